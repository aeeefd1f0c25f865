"""Exact top-k search by inner product: branch and bound over dimension blocks in a vertical layout."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import cut

_LARGEST = (1 << 63) - 1


def branch_and_bound(query: np.ndarray, vertical: np.ndarray, mass: np.ndarray, k: int, floor: float, block: int, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, scores, products): the candidates among alive whose score is among the k highest and not under floor, with ties at the kth.

    vertical: a row a dimension, a column a candidate; mass: squared norms of each candidate's dimension blocks. Blocks are taken by
    falling mass of the query. What the blocks to come can add is at most the product of both remaining norms; candidates
    whose sum so far plus that is under the kth highest sum less that, or under floor, are compacted away. All numbers are integers below 2^53 in doubles.
    """
    edges = range(0, len(query), block)
    own = np.array([(query[e : e + block] ** 2).sum() for e in edges])
    part, rest, left, products = np.zeros(len(alive)), mass.sum(axis=0)[alive], own.sum(), 0
    everything = len(alive) == vertical.shape[1]
    for step, b in enumerate(np.argsort(-own, kind="stable")):
        rows = slice(b * block, b * block + block)
        part += query[rows] @ (vertical[rows] if everything else vertical[rows][:, alive])
        products += len(alive)
        if step == len(own) - 1:
            break
        left -= own[b]
        rest = rest - (mass[b] if everything else mass[b][alive])
        slack = np.sqrt(left * np.maximum(rest, 0)) * (1 + 1e-9) + 1e-6
        if len(alive) > k:
            floor = max(floor, np.partition(part - slack, len(alive) - k)[len(alive) - k])
        keep = part + slack >= floor
        if keep.sum() < 0.9 * len(keep):
            alive, part, rest, everything = alive[keep], part[keep], rest[keep], False
            if not len(alive):
                break
    if len(alive) > k:
        floor = max(floor, np.partition(part, len(alive) - k)[len(alive) - k])
    keep = part >= floor
    return alive[keep], part[keep].astype(np.int64), products


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten(), np.int64).reshape(len(column), dim)


def _search(queries: pa.Table, vectors: pa.Table, k: int, block: int) -> pa.Table:
    """The k best of the given vectors for each query, as (q_row, query_id, vec_id, score)."""
    found: list[tuple] = []
    if queries.num_rows and vectors.num_rows:
        dim = queries["q_dim"][0].as_py()
        q, c = _matrix(queries["q_vec"], dim), _matrix(vectors["vec"], dim)
        rows, ids = np.asarray(vectors["row"]), vectors["vec_id"].combine_chunks()
        no_id, ids = np.asarray(ids.is_null()), np.asarray(ids.fill_null(0))
        wide = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * dim >= 1 << 52
        vertical = np.ascontiguousarray(c.T.astype(object if wide else np.float64))
        mass = np.array([(vertical[e : e + block] ** 2).sum(axis=0) for e in range(0, dim, block)]).reshape(-1, len(c))
        for vec, row, query_id, floor in zip(q, queries["q_row"].to_pylist(), queries["query_id"].to_pylist(), queries["floor"].to_pylist(), strict=True):
            alive = np.flatnonzero(rows != row) if (rows == row).any() else np.arange(len(c))
            if not len(alive):
                continue
            if wide:  # products beyond what doubles hold: all of them, in Python's integers
                scores = vec.astype(object) @ vertical[:, alive]
                order = sorted(range(len(alive)), key=lambda j: (-scores[j], no_id[alive[j]], ids[alive[j]]))[:k]
            else:
                alive, scores, _ = branch_and_bound(vec.astype(np.float64), vertical, mass, k, -np.inf if floor is None else floor, block, alive)
                order = np.lexsort((ids[alive], no_id[alive], -scores))[:k]
            found += [(row, query_id, None if no_id[alive[j]] else int(ids[alive[j]]), max(-_LARGEST - 1, min(_LARGEST, int(scores[j])))) for j in order]
    return pa.table({n: pa.array([f[i] for f in found], pa.int64()) for i, n in enumerate(("q_row", "query_id", "vec_id", "score"))})


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, scale: int = 256, block: int = 8, tile: int = 65536) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that is_query names the k other rows of highest integer inner product.

    Vectors count as floor(scale * x) of their components; null ones, those that hold null or non-finite components, and those
    beyond 2^62 take no part. is_query is an expression over vec_id (null: no query). Ties go to the smaller id, null ids last.
    Each row stands for itself: rows that share an id are queries and candidates of their own, also of each other. Only vectors of equal length
    meet. Fewer than k others give fewer rows, no rows none. Scores beyond 64 bits stop there, after ranking. Other columns are not read.

    Queries and vectors are dealt into blocks of `tile` rows at most (smaller ones while there are fewer than three a core), and each pair of blocks is one
    task's cell, in memory of two tiles. One tile is searched first: its kth score bounds the others from below, which so hand on little.
    """
    spark, x = vectors.sparkSession, F.col("vec")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * scale) < float(1 << 62)))
    rows = rows.where(F.coalesce(whole, F.lit(False))).select("vec_id", F.transform(x, lambda v: F.floor(v * scale)).alias("vec"), F.size(x).alias("dim"))
    table = cut(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    asked = table.where(is_query)
    n, n_asked = table.count(), asked.count()
    tiles = -(-n // min(tile, max(1024, n // (3 * spark.sparkContext.defaultParallelism)))) if n else 1
    blocks = max(1, -(-n_asked // tile))
    dealt = lambda key, ways: F.pmod(F.xxhash64(key), F.lit(ways)).cast("int")
    spread = lambda first, ways: F.explode(F.sequence(F.lit(first), F.lit(ways - 1)))
    candidates = table.select("row", "vec_id", "vec", "dim", dealt("row", tiles).alias("tile"))
    asked = asked.select(F.col("row").alias("q_row"), F.col("vec_id").alias("query_id"), F.col("vec").alias("q_vec"), F.col("dim").alias("q_dim"), dealt("row", blocks).alias("q_block"))

    def searched(queries: DataFrame, vectors: DataFrame) -> DataFrame:
        left, right = queries.groupBy("q_dim", "q_block", "q_tile"), vectors.withColumn("block", spread(0, blocks)).groupBy("dim", "block", "tile")
        return left.cogroup(right).applyInArrow(lambda a, b: _search(a, b, k, block), "q_row long, query_id long, vec_id long, score long")

    found = cut(searched(asked.withColumns({"q_tile": F.lit(0), "floor": F.lit(None).cast("long")}), candidates.where("tile = 0")), "first")
    if tiles > 1:
        floors = found.groupBy("q_row").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") == k).drop("n")
        others = asked.join(floors, "q_row", "left").withColumn("q_tile", spread(1, tiles))
        found = found.unionByName(searched(others, candidates.where("tile > 0")))
    order = Window.partitionBy("q_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
