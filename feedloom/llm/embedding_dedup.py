"""Embedding near-dedup: subspace pigeonhole join over blocks of rotated vectors, verified exactly."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import cut, dealt_join, hot_keys, merge_labels
from feedloom.llm.components import connected_components


@lru_cache(maxsize=8)
def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, the same in every process."""
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))[0]


def block_edges(dim: int, blocks: int) -> list[int]:
    count = min(blocks, dim)
    return [dim * k // count for k in range(count + 1)]


def budgets(dim: int, blocks: int, threshold: float) -> list[float]:
    """The squared distance of two unit vectors at the threshold, dealt to the blocks in proportion to their dimensions.

    If the blocks' squared distances add up to no more than the whole, some block keeps within its own share.
    """
    edges = block_edges(dim, blocks)
    return [2 * (1 - threshold) * (edges[k + 1] - edges[k]) / dim + 1e-9 for k in range(len(edges) - 1)]


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors as rows in double precision, each scaled to components of 1 at most."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)
    # by a power of two near its largest component, which rounds nothing: squares neither overflow nor vanish
    return np.ldexp(values, -np.frexp(np.abs(values).max(axis=1, keepdims=True, initial=0))[1])


def pigeonhole_links(vectors: DataFrame, threshold: float = 0.9, blocks: int = 4, tile: int = 16384) -> DataFrame:
    """(id, n_links, root): what each task found for a vector: links counted with the others' sizes, and a vector it hangs on.

    vectors: id, size (copies), vec (array of numbers, none null or non-finite, not all zero), one row per distinct
    vector. Vectors are brought to unit length and rotated; each block is joined over slabs, as wide as the block's
    radius, of its first coordinate: a slab meets itself and the next. A slab of more than `tile` vectors is cut into
    tiles that meet in tasks of their own. A task compares blocks first, and the whole vectors of those within
    the block's budget in double precision. A pair counts in the first block that keeps within budget, so once.
    """

    spark = vectors.sparkSession
    dims = [r[0] for r in vectors.select(F.size("vec").alias("dim")).distinct().collect()]  # as many as there are vector lengths
    parts = []
    for dim in dims:
        parts.append(_links_of(spark, vectors.where(F.size("vec") == dim), dim, threshold, blocks, tile))
    if not parts:
        return spark.createDataFrame([], "id long, n_links long, root long")
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _links_of(spark, vectors: DataFrame, dim: int, threshold: float, blocks: int, tile: int) -> DataFrame:
    edges, share = block_edges(dim, blocks), budgets(dim, blocks, threshold)
    count = len(share)
    width = [math.sqrt(s) * 1.0001 for s in share]

    def slab_of(batches):
        heads = rotation(dim)[:, edges[:-1]]
        for batch in batches:
            unit = _matrix(batch.column("vec"))
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            slabs = np.floor(unit @ heads / np.array(width)).astype(np.int32)
            yield pa.record_batch([batch.column("id"), batch.column("size"), batch.column("vec"), pa.ListArray.from_arrays(pa.array(np.arange(0, slabs.size + 1, count, dtype=np.int32)), pa.array(slabs.ravel()))], ["id", "size", "vec", "slabs"])

    kind = vectors.schema["vec"].dataType.simpleString()
    placed = vectors.select("id", "size", "vec").mapInArrow(slab_of, f"id long, size long, vec {kind}, slabs array<int>")
    placed = placed.select("id", "size", "vec", F.posexplode("slabs").alias("block", "slab"))
    # a slab's first coordinate is between -1 and 1, so there are few slabs in any data
    filled = {(r["block"], r["slab"]): -(-r["count"] // tile) for r in placed.groupBy("block", "slab").count().collect()}
    table = spark.createDataFrame(
        [(b, s, n, filled.get((b, s - 1), 0), filled.get((b, s + 1), 0)) for (b, s), n in filled.items()],
        "block int, slab int, tiles int, below int, above int",
    )
    placed = placed.join(F.broadcast(table), ["block", "slab"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))

    def upto(n):
        return F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))

    met = F.concat(
        F.transform(upto("tiles"), lambda o: F.struct(F.col("slab").alias("s"), F.least("own", o).alias("x"), F.lit(0).alias("step"), F.greatest("own", o).alias("y"), (F.col("own") <= o).alias("first"))),
        F.transform(upto("above"), lambda o: F.struct(F.col("slab").alias("s"), F.col("own").alias("x"), F.lit(1).alias("step"), o.alias("y"), F.lit(True).alias("first"))),
        F.transform(upto("below"), lambda o: F.struct((F.col("slab") - 1).alias("s"), o.alias("x"), F.lit(1).alias("step"), F.col("own").alias("y"), F.lit(False).alias("first"))),
    )
    placed = placed.select("id", "size", "vec", "block", F.explode(met).alias("m")).select("id", "size", "vec", "block", "m.*")

    def compare(table: pa.Table) -> pa.Table:
        block, same = table["block"][0].as_py(), table["step"][0].as_py() == 0 and table["x"][0].as_py() == table["y"][0].as_py()
        ids, sizes = np.asarray(table["id"]), np.asarray(table["size"])
        unit = _matrix(table["vec"])
        raw_norm = np.linalg.norm(unit, axis=1)
        turned = (unit / raw_norm[:, None]) @ rotation(dim)
        low = np.ascontiguousarray(turned[:, edges[block] : edges[block + 1]], np.float32)
        square, ones = (low * low).sum(axis=1, keepdims=True), np.ones((len(ids), 1), np.float32)
        # one product gives the squared distances of blocks: |x|^2 + |y|^2 - 2 x y
        of_left, of_right = np.hstack((low, square, ones)), np.hstack((-2 * low, ones, square))
        first = np.asarray(table["first"]).astype(bool)
        left, right = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(first), np.flatnonzero(~first))
        counts, labels = np.zeros(len(ids), np.int64), np.arange(len(ids))
        of_right = np.ascontiguousarray(of_right[right].T)
        for at in range(0, len(left), 256):
            rows = left[at : at + 256]
            near = of_left[rows] @ of_right <= share[block] + 1e-5
            if same:
                near &= right[None, :] > rows[:, None]
            some = near.any(axis=1)
            if not some.any():
                continue
            rows, near = rows[some], near[some]
            columns = near.any(axis=0)
            cols, near = right[columns], near[:, columns]
            near &= (unit[rows] @ unit[cols].T) / (raw_norm[rows][:, None] * raw_norm[cols][None, :]) >= threshold
            for k in range(block + 1):
                a, b = turned[rows, edges[k] : edges[k + 1]], turned[cols, edges[k] : edges[k + 1]]
                inside = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T) <= share[k]
                near &= inside if k == block else ~inside
            counts[rows] += near @ sizes[cols]
            counts[cols] += sizes[rows] @ near
            for i in np.flatnonzero(near.any(axis=1)):
                merge_labels(labels, rows[i], cols[near[i]])
        hit = np.flatnonzero(counts)
        return pa.table({"id": ids[hit], "n_links": counts[hit], "root": ids[labels[hit]]})

    return placed.groupBy("block", "s", "x", "step", "y").applyInArrow(compare, "id long, n_links long, root long")


def embedding_components(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, blocks: int = 4, tile: int = 16384) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row; vectors of cosine >= threshold in double precision are linked.

    n_links counts the other rows linked directly, component_id is the smallest id that links reach. Vectors that are
    null, empty, all zero or hold null or non-finite components link with nothing, nor do vectors of different length.
    Components are compared as they are stored, float or double; other numbers become doubles. Equal vectors are one class
    before the join and count with its size; classes are numbered once, when they are written, and rows find their class by the
    vector itself, those of hot vectors dealt over tasks. A row without an id counts in its class; its component is the
    class's. No rows give no rows; other columns are not read.
    """
    element = vectors.schema[vec_col].dataType.elementType.simpleString()
    kind = element if element in ("float", "double") else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(f"array<{kind}>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")).cast(kind)))
    valid = F.coalesce(F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    same = F.transform("vec", lambda x: F.when(x == 0, F.lit(0).cast(kind)).otherwise(x))  # -0.0 is 0.0
    rows = rows.withColumn("vec", F.when(valid, same)).withColumn("h", F.xxhash64("vec"))
    classes = rows.where("vec is not null").groupBy("h", "vec").agg(F.count("*").alias("size"), F.min("vec_id").alias("least"))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    found = cut(pigeonhole_links(classes.select("id", "size", "vec"), threshold, blocks, tile), "found")
    parts = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("id").agg(F.sum("n_links").alias("n"))
    named = classes.join(parts, classes.id == parts.node, "left").join(counts, "id", "left").select("h", F.col("vec").alias("of"), "least", "size", F.coalesce("component", "id").alias("component"), F.coalesce("n", F.lit(0)).alias("n"))
    heads = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(heads, "component").select("h", "of", (F.col("n") + F.col("size") - 1).alias("n_links"), "component_id")
    hot = hot_keys(classes.groupBy("h").agg(F.sum("size").alias("n")), "h")
    joined = dealt_join(rows.where("vec is not null"), named, "h", hot, ["vec_id"]).where("vec = of").select("vec_id", "n_links", "component_id")
    alone = rows.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
