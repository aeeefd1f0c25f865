"""Ranked lexical search over a two-level index: byte impacts bound the scores, exact integers rescore what the bounds leave."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import cut

#: Impacts are under a million; a byte holds them in steps of this size, rounded up.
STEP = 3922

_IMPACT = "((1000000000L * {tf}) div (1000L * {tf} + 20L * m))"
#: Each byte to itself, A-Z to a-z, what is no part of a term to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text: runs of letters, digits and whatever is not ASCII, A-Z lower-cased."""
    return text.translate(_FOLD).split() if text else []


def _lists(values: list[list], kind: pa.DataType) -> pa.Array:
    return pa.array(values, pa.list_(kind))


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [sorted(set(terms_of(t))) for t in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("item"), batch.column("item_id"), _lists(words, pa.binary())], ["item", "item_id", "words"])


def _counter(known: dict[bytes, int] | None):
    """Counts terms by document: those of known as their numbers, or all of them as words where known is None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, counts = [], [], []
            for text in batch.column("text").to_pylist():
                words = terms_of(text)
                found = Counter(words if known is None else map(known.get, words))
                found.pop(None, None)
                n.append(len(words))
                keys.append(sorted(found))
                counts.append([found[key] for key in keys[-1]])
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), _lists(keys, pa.binary() if known is None else pa.int64()), _lists(counts, pa.int64())], ["doc_id", "n", "terms", "tfs"])

    return run


def term_counts(docs: DataFrame, vocabulary: DataFrame, local_bytes: int) -> DataFrame:
    """(doc_id, n, terms, tfs) for each document: its number of terms, and those of the vocabulary (word, term) with their counts.

    A vocabulary of up to local_bytes travels to the tasks, which then keep its terms only; a larger one is joined over the cluster with every document's terms.
    """
    size = vocabulary.agg(F.sum(F.length("word"))).first()[0] or 0
    if size <= local_bytes:
        known = {bytes(r["word"]): r["term"] for r in vocabulary.collect()}  # bounded by local_bytes
        return docs.mapInArrow(_counter(known), "doc_id long, n long, terms array<long>, tfs array<long>")
    every = cut(docs.mapInArrow(_counter(None), "doc_id long, n long, terms array<binary>, tfs array<long>").withColumn("row", F.monotonically_increasing_id()), "words")
    met = every.select("row", F.explode(F.arrays_zip(F.col("terms").alias("word"), F.col("tfs").alias("tf"))).alias("w")).select("row", "w.word", "w.tf").join(vocabulary, "word")
    met = met.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("term", "tf"))).alias("c"))  # as many as the document has terms
    empty = F.array().cast("array<long>")
    return every.select("row", "doc_id", "n").join(met, "row", "left").select("doc_id", "n", F.coalesce("c.term", empty).alias("terms"), F.coalesce("c.tf", empty).alias("tfs"))


def _bounds(items: pa.Table, index: pa.Table, k: int) -> pa.Table:
    """(item, row, hi, lo): of each item the documents whose upper bound reaches the kth highest lower bound among these documents."""
    out: list[pa.Table] = []
    if items.num_rows and index.num_rows:
        rows, lists, impacts = np.asarray(index["row"]), index["terms"].combine_chunks(), index["impacts"].combine_chunks()
        doc = np.repeat(np.arange(len(rows)), np.diff(np.asarray(lists.offsets)))
        terms, impact = np.asarray(lists.flatten()), np.asarray(impacts.flatten()).astype(np.int64) + 128
        order = np.argsort(terms, kind="stable")
        terms, doc, impact = terms[order], doc[order], impact[order]
        for item, wanted, weights in zip(items["item"].to_pylist(), items["terms"].to_pylist(), items["weights"].to_pylist(), strict=True):
            hi, loose = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            for a, b, w in zip(np.searchsorted(terms, wanted, "left"), np.searchsorted(terms, wanted, "right"), weights, strict=True):
                hi[doc[a:b]] += w * STEP * impact[a:b]
                loose[doc[a:b]] += w * (STEP - 1) * (impact[a:b] > 0)
            lo, some = hi - loose, hi > 0
            if some.sum() > k:
                some &= hi >= np.partition(lo, len(lo) - k)[len(lo) - k]
            out.append(pa.table({"item": np.full(int(some.sum()), item, np.int64), "row": rows[some], "hi": hi[some], "lo": lo[some]}))
    return pa.concat_tables(out) if out else pa.table({n: pa.array([], pa.int64()) for n in ("item", "row", "hi", "lo")})


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shard: int = 8192, block_terms: int = 1 << 20, local_bytes: int = 8 << 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each item; ties by ascending doc_id, null ids last.

    With N documents that have terms, L terms in all, n terms of a document, df documents that hold a term, tf its occurrences, all in
    64-bit integers but w: w = floor(1000 * ln((2N + 2) / (2df + 1))), m = 50 + (50nN div L), and a score sums w * (10^9 tf div (1000tf + 20m)) over an item's terms.
    Null and empty texts have no terms: such documents and items have no rows. Each row of docs and of items stands for itself, also where ids are
    repeated or null. No rows give no rows; other columns are not read.

    The index holds the items' terms only, one row a document: bytes that bound each impact from above (first level) and exact counts (second level), in
    columns of their own. Documents of one length and the same counts score the same for any item, so the k of smallest id stand for all of them.
    Items and documents are dealt into blocks, a pair of which is one task's cell. A cell bounds scores from the bytes and hands on what may be among its best k; from these
    comes the kth highest lower bound of each item, and each document whose upper bound reaches it is scored again from the exact counts.
    """
    asked = items.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("item_id"), F.col(item_text).cast("binary").alias("text"))
    item_type = items.schema[item_col].dataType.simpleString()
    asked = cut(asked.mapInArrow(_item_terms, f"item long, item_id {item_type}, words array<binary>"), "items")
    vocabulary = cut(asked.select(F.explode("words").alias("word")).distinct().withColumn("term", F.monotonically_increasing_id()), "vocabulary")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    counts = cut(term_counts(texts, vocabulary, local_bytes), "counts")
    n_docs, n_terms = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.count("*") + 1)))
    weights = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(weight.alias("w"))
    weighed = asked.select("item", "item_id", F.explode("words").alias("word")).join(vocabulary, "word").join(weights, "term")
    weighed = weighed.groupBy("item", "item_id").agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias("t")).select("item", "item_id", F.col("t.term").alias("terms"), F.col("t.w").alias("weights"))
    weighed = cut(weighed, "weighed")

    same = Window.partitionBy(F.xxhash64("n", "terms", "tfs"), "n", "terms", "tfs").orderBy(F.asc_nulls_last("doc_id"))
    index = counts.where(F.size("terms") > 0).withColumn("_place", F.row_number().over(same)).where(F.col("_place") <= k).drop("_place")
    index = index.withColumn("m", F.expr(f"50L + (cast(50 as decimal(2,0)) * cast(n as decimal(16,0)) * cast({n_docs} as decimal(18,0))) div cast({max(n_terms, 1)} as decimal(20,0))"))
    index = index.withColumn("impacts", F.expr(f"transform(tfs, tf -> cast(({_IMPACT.format(tf='tf')} + {STEP - 1}) div {STEP} - 128 as tinyint))"))
    index = cut(index.select(F.monotonically_increasing_id().alias("row"), "doc_id", "m", "terms", "tfs", "impacts"), "index")

    shards = max(1, -(-index.count() // shard))
    blocks = max(1, -(-(weighed.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_terms))
    dealt = lambda key, ways: F.pmod(F.xxhash64(key), F.lit(ways)).cast("int")
    spread = lambda ways: F.explode(F.sequence(F.lit(0), F.lit(ways - 1)))
    left = weighed.select("item", "terms", "weights", dealt("item", blocks).alias("block"), spread(shards).alias("shard"))
    right = index.select("row", "terms", "impacts", dealt("row", shards).alias("shard"), spread(blocks).alias("block"))
    cells = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard"))
    bounds = cut(cells.applyInArrow(lambda a, b: _bounds(a, b, k), "item long, row long, hi long, lo long"), "bounds")

    best = bounds.withColumn("_place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("lo")))).where(F.col("_place") <= k)
    floors = best.groupBy("item").agg(F.when(F.count("*") == k, F.min("lo")).otherwise(0).alias("floor"))
    reached = bounds.join(floors, "item").where("hi >= floor").select("item", "row")
    exact = reached.join(index.select("row", "doc_id", "m", F.col("terms").alias("held"), "tfs"), "row").join(weighed, "item")
    tf = "get(tfs, cast(array_position(held, x.terms) - 1 as int))"
    exact = exact.withColumn("score", F.expr(f"aggregate(arrays_zip(terms, weights), 0L, (s, x) -> s + coalesce(x.weights * {_IMPACT.format(tf=tf)}, 0L))"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranks = exact.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranks.select("item_id", "rank", "doc_id", "score")
