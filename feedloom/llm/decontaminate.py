"""Benchmark decontamination: a prefix-filtered set join of item windows with documents, verified exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import cut, dealt_join, discard, hot_keys, mix, span_hashes, spans

IN_WORD = np.zeros(256, bool)
IN_WORD[0x30:0x3A] = IN_WORD[0x61:0x7B] = IN_WORD[0x80:] = True
COUNTERS = 1 << 18


def rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` word hashes."""
    if len(hashes) < size:
        return np.empty(0, np.uint64)
    out = np.zeros(len(hashes) - size + 1, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(out)]
    return mix(out)


def _words(text: bytes | None) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """A text with A-Z lower-cased, the starts, ends and hashes of its words; none for null."""
    lowered = (text or b"").lower()
    buffer = np.frombuffer(lowered, np.uint8)
    starts, ends = spans(buffer, IN_WORD)
    return lowered, starts, ends, span_hashes(buffer, starts, ends)


def _join(text: bytes, starts: np.ndarray, ends: np.ndarray, low: int, high: int) -> bytes:
    return b" ".join(text[s:e] for s, e in zip(starts[low:high].tolist(), ends[low:high].tolist(), strict=True))


def _windows(bench: DataFrame, window: int, shingle: int) -> DataFrame:
    """(words, length, size, runs, items): each window once, with the hashes of its shingles in order and the items that have it.

    A window is `window` consecutive words of an item, or all words of a shorter one; shingles have `shingle` words, or all
    of a window that is shorter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                lowered, starts, ends, hashes = _words(text)
                if not len(starts):
                    continue
                length = min(window, len(starts))
                size = min(shingle, length)
                runs, every = rolled(hashes, size).view(np.int64), len(starts) - length + 1
                for low in range(0, every, 10_000):
                    at = range(low, min(every, low + 10_000))
                    words = [_join(lowered, starts, ends, k, k + length) for k in at]
                    own = [runs[k : k + length - size + 1].tolist() for k in at]
                    yield pa.record_batch({"item": pa.array([item] * len(at)), "words": pa.array(words, pa.binary()), "length": pa.array([length] * len(at), pa.int32()), "size": pa.array([size] * len(at), pa.int32()), "runs": pa.array(own, pa.list_(pa.int64()))})

    found = bench.mapInArrow(run, "item string, words binary, length int, size int, runs array<long>")
    return found.groupBy("words").agg(F.first("length").alias("length"), F.first("size").alias("size"), F.first("runs").alias("runs"), F.array_sort(F.collect_set("item")).alias("items"))


def _counters(texts: DataFrame, sizes: list[int]) -> np.ndarray:
    """How many shingles of all documents fall into each of a fixed number of counters: a shingle occurs no more often than its counter says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, held = np.zeros(COUNTERS, np.int64), [], 0
        for batch in batches:
            for text in batch.column("text").cast(pa.binary()):
                hashes = _words(text.as_py())[3]
                waiting += [rolled(hashes, size) & np.uint64(COUNTERS - 1) for size in sizes]
                held += len(hashes)
                if held > 1_000_000:
                    total += np.bincount(np.concatenate(waiting).astype(np.int64), minlength=COUNTERS)
                    waiting, held = [], 0
        if waiting:
            total += np.bincount(np.concatenate(waiting).astype(np.int64), minlength=COUNTERS)
        hit = np.flatnonzero(total)
        yield pa.record_batch({"counter": pa.array(hit, pa.int64()), "n": pa.array(total[hit], pa.int64())})

    summed = texts.mapInArrow(run, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()  # as many rows as counters
    out = np.zeros(COUNTERS, np.int64)
    out[summed["counter"].to_numpy()] = summed["n"].to_numpy()
    return out


def _prefixes(windows: DataFrame, counters) -> DataFrame:
    """(key, at, words, length, items): each window by its prefix, its rarest shingle, and that one's place in it.

    All shingles of a window must occur for it to be contained, so a prefix of one is enough; a window with a shingle
    that occurs in no document is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counters.value
        for batch in batches:
            runs = batch.column("runs").to_pylist()
            often = [counts[np.array(r, np.int64) & (COUNTERS - 1)].tolist() for r in runs]
            at = [min(range(len(r)), key=lambda k, r=r, n=n: (n[k], r[k], k)) for r, n in zip(runs, often, strict=True)]
            own = {"key": pa.array([r[k] for r, k in zip(runs, at, strict=True)], pa.int64()), "at": pa.array(at, pa.int64())}
            out = pa.record_batch({**own, "words": batch.column("words"), "length": batch.column("length"), "items": batch.column("items")})
            yield out.filter(pa.array([n[k] > 0 for n, k in zip(often, at, strict=True)], pa.bool_()))

    return windows.mapInArrow(run, "key long, at long, words binary, length int, items array<string>")


def _filter(prefixes: DataFrame, most_bytes: int) -> np.ndarray:
    """A table of bits, set where a prefix hashes to: a thousand bits a prefix or more, but most_bytes at most, which lets more through and drops none."""
    n = prefixes.select("key").distinct().count()
    bits = 1 << max(6, min((1024 * n).bit_length(), (8 * most_bytes).bit_length() - 1))
    place = prefixes.select(F.col("key").bitwiseAND(F.lit(bits - 1).cast("long")).alias("p")).distinct()
    filled = place.groupBy(F.expr("p div 64").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[filled["at"].to_numpy()] = filled["bits"].to_numpy().view(np.uint64)
    return out


def _probe(texts: DataFrame, known, sizes: list[int], window: int, shingle: int) -> DataFrame:
    """(doc_id, h, n_words, hits): the places whose shingle passes the prefix filter, each with the words that a window there can reach."""

    def near(size: int, place: int, n: int) -> tuple[int, int]:
        reach = window - size if size == shingle else 0  # a shorter shingle is all of its window
        return max(0, place - reach), min(n, place + size + reach)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value
        mask = 64 * len(table) - 1
        for batch in batches:
            counts, hits, begin, held = [], [], 0, 0
            texts_of = batch.column("text").cast(pa.binary())
            for row, text in enumerate(texts_of):
                lowered, starts, ends, hashes = _words(text.as_py())
                own = []
                for size in sizes:
                    runs = rolled(hashes, size).view(np.int64)
                    place = runs & mask
                    passed = table[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)
                    for p in np.flatnonzero(passed).tolist():
                        low, high = near(size, p, len(starts))
                        own.append({"key": int(runs[p]), "place": p, "low": low, "near": _join(lowered, starts, ends, low, high)})
                counts.append(len(starts))
                hits.append(own)
                held += len(own)
                if held > 50_000 or row + 1 == len(texts_of):
                    part = batch.slice(begin, len(hits))
                    yield pa.record_batch({"doc_id": part.column("doc_id"), "h": part.column("h"), "n_words": pa.array(counts, pa.int64()), "hits": pa.array(hits, _HITS)})
                    counts, hits, begin, held = [], [], row + 1, 0

    return texts.mapInArrow(run, "doc_id long, h long, n_words long, hits array<struct<key:long,place:long,low:long,near:binary>>")


_HITS = pa.list_(pa.struct([("key", pa.int64()), ("place", pa.int64()), ("low", pa.int64()), ("near", pa.binary())]))
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _occurring(hits: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(doc_id, h, start, end, items) of every window that occurs: joined by prefix, kept by length and place, compared word by word."""
    places = hits.where(F.size("hits") > 0).select("doc_id", "h", "n_words", F.explode("hits").alias("x")).select("doc_id", "h", "n_words", "x.*")
    hot = hot_keys(places.groupBy("key").agg(F.count("*").alias("n")), "key")
    both = dealt_join(places, prefixes, "key", hot, ["doc_id", "h", "place"]).withColumn("start", F.col("place") - F.col("at"))
    both = both.where((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("n_words")))
    there = F.slice(F.split(F.col("near").cast("string"), " "), F.greatest(F.lit(1), F.col("start") - F.col("low") + 1).cast("int"), F.col("length"))
    same = F.array_join(there, " ") == F.col("words").cast("string")
    return both.where(same).select("doc_id", "h", "start", (F.col("start") + F.col("length")).alias("end"), "items")


def joined(parts) -> list[list[int]]:
    """The runs that overlapping or adjacent (start, end) spans cover."""
    runs: list[list[int]] = []
    for start, end in sorted(parts):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    return runs


def _by_document(occurring: DataFrame) -> DataFrame:
    """(_doc, _h, spans, items): one row for each text with an occurring window."""
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_set("items"))))
    merged = occurring.groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", "end")).alias("spans"), items.alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [[{"start": s, "end": e} for s, e in joined((x["start"], x["end"]) for x in row)] for row in batch.column("spans").to_pylist()]
            yield pa.record_batch({"_doc": batch.column("doc_id"), "_h": batch.column("h"), "spans": pa.array(runs, _SPANS), "items": batch.column("items")})

    return merged.mapInArrow(run, "_doc long, _h long, spans array<struct<start:long,end:long>>, items array<string>")


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_chars: int = 4_000_000, hash_col: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items) for every row of docs.

    n_hit counts the words inside any occurrence of a window; spans are their runs (start and end word, end not
    included); items are the ids, as strings in order, of items with a window that occurs. Shingles of all documents are
    counted first, which orders those of each window by rarity; the rarest is the window's prefix. A second reading of
    the documents keeps the places that pass a filter of all prefixes, with the words a window can reach from there. These few
    are joined with the windows by prefix, over the cluster, bounded by length and place, and compared word by word.
    Documents are read twice whatever the benchmark's size. What is broadcast is the counters, of a fixed number, and the
    filter, of `broadcast_chars` bytes at most: a larger benchmark fills it more, and the join drops what it lets through.
    Places of a hot shingle are dealt over tasks. Null texts and texts without words have no words and no hits; items without
    words have no window; a null item id counts as an empty string. Rows that repeat are answered each. No items leave all
    documents clean. hash_col names a column for xxhash64 of the text, which with the id tells a row from others of its id.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    bench = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    windows = cut(_windows(bench, window, shingle), "windows")
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # `shingle` of them at most
    prefixes = cut(_prefixes(windows, spark.sparkContext.broadcast(_counters(texts.select("text"), sizes))), "prefixes")
    hits = cut(_probe(texts, spark.sparkContext.broadcast(_filter(prefixes, broadcast_chars)), sizes, window, shingle), "hits")
    discard(windows)
    found = _by_document(_occurring(hits, prefixes))
    nothing = [F.array().cast("array<struct<start:long,end:long>>").alias("spans"), F.array().cast("array<string>").alias("items")]
    some = hits.where(F.size("hits") > 0).join(found, hits.doc_id.eqNullSafe(F.col("_doc")) & (hits.h == F.col("_h")), "left")
    some = some.select("doc_id", "h", "n_words", F.coalesce("spans", nothing[0]).alias("spans"), F.coalesce("items", nothing[1]).alias("items"))
    every = some.union(hits.where(F.size("hits") == 0).select("doc_id", "h", "n_words", *nothing))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    of_text = [F.col("h").alias(hash_col)] if hash_col else []
    return every.select("doc_id", "n_words", n_hit.alias("n_hit"), "spans", "items", *of_text)
