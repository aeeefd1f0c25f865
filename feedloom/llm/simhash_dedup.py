"""SimHash near-dedup: bit-sliced comparison of fingerprints within shared bit bands."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import cut, fresh, merge_labels
from feedloom.llm.components import connected_components

BITS = 64
_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes | None, words: int = 4, seed: int = 42) -> int:
    """SimHash of a UTF-8 text over its shingles, repeats included; 0 for a text that is null or has no word."""
    parts = (text or b"").lower().split()  # both know ASCII alone: A-Z, and the six blanks
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - words + 1)
    counts = np.zeros(BITS, np.int64)
    digest, last = xxhash.xxh64_intdigest, ends[min(words, len(parts)) - 1 :].tolist()
    starts = starts[:n].tolist()
    for at in range(0, n, 1 << 15):
        hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts[at : at + (1 << 15)], last[at : at + (1 << 15)], strict=True)], np.uint64)
        by_byte = np.stack([np.bincount(lane, minlength=256) for lane in hashes.view(np.uint8).reshape(-1, 8).T])
        counts += (by_byte @ _BITS_OF_BYTE).ravel()
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42, hash_col: str | None = None) -> DataFrame:
    """(doc_id, fp long) for every row of docs: the fingerprint as a signed 64-bit number. hash_col names a column for xxhash64 of the text."""
    more = [F.xxhash64(text_col).alias(hash_col)] if hash_col else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), words, seed) for t in batch.column("text").cast(pa.binary())], np.uint64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(prints.view(np.int64)), *[batch.column(c) for c in own]], ["doc_id", "fp", *own])

    own = [hash_col] if hash_col else []
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *more).mapInArrow(run, "doc_id long, fp long" + "".join(f", {c} long" for c in own))


def within(left: np.ndarray, right: np.ndarray | None, radius: int, block: int = 256) -> Iterator[tuple[int, np.ndarray]]:
    """(i, js) for every fingerprint of left that has some in right (or later in left, if right is None) within radius bits.

    The fingerprints to compare with lie in bit planes, 64 of them in a word. A block of queries adds each plane's
    differences into vertical counters with a carry-save adder; the counters start so that their carry out says "radius
    exceeded". A block is abandoned as soon as all its lanes are out.
    """
    lanes = left if right is None else right
    n = len(lanes)
    size = -(-n // 64)
    padded = np.zeros(size * 64, np.uint64)
    padded[:n] = lanes
    shifts = np.arange(BITS, dtype=np.uint64)
    planes = np.packbits(((padded[None, :] >> shifts[:, None]) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little").view(np.uint64)
    width = (radius + 1).bit_length()
    first = (1 << width) - (radius + 1)
    for at in range(0, len(left), block):
        mine = left[at : at + block]
        over = np.zeros((len(mine), size * 64), np.uint8)
        over[:, n:] = 1
        if right is None:  # only later ones: not itself, and no pair twice
            over[np.arange(size * 64)[None, :] <= np.arange(at, at + len(mine))[:, None]] = 1
        out = np.packbits(over, axis=1, bitorder="little").view(np.uint64)
        counters = [np.full(out.shape, np.uint64(0xFFFFFFFFFFFFFFFF if first >> k & 1 else 0)) for k in range(width)]
        for bit in range(BITS):
            own = (np.uint64(0) - ((mine >> np.uint64(bit)) & np.uint64(1)))[:, None]
            carry = planes[bit][None, :] ^ own
            for k in range(width):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            out |= carry
            if bit >= radius and bit % 4 == 3 and (out == np.uint64(0xFFFFFFFFFFFFFFFF)).all():
                break
        else:
            near = np.unpackbits((~out).view(np.uint8), axis=1, bitorder="little")
            for i in np.flatnonzero(near.any(axis=1)):
                yield at + int(i), np.flatnonzero(near[i])


def band_keys(fp, radius: int, shared: int) -> list:
    """Keys of which any two fingerprints within radius bits have one in common.

    The bits fall into radius + shared bands; `shared` of them hold no difference. A key is a choice of that many bands with their bits.
    """
    bands = radius + shared
    edges = [BITS * k // bands for k in range(bands + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(bands), shared)):
        mask = sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in chosen)
        keys.append(F.struct(F.lit(number).alias("band"), fp.bitwiseAND(F.lit(mask - (1 << BITS) if mask >> 63 else mask)).alias("key")))
    return keys


def links(prints: DataFrame, radius: int = 4, shared: int | None = None, tile: int = 4096) -> DataFrame:
    """(a, b): links between different fingerprints that join all fingerprints within radius bits, each bucket's as a forest.

    prints: column fp, one row per fingerprint. Buckets are the values of the band keys; one of more than `tile`
    fingerprints is cut into tiles that meet pairwise in tasks of their own, so no task holds more than two tiles.
    shared: bands that a key joins; None takes 1, 2 or 3 by the number of fingerprints, which changes the work, not the links.
    """
    if shared is None:
        n = prints.count()
        shared = 1 if n <= 1 << 22 else 2 if n <= 1 << 30 else 3
    keyed = prints.select("fp", F.explode(F.array(*band_keys(F.col("fp"), radius, shared))).alias("k")).select("fp", "k.band", "k.key")
    sizes = keyed.groupBy("band", "key").count().where("count > 1")
    keyed = keyed.join(sizes, ["band", "key"]).withColumn("tiles", F.ceil(F.col("count") / tile).cast("int"))
    keyed = keyed.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    keyed = keyed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    keyed = keyed.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")})
    in_x, apart = F.col("own") == F.col("x"), F.col("x") != F.col("y")
    buckets = keyed.groupBy("band", "key", "x", "y").agg(
        F.collect_list(F.when(in_x, F.col("fp"))).alias("left"),
        F.collect_list(F.when(~in_x, F.col("fp"))).alias("right"),
        F.first(apart).alias("apart"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[np.ndarray] = []
            for left, right, two in zip(batch.column("left"), batch.column("right"), batch.column("apart").to_pylist(), strict=True):
                a, b = (np.asarray(x.values).astype(np.int64).view(np.uint64) for x in (left, right))
                every = np.concatenate((a, b)) if two else a
                labels = np.arange(len(every))
                found = False
                for i, js in within(a, b if two else None, radius):
                    merge_labels(labels, i, js + len(a) if two else js)
                    found = True
                if found:
                    linked = np.flatnonzero(labels != np.arange(len(every)))
                    out.append(np.stack((every[linked], every[labels[linked]])).view(np.int64))
            both = np.concatenate(out, axis=1) if out else np.empty((2, 0), np.int64)
            yield pa.record_batch([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    return buckets.select("left", "right", "apart").mapInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42, radius: int = 4, shared: int | None = None, tile: int = 4096, hash_col: str | None = None) -> DataFrame:
    """(doc_id, fp, component_id, and hash_col if it is named) for every row: documents whose fingerprints differ in radius bits or fewer are linked.

    component_id is the smallest id that links reach. A null, empty or blank text has fingerprint zero and is linked
    like any other. Rows with equal fingerprints are one class before anything is compared, so copies cost one row
    each. A row without an id has the component of its fingerprint, null if no row there has an id; rows that repeat
    an id are separate rows. No rows give no rows; other columns are not read.
    """
    prints = cut(fingerprints(docs, id_col, text_col, words, seed, hash_col), "prints")
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    parts = connected_components(links(classes.select("fp"), radius, shared, tile))
    named = classes.join(parts, classes.fp == parts.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    heads = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(heads, "component").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id", *[hash_col] if hash_col else [])


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of docs with all their columns, of each linked group only the document with the smallest id.

    Rows are told apart by id and text: of rows that share an id but not the text, those go that some smaller id is linked to.
    Rows without an id are kept, as they can't be told from the one to keep; rows that repeat the kept id in its group all stay.
    """
    of_id, of_text = fresh(docs.columns, "gone_id", "gone_th")
    gone = simhash_components(docs, id_col, text_col, hash_col=of_text, **settings).where("doc_id != component_id").select(F.col("doc_id").alias(of_id), of_text).distinct()
    return docs.join(gone, (docs[id_col].cast("long") == gone[of_id]) & (F.xxhash64(docs[text_col]) == gone[of_text]), "left_anti")
