"""What the operators of this package share: cutting lineage, hashing of words and n-grams in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions.lineage import cut

__all__ = ["cut", "dealt_join", "discard", "fresh", "gram_hashes", "held_out", "hot_keys", "merge_labels", "mix", "span_hashes", "spans"]


def hot_keys(counted: DataFrame, key: str, n: str = "n", share: int = 1000) -> list:
    """Keys that hold more than a share-th of all counted rows (key once each, n: its rows); by that there are fewer than `share`."""
    total, most = counted.agg(F.sum(n), F.max(n)).first()
    if not total or most * share <= total:
        return []
    return [row[0] for row in counted.where(F.col(n) * share > total).select(key).collect()]


def dealt_join(rows: DataFrame, keyed: DataFrame, key: str, hot: list, deal_by: list[str], ways: int = 64) -> DataFrame:
    """rows inner-joined with keyed (each key once) on the key; rows of hot keys are dealt over `ways` tasks, their keyed rows copied there."""
    if not hot:
        return rows.join(keyed, key)
    is_hot = F.col(key).isin(hot)
    left = rows.withColumn("_way", F.when(is_hot, F.pmod(F.xxhash64(*deal_by), F.lit(ways))).otherwise(F.lit(0)).cast("int"))
    right = keyed.withColumn("_way", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(ways - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, "_way"]).drop("_way")


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by cut() that no later plan reads."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be none of columns, whatever their case."""
    taken, lead = {c.lower() for c in columns}, "_"
    while any(lead + n in taken for n in names):
        lead += "_"
    return [lead + n for n in names]


def held_out(key: str, mod: int, rest: int):
    """True where crc32 of the key's text, mod `mod`, is `rest`; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % mod == rest


_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_powers = {"n": 0, "up": np.empty(0, np.uint64), "down": np.empty(0, np.uint64)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, kept by each worker."""
    if _powers["n"] < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, base in (("up", _MULTIPLIER), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
        _powers["n"] = size
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over a 64-bit hash."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def spans(buffer: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that the 256-entry table in_word marks."""
    flags = np.zeros(len(buffer) + 2, np.int8)
    flags[1:-1] = in_word[buffer]
    step = np.diff(flags)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def span_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, the same wherever the span stands."""
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _power_tables(len(buffer) + 1)
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * up[: len(buffer)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(buffer: np.ndarray, n: int) -> np.ndarray:
    """A 32-bit hash of each run of n bytes."""
    if len(buffer) < n:
        return np.empty(0, np.uint32)
    size = len(buffer) - n + 1
    h = np.full(size, n, np.uint32)
    for k in range(n):
        h *= np.uint32(0x01000193)
        h += buffer[k : k + size]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    return h


def merge_labels(labels: np.ndarray, row: int, linked: np.ndarray) -> None:
    """Give a row and the rows linked to it one label, the smallest of theirs, with all that shared their labels."""
    old = np.unique(np.append(labels[linked], labels[row]))
    if len(old) > 1:
        labels[np.isin(labels, old[1:])] = old[0]
