"""Best-fit packing: a configuration linear program over the length histogram, solved by multiplicative weights."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import cut

# For texts of these characters alone, lower() and the patterns below cut words as the tokenizer file does.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-į]*")
_LETTER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-į"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
WORDS = re.compile(f"[{_LETTER}]+|[{_NUMBER}]|'(?:s|t|re|ve|m|ll|d)|[^\\s{_LETTER}{_NUMBER}]+")
# The file's names for bytes: printable ones are their own character, the others follow from 256 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_NAMES = dict.fromkeys(_PRINTABLE) | dict(zip(sorted(set(range(256)) - set(_PRINTABLE)), range(256, 512), strict=False))
_NAMES = {byte: chr(byte if name is None else name) for byte, name in _NAMES.items()}


class WordTokenizer(dict):
    """Ids of a word-based BPE file, exactly those of its encode(): from what stands between blanks to the bytes of its 32-bit ids.

    No word of the file spans a blank. What is new goes through the file's model word by word, what comes again is looked up;
    more than `keep` entries are forgotten. Texts with other characters than PLAIN, or with a special token's text, go
    through the tokenizer itself.
    """

    def __init__(self, path: str, keep: int = 300_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.own, self.most = Tokenizer.from_file(path), keep
        self.model = self.own.model
        self.special = [t.content for t in self.own.get_added_tokens_decoder().values()]

    def __missing__(self, part: str) -> bytes:
        words = WORDS.findall(part)
        named = words if part.isascii() else ["".join(map(_NAMES.__getitem__, w.encode())) for w in words]
        ids = self[part] = np.array([t.id for w in named for t in self.model.tokenize(w)], "<u4").tobytes()
        return ids

    def encode(self, text: str) -> np.ndarray:
        if not PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return np.array(self.own.encode(text, add_special_tokens=False).ids, np.uint32)
        if len(self) > self.most:
            self.clear()
        return np.frombuffer(b"".join(map(self.__getitem__, text.lower().split())), "<u4")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): every document's ids and the end id, cut only beyond capacity.

    A null text counts as empty, so it has the end id alone. Rows that repeat give their pieces again.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(tokenizer_path).encode
        for batch in batches:
            rows = defaultdict(list)
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id))
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    for name, value in zip(("doc_id", "piece", "start", "length", "ids_crc32"), (doc, piece, start, len(part), zlib.crc32(part.astype("<u4").tobytes())), strict=True):
                        rows[name].append(value)
                    if with_ids:
                        rows["ids"].append(part.tolist())
            types = {"piece": pa.int32(), "ids": pa.list_(pa.int64())}
            yield pa.record_batch({n: pa.array(rows[n], types.get(n, pa.int64())) for n in [c.split()[0] for c in schema.split(", ")]})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def priced(worth: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The most that pieces of these lengths (ascending) and worths can add up to in each room up to `capacity`, and a piece of that (0: leave one token free)."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    least, most = int(lengths[0]), int(lengths[-1])
    of = np.zeros(most + 1)
    of[lengths] = worth
    for room in range(least, capacity + 1):
        longest = min(room, most)
        gain = of[least : longest + 1] + best[room - longest : room - least + 1][::-1]
        k = int(gain.argmax())
        best[room], took[room] = (gain[k], k + least) if gain[k] > best[room - 1] else (best[room - 1], 0)
    return best, took


def filled(took: np.ndarray, room: int) -> dict[int, int]:
    """The pieces that priced() puts into a room: how many of each length."""
    out: dict[int, int] = defaultdict(int)
    while room > 0:
        length = int(took[room])
        out[length] += length > 0
        room -= length or 1
    out.pop(0, None)
    return out


class Program(NamedTuple):
    """A solution of the covering program: configurations with numbers, the share of each length's demand that they cover, and a lower bound of any solution."""

    taken: dict[tuple[tuple[int, int], ...], float]
    cover: np.ndarray
    bound: float


def configurations(lengths: np.ndarray, demand: np.ndarray, capacity: int, step: float = 0.5, power: float = 1.02) -> Program:
    """The configuration program, fewest sequences that hold each length's demand, by multiplicative weights.

    A length's weight is a little more than its size, so that long pieces come first, times e to minus the share covered. Each
    round prices all rooms by one knapsack; every length that is not covered yet gets the configuration of
    itself and the best filling of the room beside it, of which as much is taken as covers `step` of its demand
    and no length beyond the whole. So each round covers a length or a step of every one, and rounds go on until all are covered.
    Weights whose best configuration is worth 1 bound the program from below; so do the sizes alone.
    """
    taken: dict[tuple, float] = defaultdict(float)
    cover, want = np.zeros(capacity + 1), np.zeros(capacity + 1)
    want[lengths] = demand
    bound, open_ = float(lengths @ demand) / capacity, lengths
    while len(open_):
        worth = (open_ / capacity) ** power * np.exp(-cover[open_])
        best, took = priced(worth, open_, capacity)
        bound = max(bound, float(worth @ want[open_]) / best[capacity])
        for length in open_[::-1].tolist():
            if cover[length] < 1:
                fill = filled(took, capacity - length)
                fill[length] = fill.get(length, 0) + 1
                x = min([step * want[length] / fill[length], *((1 - cover[k]) * want[k] / n for k, n in fill.items())])
                if x > 0:
                    taken[tuple(sorted(fill.items(), reverse=True))] += x
                    for k, n in fill.items():
                        cover[k] = 1 if (1 - cover[k]) * want[k] <= n * x * (1 + 1e-9) else cover[k] + n * x / want[k]
        open_ = open_[cover[open_] < 1]
    return Program(dict(taken), cover[lengths], bound)


def rounded(program: Program, left: dict[int, int]) -> dict[tuple[tuple[int, int], ...], int]:
    """Whole numbers of the program's configurations, rounded down and then, by what was lost, up by one where enough pieces are left; `left` is lowered by what they hold."""
    numbers = {fill: int(x + 1e-6) for fill, x in program.taken.items()}
    done: dict[tuple, int] = defaultdict(int)
    for lost in (False, True):
        for fill, x in sorted(program.taken.items(), key=lambda t: (numbers[t[0]] - t[1], t[0])):
            number = min([1 if lost else numbers[fill], *(left[k] // n for k, n in fill)])
            if number > 0 and (not lost or x - numbers[fill] > 1e-6):
                done[fill] += number
                for k, n in fill:
                    left[k] -= n * number
    return dict(done)


def pack_histogram(lengths: np.ndarray, counts: np.ndarray, capacity: int, solve: bool = True) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """[(fill, number)]: sequences by what they hold, ((length, how many), ...), longest first; every piece stands in one.

    The program's solution is rounded; the pieces that rounding leaves, fewer than there are configurations times their
    pieces, go longest first into the fullest sequence that has room, whole groups of like sequences at a time. That alone
    (solve=False) is best fit, which the rounded program replaces.
    """
    left = {int(x): int(n) for x, n in zip(lengths, counts, strict=True) if n > 0}
    done: dict[tuple, int] = defaultdict(int)
    if left.get(capacity):
        done[((capacity, 1),)] = left.pop(capacity)
    room: dict[int, dict[tuple, int]] = defaultdict(lambda: defaultdict(int))
    if left and solve:
        sizes = np.array(sorted(left))
        for fill, number in rounded(configurations(sizes, np.array([left[int(s)] for s in sizes], float), capacity), left).items():
            room[capacity - sum(s * n for s, n in fill)][fill] += number
    for s in sorted((s for s, n in left.items() if n > 0), reverse=True):
        n = left[s]
        while n > 0:
            space = min((r for r in room if r >= s), default=None)
            if space is None:
                per = min(capacity // s, n)
                number = n // per
                room[capacity - per * s][((s, per),)] += number
                n -= per * number
                continue
            fill, number = next(iter(room[space].items()))
            per = min(space // s, n)
            use = min(number, n // per)
            room[space][fill] -= use
            if not room[space][fill]:
                del room[space][fill]
                if not room[space]:
                    del room[space]
            held = defaultdict(int, fill)
            held[s] += per
            room[space - per * s][tuple(sorted(held.items(), reverse=True))] += use
            n -= per * use
    for fills in room.values():
        for fill, number in fills.items():
            done[fill] += number
    return sorted(done.items(), reverse=True)


def placements(fills: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[int, np.ndarray]:
    """For each length the runs of its pieces in order of rank: first rank, pieces a sequence, first sequence, offset."""
    runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    rank: dict[int, int] = defaultdict(int)
    sequence = 0
    for fill, number in fills:
        at = 0
        for length, per in fill:
            runs[length].append((rank[length], per, sequence, at))
            rank[length] += per * number
            at += per * length
        sequence += number
    return {length: np.array(r, np.int64) for length, r in runs.items()}


def pack(parts: DataFrame, capacity: int = 2048, bucket_rows: int = 100_000) -> DataFrame:
    """parts with sequence_id and offset: as few sequences of at most `capacity` as the rounded program finds.

    parts: doc_id, piece, length (1 to capacity) and any other columns. Only the histogram, of `capacity` numbers at
    most, reaches the driver, and what goes back is a run for each length of each configuration. A piece's rank
    among those of its length comes from counts by (length, bucket of its id) and its place in the bucket, so that a
    length with a third of all pieces is dealt to many tasks. No rows give no rows; rows that repeat are pieces of their own.
    """
    spark, given = parts.sparkSession, parts.columns
    if {"sequence_id", "offset"} & {c.lower() for c in given}:
        raise ValueError("parts must not have columns named sequence_id or offset")
    parts = parts.withColumnsRenamed({c: f"{c}__" for c in given if c.lower() in ("_bucket", "_n", "_base", "_rank")})
    histogram = parts.groupBy("length").agg(F.count("*").alias("n")).collect()
    total = sum(r["n"] for r in histogram)
    if not total:
        return parts.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).toDF(*given, "sequence_id", "offset")
    histogram.sort(key=lambda r: r["length"])
    fills = pack_histogram(np.array([r["length"] for r in histogram]), np.array([r["n"] for r in histogram]), capacity)
    runs = spark.sparkContext.broadcast(placements(fills))
    buckets = -(-total // bucket_rows) * 8
    dealt = parts.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    base = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = base.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    told = [f.name for f in parts.schema.fields if not {"map<", "variant"} & set(re.findall("map<|variant", f.dataType.simpleString()))]  # what can be hashed
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", F.xxhash64(*told))  # rows that share both are told apart, so a task run again ranks them as before
    ranked = dealt.withColumn("_rank", F.row_number().over(within) - 1).join(base, ["length", "_bucket"])
    columns = parts.columns
    ranked = ranked.select(*columns, (F.col("_rank") + F.col("_base")).alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length = runs.value
        for batch in batches:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("_rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for x in np.unique(length):
                rows = np.flatnonzero(length == x)
                run = by_length[int(x)]
                first, per, start, at = run[np.searchsorted(run[:, 0], rank[rows], "right") - 1].T
                sequence[rows] = start + (rank[rows] - first) // per
                offset[rows] = at + (rank[rows] - first) % per * x
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema).toDF(*given, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, with_ids: bool = False, **columns) -> DataFrame:
    """pieces() of docs, packed by pack(); the pieces are written once, as the histogram and the placing both read them."""
    return pack(cut(pieces(docs, tokenizer_path, capacity, with_ids=with_ids, **columns), "pieces"), capacity)
