"""Language ID: nearest of several TF-IDF centroids per language by cosine, with rejection by distance."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import gram_hashes, held_out

BUCKETS = 1 << 13
GRAMS = (1, 2, 3)
_TO_BLANK = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
LETTER = re.compile(r"[^\W\d_]")


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a whole text's byte 1- to 3-grams, and how often each stands there.

    The text is lower-cased, and what is between words (all ASCII but a-z) counts as one blank.
    """
    words = (text or "").lower().encode().translate(_TO_BLANK).split()
    buffer = np.frombuffer(b" ".join([b"", *words, b""]), np.uint8)
    every = np.concatenate([gram_hashes(buffer, n) for n in GRAMS]) & np.uint32(BUCKETS - 1)
    total = np.bincount(every.astype(np.int32), minlength=BUCKETS)
    where = np.flatnonzero(total)
    return where, total[where]


def weigh(where: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The TF-IDF weights of a document, of length 1 unless all are zero."""
    x = (1 + np.log(n)) * idf[where]
    return x / (np.linalg.norm(x) or 1.0)


@dataclass
class Centroids:
    """idf: of each bucket; centres: one row each, of length 1; langs: their languages; radii: the least cosine at which a text is near each."""

    idf: np.ndarray
    centres: np.ndarray
    langs: list[str]
    radii: np.ndarray

    def predict(self, text: str | None, reject: bool = False, least: float = 0.0) -> tuple[str, float, bool]:
        """The nearest centre's language, the cosine, and whether it is beyond the centre's radius; `und` and 0 without a letter, `und` too beyond the radius if reject, and under the cosine `least`."""
        if not self.langs or not text or not LETTER.search(text):
            return "und", 0.0, True
        where, n = counts(text)
        cosine = self.centres[:, where] @ weigh(where, n, self.idf)
        k = int(cosine.argmax())
        score = float(np.clip(cosine[k], 0, 1))
        far = bool(score < self.radii[k])
        return ("und" if score < least or (far and reject) else self.langs[k]), score, far


def cluster(rows: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Centres of spherical k-means over rows of length 1; fewer if some stay empty."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)]
    for _ in range(rounds):
        own = (rows @ centres.T).argmax(axis=1)
        sums = np.stack([rows[own == j].sum(axis=0) for j in range(len(centres)) if (own == j).any()])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_per_lang: int = 500, clusters: int = 8, quantile: float = 0.01, mod: int = 4, held: int = 2) -> Centroids:
    """Centroids learned from rows with a language whose crc32(id as text) mod `mod` is not `held`.

    Document frequencies come from all these rows: every task adds up its own, at most 8192 numbers, before the shuffle.
    Centres are clustered on a bounded sample, about `sample_per_lang` rows of each language by hash of id and text; those
    that draw over three tenths of their rows from other languages (passages quoted in another language) are left out.
    A centre's radius is the cosine that all but a `quantile` of its language's sampled rows nearest to it reach.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), held_out(id_col, mod, held).alias("held"))
    rows = rows.where(~F.col("held") & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # as many as there are languages
    if not sizes:
        return Centroids(np.zeros(BUCKETS), np.zeros((0, BUCKETS)), [], np.zeros(0))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                total[counts(text.as_py())[0]] += 1
        where = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(where.astype(np.int32)), "n": pa.array(total[where])})

    summed = rows.select("text").mapInArrow(frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(BUCKETS)
    df[np.asarray(summed["bucket"])] = np.asarray(summed["n"])
    idf = np.log((1 + sum(sizes.values())) / (1 + df)) + 0.05

    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample_per_lang / n))])
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / (1 << 20)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts(t.as_py()) for t in batch.column("text")]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "lang": batch.column("lang"), "buckets": pa.array([f[0].astype(np.int32) for f in found], pa.list_(pa.int32())), "counts": pa.array([f[1].astype(np.int32) for f in found], pa.list_(pa.int32()))})

    got = rows.where(draw < share[F.col("lang")]).mapInArrow(count, "doc_id long, lang string, buckets array<int>, counts array<int>").toArrow()
    got = got.sort_by([("lang", "ascending"), ("doc_id", "ascending")])
    of_row = np.array(got["lang"].to_pylist(), object)
    centres, langs, rows_of = [], [], {}
    for number, lang in enumerate(sorted(sizes)):
        dense = np.zeros((int((of_row == lang).sum()), BUCKETS), np.float32)
        for k, row in enumerate(np.flatnonzero(of_row == lang)):
            where, n = np.asarray(got["buckets"][int(row)].values), np.asarray(got["counts"][int(row)].values)
            dense[k, where] = weigh(where, n, idf)
        dense = dense[dense.any(axis=1)]
        if len(dense):
            own = cluster(dense, clusters, number)
            centres.append(own)
            langs += [lang] * len(own)
        rows_of[lang] = dense
    if not centres:
        return Centroids(idf, np.zeros((0, BUCKETS)), [], np.zeros(0))
    every, own = np.concatenate(centres), np.array(langs, object)
    nearest = {lang: (dense @ every.T).argmax(axis=1) for lang, dense in rows_of.items()}
    total = sum(np.bincount(k, minlength=len(every)) / len(k) for k in nearest.values() if len(k))
    mine = np.array([np.mean(nearest[lang] == k) for k, lang in enumerate(own)])
    pure = mine >= 0.7 * total
    for lang in rows_of:  # a language keeps one centre at least
        if not pure[own == lang].any() and (own == lang).any():
            pure[np.flatnonzero(own == lang)[mine[own == lang].argmax()]] = True
    radii = np.zeros(len(every))  # a language's rows of the sample that a kept centre draws; beyond nearly all of them is beyond the centre
    for lang, dense in rows_of.items():
        mine = np.flatnonzero(pure & (own == lang))
        cosines = dense @ every[mine].T
        for n, k in enumerate(mine):
            drawn = cosines[cosines.argmax(axis=1) == n, n] if len(cosines) else cosines
            radii[k] = np.quantile(drawn, quantile) if len(drawn) else 0
    return Centroids(idf, every[pure], own[pure].tolist(), radii[pure])


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", reject: bool = False, least: float = 0.0, mod: int = 4, held: int = 2, **settings) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row of docs, from its whole text alone.

    `und` with score 0 if the text is null or has no letter, or nothing was learned. rejected: so, or the nearest centre is further than
    its learned radius, as for a language not learned; with `reject` such texts are `und` too, and so are all under the cosine `least` (0: none). Ties go to the first language in order. Rows that repeat are answered each.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, lang_col, mod=mod, held=held, **settings))

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.value.predict(t, reject, least) for t in texts], columns=["lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col, mod, held).alias("held_out"), predict(F.col(text_col)).alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")
