"""Quality classifier: supervised subword embeddings trained by numpy stochastic gradient descent."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import gram_hashes, held_out, span_hashes, spans

BUCKETS = 1 << 16
GRAMS = (3, 4)
_BLANKS = np.array([9, 10, 11, 12, 13, 32, 0xA0], np.uint32)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The hashed words and character 3- and 4-grams of words, blanks at their ends included, of a whole text: buckets and their shares, which add up to 1."""
    codes = np.frombuffer(f" {text or ''} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = np.isin(codes, _BLANKS)
    kept = ~(blank & np.append(False, blank[:-1]))  # runs of blanks are one
    codes, blank = np.where(blank, np.uint32(32), codes)[kept], blank[kept]
    parts = []
    for n in GRAMS:
        inner = np.lib.stride_tricks.sliding_window_view(blank, n - 2)[1:-1].any(axis=1) if len(blank) >= n else np.empty(0, bool)
        parts.append(gram_hashes(codes, n)[~inner])
    edges = np.flatnonzero(blank)
    starts, ends = edges[:-1] + 1, edges[1:]
    words = ends > starts
    parts.append(span_hashes(codes, starts[words], ends[words]).astype(np.uint32))
    every = (np.concatenate(parts) & np.uint32(BUCKETS - 1)).astype(np.int32)
    counts = np.bincount(every, minlength=BUCKETS)
    where = np.flatnonzero(counts)
    return where, (counts[where] / max(1, len(every))).astype(np.float32)


@dataclass
class Model:
    """Vectors of the buckets, weights of the two classes, and their biases."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def score(self, where: np.ndarray, share: np.ndarray) -> float:
        """The softmax of class 1 for a document's averaged vector."""
        out = (share @ self.vectors[where]) @ self.weights + self.bias
        return float(1 / (1 + np.exp(np.clip(out[0] - out[1], -500, 500))))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], dim: int = 16, epochs: int = 15, rate: float = 0.5, pace: float = 100.0, seed: int = 11, start: Model | None = None) -> Model:
    """Stochastic gradient descent over documents in random order, at a rate that falls to nothing; no rows: all scores 0.5. It goes on from `start` where given.

    Every step is along the gradient of the softmax loss of one document; as a bucket's share of a document is about a hundredth, its
    vector has a rate `pace` times that of the output weights.
    """
    rng = np.random.default_rng(seed)
    model = Model((rng.random((BUCKETS, dim), np.float32) - 0.5) / dim, np.zeros((dim, 2), np.float32), np.zeros(2, np.float32))
    if start:
        model = Model(start.vectors.copy(), start.weights.copy(), start.bias.copy())
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            where, share, label = rows[k]
            now = rate * (1 - done / steps)
            mean = share @ model.vectors[where]
            out = mean @ model.weights + model.bias
            p = np.exp(out - out.max())
            error = p / p.sum()
            error[label] -= 1
            back = model.weights @ error
            model.weights -= now * np.outer(mean, error)
            model.bias -= now * 0.1 * error
            model.vectors[where] -= now * pace * np.outer(share, back)
            done += 1
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 6000, mod: int = 3, held: int = 1) -> Model:
    """A model learned from at most `sample` labelled rows whose crc32(id as text) mod `mod` is not `held`.

    The sample is that of the smallest hashes of the id, so it is the same in every run. Its documents' texts are counted
    whole on the executors; the driver gets their bucket counts, at most 65536 for a document. Rows without an id or
    a label of 0 or 1, and ids without a document, teach nothing; an id labelled twice teaches each label, and so does each text of a repeated id, as
    long as there are no more than `sample` of them in all.
    """
    chosen = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col, mod, held))
    chosen = chosen.select(F.col(id_col).cast("long").alias("label_id"), F.col(label_col).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("label_id"), "label_id", "label").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # at most `sample` rows of two numbers
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "label")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column("text")]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "label": batch.column("label"), "buckets": pa.array([f[0].astype(np.int32) for f in found], pa.list_(pa.int32())), "shares": pa.array([f[1] for f in found], pa.list_(pa.float32()))})

    got = rows.mapInArrow(count, "doc_id long, label int, buckets array<int>, shares array<float>")
    if rows.count() > sample:  # only where ids repeat
        got = got.orderBy(F.xxhash64("doc_id"), "doc_id", "label", F.xxhash64("buckets")).limit(sample)
    got = got.toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("label", "ascending")])
    return train([(np.asarray(w.values), np.asarray(s.values), y) for w, s, y in zip(got["buckets"], got["shares"], got["label"].to_pylist(), strict=True)])


def score_column(docs: DataFrame, model: Model, text_col: str = "text"):
    """A column with the score of each row's whole text; null counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(*features(t)) for t in texts], dtype="float64")

    return score(F.col(text_col))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **settings) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs; null, empty and very long texts are scored like any.

    Rows that repeat are scored each; other columns are not read; without labels every score is 0.5.
    """
    model = fit(docs, labels, id_col, text_col, **settings)
    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col, settings.get("mod", 3), settings.get("held", 1)).alias("held_out"), score_column(docs, model, text_col).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = 0.5, **settings) -> DataFrame:
    """The rows of docs, with all their columns, that the classifier does not reject."""
    model = fit(docs, labels, text_col=text_col, **settings)
    return docs.where(score_column(docs, model, text_col) >= threshold)
