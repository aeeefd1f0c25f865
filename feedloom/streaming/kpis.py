"""Structured Streaming over arrivals: duplicates by fingerprint, indicators by window, and rules by micro-batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions.lineage import shared_dir
from feedloom.operators import rules as dq
from feedloom.sources import attempts


def first_arrivals(stream: DataFrame, key: str, at: str, delay: str = "1 hour") -> DataFrame:
    """The stream without later rows of a key, remembered for the delay."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str, by: str, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """(window_start, by, n) by tumbling window of event time."""
    counted = stream.withWatermark(at, delay).groupBy(F.window(at, width), by).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), by, "n")


def drain(stream: DataFrame) -> DataFrame:
    """What an append stream yields from all that is there now, written with its checkpoint to the shared folder and read back."""
    path = f"{shared_dir(stream.sparkSession)}/feedloom-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def apply_rules(stream: DataFrame, rules: list[dq.Rule], root: str, name: str) -> None:
    """Put all that is there now through the rules: accepted rows to stage silver, the others with _failure to stage quarantine, of a batch a micro-batch.

    Rows count by attempts.committed(). A micro-batch is a batch named by the stream and its number, so one that is run again after a failure finds its manifests
    and adds nothing; one that violates a REJECT_FILE rule has no rows. Where the stream stands is kept under root, for the next call.
    """

    def each(frame: DataFrame, number: int) -> None:
        frame = frame.persist()

        def silver(_: dict[str, DataFrame]) -> DataFrame:
            if any(r.severity == "REJECT_FILE" and frame.where(dq.violated(r)).take(1) for r in rules):
                raise attempts.Rejected(f"{name} {number}")
            return dq.split(frame, rules)[0]

        attempts.run_batch(frame.sparkSession, root, f"{name}-{number:09d}", [("silver", silver), ("quarantine", lambda _: dq.split(frame, rules)[1])])
        frame.unpersist()

    stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{root}/state/{name}").trigger(availableNow=True).start().awaitTermination()
