"""A commit protocol for batches: outputs count when their manifest stands, so that restarts give each row once."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "batch string, stage string, attempt string, status string"


class Rejected(Exception):
    """A stage's verdict on a whole batch: none of its rows may count."""


def _hadoop(spark: SparkSession, path: str):
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark._jsc.hadoopConfiguration())


def _manifest_path(root: str, batch: str, stage: str) -> str:
    return f"{root}/manifest/{batch}~{stage}.json"


def commit(spark: SparkSession, root: str, batch: str, stage: str, attempt: str, status: str = "SUCCESS") -> bool:
    """Make an attempt the one that counts for its batch and stage; False if another does already.

    The manifest's file is written aside and renamed, and a name that stands is never replaced: of attempts that run at the same time one wins.
    """
    aside, fs = _hadoop(spark, f"{root}/aside/{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps({"batch": batch, "stage": stage, "attempt": attempt, "status": status}).encode()))
    out.close()
    target, _ = _hadoop(spark, _manifest_path(root, batch, stage))
    fs.mkdirs(target.getParent())
    won = not fs.exists(target) and fs.rename(aside, target)
    if not won:
        fs.delete(aside, False)
    return won


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(batch, stage, attempt, status) of all that counts."""
    path, fs = _hadoop(spark, f"{root}/manifest")
    if not fs.exists(path):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).json(str(path.toString()))


def write_attempt(frame: DataFrame, root: str, batch: str, stage: str) -> str:
    """Write a stage's rows into a folder of their own and name the attempt; nothing counts before commit()."""
    attempt = uuid.uuid4().hex
    frame.write.parquet(f"{root}/data/stage={stage}/batch={batch}/attempt={attempt}")
    return attempt


def committed(spark: SparkSession, root: str, stage: str) -> DataFrame:
    """The rows of a stage in all batches that count, with batch; a rejected batch has none in any stage.

    What has no manifest is neither read nor in the way: the manifest's few rows prune the partitions.
    """
    held = manifest(spark, root)
    rejected = held.where("status = 'REJECTED'").select("batch").distinct()
    valid = held.where((F.col("stage") == stage) & (F.col("status") == "SUCCESS")).join(rejected, "batch", "left_anti").select("batch", "attempt")
    rows = spark.read.option("basePath", f"{root}/data/stage={stage}").parquet(f"{root}/data/stage={stage}")
    return rows.withColumns({c: F.col(c).cast("string") for c in ("batch", "attempt")}).join(valid, ["batch", "attempt"], "left_semi").drop("attempt")


def purge(spark: SparkSession, root: str, batch: str | None = None) -> list[str]:
    """Delete the folders of attempts without a manifest (of one batch, or all) and name them; only for when no run of these batches is under way."""
    held = {(r.batch, r.stage, r.attempt) for r in manifest(spark, root).where("status = 'SUCCESS'").collect()}  # names of folders, as many as are listed below
    pattern, fs = _hadoop(spark, f"{root}/data/stage=*/batch={batch or '*'}/attempt=*")
    gone = []
    for status in fs.globStatus(pattern) or []:
        parts = [p.partition("=")[2] for p in status.getPath().toString().split("/")[-3:]]
        if (parts[1], parts[0], parts[2]) not in held:
            fs.delete(status.getPath(), True)
            gone.append("/".join(parts))
    return sorted(gone)


def run_batch(spark: SparkSession, root: str, batch: str, stages: list[tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]]) -> str:
    """Run a batch's stages in order, each once: SUCCESS, or REJECTED if a stage raises Rejected.

    A stage gets the rows of those before it by name. Stages that have a manifest are not run again, so a run that was killed goes on with the first stage
    that is not complete, and what it left half-written is purged first. Any other error leaves the batch as it stands, for a restart.
    """
    done = {r.stage: r.status for r in manifest(spark, root).where(F.col("batch") == batch).collect()}  # as many as the batch has stages
    if "REJECTED" in done.values():
        return "REJECTED"
    purge(spark, root, batch)
    held: dict[str, DataFrame] = {}
    for name, stage in stages:
        if name not in done:
            try:
                commit(spark, root, batch, name, write_attempt(stage(held), root, batch, name))
            except Rejected:
                commit(spark, root, batch, name, "", "REJECTED")
                return "REJECTED"
        held[name] = committed(spark, root, name).where(F.col("batch") == batch).drop("batch")
    return "SUCCESS"
