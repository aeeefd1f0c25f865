"""The monitor of batches: stages with their durations, the outcome of rules, drift and balance, a row a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINISHED = ("SUCCESS", "FAILED", "FAILED_RECONCILIATION")
RANKS = {"BATCH_ABORTED": 4, "QUARANTINED_ROWS": 3, "LOGGED_WARNING": 2, "LOGGED_INFO": 2}
OUTCOMES = ("PASSED", "LOGGED_WARNING", "QUARANTINED_ROWS", "BATCH_ABORTED")


def running_ms(status: Column, started: Column, completed: Column, now: Column) -> Column:
    """Milliseconds from start to end of what is finished, from start to now of what runs, else 0; never below 0, and 0 where a time is missing."""
    until = F.when(status.isin(*FINISHED), completed).when(status == "RUNNING", now)
    return F.greatest(F.lit(0).cast("long"), F.coalesce(F.unix_millis(until.cast("timestamp")) - F.unix_millis(started.cast("timestamp")), F.lit(0)))


def monitor(
    batches: DataFrame, stages: DataFrame, results: DataFrame, drifts: DataFrame, reconciliations: DataFrame, now: str,
    hours: int | None = 24, feed_id=None, status: str | None = None, stage_status: str | None = None, violations: bool | None = None,
) -> DataFrame:
    """batches (batch_id, feed_id, status, created_at, started_at, completed_at) with total_ms, stages, dq_action, quarantined, drift_severity, recon_status.

    stages: (batch_id, stage_order, stage, status, started_at, completed_at), shown in order as (stage_order, stage, status, duration_ms). results: (batch_id,
    action), of which the worst counts; none is NO_RULES, and logged violations of any kind are LOGGED_WARNING. drifts: (batch_id, created_at, severity), the
    latest counts, of equal times the greatest severity. reconciliations: (batch_id, status); a batch without one is PENDING.
    Of the last `hours` (None: all), a feed, a status, with a stage of stage_status, and with or without violations (quarantined rows, drift, an abort).
    The batches are chosen first, and only their rows of the other tables are gathered; all are shuffled by the batch alone.
    """
    at = F.lit(now).cast("timestamp")
    chosen = batches.select("batch_id", "feed_id", "status", "created_at", "started_at", "completed_at")
    if hours is not None:
        chosen = chosen.where(F.col("created_at") >= at - F.expr(f"INTERVAL {hours} HOURS"))
    if feed_id is not None:
        chosen = chosen.where(F.col("feed_id") == feed_id)
    if status is not None:
        chosen = chosen.where(F.col("status") == status)
    if stage_status is not None:
        chosen = chosen.join(stages.where(F.col("status") == stage_status).select("batch_id"), "batch_id", "left_semi")
    ids = chosen.select("batch_id")
    own = lambda frame: frame.join(ids, "batch_id", "left_semi").groupBy("batch_id")

    shown = F.struct("stage_order", "stage", "status", running_ms(F.col("status"), F.col("started_at"), F.col("completed_at"), at).alias("duration_ms"))
    way = own(stages).agg(F.array_sort(F.collect_list(shown)).alias("stages"))
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for item in RANKS.items() for x in item]), F.col("action")), F.lit(1))
    outcome = own(results).agg(F.max(rank).alias("_rank"), F.bool_or(F.coalesce(F.col("action") == "QUARANTINED_ROWS", F.lit(False))).alias("_quarantined"))
    drift = own(drifts).agg(F.max(F.struct("created_at", "severity")).alias("_drift"))
    balance = own(reconciliations).agg(F.max("status").alias("_recon"))

    joined = chosen
    for part in (way, outcome, drift, balance):
        joined = joined.join(part, "batch_id", "left")
    out = joined.select(
        "batch_id", "feed_id", "status", "created_at", running_ms(F.col("status"), F.col("started_at"), F.col("completed_at"), at).alias("total_ms"), "stages",
        F.when(F.col("_rank").isNull(), "NO_RULES").otherwise(F.try_element_at(F.array(*map(F.lit, OUTCOMES)), F.col("_rank"))).alias("dq_action"), F.coalesce("_quarantined", F.lit(False)).alias("quarantined"),
        F.col("_drift").isNotNull().alias("drifted"), F.col("_drift.severity").alias("drift_severity"), F.coalesce("_recon", F.lit("PENDING")).alias("recon_status"),
    )
    if violations is None:
        return out
    bad = F.col("quarantined") | F.col("drifted") | (F.col("dq_action") == "BATCH_ABORTED")
    return out.where(bad if violations else ~bad)
