"""Operational analytics: indicators, summaries, search, alerts and parity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRECEDENCE = ["BATCH_ABORTED", "QUARANTINED_ROWS", "LOGGED_WARNING", "PASSED"]


def home_kpis(batches: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """(batches, succeeded, failed, running) of the trailing hours, both ends included; running counts all times."""
    now = F.lit(as_of).cast("timestamp")
    recent = F.col("created_at").between(now - F.expr(f"INTERVAL {hours} HOURS"), now)
    return batches.agg(F.count_if(recent).alias("batches"), F.count_if(recent & (F.col("status") == "SUCCESS")).alias("succeeded"), F.count_if(recent & F.col("status").isin("FAILED", "FAILED_RECONCILIATION")).alias("failed"), F.count_if(F.col("status") == "RUNNING").alias("running"))


def dq_summary(results: DataFrame) -> DataFrame:
    """(batch_id, evaluated, violations, outcome) of rule results (batch_id, evaluated, failed, action); violations that are only logged give LOGGED_WARNING, of INFO rules too."""
    action = F.when(F.col("action") == "LOGGED_INFO", "LOGGED_WARNING").otherwise(F.col("action"))
    worst = F.min(F.nullif(F.array_position(F.array(*map(F.lit, PRECEDENCE)), action), F.lit(0)))
    out = results.groupBy("batch_id").agg(F.max("evaluated").alias("evaluated"), F.sum("failed").alias("violations"), worst.alias("worst"))
    return out.select("batch_id", "evaluated", "violations", F.coalesce(F.try_element_at(F.array(*map(F.lit, PRECEDENCE)), F.col("worst").cast("int")), F.lit("PASSED")).alias("outcome"))


def batch_monitor(batches: DataFrame, stages: DataFrame) -> DataFrame:
    """batches (batch_id, status) with the number of stages, seconds in them, and stages in order."""
    seconds = F.greatest(F.lit(0), F.unix_timestamp("completed_at") - F.unix_timestamp("started_at"))
    own = stages.groupBy("batch_id").agg(F.count("*").alias("stages"), F.sum(seconds).alias("seconds"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stage_order", "stage"))), lambda s: s["stage"]), ">").alias("way"))
    return batches.join(own, "batch_id", "left").select("batch_id", "status", F.coalesce("stages", F.lit(0)).alias("stages"), F.coalesce("seconds", F.lit(0)).alias("seconds"), F.coalesce("way", F.lit("")).alias("way"))


def search(frame: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows with the text, in any case, in one of the columns; % and _ are themselves."""
    hit: Column = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c)).contains(text.lower()), F.lit(False))
    return frame.where(hit)


def facets(frame: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, n) for each value of each column, in one pass."""
    cells = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    return frame.select(F.explode(cells).alias("c")).groupBy("c.facet", "c.value").agg(F.count("*").alias("n"))


def page(frame: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """One page of rows in order, from page 1: the feature is the limit."""
    return frame.orderBy(*order).offset((number - 1) * size).limit(size)


def alert_episodes(failures: DataFrame, resolutions: DataFrame, keys: list[str], at: str, within_hours: int = 2) -> DataFrame:
    """(keys, alert, n, first_at, last_at, reopened): failures of a key join its open alert; after a resolution one within the hours reopens it, a later one opens a new alert.

    resolutions: keys and the time, under the same name. Both ends of the hours are included; a resolution at the time of a failure comes before it;
    resolutions without an open alert do nothing. reopened counts how often an alert was reopened.
    """
    both = failures.select(*keys, at, F.lit(1).alias("_failure")).unionByName(resolutions.select(*keys, at, F.lit(0).alias("_failure")))
    before = Window.partitionBy(*keys).orderBy(at, "_failure").rowsBetween(Window.unboundedPreceding, -1)
    seconds = lambda c: F.unix_micros(c.cast("timestamp"))
    last = lambda kind: F.last(F.when(F.col("_failure") == kind, seconds(F.col(at))), ignorenulls=True).over(before)
    marked = both.withColumns({"_failed": last(1), "_solved": last(0)}).where("_failure = 1")
    solved = F.coalesce(F.col("_solved") >= F.col("_failed"), F.lit(False))
    again = solved & (seconds(F.col(at)) - F.col("_solved") <= within_hours * 3_600_000_000)
    marked = marked.withColumns({"_again": again.cast("long"), "_new": (F.col("_failed").isNull() | (solved & ~again)).cast("long")})
    alert = F.sum("_new").over(Window.partitionBy(*keys).orderBy(at).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.withColumn("alert", alert).groupBy(*keys, "alert").agg(F.count("*").alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.sum("_again").alias("reopened"))


def fingerprint_totals(failures: DataFrame, fingerprint: str, at: str) -> DataFrame:
    """(fingerprint, total, first_seen, last_seen)."""
    return failures.groupBy(F.col(fingerprint).alias("fingerprint")).agg(F.count("*").alias("total"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))


def member_parity(rows_in: Column, ods: Column, dropped: Column, quarantined: Column) -> Column:
    """What of the rows in is not accounted for."""
    return rows_in - (ods + dropped + quarantined)


def amount_parity(ours: Column, theirs: Column, tolerance: float) -> Column:
    """PASS, within tolerance TOLERATED, else TOLERANCE_EXCEEDED."""
    gap = F.abs(F.coalesce(ours, F.lit(0)) - F.coalesce(theirs, F.lit(0)))
    return F.when(gap == 0, "PASS").when(gap <= tolerance, "TOLERATED").otherwise("TOLERANCE_EXCEEDED")
