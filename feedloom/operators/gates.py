"""Gates: which batches may run, be certified, and be read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.lineage import cut


def latest(frame: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order; Spark keeps one row a key in each task before the shuffle (its limit by group)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return frame.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def dependency_gate(edges: DataFrame, latest_runs: DataFrame, as_of: str) -> DataFrame:
    """edges (downstream, upstream, kind, max_lag_hours, max_quarantine_pct) with blocked and reason.

    latest_runs: upstream, status, completed_at, recon_status, quarantine_pct, aborted. A run that failed, is under way or never was is that alone;
    lag, reconciliation, quarantine and rejected files are looked at where it succeeded, and the last failing one gives the
    reason. edges may have booleans block_on_failure, block_on_unbalanced and block_on_rejected that switch checks off (null and absent:
    on). A SOFT edge warns and never blocks.
    """
    joined = edges.join(latest_runs, "upstream", "left")
    on = lambda name: F.coalesce(F.col(name), F.lit(True)) if name in edges.columns else F.lit(True)
    late = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("completed_at")) > F.col("max_lag_hours") * 3600
    status = F.col("status")
    succeeded = [
        (F.col("aborted") & on("block_on_rejected"), "REJECTED_FILE"), (F.col("quarantine_pct") > F.col("max_quarantine_pct"), "QUARANTINE_OVER_LIMIT"),
        ((F.col("recon_status") != "PASS") & on("block_on_unbalanced"), "NOT_RECONCILED"), (late & (F.col("max_lag_hours") > 0), "STALE"),
    ]
    checks = [(status.isNull(), "NEVER_RAN"), (status.isin("FAILED", "CANCELLED", "FAILED_RECONCILIATION") & on("block_on_failure"), "UPSTREAM_FAILED"), (status.isin("RUNNING", "PENDING"), "STILL_RUNNING")]
    checks += [((status == "SUCCESS") & check, name) for check, name in succeeded]
    reason = F.coalesce(*[F.when(check, F.lit(name)) for check, name in checks])
    return joined.select("downstream", "upstream", "kind", F.coalesce(reason, F.lit("READY")).alias("reason"), (reason.isNotNull() & (F.col("kind") == "HARD")).alias("blocked"))


def reachable(edges: DataFrame) -> DataFrame:
    """(start, node) of all nodes that edges (src, dst) lead to; a node that reaches itself is on a cycle.

    Each round joins the pairs found with themselves, so a path of n edges takes log n rounds; each is written out.
    """
    found = cut(edges.select(F.col("src").alias("start"), F.col("dst").alias("node")).distinct(), "reach")
    before, now = 0, found.count()
    while now > before:
        onward = found.select(F.col("start").alias("node"), F.col("node").alias("next"))
        found = cut(found.union(found.join(onward, "node").select("start", F.col("next"))).distinct(), "reach")
        before, now = now, found.count()
    return found


def certify(batches: DataFrame, checks: dict[str, DataFrame]) -> DataFrame:
    """batches (batch_id) with reasons and certified; each check is a frame of the batch_ids that fail it."""
    out = batches
    for name, failed in checks.items():
        out = out.join(failed.select(F.col("batch_id")).distinct().withColumn(f"_{name}", F.lit(name)), "batch_id", "left")
    reasons = F.array_compact(F.array(*[F.col(f"_{name}") for name in checks]))
    return out.withColumn("reasons", reasons).withColumn("certified", F.size("reasons") == 0).drop(*[f"_{n}" for n in checks])


def certified_view(rows: DataFrame, certifications: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns of rows whose batch is certified."""
    return rows.join(certifications.where("status = 'CERTIFIED'").select("batch_id").distinct(), "batch_id", "left_semi").select(columns)


def waivers_for(batches: DataFrame, waivers: DataFrame) -> DataFrame:
    """(batch_id, waiver_id): waivers that apply to a batch of their feed: one batch, a range of batches, or a stretch of time."""
    w = waivers.withColumnRenamed("feed_id", "_feed")
    applies = (
        ((F.col("scope") == "SINGLE_BATCH") & (F.col("batch_id") == F.col("from_batch")))
        | ((F.col("scope") == "BATCH_RANGE") & F.col("batch_id").between(F.col("from_batch"), F.col("to_batch")))
        | ((F.col("scope") == "TIME_BOUNDED") & F.col("created_at").between(F.col("from_time"), F.col("to_time")))
    )
    return batches.join(w, F.col("feed_id") == F.col("_feed")).where(applies).select("batch_id", "waiver_id")


def consumer_gate(requests: DataFrame, consumers: DataFrame, models: DataFrame) -> DataFrame:
    """requests (consumer, batch_id) with allowed and why: an active consumer, the batch's model version, certified where asked for."""
    joined = requests.join(consumers, "consumer", "left").join(models, "batch_id", "left")
    why = F.when(F.col("active").isNull() | ~F.col("active"), "INACTIVE_CONSUMER").when(~F.col("model_version").eqNullSafe(F.col("consumer_version")), "VERSION_MISMATCH").when(F.col("needs_certified") & ~F.coalesce("certified", F.lit(False)), "NOT_CERTIFIED")
    return joined.select("consumer", "batch_id", why.isNull().alias("allowed"), F.coalesce(why, F.lit("OK")).alias("why"))


def duplicate_keys(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand more than once: none where a key is unique."""
    return frame.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
