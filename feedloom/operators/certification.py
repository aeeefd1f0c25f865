"""Certification of batches: one union of evidence, folded into a mask a batch, with waivers and their quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The checks, by their bit.
CHECKS = ["BATCH_STATUS", "STAGES", "SCHEMA", "RECONCILIATION", "DATA_QUALITY", "QUARANTINE", "ALERTS"]


def evidence(batches: DataFrame, stages: DataFrame, drifts: DataFrame, recon: DataFrame, results: DataFrame, quarantine: DataFrame, alerts: DataFrame) -> DataFrame:
    """(batch_id, bit, control): a row for each thing that speaks against a batch; control names what a waiver may excuse, null what none may.

    batches: batch_id, feed_id, status; stages, quarantine, alerts: batch_id, status; drifts: feed_id, severity, status; recon: batch_id, recon_id,
    status, discrepancy, one row a batch; results: batch_id, rule_version_id, failed_rows, action. A missing reconciliation speaks against a batch too, a null status as
    one that is not SUCCESS.
    """

    def speaks(rows: DataFrame, check: str, control: Column | None = None) -> DataFrame:
        return rows.select("batch_id", F.lit(CHECKS.index(check)).alias("bit"), (F.lit(None).cast("string") if control is None else control.cast("string")).alias("control"))

    unlike = lambda c, value: ~F.col(c).eqNullSafe(value)
    broken = drifts.where("status = 'DETECTED' and severity = 'BREAKING'").select("feed_id").distinct()
    balance = batches.select("batch_id").join(recon.select("batch_id", "recon_id", F.col("status").alias("_recon"), "discrepancy"), "batch_id", "left")
    failed = results.where("failed_rows > 0 and action in ('QUARANTINED_ROWS', 'BATCH_ABORTED')")
    parts = [
        speaks(batches.where(unlike("status", "SUCCESS")), "BATCH_STATUS"),
        speaks(stages.where(unlike("status", "SUCCESS")), "STAGES"),
        speaks(batches.join(broken, "feed_id", "left_semi"), "SCHEMA", F.lit("SCHEMA_DRIFT")),
        speaks(balance.where(unlike("_recon", "PASS") | unlike("discrepancy", 0)), "RECONCILIATION", F.coalesce(F.col("recon_id").cast("string"), F.lit("RECONCILIATION"))),
        speaks(failed, "DATA_QUALITY", F.coalesce(F.col("rule_version_id").cast("string"), F.lit("None"))),
        speaks(quarantine.where("status = 'QUARANTINED'"), "QUARANTINE", F.lit("QUARANTINE_ACCUMULATION")),
        speaks(alerts.where("status in ('OPEN', 'RECOVERY_IN_PROGRESS')"), "ALERTS"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.distinct()  # summed up in each task before the shuffle


def grants(batches: DataFrame, waivers: DataFrame, at: Column) -> DataFrame:
    """(batch_id, created_at, control, waiver_id, left): what waivers in force at a time may excuse in a batch of their feed, the waiver of the largest id for each control.

    batches: batch_id, feed_id, created_at; waivers: waiver_id, feed_id, status, scope, batch_id, target_batch_ids, range_start, range_end, valid_from, expires_at,
    control_id, control_type, max_batches, applied. Ranges and stretches of time are closed; a range with an unknown end applies nowhere. left: how
    many more batches the waiver excuses, null for any number.
    """
    w = waivers.where((F.col("status") == "APPROVED") & (F.col("expires_at") > at) & (F.col("valid_from").isNull() | (F.col("valid_from") <= at)))
    w = w.withColumn("left", F.col("max_batches") - F.coalesce("applied", F.lit(0))).where("left is null or left > 0").drop("status")
    when = batches.select(F.col("batch_id").alias("_id"), F.col("created_at").alias("_at"))
    keep = ["waiver_id", "feed_id", "control_id", "control_type", "left"]
    listed = F.coalesce(F.size("target_batch_ids"), F.lit(0)) > 0
    named = w.where("scope = 'SINGLE_BATCH'").select(*keep, "batch_id").union(w.where((F.col("scope") == "BATCH_RANGE") & listed).select(*keep, F.explode("target_batch_ids").alias("batch_id")))
    ranged = w.where((F.col("scope") == "BATCH_RANGE") & ~listed)
    for side in ("start", "end"):
        ranged = ranged.join(when.withColumnsRenamed({"_id": f"range_{side}", "_at": f"_{side}"}), f"range_{side}")
    spans = ranged.select(*keep, F.least("_start", "_end").alias("_from"), F.greatest("_start", "_end").alias("_to"))
    spans = spans.union(w.where("scope = 'TIME_BOUNDED'").select(*keep, "valid_from", "expires_at"))
    own = batches.select("batch_id", "feed_id", "created_at")
    applies = own.join(named, ["batch_id", "feed_id"]).select("batch_id", "created_at", *keep[2:], "waiver_id")
    inside = own.join(spans, "feed_id").where("(_from is null or created_at >= _from) and created_at <= _to").select("batch_id", "created_at", *keep[2:], "waiver_id")
    both = applies.union(inside).withColumn("control", F.explode(F.array_compact(F.array(F.col("control_id").cast("string"), F.col("control_type").cast("string")))))
    return both.groupBy("batch_id", "created_at", "control").agg(F.max(F.struct("waiver_id", "left")).alias("w")).select("batch_id", "created_at", "control", "w.waiver_id", "w.left")


def certify(batches: DataFrame, found: DataFrame, granted: DataFrame) -> DataFrame:
    """(batch_id, failed, waived, reasons, waiver_ids, eligible) of every batch, from evidence() and grants().

    failed and waived are masks of CHECKS, reasons the failed checks' names in order. A waiver with a quota excuses batches in order of created_at and id
    until it runs out, each batch counting once however much it excuses there; later ones fail.
    """
    held = found.join(granted, ["batch_id", "control"], "left")
    used = held.where("left is not null").select("waiver_id", "batch_id", "created_at", "left").distinct()
    place = F.row_number().over(Window.partitionBy("waiver_id").orderBy("created_at", "batch_id"))
    void = used.withColumn("_n", place).where("_n > left").select("waiver_id", "batch_id", F.lit(True).alias("_void"))
    held = held.join(void, ["waiver_id", "batch_id"], "left")
    excused = F.col("waiver_id").isNotNull() & F.col("_void").isNull()
    bit = F.expr("shiftleft(1, bit)")
    folded = held.groupBy("batch_id").agg(F.bit_or(F.when(excused, 0).otherwise(bit)).alias("failed"), F.bit_or(F.when(excused, bit).otherwise(0)).alias("waived"), F.array_sort(F.collect_set(F.when(excused, F.col("waiver_id")))).alias("waiver_ids"))
    out = batches.select("batch_id").join(folded, "batch_id", "left")
    failed = F.coalesce("failed", F.lit(0))
    reasons = F.array_compact(F.array(*[F.when(failed.bitwiseAND(1 << n) > 0, F.lit(name)) for n, name in enumerate(CHECKS)]))
    none = F.array().cast(folded.schema["waiver_ids"].dataType)
    return out.select("batch_id", failed.alias("failed"), F.coalesce("waived", F.lit(0)).alias("waived"), reasons.alias("reasons"), F.coalesce("waiver_ids", none).alias("waiver_ids"), (failed == 0).alias("eligible"))
