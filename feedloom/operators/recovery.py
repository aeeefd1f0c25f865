"""Recovery: quarantined records parsed again from their raw text, and what becomes of them."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions.text import blank_to_null
from feedloom.operators import rules as dq
from feedloom.operators.rules import Rule
from feedloom.operators.validation import Field, failure


@dataclass(frozen=True)
class Recovery:
    """silver: rows that are valid now; records: all records with their new status; totals: one row of the recovery batch's balance."""

    silver: DataFrame
    records: DataFrame
    totals: DataFrame


def reparsed(records: DataFrame, raw: str, fields: list[Field], delimiter: str = ",") -> DataFrame:
    """records with the struct _row of the fields, which stand in the raw text in their order; a text cut short has nulls, a null text nothing but nulls.

    Raw texts are cells joined by the delimiter, so they are split at each; cells are trimmed.
    """
    cells = F.split(F.col(raw), re.escape(delimiter), -1)
    return records.withColumn("_row", F.struct(*[F.trim(F.get(cells, F.lit(k))).alias(f.name) for k, f in enumerate(fields)]))


def reprocess(records: DataFrame, fields: list[Field], rules: list[Rule], batch: str, as_of: str, delimiter: str = ",", notes: str | None = None) -> Recovery:
    """Records (record_id, batch_id, feed_id, source_row_number, source_record_raw, status) against the present fields and rules.

    A record is valid if its fields are and no rule, of any severity, is violated; it becomes REPROCESSED with the recovery batch, the others stay as they
    are with a note and their first failure as (field, reason). A record that is not QUARANTINED any more, or records of several feeds, are an error before
    anything is done, as a second recovery would write rows twice. No records give no rows and a balance of zeros. Record ids are taken to be unique.
    """
    seen = records.agg(F.min(F.when(F.coalesce(F.col("status") != "QUARANTINED", F.lit(True)), F.struct("record_id", "status"))).alias("done"), F.min("feed_id").alias("low"), F.max("feed_id").alias("high")).first()
    if seen.done:
        raise ValueError(f"record {seen.done.record_id} is {seen.done.status} and cannot be reprocessed again")
    if seen.low != seen.high:
        raise ValueError("records of several feeds cannot be reprocessed together")

    parsed = reparsed(records.select("record_id", "batch_id", "feed_id", "source_row_number", "source_record_raw", "status"), "source_record_raw", fields, delimiter)
    rows = parsed.select("record_id", "batch_id", "feed_id", "source_row_number", "source_record_raw", "status", "_row.*")
    by_rule = [F.when(dq.violated(r), F.struct(F.lit(r.column).alias("field"), F.lit(dq.REASONS[r.kind]).alias("reason"))) for r in rules]
    by_field = failure(fields, as_of)
    judged = rows.withColumn("_failed", F.coalesce(F.when(by_field.isNotNull(), F.struct(by_field["field"].alias("field"), by_field["reason"].alias("reason"))), *by_rule))
    valid = F.col("_failed").isNull()

    lineage = [F.lit(batch).alias("_recovery_batch_id"), F.col("record_id").cast("string").alias("_quarantine_source_id"), F.col("batch_id").cast("string").alias("_batch_id"), F.col("feed_id").cast("string").alias("_feed_id"), F.col("source_row_number").alias("_source_row_num"), F.lit(as_of).cast("timestamp").alias("_ingested_at")]
    silver = judged.where(valid).select(*lineage, *[blank_to_null(F.col(f.name)).alias(f.name) for f in fields])
    after = judged.select(
        "record_id", "batch_id", "feed_id", "source_row_number", "source_record_raw", F.when(valid, "REPROCESSED").otherwise("QUARANTINED").alias("status"),
        F.when(valid, F.lit(batch)).alias("resolution_batch_id"), F.when(valid, F.lit(as_of).cast("timestamp")).alias("resolved_at"),
        F.when(valid, F.lit(notes).cast("string")).otherwise(f"Recovery attempt {batch}: record remains invalid").alias("resolution_notes"), F.col("_failed.field").alias("field"), F.col("_failed.reason").alias("reason"),
    )
    sums = judged.agg(F.count("*").alias("rows_in"), F.count_if(valid).alias("silver"), F.count_if(~valid).alias("quarantined"))
    totals = sums.select("*", *dq.reconcile(F.col("rows_in"), F.col("silver"), F.col("quarantined"), F.lit(0).cast("long")))
    return Recovery(silver, after, totals)
