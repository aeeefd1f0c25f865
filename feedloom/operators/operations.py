"""Operational joins and lists: executions, drift, stages, risks, playbooks, glossary links, batch detail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.operators.gates import latest

# The risk levels, and the texts of alerts by category.
RISK_LEVELS = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
ALERT_TEXTS = {
    "SCHEMA_DRIFT": ("Breaking Schema Drift on feed '{feed}'", "Feed '{feed}' failed at {stage} due to schema drift: {pattern}. The incoming file structure does not conform to the active published schema."),
    "DATA_QUALITY": ("Data Quality Rule Violation on feed '{feed}'", "Feed '{feed}' failed data quality validation in {stage}: {pattern}. Records violating critical rules were quarantined or caused the batch to abort."),
    "STAGE_EXECUTION": ("Pipeline Execution Error in {stage} for '{feed}'", "Execution error occurred while processing feed '{feed}' in {stage}: {pattern}. Prior stages completed safely."),
    "RECONCILIATION": ("Reconciliation Balance Failure for '{feed}'", "Record count balance check failed for feed '{feed}': {pattern}. Records may have dropped unexpectedly between transformation stages."),
    "DEPENDENCY_GATE": ("Upstream Dependency Gate Blocked for '{feed}'", "Feed '{feed}' cannot run because a required upstream dependency failed or has not arrived: {pattern}."),
}
OTHER_ALERT = ("Operational Failure in {stage} for '{feed}'", "Failure occurred on feed '{feed}' during {stage}: {pattern}.")


def quarantined_recent(reconciliations: DataFrame, batches: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """(rows_quarantined): the sum over batches made in the trailing hours, both ends included; 0 if there are none."""
    now = F.lit(as_of).cast("timestamp")
    recent = batches.where(F.col("created_at").between(now - F.expr(f"INTERVAL {hours} HOURS"), now)).select("batch_id")
    return reconciliations.join(recent, "batch_id").agg(F.coalesce(F.sum("rows_quarantined"), F.lit(0)).alias("rows_quarantined"))


def drift_reports(reports: DataFrame, limit: int = 50, offset: int = 0, **wanted: object) -> DataFrame:
    """A page of drift reports, latest first, ties by report_id, with total: how many there are in all. wanted: columns and the values asked for.

    The total is an aggregate beside the page, which Spark takes as a top-k; a page beyond the end has no rows.
    """
    for column, value in wanted.items():
        reports = reports.where(F.col(column) == value)
    total = reports.agg(F.count("*").alias("total"))  # one row
    page = reports.orderBy(F.desc("created_at"), "report_id").offset(offset).limit(limit)
    return page.join(F.broadcast(total))


def acknowledge_drift(reports: DataFrame, asked: DataFrame, at: str) -> DataFrame:
    """reports after acknowledgements (report_id, actor, notes): status, acknowledged_by, acknowledged_at, notes, and refused for those that may not be.

    Breaking drift can't be acknowledged; other reports can, also again, of several acknowledgements of a report that of the smallest actor counts.
    """
    one = asked.groupBy("report_id").agg(F.min(F.struct("actor", "notes")).alias("_a"))
    out = reports.join(one, "report_id", "left")
    breaking = F.col("severity") == "BREAKING"
    taken = F.col("_a").isNotNull() & ~breaking
    return out.select(*[F.when(taken, "ACKNOWLEDGED").otherwise(F.col("status")).alias("status") if c == "status" else F.col(c) for c in reports.columns], F.when(taken, F.col("_a.actor")).alias("acknowledged_by"), F.when(taken, F.lit(at).cast("timestamp")).alias("acknowledged_at"), F.when(taken, F.col("_a.notes")).alias("notes"), (F.col("_a").isNotNull() & breaking).alias("refused"))


def drift_counts(reports: DataFrame) -> DataFrame:
    """(breaking, non_breaking, total) of reports whose status is DETECTED."""
    of = lambda severity: F.count_if(F.col("severity") == severity)
    counts = reports.where("status = 'DETECTED'").agg(of("BREAKING").alias("breaking"), of("NON_BREAKING").alias("non_breaking"))
    return counts.withColumn("total", F.col("breaking") + F.col("non_breaking"))


def dq_executions(results: DataFrame, versions: DataFrame, rules: DataFrame, action: str | None = None) -> DataFrame:
    """results with their rule's version and name; results of unknown versions or rules are left out. Newest first is for ops.page."""
    kept = results if action is None else results.where(F.col("action") == action)
    return kept.join(versions, "rule_version_id").join(rules, "rule_id")


def batches_with_stage(batches: DataFrame, stages: DataFrame, status: str) -> DataFrame:
    """batches, once each, that have a stage in the status."""
    return batches.join(stages.where(F.col("status") == status).select("batch_id"), "batch_id", "left_semi")


def schedules_of(schedules: DataFrame, feeds: DataFrame, status: str = "ACTIVE") -> DataFrame:
    """schedules in the status with their feed; those of unknown feeds are left out."""
    return schedules.where(F.col("status") == status).join(feeds, "feed_id")


def quarantine_of_feed(quarantine: DataFrame, batches: DataFrame, feed: object) -> DataFrame:
    """Quarantined records of a feed's batches; the filter reaches the scan of the batches."""
    return quarantine.join(batches.where(F.col("feed_id") == feed).select("batch_id"), "batch_id", "left_semi")


def open_risks(unknowns: DataFrame, contracts: DataFrame) -> DataFrame:
    """Open unknowns with their contract."""
    return unknowns.where("status = 'OPEN'").join(contracts, "contract_id")


def risk_view(unknowns: DataFrame, contracts: DataFrame) -> DataFrame:
    """(risk_level, n) for each level, those without open unknowns too."""
    level = F.when(F.col("risk_level").isin(RISK_LEVELS), F.col("risk_level"))
    counts = open_risks(unknowns, contracts).agg(*[F.count_if(level == name).alias(name) for name in RISK_LEVELS])
    pairs = F.array(*[F.struct(F.lit(name).alias("risk_level"), F.col(name).alias("n")) for name in RISK_LEVELS])
    return counts.select(F.explode(pairs).alias("p")).select("p.*")


def playbook_for(fingerprints: DataFrame, bindings: DataFrame, playbooks: DataFrame, versions: DataFrame) -> DataFrame:
    """(fingerprint_id, version_id): the approved current version of the first active binding's approved playbook, else of the category's oldest approved playbook.

    A binding whose playbook has no approved current version falls back to the category; a category whose oldest approved
    playbook has none gives null. Bindings go by priority, then playbook; playbooks and versions are catalogue tables.
    """
    approved = playbooks.where("status = 'APPROVED'").select("playbook_id", "category", "current_version_id", "created_at")
    good = versions.where("status = 'APPROVED'").select(F.col("version_id").alias("current_version_id")).withColumn("version_id", F.col("current_version_id"))
    bound = latest(bindings.where("is_active").join(approved.drop("category"), "playbook_id"), ["fingerprint_id"], ["priority", "playbook_id"])
    bound = bound.join(good, "current_version_id").select("fingerprint_id", F.col("version_id").alias("bound_version"))
    default = latest(approved, ["category"], ["created_at", "playbook_id"]).join(good, "current_version_id").select("category", F.col("version_id").alias("default_version"))
    joined = fingerprints.join(bound, "fingerprint_id", "left").join(default, "category", "left")
    return joined.select("fingerprint_id", F.coalesce("bound_version", "default_version").alias("version_id"))


def glossary_models(terms: DataFrame, links: DataFrame, fields: DataFrame, models: DataFrame) -> DataFrame:
    """(term_id, model_id, model) once for each model one of whose fields a term is linked with; a term without links has null."""
    linked = links.join(fields, "field_id").join(models, "model_id").select("term_id", "model_id", "model").distinct()
    return terms.select("term_id").join(linked, "term_id", "left").select("term_id", "model_id", "model")


def batch_detail(batches: DataFrame, reconciliations: DataFrame, results: DataFrame, drifts: DataFrame) -> DataFrame:
    """batches with their reconciliation status, rules as name:failed in order, and number of drift reports."""
    rules = results.groupBy("batch_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "rule", "failed"))), ",").alias("rules"))
    drift = drifts.groupBy("batch_id").agg(F.count("*").alias("drifts"))
    out = batches.join(reconciliations.select("batch_id", "recon_status"), "batch_id", "left").join(rules, "batch_id", "left").join(drift, "batch_id", "left")
    return out.withColumns({"rules": F.coalesce("rules", F.lit("")), "drifts": F.coalesce("drifts", F.lit(0))})


def alert_text(category: Column, stage: Column, pattern: Column, feed: Column) -> tuple[Column, Column]:
    """Title, of 255 characters at most, and description of an alert; a blank stage is the ingestion pipeline."""
    where = F.when(F.coalesce(stage, F.lit("")) == "", "ingestion pipeline").otherwise(F.concat(F.lit("stage "), stage))

    def filled(template: str) -> Column:
        parts = {"feed": F.coalesce(feed, F.lit("")), "stage": where, "pattern": F.coalesce(pattern, F.lit(""))}
        pieces = []
        for piece in template.split("{"):
            name, closed, rest = piece.partition("}")
            pieces += [parts[name], F.lit(rest)] if closed else [F.lit(piece)]
        return F.concat(*pieces)

    def by_category(k: int) -> Column:
        cases = reduce(lambda c, item: c.when(category == item[0], filled(item[1][k])), list(ALERT_TEXTS.items())[1:], F.when(category == "SCHEMA_DRIFT", filled(ALERT_TEXTS["SCHEMA_DRIFT"][k])))
        return cases.otherwise(filled(OTHER_ALERT[k]))

    return F.substring(by_category(0), 1, 255), by_category(1)


def risk_tier(action: Column, records: Column) -> Column:
    """HIGH_RISK for running a batch again, bulk and discarding actions, and for reprocessing over 50 records; else STANDARD."""
    high = action.isin("RETRIGGER_BATCH", "BULK_REPROCESS_QUARANTINE", "DISCARD_QUARANTINE") | ((action == "REPROCESS_QUARANTINE") & (records > 50))
    return F.when(high, "HIGH_RISK").otherwise("STANDARD")


def operation_hash(batch: Column, member: Column, operation: Column) -> Column:
    """SHA-256 of batch|member|operation, which names a write so that it is done once."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("None")) for c in (batch, member, operation)]), 256)


def fingerprint_preview(fingerprint: Column) -> Column:
    """The first eight characters; null for a blank fingerprint."""
    return F.left(F.nullif(fingerprint, F.lit("")), F.lit(8))


def keyed_append(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of new to append: one for each key that existing lacks, so that appending twice adds nothing; rows with a null key are not appended."""
    present = existing.select(keys).distinct()
    return new.dropna(subset=keys).dropDuplicates(keys).join(present, keys, "left_anti")


def waiver_map(waivers: DataFrame, order: str) -> DataFrame:
    """(batch_id, control, waiver_id): the last waiver by order of each control, which a waiver names by id, by type or by both."""
    named = F.explode(F.array_compact(F.array(F.nullif("control_id", F.lit("")), F.nullif("control_type", F.lit("")))))
    rows = waivers.select("batch_id", "waiver_id", order, named.alias("control"))
    return rows.groupBy("batch_id", "control").agg(F.max_by("waiver_id", F.struct(order, "waiver_id")).alias("waiver_id"))


def ods_eligibility(batches: DataFrame, stages: DataFrame, models: DataFrame, identity_runs: DataFrame, reconciliations: DataFrame, results: DataFrame, run_order: list[str] | None = None) -> DataFrame:
    """(batch_id, identity_status, reasons, eligible): all six prerequisites, each with its reason.

    A batch without reconciliation passes that one; without a model or an identity run it fails. Of several identity runs the
    one that ended last counts; of those that ended at once the first by run_order, columns of identity_runs, and then by status.
    """
    bad_stage = stages.where("status not in ('SUCCESS', 'SKIPPED')").select("batch_id").distinct().withColumn("_stage", F.lit(True))
    runs = latest(identity_runs, ["batch_id"], [F.desc("completed_at"), *(run_order or []), "status"]).select("batch_id", F.col("status").alias("_run"))
    unbalanced = reconciliations.where("not balanced or status = 'FAIL'").select("batch_id").distinct().withColumn("_recon", F.lit(True))
    aborted = results.where("action = 'BATCH_ABORTED'").select("batch_id").distinct().withColumn("_dq", F.lit(True))
    out = batches.join(models.select("model_version_id", F.col("status").alias("_model")), "model_version_id", "left")
    for part in (bad_stage, runs, unbalanced, aborted):
        out = out.join(part, "batch_id", "left")
    failed = lambda c, name: F.when(F.coalesce(c, F.lit(True)), F.lit(name))
    reasons = [failed(F.col("status") != "SUCCESS", "BATCH_STATUS"), failed(F.coalesce("_stage", F.lit(False)), "STAGE_STATUS"), failed(F.col("_model") != "PUBLISHED", "MODEL_NOT_PUBLISHED"), failed(F.col("_run") != "SUCCESS", "IDENTITY_STATUS"), failed(F.coalesce("_recon", F.lit(False)), "RECONCILIATION"), failed(F.coalesce("_dq", F.lit(False)), "DQ_ABORTED")]
    out = out.withColumn("reasons", F.array_compact(F.array(*reasons)))
    return out.select("batch_id", F.coalesce("_run", F.lit("NOT_RUN")).alias("identity_status"), "reasons", (F.size("reasons") == 0).alias("eligible"))


def dag_nodes(feeds: DataFrame, gates: DataFrame) -> DataFrame:
    """feeds (feed_id) with upstreams, the number of edges into each, and cleared: none of these blocks."""
    into = gates.groupBy(F.col("downstream").alias("feed_id")).agg(F.count("*").alias("upstreams"), F.bool_or("blocked").alias("_blocked"))
    return feeds.join(into, "feed_id", "left").withColumns({"upstreams": F.coalesce("upstreams", F.lit(0)), "cleared": ~F.coalesce("_blocked", F.lit(False))}).drop("_blocked")


def crosswalk_active(records: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """records (source_system, source_hash) with the master of their active crosswalk row; what has one is HIGH_CONFIDENCE at 100, the rest is left to scoring.

    One row is active for a system and hash; of several the smallest master counts. Null keys match nothing.
    """
    active = crosswalk.where("is_active").groupBy("source_system", "source_hash").agg(F.min("master_id").alias("master_id"))
    out = records.join(active, ["source_system", "source_hash"], "left")
    found = F.col("master_id").isNotNull()
    return out.withColumns({"disposition": F.when(found, "HIGH_CONFIDENCE"), "score": F.when(found, F.lit(100)).cast("decimal(5,2)")})


def top_candidates(scored: DataFrame, record: str = "record_id", person: str = "master_id", n: int = 10) -> DataFrame:
    """(record, candidates): each record's n best candidates, by score and then person, in order; ranked before they are gathered."""
    place = F.row_number().over(Window.partitionBy(record).orderBy(F.desc("score"), F.asc(person)))
    best = scored.withColumn("_place", place).where(F.col("_place") <= n)
    inside = F.array_sort(F.collect_list(F.struct("_place", F.col(person).alias("person"), "score")))
    return best.groupBy(record).agg(F.transform(inside, lambda c: F.struct(c["person"].alias("person"), c["score"].alias("score"))).alias("candidates"))


def in_file_order(frame: DataFrame, number: str = "_source_row_num") -> DataFrame:
    """Rows by their number in the file; a number that is none counts as 0."""
    return frame.orderBy(F.coalesce(F.col(number).try_cast("long"), F.lit(0)))
