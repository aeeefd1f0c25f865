"""A batch of merges and splits of persons, carried out as if one after the other."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.lineage import cut


class Lifecycle(NamedTuple):
    """What a batch of merges and splits leaves: the crosswalk, the persons, their tokens, and each event's outcome."""

    crosswalk: DataFrame
    persons: DataFrame
    tokens: DataFrame
    outcomes: DataFrame


def _order() -> Column:
    return F.struct(F.col("at"), F.col("event_id"))


def accepted_merges(persons: DataFrame, merges: DataFrame) -> DataFrame:
    """(source_id, target_id, o) of the merges (event_id, at, source_id, target_id) that hold, one a source; o is the struct (at, event_id) they are ordered by.

    A merge holds if both persons are ACTIVE and differ, and no earlier merge has taken either away. Each round decides all merges
    that nothing undecided comes before: those of a person already gone fail, and the first of each source whose target nothing earlier may take hold.
    """
    live = persons.where("status = 'ACTIVE'").select("master_id")
    known = merges.where("source_id <> target_id").select("source_id", "target_id", _order().alias("o")).distinct()
    for side in ("source_id", "target_id"):
        known = known.join(live.withColumnRenamed("master_id", side), side, "left_semi")
    todo = cut(known.select("source_id", "target_id", "o"), "merges")
    held = todo.limit(0)
    while todo.take(1):
        waiting, gone = (x.groupBy("source_id").agg(F.min("o").alias("o")) for x in (todo, held))
        rows = todo
        for name, table in (("waits", waiting), ("gone", gone)):
            for side in ("source", "target"):
                rows = rows.join(table.select(F.col("source_id").alias(f"{side}_id"), F.col("o").alias(f"{side}_{name}")), f"{side}_id", "left")
        first = lambda c: F.coalesce(F.col(c) < F.col("o"), F.lit(False))
        rows = rows.withColumn("fails", first("source_gone") | first("target_gone"))
        rows = cut(rows.withColumn("holds", ~F.col("fails") & ~first("source_waits") & ~first("target_waits")), "round")
        held = held.union(rows.where("holds").select("source_id", "target_id", "o"))
        todo = rows.where("not fails and not holds").select("source_id", "target_id", "o")
    return held


def merge_paths(held: DataFrame) -> DataFrame:
    """(source_id, n, target_id, o): the nth person that a person ends up in, by accepted merges; paths double in length with each round."""
    paths, length = cut(held.select("source_id", F.lit(1).alias("n"), "target_id", "o"), "paths"), 1
    while paths.where(F.col("n") == length).take(1):
        ends = paths.where(F.col("n") == length).select("source_id", F.col("target_id").alias("via"))
        on = paths.select(F.col("source_id").alias("via"), "n", "target_id", "o")
        paths = cut(paths.union(ends.join(on, "via").select("source_id", (F.col("n") + length).alias("n"), "target_id", "o")), "paths")
        length *= 2
    return paths


def _fails(rows: DataFrame) -> Column:
    """Why a split fails, in the order of the checks; null if it holds."""
    return (
        F.when(~F.col("source_live"), "SOURCE_NOT_ACTIVE").when(F.col("n_rows") == 0, "IDENTIFIER_NOT_FOUND").when(F.col("n_rows") > 1, "IDENTIFIER_AMBIGUOUS")
        .when(~F.col("target_live"), "TARGET_NOT_ACTIVE").when(F.col("source_ssn") != F.col("target_ssn"), "SSN_CONFLICT")
    )


def apply_events(crosswalk: DataFrame, persons: DataFrame, tokens: DataFrame, events: DataFrame) -> Lifecycle:
    """The state after events (event_id, at, operation MERGE or SPLIT, source_id, target_id, is_new, source_system, source_hash) in order of at and event_id.

    crosswalk: source_system, source_hash, master_id, valid_from, valid_to, match_type, rows with no valid_to being active; persons: master_id, status; tokens:
    master_id, ssn_hash, is_current, effective_from, effective_to, one current row a person at most. A repeated event counts once.

    A merge takes all active rows of its source to its target, at its time; its source becomes MERGED and its tokens close. A split takes the one active row of a
    system and hash from its source to its target, which is_new makes; a target without tokens gets its source's. What a merge took away goes on with the next
    merge, so a row may move several times in a batch: rows that would begin and end at one time don't stand. Outcomes: EXECUTED, or why an event failed (NOT_FOUND, SOURCE_NOT_ACTIVE,
    TARGET_NOT_ACTIVE, IDENTIFIER_NOT_FOUND, IDENTIFIER_AMBIGUOUS, SSN_CONFLICT). A person that a split makes takes part in merges of later batches only.
    Rounds grow with the longest wait of one event for another, not with the number of events or rows.
    """
    events = cut(events.groupBy("event_id").agg(F.min(F.struct(*[c for c in events.columns if c != "event_id"])).alias("e")).select("event_id", "e.*").withColumn("o", _order()), "events")
    walk = cut(crosswalk.withColumn("_row", F.monotonically_increasing_id()), "crosswalk")
    held = cut(accepted_merges(persons, events.where("operation = 'MERGE'")), "accepted")
    paths = merge_paths(held)
    gone = held.select(F.col("source_id").alias("master_id"), F.col("o").alias("gone"))
    key = ["source_system", "source_hash"]
    when = events.schema["o"].dataType.simpleString()

    # splits, each when no earlier one that may bear on it is left
    todo = events.where("operation = 'SPLIT'").select("event_id", "at", "o", "source_id", "target_id", F.coalesce("is_new", F.lit(False)).alias("is_new"), *key)
    rows_of = walk.where("valid_to is null").join(todo.select(*key).distinct(), key, "left_semi")
    segments = rows_of.select("_row", *key, F.col("master_id").alias("start"), F.lit(None).cast(when).alias("since"), F.lit(None).cast(when).alias("until"))
    current = tokens.where("is_current").groupBy("master_id").agg(F.first("ssn_hash", ignorenulls=True).alias("ssn"))
    # status and tokens before any split; made: persons and tokens that splits add
    made = current.limit(0).select("master_id", "ssn", F.lit(None).cast(when).alias("o"), F.lit(False).alias("is_new"), F.lit(False).alias("has_token"), F.lit(None).cast(current.schema["master_id"].dataType).alias("like"))
    decided = todo.limit(0).select("event_id", F.lit(None).cast("string").alias("outcome"))
    live = persons.where("status = 'ACTIVE'").select("master_id", F.lit(True).alias("live"))
    todo, segments = cut(todo, "splits"), cut(segments, "segments")
    while todo.take(1):
        by_key, by_target = todo.groupBy(*key).agg(F.min("o").alias("k_o")), todo.groupBy("target_id").agg(F.min("o").alias("t_o"))
        rows = todo.join(by_key, key, "left").join(by_target, "target_id", "left").join(by_target.select(F.col("target_id").alias("source_id"), F.col("t_o").alias("s_o")), "source_id", "left")
        waits = F.coalesce(F.col("k_o") < F.col("o"), F.lit(False)) | F.coalesce(F.col("t_o") < F.col("o"), F.lit(False)) | F.coalesce(F.col("s_o") < F.col("o"), F.lit(False))
        rows = rows.withColumn("waits", waits).drop("k_o", "t_o", "s_o")
        # where each open row of the key stands at the time of the split
        open_rows = segments.where("until is null").select("_row", *[F.col(c).alias(f"_{c}") for c in key], "start", "since")
        met = rows.where("not waits").join(open_rows, [F.col(c) == F.col(f"_{c}") for c in key])
        moves = paths.select(F.col("source_id").alias("start"), F.col("target_id").alias("now"), F.col("o").alias("m_o"))
        met = met.join(moves, "start", "left").groupBy("event_id", "source_id", "_row", "start").agg(
            F.max_by(F.when((F.col("m_o") < F.col("o")) & (F.col("since").isNull() | (F.col("m_o") > F.col("since"))), F.col("now")), F.when((F.col("m_o") < F.col("o")) & (F.col("since").isNull() | (F.col("m_o") > F.col("since"))), F.col("m_o"))).alias("now"))
        at_source = met.where(F.coalesce("now", "start") == F.col("source_id")).groupBy("event_id").agg(F.count("*").alias("n_rows"), F.min("_row").alias("_row"))
        rows = rows.join(at_source, "event_id", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
        people = live.join(gone, "master_id", "left").join(current, "master_id", "left").join(made.groupBy("master_id").agg(F.bool_or("is_new").alias("m_new"), F.bool_or("has_token").alias("m_token"), F.max("ssn").alias("m_ssn")), "master_id", "full")
        people = people.join(current.select("master_id", F.lit(True).alias("token")), "master_id", "left")
        for side in ("source", "target"):
            own = people.select(F.col("master_id").alias(f"{side}_id"), (F.coalesce("live", F.lit(False)) | F.coalesce("m_new", F.lit(False))).alias(f"{side}_live"), F.col("gone").alias(f"{side}_gone"), F.coalesce("ssn", "m_ssn").alias(f"{side}_ssn"), (F.coalesce("token", F.lit(False)) | F.coalesce("m_token", F.lit(False))).alias(f"{side}_token"))
            rows = rows.join(own, f"{side}_id", "left")
            still = F.coalesce(F.col(f"{side}_live"), F.lit(False)) & ~F.coalesce(F.col(f"{side}_gone") < F.col("o"), F.lit(False))
            rows = rows.withColumn(f"{side}_live", still | (F.col("is_new") if side == "target" else F.lit(False)))
        rows = cut(rows.withColumn("outcome", F.when(~F.col("waits"), F.coalesce(_fails(rows), F.lit("EXECUTED")))), "round")
        done = rows.where("outcome = 'EXECUTED'")
        decided = decided.union(rows.where("not waits").select("event_id", "outcome"))
        seeds = F.coalesce("source_token", F.lit(False)) & ~F.coalesce("target_token", F.lit(False))
        made = made.union(done.select(F.col("target_id").alias("master_id"), F.when(seeds, F.col("source_ssn")).alias("ssn"), "o", "is_new", seeds.alias("has_token"), "source_id"))
        moved = done.select("_row", F.col("o").alias("_cut"), "target_id")
        kept = segments.join(moved, "_row", "left").withColumn("until", F.when(F.col("until").isNull(), F.col("_cut")).otherwise(F.col("until"))).select(segments.columns)
        opened = segments.where("until is null").join(moved, "_row").select("_row", *key, F.col("target_id").alias("start"), F.col("_cut").alias("since"), F.lit(None).cast(when).alias("until"))
        segments, made = cut(kept.union(opened), "segments"), cut(made, "made")
        todo = rows.where("waits").select(todo.columns)

    # every stand of a row: where it begins, and the merges on the way until it is split off
    whole = walk.where("valid_to is null").join(segments.select("_row").distinct(), "_row", "left_anti").select("_row", *key, F.col("master_id").alias("start"), F.lit(None).cast(when).alias("since"), F.lit(None).cast(when).alias("until"))
    whole = whole.union(segments)
    begun = whole.select("_row", F.col("start").alias("person"), F.col("since").alias("o"), F.when(F.col("since").isNotNull(), "SPLIT_OVERRIDE").alias("kind"))
    steps = whole.join(paths.select(F.col("source_id").alias("start"), "target_id", "o"), "start").where("(since is null or o > since) and (until is null or o < until)")
    stands = begun.union(steps.select("_row", F.col("target_id").alias("person"), "o", F.lit("MERGE_OVERRIDE").alias("kind")))
    after = F.lead("o").over(Window.partitionBy("_row").orderBy(F.asc_nulls_first("o")))
    kind = walk.schema["valid_from"].dataType
    stands = stands.withColumn("next", after).join(walk, "_row")
    from_at, to_at = F.col("o.at").cast(kind), F.col("next.at").cast(kind)
    columns = {"master_id": F.col("person"), "valid_from": F.coalesce(from_at, "valid_from"), "valid_to": to_at, "match_type": F.coalesce("kind", "match_type")}
    stands = stands.where(F.col("o").isNull() | F.col("next").isNull() | (from_at < to_at)).select(*[columns.get(c, F.col(c)).alias(c) for c in crosswalk.columns])
    new_walk = walk.where("valid_to is not null").select(crosswalk.columns).union(stands)

    fresh = made.where("is_new").select("master_id").distinct().join(persons.select("master_id"), "master_id", "left_anti")
    merged = held.select(F.col("source_id").alias("master_id"), F.col("target_id").alias("merged_into"), F.lit(True).alias("_merged"))
    new_persons = persons.select("master_id", "status").union(fresh.select("master_id", F.lit("ACTIVE"))).join(merged, "master_id", "left")
    new_persons = new_persons.select("master_id", F.when(F.col("_merged"), "MERGED").otherwise(F.col("status")).alias("status"), "merged_into")

    when_at = tokens.schema["effective_from"].dataType
    closing = held.select(F.col("source_id").alias("master_id"), F.col("o.at").cast(when_at).alias("_at"))
    closes = F.col("is_current") & F.col("_at").isNotNull()
    begun_tokens = made.where("has_token").select("master_id", "ssn", F.col("o.at").cast(when_at).alias("at"))
    held_tokens = tokens.select("master_id", "ssn_hash", "is_current", "effective_from", "effective_to").union(begun_tokens.select("master_id", "ssn", F.lit(True), "at", F.lit(None).cast(when_at)))
    new_tokens = held_tokens.join(closing, "master_id", "left").select("master_id", "ssn_hash", (F.col("is_current") & ~closes).alias("is_current"), "effective_from", F.when(closes, F.col("_at")).otherwise(F.col("effective_to")).alias("effective_to"))

    merges = events.where("operation = 'MERGE'").join(held.select("o", F.lit(True).alias("_held")), "o", "left")
    for side in ("source", "target"):
        merges = merges.join(persons.select(F.col("master_id").alias(f"{side}_id"), F.col("status").alias(f"{side}_status")), f"{side}_id", "left").join(gone.select(F.col("master_id").alias(f"{side}_id"), F.col("gone").alias(f"{side}_gone")), f"{side}_id", "left")
    dead = lambda side: (F.col(f"{side}_status") != "ACTIVE") | F.coalesce(F.col(f"{side}_gone") < F.col("o"), F.lit(False))
    missing = F.col("source_status").isNull() | F.col("target_status").isNull()
    outcome = F.when(F.col("_held"), "EXECUTED").when(missing, "NOT_FOUND").when(dead("source"), "SOURCE_NOT_ACTIVE").otherwise("TARGET_NOT_ACTIVE")  # a merge into itself has no target left
    return Lifecycle(new_walk, new_persons, new_tokens, merges.select("event_id", outcome.alias("outcome")).union(decided))
