"""Matching a whole batch of records: blocks that survive heavy keys, and the stage in which later records use earlier links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.lineage import cut, spread
from feedloom.functions.text import blank_to_null, canonical_source
from feedloom.operators.identity import POINTS, digest, score, tokens

_HASHES = [f"{a}_hash" for a in POINTS]
#: Attributes that tell the pairs of a block apart. Pairs of a block of names that share the SSN are found in the block of that SSN.
_INSIDE = {"ssn": ["dob", "last_name", "first_name", "gender", "postal_code"], "name": ["ssn", "first_name", "gender", "postal_code"]}
#: Keys of a heavy block that name fewer attributes than this are shared by many records, which are dealt over WAYS tasks.
_SHARED, WAYS = 2, 32


def record_tokens(frame: DataFrame, key: bytes, system: Column, record: str = "record_id", order: str = "_source_row_num") -> DataFrame:
    """(record, row_num, source_system, source_hash, the six token hashes) of a batch's raw columns, blank ones counting as absent.

    Dates of birth stand in date_of_birth or dob, postal codes in postal_code or zip, the source's identifier in member_id or id; absent columns are null.
    A record without an identifier has no source hash and is like no other. A row number that is none counts as 0.
    """

    def first_of(*names: str) -> Column:
        held = [blank_to_null(F.col(n).cast("string")) for n in names if n in frame.columns]
        return F.coalesce(*held) if held else F.lit(None).cast("string")

    raw = frame.select(
        F.col(record), F.coalesce(F.col(order).try_cast("long"), F.lit(0)).alias("row_num"), system.cast("string").alias("source_system"),
        canonical_source(key, system.cast("string"), first_of("member_id", "id"))[0].alias("source_hash"),
        first_of("ssn").alias("ssn"), first_of("date_of_birth", "dob").alias("dob"), first_of("last_name").alias("last_name"),
        first_of("first_name").alias("first_name"), first_of("gender").alias("gender"), first_of("postal_code", "zip").alias("postal_code"),
    )
    return tokens(raw, key, {a: a for a in POINTS}, [record, "row_num", "source_system", "source_hash"])


def _short(frame: DataFrame, *keep: str) -> DataFrame:
    """keep and the tokens' digests, null for null."""
    return frame.select(*keep, *[digest(F.col(h)).alias(h) for h in _HASHES])


def _grown(frame: DataFrame) -> DataFrame:
    """A side of a join that grows with the input, both sides of which are shuffled: by the small files that it is read from Spark would send it through the driver, exploded rows and all."""
    return frame.hint("merge")


def _key_of(*parts: Column) -> Column:
    """A digest of parts that are digests, empty or null, the same only for rows that agree in all of them."""
    return digest(F.concat(*[F.coalesce(F.concat(F.lit("="), F.hex(h)), F.lit("|")) for h in parts]))


def _block_key(block: str) -> Column:
    return F.col("ssn_hash") if block == "ssn" else F.concat("last_name_hash", "dob_hash")


def _patterns(frame: DataFrame, block: str, of_records: bool) -> DataFrame:
    """frame with a row for each pattern of its block: (_key, _named, _points), where each attribute inside the block is named, null or open.

    A person has the pattern of its own values with any of them open. A record asks for persons that have its value, none, or any;
    a record without a value asks for any, as it makes no difference. _points are what a record has in common with whoever stands in the
    pattern and differs from it in all that is open.
    """
    shared = sum(same for a, (same, _) in POINTS.items() if a in {"ssn": ["ssn"], "name": ["last_name", "dob"]}[block])
    out = frame.withColumns({"_key": F.col("_block"), "_named": F.lit(0), "_points": F.lit(shared)})
    for a in _INSIDE[block]:
        h, key, named, points = (F.col(c) for c in (f"{a}_hash", "_key", "_named", "_points"))
        of = lambda key, named, points: F.struct(key.alias("key"), named.alias("named"), points.alias("points"))
        any_of = of(F.concat(key, F.lit("|*")), named, points + (F.when(h.isNull(), 0).otherwise(POINTS[a][1]) if of_records else 0))
        null_of = of(F.concat(key, F.lit("|0")), named + 1, points + 0)
        same = of(F.concat(key, F.lit("|="), F.hex(h)), named + 1, points + POINTS[a][0])
        if of_records:
            asked = F.array(any_of, null_of) if block == "name" and a == "ssn" else F.array(any_of, null_of, same)
            choices = F.when(h.isNull(), F.array(any_of)).otherwise(asked)
        else:
            own = F.when(h.isNull(), null_of) if block == "name" and a == "ssn" else F.when(h.isNull(), null_of).otherwise(same)
            choices = F.array_compact(F.array(any_of, own))
        out = out.withColumn("_p", F.explode(choices)).withColumns({"_key": F.col("_p.key"), "_named": F.col("_p.named"), "_points": F.col("_p.points")}).drop("_p")
    return out.withColumn("_key", digest(F.col("_key")))


def _clipped(points: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), points)).cast("decimal(5,2)")


def _top(scored: DataFrame, k: int) -> DataFrame:
    """(_ask, _person, score) of each ask's k best; a pair may be found by several patterns."""
    order = Window.partitionBy("_ask").orderBy(F.desc("score"), F.asc("_person"))
    once = scored.groupBy("_ask", "_person").agg(F.max("score").alias("score"))
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _in_block(asks: DataFrame, people: DataFrame, block: str, k: int, heavy: int) -> DataFrame:
    """(_ask, _person, score): the k best persons of each ask's block; asks and people have _block and digests."""
    light = lambda b: asks.alias("a").join(_grown(b).alias("b"), F.col("a._block") == F.col("b._block")).select("a._ask", F.col("b._person").alias("_person"), score().alias("score"))
    crowded = people.groupBy("_block").agg(F.count("*").alias("_n")).where(F.col("_n") > heavy).select("_block")
    if not crowded.take(1):
        return _top(light(people), k)
    crowded = cut(crowded, "crowded")
    full = people.join(crowded, "_block", "left_semi")
    smallest = Window.partitionBy("_key").orderBy("_person")
    kept = _patterns(full, block, False).select("_key", "_named", "_person").withColumn("_n", F.row_number().over(smallest)).where(F.col("_n") <= k)
    ways = F.when(F.col("_named") < _SHARED, F.sequence(F.lit(0), F.lit(WAYS - 1))).otherwise(F.array(F.lit(0)))
    kept = kept.select("_key", "_person", F.explode(ways).alias("_way"))
    way = F.when(F.col("_named") < _SHARED, F.pmod(F.xxhash64("_ask"), F.lit(WAYS))).otherwise(F.lit(0)).cast("int")
    asked = _patterns(spread(asks.join(crowded, "_block", "left_semi")), block, True).select("_ask", "_key", way.alias("_way"), _clipped(F.col("_points")).alias("score"))
    by_pattern = asked.join(_grown(kept), ["_key", "_way"]).select("_ask", "_person", "score")
    return _top(light(people.join(crowded, "_block", "left_anti")).union(by_pattern), k)


def best(records: DataFrame, persons: DataFrame, k: int = 2, record: str = "record_id", person: str = "master_id", heavy: int = 64) -> DataFrame:
    """(record, place, person, score): each record's k best candidates, ties to the smaller person; records without any have no rows.

    Candidates share the SSN, or last name and date of birth, as in identity.candidates(). Records and persons of equal tokens are one class,
    of which the k smallest persons count. In a block of names records that differ in the SSN only ask as one, as if no person shared it: who does is found in the block of
    that SSN, scores more there, and keeps nobody else from the k best. In a block of more than `heavy` persons, pairs are not made: its persons are
    kept by pattern, the k smallest of each, and a record asks for the patterns of the scores it can reach. A differing attribute counts least,
    so whoever stands in a pattern that leaves it open scores no less than the pattern says: the k persons kept there rank before any that is not, and whoever is kept has its
    score from the pattern of all that it shares. Work is linear in records and persons, 54 patterns an ask in a block of names and 243 in one of an SSN at most. Null ids count as ids.
    """
    people = _short(persons.withColumn("_person", F.col(person)), "_person")
    first = Window.partitionBy(*_HASHES).orderBy("_person")
    people = cut(people.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k).drop("_n"), "persons")
    rows = cut(_short(records, record).withColumn("_c", _key_of(*[F.col(h) for h in _HASHES])), "records")
    classes = rows.groupBy("_c").agg(*[F.any_value(h).alias(h) for h in _HASHES])
    # an SSN that is like no person's, where there is one
    other = F.when(F.col("ssn_hash").isNotNull(), F.lit(b""))
    inside = [other, *[F.col(f"{a}_hash") for a in ("last_name", "dob", "first_name", "gender", "postal_code")]]
    named = F.when(_block_key("name").isNotNull(), _key_of(*inside))
    classes = cut(classes.withColumn("_name_ask", named), "classes")
    blocks = {block: people.withColumn("_block", _block_key(block)).where("_block is not null") for block in _INSIDE}
    by_ssn = classes.withColumn("_block", _block_key("ssn")).where("_block is not null").withColumnRenamed("_c", "_ask").drop("_name_ask")
    by_name = classes.where("_name_ask is not null").withColumn("ssn_hash", other).groupBy(F.col("_name_ask").alias("_ask")).agg(*[F.any_value(h).alias(h) for h in _HASHES]).withColumn("_block", _block_key("name"))
    of_ssn = _in_block(by_ssn, blocks["ssn"], "ssn", k, heavy).select(F.col("_ask").alias("_c"), "_person", "score")
    of_name = _in_block(cut(by_name, "asks"), blocks["name"], "name", k, heavy).select(F.col("_ask").alias("_name_ask"), "_person", "score")
    of_name = classes.select("_c", "_name_ask").join(_grown(of_name), "_name_ask").select("_c", "_person", "score")
    top = _top(of_ssn.union(of_name).withColumnRenamed("_c", "_ask"), k)
    return rows.select(record, F.col("_c").alias("_ask")).join(_grown(top), "_ask").select(record, "place", F.col("_person").alias(person), "score")


def disposition(top: Column, after: Column) -> Column:
    """What a record's two best scores say: over 85 links unless the next is within 5, from 65 on it is ambiguous."""
    return F.when((top > 85) & (top - after < 5), "SCORE_TIE").when(top > 85, "HIGH_CONFIDENCE").when(top >= 65, "AMBIGUOUS_MATCH").otherwise("NO_VIABLE_CANDIDATE")


def dispositions(records: DataFrame, persons: DataFrame, record: str = "record_id", person: str = "master_id", heavy: int = 64) -> DataFrame:
    """(record, person, score, disposition) by the best two candidates; a record without one is NO_VIABLE_CANDIDATE without person and score."""
    two = best(records, persons, 2, record, person, heavy)
    pair = two.groupBy(record).agg(F.max_by(person, -F.col("place")).alias(person), F.max("score").alias("score"), F.max(F.when(F.col("place") == 2, F.col("score"))).alias("_next"))
    out = records.select(record).join(_grown(pair), record, "left")
    return out.select(record, person, "score", disposition(F.col("score"), F.col("_next")).alias("disposition"))


def identity_stage(records: DataFrame, persons: DataFrame, crosswalk: DataFrame, record: str = "record_id", person: str = "master_id", heavy: int = 64) -> DataFrame:
    """(record, row_num, source_system, source_hash, person, score, disposition, resolution) for each record of a batch, as if taken in order.

    records: record_tokens(), each record id once and none null; crosswalk: source_system, source_hash, person, is_active. In order of row_num and record id a record
    takes the active crosswalk row of its source (ACTIVE_CROSSWALK), else the row that an earlier record of the batch has made (LINKED_IN_BATCH), both
    HIGH_CONFIDENCE at 100; else it is SCORED. Scores don't depend on the order, so all are made at once, and the first record of a source that links is found by
    an aggregate: a source of any number of records is one row before it is joined. Of several active rows the smallest person counts.
    """
    source = ["source_system", "source_hash"]
    active = crosswalk.where("is_active").groupBy(*source).agg(F.min(person).alias("_held"))
    rows = cut(_short(records, record, "row_num", *source).join(_grown(active), source, "left"), "batch")
    open_rows = rows.where("_held is null")
    found = cut(open_rows.select(record, "row_num", *source).join(_grown(dispositions(open_rows, _short(persons, person), record, person, heavy)), record), "scored")
    place = F.struct(F.col("row_num"), F.col(record))
    first = found.where("disposition = 'HIGH_CONFIDENCE' and source_hash is not null and source_system is not null")
    first = first.groupBy(*source).agg(F.min(place).alias("_first"), F.min_by(person, place).alias("_linked"))
    found = found.join(_grown(first), source, "left")
    late = F.coalesce(place > F.col("_first"), F.lit(False))
    hundred = F.lit(100).cast("decimal(5,2)")
    of_batch = found.select(
        record, "row_num", *source, F.when(late, F.col("_linked")).otherwise(F.col(person)).alias(person), F.when(late, hundred).otherwise(F.col("score")).alias("score"),
        F.when(late, "HIGH_CONFIDENCE").otherwise(F.col("disposition")).alias("disposition"), F.when(late, "LINKED_IN_BATCH").otherwise("SCORED").alias("resolution"),
    )
    held = rows.where("_held is not null").select(record, "row_num", *source, F.col("_held").alias(person), hundred.alias("score"), F.lit("HIGH_CONFIDENCE").alias("disposition"), F.lit("ACTIVE_CROSSWALK").alias("resolution"))
    return held.unionByName(of_batch)


def new_links(stage: DataFrame, crosswalk: DataFrame, batch_id: Column, at: Column, record: str = "record_id", person: str = "master_id") -> DataFrame:
    """Crosswalk rows that a stage appends: one a source that a score has linked, active and open from `at`; none for what the crosswalk holds active.

    A source's system and hash stay unique among active rows, also where the stage's rows are given twice. Links without a source hash are their record's own.
    """
    made = stage.where("resolution = 'SCORED' and disposition = 'HIGH_CONFIDENCE'")
    known = made.where("source_hash is not null").groupBy("source_system", "source_hash").agg(F.min_by(F.struct(person, "score"), F.struct("row_num", record)).alias("_m"))
    known = known.join(_grown(crosswalk.where("is_active").select("source_system", "source_hash")), ["source_system", "source_hash"], "left_anti")
    known = known.select("source_system", "source_hash", f"_m.{person}", "_m.score")
    own = made.where("source_hash is null").select("source_system", "source_hash", person, "score")
    return known.union(own).select("source_system", "source_hash", person, F.col("score").alias("match_score"), F.lit("DETERMINISTIC_HIGH_CONFIDENCE").alias("match_type"), F.lit(True).alias("is_active"), at.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), batch_id.alias("source_batch_id"))


def exceptions(stage: DataFrame, candidates: DataFrame, record: str = "record_id", person: str = "master_id") -> DataFrame:
    """(record, source_system, source_hash, fingerprint, exception_type, highest_score, candidates, status) of what a stage did not link.

    candidates: best() with k = 10; they are listed in order. A record without candidates has an empty list and a score of 0. The fingerprint is a hash of the source's.
    """
    left = stage.where("disposition <> 'HIGH_CONFIDENCE'")
    inside = F.array_sort(F.collect_list(F.struct("place", F.col(person).alias("person"), F.col("score").alias("points"))))
    listed = candidates.groupBy(record).agg(F.transform(inside, lambda c: F.struct(c["person"].alias("person"), c["points"].alias("score"))).alias("candidates"))
    out = left.join(_grown(listed), record, "left")
    none = F.array().cast(listed.schema["candidates"].dataType)
    return out.select(record, "source_system", "source_hash", F.sha2("source_hash", 256).alias("fingerprint"), F.col("disposition").alias("exception_type"), F.coalesce("score", F.lit(0)).cast("decimal(5,2)").alias("highest_score"), F.coalesce("candidates", none).alias("candidates"), F.lit("PENDING").alias("status"))


def stage_status(stage: DataFrame) -> DataFrame:
    """(rows_in, linked, exceptions, run_status): SUCCESS, or BLOCKED where the batch has no records, as then its input is missing."""
    linked = F.count_if(F.col("disposition") == "HIGH_CONFIDENCE")
    return stage.agg(F.count("*").alias("rows_in"), linked.alias("linked"), (F.count("*") - linked).alias("exceptions"), F.when(F.count("*") > 0, "SUCCESS").otherwise("BLOCKED").alias("run_status"))
