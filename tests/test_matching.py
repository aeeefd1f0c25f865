"""Matching by batch against pairwise brute force and a sequential program."""

import random

import pytest
from pyspark.sql import functions as F

from feedloom.operators import identity, matching

HASHES = [f"{a}_hash" for a in identity.POINTS]
SCHEMA = "{} long, " + ", ".join(f"{h} string" for h in HASHES)


def people(rng, n, start):
    pick = lambda values: rng.choice(values)
    return [(start + k, pick([None, "s1", "s1", "s2", f"s{k % 40}"]), pick(["d1", "d1", "d2", None]), pick(["n1", "n1", "n2", None]), pick(["f1", "f2", "f3", None]), pick(["m", "w", None]), pick(["p1", "p2", None])) for k in range(n)]


def points(a, b):
    total = sum(same if x == y else other for (same, other), x, y in zip(identity.POINTS.values(), a[1:], b[1:], strict=True) if x and y)
    return max(0, min(100, total))


def ranked(a, persons):
    near = [p for p in persons if (a[1] and a[1] == p[1]) or (a[3] and a[2] and (a[3], a[2]) == (p[3], p[2]))]
    return sorted({(-points(a, p), p[0]) for p in near})


def said(found):
    if not found or -found[0][0] < 65:
        return "NO_VIABLE_CANDIDATE"
    top = -found[0][0]
    if top > 85 and len(found) > 1 and top + found[1][0] < 5:
        return "SCORE_TIE"
    return "HIGH_CONFIDENCE" if top > 85 else "AMBIGUOUS_MATCH"


@pytest.mark.parametrize(("heavy", "k"), [(64, 2), (0, 2), (3, 10)])
def test_best_is_that_of_all_pairs(spark, heavy, k):
    rng = random.Random(heavy + k)
    persons, records = people(rng, 150, 1000), people(rng, 120, 0)
    persons += [(2000 + n, *persons[0][1:]) for n in range(5)]
    records += [(500, *records[0][1:]), (501, None, None, None, None, None, None)]
    got = matching.best(spark.createDataFrame(records, SCHEMA.format("record_id")), spark.createDataFrame(persons, SCHEMA.format("master_id")), k, heavy=heavy)
    want = [(a[0], n, person, -s) for a in records for n, (s, person) in enumerate(ranked(a, persons)[:k], 1)]
    assert len(want) > 150 and sorted((r[0], r[1], r[2], int(r[3])) for r in got.collect()) == sorted(want)


def test_a_heavy_block_makes_no_pairs(spark):
    """300 records and 300 persons of one name: the joins of patterns make far fewer rows than the block has pairs."""
    rng = random.Random(4)
    rows = [(k, f"s{k}", "d", "n", rng.choice(["f1", "f2"]), None, rng.choice(["p1", "p2"])) for k in range(300)]
    records, persons = spark.createDataFrame(rows, SCHEMA.format("record_id")), spark.createDataFrame(rows, SCHEMA.format("master_id"))
    a, b = (x.withColumn("_block", F.lit("b")).withColumn("_class", F.lit("c")) for x in (records, persons))
    asked, kept = matching._patterns(a, "name", True), matching._patterns(b, "name", False)
    assert asked.count() <= 36 * 300 and kept.select("_key").distinct().count() <= 20
    got = {r[0]: (r[1], int(r[2]), r[3]) for r in matching.dispositions(records, persons, heavy=10).collect()}
    assert got == {a[0]: (ranked(a, rows)[0][1], -ranked(a, rows)[0][0], said(ranked(a, rows))) for a in rows}


def sequential(records, persons, held):
    active, out = {}, []
    for system, source, person, is_active in held:
        if is_active:
            active[system, source] = min(person, active.get((system, source), person))
    made = {}
    for rid, row, source, *own in sorted(records, key=lambda r: (r[1], r[0])):
        key = ("s", source)
        if source and key in active:
            out.append((rid, active[key], 100, "HIGH_CONFIDENCE", "ACTIVE_CROSSWALK"))
        elif source and key in made:
            out.append((rid, made[key], 100, "HIGH_CONFIDENCE", "LINKED_IN_BATCH"))
        else:
            found = ranked((rid, *own), persons)
            out.append((rid, found[0][1] if found else None, -found[0][0] if found else None, said(found), "SCORED"))
            if out[-1][3] == "HIGH_CONFIDENCE" and source:
                made[key] = found[0][1]
    return sorted(out, key=repr), made


def staged(spark, records, persons, held):
    a = spark.createDataFrame([(r[0], r[1], "s", *r[2:]) for r in records], "record_id long, row_num long, source_system string, source_hash string, " + SCHEMA.format("x").split(", ", 1)[1])
    b = spark.createDataFrame(persons, SCHEMA.format("master_id"))
    return a, b, spark.createDataFrame(held, "source_system string, source_hash string, master_id long, is_active boolean")


def test_stage_is_that_of_a_sequential_program(spark):
    rng = random.Random(9)
    persons = [(1000 + k, f"s{k}", f"d{k % 3}", f"n{k % 5}", f"f{k % 2}", "m", None) for k in range(30)] + [(1100, "s1", "d1", "n1", "f1", "m", None)]
    records = []
    for k in range(200):
        p = rng.choice(persons)
        records.append((k, rng.randrange(60), rng.choice([None, "hot", "hot", *[f"h{j}" for j in range(30)]]), p[1], p[2], rng.choice([p[3], "other"]), rng.choice([p[4], "other"]), p[5], None))
    held = [("s", "h1", 7, True), ("s", "h1", 5, True), ("s", "h2", 9, False), ("t", "h3", 1, True), ("s", None, 3, True)]
    a, b, c = staged(spark, records, persons, held)
    stage = matching.identity_stage(a, b, c)
    want, made = sequential(records, persons, held)
    assert {w[4] for w in want} == {"SCORED", "LINKED_IN_BATCH", "ACTIVE_CROSSWALK"}
    assert sorted(((r.record_id, r.master_id, None if r.score is None else int(r.score), r.disposition, r.resolution) for r in stage.collect()), key=repr) == want
    links = matching.new_links(stage.union(stage), c, F.lit(1), F.lit("2024-01-01").cast("timestamp")).where("source_hash is not null").collect()
    assert sorted((r.source_hash, r.master_id) for r in links) == sorted((h, m) for (_, h), m in made.items())
    left = matching.exceptions(stage, matching.best(a, b, 10)).collect()
    assert sorted(r.record_id for r in left) == sorted(w[0] for w in want if w[3] != "HIGH_CONFIDENCE")
    assert all([(c.person, int(c.score)) for c in r.candidates] == [(p, -s) for s, p in ranked(next((x[0], *x[3:]) for x in records if x[0] == r.record_id), persons)[:10]] for r in left)
    status = matching.stage_status(stage).first()
    assert (status.rows_in, status.linked + status.exceptions, status.run_status) == (200, 200, "SUCCESS")


def test_a_source_thrice_gives_no_link_then_two(spark):
    person = [(1, "s", "d", "n", "f", "m", "p")]
    records = [(1, 1, "h", None, "d", "other", "f", "m", "p"), (2, 2, "h", "s", "d", "n", "f", "m", "p"), (3, 3, "h", None, None, None, None, None, None)]
    a, b, c = staged(spark, records, person, [])
    assert [(r.resolution, r.disposition == "HIGH_CONFIDENCE") for r in matching.identity_stage(a, b, c).orderBy("record_id").collect()] == [("SCORED", False), ("SCORED", True), ("LINKED_IN_BATCH", True)]
    empty = matching.identity_stage(a.limit(0), b, c)
    assert empty.count() == 0 and matching.stage_status(empty).first().run_status == "BLOCKED"
    assert matching.identity_stage(a, b.limit(0), c).where("disposition = 'NO_VIABLE_CANDIDATE' and master_id is null").count() == 3


def test_record_tokens_take_the_first_column_that_has_text(spark):
    raw = spark.createDataFrame([(1, "7", " ", "A1", None, "x", " Ann ", "1"), (2, "x", "M", "A1", "1990", "y", "ann", None)], "record_id long, _source_row_num string, member_id string, id string, date_of_birth string, dob string, first_name string, score string")
    one, two = matching.record_tokens(raw, b"k", F.lit("s")).orderBy("record_id").collect()
    assert (one.row_num, two.row_num, one.first_name_hash == two.first_name_hash, one.dob_hash is None, one.source_hash == two.source_hash) == (7, 0, True, False, False)
    assert one.ssn_hash is None and one.gender_hash is None and matching.record_tokens(raw.limit(0), b"k", F.lit("s")).count() == 0


@pytest.mark.parametrize("share", [1, 1000])
def test_as_of_is_that_of_all_pairs(spark, share):
    rng = random.Random(share)
    walk = [(rng.choice(["a", "b", "c", "d"]), k, rng.randrange(0, 500), 0) for k in range(60)]
    walk = [(key, master, start, None if rng.random() < 0.2 else start + rng.randrange(0, 200)) for key, master, start, _ in walk] + [("e", 100 + k, 50 * k, 50 * k + 50) for k in range(6)] + [("e", 7, 10, 10), (None, 8, 1, None), ("a", 9, None, None)]
    asked = [(k, rng.choice(["a", "b", "e", "e", "z"]), rng.randrange(-20, 900)) for k in range(400)] + [(1, "a", 70), (1, "a", 70), (500, None, 5), (501, "a", None)]
    stamp = lambda c: F.timestamp_seconds(c).alias(c)
    versions = spark.createDataFrame(walk, "id string, master_id long, valid_from long, valid_to long").select("id", "master_id", stamp("valid_from"), stamp("valid_to"))
    lookups = spark.createDataFrame(asked, "event long, id string, at long").select("event", "id", stamp("at"))
    want = []
    for event, key, at in asked:
        found = [(s, -m) for k, m, s, e in walk if k == key and key and at is not None and s is not None and s <= at and (e is None or at < e)]
        want.append((event, -max(found)[1] if found else None))
    got = identity.as_of(lookups, versions, ["id"], share=share, ranges=4).collect()
    assert sorted(((r.event, r.master_id) for r in got), key=repr) == sorted(want, key=repr)
    assert identity.as_of(lookups.limit(0), versions, ["id"]).count() == 0 and identity.as_of(lookups, versions.limit(0), ["id"]).where("master_id is null").count() == len(asked)


def test_records_that_differ_in_the_ssn_only_ask_a_block_of_names_as_one(spark, monkeypatch):
    """Digests of 16 bytes and a score go with a pattern, and 300 records of one name ask for those of 4."""
    rows = [(k, f"s{k}", "d", "n", f"f{k % 2}", None, f"p{k // 2 % 2}") for k in range(300)]
    asked, own = [], matching._patterns
    monkeypatch.setattr(matching, "_patterns", lambda frame, block, of_records: asked.append(own(frame, block, of_records)) or asked[-1])
    records, persons = spark.createDataFrame(rows, SCHEMA.format("record_id")), spark.createDataFrame(rows, SCHEMA.format("master_id"))
    got = matching.best(records, persons, 2, heavy=10)
    want = [(a[0], n, p, -s) for a in rows for n, (s, p) in enumerate(ranked(a, rows)[:2], 1)]
    assert sorted((r[0], r[1], r[2], int(r[3])) for r in got.collect()) == sorted(want)
    assert asked[1].count() <= 54 * 4 and "binary" in dict(asked[1].dtypes)["_key"]


def test_no_side_of_a_join_that_grows_goes_through_the_driver(spark):
    """Joins by broadcast hold the crowded blocks at most: small files may stand for many rows, and asks are exploded."""
    rng = random.Random(3)
    persons, records = (spark.createDataFrame(people(rng, 60, start), SCHEMA.format(name)) for start, name in ((1000, "master_id"), (0, "record_id")))
    plan = matching.dispositions(records, persons, heavy=3)._jdf.queryExecution().executedPlan().toString()
    sent = [line for line in plan.splitlines() if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]
    assert "SortMergeJoin" in plan and all("LeftSemi" in line or "LeftAnti" in line for line in sent)


def test_pairs_are_joined_by_digests_of_their_tokens_and_not_through_the_driver(spark):
    rng = random.Random(5)
    persons, records = people(rng, 80, 1000), people(rng, 80, 0)
    persons, records = ([(k, *(v and v.ljust(64, "0") for v in row)) for k, *row in side] for side in (persons, records))
    found = identity.candidates(spark.createDataFrame(records, SCHEMA.format("record_id")), spark.createDataFrame(persons, SCHEMA.format("master_id")))
    want = sorted((a[0], person, -s) for a in records for s, person in ranked(a, persons))
    assert sorted((r[0], r[1], int(r[2])) for r in found.collect()) == want and len(want) > 100
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 2 and "ssn_hash#" in plan and "Broadcast" not in plan
    assert all("ssn_hash:binary" in line for line in plan.splitlines() if "ReadSchema" in line)
