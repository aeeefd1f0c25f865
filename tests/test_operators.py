"""Operators on written-out rows: rules in both dialects, paths, identity scores, schedules, sources and streams."""

import hashlib
import hmac
from datetime import datetime, timedelta

import re

import pytest
from pyspark.sql import functions as F

from feedloom.functions import text
from feedloom.operators import gates, identity, ops, profile, rules, schedule, transforms, validation
from feedloom.operators.rules import Rule
from feedloom.sources import files
from feedloom.streaming import kpis

CLAIMS = [("CLM-101", "150.00", "120.00", "2026-01-15", "PAID", "ABC-01"), ("", "-50.00", "200.00", "2015-05-01", "UNKNOWN", "INVALID"), ("CLM-103", "450.00", "450.00", "2026-02-10", "DENIED", "ABC-03"), ("CLM-104", "75.25", "50.00", "2026-03-20", "PENDING", "ABC-04")]
CLAIM_RULES = [
    Rule("a", "NOT_NULL", "claim_id"), Rule("b", "RANGE", "amount", config={"min": 0, "max": 500}), Rule("c", "REGEX", "code", config={"pattern": "^ABC-[0-9]{2}$"}),
    Rule("d", "ENUM", "status", config={"values": ["PAID", "DENIED", "PENDING"]}), Rule("e", "LENGTH", "code", config={"min_length": 6, "max_length": 6}),
    Rule("f", "DATE_RANGE", "service_date", config={"min_date": "2026-01-01", "max_date": "2026-12-31"}), Rule("g", "CROSS_FIELD", "amount", config={"compare_field": "paid_amount", "operator": "GTE"}),
]


@pytest.mark.parametrize("dialect", ["production", "test"])
def test_each_rule_fails_the_second_claim(spark, dialect):
    frame = spark.createDataFrame(CLAIMS, "claim_id string, amount string, paid_amount string, service_date string, status string, code string")
    assert not [p for r in CLAIM_RULES for p in rules.problems(r)]
    assert [(r.evaluated, r.passed, r.failed, r.pass_rate) for r in rules.telemetry(frame, CLAIM_RULES, dialect).collect()] == [(4, 3, 1, 75.0)] * 7
    valid, bad = rules.split(frame, CLAIM_RULES)
    assert valid.count() == 3 and bad.first()["_failure"].reason == "MISSING_REQUIRED_FIELD"


def test_dialects_differ_on_nulls_and_patterns(spark):
    frame = spark.createDataFrame([("xABCx",), (None,), (" ",), ("ABC",)], "v string")
    rule = Rule("r", "REGEX", "v", config={"pattern": "ABC"})
    for dialect, want in (("production", [False] * 4), ("test", [True, True, True, False])):
        assert [r[0] for r in frame.select(rules.violated(rule, dialect)).collect()] == want
    numbers = spark.createDataFrame([("NaN",), ("1_000",), ("1e2",), ("5",)], "v string")
    assert [r[0] for r in numbers.select(rules.violated(Rule("r", "RANGE", "v", config={"max": 50}))).collect()] == [True, True, True, False]
    assert rules.problems(Rule("r", "RANGE", "v", config={"min": 3, "max": 1})) and rules.problems(Rule("r", "REGEX", "v", config={"pattern": "("}))


def test_validation_takes_the_first_failing_field(spark):
    frame = spark.createDataFrame([("M1", "Ann", "1990-1-5", "F"), ("M4", "", "2099-01-01", "X"), ("M5", "Bo", "2099-01-01", "M"), ("M6", "Cy", "05/01/1990", "M"), ("M7", "Di", "1990-01-01", "X")], "id string, last_name string, date_of_birth string, gender string")
    fields = [validation.Field("id", required=True), validation.Field("last_name", required=True), validation.Field("date_of_birth", "DATE", True), validation.Field("gender", "ENUM", allowed=("M", "F"))]
    got = [r.f and r.f.reason for r in frame.select(validation.failure(fields, "2026-01-01").alias("f")).collect()]
    assert got == [None, "MISSING_REQUIRED_FIELD", "FUTURE_DATE", "INVALID_DATE_FORMAT", "INVALID_ENUM_VALUE"]
    lines = spark.createDataFrame([("a|b|c",), ("a,b;c,d",), ("abc",)], "v string")
    assert [r[0] for r in lines.select(validation.sniff_delimiter(F.col("v"))).collect()] == ["|", ",", ","]


def test_paths(spark):
    frame = spark.createDataFrame([({"entry": [{"res": {"id": "1", "k": "x"}}, {"res": {"id": "2", "k": "y"}}, {"res": {"id": "3", "k": "x"}}]},)], "d struct<entry:array<struct<res:struct<id:string,k:string>>>>")
    take = lambda p, default=None: frame.select(transforms.extract(F.col("d"), p, default)).first()[0]
    assert take("entry[0].res.id") == "1" and take("entry[99].res.id") is None and take("entry[99].res.id", "none") == "none"
    assert take("$.entry[*].res.id") == ["1", "2", "3"] and len(take("entry[*]")) == 3
    flat = frame.select(transforms.extract(F.col("d"), "entry[*].res").alias("rows")).select(transforms.extract(F.struct("rows"), "rows[?(@.k=='x')].id"))
    assert flat.first()[0] == ["1", "3"]
    with pytest.raises(ValueError):
        transforms.steps("a[")
    nested = spark.createDataFrame([(1, {"a": {"b": 2}}, [1, 2]), (2, None, [])], "id int, s struct<a:struct<b:int>>, xs array<int>")
    assert nested.select(*transforms.flatten(nested.schema)).columns == ["id", "s_a_b", "xs"]
    assert nested.select(*transforms.flatten(nested.schema, max_depth=2)).columns == ["id", "s_a", "xs"]
    assert sorted(map(tuple, transforms.explode_rows(nested.select("id", "xs"), "xs", "x").collect()), key=str) == [(1, 0, 1), (1, 1, 2), (2, 0, None)]
    assert transforms.explode_rows(nested.select("id", "xs"), "xs", "x", False).count() == 2


def test_hashes_and_redaction(spark):
    frame = spark.createDataFrame([("Ann  smith",), ("mail a.b@c.org or 123-45-6789, 555-123-4567 MRN-99123",), (None,)], "v string")
    got = [r[0] for r in frame.select(text.hmac_sha256(b"k" * 70, F.col("v"))).collect()]
    assert got[0] == hmac.new(b"k" * 70, b"Ann  smith", hashlib.sha256).hexdigest() and got[2] is None
    assert frame.select(text.redact(F.col("v"))).collect()[1][0] == "mail [REDACTED_EMAIL] or [REDACTED_SSN], [REDACTED_PHONE] [REDACTED_MRN]"
    said = spark.createDataFrame([("row 5 of /var/in/a.csv at 2026-01-01T00:00:00Z",), ("row 77 of /var/in/b.csv  at 2026-02-02 11:00:00",), ("",)], "v string")
    signatures = [r[0] for r in said.select(text.failure_signature(F.col("v"))).collect()]
    assert signatures[0] == signatures[1] and signatures[2] == "UnknownError"


def test_identity_scores(spark):
    names = list(identity.POINTS)
    base = dict.fromkeys(names, "same")

    def person(**other):
        return tuple((base | other)[n] for n in names)

    cases = {(): 100, ("postal_code", "gender"): 90, ("first_name", "postal_code"): 85, ("last_name", "first_name", "gender", "postal_code"): 65, ("ssn",): 60, ("dob",): 75}
    schema = ", ".join(f"{n}_hash string" for n in names)
    for missing, want in cases.items():
        a, b = spark.createDataFrame([person(**dict.fromkeys(missing))], schema).alias("a"), spark.createDataFrame([person()], schema).alias("b")
        assert a.crossJoin(b).select(identity.score()).first()[0] == want
    scored = spark.createDataFrame([(1, 1, 90.0), (1, 2, 86.0), (2, 1, 85.0), (3, 1, 65.0), (4, 1, 64.0), (5, 1, 95.0), (5, 2, 90.0)], "record_id long, master_id long, score double")
    got = {r.record_id: r.disposition for r in identity.dispositions(spark.range(1, 7).withColumnRenamed("id", "record_id"), scored).collect()}
    assert got == {1: "SCORE_TIE", 2: "AMBIGUOUS_MATCH", 3: "AMBIGUOUS_MATCH", 4: "NO_VIABLE_CANDIDATE", 5: "HIGH_CONFIDENCE", 6: "NO_VIABLE_CANDIDATE"}


def test_candidates_hash_tokens_once(spark):
    rows = [(1, "a", "d", "n"), (2, None, "d", "n"), (3, "a", "e", "m")]
    sides = [identity.tokens(spark.createDataFrame(rows, f"{i} long, ssn string, dob string, last string"), b"k", {"ssn": "ssn", "dob": "dob", "last_name": "last"}, [i]) for i in ("record_id", "master_id")]
    found = identity.candidates(*sides)
    assert "sha2" not in found._jdf.queryExecution().toString()
    assert sorted((r.record_id, r.master_id) for r in found.collect()) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (3, 1), (3, 3)]


def test_crosswalk_split_and_audit(spark):
    rows = [("s", "1", datetime(2026, 1, 1), None, "EXACT"), ("s", "2", datetime(2026, 1, 1), datetime(2026, 2, 1), "EXACT")]
    walk = spark.createDataFrame([(a, b, 10, c, d, e) for a, b, c, d, e in rows], "system string, id string, master_id long, valid_from timestamp, valid_to timestamp, match_type string")
    out = identity.split_person(walk, spark.createDataFrame([("s", "1", 20)], "system string, id string, new_id long"), ["system", "id"], F.lit("2026-03-01").cast("timestamp"))
    assert sorted((r.id, r.master_id, r.valid_to is None) for r in out.collect()) == [("1", 10, False), ("1", 20, True), ("2", 10, False)]
    assert identity.overlaps(out, ["system", "id"]).count() == 0 and identity.overlaps(out.union(walk), ["system", "id"]).count() > 0


def test_schedules(spark):
    assert schedule.cron_field("1-10/3,20", 0, 59) == {1, 4, 7, 10, 20} and schedule.cron_field("*/15", 0, 59) == {0, 15, 30, 45}
    with pytest.raises(ValueError):
        schedule.cron("61 * * * *")
    assert schedule.next_run("0 9 * * *", "America/New_York", datetime(2026, 7, 1, 0, 0)) == datetime(2026, 7, 1, 13, 0)
    assert schedule.next_run("0 9 * * *", "America/New_York", datetime(2026, 1, 1, 0, 0)) == datetime(2026, 1, 1, 14, 0)
    assert len(schedule.slots("0 0 13 * 5", "Nowhere", datetime(2026, 1, 1), datetime(2026, 1, 31))) == 6
    at = lambda h, m=0: datetime(2026, 1, 1, h, m)
    windows = schedule.slot_windows(spark.createDataFrame([("f", at(8)), ("f", at(12)), ("g", at(8)), ("h", at(8))], "feed string, slot timestamp"))
    arrivals = spark.createDataFrame([("f", 1, at(7, 30)), ("g", 3, at(7, 45)), ("g", 2, at(7, 15)), ("h", 4, at(9, 30))], "feed string, arrival_id long, detected_at timestamp")
    for match in (schedule.match_arrivals, schedule.match_disjoint):
        got = {(r.feed, r.slot.hour): (r.arrival_id, r.status) for r in schedule.slot_status(windows, match(windows, arrivals), "2026-01-01 10:00:00").collect()}
        assert got == {("f", 8): (1, "ON_TIME"), ("f", 12): (None, "EXPECTED"), ("g", 8): (2, "ON_TIME"), ("h", 8): (4, "LATE")}


def test_arrivals_are_matched_by_groups_of_windows(spark):
    from collections import defaultdict
    from random import Random

    rng, at = Random(4), lambda m: datetime(2026, 1, 1) + timedelta(minutes=m)
    slots = [(f, at(m)) for f in "fgh" for m in sorted(rng.sample(range(0, 6000, 30), 25))]
    windows = schedule.slot_windows(spark.createDataFrame(slots, "feed string, slot timestamp"), 200, 60)
    rows = [(rng.choice("fgh"), k, at(rng.randrange(0, 6000))) for k in range(400)] + [("f", 1000 + k, at(rng.randrange(0, 6000, 100))) for k in range(200)]
    arrivals = spark.createDataFrame(rows, "feed string, arrival_id long, detected_at timestamp")
    want, used = {}, defaultdict(set)
    for w in sorted(windows.collect(), key=lambda w: (w.feed, w.slot)):
        left = sorted((d, i) for f, i, d in rows if f == w.feed and w.opens <= d <= w.closes and i not in used[f])
        if left:
            used[w.feed].add(left[0][1])
            want[w.feed, w.slot] = left[0][1]
    matched = schedule.match_arrivals(windows, arrivals)
    assert {(r.feed, r.slot): r.arrival_id for r in matched.collect()} == want
    apart = spark.createDataFrame([("f", at(m), at(m - 5), at(m + 5), at(m + 5)) for m in (10, 50, 100)], "feed string, slot timestamp, opens timestamp, deadline timestamp, closes timestamp")
    again = spark.createDataFrame([("f", 1, at(12)), ("f", 1, at(97)), ("f", 1, at(98)), ("f", 2, at(99)), ("f", 3, at(51))], arrivals.schema)
    assert {(r.slot, r.arrival_id) for r in schedule.match_arrivals(apart, again).collect()} == {(at(10), 1), (at(50), 3), (at(100), 2)}
    sizes = matched._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroupsInPandas [feed#" in sizes and ", group#" in sizes.split("FlatMapGroupsInPandas", 1)[1].splitlines()[0]


def test_profile_quirks(spark):
    frame = spark.createDataFrame([(1, "0", "125.5", "15/01/2026", ""), (2, "1", "450", "22/01/2026", "x"), (3, "1", "48", "16/01/2026", None), (4, "0", "75.25", "17/01/2026", " ")], "ord int, flag string, amount string, day string, rare string")
    got = {r.column: r for r in profile.profile(frame, ["ord"]).collect()}
    assert (got["flag"].inferred, got["amount"].inferred, got["day"].inferred) == ("BOOLEAN", "DECIMAL", "DATE")
    assert (got["amount"].min_value, got["amount"].max_value, got["rare"].nulls, got["rare"].null_pct) == ("48", "450", 3, 75.0)


def test_gates(spark):
    requests = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 1)], "consumer string, batch_id long")
    consumers = spark.createDataFrame([("a", True, 1, True), ("b", False, 1, False)], "consumer string, active boolean, consumer_version int, needs_certified boolean")
    models = spark.createDataFrame([(1, 1, True), (2, 1, False)], "batch_id long, model_version int, certified boolean")
    assert {(r.consumer, r.batch_id): r.why for r in gates.consumer_gate(requests, consumers, models).collect()} == {("a", 1): "OK", ("a", 2): "NOT_CERTIFIED", ("b", 1): "INACTIVE_CONSUMER", ("c", 1): "INACTIVE_CONSUMER"}
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "src int, dst int")
    assert {r.start for r in gates.reachable(edges).where("start = node").collect()} == {1, 2, 3}


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿ID, Name\n1,"A ""q"" b"\n\n2\n3,"two\nlines",extra\n'.encode())
    got = [(r._source_row_num, r.id, r.name) for r in files.read_numbered(spark, str(tmp_path / "a.csv"), ["id", "name"]).orderBy("_source_row_num").collect()]
    assert got == [(1, "1", 'A "q" b'), (2, None, None), (3, "2", None), (4, "3", "two\nlines")]
    assert files.read_delimited(spark, str(tmp_path / "a.csv")).columns == ["id", "name"]
    (tmp_path / "n.json").write_text('{"a": 1}\n\nbad\n{"a": 2}\n')
    assert files.read_ndjson(spark, str(tmp_path / "n.json")).where("bad").count() == 1
    heads = {"a,b\n1,2": "CSV", "": "CSV", '{"a":1}\n{"a":2}': "NDJSON", '[{"a":1}]': "JSON", '{"resourceType":"Bundle"}': "FHIR", "<?xml version='1.0'?><a/>": "XML"}
    assert {h: files.detect_format(h) for h in heads} == heads
    bundle = spark.createDataFrame([('{"resourceType":"Bundle","entry":[{"resource":{"id":"1"}},{"id":"2"}]}',)], "t string")
    assert [r[0] for r in files.fhir_resources(bundle, "t").collect()] == ['{"id":"1"}', '{"id":"2"}']
    xml = spark.createDataFrame([("<n:a xmlns:n='u'><b k='v'>x</b><c>1</c><c>2</c></n:a>",)], "t string")
    assert sorted(map(tuple, files.xml_paths(xml, "t").collect())) == [("a.b", "x"), ("a.b@k", "v"), ("a.c[*].c", "1"), ("a.c[*].c", "2")]
    landed = spark.createDataFrame([("m_1.csv", 5, "x"), ("m_2.csv", 5, "x"), ("m_3.csv", 0, "y"), ("z.csv", 5, "w"), ("m_4.csv", 5, "old")], "name string, size long, fingerprint string")
    status = {r.name: r.status for r in files.register(landed, spark.createDataFrame([("old",)], "fingerprint string"), [("members", "m_*.csv")], ["name"]).collect()}
    assert status == {"m_1.csv": "ACCEPTED", "m_2.csv": "DUPLICATE", "m_3.csv": "EMPTY", "z.csv": "NO_FEED", "m_4.csv": "DUPLICATE"}


def test_streams(spark, tmp_path):
    rows = [(k % 5, "t" if k % 2 else "u", datetime(2026, 1, 1, k % 3, k)) for k in range(30)]
    frame = spark.createDataFrame(rows, "fingerprint int, kind string, at timestamp")
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("first", kpis.first_arrivals(stream, "fingerprint", "at"), "append"), ("counts", kpis.windowed_counts(stream, "at", "kind"), "complete")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination(120)
    assert spark.table("first").count() == 5 and spark.table("counts").agg(F.sum("n")).first()[0] == 30


def test_entry_without_the_corpus_operators(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5 and set(entry.oracle_sql()) <= set(entry.queries())


def test_privacy_patterns_against_python(spark):
    said = ["claims_123456789.csv", "MRN AB12345 and mrn:99999", "x123-45-6789", "DOB: 1980-01-02 patient name: John Smith zip: 12345", "call (555) 123-4567, or +1 555.123.4567; 5551234567", "12 Old Mill Road, Springfield 12345-6789", "123456789 123456789 078-05-1120", "a@b.org PatientID#A1234 é123456789", "line 5 of C:\\x\\y.csv at 2024-01-02T03:04:05.6+01:00", "/a/b /tmp/f.txt'x record#12 0xFFab", "member name:\tAda Lovelace king", "", None]
    frame = spark.createDataFrame([(n, v) for n, v in enumerate(said)], "n int, v string")
    got = {r.n: r for r in frame.select("n", text.redact(F.col("v")).alias("op"), text.scrub(F.col("v")).alias("all"), text.failure_signature(F.col("v")).alias("sig")).collect()}

    def plain(value, patterns):
        for pattern, mark in patterns:
            value = re.sub(pattern, mark, value)
        return value

    for n, value in enumerate(said):
        v = value or ""
        assert got[n].op == (plain(v, text.OPERATIONAL_PATTERNS) or None) and got[n].all == plain(v, text.PERSONAL_PATTERNS)
        assert got[n].sig == (re.sub(r"\s+", " ", plain(plain(v, text.FAILURE_PATTERNS), text.PERSONAL_PATTERNS)).strip() if v else "UnknownError")
    assert got[0].op == "claims_[REDACTED_SSN].csv" and got[1].op == "[REDACTED_MRN] and [REDACTED_MRN]" and got[2].op == "x[REDACTED_SSN]"
    assert got[3].all == "[REDACTED_DOB] [REDACTED_NAME]: 12345" or "John" not in got[3].all
    assert got[8].sig == "row <NUM> of <PATH> at <TS>" and got[9].sig.startswith("/a/b <PATH>'x row <NUM> <HEX_ADDR>")


def test_alerts_reopen_within_the_hours(spark):
    t = lambda h: f"2024-01-01 {h:02d}:00:00"
    failures = spark.createDataFrame([("a", t(1)), ("a", t(2)), ("a", t(5)), ("a", t(9)), ("b", t(3)), ("b", t(9))], "k string, at string").selectExpr("k", "cast(at as timestamp) at")
    solved = spark.createDataFrame([("a", t(3)), ("a", t(6)), ("b", t(1)), (None, t(2))], "k string, at string").selectExpr("k", "cast(at as timestamp) at")
    got = sorted((r.k, r.alert, r.n, r.reopened) for r in ops.alert_episodes(failures, solved, ["k"], "at").collect())
    assert got == [("a", 1, 3, 1), ("a", 2, 1, 0), ("b", 1, 2, 0)]


def test_only_runs_that_succeeded_are_looked_at(spark):
    edges = spark.createDataFrame([("d", u, "HARD", 1, 5, b) for u, b in ((1, None), (2, False), (3, None), (4, None), (5, None))], "downstream string, upstream int, kind string, max_lag_hours int, max_quarantine_pct int, block_on_failure boolean")
    runs = spark.createDataFrame([(1, "FAILED"), (2, "FAILED"), (3, "SUCCESS"), (4, "RUNNING")], "upstream int, status string").selectExpr("*", "timestamp'2024-01-01' completed_at", "'PASS' recon_status", "0 quarantine_pct", "false aborted")
    got = {r.upstream: r.reason for r in gates.dependency_gate(edges, runs, "2024-01-02").collect()}
    assert got == {1: "UPSTREAM_FAILED", 2: "READY", 3: "STALE", 4: "STILL_RUNNING", 5: "NEVER_RAN"}


def test_paths_behind_wildcards(spark):
    row = spark.range(1).select(F.expr("named_struct('a', array(named_struct('b', array(1, 2), 'c d', 5), named_struct('b', array(3, 4), 'c d', 6)))").alias("r"))
    paths = {"a[*].b[0]": [1, 3], "a[*].b[*]": [1, 2, 3, 4], "a[0]['c d']": 5, "a[*]['c d']": [5, 6], "a[*].b[7]": None}
    got = row.select(*[transforms.extract(F.col("r"), p).alias(str(n)) for n, p in enumerate(paths)]).first()
    assert list(got) == list(paths.values())


def test_rules_end_no_job(spark):
    frame = spark.createDataFrame([("1" * 25,), ("12",), (None,), ("x",)], "v string")
    of = lambda kind, **c: [r[0] for r in frame.select(rules.violated(rules.Rule("r", kind, "v", config=c))).collect()]
    assert of("RANGE", max=10**26) == [False, False, False, True] and of("RANGE", max=10**22) == [True, False, False, True]
    assert of("REGEX", pattern="(") == [False] * 4 and of("DATE_RANGE", min_date="soon", format="%d-%b-%Y") == [True, True, False, True]
    line = {"dictionary": {"12": "y"}, "on_unmapped": "ERROR"}
    got = frame.select(transforms.compile_transform("VALUE_MAP", ["v"], line).alias("m"), transforms.without_value(["v"], line).alias("u")).collect()
    assert [tuple(r) for r in got] == [(None, True), ("y", False), (None, False), (None, True)]
    days = spark.createDataFrame([("02-Jan-2024",), ("x",)], "v string")
    assert [r[0] for r in days.select(transforms.compile_transform("DATE_FORMAT", ["v"], {"source_format": "%d-%b-%Y", "target_format": "%Y-%m-%d"})).collect()] == ["2024-01-02", "x"]


def test_delay_counts_from_the_deadline(spark):
    windows = spark.sql("select 'f' feed, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,id) slot, timestamp'2024-01-01 01:00:00' + make_interval(0,0,0,id) deadline, id = 3 paused from range(5)")
    matched = spark.sql("select 'f' feed, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,id) slot, id arrival_id, timestamp'2024-01-01 01:00:30' + make_interval(0,0,0,id,0,id * 10) detected_at from range(2)")
    got = {r.slot.day: (r.status, r.delay_minutes) for r in schedule.slot_status(windows, matched, "2024-01-05 00:30:00").collect()}
    assert got == {1: ("LATE", 1), 2: ("LATE", 10), 3: ("MISSED_SLA", 2 * 1440 - 30), 4: ("PAUSED", 0), 5: ("EXPECTED", 0)}
