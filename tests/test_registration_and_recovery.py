"""Registration, monitor, recovery and rule configurations: nulls, ties, repeated rows, no rows."""

import datetime

import pytest

from feedloom.operators import monitor, recovery, rules
from feedloom.operators.rules import Rule
from feedloom.operators.validation import Field
from feedloom.sources import registration
from feedloom.sources.registration import Feed

FEEDS = [Feed("m", "m_*.csv", ("ID", "a,b"), ",", "in"), Feed("old", "*", active=False)]
KNOWN = "fingerprint string, name string"


def landed(spark, files, known=(), **kw):
    frame = spark.createDataFrame(files, "n int, name string, content binary")
    rows = registration.register_landing(frame, spark.createDataFrame(list(known), KNOWN), FEEDS, ["n"], **kw)
    return rows


def test_ladder_takes_its_gates_in_turn(spark):
    good = b'\xef\xbb\xbf id ,"a,b","x\ny"\r\n1,2\n'
    files = [
        (0, "other.csv", good), (1, "m_1.csv", good), (2, "m_2.csv", good), (3, "m_3.csv", b""), (4, "m_4.csv", None), (5, "m_5.csv", b"id,a,b\n"), (6, "m_6.csv", b"id\xff,a\n"),
        (7, "m_7.csv", b"\nid\n"), (8, "m_8.csv", b"x" * 200), (9, None, b"?"), (10, "m_9.csv", b"id\xff,a\n"),
    ]
    got = {r.n: r for r in landed(spark, files, max_bytes=100).collect()}
    assert [got[k].status for k in range(11)] == ["REJECTED", "ACCEPTED", "DUPLICATE", "REJECTED", "DUPLICATE", "REJECTED", "REJECTED", "REJECTED", "REJECTED", "REJECTED", "DUPLICATE"]
    assert got[0].reason == "No configured feed pattern matched filename 'other.csv'" and got[9].feed is None
    assert got[2].registered_as == "m_1.csv" and got[4].registered_as == "m_3.csv" and got[10].registered_as == "m_6.csv"  # rejected files are entered, too
    assert got[1].path == "in/m_1.csv" and got[2].path is None
    assert [got[k].reason for k in (3, 5, 6, 7, 8)] == [
        "File is empty (0 bytes)", "Missing required column in header: 'a,b'", "File encoding is invalid (expected UTF-8)", "File is empty or contains no header row", "File size 200 bytes exceeds max allowed 100 bytes",
    ]


def test_repeated_rows_known_files_and_no_files(spark):
    good = b'id,"a,b"\n'
    once = landed(spark, [(1, "m_1.csv", good), (1, "m_1.csv", good)])
    assert [r.status for r in once.collect()] == ["ACCEPTED", "ACCEPTED"]  # one arrival, whose rows share its status
    entered = [tuple(r) for r in registration.entries(once).distinct().collect()]
    again = landed(spark, [(1, "m_1.csv", good)], [*entered, (entered[0][0], "a.csv"), (None, "z")]).first()
    assert (again.status, again.registered_as) == ("DUPLICATE", "a.csv")
    assert [(r.stage_order, r.stage) for r in registration.opened(once).distinct().orderBy("stage_order").collect()] == [(1, "LANDING"), (2, "BRONZE"), (3, "SILVER_RAW")]
    none = landed(spark, [])
    assert none.count() == 0 and registration.opened(none).count() == 0


def test_many_copies_are_one_entry(spark):
    frame = spark.range(3000).selectExpr("CAST(id AS INT) AS n", "concat('m_', id, '.csv') AS name", "CAST(IF(id % 3 = 0, 'id,\"a,b\"\n', concat('id,\"a,b\"\n', id)) AS BINARY) AS content")
    rows = registration.register_landing(frame, spark.createDataFrame([], KNOWN), FEEDS, ["n"])
    assert {(r.status, r["count"]) for r in rows.groupBy("status").count().collect()} == {("ACCEPTED", 2001), ("DUPLICATE", 999)}
    assert rows.where("registered_as <> 'm_0.csv'").count() == 0


def at(minute):
    return datetime.datetime(2024, 1, 1, 0, minute)


def test_monitor(spark):
    batches = spark.createDataFrame(
        [(1, 7, "SUCCESS", at(0), at(5), at(3)), (2, 7, "RUNNING", at(0), at(10), None), (3, 8, "FAILED", at(0), None, at(9)), (4, None, None, at(0), at(1), at(2)), (5, 7, "SUCCESS", datetime.datetime(2023, 1, 1), at(1), at(2))],
        "batch_id int, feed_id int, status string, created_at timestamp, started_at timestamp, completed_at timestamp",
    )
    stages = spark.createDataFrame([(2, 2, "b", "RUNNING", at(20), None), (2, 1, "a", "SUCCESS", at(1), at(2)), (2, 1, "a", "SUCCESS", at(1), at(2)), (None, 1, "a", "FAILED", at(1), at(2))], "batch_id int, stage_order int, stage string, status string, started_at timestamp, completed_at timestamp")
    results = spark.createDataFrame([(1, "LOGGED_INFO"), (1, "PASSED"), (2, "QUARANTINED_ROWS"), (2, "BATCH_ABORTED"), (3, None)], "batch_id int, action string")
    drifts = spark.createDataFrame([(3, at(1), "BREAKING"), (3, at(2), "NON_BREAKING"), (3, at(2), "NONE")], "batch_id int, created_at timestamp, severity string")
    recon = spark.createDataFrame([(1, "PASS")], "batch_id int, status string")
    parts = (batches, stages, results, drifts, recon, "2024-01-01 00:30:00")
    got = {r.batch_id: r for r in monitor.monitor(*parts).collect()}
    assert {k: r.total_ms for k, r in got.items()} == {1: 0, 2: 1_200_000, 3: 0, 4: 0}
    assert {k: r.dq_action for k, r in got.items()} == {1: "LOGGED_WARNING", 2: "BATCH_ABORTED", 3: "PASSED", 4: "NO_RULES"}
    assert [(s.stage, s.duration_ms) for s in got[2].stages] == [("a", 60_000), ("a", 60_000), ("b", 600_000)] and got[1].stages is None
    assert got[2].quarantined and (got[3].drifted, got[3].drift_severity) == (True, "NON_BREAKING") and [got[k].recon_status for k in (1, 2)] == ["PASS", "PENDING"]
    ids = lambda **kw: sorted(r.batch_id for r in monitor.monitor(*parts, **kw).collect())
    assert ids(violations=True) == [2, 3] and ids(violations=False) == [1, 4] and ids(hours=None, feed_id=7) == [1, 2, 5] and ids(status="FAILED") == [3] and ids(stage_status="RUNNING") == [2] and ids(feed_id=9) == []


RECORD = "record_id int, batch_id string, feed_id string, source_row_number long, source_record_raw string, status string"
FIELDS = [Field("id", required=True), Field("day", "DATE"), Field("price")]
RULES = [Rule("r", "RANGE", "price", "INFO", {"max": 10})]


def test_reprocess(spark):
    raws = [" 1 | |5", "2|x|5", "3||11", "4", None, "", "5|2024-01-02|3|more"]
    records = spark.createDataFrame([(k, "b", "f", k, raw, "QUARANTINED") for k, raw in enumerate(raws)], RECORD)
    done = recovery.reprocess(records, FIELDS, RULES, "rec", "2024-02-01", "|")
    assert {r.record_id: r.reason for r in done.records.collect()} == {0: None, 1: "INVALID_DATE_FORMAT", 2: "VALUE_OUT_OF_RANGE", 3: None, 4: "MISSING_REQUIRED_FIELD", 5: "MISSING_REQUIRED_FIELD", 6: None}
    assert sorted((r._quarantine_source_id, r.id, r.day, r.price) for r in done.silver.collect()) == [("0", "1", None, "5"), ("3", "4", None, None), ("6", "5", "2024-01-02", "3")]
    assert tuple(done.totals.first()) == (7, 3, 4, 0, "PASS")
    kept = done.records.where("status = 'QUARANTINED'").select("source_record_raw", "resolution_batch_id").first()
    assert kept.source_record_raw is not None and kept.resolution_batch_id is None


def test_reprocess_refuses_and_takes_nothing(spark):
    for rows in ([(1, "b", "f", 1, "1", "REPROCESSED")], [(1, "b", "f", 1, "1", None)], [(1, "b", "f", 1, "1", "QUARANTINED"), (2, "b", "g", 1, "1", "QUARANTINED")]):
        with pytest.raises(ValueError):
            recovery.reprocess(spark.createDataFrame(rows, RECORD), FIELDS, RULES, "rec", "2024-02-01")
    done = recovery.reprocess(spark.createDataFrame([], RECORD), FIELDS, RULES, "rec", "2024-02-01")
    assert done.silver.count() == 0 and tuple(done.totals.first()) == (0, 0, 0, 0, "PASS")


TYPES = {"n": "INTEGER", "m": "DECIMAL", "d": "DATE", "s": "STRING"}


@pytest.mark.parametrize("kind, column, config, said", [
    ("RANGE", "n", {"min": 1, "max": "2.5"}, None), ("RANGE", "n", {"min": "x"}, "no number"), ("RANGE", "s", {"min": 1}, "needs a number"), ("RANGE", "q", {"min": 1}, "no such field"), ("RANGE", "n", {}, "no bound"),
    ("LENGTH", "s", {"min_length": -1}, "below 0"), ("LENGTH", "s", {"min_length": "3", "max_length": 20}, None), ("LENGTH", "s", {"min_length": 30, "max_length": "4"}, "crossed"),
    ("DATE_RANGE", "d", {"format": "MM/DD/YYYY", "min_date": "12/31/2023", "max_date": "01/02/2024"}, None), ("DATE_RANGE", "d", {"format": "MM/DD/YYYY", "min_date": "2023-12-31"}, "no date"),
    ("DATE_RANGE", "d", {"format": "YYYYMMDD", "min_date": "20231231"}, "unknown date format"), ("DATE_RANGE", "n", {"format": "YYYY-MM-DD", "min_date": "2023-12-31"}, "needs a date"),
    ("REGEX", "s", {"pattern": " "}, "empty"), ("REGEX", "s", {"pattern": None}, "compile"), ("REGEX", "s", {"pattern": "("}, "compile"), ("ENUM", "s", {"values": ["a", "a"]}, "once"), ("ENUM", "s", {"values": ["a", 1]}, "texts"),
    ("CROSS_FIELD", "n", {"compare_field": "m", "operator": "GT"}, None), ("CROSS_FIELD", "n", {"compare_field": "d", "operator": "GT"}, "both"), ("CROSS_FIELD", "n", {"compare_field": "d", "operator": "EQ"}, None),
    ("CROSS_FIELD", "n", {"compare_field": "n", "operator": "EQ"}, "itself"), ("CROSS_FIELD", "n", {"compare_field": "z", "operator": "LT"}, "no such field"), ("CROSS_FIELD", "n", {"operator": "LT"}, "second field"),
])
def test_rule_configurations(spark, kind, column, config, said):
    found = rules.problems(Rule("r", kind, column, config=config), TYPES)
    assert (not found) if said is None else any(said in text for text in found), found
