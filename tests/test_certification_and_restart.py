"""Certification by masks, the commit protocol, rules in a stream, privacy on nested values."""

import datetime

import pytest
from pyspark.sql import functions as F

from feedloom.functions import nested
from feedloom.operators import certification, operations
from feedloom.operators.rules import Rule
from feedloom.sources import attempts
from feedloom.streaming import kpis


def day(n):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)


def frames(spark, alerts=()):
    batches = [(k, 1, day(k), "SUCCESS") for k in range(1, 9)] + [(9, 2, day(9), "FAILED"), (10, 3, day(10), None)]
    rows = {
        "batches": (batches, "batch_id long, feed_id long, created_at timestamp, status string"), "stages": ([(9, "FAILED"), (9, "SUCCESS"), (1, "SUCCESS")], "batch_id long, status string"),
        "drifts": ([(2, "BREAKING", "DETECTED"), (1, "BREAKING", "ACKNOWLEDGED"), (3, "NON_BREAKING", "DETECTED")], "feed_id long, severity string, status string"),
        "recon": ([(k, 100 + k, "PASS", int(k == 2)) for k in range(1, 9)] + [(10, 110, None, 0)], "batch_id long, recon_id long, status string, discrepancy long"),
        "results": ([(k, "rv", 1, "QUARANTINED_ROWS") for k in (3, 4, 5, 6, 6)] + [(7, "rv", 0, "QUARANTINED_ROWS"), (7, "rv", 3, "LOGGED_WARNING")], "batch_id long, rule_version_id string, failed_rows long, action string"),
        "quarantine": ([(8, "QUARANTINED"), (8, "QUARANTINED"), (7, "REPROCESSED")], "batch_id long, status string"), "alerts": (list(alerts), "batch_id long, status string"),
    }
    return [spark.createDataFrame(r, s) for r, s in rows.values()]


WAIVER = "waiver_id long, feed_id long, status string, scope string, batch_id long, target_batch_ids array<long>, range_start long, range_end long, valid_from timestamp, expires_at timestamp, control_id string, control_type string, max_batches int, applied int"


def waiver(n, scope, feed=1, status="APPROVED", batch=None, listed=None, start=None, end=None, since=day(0), until=day(30), control=None, kind=None, most=None, used=None):
    return (n, feed, status, scope, batch, listed, start, end, since, until, control, kind, most, used)


def certified(spark, waivers, at=day(20), alerts=()):
    batches, *found = frames(spark, alerts)
    granted = certification.grants(batches, spark.createDataFrame(waivers, WAIVER), F.lit(at))
    return {r.batch_id: (r.reasons, r.waiver_ids, r.eligible) for r in certification.certify(batches, certification.evidence(batches, *found), granted).collect()}


def test_seven_checks_without_waivers(spark):
    got = certified(spark, [], alerts=[(1, "OPEN"), (1, "CLOSED"), (7, "CLOSED")])
    assert {k: v[0] for k, v in got.items()} == {1: ["ALERTS"], 2: ["RECONCILIATION"], 3: ["DATA_QUALITY"], 4: ["DATA_QUALITY"], 5: ["DATA_QUALITY"], 6: ["DATA_QUALITY"], 7: [], 8: ["QUARANTINE"], 9: ["BATCH_STATUS", "STAGES", "SCHEMA", "RECONCILIATION"], 10: ["BATCH_STATUS", "RECONCILIATION"]}
    assert all(v[2] == (not v[0]) and v[1] == [] for v in got.values())


def test_scopes_and_a_quota_that_runs_out(spark):
    waivers = [
        waiver(1, "TIME_BOUNDED", control="rv", most=3, used=1), waiver(2, "SINGLE_BATCH", batch=8, kind="QUARANTINE_ACCUMULATION"), waiver(3, "BATCH_RANGE", listed=[2, 7], control="102"),
        waiver(4, "BATCH_RANGE", feed=2, start=9, end=9, kind="RECONCILIATION"), waiver(5, "BATCH_RANGE", feed=2, start=9, end=77, kind="SCHEMA_DRIFT"), waiver(6, "SINGLE_BATCH", batch=9, kind="SCHEMA_DRIFT"),
    ]
    got = certified(spark, waivers)
    assert {k: (got[k][0], got[k][1]) for k in (2, 3, 4, 5, 6, 8)} == {2: ([], [3]), 3: ([], [1]), 4: ([], [1]), 5: (["DATA_QUALITY"], []), 6: (["DATA_QUALITY"], []), 8: ([], [2])}
    assert got[9] == (["BATCH_STATUS", "STAGES", "SCHEMA"], [4], False)  # 5 has an unknown end, 6 is of another feed


@pytest.mark.parametrize("wrong", [{"status": "PENDING"}, {"until": day(20)}, {"since": day(21)}, {"most": 2, "used": 2}, {"since": day(9)}])
def test_waivers_out_of_force(spark, wrong):
    assert certified(spark, [waiver(1, "TIME_BOUNDED", control="rv", **wrong)])[3] == (["DATA_QUALITY"], [], False)


def test_no_batches(spark):
    batches, *found = (f.limit(0) for f in frames(spark))
    granted = certification.grants(batches, spark.createDataFrame([], WAIVER), F.lit(day(1)))
    assert certification.certify(batches, certification.evidence(batches, *found), granted).count() == 0


def test_a_killed_batch_gives_each_row_once(spark, tmp_path):
    root, runs = str(tmp_path / "r"), []
    rows = spark.range(10)

    def stages(dies):
        def second(held):
            runs.append("second")
            if dies:
                attempts.write_attempt(held["first"], root, "b", "second")
                raise RuntimeError
            return held["first"].where("id < 4")

        return [("first", lambda _: runs.append("first") or rows), ("second", second)]

    with pytest.raises(RuntimeError):
        attempts.run_batch(spark, root, "b", stages(True))
    assert attempts.committed(spark, root, "first").count() == 10 and attempts.committed(spark, root, "second").count() == 0
    assert [attempts.run_batch(spark, root, "b", stages(False)) for _ in range(2)] == ["SUCCESS"] * 2
    assert runs == ["first", "second", "second"] and attempts.committed(spark, root, "second").count() == 4
    assert {p.name.partition("=")[0] for p in (tmp_path / "r/data/stage=second/batch=b").glob("a*")} == {"attempt"} and len(list((tmp_path / "r/data/stage=second/batch=b").glob("a*"))) == 1
    lost = attempts.write_attempt(rows, root, "b", "first")
    assert not attempts.commit(spark, root, "b", "first", lost) and attempts.committed(spark, root, "first").count() == 10
    assert attempts.purge(spark, root) == [f"first/b/{lost}"] and attempts.purge(spark, root, "none") == []


def test_a_rejected_batch_leaves_no_rows(spark, tmp_path):
    def rejects(held):
        raise attempts.Rejected

    stages = [("first", lambda _: spark.range(3)), ("second", rejects)]
    assert [attempts.run_batch(spark, str(tmp_path), "bad", stages) for _ in range(2)] == ["REJECTED"] * 2
    assert attempts.run_batch(spark, str(tmp_path), "good", stages[:1]) == "SUCCESS"
    assert {r.batch for r in attempts.committed(spark, str(tmp_path), "first").collect()} == {"good"}
    assert attempts.manifest(spark, str(tmp_path / "none")).count() == 0


def test_rules_in_a_stream(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "out")
    rule = [Rule("few", "RANGE", "id", "QUARANTINE", {"max": 5}), Rule("key", "NOT_NULL", "k", "REJECT_FILE")]
    frame = spark.range(9).withColumn("k", F.lit("x"))
    call = lambda: kpis.apply_rules(spark.readStream.schema(frame.schema).parquet(str(source)), rule, root, "s")
    frame.where("id < 4").write.parquet(str(source))
    call()
    frame.where("id >= 4").write.mode("append").parquet(str(source))
    call()
    call()
    ids = lambda stage: sorted(r.id for r in attempts.committed(spark, root, stage).collect())
    assert (ids("silver"), ids("quarantine")) == ([0, 1, 2, 3, 4, 5], [6, 7, 8])
    frame.limit(2).withColumn("k", F.lit(None).cast("string")).write.mode("append").parquet(str(source))
    call()
    assert ids("silver") == [0, 1, 2, 3, 4, 5] and attempts.manifest(spark, root).where("status = 'REJECTED'").count() == 1


PAYLOAD = "p struct<a:array<map<string,array<struct<note:string,n:int>>>>,b:map<string,string>,`Home_Address`:string>"


def test_nested_values_are_scrubbed_and_searched(spark):
    rows = [(([{"k": [("call 555-123-4567", 1), (None, 2)], "x@y.org": []}], {"z": "123-45-6789"}, None),), (([None, {"ssn_hash": None}], None, "x"),), (None,)]
    frame = spark.createDataFrame(rows, PAYLOAD)
    kind = frame.schema["p"].dataType
    got = [r[0] for r in frame.select(nested.scrub_nested(F.col("p"), kind)).collect()]
    assert got[0].a == [{"k": [("call [REDACTED_PHONE]", 1), (None, 2)], "[REDACTED_EMAIL]": []}] and got[0].b == {"z": "[REDACTED_SSN]"} and got[2] is None
    assert [r[0] for r in frame.select(nested.forbidden_path(F.col("p"), kind)).collect()] == ["Home_Address", "Home_Address", None]
    deep = spark.createDataFrame([([{"ok": [{"user_phone": "1"}]}],), ([{"ssn_hash": [{"DOB": "1"}]}],), ([{"fine": []}, None],), ([],), (None,)], "a array<map<string,array<map<string,string>>>>")
    assert [r[0] for r in deep.select(nested.forbidden_path(F.col("a"), deep.schema["a"].dataType, "root")).collect()] == ["root.ok.user_phone", "root.ssn_hash.DOB", None, None, None]


def test_notes(spark):
    texts = {"SSN 123-45-6789": "SSN", "born: 3/4/1990": "DOB", "on 2024-01-31": "DATE_YYYYMMDD", "call (415) 555-2671": "PHONE", "a@b.org": "EMAIL", "a@own.test": None, "mrn: AB123": "MRN_TAG", "checked against source": None, "": None, None: None}
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in frame.select(nested.note_problem(F.col("t"), "own.test")).collect()] == list(texts.values())
    ids = [r[0] for r in spark.range(3).select(nested.synthetic_row_id(F.col("id"))).collect()]
    assert len(set(ids)) == 3 and all(len(i) == len("row_0_") + 16 for i in ids)


def test_drift_pages_and_acknowledgements(spark):
    reports = spark.createDataFrame([(k, day(k // 2), "BREAKING" if k == 4 else "NON_BREAKING", "DETECTED") for k in range(7)], "report_id long, created_at timestamp, severity string, status string")
    page = operations.drift_reports(reports, 3, 1, severity="NON_BREAKING").collect()
    assert [(r.report_id, r.total) for r in page] == [(5, 6), (2, 6), (3, 6)] and operations.drift_reports(reports, 3, 50).count() == 0
    asked = spark.createDataFrame([(4, "a", "n"), (5, "b", "n"), (5, "a", "m"), (99, "a", "n")], "report_id long, actor string, notes string")
    got = {r.report_id: (r.status, r.acknowledged_by, r.notes, r.refused) for r in operations.acknowledge_drift(reports, asked, "2024-02-01").collect()}
    assert got[4] == ("DETECTED", None, None, True) and got[5] == ("ACKNOWLEDGED", "a", "m", False) and got[0] == ("DETECTED", None, None, False)
