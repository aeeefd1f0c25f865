"""Edge cases of the operational joins, nested cells and file sinks: nulls, ties, repeated rows, empty tables, broken texts."""

import hashlib
import hmac
import unicodedata

import pytest
from pyspark.sql import functions as F

from feedloom.functions import text
from feedloom.operators import operations, profile, rules
from feedloom.operators.rules import Rule
from feedloom.sources import files


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_json_cells(spark):
    texts = ['[{"a": [1, null, "x"], "b": {}}, {"a": []}, 5]', '{"meta": 1, "items": [{"a": [{"c": true}]}]}', '{"resourceType": "Bundle", "entry": [{"resource": {"b": " "}}, {"z": 1}]}', "[1, 2]", "broken", None, "{}"]
    frame = spark.createDataFrame([(t, "x") for t in texts], "t string, path string")
    got = {r.path: r for r in profile.profile_paths(files.json_cells(frame, "t")).collect()}
    assert sorted(got) == ["a[*]", "a[*].c", "b", "value", "z"]
    records = 2 + 1 + 2 + 2 + 1
    array = got["a[*]"]
    assert (array.total, array.nulls, array.min_length, array.max_length, array.is_array) == (max(records, 3 + 3), 1 + 1 + (records - 6), 0, 3, True)
    assert array.distinct == 3  # 1, x, and None as the array shows it
    assert (got["b"].total, got["b"].nulls, got["b"].inferred) == (records, records, "STRING")
    assert (got["a[*].c"].inferred, got["a[*].c"].depth, got["value"].distinct) == ("BOOLEAN", 2, 2)
    assert profile.profile_paths(files.json_cells(frame.where("false"), "t")).count() == 0


def test_xml_cells(spark):
    frame = spark.createDataFrame([('<n:a xmlns:n="u" k=" "><b>x</b><b>y</b><c/></n:a>',), ("<broken",), (None,)], "t string")
    got = {r.path: r for r in profile.profile_paths(files.xml_cells(frame, "t"), padded=False).collect()}
    assert {p: (r.total, r.nulls) for p, r in got.items()} == {"a@k": (1, 1), "a.b[*].b": (2, 0)}


def test_structure_error(spark):
    frame = spark.createDataFrame([(1, "Id,Name "), (2, '﻿"NAME",id,x'), (3, "id"), (4, ""), (5, None)], "n int, header string")
    got = dict(rows(frame.select("n", files.structure_error(F.col("header"), ["name"]))))
    assert got == {1: None, 2: None, 3: "Missing required column in header: 'name'", 4: "File is empty or contains no header row", 5: "File is empty or contains no header row"}


def test_bronze_and_silver(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_bytes(b"x\n1\n")
    (tmp_path / "in" / "b.csv").write_bytes(b"")
    got = rows(files.land_bronze(spark, str(tmp_path / "in"), str(tmp_path / "bronze")))
    assert got == [("a.csv", 4, hashlib.sha256(b"x\n1\n").hexdigest(), True)]
    frame = spark.createDataFrame([(1, "b1"), (2, "b2")], "k long, _batch_id string")
    files.write_silver(files.recovered(frame, "r1", "k"), str(tmp_path / "silver"))
    assert [(r.k, r._recovery_batch_id, r._quarantine_source_id) for r in files.rescan_silver(spark, [str(tmp_path / "none"), str(tmp_path / "silver")], "b2").collect()] == [(2, "r1", "2")]
    with pytest.raises(ValueError):
        files.rescan_silver(spark, [str(tmp_path / "silver")], "b3")


def test_keyed_append_and_waivers(spark):
    held = spark.createDataFrame([(1, "x"), (None, "y")], "k long, v string")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "c")], "k long, v string")
    assert rows(operations.keyed_append(held, new, ["k"])) == [(2, "b")]
    w = spark.createDataFrame([("b", "w1", 1, "c1", "T"), ("b", "w2", 2, None, "T"), ("b", "w3", 3, "", None)], "batch_id string, waiver_id string, at int, control_id string, control_type string")
    assert rows(operations.waiver_map(w, "at")) == [("b", "T", "w2"), ("b", "c1", "w1")]


def test_eligibility_without_rows(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    batches = spark.createDataFrame([(1, "SUCCESS", None), (2, None, 5)], "batch_id long, status string, model_version_id long")
    got = operations.ods_eligibility(batches, none("batch_id long, status string"), none("model_version_id long, status string"), none("batch_id long, completed_at int, status string"), none("batch_id long, balanced boolean, status string"), none("batch_id long, action string"))
    assert {r.batch_id: (r.identity_status, r.reasons) for r in got.collect()} == {1: ("NOT_RUN", ["MODEL_NOT_PUBLISHED", "IDENTITY_STATUS"]), 2: ("NOT_RUN", ["BATCH_STATUS", "MODEL_NOT_PUBLISHED", "IDENTITY_STATUS"])}


def test_of_runs_that_end_at_once_the_first_by_their_order_counts(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    batches = spark.createDataFrame([(k, "SUCCESS", 1) for k in range(6)], "batch_id long, status string, model_version_id long")
    made = [(k, 2, "FAILED" if (k + n) % 3 == 0 else "SUCCESS", n) for k in range(6) for n in range(3)] + [(0, 1, "OTHER", -1)]
    for order, want in ((["n"], {k: "FAILED" if k % 3 == 0 else "SUCCESS" for k in range(6)}), (None, dict.fromkeys(range(6), "FAILED"))):
        for runs in (made, made[::-1]):
            got = operations.ods_eligibility(batches, none("batch_id long, status string"), none("model_version_id long, status string"), spark.createDataFrame(runs, "batch_id long, completed_at int, status string, n int"), none("batch_id long, balanced boolean, status string"), none("batch_id long, action string"), order)
            assert {r.batch_id: r.identity_status for r in got.collect()} == want


def test_source_tokens(spark):
    pairs = [("ｓｙｓ  a", "００7 "), ("s:x", "1"), (None, "1"), ("s", " "), ("s", "a::b"), ("s", "0012")]
    token, error = text.canonical_source(b"k", F.col("s"), F.col("i"))
    got = spark.createDataFrame(pairs, "s string, i string").select(token.alias("t"), error.alias("e")).collect()
    sign = lambda s: hmac.new(b"k", s.encode(), hashlib.sha256).hexdigest()
    assert unicodedata.normalize("NFKC", "ｓｙｓ") == "sys"
    assert [tuple(r) for r in got] == [(sign("SYS A::007"), None), (None, "COLON_IN_SYSTEM"), (None, "EMPTY_SYSTEM"), (None, "EMPTY_IDENTIFIER"), (None, "DELIMITER_IN_IDENTIFIER"), (sign("S::0012"), None)]


def test_trials(spark):
    frame = spark.createDataFrame([(1, "5"), (2, None), (3, "50")], "k long, v string")
    own = [Rule("r", "RANGE", "v", "QUARANTINE", {"max": 10}), Rule("n", "NOT_NULL", "v", "REJECT_FILE")]
    counts, failures = rules.rule_test(frame, own[0], ["k"])
    assert tuple(counts.first())[0] == 3 and (3, "v", "VALUE_OUT_OF_RANGE") in rows(failures)
    evidence = rules.sandbox(frame, own, ["k"])[0].first()
    assert (evidence.total, evidence.passed, evidence.quarantined, evidence.reject_file, evidence.status) == (3, 1, 2, True, "BALANCED")
    empty = frame.where("false")
    assert rules.rule_test(empty, own[0], ["k"])[0].first().pass_rate == 0.0 and rules.sandbox(empty, own, ["k"])[0].first().pass_rate == 100.0


def test_lists(spark):
    bindings = spark.createDataFrame([(1, 1, 2, True), (1, 2, 1, True), (2, 3, 1, True), (3, 1, 1, False)], "fingerprint_id int, playbook_id int, priority int, is_active boolean")
    playbooks = spark.createDataFrame([(1, "A", 11, 1, "APPROVED"), (2, "A", 12, 2, "APPROVED"), (3, "B", 13, 1, "APPROVED"), (4, "B", 14, 0, "DRAFT")], "playbook_id int, category string, current_version_id int, created_at int, status string")
    versions = spark.createDataFrame([(11, "APPROVED"), (12, "APPROVED"), (13, "DRAFT")], "version_id int, status string")
    prints = spark.createDataFrame([(1, "A"), (2, "B"), (3, "A"), (4, None)], "fingerprint_id int, category string")
    assert rows(operations.playbook_for(prints, bindings, playbooks, versions)) == [(1, 12), (2, None), (3, 11), (4, None)]
    scored = spark.createDataFrame([(1, k, k % 3) for k in range(15)], "record_id int, master_id int, score int")
    best = operations.top_candidates(scored).first().candidates
    assert [c.person for c in best] == [2, 5, 8, 11, 14, 1, 4, 7, 10, 13]
    order = spark.createDataFrame([("2", 1), ("x", 2), ("10", 3)], "_source_row_num string, k int")
    assert [r.k for r in operations.in_file_order(order).collect()] == [2, 1, 3]
    title, about = operations.alert_text(F.lit("NEW"), F.lit(None).cast("string"), F.lit("p"), F.lit("f" * 300))
    got = spark.range(1).select(title.alias("t"), about.alias("a")).first()
    assert len(got.t) == 255 and got.a.endswith("during ingestion pipeline: p.")


def test_distinct_values_without_a_cap(spark):
    cells = spark.range(12_000).selectExpr("'a' AS path", "CAST(id AS STRING) AS value", "1L AS counted", "0L AS empty", "CAST(null AS BIGINT) AS length", "1L AS records")
    assert profile.profile_paths(cells, distinct_cap=None).first().distinct == 12_000 and profile.profile_paths(cells).first().distinct == 10_000
