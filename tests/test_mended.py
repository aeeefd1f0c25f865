"""Numbers of many digits, patterns of either dialect, texts without personal data, landing by batch."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from feedloom.functions import text
from feedloom.operators import rules, transforms
from feedloom.operators.rules import Rule
from feedloom.plans import catalogue
from feedloom.sources import files

BIG = "1234567890123456789012345"


@pytest.mark.parametrize(("operator", "rows"), [("GREATER_THAN", [(BIG, "5", False), (BIG, BIG, True), (BIG, BIG[:-1] + "4", False), ("5", BIG, True), ("5.5", "5.4", False), ("x", "5", True)]), ("LTE", [(BIG, BIG, False), (BIG[:-1] + "6", BIG, True), ("1e50", "1e49", True), ("-" + BIG, "3", False)])])
def test_comparisons_of_many_digits(spark, operator, rows):
    rule = Rule("r", "CROSS_FIELD", "a", config={"compare_field": "b", "operator": operator})
    frame = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert all(r[0] == r[1] for r in frame.select(rules.violated(rule), "want").collect())


def test_ranges_of_many_digits(spark):
    rule = Rule("r", "RANGE", "a", config={"min": 5, "max": int(BIG)})
    frame = spark.createDataFrame([(BIG,), (BIG[:-1] + "6",), ("4.9",), ("1e40",), (None,)], "a string")
    assert [r[0] for r in frame.select(rules.violated(rule)).collect()] == [False, True, True, True, False]


def test_named_groups_and_patterns_that_check_nothing(spark):
    rule = Rule("r", "REGEX", "a", config={"pattern": r"^(?P<x>[ab])-(?P=x)$"})
    frame = spark.createDataFrame([("a-a",), ("a-b",)], "a string")
    assert [r[0] for r in frame.select(rules.violated(rule)).collect()] == [False, True] and rules.problems(rule) == []
    assert rules.problems(Rule("r", "REGEX", "a", config={"pattern": r"(a)?(?(1)b|c)"}))


def test_texts_are_marked_the_same_with_and_without_the_first_look(spark):
    rng = random.Random(1)
    pieces = ["MRN: abcdef", "mrn#ABCDE", "patient name John Smith", "Member: Ada Love", "a@b.org", "12 Old Road", "٣٤٥-٦٧-٨٩٠١", "123456789", "plain words", "PATIENTID abcd", "zip 12345-6789", "MedRec abcd", "Σ ſ K"]
    rows = [(" ".join(rng.sample(pieces, rng.randrange(0, 4))),) for _ in range(300)] + [(None,), ("",)]
    frame = spark.createDataFrame(rows, "t string")
    whole = frame.select(F.nullif(text.replace_all(F.col("t"), text.OPERATIONAL_PATTERNS), F.lit("")), text.replace_all(F.coalesce("t", F.lit("")), text.PERSONAL_PATTERNS))
    assert frame.select(text.redact(F.col("t")), text.scrub(F.col("t"))).collect() == whole.collect()


def test_landing_by_batch_and_the_first_silver_table(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.csv").write_bytes(name.encode())
        assert [r.verified for r in files.land_bronze(spark, str(tmp_path / name), str(tmp_path / "bronze"), name).collect()] == [True]
    assert sorted((r.file, r._batch_id) for r in spark.read.parquet(str(tmp_path / "bronze")).collect()) == [("a.csv", "a"), ("b.csv", "b")]
    for folder, batch in (("first", "b1"), ("second", "b2")):
        files.write_silver(spark.createDataFrame([(1, batch)], "k long, _batch_id string"), str(tmp_path / folder))
    assert files.rescan_silver(spark, [str(tmp_path / "none"), str(tmp_path / "second"), str(tmp_path / "first")], "b2").count() == 1
    with pytest.raises(ValueError):
        files.rescan_silver(spark, [str(tmp_path / "first"), str(tmp_path / "second")], "b2")


def test_arrays_behind_a_wildcard_are_spread_and_unmapped_values_fail(spark):
    rows = [(1, "F", [([1, 2], "x"), ([3], "y"), (None, "z")]), (2, "P", [([], None)]), (3, None, None)]
    frame = spark.createDataFrame(rows, "k long, s string, a array<struct<b:array<long>,c:string>>")
    lines = [("k", "DIRECT", ["k"], {}), ("s", "VALUE_MAP", ["s"], {"dictionary": {"F": "f"}, "on_unmapped": "ERROR"}), ("b", "PATH_EXTRACT", ["a"], {"path": "[*].b"}), ("c", "PATH_EXTRACT", ["a"], {"path": "[*].c"})]
    mapped, failed = transforms.split_mapping(frame, lines)
    assert sorted(map(tuple, mapped.collect()), key=repr) == [(1, "f", [1, 2, 3], ["x", "y", "z"]), (3, None, None, None)]
    assert [(r.k, r._failure.field, r._failure.value, r._failure.rule) for r in failed.collect()] == [(2, "s", "P", "s")]
    assert transforms.apply_mapping(frame.where("k = 2"), lines).first().b is None and transforms.split_mapping(frame.limit(0), lines)[1].count() == 0


def test_documents_are_redacted_as_their_sql_does_beside_letters_beyond_ascii(spark, tmp_path):
    rng = random.Random(2)
    pieces = ["\u00e9mrnthanon", "mrn abcd\u00e9f", "MRN:abcdefg\u00f1", "mrn\u00a0abcde", "mrn\x0babcde", "\u00e9555-123-4567", "5551234567\u00df", "\u0663123456789", "123456789", "\u00e9123456789\u00e9", "_123456789", "\u0663\u0664\u0665-67-8901", "a@b.org", "\u00e9@b.org", "078-05-1120", "\n", "\u0085", "plain", "mrn"]
    texts = ["".join(rng.choice(["", " ", "_", "\u00e9"]) + p for p in rng.choices(pieces, k=rng.randrange(1, 6))) for _ in range(2000)] + ["", " ", None, *pieces]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = dict(con.execute(catalogue.ORACLE_SQL["redact_phi"]).fetchall())
    got = {r.doc_id: r.redacted for r in catalogue.QUERIES["redact_phi"](spark, str(tmp_path)).collect()}
    assert [texts[k] for k in want if got[k] != want[k]] == [] and len(got) == len(texts)
