"""Paths over Variant: documents of unlike shape in one frame."""

import json

import pytest
from pyspark.sql import functions as F

from feedloom.operators import variants
from feedloom.sources import files

DOCS = [
    {"entry": [{"resource": {"id": "r1", "type": "P"}}, {"resource": {"id": "r2"}}, {"resource": {"id": ["r3", "r4"]}}, {"resource": {}}, 7]},
    {"Entry": [{"resource": {"id": "x"}}], "telecom": [{"system": "email", "value": "a@b"}, {"system": "phone", "value": "555"}, {"system": "phone", "value": "556"}]},
    {"entry": {"resource": 5}, "telecom": [{"system": "phone", "value": 1.0}, {"value": None}, "phone"], "patient": {"Name": {"family": "S", "given": None}}},
    {"patient": {"name": {"family": "T"}, "NAME": {"family": "U"}}, "flags": [{"on": True, "v": 1}, {"on": False, "v": 2}, {"v": 3}]},
    [1, 2],
    "text",
    None,
]

CASES = [
    ("entry[0].resource.id", None, ["r1", None, None, None, None, None, None]),
    ("entry[9].resource.id", "none", ["none"] * 7),
    ("entry[*].resource.id", None, [["r1", "r2", "r3", "r4"], None, None, None, None, None, None]),
    ("entry[*].resource.type", None, [["P"], None, None, None, None, None, None]),
    ("telecom[?(@.system=='phone')].value", None, [None, ["555", "556"], 1, None, None, None, None]),
    ("telecom[?(@.system=='email')].value", None, [None, "a@b", None, None, None, None, None]),
    ("telecom[?(@.system!='phone')].system", None, [None, "email", None, None, None, None, None]),
    ("telecom[?(@.value=='None')]", None, [None, None, {"value": None}, None, None, None, None]),
    ("flags[?(@.on=='True')].v", None, [None, None, None, 1, None, None, None]),
    ("flags[?(@.on=='None')].v", None, [None, None, None, 3, None, None, None]),
    ("PATIENT.name.FAMILY", None, [None, None, "S", "T", None, None, None]),
    ("patient.nAme.family", "N/A", ["N/A", "N/A", "S", "T", "N/A", "N/A", "N/A"]),
    ("patient.Name.given", "N/A", ["N/A"] * 7),
    ("[1]", None, [None, None, None, None, 2, None, None]),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, None if d is None else json.dumps(d)) for k, d in enumerate(DOCS)] + [(7, "{bad")], "n int, t string").select("n", "t", F.try_parse_json("t").alias("v"))


def values(frame, column):
    return [None if r[0] is None else json.loads(r[0]) for r in frame.where("n < 7").orderBy("n").select(F.to_json(column)).collect()]


def test_paths(docs):
    found = docs.select("n", *[variants.find(F.col("v"), path, default).alias(f"c{k}") for k, (path, default, _) in enumerate(CASES)])
    for k, (path, _, want) in enumerate(CASES):
        assert values(found, F.col(f"c{k}")) == want, path


def test_first_of_one_or_all(docs):
    assert values(docs, variants.first(variants.find(F.col("v"), "telecom[?(@.system=='phone')].value"))) == [None, "555", 1, None, None, None, None]


def test_flatten_by_the_type_found(spark):
    frame = spark.createDataFrame([(json.dumps(d),) for d in ({"patient": {"name": {"first": "J", "last": "D"}, "age": 42}, "status": "a", "l": [{"x": 1}], "e": {}}, {"patient": "plain", "a_b": 1, "a": {"b": 2}})], "t string").select(F.parse_json("t").alias("v"))
    got = [{k: json.loads(v) for k, v in r[0].items()} for r in frame.select(F.transform_values(variants.flatten(F.col("v")), lambda k, v: F.to_json(v))).collect()]
    assert got == [{"patient_name_first": "J", "patient_name_last": "D", "patient_age": 42, "status": "a", "l": [{"x": 1}]}, {"patient": "plain", "a_b": 1}]
    flat = variants.flatten(F.col("v"), prefix="p", separator=".", max_depth=2)
    got = [{k: json.loads(v) for k, v in r[0].items()} for r in frame.select(F.transform_values(flat, lambda k, v: F.to_json(v))).collect()]
    assert got[0] == {"p.patient.name": {"first": "J", "last": "D"}, "p.patient.age": 42, "p.status": "a", "p.l": [{"x": 1}]}


def test_array_map_unnest_and_explode(spark, docs):
    assert [r[0] for r in docs.where("n < 5").orderBy("n").select(variants.array_map(F.col("v"), "telecom", "value", " | ")).collect()] == [None, "a@b | 555 | 556", "1.0 | phone", None, None]
    assert [r[0] for r in docs.where("n < 3").orderBy("n").select(variants.array_map(F.col("v"), "telecom", "value", ",", "system", "phone")).collect()] == [None, "555,556", "1.0"]
    got = docs.where("n in (2, 4)").orderBy("n").select(F.map_keys(variants.unnest(F.col("v"), "patient.Name", ["family", "absent"]))).collect()
    assert [r[0] for r in got] == [["family"], []]
    rows = variants.explode_rows(docs.where("n in (1, 3)"), "v", "telecom", "item").select("n", "_explode_index", F.to_json("item").isNull()).collect()
    assert sorted(tuple(r) for r in rows) == [(1, 0, False), (1, 1, False), (1, 2, False), (3, 0, True)]
    assert variants.explode_rows(docs.where("n = 3"), "v", "telecom", "item", outer=False).count() == 0


def test_no_python_worker(docs):
    plan = files.json_cells(docs, "t")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_a_path_names_its_value_once(docs):
    plan = docs.select(variants.find(F.col("v"), "a.b.c[0].d").alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_variant_get") + plan.count("variant_get") < 40  # each step used to repeat all before it six times
    assert values(docs.where("n < 7"), variants.find(F.col("v"), "$['telecom'][1].system")) == [None, "phone", None, None, None, None, None]
