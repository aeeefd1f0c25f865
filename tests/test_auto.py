"""Formats told by a column, CSV cells with quotes, and profiles of mixed texts."""

from feedloom.sources import auto, files
from pyspark.sql import functions as F

TEXTS = {
    ' <?xml version="1.0"?><a/>': "XML", "<a>1</a>": "XML", "<a": "CSV", '{"resourceType": "Patient"}': "FHIR", "[1]": "JSON", '{"a": 1}': "JSON", '{"a": 1}\n\n{"b": 2}': "NDJSON", '{"a": 1}\nx': "CSV", "a,b\n1,2": "CSV", "": "CSV", '"s"': "CSV", "{bad": "CSV",
}


def test_formats(spark):
    frame = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "t string")
    assert [r[0] for r in frame.select(auto.format_of(F.col("t"))).collect()] == [*TEXTS.values(), "CSV"]
    plain = [t for t in TEXTS if t and t not in ('"s"', "<a")]
    assert [files.detect_format(t) for t in plain] == [TEXTS[t] for t in plain]


def test_csv_cells(spark):
    texts = ['﻿a, b \r\n1,"x, ""y"""\r\n\r\n2\n"3\n4",z,extra\n', "a,b", "", None, 'c\n"' + "long " * 20000 + '"']
    got = auto.csv_cells(spark.createDataFrame([(t, 1) for t in texts], "t string, path int"), "t").collect()
    assert [(r.path, r.value and r.value[:8], r.empty) for r in got] == [("a", "1", 0), ("b", 'x, "y"', 0), ("a", "2", 0), ("b", None, 1), ("a", "3\n4", 0), ("b", "z", 0), ("c", "long lon", 0)]
    assert len(got[-1].value) == 5 * 20000 - 1


def test_profiles_of_mixed_texts(spark):
    texts = ["k,v\n1,\n2,x\n", '{"k": 1}\n{"k": 2, "v": null}', '[{"k": "a"}]', "<r><k>7</k></r>", "<broken>", '{"resourceType": "Bundle", "entry": [{"resource": {"id": 5}}]}', None]
    got = {(r.format, r.path): (r.total, r.nulls, r.inferred) for r in auto.profile_auto(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()}
    assert got == {("CSV", "k"): (2, 0, "STRING"), ("CSV", "v"): (2, 1, "STRING"), ("NDJSON", "k"): (2, 0, "STRING"), ("NDJSON", "v"): (2, 2, "STRING"), ("JSON", "k"): (1, 0, "STRING"), ("XML", "r.k"): (1, 0, "INTEGER"), ("FHIR", "id"): (1, 0, "INTEGER")}
    assert auto.profile_auto(spark.createDataFrame([], "t string"), "t").count() == 0
