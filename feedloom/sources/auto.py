"""Profiles of files whose format is not known: each text's format is told by a column, and each format has its cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.lineage import cut, spread
from feedloom.functions.text import blank_to_null, trim_ws
from feedloom.operators.profile import profile_paths
from feedloom.operators.variants import cells, fields, parse
from feedloom.sources.files import xml_cells

#: A record's text up to a line end outside quotes, and a field's up to a comma outside quotes.
_RECORD = r'(?:[^"\r\n]++|"(?:[^"]++|"")*+"?)++'
_FIELD = r'(?:^|,)("(?:[^"]++|"")*+"?[^,]*|[^,]*)'


def format_of(text: Column) -> Column:
    """CSV, XML, JSON, FHIR or NDJSON: by the tags at both ends, as one JSON document (FHIR if it has a resourceType), by its first five lines; all else, also null, is CSV."""
    t = trim_ws(F.coalesce(text, F.lit("")))
    xml = t.startswith("<?xml") | (t.startswith("<") & F.left(t, F.lit(100)).contains(">") & t.endswith(">"))
    parsed = F.when(t.startswith("{") | t.startswith("["), parse(t))
    lines = F.filter(F.transform(F.slice(F.split(t, "\n"), 1, 5), trim_ws), lambda x: x != "")
    objects = (F.size(lines) > 0) & F.forall(lines, lambda x: x.startswith("{") & x.endswith("}") & parse(x).isNotNull())
    return F.when(xml, "XML").when(F.map_contains_key(fields(parsed), "resourceType"), "FHIR").when(parsed.isNotNull(), "JSON").when(objects, "NDJSON").otherwise("CSV")


def csv_cells(frame: DataFrame, text: str) -> DataFrame:
    """The cells of CSV texts as profile.profile_paths takes them: a value for each row and column of the header, trimmed, empty where it is blank or missing.

    Quotes may hold commas, line ends and doubled quotes; blank lines are no rows, cells beyond the header go. A text without rows gives nothing.
    """

    def split(record: Column) -> Column:
        quoted = lambda x: F.replace(F.regexp_replace(x, '^"|"$', ""), F.lit('""'), F.lit('"'))
        return F.transform(F.regexp_extract_all(record, F.lit(_FIELD), 1), lambda x: F.when(x.startswith('"'), quoted(x)).otherwise(x))

    rows = F.regexp_extract_all(F.regexp_replace(F.col(text), "^﻿", ""), F.lit(_RECORD), 0)
    parts = frame.select(F.transform(split(F.get(rows, 0)), lambda x: F.trim(x)).alias("header"), F.explode(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1)))).alias("row"))
    parts = parts.where(F.trim("row") != "").select("header", split(F.col("row")).alias("row"))
    held = parts.select("row", F.posexplode("header").alias("at", "path")).select("path", blank_to_null(F.get("row", F.col("at"))).alias("value"))
    none = F.lit(None).cast("long")
    return held.select("path", "value", F.lit(1).cast("long").alias("counted"), F.col("value").isNull().cast("long").alias("empty"), none.alias("length"), F.lit(0).cast("long").alias("records"))


def profile_auto(frame: DataFrame, text: str, distinct_cap: int = 10_000) -> DataFrame:
    """(format, and what profile_paths() gives) for texts of any formats in one frame: the texts of a format are profiled together.

    Each line of an NDJSON text is a record. Texts that are broken give nothing, like no texts.
    """
    told = cut(spread(frame.select(F.col(text).alias("text"))).withColumn("format", format_of(F.col("text"))), "told")  # read once a format
    lines = F.concat(F.lit("["), F.array_join(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), ","), F.lit("]"))
    of = {
        "CSV": lambda f: csv_cells(f, "text"), "XML": lambda f: xml_cells(f, "text"), "JSON": lambda f: cells(f, "text"), "FHIR": lambda f: cells(f, "text"),
        "NDJSON": lambda f: cells(f.select(lines.alias("text")), "text"),
    }
    parts = [profile_paths(make(told.where(F.col("format") == name)), name not in ("CSV", "XML"), distinct_cap).select(F.lit(name).alias("format"), "*") for name, make in of.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
