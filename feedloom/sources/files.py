"""Files: delimited and nested sources, format detection, registration, and the row-numbered reader."""

from __future__ import annotations

import csv
import io
import json
import re
from collections import Counter
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedloom.functions.lineage import spread
from feedloom.functions.text import glob_to_regex
from feedloom.operators.variants import cells as json_cells

MAX_BYTES = 100 * 1024 * 1024


def read_delimited(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """All columns as text; short rows have nulls, extra cells go; quotes double; names are trimmed and lower-case."""
    frame = spark.read.csv(path, header=True, sep=delimiter, quote='"', escape='"', multiLine=True, mode="PERMISSIVE", enforceSchema=False)
    return frame.toDF(*[c.strip().lower() for c in frame.columns])


def read_numbered(spark: SparkSession, path: str, columns: list[str], delimiter: str = ",") -> DataFrame:
    """(file, _source_row_num, _raw, columns): rows numbered in file order, blank lines counted. One file is one task's work.

    For landing files, whose size is capped: a row number needs the rows before it. Larger inputs come in many files.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = list(csv.reader(io.StringIO(bytes(content).decode("utf-8-sig", "replace"), newline=""), delimiter=delimiter))
                at = {name.strip().lower(): k for k, name in enumerate(rows[0])} if rows else {}
                out = []
                for number, row in enumerate(rows[1:], 1):
                    cells = [row[at[c]].strip() if c in at and at[c] < len(row) else None for c in columns]
                    out.append((file, number, delimiter.join(row), *cells))
                yield pd.DataFrame(out, columns=["file", "_source_row_num", "_raw", *columns])

    schema = "file string, _source_row_num long, _raw string, " + ", ".join(f"`{c}` string" for c in columns)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, schema)


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """(file, value variant, bad): one row for each line that is not blank."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), "value").where(F.trim("value") != "")
    return lines.select("file", F.try_parse_json("value").alias("value"), F.try_parse_json("value").isNull().alias("bad"))


def fhir_resources(bundles: DataFrame, text: str) -> DataFrame:
    """Each entry's resource of bundles given as JSON text, or the entry itself, as JSON text."""
    entries = F.from_json(F.get_json_object(text, "$.entry"), "array<string>")
    return bundles.select(F.explode(entries).alias("entry")).select(F.coalesce(F.get_json_object("entry", "$.resource"), F.col("entry")).alias("resource"))


def xml_paths(frame: DataFrame, text: str) -> DataFrame:
    """(path, value): texts of the leaves and attributes (path@name) of XML texts, names without their namespace.

    A child whose name its siblings share stands under parent.name[*]; empty leaves are left out. A null or broken text gives nothing.
    A document is read once into a row a node (parent, name, text); paths are put together when all siblings are known.
    """

    def nodes_of(content: str) -> tuple[list[list], Counter]:
        nodes: list[list] = []  # parent, name, attributes, text, leaf
        above, shared = [-1], Counter()

        def start(name: str, attributes: dict[str, str]) -> None:
            own = name.rpartition("}")[2]
            if above[-1] >= 0:
                nodes[above[-1]][4] = False
            shared[above[-1], own] += 1
            nodes.append([above[-1], own, {k.rpartition("}")[2]: v for k, v in attributes.items()}, [], True])
            above.append(len(nodes) - 1)

        parser = expat.ParserCreate(namespace_separator="}")
        parser.StartElementHandler, parser.EndElementHandler = start, lambda name: above.pop()
        parser.CharacterDataHandler = lambda data: nodes[above[-1]][3].append(data)
        parser.Parse(content, True)
        return nodes, shared

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple[str, str]] = []
            for content in pdf["text"].dropna():
                try:
                    nodes, shared = nodes_of(content)
                except expat.ExpatError:
                    continue
                paths: list[str] = []
                for parent, name, attributes, pieces, leaf in nodes:
                    lead = "" if parent < 0 else paths[parent] + "."
                    paths.append(f"{lead}{name}[*].{name}" if parent >= 0 and shared[parent, name] > 1 else f"{lead}{name}")
                    out += [(f"{paths[-1]}@{k}", v) for k, v in attributes.items()]
                    own = "".join(pieces).strip()
                    if leaf and own:
                        out.append((paths[-1], own))
            yield pd.DataFrame(out, columns=["path", "value"])

    return spread(frame.select(F.col(text).alias("text"))).mapInPandas(run, "path string, value string")


def xml_cells(frame: DataFrame, text: str) -> DataFrame:
    """The cells of XML texts as profile.profile_paths takes them; blank attributes are empty values."""
    shown = F.nullif(F.trim("value"), F.lit(""))
    return xml_paths(frame, text).select("path", shown.alias("value"), F.lit(1).cast("long").alias("counted"), shown.isNull().cast("long").alias("empty"), F.lit(None).cast("long").alias("length"), F.lit(0).cast("long").alias("records"))


def header_cells(header: Column, delimiter: str = ",") -> Column:
    """The cells of a header line, trimmed and in lower case: delimiters within quotes part nothing, doubled quotes are one."""
    part = re.escape(delimiter) + r'(?=(?:[^"]*"[^"]*")*[^"]*$)'
    unquoted = lambda x: F.replace(F.regexp_replace(F.trim(x), r'(?s)^"(.*)"$', "$1"), F.lit('""'), F.lit('"'))
    return F.transform(F.split(F.regexp_replace(header, "^\\uFEFF", ""), part, -1), lambda x: F.lower(F.trim(unquoted(x))))


def structure_error(header: Column, required: list[str], delimiter: str = ",") -> Column:
    """What is wrong with a file's first line: no header, or the first required column that it lacks, in any case; null if nothing is."""
    names = header_cells(header, delimiter)
    lacks = [F.when(~F.array_contains(names, name.strip().lower()), F.lit(f"Missing required column in header: '{name}'")) for name in required]
    return F.coalesce(F.when(F.coalesce(header, F.lit("")) == "", F.lit("File is empty or contains no header row")), *lacks)


def land_bronze(spark: SparkSession, path: str, to: str, batch: str | None = None) -> DataFrame:
    """(file, bytes, sha256, verified) of the files at path after their bytes were written to a table at `to`: verified is false where what was written reads back otherwise.

    Files of no bytes are left out: registration refuses them, and Spark's reader does not list them. With a batch its files are a partition of the table, which
    leaves other batches' as they are, and a file that reads back otherwise is an error.
    """
    to = to if batch is None else f"{to}/_batch_id={batch}"
    read = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content", F.sha2("content", 256).alias("sha256"))
    read.write.mode("overwrite").parquet(to)
    held = spark.read.parquet(to)
    landed = held.select("file", F.octet_length("content").cast("long").alias("bytes"), "sha256", (F.sha2("content", 256) == F.col("sha256")).alias("verified"))
    if batch is not None and landed.where("not verified").take(1):
        raise ValueError(f"files of batch {batch} did not land as they were")
    return landed


def rescan_silver(spark: SparkSession, paths: list[str], batch: str) -> DataFrame:
    """A batch's valid rows from the first of the silver tables that exists; an error if none does or it has none of the batch."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            rows = spark.read.parquet(path).where(F.col("_batch_id").cast("string") == batch)  # the partition's filter: other batches are not read
            if rows.isEmpty():
                break
            return rows
    raise ValueError(f"no silver rows of batch {batch}")


def recovered(valid: DataFrame, recovery_batch: str, source_id: str) -> DataFrame:
    """Rows mended in a recovery, with the recovery's batch and the quarantined record they come from."""
    return valid.withColumns({"_recovery_batch_id": F.lit(recovery_batch), "_quarantine_source_id": F.col(source_id).cast("string")})


def detect_format(head: str) -> str:
    """CSV, XML, JSON, FHIR or NDJSON by the head of a file."""
    text = head.strip()
    if text.startswith("<?xml") or (text.startswith("<") and text.endswith(">")):
        return "XML"
    try:
        found = json.loads(text)
        return "FHIR" if isinstance(found, dict) and "resourceType" in found else "JSON" if isinstance(found, (dict, list)) else "CSV"
    except ValueError:
        lines = [x for x in text.splitlines() if x.strip()][:5]
    try:
        return "NDJSON" if lines and all(isinstance(json.loads(x), dict) for x in lines) else "CSV"
    except ValueError:
        return "CSV"


def register(files: DataFrame, known: DataFrame, feeds: list[tuple[str, str]], order: list[str]) -> DataFrame:
    """files (name, size, fingerprint) with feed and status, gates in order: feed by name, duplicate, empty, too large, accepted.

    known: fingerprints seen before. Of equal fingerprints the first by `order` counts.
    """
    feed = F.coalesce(*[F.when(F.col("name").rlike(glob_to_regex(pattern)), F.lit(feed)) for feed, pattern in feeds])
    seen = known.select("fingerprint").distinct().withColumn("_seen", F.lit(True))
    place = F.row_number().over(Window.partitionBy("fingerprint").orderBy(*order))
    status: Column = F.when(F.col("feed").isNull(), "NO_FEED").when(F.col("_seen") | (F.col("_place") > 1), "DUPLICATE").when(F.col("size") == 0, "EMPTY").when(F.col("size") > MAX_BYTES, "TOO_LARGE").otherwise("ACCEPTED")
    return files.withColumns({"feed": feed, "_place": place}).join(seen, "fingerprint", "left").withColumn("status", status).drop("_seen", "_place")


def write_silver(valid: DataFrame, path: str) -> None:
    """Valid rows with their lineage, by batch; writing a batch again replaces it."""
    valid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch_id").parquet(path)
