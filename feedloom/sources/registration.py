"""Registration of landed files: one ladder of gates over all files of a landing, and the batches that it opens."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.text import glob_to_regex
from feedloom.sources.files import MAX_BYTES, structure_error

STAGES = ("LANDING", "BRONZE", "SILVER_RAW")


@dataclass(frozen=True)
class Feed:
    """Where a feed's files are known by, what their header must hold, and where accepted ones go."""

    name: str
    pattern: str
    required: tuple[str, ...] = ()
    delimiter: str = ","
    folder: str = ""
    active: bool = True


def first_line(content: Column) -> Column:
    """The first record of a file's bytes without its byte order mark; line breaks within quotes belong to it."""
    return F.regexp_extract(F.regexp_replace(content.cast("string"), "^\\uFEFF", ""), r'^(?:[^"\r\n]++|"[^"]*+"?+)*+', 0)


def content_error(content: Column, required: tuple[str, ...], delimiter: str = ",") -> Column:
    """What is wrong with a delimited file's bytes: not UTF-8, no header, or a required column that it lacks; null if nothing is."""
    return F.when(~F.is_valid_utf8(content.cast("string")), F.lit("File encoding is invalid (expected UTF-8)")).otherwise(structure_error(first_line(content), list(required), delimiter))


def register_landing(files: DataFrame, known: DataFrame, feeds: list[Feed], order: list[str], max_bytes: int = MAX_BYTES) -> DataFrame:
    """(order, name, feed, size, fingerprint, status, reason, registered_as, path) of files (name, content, order).

    The gates in turn: the first active feed whose pattern takes the name; a fingerprint seen before, in `known` (fingerprint, name) or earlier in the
    landing; no bytes; more than max_bytes; structure. A file that no feed takes is not entered, so a later one of its bytes is no duplicate; a rejected
    one is entered. registered_as names the entry that a duplicate repeats, of several known ones the smallest name. Null content is no bytes, a null
    name belongs to no feed. Rows that are equal in `order` and name are one arrival and share its status. Bytes are read once, before any shuffle.
    """
    active = [f for f in feeds if f.active]
    content = F.coalesce("content", F.lit(b""))
    pick = lambda of: F.coalesce(*[F.when(F.col("name").rlike(glob_to_regex(f.pattern)), of(f)) for f in active], F.lit(None).cast("string"))
    read = files.select(
        *order, "name", pick(lambda f: F.lit(f.name)).alias("feed"), F.octet_length(content).cast("long").alias("size"), F.sha2(content, 256).alias("fingerprint"),
        pick(lambda f: F.lit(f.folder)).alias("_folder"), F.coalesce(*[F.when(F.col("name").rlike(glob_to_regex(f.pattern)), F.coalesce(content_error(content, f.required, f.delimiter), F.lit(""))) for f in active], F.lit("")).alias("_error"),
    )
    own = F.struct(F.lit(1).alias("now"), *order, "name")
    before = known.select("fingerprint", F.struct(F.lit(0).alias("now"), *[F.lit(None).cast(read.schema[c].dataType).alias(c) for c in order], F.col("name")).alias("_entry"))
    entries = read.where("feed is not null").select("fingerprint", own.alias("_entry")).union(before)
    first = entries.groupBy("fingerprint").agg(F.min("_entry").alias("_first"))  # summed up before the shuffle: many copies of a file are one row a task
    repeats = ~F.col("_first").eqNullSafe(own)
    reason = (
        F.when(F.col("feed").isNull(), F.concat(F.lit("No configured feed pattern matched filename '"), F.coalesce("name", F.lit("")), F.lit("'")))
        .when(repeats, None).when(F.col("size") == 0, "File is empty (0 bytes)")
        .when(F.col("size") > max_bytes, F.concat(F.lit("File size "), F.col("size").cast("string"), F.lit(f" bytes exceeds max allowed {max_bytes} bytes")))
        .otherwise(F.nullif("_error", F.lit("")))
    )
    status = F.when(F.col("feed").isNull(), "REJECTED").when(repeats, "DUPLICATE").when(F.col("reason").isNotNull(), "REJECTED").otherwise("ACCEPTED")
    told = read.join(first, "fingerprint", "left").withColumn("reason", reason).withColumn("status", status)
    return told.select(
        *order, "name", "feed", "size", "fingerprint", "status", "reason", F.when(F.col("status") == "DUPLICATE", F.col("_first.name")).alias("registered_as"),
        F.when(F.col("status") == "ACCEPTED", F.concat_ws("/", F.nullif("_folder", F.lit("")), "name")).alias("path"),
    )


def entries(registered: DataFrame) -> DataFrame:
    """What the next landing takes as known: (fingerprint, name) of the files that were entered."""
    return registered.where("feed is not null and status <> 'DUPLICATE'").select("fingerprint", "name")


def opened(registered: DataFrame, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """(batch_id, feed, name, stage_order, stage, status) of the pending stages of a batch for each accepted file; its id is the fingerprint."""
    names = F.array(*map(F.lit, stages))
    rows = registered.where("status = 'ACCEPTED'").select(F.col("fingerprint").alias("batch_id"), "feed", "name", F.posexplode(names).alias("stage_order", "stage"))
    return rows.select("batch_id", "feed", "name", (F.col("stage_order") + 1).alias("stage_order"), "stage", F.lit("PENDING").alias("status"))
