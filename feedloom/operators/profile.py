"""Column profiles: one pass from wide text columns to a row for each column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.lineage import cut
from feedloom.functions.text import blank_to_null

# Date forms in the order in which they are tried: name, pattern of the text, pattern of the date.
DATE_FORMS = [
    ("YYYY-MM-DD", r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), ("MM/DD/YYYY", r"^\d{2}/\d{2}/\d{4}$", "MM/dd/yyyy"), ("DD/MM/YYYY", r"^\d{2}/\d{2}/\d{4}$", "dd/MM/yyyy"),
    ("MM-DD-YYYY", r"^\d{2}-\d{2}-\d{4}$", "MM-dd-yyyy"), ("DD-MM-YYYY", r"^\d{2}-\d{2}-\d{4}$", "dd-MM-yyyy"), ("YYYY/MM/DD", r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd"), ("YYYYMMDD", r"^\d{8}$", "yyyyMMdd"),
]
# The same of timestamps, whose first 19 characters count.
TIMESTAMP_FORMS = [("YYYY-MM-DD HH:MM:SS", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"), ("ISO-8601", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z?$", "yyyy-MM-dd'T'HH:mm:ss")]
TYPES = ("STRING", "INTEGER", "DECIMAL", "BOOLEAN", "DATE", "TIMESTAMP")


def values(frame: DataFrame, order: list[str]) -> DataFrame:
    """(column, ord, value): every cell as trimmed text, null where blank; wide rows are unpivoted once."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), blank_to_null(F.col(c).cast("string")).alias("value")) for c in frame.columns])
    return frame.select(F.struct(*order).alias("ord"), F.explode(cells).alias("c")).select("c.column", "ord", "c.value")


def _moment(pattern: str) -> Column:
    return F.try_to_timestamp(F.left("value", F.lit(19)), F.lit(pattern))


def classified(cells: DataFrame) -> DataFrame:
    """cells with form (of a date or timestamp) and kind: the first of date, timestamp, boolean, integer, decimal, text that fits."""
    value = F.col("value")
    form = F.coalesce(*[F.when(value.rlike(pattern) & _moment(ours).isNotNull(), F.lit(name)) for name, pattern, ours in DATE_FORMS + TIMESTAMP_FORMS])
    timed = F.col("form").isin([name for name, _, _ in TIMESTAMP_FORMS])
    kind = F.when(value.isNull(), F.lit(None)).when(timed, "TIMESTAMP").when(F.col("form").isNotNull(), "DATE").when(F.lower(value).isin("true", "false", "t", "f", "yes", "no", "y", "n", "1", "0"), "BOOLEAN").when(value.rlike(r"^[-+]?\d+$"), "INTEGER").when(value.rlike(r"^[-+]?\d*\.\d+$"), "DECIMAL").otherwise("STRING")
    return cells.withColumn("form", form).withColumn("kind", kind)


def _inferred(filled: Column) -> Column:
    """The type of a column from the numbers of its values of each kind, of which there are `filled`."""
    return (
        F.when(filled == 0, "STRING").when(F.col("BOOLEAN") == filled, "BOOLEAN").when(F.col("INTEGER") == filled, "INTEGER")
        .when(F.col("INTEGER") + F.col("DECIMAL") == filled, "DECIMAL").when((F.col("TIMESTAMP") > 0) & (F.col("TIMESTAMP") + F.col("DATE") == filled), "TIMESTAMP")
        .when(F.col("DATE") == filled, "DATE").otherwise("STRING")
    )


def profile(frame: DataFrame, order: list[str], distinct_cap: int = 10_000) -> DataFrame:
    """(column, total, nulls, null_pct, distinct, distinct_pct, inferred, min_value, max_value) for each column.

    min and max are by number or date where the inferred type has them, else by text. Distinct counts stop at the cap.
    """
    counted = classified(values(frame, order)).groupBy("column", "value", "form", "kind").agg(F.count("*").alias("n"))
    number = F.when(F.col("kind").isin("INTEGER", "DECIMAL", "BOOLEAN"), F.col("value").try_cast("decimal(38,18)"))
    day = F.coalesce(*[F.when(F.col("form") == name, _moment(ours)) for name, _, ours in DATE_FORMS + TIMESTAMP_FORMS])
    counted = counted.withColumns({"number": number, "day": day})
    of = lambda *kinds: F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), F.col("n"))), F.lit(0))
    summed = counted.groupBy("column").agg(
        F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.count("value").alias("d"),
        *[of(k).alias(k) for k in TYPES],
        F.min(F.struct("number", "value")).alias("_"), F.min(F.when(F.col("number").isNotNull(), F.struct("number", "value"))).alias("ln"), F.max(F.when(F.col("number").isNotNull(), F.struct("number", "value"))).alias("hn"),
        F.min(F.when(F.col("day").isNotNull(), F.struct("day", "value"))).alias("ld"), F.max(F.when(F.col("day").isNotNull(), F.struct("day", "value"))).alias("hd"), F.min("value").alias("lt"), F.max("value").alias("ht"),
    )
    filled = F.col("total") - F.col("nulls")
    inferred = _inferred(filled)
    numeric, timed = F.col("inferred").isin("INTEGER", "DECIMAL"), F.col("inferred").isin("DATE", "TIMESTAMP")
    pick = lambda n, d, t: F.when(numeric, F.col(f"{n}.value")).when(timed, F.col(f"{d}.value")).otherwise(F.col(t))
    distinct = F.least(F.col("d"), F.lit(distinct_cap))
    return summed.withColumn("inferred", inferred).select(
        "column", "total", "nulls", F.when(F.col("total") == 0, 0.0).otherwise(F.round(100.0 * F.col("nulls") / F.col("total"), 2)).alias("null_pct"),
        distinct.alias("distinct"), F.when(filled == 0, 0.0).otherwise(F.round(100.0 * distinct / filled, 2)).alias("distinct_pct"), "inferred", pick("ln", "ld", "lt").alias("min_value"), pick("hn", "hd", "ht").alias("max_value"),
    )


def date_histogram(frame: DataFrame, order: list[str]) -> DataFrame:
    """(column, form, n) of the forms of dates and timestamps met."""
    return classified(values(frame, order)).where("form is not null").groupBy("column", "form").agg(F.count("*").alias("n"))


def samples(frame: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """(column, place, value): each column's first n distinct values in order of arrival."""
    first = values(frame, order).where("value is not null").groupBy("column", "value").agg(F.min("ord").alias("ord"))
    place = F.row_number().over(Window.partitionBy("column").orderBy("ord", "value"))
    return first.withColumn("place", place).where(F.col("place") <= n).select("column", "place", "value")


def array_lengths(frame: DataFrame, column: str) -> DataFrame:
    """(min_length, max_length, avg_length) of an array column."""
    size = F.when(F.col(column).isNotNull(), F.size(column))
    return frame.agg(F.min(size).alias("min_length"), F.max(size).alias("max_length"), F.round(F.avg(size), 2).alias("avg_length"))


def summary(profiled: DataFrame) -> DataFrame:
    """(total_rows, total_columns, columns_with_nulls, and a count of columns for each type, zeros included) of a profile."""
    of = [F.count_if(F.col("inferred") == t).alias(f"n_{t.lower()}") for t in TYPES]
    return profiled.agg(F.coalesce(F.max("total"), F.lit(0)).alias("total_rows"), F.count("*").alias("total_columns"), F.count_if(F.col("nulls") > 0).alias("columns_with_nulls"), *of)


def profile_paths(cells: DataFrame, padded: bool = True, distinct_cap: int | None = 10_000) -> DataFrame:
    """(path, total, nulls, null_pct, distinct, inferred, is_array, depth, min_length, max_length) for each path of nested documents.

    cells come from files.json_cells or xml_cells: path, value, counted, empty, length, records. Padded paths that
    fewer values than records have count the rest as nulls. Cells without a path only carry the number of records. Distinct
    counts stop at the cap, if there is one.
    """
    held = cut(cells, "cells")  # read twice: for the number of records and for the paths
    records = held.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0] if padded else 0
    counted = classified(held.where("path is not null")).groupBy("path", "value", "form", "kind")
    counted = counted.agg(F.count("*").alias("n"), F.sum("counted").alias("counted"), F.sum("empty").alias("empty"), F.min("length").alias("lo"), F.max("length").alias("hi"))
    of = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in TYPES]
    summed = counted.groupBy("path").agg(F.sum("counted").alias("vals"), F.sum("empty").alias("empty"), F.least(F.count("value"), F.lit(distinct_cap).cast("long")).alias("distinct"), *of, F.min("lo").alias("min_length"), F.max("hi").alias("max_length"))
    missing = F.greatest(F.lit(0), F.lit(records) - F.col("vals"))
    summed = summed.withColumns({"total": F.col("vals") + missing, "nulls": F.col("empty") + missing, "filled": sum((F.col(k) for k in TYPES), F.lit(0))})
    depth = F.regexp_count("path", F.lit(r"\.")).cast("long") + 1
    return summed.select("path", "total", "nulls", F.when(F.col("total") == 0, 0.0).otherwise(F.round(100.0 * F.col("nulls") / F.col("total"), 2)).alias("null_pct"), "distinct", _inferred(F.col("filled")).alias("inferred"), F.col("path").contains("[*]").alias("is_array"), depth.alias("depth"), "min_length", "max_length")


#: Registers of a distinct-count sketch: 2^14, a standard error of 0.8 %.
SKETCH = 14


def profile_part(frame: DataFrame, order: list[str], part: Column | str, distinct_cap: int = 10_000) -> DataFrame:
    """(part, column, total, nulls, a count for each type, sketch, held, firsts): what a batch adds to the profile of its columns, to be merged later.

    sketch counts distinct values; held has all of them where there are distinct_cap at most, else it is null; firsts the first five in order of arrival, whose
    order part begins. Sketches are summed up in each task, and only columns whose sketch says that they may be under the cap have their values shuffled.
    """
    own = F.lit(part) if isinstance(part, str) else part
    cells = cut(classified(values(frame, order)), "cells")
    of = [F.count_if(F.col("kind") == k).alias(k) for k in TYPES]
    sums = cut(cells.groupBy("column").agg(F.count("*").alias("total"), F.count_if(F.col("value").isNull()).alias("nulls"), *of, F.hll_sketch_agg("value", F.lit(SKETCH)).alias("sketch")), "sums")
    few = sums.where(F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)) <= distinct_cap * 1.1).select("column")  # columns of one table
    distinct = cells.where("value is not null").join(F.broadcast(few), "column", "left_semi").groupBy("column", "value").agg(F.lit(0).alias("_"))
    place = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    held = distinct.withColumn("_n", place).where(F.col("_n") <= distinct_cap + 1).groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("held"))
    # the first five distinct values: a value's first place, then the five smallest of these, both kept small in each task
    once = Window.partitionBy("column", "value").orderBy("ord")
    first = cells.where("value is not null").withColumn("_n", F.row_number().over(once)).where("_n = 1")
    first = first.withColumn("_n", F.row_number().over(Window.partitionBy("column").orderBy("ord", "value"))).where("_n <= 5")
    firsts = first.groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "value"))), lambda x: x["value"]).alias("firsts"))
    out = sums.join(held, "column", "left").join(firsts, "column", "left")
    empty, whole = F.array().cast("array<string>"), F.coalesce("held", F.array().cast("array<string>"))
    kept = F.when((F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)) <= distinct_cap * 1.1) & (F.size(whole) <= distinct_cap), whole)
    return out.select(own.alias("part"), "column", "total", "nulls", *TYPES, "sketch", kept.alias("held"), F.coalesce("firsts", empty).alias("firsts"))


def merge_parts(parts: DataFrame, distinct_cap: int = 10_000) -> DataFrame:
    """(column, total, nulls, null_pct, distinct, estimate, is_exact, inferred, firsts) of all parts together, without reading their rows again.

    distinct is exact up to the cap and stops there, as profile() has it; estimate goes on beyond, with the sketch's error. firsts are the first five distinct values, parts in
    order. Values that several parts hold count once; parts may be merged in any order and number, as long as each is there once.
    """
    sums = parts.groupBy("column").agg(F.sum("total").alias("total"), F.sum("nulls").alias("nulls"), *[F.sum(k).alias(k) for k in TYPES], F.hll_sketch_estimate(F.hll_union_agg("sketch", F.lit(True))).alias("estimate"), F.bool_and(F.col("held").isNotNull()).alias("_whole"))
    values_of = parts.where("held is not null").select("column", F.explode("held").alias("value")).distinct().groupBy("column").agg(F.count("*").alias("_d"))
    first = parts.select("part", "column", F.posexplode("firsts").alias("at", "value")).groupBy("column", "value").agg(F.min(F.struct("part", "at")).alias("ord"))
    first = first.withColumn("_n", F.row_number().over(Window.partitionBy("column").orderBy("ord", "value"))).where("_n <= 5")
    firsts = first.groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "value"))), lambda x: x["value"]).alias("firsts"))
    out = sums.join(values_of, "column", "left").join(firsts, "column", "left")
    exact = F.col("_whole") & (F.coalesce("_d", F.lit(0)) <= distinct_cap)
    return out.select(
        "column", "total", "nulls", F.when(F.col("total") == 0, 0.0).otherwise(F.round(100.0 * F.col("nulls") / F.col("total"), 2)).alias("null_pct"),
        F.when(exact, F.coalesce("_d", F.lit(0))).otherwise(F.lit(distinct_cap)).cast("long").alias("distinct"), F.when(exact, F.coalesce("_d", F.lit(0))).otherwise(F.coalesce("estimate", F.lit(0))).cast("long").alias("estimate"), exact.alias("is_exact"),
        _inferred(F.col("total") - F.col("nulls")).alias("inferred"), F.coalesce("firsts", F.array().cast("array<string>")).alias("firsts"),
    )
