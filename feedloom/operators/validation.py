"""Record validation against a feed's fields, and drift of a header against its contract."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.text import blank_to_null, to_date


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "STRING"
    required: bool = False
    allowed: tuple[str, ...] = ()


def failure(fields: list[Field], as_of: str) -> Column:
    """The first failure in the fields' order as (field, value, reason); null for a valid row. Blank text counts as missing."""
    found = []
    for f in fields:
        value = blank_to_null(F.col(f.name).cast("string"))
        why = F.when(F.lit(f.required) & value.isNull(), "MISSING_REQUIRED_FIELD")
        if f.type == "DATE":
            day = to_date(value)
            why = why.when(value.isNotNull() & day.isNull(), "INVALID_DATE_FORMAT")
            if "birth" in f.name.lower() or "dob" in f.name.lower():
                why = why.when(day > F.lit(as_of).cast("date"), "FUTURE_DATE")
        if f.type == "ENUM" and f.allowed:
            why = why.when(value.isNotNull() & ~value.isin(*f.allowed), "INVALID_ENUM_VALUE")
        found.append(F.when(why.isNotNull(), F.struct(F.lit(f.name).alias("field"), value.alias("value"), why.alias("reason"))))
    return F.coalesce(*found)


def project(frame: DataFrame, fields: list[Field], **lineage: Column) -> DataFrame:
    """The lineage columns, then the fields in order, trimmed; a field that the frame lacks is null. Names match in any case."""
    there = {c.strip().lower(): c for c in frame.columns}
    return frame.select(*[c.alias(n) for n, c in lineage.items()], *[(blank_to_null(F.col(there[f.name.lower()]).cast("string")) if f.name.lower() in there else F.lit(None).cast("string")).alias(f.name) for f in fields])


def drift(headers: DataFrame, contract: list[Field], delimiter: str = ",") -> DataFrame:
    """headers (header array<string>, delimiter) with missing_required, missing_optional, unexpected and severity."""
    names = F.transform(F.col("header"), lambda x: F.lower(F.trim(x)))
    want = lambda flag: F.array(*[F.lit(f.name.lower()) for f in contract if f.required == flag]).cast("array<string>")
    out = headers.withColumns({"missing_required": F.array_except(want(True), names), "missing_optional": F.array_except(want(False), names), "unexpected": F.array_except(names, F.concat(want(True), want(False)))})
    empty = F.col("header").isNull() | (F.size("header") == 0)
    breaking = empty | (F.col("delimiter") != delimiter) | (F.size("missing_required") > 0)
    return out.withColumn("severity", F.when(breaking, "BREAKING").when((F.size("missing_optional") > 0) | (F.size("unexpected") > 0), "NON_BREAKING").otherwise("NONE"))


def sniff_delimiter(line: Column, expected: str = ",") -> Column:
    """The most frequent of , tab | ; in a header line; the expected one if there is none, the first of equals."""
    counts = {d: F.length(line) - F.length(F.replace(line, F.lit(d), F.lit(""))) for d in (",", "\t", "|", ";")}
    most = F.greatest(*counts.values())
    best = F.coalesce(*[F.when(n == most, F.lit(d)) for d, n in counts.items()])
    return F.when(most > 0, best).otherwise(F.lit(expected))
