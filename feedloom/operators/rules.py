"""Data-quality rules compiled to columns: seven types, four severities, two dialects."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedloom.functions.text import NUMBER, blank_to_null, to_date, to_decimal

SEVERITIES = ("INFO", "WARNING", "QUARANTINE", "REJECT_FILE")
# The quarantine reason of each rule type.
REASONS = {
    "NOT_NULL": "MISSING_REQUIRED_FIELD", "RANGE": "VALUE_OUT_OF_RANGE", "REGEX": "REGEX_MISMATCH", "ENUM": "INVALID_ENUM_VALUE",
    "LENGTH": "RECORD_TOO_LONG", "DATE_RANGE": "INVALID_DATE_FORMAT", "CROSS_FIELD": "REFERENTIAL_INTEGRITY",
}
_OPERATORS = {"EQUALS": "EQ", "NOT_EQUALS": "NE", "GREATER_THAN": "GT", "LESS_THAN": "LT"}


@dataclass(frozen=True)
class Rule:
    """A rule on one field. In dialect "production" nulls pass and patterns are searched for; in "test" nulls fail and patterns match whole."""

    name: str
    kind: str
    column: str
    severity: str = "QUARANTINE"
    config: dict[str, Any] = field(default_factory=dict)


# The date formats that a rule's configuration may name.
DATE_FORMATS = ("YYYY-MM-DD", "DD/MM/YYYY", "MM/DD/YYYY", "YYYY/MM/DD", "DD-MM-YYYY", "MM-DD-YYYY")
_KINDS = {"INTEGER": "number", "DECIMAL": "number", "DATE": "date", "TIMESTAMP": "date"}
_BOUNDS = {"RANGE": ("min", "max", float), "LENGTH": ("min_length", "max_length", int), "DATE_RANGE": ("min_date", "max_date", None)}


def _bound_problems(rule: Rule) -> list[str]:
    low_name, high_name, kind = _BOUNDS[rule.kind]
    form = str(rule.config.get("format", "%Y-%m-%d"))
    out, read = [], {}
    for name in (low_name, high_name):
        given = rule.config.get(name)
        if given is None:
            continue
        try:
            read[name] = kind(given) if kind else datetime.strptime(str(given), form.upper().replace("YYYY", "%Y").replace("MM", "%m").replace("DD", "%d") if "%" not in form else form)
        except (TypeError, ValueError):
            out.append(f"{name} is no {'date of the format' if kind is None else 'number'}: {given}")
            continue
        if rule.kind == "LENGTH" and read[name] < 0:
            out.append(f"{name} is below 0")
    if rule.config.get(low_name) is None and rule.config.get(high_name) is None and rule.config.get("exact_length") is None:
        out.append("no bound")
    if len(read) == 2 and read[low_name] > read[high_name]:
        out.append("the bounds are crossed")
    return out


def problems(rule: Rule, types: dict[str, str] | None = None) -> list[str]:
    """What is wrong with a rule's configuration; nothing if it may be used. With types, the schema's data type of each field, its fields are checked as well."""
    c, out = rule.config, []
    if rule.kind not in REASONS:
        return [f"unknown type {rule.kind}"]
    if rule.severity not in SEVERITIES:
        out.append(f"unknown severity {rule.severity}")
    if rule.kind in _BOUNDS:
        out += _bound_problems(rule)
    if rule.kind == "DATE_RANGE" and "%" not in str(c.get("format", "%")) and str(c["format"]).upper() not in DATE_FORMATS:
        out.append(f"unknown date format {c['format']}")
    if rule.kind == "REGEX":
        try:
            if not c["pattern"].strip():
                out.append("the pattern is empty")
            re.compile(c["pattern"])
            if SparkSession.getActiveSession() and not compiles(java_pattern(c["pattern"])):
                out.append("the pattern is none that Spark takes, and would check nothing")
        except (AttributeError, KeyError, TypeError, re.error):
            out.append("the pattern does not compile")
    if rule.kind == "ENUM":
        values = c.get("values") or []
        if not values or len(set(map(str, values))) != len(values):
            out.append("values must be given once each")
        if not all(isinstance(v, str) for v in values):
            out.append("values must be texts")
    other, operator = c.get("secondary_field") or c.get("compare_field"), _OPERATORS.get(c.get("operator"), c.get("operator"))
    if rule.kind == "CROSS_FIELD":
        if not other or operator not in ("EQ", "NE", "GT", "LT", "GTE", "LTE"):
            out.append("a second field and an operator are needed")
        if other == rule.column:
            out.append("a field cannot be compared with itself")
    return out if types is None else out + _field_problems(rule, types, other, operator)


def _field_problems(rule: Rule, types: dict[str, str], other: str | None, operator: str | None) -> list[str]:
    out = [f"no such field: {name}" for name in (rule.column, *([other] if rule.kind == "CROSS_FIELD" and other else [])) if name not in types]
    own = _KINDS.get(types.get(rule.column, ""))
    wanted = {"RANGE": "number", "DATE_RANGE": "date"}.get(rule.kind)
    if wanted and rule.column in types and own != wanted:
        out.append(f"a {rule.kind} rule needs a {wanted}, not {types[rule.column]}")
    if rule.kind == "CROSS_FIELD" and not out and operator not in ("EQ", "NE") and (own is None or own != _KINDS.get(types.get(other, ""))):
        out.append("fields put in order must both be numbers or both dates")
    return out


def java_pattern(pattern: str) -> str:
    """A Python pattern in Java's notation, with Unicode classes."""
    return "(?U)" + re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern).replace("(?P<", "(?<").replace("\\Z", "\\z")


def compiles(pattern: str) -> bool:
    """Whether Java takes a pattern; one that it doesn't is no check."""
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:
        return False
    return True


def _numbers(c: Column) -> list[Column]:
    """The number in a text as finely as it can be held: with 18 digits after the point, as a whole number of up to 38, and about."""
    number = F.when(c.rlike(NUMBER), c)
    return [to_decimal(c), number.try_cast("decimal(38,0)"), number.try_cast("double")]


def violated(rule: Rule, dialect: str = "production") -> Column:
    """True where the row violates the rule, never null."""
    c, test = rule.config, dialect == "test"
    value = blank_to_null(F.col(rule.column).cast("string"))
    if rule.kind == "NOT_NULL":
        return value.isNull()
    checks: list[Column] = []
    if rule.kind == "RANGE":
        numbers = _numbers(F.col(rule.column).cast("string"))
        checks.append(numbers[-1].isNull())
        for bound, inclusive in (("min", c.get("inclusive_min", c.get("inclusive", True))), ("max", c.get("inclusive_max", c.get("inclusive", True)))):
            if c.get(bound) is not None:
                limits = [F.lit(str(c[bound])).try_cast("decimal(38,18)"), F.lit(str(c[bound])).try_cast("decimal(38,0)"), F.lit(float(c[bound]))]
                outside = lambda x, limit: ((x < limit, x <= limit) if bound == "min" else (x > limit, x >= limit))[not inclusive]  # noqa: B023, E731
                checks.append(F.coalesce(*[outside(x, limit) for x, limit in zip(numbers, limits, strict=True)]))
    elif rule.kind == "REGEX" and c.get("pattern") and compiles(java_pattern(c["pattern"])):
        pattern = java_pattern(c["pattern"])
        checks.append(~value.rlike(rf"^(?:{pattern})\z" if test else pattern))
    elif rule.kind == "ENUM":
        exact = c.get("case_sensitive", True)
        checks.append(~(value if exact else F.lower(value)).isin([v if exact else v.lower() for v in c["values"]]))
    elif rule.kind == "LENGTH":
        size = F.char_length(value)
        if c.get("exact_length") is not None and not test:
            checks.append(size != c["exact_length"])
        if c.get("min_length") is not None:
            checks.append(size < c["min_length"])
        if c.get("max_length") is not None:
            checks.append(size > c["max_length"])
    elif rule.kind == "DATE_RANGE":
        day = to_date(value, c.get("format", "%Y-%m-%d"))
        checks.append(day.isNull())
        if c.get("min_date"):
            checks.append(day < F.lit(c["min_date"]).try_cast("date"))  # a bound that is no date bounds nothing
        if c.get("max_date"):
            checks.append(day > F.lit(c["max_date"]).try_cast("date"))
    elif rule.kind == "CROSS_FIELD":
        other = blank_to_null(F.col(c.get("secondary_field") or c["compare_field"]).cast("string"))
        operator = _OPERATORS.get(c["operator"], c["operator"])
        if operator in ("EQ", "NE"):
            same = value == F.coalesce(other, F.lit("None"))
            checks.append(~same if operator == "EQ" else same)
        else:
            compare = {"GT": lambda a, b: a > b, "LT": lambda a, b: a < b, "GTE": lambda a, b: a >= b, "LTE": lambda a, b: a <= b}.get(operator)
            if compare:
                holds = F.coalesce(*[compare(a, b) for a, b in zip(_numbers(value), _numbers(other), strict=True)])
                checks.append(F.coalesce(~holds, F.lit(True)))
    bad = reduce(lambda x, y: x | y, [F.coalesce(check, F.lit(False)) for check in checks], F.lit(False))
    return F.when(value.isNull(), F.lit(test)).otherwise(F.coalesce(bad, F.lit(False)))


def flagged(frame: DataFrame, rules: list[Rule], dialect: str = "production") -> DataFrame:
    """frame with a boolean column _v<k> for each rule."""
    return frame.withColumns({f"_v{k}": violated(r, dialect) for k, r in enumerate(rules)})


def first_failure(rules: list[Rule]) -> Column:
    """The first violated QUARANTINE rule of a flagged row: field, value, reason, rule; null if none is."""
    found = [
        F.when(F.col(f"_v{k}"), F.struct(F.lit(r.column).alias("field"), F.col(r.column).cast("string").alias("value"), F.lit(REASONS[r.kind]).alias("reason"), F.lit(r.name).alias("rule")))
        for k, r in enumerate(rules) if r.severity == "QUARANTINE"
    ]
    return F.coalesce(*found) if found else F.lit(None).cast("struct<field:string,value:string,reason:string,rule:string>")


def split(frame: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with _failure): disjoint, and together the frame."""
    marked = flagged(frame, rules).withColumn("_failure", first_failure(rules))
    return marked.where("_failure is null").select(frame.columns), marked.where("_failure is not null").select(*frame.columns, "_failure")


def telemetry(frame: DataFrame, rules: list[Rule], dialect: str = "production") -> DataFrame:
    """One row for each rule: evaluated, passed, failed, pass_rate, action. One pass; counts are summed before the shuffle."""
    marked = flagged(frame, rules, dialect)
    sums = marked.agg(F.count("*").alias("n"), *[F.count_if(f"_v{k}").alias(f"f{k}") for k in range(len(rules))])
    rows = [F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.col("n").alias("evaluated"), (F.col("n") - F.col(f"f{k}")).alias("passed"), F.col(f"f{k}").alias("failed")) for k, r in enumerate(rules)]
    return with_rate(sums.select(F.inline(F.array(*rows))))


def with_rate(counts: DataFrame) -> DataFrame:
    rate = F.when(F.col("evaluated") == 0, F.lit(100.0)).otherwise(F.round(100.0 * F.col("passed") / F.col("evaluated"), 2))
    action = F.when(F.col("failed") == 0, "PASSED").when(F.col("severity") == "REJECT_FILE", "BATCH_ABORTED").when(F.col("severity") == "QUARANTINE", "QUARANTINED_ROWS").when(F.col("severity") == "WARNING", "LOGGED_WARNING").otherwise("LOGGED_INFO")
    return counts.withColumns({"pass_rate": rate, "action": action})


def telemetry_until_reject(frame: DataFrame, rules: list[Rule], order: list[str]) -> DataFrame:
    """telemetry() as far as a run gets that stops at the first row, in the given order, that violates a REJECT_FILE rule.

    Rows before it count for every rule; on that row the rules up to the one that rejects. The stop is one minimum, found first.
    """
    marked, key = flagged(frame, rules), F.struct(*order)
    reject = [k for k, r in enumerate(rules) if r.severity == "REJECT_FILE"]
    if not reject:
        return telemetry(frame, rules)
    which = F.coalesce(*[F.when(F.col(f"_v{k}"), F.lit(k)) for k in reject])
    stop = marked.where(which.isNotNull()).agg(F.min(F.struct(key.alias("at"), which.alias("k"))).alias("stop")).select("stop.at", "stop.k")
    seen = marked.join(F.broadcast(stop), F.col("at").isNull() | (key <= F.col("at")))  # one row
    on = [F.col("at").isNull() | (key < F.col("at")) | (F.lit(k) <= F.col("k")) for k in range(len(rules))]
    sums = seen.agg(*[F.count_if(on[k]).alias(f"n{k}") for k in range(len(rules))], *[F.count_if(on[k] & F.col(f"_v{k}")).alias(f"f{k}") for k in range(len(rules))])
    rows = [F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.col(f"n{k}").alias("evaluated"), (F.col(f"n{k}") - F.col(f"f{k}")).alias("passed"), F.col(f"f{k}").alias("failed")) for k, r in enumerate(rules)]
    return with_rate(sums.select(F.inline(F.array(*rows))))


def rule_test(frame: DataFrame, rule: Rule, order: list[str], rows: int = 10_000, shown: int = 10) -> tuple[DataFrame, DataFrame]:
    """A rule tried on the first rows in order: (total, passed, failed, pass_rate), and (row_number, field, reason) of the first failures.

    The limits are the feature, a preview; failures carry no values. No rows have a pass rate of 0.
    """
    first = frame.orderBy(*order).limit(rows)
    tried = first.select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("row_number"), violated(rule, "test").alias("_bad"))  # `rows` rows at most
    counts = tried.agg(F.count("*").alias("total"), F.count_if(~F.col("_bad")).alias("passed"), F.count_if("_bad").alias("failed"))
    rate = F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.round(100.0 * F.col("passed") / F.col("total"), 2))
    failures = tried.where("_bad").orderBy("row_number").limit(shown).select("row_number", F.lit(rule.column).alias("field"), F.lit(REASONS[rule.kind]).alias("reason"))
    return counts.withColumn("pass_rate", rate), failures


def sandbox(frame: DataFrame, rules: list[Rule], order: list[str], rows: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Evidence from the first rows in order: (total, passed, quarantined, pass_rate, reject_file, status), and telemetry() of these rows.

    A REJECT_FILE violation quarantines its row and is reported, but does not stop the trial; no rows have a pass rate of 100.
    """
    first = frame.orderBy(*order).limit(rows)
    of = lambda *kinds: reduce(lambda a, b: a | b, [F.col(f"_v{k}") for k, r in enumerate(rules) if r.severity in kinds], F.lit(False))
    marked = flagged(first, rules).select(of("QUARANTINE", "REJECT_FILE").alias("_out"), of("REJECT_FILE").alias("_reject"))
    sums = marked.agg(F.count("*").alias("total"), F.count_if(~F.col("_out")).alias("passed"), F.count_if("_out").alias("quarantined"), F.coalesce(F.bool_or("_reject"), F.lit(False)).alias("reject_file"))
    rate = F.when(F.col("total") == 0, F.lit(100.0)).otherwise(F.round(100.0 * F.col("passed") / F.col("total"), 2))
    status = F.when(F.col("total") == F.col("passed") + F.col("quarantined"), "BALANCED").otherwise("UNBALANCED")
    return sums.withColumns({"pass_rate": rate, "status": status}), telemetry(first, rules)


def ledger(quarantined: DataFrame) -> DataFrame:
    """(reason, n) of quarantined rows."""
    return quarantined.groupBy(F.col("_failure.reason").alias("reason")).agg(F.count("*").alias("n"))


def reconcile(rows_in: Column, silver: Column, quarantined: Column, dropped: Column) -> list[Column]:
    """discrepancy and status of a batch's row balance."""
    gap = rows_in - (silver + quarantined + dropped)
    return [gap.alias("discrepancy"), F.when(gap == 0, "PASS").otherwise("FAIL").alias("status")]
