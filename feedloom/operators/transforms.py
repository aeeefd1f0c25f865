"""Twelve mapping transforms and the path language, compiled to columns."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions.text import blank_to_null, date_pattern, trim_ws

_STEP = re.compile(r"\.?(?P<name>[^.\[\]]+)|\[['\"](?P<quoted>[^'\"]*)['\"]\]|\[(?P<index>\d+)\]|\[(?P<all>\*)\]|\[\?\(@\.(?P<key>\w+)\s*(?P<op>==|!=)\s*'(?P<value>[^']*)'\)\]")


def steps(path: str) -> list[dict[str, str]]:
    """A path cut into names, [n], [*] and [?(@.k=='v')]; what is none of these is an error."""
    path, at, out = path.removeprefix("$").removeprefix("."), 0, []
    while at < len(path):
        match = _STEP.match(path, at)
        if not match:
            raise ValueError(f"cannot read {path!r} at {at}")
        found = {k: v for k, v in match.groupdict().items() if v is not None}
        out.append({"name": found["quoted"]} if "quoted" in found else found)
        at = match.end()
    return out


def _field(name: str):
    return lambda x: x[name]


def _at(index: int):
    return lambda x: F.get(x, index)


def _equals(key: str, value: str, same: bool):
    return lambda x: (F.coalesce(x[key].cast("string"), F.lit("None")) == value) == F.lit(same)


def _present(array: Column) -> Column:
    return F.filter(array, lambda x: x.isNotNull())


def extract(root: Column, path: str, default: Any = None) -> Column:
    """What a path finds in a struct. [*] and filters give arrays, without nulls; what follows holds for each element, a further [*] or filter
    for the elements of all its arrays. None found: the default."""
    column, many = root, False
    todo = steps(path)
    for n, step in enumerate(todo):
        if "name" in step:
            column = _present(F.transform(column, _field(step["name"]))) if many else column[step["name"]]
        elif "index" in step:
            at = int(step["index"])
            column = _present(F.transform(column, _at(at))) if many else F.get(column, at)
        else:
            if many:
                column = F.flatten(column)
            if "key" in step:
                column = F.filter(column, _equals(step["key"], step["value"], step["op"] == "=="))
            many = True
            if n == len(todo) - 1:
                column = _present(column)
    if many:
        column = F.when(F.size(column) > 0, column)
    return column if default is None else F.coalesce(column, F.lit(default))


def without_value(sources: list[str], params: dict[str, Any]) -> Column:
    """True for a row that a VALUE_MAP with on_unmapped ERROR has no value for: it goes to quarantine and ends no job."""
    if params.get("on_unmapped") != "ERROR":
        return F.lit(False)
    value = F.col(sources[0]).cast("string")
    return F.coalesce(value.isNotNull() & ~value.isin(list(params["dictionary"])), F.lit(False))


def compile_transform(kind: str, sources: list[str], params: dict[str, Any] | None = None) -> Column:
    """The column of one mapping line."""
    p, cols = params or {}, [F.col(s) for s in sources]
    if kind == "DIRECT":
        return cols[0]
    if kind == "CONSTANT":
        return F.lit(p["value"])
    if kind == "VALUE_MAP":
        pairs = [F.lit(x) for kv in p["dictionary"].items() for x in kv]
        found = F.try_element_at(F.create_map(*pairs), cols[0].cast("string")) if pairs else F.lit(None)
        return found if p.get("on_unmapped") in ("NULL", "ERROR") else F.coalesce(found, F.lit(p.get("default")))
    if kind == "DATE_FORMAT":
        text = blank_to_null(cols[0].cast("string"))
        return F.coalesce(F.date_format(F.try_to_timestamp(text, F.lit(date_pattern(p["source_format"]))), _output(p["target_format"])), text)
    if kind == "CONCAT":
        return F.array_join(F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), p.get("delimiter", " "))
    if kind == "COALESCE":
        return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in cols])
    if kind == "STRING_CLEAN":
        text = trim_ws(cols[0].cast("string")) if p.get("trim", True) else cols[0].cast("string")
        return {"UPPER": F.upper, "LOWER": F.lower}.get(p.get("casing", "NONE"), lambda c: c)(text)
    if kind == "PATH_EXTRACT":
        return extract(cols[0], p["path"], p.get("default"))
    if kind == "EXPLODE":
        return F.get(extract(cols[0], p["array_path"]) if p.get("array_path") else cols[0], 0)
    if kind == "ARRAY_MAP":
        found = extract(cols[0], p["array_path"]) if p.get("array_path") else cols[0]
        if p.get("filter_key"):
            found = F.filter(found, lambda x: x[p["filter_key"]].cast("string") == str(p["filter_val"]))
        if p.get("element_path"):
            found = F.transform(found, lambda x: extract(x, p["element_path"]))
        found = F.filter(found, lambda x: x.isNotNull())
        return found if p.get("delimiter", ", ") is None else F.array_join(found.cast("array<string>"), p.get("delimiter", ", "))
    if kind == "UNNEST":
        root = extract(cols[0], p["path"]) if p.get("path") else cols[0]
        return F.struct(*[root[name].alias(name) for name in p["properties"]])
    raise ValueError(f"unknown transform {kind}")


def _output(fmt: str) -> str:
    return date_pattern(fmt).replace("M", "MM").replace("d", "dd").replace("H", "HH").replace("m", "mm").replace("s", "ss")


def _spread(frame: DataFrame, column: Column, path: str) -> Column:
    """What a path with [*] finds, arrays among it spread into their elements: the frame's schema tells where there are any."""
    found = steps(path)
    if not any("all" in s for s in found) or any("key" in s for s in found) or "name" not in found[-1]:
        return column
    kind = frame.select(column.alias("x")).schema["x"].dataType
    if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType)):
        return column
    whole = _present(F.flatten(column))
    return F.when(F.size(whole) > 0, whole)


def apply_mapping(frame: DataFrame, lines: list[tuple[str, str, list[str], dict[str, Any]]]) -> DataFrame:
    """One select of (target, kind, sources, params) lines. A PATH_EXTRACT through [*] gives the elements of the arrays it ends in, as one array."""
    out = []
    for target, kind, sources, params in lines:
        column = compile_transform(kind, sources, params)
        if kind == "PATH_EXTRACT" and params.get("default") is None:
            column = _spread(frame, column, params["path"])
        out.append(column.alias(target))
    return frame.select(*out)


def mapping_failure(lines: list[tuple[str, str, list[str], dict[str, Any]]]) -> Column:
    """The first VALUE_MAP line of a row with on_unmapped ERROR that has no value: field, value, reason, rule, as rules.first_failure() has them; null if none is."""
    kind = "struct<field:string,value:string,reason:string,rule:string>"
    found = [F.when(without_value(s, p), F.struct(F.lit(s[0]).alias("field"), F.col(s[0]).cast("string").alias("value"), F.lit("INVALID_ENUM_VALUE").alias("reason"), F.lit(t).alias("rule"))) for t, k, s, p in lines if k == "VALUE_MAP"]
    return F.coalesce(*found, F.lit(None).cast(kind))


def split_mapping(frame: DataFrame, lines: list[tuple[str, str, list[str], dict[str, Any]]]) -> tuple[DataFrame, DataFrame]:
    """(mapped rows, rows that can't be mapped with _failure): each row is in one of them."""
    failure = mapping_failure(lines)
    return apply_mapping(frame.where(failure.isNull()), lines), frame.withColumn("_failure", failure).where("_failure is not null")


def explode_rows(frame: DataFrame, array: str, target: str, outer: bool = True) -> DataFrame:
    """A row for each element with _explode_index from 0; with outer, an empty or null array gives one row with null and 0."""
    rest = [c for c in frame.columns if c != array]
    rows = frame.select(*rest, (F.posexplode_outer if outer else F.posexplode)(array).alias("_explode_index", target))
    return rows.withColumn("_explode_index", F.coalesce("_explode_index", F.lit(0)))


def flatten(schema: T.StructType, prefix: str = "", separator: str = "_", max_depth: int = 5, parent: str = "") -> list[Column]:
    """Columns of all leaves of a schema, named by their way; arrays and what is deeper than max_depth stay whole."""
    out = []
    for f in schema.fields:
        path, name = f"{parent}.`{f.name}`" if parent else f"`{f.name}`", f"{prefix}{separator}{f.name}" if prefix else f.name
        if isinstance(f.dataType, T.StructType) and max_depth > 1:
            out += flatten(f.dataType, name, separator, max_depth - 1, path)
        else:
            out.append(F.col(path).alias(name))
    return out


def unmapped(required: list[str], optional: list[str], sources: list[str], lines: list[tuple]) -> dict[str, list[str]]:
    """What a mapping leaves out: required and optional targets, and source fields."""
    targets, used = {line[0] for line in lines}, {s for line in lines for s in line[2]}
    return {"required": [r for r in required if r not in targets], "optional": [o for o in optional if o not in targets], "source": [s for s in sources if s not in used]}
