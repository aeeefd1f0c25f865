"""The path language over Variant: documents whose shape differs from row to row, without a Python worker."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.lineage import cut, spread
from feedloom.operators.transforms import steps


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """What `of` makes of a value that it names several times, the value being found once."""
    return F.get(F.transform(F.array(value), of), 0)


def fields(value: Column) -> Column:
    """An object's values by key; null for what is no object."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def items(value: Column) -> Column:
    """An array's elements; null for what is no array."""
    return F.try_variant_get(value, "$", "array<variant>")


def parse(text: Column) -> Column:
    """The one JSON document in a text; null where there is none, or more behind it, which Spark's parser leaves unread."""
    alone = items(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))))
    return once(alone, lambda a: F.when(F.size(a) == 1, F.get(a, 0)))


def _something(value: Column) -> Column:
    return once(value, lambda v: F.when(~F.is_variant_null(v), v))


def shown(value: Column) -> Column:
    """A plain value as text: True and False, None for null, floats with a point; numbers that need an exponent as Spark writes them."""

    def of(v: Column) -> Column:
        text = F.try_variant_get(v, "$", "string")
        numeric, boolean = F.schema_of_variant(v).rlike(r"^(DECIMAL\(\d+,0\)|DOUBLE|FLOAT)"), F.schema_of_variant(v) == "BOOLEAN"
        told = once(text, lambda t: F.when(t.rlike(r"^-?\d{1,18}$"), F.when(numeric, F.concat(t, F.lit(".0"))).otherwise(t)).when(t.isin("true", "false"), F.when(boolean, F.initcap(t)).otherwise(t)).otherwise(t))
        return F.when(v.isNull() | F.is_variant_null(v), "None").otherwise(told)

    return once(value, of)


def _key(value: Column, name: str, any_case: bool) -> Column:
    plain = re.fullmatch(r"[^\"?\\]+", name)  # what Spark's own paths can name
    own = (lambda v: F.try_variant_get(v, f'$["{name}"]', "variant")) if plain else (lambda v: F.try_element_at(fields(v), F.lit(name)))
    if not any_case:
        return own(value)
    alike = lambda v: F.try_element_at(F.filter(F.map_entries(fields(v)), lambda e: F.lower(e["key"]) == name.lower()), F.lit(-1))["value"]
    return once(value, lambda v: F.coalesce(own(v), alike(v)))


def _one_or_all(found: Column) -> Column:
    return once(found, lambda a: F.when(F.size(a) > 1, F.to_variant_object(a)).when(F.size(a) == 1, F.get(a, 0)))


def _find(value: Column, todo: list[dict[str, str]]) -> Column:
    for n, step in enumerate(todo):
        rest = todo[n + 1 :]
        if "name" in step:
            value = _something(_key(value, step["name"], any_case=not rest or "name" in rest[0]))
        elif "index" in step:
            value = _something(F.try_variant_get(value, f"$[{int(step['index'])}]", "variant"))
        else:
            inside = items(value)
            if "key" in step:
                key, wanted, same = step["key"], step["value"], step["op"] == "=="
                inside = F.filter(inside, lambda x: fields(x).isNotNull() & ((shown(_find(x, steps(key))) == wanted) == F.lit(same)))
            if not rest:
                return _one_or_all(inside) if "key" in step else once(inside, lambda a: F.when(a.isNotNull(), F.to_variant_object(a)))
            found = F.filter(F.transform(inside, lambda x: _find(x, rest)), lambda x: x.isNotNull())
            if "key" in step:
                return _one_or_all(found)
            flat = F.flatten(F.transform(found, lambda x: F.coalesce(items(x), F.array(x))))
            return once(flat, lambda a: F.when(F.size(a) > 0, F.to_variant_object(a)))
    return value


def find(value: Column, path: str, default: Any = None) -> Column:
    """What a path finds in a Variant, as a Variant: names, [n], [*] and [?(@.k=='v')] as transforms.steps() reads them; null or the default where there is nothing.

    A name is taken as it is written, or else in any case (the last such key), but before a bracket only as it is written. [*] gathers what
    the rest of the path finds in each element, arrays spread into their elements, without nulls; nothing found is nothing. A filter compares its key's value as text
    (shown()) in objects only, and gives one match as it is, several as an array. An object where an array is asked for, and the like, is nothing.
    """
    found = _find(_something(value), steps(path))
    if default is None:
        return found
    return F.coalesce(found, F.try_variant_get(F.parse_json(F.to_json(F.array(F.lit(default)))), "$[0]", "variant"))


def first(value: Column) -> Column:
    """The first element of an array, null if it has none; what is no array is itself."""
    return once(value, lambda v: F.when(items(v).isNull(), v).otherwise(F.try_variant_get(v, "$[0]", "variant")))


def _pairs(value: Column, prefix: Column | None, separator: str, depth: int) -> Column:
    def of(entry: Column) -> Column:
        name = entry["key"] if prefix is None else F.concat(prefix, F.lit(separator), entry["key"])
        own = F.array(F.struct(name.alias("key"), entry["value"].alias("value")))
        return own if depth <= 1 else F.when(fields(entry["value"]).isNull(), own).otherwise(_pairs(entry["value"], name, separator, depth - 1))

    return F.flatten(F.transform(F.map_entries(fields(value)), of))


def flatten(value: Column, prefix: str = "", separator: str = "_", max_depth: int = 5) -> Column:
    """An object's leaves by name, as map<string, variant>: nested objects down to max_depth give prefix_key names, arrays and what is deeper stay whole.

    Of two leaves of one name the later in the order of keys stays; an empty nested object leaves nothing; what is no object gives null.
    """
    pairs = _pairs(value, F.lit(prefix) if prefix else None, separator, max_depth)
    names = F.transform(pairs, lambda e: e["key"])
    last = F.filter(pairs, lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), e["key"]))
    return F.map_from_entries(last)


def unnest(value: Column, path: str, properties: list[str] | None = None) -> Column:
    """The object at a path as map<string, variant>, only the named properties that it has; an empty map where no object is."""
    held = fields(find(value, path))
    if properties:
        held = F.map_filter(held, lambda k, v: k.isin(properties))
    return F.coalesce(held, F.create_map().cast("map<string,variant>"))


def array_map(value: Column, path: str, element_path: str | None = None, delimiter: str | None = ", ", filter_key: str | None = None, filter_val: str | None = None) -> Column:
    """The array at a path, filtered by a key's text, each object or array in it replaced by what element_path finds, without nulls; joined as text, or an array without delimiter."""
    inside = items(find(value, path))
    if filter_key is not None:
        inside = F.filter(inside, lambda x: F.when(fields(x).isNull(), F.lit("None")).otherwise(shown(_find(x, steps(filter_key)))) == str(filter_val))
    if element_path:
        inside = F.transform(inside, lambda x: F.when(fields(x).isNull() & items(x).isNull(), x).otherwise(_find(x, steps(element_path))))
    found = F.filter(inside, lambda x: x.isNotNull() & ~F.is_variant_null(x))
    return found if delimiter is None else F.array_join(F.transform(found, shown), delimiter)


def explode_rows(frame: DataFrame, column: str, path: str, target: str, outer: bool = True) -> DataFrame:
    """frame with a row for each element of the array at a path, target and _explode_index from 0; with outer, no or an empty array gives one row with null and 0."""
    rows = frame.select("*", (F.posexplode_outer if outer else F.posexplode)(items(find(F.col(column), path))).alias("_explode_index", target))
    return rows.withColumn("_explode_index", F.coalesce("_explode_index", F.lit(0)))


def records(text: Column, value: Column) -> Column:
    """A JSON document's records as an array: a bundle's resources (or entries), the objects of an array or else its values as {"value": v}, the first array of objects in an object, else the object.

    "First" is in the order of the text. A plain document has none.
    """
    none = lambda x: x.isNull() | F.is_variant_null(x) | (F.size(fields(x)) == 0) | (F.size(items(x)) == 0) | F.try_variant_get(x, "$", "string").isin("", "false", "0")

    def of_object(v: Column) -> Column:
        inner = lambda name: lambda x: F.try_element_at(fields(x), F.lit(name))
        entries = F.filter(items(inner("entry")(v)), lambda e: fields(e).isNotNull())
        resources = F.transform(entries, lambda e: once(inner("resource")(e), lambda r: F.when(F.coalesce(none(r), F.lit(False)), e).otherwise(r)))
        lists = once(fields(v), lambda held: F.filter(F.transform(F.json_object_keys(text), lambda k: items(F.try_element_at(held, k))), lambda a: fields(F.get(a, 0)).isNotNull()))
        bundle = F.try_variant_get(inner("resourceType")(v), "$", "string") == "Bundle"
        of_bundle = once(resources, lambda a: F.when(F.size(a) > 0, a).otherwise(F.array(v)))
        return F.when(bundle, of_bundle).otherwise(once(lists, lambda a: F.when(F.size(a) > 0, F.get(a, 0)).otherwise(F.array(v))))

    def of_list(inside: Column) -> Column:
        wrapped = F.transform(inside, lambda x: F.to_variant_object(F.create_map(F.lit("value"), x)))
        return once(F.filter(inside, lambda x: fields(x).isNotNull()), lambda a: F.when(F.size(a) > 0, a).otherwise(wrapped))

    return once(value, lambda v: F.when(fields(v).isNotNull(), of_object(v)).otherwise(once(items(v), lambda a: F.when(a.isNotNull(), of_list(a)))))


def cells(frame: DataFrame, text: str) -> DataFrame:
    """(path, value, counted, empty, length, records): the values at each path of JSON texts, one text a row.

    An array counts once at path[*] with its length, and so does each plain item, which also stands there as the array shows it; an empty object is an empty value, and so is a blank or null one. A row
    without a path says how many records a text has, 1 at least; a text that is null or no JSON gives nothing. Each round takes all objects
    and arrays of one depth apart, so there are as many rounds as the deepest document has levels.
    """
    cell = lambda path, value, counted, empty, length, child: F.struct(path.alias("path"), value.alias("value"), F.lit(counted).cast("long").alias("counted"), empty.cast("long").alias("empty"), length.cast("long").alias("length"), child.alias("child"))
    none, no_text, no_child = F.lit(None).cast("long"), F.lit(None).cast("string"), F.lit(None).cast("variant")
    plain = lambda v: fields(v).isNull() & items(v).isNull()

    def leaf_of(at: Column, value: Column) -> Column:
        text = F.nullif(F.trim(F.when(F.is_variant_null(value), "").otherwise(shown(value))), F.lit(""))
        return cell(at, text, 1, text.isNull(), none, no_child)

    def below(path: Column, value: Column) -> Column:
        own = F.concat(path, F.lit("[*]"))

        def of_field(e: Column) -> Column:
            at = F.when(path == "", e["key"]).otherwise(F.concat(path, F.lit("."), e["key"]))
            return F.when(plain(e["value"]), leaf_of(at, e["value"])).otherwise(cell(at, no_text, 0, F.lit(0), none, e["value"]))

        nothing = F.when(path == "", F.array().cast(kind)).otherwise(F.array(cell(path, no_text, 1, F.lit(1), none, no_child)))
        def of_item(x: Column) -> Column:
            as_leaf, as_shown = leaf_of(own, x), cell(own, shown(x), 0, F.lit(0), none, no_child)
            return F.when(plain(x), F.array(as_shown, as_leaf)).otherwise(F.array(cell(own, no_text, 0, F.lit(0), none, x)))

        listed = lambda inside: F.concat(F.array(cell(own, no_text, 1, (F.size(inside) == 0), F.size(inside), no_child)), F.flatten(F.transform(inside, of_item)))
        of_held = lambda held: F.when(F.size(held) == 0, nothing).when(F.size(held) > 0, F.transform(held, of_field))
        return F.coalesce(once(F.map_entries(fields(value)), of_held), once(items(value), listed))

    kind = "array<struct<path:string,value:string,counted:bigint,empty:bigint,length:bigint,child:variant>>"
    parsed = spread(frame.select(F.col(text).alias("text"))).select("text", parse(F.col("text")).alias("doc")).where("doc is not null")
    found = cut(parsed.select(records(F.col("text"), F.col("doc")).alias("r")), "records")
    counts = found.select(no_text.alias("path"), no_text.alias("value"), F.lit(0).cast("long").alias("counted"), F.lit(0).cast("long").alias("empty"), none.alias("length"), F.greatest(F.coalesce(F.size("r"), F.lit(0)), F.lit(1)).cast("long").alias("records"))
    nodes = found.select(F.lit("").alias("path"), F.explode("r").alias("child")).where(~plain(F.col("child")))
    out = counts
    while nodes.take(1):
        level = cut(nodes.select(F.explode(below(F.col("path"), F.col("child"))).alias("c")).select("c.*"), "level")
        out = out.union(level.where("child is null").select("path", "value", "counted", "empty", "length", F.lit(0).cast("long").alias("records")))
        nodes = level.where("child is not null").select("path", "child")
    return out
