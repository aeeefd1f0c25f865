"""Privacy on nested values: the schema is walked once and compiled to transforms, keys and values alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions.text import scrub

# What keys of a payload must not be named after, and the hash fields that may.
FORBIDDEN_KEYS = ["name", "first_name", "last_name", "dob", "date_of_birth", "birth_date", "ssn", "social_security_number", "mrn", "member_id", "phone", "email", "address", "street", "raw_record", "source_record_raw"]
HASH_KEYS = ["ssn_hash", "dob_hash", "last_name_hash", "first_name_hash", "gender_hash", "postal_code_hash"]
# What a decision's notes must not show, in the order of the checks; mail addresses of a domain of one's own are allowed.
NOTE_PATTERNS = [
    ("SSN", r"\b\d{3}[- ]?\d{2}[- ]?\d{4}\b"),
    ("SSN_DIGITS", r"\b\d{9}\b"),
    ("DOB", r"(?i)\b(dob|birth|born)[:\s]+(0[1-9]|1[0-2]|[1-9])[-/.](0[1-9]|[12]\d|3[01]|[1-9])[-/.](19\d{2}|20\d{2})\b"),
    ("DATE_YYYYMMDD", r"\b(19\d{2}|20\d{2})[-/.](0[1-9]|1[0-2])[-/.](0[1-9]|[12]\d|3[01])\b"),
    ("PHONE", r"\b(?:\+?1[-. ]?)?\(?([2-9]\d{2})\)?[-. ]?([2-9]\d{2})[-. ]?(\d{4})\b"),
    ("EMAIL", r"(?i)\b[A-Za-z0-9._%+-]+@{own}[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("MRN_TAG", r"(?i)\b(mrn|ssn)[:\s]*[A-Za-z0-9-]{4,}\b"),
]

_ANY = "|".join(FORBIDDEN_KEYS)
_KEY = f"^(?:{_ANY})$|_(?:{_ANY})|(?:{_ANY})_"


def scrub_nested(value: Column, kind: T.DataType) -> Column:
    """value without personal data in any text: in fields, elements, map values and map keys, at any depth.

    Nulls stay nulls in nested values, other types stay as they are. Names of struct fields are the schema's and stay. Of map keys that are the same once scrubbed the last one's value stays.
    """
    if isinstance(kind, T.StringType):
        return F.when(value.isNotNull(), scrub(value))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: scrub_nested(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[scrub_nested(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.MapType):
        pairs = F.transform(F.map_entries(value), lambda e: F.struct(scrub_nested(e["key"], kind.keyType).alias("key"), scrub_nested(e["value"], kind.valueType).alias("value")))
        names = F.transform(pairs, lambda e: e["key"])
        return F.map_from_entries(F.filter(pairs, lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), e["key"])))
    return value


def forbidden_key(key: Column) -> Column:
    """Whether a key is named after a personal attribute, in any case, alone or beside an underscore; the six hash fields are not."""
    low = F.lower(key)
    return low.rlike(_KEY) & ~low.isin(HASH_KEYS)


def forbidden_path(value: Column, kind: T.DataType, path: str | Column = "") -> Column:
    """The path of the first key of a nested payload that must not stand there, null if none does: struct fields by the schema, map keys by what they hold.

    Keys come before what is below them, in order; elements of an array in order, without their numbers. What is null has no keys.
    """
    base = F.lit(path) if isinstance(path, str) else path
    at = lambda name: F.when(base == "", name).otherwise(F.concat(base, F.lit("."), name))
    no_path = F.lit(None).cast("string")
    if isinstance(kind, T.StructType):
        found = []
        for f in kind.fields:
            own = at(F.lit(f.name))
            found += [F.when(forbidden_key(F.lit(f.name)), own), forbidden_path(value[f.name], f.dataType, own)]
        return F.when(value.isNotNull(), F.coalesce(*found, no_path))
    if isinstance(kind, T.MapType):
        below = F.transform(F.map_entries(value), lambda e: F.coalesce(F.when(forbidden_key(e["key"].cast("string")), at(e["key"].cast("string"))), forbidden_path(e["value"], kind.valueType, at(e["key"].cast("string")))))
        return F.get(F.filter(below, lambda p: p.isNotNull()), 0)
    if isinstance(kind, T.ArrayType):
        below = F.transform(value, lambda x: forbidden_path(x, kind.elementType, base))
        return F.get(F.filter(below, lambda p: p.isNotNull()), 0)
    return no_path


def note_problem(note: Column, own_domain: str | None = None) -> Column:
    """Which kind of personal data a decision's note shows first (a name of NOTE_PATTERNS), null if none; the text itself is never handed on."""
    own = f"(?!{own_domain.replace('.', '[.]')}\\b)" if own_domain else ""
    return F.coalesce(*[F.when(note.rlike("(?U)" + pattern.replace("{own}", own)), F.lit(name)) for name, pattern in NOTE_PATTERNS])


def synthetic_row_id(ordinal: Column, seed: str | None = None) -> Column:
    """row_<ordinal>_<16 hex digits> for rows without a key: random digits, or with a seed the same ones in each run."""
    digits = F.sha2(F.concat(F.lit(f"{seed}|"), ordinal.cast("string")), 256) if seed is not None else F.sha2(F.uuid(), 256)
    return F.concat(F.lit("row_"), ordinal.cast("string"), F.lit("_"), F.left(digits, F.lit(16)))
