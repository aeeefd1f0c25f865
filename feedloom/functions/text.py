"""Text, hashing and privacy functions as Spark columns."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def trim_ws(c: Column) -> Column:
    """The text without Unicode white space at its ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(trim_ws(c), F.lit(""))


def collapse(c: Column, upper: bool = True) -> Column:
    """White space runs to one blank, one case; blank text is null."""
    one = F.regexp_replace(trim_ws(c), r"(?U)\s+", " ")
    return F.nullif(F.upper(one) if upper else F.lower(one), F.lit(""))


NUMBER = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"


def to_decimal(c: Column) -> Column:
    """The number in a text; null where there is none (NaN, infinities and digit groups count as none)."""
    text = F.when(c.cast("string").rlike(NUMBER), c.cast("string"))
    return text.try_cast("decimal(38,18)")


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Keyed hash of a text as lowercase hex, from two rounds of SHA-256 with the padded key."""
    import hashlib

    padded = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ x for b in padded).hex())) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def mask_preview(c: Column) -> Column:
    """First and last character around ***; two characters or fewer are **."""
    return F.when(F.length(c) <= 2, F.lit("**")).otherwise(F.concat(F.left(c, F.lit(1)), F.lit("***"), F.right(c, F.lit(1))))


# What operational texts and file names must not show, in the order of replacement.
OPERATIONAL_PATTERNS = [
    (r"\d{3}-\d{2}-\d{4}", "[REDACTED_SSN]"),
    (r"(?:(?<=[\W_])|^)\d{9}(?:(?=[\W_])|$)", "[REDACTED_SSN]"),
    (r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", "[REDACTED_PHONE]"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[REDACTED_EMAIL]"),
    (r"\b(?:MRN|mrn)[:\s#-]*[A-Za-z0-9]{5,15}\b", "[REDACTED_MRN]"),
]
# What texts must not show where no personal data may stand, in the order of replacement.
PERSONAL_PATTERNS = [
    (r"(?i)\b(?:MRN|mrn|MEDREC|PatientID)[:\s#-]*[A-Za-z0-9]{4,15}\b", "[REDACTED_MRN]"),
    (r"(?i)\b(?:DOB|dob|Date of Birth|birth date)[:\s#-]*\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}\b", "[REDACTED_DOB]"),
    (r"(?i)\b(?:patient(?:\s+name)?|member(?:\s+name)?|patient_name|member_name)[:\s]+[A-Za-z]+(?:\s+[A-Za-z]+)+\b", "[REDACTED_NAME]"),
    (r"(?i)\b\d{1,5}\s+[A-Za-z0-9\s,.'-]{3,35}\s+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Way|Court|Ct|Circle|Cir|Terrace|Ter|Place|Pl|Trail|Trl|Parkway|Pkwy|Highway|Hwy)\b", "[REDACTED_ADDRESS]"),
    (r"(?i)\b(?:ZIP(?:code)?|postal(?:\s*code)?)[:\s#-]*\d{5}(?:-\d{4})?\b|\b\d{5}-\d{4}\b", "[REDACTED_ZIP]"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[REDACTED_EMAIL]"),
    (r"(?:(?<=[\s,;:()\[\]\-])|^)(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}(?:(?=[\s,;:()\[\].\-])|$)", "[REDACTED_PHONE]"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "[REDACTED_SSN]"),
    (r"(?:(?<=[\W_])|^)\d{9}(?:(?=[\W_])|$)", "[REDACTED_SSN]"),
]
# What differs between like failures, in the order of replacement.
FAILURE_PATTERNS = [
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<UUID>"),
    (r"0x[0-9a-fA-F]+", "<HEX_ADDR>"),
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?", "<TS>"),
    (r"(?i)(?:row|line|record)\s*#?\d+", "row <NUM>"),
    (r"(?i)(?:[A-Za-z]:[\\/]|/(?:home|var|tmp|app|etc|usr)/)[^\s'\"\)\]\}]+", "<PATH>"),
]


def ascii_classes(pattern: str) -> str:
    r"""The pattern with \b and \s as RE2 and DuckDB have them: letters, digits and blanks of ASCII only, whatever the Java release.

    For patterns of OPERATIONAL_PATTERNS' kind: \b stands at their ends only, beside letters and digits, and \s within brackets only.
    """
    pattern = re.sub(r"^\\b", "(?<![0-9A-Za-z_])", re.sub(r"\\b$", "(?![0-9A-Za-z_])", pattern))
    if r"\b" in pattern:
        raise ValueError(f"\\b inside a pattern: {pattern!r}")
    return pattern.replace(r"\s", r"\t\n\f\r ")


def replace_all(c: Column, patterns: list[tuple[str, str]], ascii_only: bool = False) -> Column:
    """Each pattern's matches replaced by its mark; classes and cases are those of Unicode, or of ASCII (see ascii_classes())."""
    for pattern, mark in patterns:
        c = F.regexp_replace(c, ascii_classes(pattern) if ascii_only else "(?U)" + pattern, mark)
    return c


def redact(c: Column, ascii_only: bool = False) -> Column:
    """File names and operational messages without numbers of persons, telephones and mail addresses; blank text is null. ascii_only: words end at any letter beyond ASCII, as in DuckDB's patterns."""
    marked = F.when(c.rlike(r"(?U)[\d@]|MRN|mrn"), replace_all(c, OPERATIONAL_PATTERNS, ascii_only)).otherwise(c)  # each pattern needs one of these
    return F.nullif(marked, F.lit(""))


def scrub(c: Column) -> Column:
    """Any text without personal data: numbers, birth dates, names behind their labels, addresses, postal codes, mail, telephones; null is empty."""
    some = c.rlike(r"(?iU)[\d@]|mrn|medrec|patient|member")  # each pattern needs one of these
    return F.when(some, replace_all(c, PERSONAL_PATTERNS)).otherwise(F.coalesce(c, F.lit("")))


def scrub_all(c: Column) -> Column:
    """scrub() on each text of an array."""
    return F.transform(c, scrub)


def failure_signature(c: Column) -> Column:
    """A failure message without what differs between like failures, then without personal data; null and empty ones are UnknownError."""
    plain = F.regexp_replace(trim_ws(scrub(replace_all(c, FAILURE_PATTERNS))), r"(?U)\s+", " ")
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("UnknownError")).otherwise(plain)


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def failure_hash(category: Column, error_class: Column, signature: Column, stage: Column) -> Column:
    """SHA-256 of the failure's coordinates as JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(category.alias("cat"), error_class.alias("cls"), F.left(signature, F.lit(255)).alias("sig"), stage.alias("stg"), F.lit(1).alias("v"))), 256)


def glob_to_regex(pattern: str) -> str:
    """A file name pattern with * ? [..] as a regular expression for the whole name."""
    import fnmatch

    return "^(?:" + fnmatch.translate(pattern).removeprefix("(?s:").replace(")\\Z", "").replace(")\\z", "") + ")$"


def date_pattern(fmt: str) -> str:
    """YYYY/MM/DD tokens or strptime codes as a Spark pattern that takes one-digit months and days; other codes are an error."""
    for code, ours in (("%Y", "yyyy"), ("%y", "yy"), ("%m", "M"), ("%b", "MMM"), ("%B", "MMMM"), ("%d", "d"), ("%j", "D"), ("%H", "H"), ("%I", "h"), ("%p", "a"), ("%M", "m"), ("%S", "s"), ("%z", "xx"), ("YYYY", "yyyy"), ("MM", "M"), ("DD", "d")):
        if code != "MM" or "MMM" not in fmt:
            fmt = fmt.replace(code, ours)
    if "%" in fmt:
        raise ValueError(f"no such code: {fmt!r}")
    return fmt


def to_date(c: Column, fmt: str = "%Y-%m-%d") -> Column:
    return F.try_to_timestamp(c, F.lit(date_pattern(fmt))).cast("date")


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(c: Column) -> Column:
    """The text in Unicode's compatibility form; ASCII texts, which are in it already, don't leave the JVM."""
    ascii_only = c.rlike(r"^\p{ASCII}*$")
    return F.when(ascii_only, c).otherwise(_nfkc(F.when(~ascii_only, c)))


def canonical_source(key: bytes, system: Column, identifier: Column) -> tuple[Column, Column]:
    """Keyed hash of SYSTEM::IDENTIFIER, and why there is none: an empty part, a colon in the system, or :: in the identifier.

    Both parts are brought to compatibility form, trimmed and upper-cased; white space within the system is one blank, leading
    zeros of the identifier stay.
    """
    own_system, own_id = collapse(nfkc(system)), F.upper(trim_ws(nfkc(identifier)))
    error = (
        F.when(blank_to_null(system).isNull(), "EMPTY_SYSTEM").when(blank_to_null(identifier).isNull(), "EMPTY_IDENTIFIER")
        .when(own_system.contains(":"), "COLON_IN_SYSTEM").when(own_id.contains("::"), "DELIMITER_IN_IDENTIFIER")
    )
    return F.when(error.isNull(), hmac_sha256(key, F.concat(F.coalesce(own_system, F.lit("")), F.lit("::"), own_id))), error
