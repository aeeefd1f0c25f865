"""Integrity audits: frames of rows that break a constraint, empty where all is sound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def orphans(children: DataFrame, parents: DataFrame, key: str, same: list[str]) -> DataFrame:
    """children, with why, whose parent (key once each) is missing (NO_PARENT) or differs in one of the columns `same` (MISMATCH).

    Nulls are equal to nulls; a child with a null key has no parent.
    """
    p = parents.select(F.col(key), F.lit(True).alias("_there"), *[F.col(c).alias(f"_{c}") for c in same])
    differs = F.lit(False)
    for c in same:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    why = F.when(F.col("_there").isNull(), "NO_PARENT").when(differs, "MISMATCH")
    return children.join(p, key, "left").withColumn("why", why).where("why is not null").select(*children.columns, "why")


def row_id_problem(c: Column) -> Column:
    """True for an id of a row that is neither row_<number>_<16 hex digits> nor a UUID; a null is none."""
    return ~F.coalesce(c.rlike(r"^row_[0-9]+_[0-9a-f]{16}$") | c.rlike(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), F.lit(False))
