"""Cleaning of ids, names and value arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_key(c: Column | str) -> Column:
    """The key without spaces at both ends; null for null and blank values, so that they never match."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.trim(c.cast("string"))
    return F.when(t.rlike(r"\S"), t)


def clean_values(c: Column | str) -> Column:
    """Distinct values of an array without spaces at both ends, sorted; null and blank values are dropped; null gives an empty array."""
    c = F.col(c) if isinstance(c, str) else c
    kept = F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x.isNotNull() & x.rlike(r"\S"))
    return F.coalesce(F.array_sort(F.array_distinct(kept)), F.array().cast("array<string>"))
