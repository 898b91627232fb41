"""Scalar expressions whose meaning is fixed where engines differ, as columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0))


def join_text(*parts: Column) -> Column:
    """Concatenation that takes null for an empty text."""
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def day_of_week(d: Column) -> Column:
    """0 for Sunday to 6 for Saturday."""
    return F.dayofweek(d) - 1


def half_up(x: Column) -> Column:
    """The nearest integer, halves away from zero."""
    return F.when(x >= 0, F.floor(x + 0.5)).otherwise(F.ceil(x - 0.5)).cast("bigint")


def exact_sum(x: Column, scale: int = 4) -> Column:
    """A sum of doubles that doesn't depend on their order: over decimals."""
    return F.sum(x.cast(f"decimal(18,{scale})")).cast("double")


def exact_avg(x: Column, scale: int = 4) -> Column:
    return exact_sum(x, scale) / F.count(x)


def guarded_log(x: Column) -> Column:
    """The natural logarithm, null where there is none."""
    return F.when(x > 0, F.ln(x))


def dot(a: Column, b: Column) -> Column:
    """The inner product of two arrays of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
