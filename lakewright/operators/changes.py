"""UPDATE, DELETE, MERGE and constraints over immutable tables: each returns the changed table as a DataFrame.

Nothing is changed in place. The caller writes the result as a new version; there are no
transactions over several statements and no secondary indexes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def update(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    return df.select(*[F.when(where, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def delete(df: DataFrame, where: Column) -> DataFrame:
    """Rows for which where is false or null stay."""
    return df.where(~F.coalesce(where, F.lit(False)))


def merge(target: DataFrame, source: DataFrame, keys: list[str], delete_when: Column | None = None) -> DataFrame:
    """Upsert: source rows replace target rows of their key or are added; delete_when (over source columns) removes the key. source keys must be unique."""
    kept = target.join(source.select(*keys), keys, "left_anti")
    fresh = source if delete_when is None else delete(source, delete_when)
    return kept.unionByName(fresh.select(*target.columns))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Violations of a primary key: keys that repeat or hold a null."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where((F.col("n") > 1) | null)


def nulls_in(df: DataFrame, columns: list[str]) -> DataFrame:
    """Violations of NOT NULL: the number of nulls of each column that has any."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], columns, "column", "nulls").where("nulls > 0")


def missing_parents(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Violations of a foreign key."""
    return child.where(F.col(child_key).isNotNull()).join(parent, F.col(child_key) == F.col(parent_key), "left_anti")
