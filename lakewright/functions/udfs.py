"""The kinds of user-defined functions, vectorised wherever Spark offers it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.udf(T.StringType())
def initials(name: str | None) -> str | None:
    """Row by row: for logic that no column expression or vector has."""
    return None if name is None else "".join(w[0] for w in name.replace("#", " ").split())


@F.pandas_udf(T.DoubleType())
def with_tax(price: pd.Series, tax: pd.Series) -> pd.Series:
    return price * (1 + tax)


@F.pandas_udf(T.DoubleType())
def midrange(x: pd.Series) -> float:
    """An aggregate: the mean of the smallest and the largest."""
    return float((x.min() + x.max()) / 2) if len(x) else float("nan")


@F.udtf(returnType=T.StructType([T.StructField("word", T.StringType()), T.StructField("place", T.IntegerType())]))
class SplitWords:
    """A table function: a row for each word."""

    def eval(self, text: str):
        for k, word in enumerate((text or "").split()):
            yield word, k


def centred(df: DataFrame, key: str, value: str, scale: int = 4) -> DataFrame:
    """A grouped map: each value less its group's mean, over integers of 10**-scale, so that neither the order of rows nor the rounding of sums counts. A group must fit in a task; a window does the same without that limit."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        units = (group[value] * 10**scale).round().astype("int64")
        return group.assign(centred=(units * len(units) - int(units.sum())) / (len(units) * 10**scale))

    return df.select(key, value).groupBy(key).applyInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, {value} double, centred double")


def flagged(df: DataFrame, value: str, above: float) -> DataFrame:
    """A map over batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[batch[value] > above]

    return df.mapInPandas(run, df.schema)


def register(spark: SparkSession) -> None:
    """The functions by name, and one written in SQL."""
    spark.udf.register("initials", initials)
    spark.udf.register("with_tax", with_tax)
    spark.udf.register("midrange", midrange)
    spark.udtf.register("split_words", SplitWords)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION net_price(p DOUBLE, d DOUBLE) RETURNS DOUBLE RETURN p * (1 - d)")
