"""Session factory and table loader."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

#: Tables of the star schema and of the text corpora.
TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def session(app: str = "lakewright", cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with UTC time, ANSI errors and adaptive execution; on a cluster pass the master through spark-submit."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if "PYSPARK_SUBMIT_ARGS" not in os.environ:
        builder = builder.master(f"local[{cores}]").config("spark.driver.memory", os.environ.get("LAKEWRIGHT_DRIVER_MEMORY", "4g"))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Expose tables as temporary views for SQL text."""
    for name in names or TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
