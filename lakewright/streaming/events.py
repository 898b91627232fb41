"""Structured Streaming over the events table. Timestamps are cast first: a watermark needs a time zone."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_of(spark: SparkSession, path: str, schema, delay: str = "1 hour") -> DataFrame:
    """The rows of a folder that others add files to."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def stream(spark: SparkSession, sf_dir: str, name: str = "events", delay: str = "1 hour", files: int = 1) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    read = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", files).parquet(sf_dir)
    return read.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def settled(df: DataFrame, path: str | None = None, mode: str = "complete") -> DataFrame:
    """All that is there now, run to its end. Without a path complete results (a few rows) go to a table in memory; with one, Parquet takes what each batch gives, and none of it passes the driver."""
    spark = df.sparkSession
    if path:
        batches_into(df, path, mode)
        found = spark.read.parquet(path)
        return (found.where(F.col("batch") == found.agg(F.max("batch")).first()[0]) if mode == "complete" else found).drop("batch")
    name = f"stream_{uuid.uuid4().hex}"
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.table(name)


def tumbling(events: DataFrame, width: str = "1 day") -> DataFrame:
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))


def sliding(events: DataFrame, width: str = "1 day", step: str = "6 hours") -> DataFrame:
    return events.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def first_of_users(events: DataFrame) -> DataFrame:
    return events.dropDuplicatesWithinWatermark(["user_id", "event_type"])


def purchases_after_clicks(clicks: DataFrame, purchases: DataFrame, within: str = "1 hour") -> DataFrame:
    """A stream-stream join; the time range lets either side's state go."""
    c = clicks.where("event_type = 'click'").select(F.col("user_id").alias("c_user"), F.col("ts").alias("c_ts"), F.col("event_id").alias("click_id"))
    p = purchases.where("event_type = 'purchase'").select(F.col("user_id").alias("p_user"), F.col("ts").alias("p_ts"), F.col("event_id").alias("purchase_id"))
    return c.join(p, F.expr(f"c_user = p_user AND p_ts >= c_ts AND p_ts < c_ts + INTERVAL {within}")).select("click_id", "purchase_id")


def with_customers(events: DataFrame, customers: DataFrame) -> DataFrame:
    """A stream-static join."""
    return events.join(customers, F.col("user_id") == F.col("c_custkey"))


def running_counts(events: DataFrame) -> DataFrame:
    """State of one's own: each user's events so far, given out whenever it changes."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total = state.get[0] if state.exists else 0
        total += sum(len(b) for b in batches)
        state.update((total,))
        yield pd.DataFrame({"user_id": [key[0]], "n": [total]})

    return events.groupBy("user_id").applyInPandasWithState(update, "user_id long, n long", "n long", "update", GroupStateTimeout.NoTimeout)


def batches_into(df: DataFrame, path: str, mode: str = "append") -> None:
    """foreachBatch: each micro-batch in a folder named by its number, so that a repeated batch overwrites itself. Its state is kept beside path: called again, it goes on from there."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
