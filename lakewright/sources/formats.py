"""Readers and writers by format, each with its schema given, and a generated source."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Options that make a format keep types and nulls through a round trip.
OPTIONS = {
    "parquet": {},
    "orc": {},
    "json": {"ignoreNullFields": "false"},
    "csv": {"header": "true", "escape": '"', "nullValue": "\\N", "emptyValue": ""},
    "xml": {"rowTag": "row", "rootTag": "rows", "nullValue": "\\N"},
    "avro": {},
}


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).format(kind).options(**OPTIONS.get(kind, {}))
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def read(spark: SparkSession, path: str, kind: str = "parquet", schema=None) -> DataFrame:
    """Text formats need a schema: inference reads everything twice and reorders or widens columns."""
    if kind in ("csv", "json", "xml") and schema is None:
        raise ValueError(f"{kind} has no types of its own: give a schema")
    reader = spark.read.format(kind).options(**OPTIONS.get(kind, {}))
    df = (reader.schema(schema) if schema is not None else reader).load(path)
    return df.select(*[f.name for f in schema]) if hasattr(schema, "fields") else df


def available(spark: SparkSession, kind: str) -> bool:
    """Whether this installation has a format (avro comes in a package of its own)."""
    try:
        spark._jvm.org.apache.spark.sql.execution.datasources.DataSource.lookupDataSource(kind, spark._jsparkSession.sessionState().conf())
        return True
    except Exception:
        return False


def jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A table of another database, read in parts of a numeric column where its bounds are given. The driver's jar is the caller's."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column and bounds:
        reader = reader.options(partitionColumn=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


class Squares(DataSource):
    """Generated rows (n, square), in parts: a template for sources of one's own. Options: rows, parts."""

    @classmethod
    def name(cls) -> str:
        return "squares"

    def schema(self) -> str:
        return "n bigint, square bigint"

    def reader(self, schema) -> DataSourceReader:
        return SquaresReader(int(self.options.get("rows", 100)), int(self.options.get("parts", 4)))


class SquaresReader(DataSourceReader):
    def __init__(self, rows: int, parts: int):
        self.rows, self.parts = rows, parts

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(self.parts)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for n in range(partition.value, self.rows, self.parts):
            yield n, n * n
