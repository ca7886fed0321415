"""Readers and writers of the tables; paths go to Spark's own readers, so any store that Spark can open will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, root: str, name: str, fmt: str = "parquet", **options: str) -> DataFrame:
    return spark.read.options(**options).format(fmt).load(f"{root}/{name}.{fmt}")


def write_table(df: DataFrame, root: str, name: str, fmt: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    df.write.format(fmt).mode(mode).partitionBy(*partition_by).save(f"{root}/{name}.{fmt}")


def with_event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """``withWatermark`` refuses timestamps without a zone; read them in the session's zone."""
    return df.withColumn(column, F.col(column).cast("timestamp"))
