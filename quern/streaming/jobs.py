"""Event-time jobs on Structured Streaming. Each reads a folder or file of Parquet as a stream and ends with what is there.

State and output go to the cluster's shared checkpoint folder, so a job that loses executors, or the driver, resumes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.events import sessions, tumbling_counts
from quern.session import shared_folder
from quern.sources import with_event_time

LATENESS = "1 hour"


def event_stream(spark: SparkSession, path: str, time: str = "ts", lateness: str = LATENESS) -> DataFrame:
    parent, _, name = path.rpartition("/")
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{parent}/{{{name},{name}/*}}")
    return with_event_time(stream, time).withWatermark(time, lateness)


def run_to_end(stream: DataFrame) -> DataFrame:
    """Append everything available to a Parquet table in the shared folder and return that table."""
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession, "stream")
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def _zoneless(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def stream_tumbling(spark: SparkSession, path: str) -> DataFrame:
    """Counts per day and type, of the days that the watermark has closed."""
    return _zoneless(run_to_end(tumbling_counts(event_stream(spark, path), "ts", "1 day", ["event_type"], "value")), "window_start", "window_end")


def stream_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Sessions per user that the watermark has closed."""
    return _zoneless(run_to_end(sessions(event_stream(spark, path), "ts", "6 hours", "user_id")), "first", "last")


def stream_deduplicated(spark: SparkSession, path: str) -> DataFrame:
    """The first event of each id within the watermark."""
    events = event_stream(spark, path).select("event_id", "ts", "user_id", "event_type", "value")
    return _zoneless(run_to_end(events.dropDuplicatesWithinWatermark(["event_id"])), "ts")
