from datetime import datetime, timedelta

from quern.streaming.jobs import event_stream, run_to_end, stream_deduplicated, stream_tumbling


def test_late_day_is_dropped_and_last_day_held_back(spark, tmp_path):
    path = f"{tmp_path}/events.parquet"
    start = datetime(2024, 1, 1)

    def add(days):
        rows = [(i, start + timedelta(days=d, hours=1), 1, "view", 1.0) for i, d in enumerate(days)]
        spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.mode("append").parquet(path)

    add([0, 1, 2, 2, 3])
    got = sorted((r["window_start"].day, r["n"]) for r in stream_tumbling(spark, path).collect())
    assert got == [(1, 1), (2, 1), (3, 2)]


def test_deduplication_keeps_one_row_an_id(spark, tmp_path):
    path = f"{tmp_path}/events.parquet"
    rows = [(i % 3, datetime(2024, 1, 1), 1, "view", 1.0) for i in range(9)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(path)
    assert stream_deduplicated(spark, path).count() == 3


def test_a_stream_is_read_to_its_end(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    assert run_to_end(event_stream(spark, path).select("event_id")).count() == spark.read.parquet(path).count()
