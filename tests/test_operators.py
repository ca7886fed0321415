import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import change, drawdown, per_unit_price
from quern.operators.bars import breakouts, filled_weeks, price_bars, trailing_mean, trend_runs
from quern.operators.events import asof_join, sessions, top_per_key, tumbling_counts
from quern.sources import read_table, write_table

START = datetime(2024, 1, 1)


def hours(*values):
    return [START + timedelta(hours=h) for h in values]


def test_asof_join_takes_the_row_at_the_same_time_and_keeps_unmatched_rows(spark):
    left = spark.createDataFrame([(1, t, f"l{i}") for i, t in enumerate(hours(0, 2, 5))] + [(2, START, "x")], "k int, ts timestamp, name string")
    right = spark.createDataFrame([(1, t, v) for t, v in zip(hours(2, 3), (10, 20), strict=True)], "k int, ts timestamp, v int")
    got = {r["name"]: r["last_v"] for r in asof_join(left, right, "k", "ts", ["v"]).collect()}
    assert got == {"l0": None, "l1": 10, "l2": 20, "x": None}


def test_asof_join_of_empty_tables(spark):
    none = spark.createDataFrame([], "k int, ts timestamp, v int")
    assert asof_join(none, none, "k", "ts", ["v"]).count() == 0


def test_a_gap_of_just_the_width_does_not_end_a_session(spark):
    events = spark.createDataFrame([(1, t) for t in hours(0, 5, 11, 20)], "u int, ts timestamp")
    got = sorted((r["first"], r["n"]) for r in sessions(events, "ts", "6 hours", "u").collect())
    assert got == [(hours(0)[0], 3), (hours(20)[0], 1)]


def test_tumbling_counts_and_top_rows(spark):
    events = spark.createDataFrame([(t, "a", float(i)) for i, t in enumerate(hours(0, 23, 24))], "ts timestamp, kind string, v double")
    assert sorted(r["n"] for r in tumbling_counts(events, "ts", "1 day", ["kind"], "v").collect()) == [1, 2]
    assert [r["v"] for r in top_per_key(events, ["kind"], [F.desc("v")], 2).orderBy("rank").collect()] == [2.0, 1.0]


def test_bars_and_indicators(spark):
    ticks = spark.createDataFrame(
        [("k", START + timedelta(days=7 * w), p, 1.0) for w, p in enumerate((10.0, 12.0, 11.0, 15.0))] + [("k", START + timedelta(hours=1), 9.0, 2.0)],
        "brand string, ts timestamp, p double, q double",
    )
    bars = price_bars(ticks, "brand", "ts", F.col("p"), F.col("q"), ["ts"])
    first = bars.orderBy("week").first()
    assert (first["open"], first["high"], first["low"], first["close"], first["volume"]) == (10.0, 10.0, 9.0, 9.0, 3.0)
    assert [r["trailing_mean"] for r in trailing_mean(bars, "brand", "week", "close", 2).orderBy("week").collect()] == [9.0, 10.5, 11.5, 13.0]
    assert [r["close"] for r in breakouts(bars, "brand", "week", 2).orderBy("week").collect()] == [12.0, 15.0]
    assert sorted((r["rising"], r["length"]) for r in trend_runs(bars, "brand", "week").collect()) == [(False, 1), (True, 1), (True, 1)]


def test_tables_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    for fmt in ("parquet", "orc", "json"):
        write_table(rows, str(tmp_path), "rows", fmt)
        assert sorted(map(tuple, read_table(spark, str(tmp_path), "rows", fmt).select("k", "v").collect())) == [(1, "a"), (2, "b")]
    write_table(rows, str(tmp_path), "parts", partition_by=("k",))
    assert read_table(spark, str(tmp_path), "parts").where("k = 2").count() == 1


def test_weeks_without_ticks_repeat_the_last_close(spark):
    bars = spark.createDataFrame([("k", START.date(), 1.0, 3.0, 1.0, 2.0, 5.0), ("k", (START + timedelta(days=21)).date(), 4.0, 4.0, 4.0, 4.0, 1.0)], "brand string, week date, open double, high double, low double, close double, volume double")
    rows = filled_weeks(bars, "brand").orderBy("week").collect()
    assert [(r["open"], r["close"], r["volume"]) for r in rows] == [(1.0, 2.0, 5.0), (2.0, 2.0, 0.0), (2.0, 2.0, 0.0), (4.0, 4.0, 1.0)]


def test_change_drawdown_and_prices_of_zero_quantities(spark):
    rows = spark.createDataFrame([("k", i, float(v), float(i)) for i, v in enumerate((10, 5, 0, 20))], "k string, i int, v double, q double")
    ordered = Window.partitionBy("k").orderBy("i")
    got = rows.select("i", change("v", ordered).alias("c"), drawdown("v", ordered).alias("d"), per_unit_price("v", "q").alias("p")).orderBy("i").collect()
    assert [r["c"] for r in got] == [None, -0.5, -1.0, None]
    assert [r["d"] for r in got] == [0.0, 0.5, 1.0, 0.0]
    assert [r["p"] for r in got][:2] == [None, 5.0]


def test_sliding_windows_count_a_row_in_each_that_holds_it(spark):
    events = spark.createDataFrame([(START, "a", 1.0)], "ts timestamp, kind string, v double")
    assert tumbling_counts(events, "ts", "1 day", ["kind"], "v", slide="6 hours").count() == 4


@pytest.mark.parametrize("stretch", ["day", "year"])
def test_asof_join_carries_one_row_whole(spark, stretch):
    left = spark.sql("select * from values (1, timestamp'2024-01-05 10:00', 'a'), (1, timestamp'2024-01-01 00:00', 'b'), (null, timestamp'2024-01-05 10:00', 'c'), (2, null, 'd'), (2, timestamp'2024-01-02 05:00', 'e'), (1, timestamp'2024-01-05 10:00', 'a') as t(k, ts, x)")
    right = spark.sql("select * from values (1, timestamp'2024-01-02 00:00', 10, 1.0D), (1, timestamp'2024-01-03 00:00', 20, null), (1, timestamp'2024-01-06 00:00', 30, 3.0D), (null, timestamp'2024-01-01 00:00', 40, 4.0D), (2, timestamp'2024-01-02 05:00', 50, 5.0D), (2, timestamp'2024-01-02 05:00', 60, null), (2, null, 70, 7.0D) as t(k, ts, id, v)")
    got = {(r["x"], r["last_id"], r["last_v"]) for r in asof_join(left, right, "k", "ts", ["id", "v"], stretch=stretch).collect()}
    assert got == {("a", 20, None), ("b", None, None), ("c", None, None), ("d", None, None), ("e", 60, None)}
    assert asof_join(left, right, "k", "ts", ["id", "v"], stretch=stretch).count() == 6
    assert asof_join(left.limit(0), right, "k", "ts", ["id"]).collect() == [] and asof_join(left, right.limit(0), "k", "ts", ["id"]).count() == 6


@pytest.mark.parametrize("stretch", ["hour", "day", "month"])
def test_asof_join_against_every_earlier_row(spark, stretch):
    rng = random.Random(3)
    moment = lambda: START + timedelta(hours=rng.randrange(0, 24 * 40, 5))
    left = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([moment(), moment(), moment(), None]), i) for i in range(150)]
    right = [(rng.choice([1, 1, 2, 4, None]), rng.choice([moment(), moment(), moment(), None]), rng.choice([None, 1, 2, 3])) for i in range(60)]
    found = asof_join(spark.createDataFrame(left, "k int, ts timestamp, x int"), spark.createDataFrame(right, "k int, ts timestamp, v int"), "k", "ts", ["v"], stretch=stretch)

    def latest(key, time):
        earlier = [(at, v is not None, v or 0) for k, at, v in right if None not in (key, time, k, at) and k == key and at <= time]
        return (max(earlier)[2] or None) if earlier else None

    assert sorted((r["x"], r["last_v"] or 0) for r in found.collect()) == sorted((x, latest(k, t) or 0) for k, t, x in left)
