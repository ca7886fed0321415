"""Registered queries on the relational tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import change, drawdown, per_unit_price
from quern.operators.bars import breakouts, filled_weeks, price_bars, relative_strength, trailing_mean, trend_runs
from quern.operators.events import asof_join, sessions, top_per_key, tumbling_counts
from quern.sources import read_table
from quern.streaming.jobs import stream_deduplicated, stream_sessions, stream_tumbling

def _price():
    return per_unit_price("l_extendedprice", "l_quantity")



def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"))
    return read_table(spark, sf_dir, "lineitem").join(parts, "l_partkey")


def weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price_bars(_ticks(spark, sf_dir), "brand", "l_shipdate", _price(), F.col("l_quantity"), ["l_shipdate", "l_orderkey", "l_linenumber"])


def weekly_trailing_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trailing_mean(weekly_bars(spark, sf_dir), "brand", "week", "close", 30).select("brand", "week", "close", "trailing_mean")


def weekly_breakouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breakouts(weekly_bars(spark, sf_dir), "brand", "week", 10).select("brand", "week", "close", "prior_high")


def weekly_relative_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    week = F.to_date(F.date_trunc("week", "l_shipdate")).alias("week")
    market = read_table(spark, sf_dir, "lineitem").groupBy(week).agg(F.avg(_price()).alias("mean_price"))
    return relative_strength(weekly_bars(spark, sf_dir), market, "week").select("brand", "week", "close", "relative_strength")


def weekly_trend_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend_runs(weekly_bars(spark, sf_dir), "brand", "week")


def weekly_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filled_weeks(weekly_bars(spark, sf_dir), "brand")


def weekly_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = Window.partitionBy("brand").orderBy("week")
    columns = {"change": F.round(change("close", ordered), 6), "drawdown": F.round(drawdown("close", ordered), 6)}
    return weekly_bars(spark, sf_dir).withColumns(columns).select("brand", "week", "close", "change", "drawdown")


def sliding_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tumbling_counts(read_table(spark, sf_dir, "events"), "ts", "1 day", ["event_type"], "value", slide="6 hours")


def clicks_after_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    clicks = events.where("event_type = 'click'").select("event_id", "ts", "user_id")
    purchases = events.where("event_type = 'purchase'").select("event_id", "ts", "user_id", "value")
    return asof_join(clicks, purchases, "user_id", "ts", ["event_id", "value"])


def daily_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tumbling_counts(read_table(spark, sf_dir, "events"), "ts", "1 day", ["event_type"], "value")


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(read_table(spark, sf_dir, "events"), "ts", "6 hours", "user_id")


def top_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    return top_per_key(events, ["event_type"], [F.desc("value"), F.col("event_id")], 3)


def streamed_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_tumbling(spark, f"{sf_dir}/events.parquet")


def streamed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_sessions(spark, f"{sf_dir}/events.parquet")


def streamed_distinct_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_deduplicated(spark, f"{sf_dir}/events.parquet")


QUERIES = {
    f.__name__: f
    for f in (
        weekly_bars,
        weekly_trailing_mean,
        weekly_breakouts,
        weekly_relative_strength,
        weekly_trend_runs,
        weekly_filled,
        weekly_changes,
        sliding_event_counts,
        clicks_after_purchase,
        daily_event_counts,
        user_sessions,
        top_events,
        streamed_daily_counts,
        streamed_sessions,
        streamed_distinct_events,
    )
}

_BARS = """
    WITH ticks AS (
        SELECT p_brand AS brand, CAST(date_trunc('week', l_shipdate) AS DATE) AS week,
               l_extendedprice / l_quantity AS price, l_quantity,
               struct_pack(d := l_shipdate, o := l_orderkey, n := l_linenumber, p := l_extendedprice / l_quantity) AS place
        FROM lineitem JOIN part ON l_partkey = p_partkey
    ), bars AS (
        SELECT brand, week, arg_min(price, place) AS open, max(price) AS high, min(price) AS low,
               arg_max(price, place) AS close, sum(l_quantity) AS volume
        FROM ticks GROUP BY brand, week
    )
"""

_CLOSED = "date_trunc('day', ts) < (SELECT date_trunc('day', max(ts)) FROM events)"

ORACLE_SQL = {
    "weekly_bars": _BARS + "SELECT * FROM bars",
    "weekly_trailing_mean": _BARS
    + "SELECT brand, week, close, round(avg(close) OVER (PARTITION BY brand ORDER BY week ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 6) AS trailing_mean FROM bars",
    "weekly_breakouts": _BARS
    + "SELECT * FROM (SELECT brand, week, close, max(high) OVER (PARTITION BY brand ORDER BY week ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS prior_high FROM bars) WHERE close > prior_high",
    "weekly_relative_strength": _BARS
    + ", market AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS week, avg(l_extendedprice / l_quantity) AS mean_price FROM lineitem GROUP BY 1)"
    + "SELECT brand, week, close, round(close / mean_price, 6) AS relative_strength FROM bars JOIN market USING (week)",
    "weekly_trend_runs": _BARS
    + """
    , moves AS (
        SELECT brand, week, close > lag(close) OVER (PARTITION BY brand ORDER BY week) AS rising FROM bars
    ), numbered AS (
        SELECT brand, week, rising,
               row_number() OVER (PARTITION BY brand ORDER BY week) - row_number() OVER (PARTITION BY brand, rising ORDER BY week) AS run
        FROM moves WHERE rising IS NOT NULL
    )
    SELECT brand, rising, min(week) AS first, max(week) AS last, count(*) AS length FROM numbered GROUP BY brand, rising, run
    """,
    "weekly_filled": _BARS
    + """
    , weeks AS (
        SELECT brand, CAST(unnest(generate_series(min(week), max(week), INTERVAL 7 DAYS)) AS DATE) AS week FROM bars GROUP BY brand
    ), wide AS (
        SELECT brand, week, open, high, low, volume, last_value(close IGNORE NULLS) OVER (PARTITION BY brand ORDER BY week) AS close
        FROM weeks LEFT JOIN bars USING (brand, week)
    )
    SELECT brand, week, coalesce(open, close) AS open, coalesce(high, close) AS high, coalesce(low, close) AS low, close, coalesce(volume, 0) AS volume
    FROM wide
    """,
    "weekly_changes": _BARS
    + """
    SELECT brand, week, close, round(close / lag(close) OVER w - 1, 6) AS change,
           round(1 - close / max(close) OVER (PARTITION BY brand ORDER BY week ROWS UNBOUNDED PRECEDING), 6) AS drawdown
    FROM bars WINDOW w AS (PARTITION BY brand ORDER BY week)
    """,
    "sliding_event_counts": """
        SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total
        FROM (SELECT time_bucket(INTERVAL 6 HOURS, ts) - to_hours(6 * k) AS window_start, event_type, value FROM events, range(4) AS r(k))
        GROUP BY ALL
    """,
    "clicks_after_purchase": """
        SELECT c.event_id, c.ts, c.user_id, p.event_id AS last_event_id, p.value AS last_value
        FROM (SELECT * FROM events WHERE event_type = 'click') c
        ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON c.user_id = p.user_id AND c.ts >= p.ts
    """,
    "daily_event_counts": """
        SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, event_type,
               count(*) AS n, round(sum(value), 4) AS total
        FROM events GROUP BY ALL
    """,
    "user_sessions": """
        SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n
        FROM (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS session
              FROM (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS starts FROM events))
        GROUP BY user_id, session
    """,
    "top_events": """
        SELECT * FROM (SELECT event_type, event_id, value, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS INTEGER) AS rank FROM events)
        WHERE rank <= 3
    """,
    "streamed_daily_counts": f"""
        SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, event_type,
               count(*) AS n, round(sum(value), 4) AS total
        FROM events WHERE {_CLOSED} GROUP BY ALL
    """,
    "streamed_sessions": """
        SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n
        FROM (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS session
              FROM (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS starts FROM events))
        GROUP BY user_id, session
        HAVING max(ts) + INTERVAL 6 HOURS <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR
    """,
    "streamed_distinct_events": "SELECT DISTINCT event_id, ts, user_id, event_type, value FROM events",
}
