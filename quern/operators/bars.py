"""Price bars and the indicators computed from them, all as grouped aggregates and windows over one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def price_bars(ticks: DataFrame, key: str, time: str, price: Column, volume: Column, order: list[str], unit: str = "week") -> DataFrame:
    """Open, high, low, close and volume per key and calendar unit. ``order`` must decide which tick is first and last."""
    sequence = F.struct(*order, price.alias("__p"))
    return (
        ticks.groupBy(key, F.to_date(F.date_trunc(unit, time)).alias(unit))
        .agg(
            F.min_by(price, sequence).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, sequence).alias("close"),
            F.sum(volume).alias("volume"),
        )
    )


def trailing_mean(bars: DataFrame, key: str, time: str, value: str, rows: int, digits: int = 6) -> DataFrame:
    """``trailing_mean``: the mean of ``value`` over this row and the ``rows - 1`` before it."""
    frame = Window.partitionBy(key).orderBy(time).rowsBetween(1 - rows, 0)
    return bars.withColumn("trailing_mean", F.round(F.avg(value).over(frame), digits))


def breakouts(bars: DataFrame, key: str, time: str, rows: int) -> DataFrame:
    """Rows that close above the highest high of the ``rows`` before them; the first row of a key never does."""
    frame = Window.partitionBy(key).orderBy(time).rowsBetween(-rows, -1)
    return bars.withColumn("prior_high", F.max("high").over(frame)).where(F.col("close") > F.col("prior_high"))


def relative_strength(bars: DataFrame, all_bars: DataFrame, time: str, digits: int = 6) -> DataFrame:
    """``close`` over the mean price of the same period in ``all_bars`` (columns ``time`` and ``mean_price``)."""
    return bars.join(all_bars, time).withColumn("relative_strength", F.round(F.col("close") / F.col("mean_price"), digits))


def trend_runs(bars: DataFrame, key: str, time: str) -> DataFrame:
    """Maximal runs of rows that rise, or do not rise, against the row before; the first row of a key starts no run."""
    ordered = Window.partitionBy(key).orderBy(time)
    rising = bars.withColumn("__before", F.lag("close").over(ordered)).where(F.col("__before").isNotNull()).withColumn("rising", F.col("close") > F.col("__before"))
    within = Window.partitionBy(key, "rising").orderBy(time)
    return (
        rising.withColumn("__run", F.row_number().over(ordered) - F.row_number().over(within))
        .groupBy(key, "rising", "__run")
        .agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("length"))
        .drop("__run")
    )


def filled_weeks(bars: DataFrame, key: str, time: str = "week") -> DataFrame:
    """``bars`` with a row for every calendar week between a key's first and last: prices are the last close, volume is 0."""
    spans = bars.groupBy(key).agg(F.min(time).alias("__from"), F.max(time).alias("__to"))
    weeks = spans.select(key, F.explode(F.sequence("__from", "__to", F.expr("interval 7 days"))).alias(time))
    upto = Window.partitionBy(key).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    wide = weeks.join(bars, [key, time], "left").withColumn("__close", F.last("close", ignorenulls=True).over(upto))
    return wide.select(key, time, *(F.coalesce(c, "__close").alias(c) for c in ("open", "high", "low", "close")), F.coalesce("volume", F.lit(0.0)).alias("volume"))
