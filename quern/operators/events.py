"""Operators on event streams kept as tables: as-of join, tumbling and session windows, top rows per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, carry: list[str], prefix: str = "last_", stretch: str = "day") -> DataFrame:
    """Each row of ``left`` with the latest row of ``right`` of the same key at or before its time, or nulls.

    The columns of ``carry`` come from that one row, nulls included. Of rows of ``right`` with the same time the one with
    the largest values in ``carry`` counts. Rows with a null key or time match nothing; those of ``left`` are returned.

    Times are dealt into stretches (a unit of ``date_trunc``). A window runs within a key's stretch, and another over one
    row a stretch hands on what came before, so a key with a third of all rows is spread over as many groups as it has
    stretches.
    """
    names, usable = left.columns, F.col(key).isNotNull() & F.col(time).isNotNull()
    seen = F.struct(F.col(time).alias("__at"), *(F.col(c).alias(f"__{c}") for c in carry))
    rows = F.struct(*names)
    shared = [F.col(key).alias("__key"), F.col(time).alias("__time"), F.date_trunc(stretch, F.col(time)).alias("__stretch")]
    known = right.where(usable).select(*shared, F.lit(None).cast(left.select(rows).schema[0].dataType).alias("__left"), seen.alias("__seen"))
    asked = left.where(usable).select(*shared, rows.alias("__left"), F.lit(None).cast(known.schema["__seen"].dataType).alias("__seen"))
    # Both uses need all columns of the union, so Spark shuffles it once and reads that exchange twice.
    both = known.union(asked).repartition("__key", "__stretch")
    totals = both.groupBy("__key", "__stretch").agg(
        F.max("__seen").alias("__total"),
        F.min(F.when(F.col("__left").isNotNull(), F.col("__time"))).alias("__asked"),
        F.min(F.when(F.col("__seen").isNotNull(), F.col("__time"))).alias("__known"),
    )
    earlier = Window.partitionBy("__key").orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    handed = totals.withColumn("__handed", F.max("__total").over(earlier))
    # Only rows before the first known one of their stretch need what came before it.
    handed = handed.where("__handed is not null and (__asked < __known or (__asked is not null and __known is null))").select("__key", "__stretch", "__handed")
    upto = Window.partitionBy("__key", "__stretch").orderBy("__time").rangeBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("__near", F.max("__seen").over(upto)).where("__left is not null")
    found = near.join(handed, ["__key", "__stretch"], "left").withColumn("__last", F.coalesce("__near", "__handed"))
    matched = found.select("__left.*", *(F.col(f"__last.__{c}").alias(f"{prefix}{c}") for c in carry))
    alone = left.where(~usable).select(*names, *(F.lit(None).cast(right.schema[c].dataType).alias(f"{prefix}{c}") for c in carry))
    return matched.unionByName(alone)


def tumbling_counts(events: DataFrame, time: str, width: str, by: list[str], value: str, slide: str | None = None) -> DataFrame:
    """Count and total per window and key; with ``slide`` the windows overlap and a row counts in each that holds it."""
    return (
        events.groupBy(F.window(time, width, slide), *by)
        .agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "n", "total")
    )


def sessions(events: DataFrame, time: str, gap: str, key: str) -> DataFrame:
    return (
        events.groupBy(key, F.session_window(time, gap))
        .agg(F.count("*").alias("n"), F.min(time).alias("first"), F.max(time).alias("last"))
        .select(key, "first", "last", "n")
    )


def top_per_key(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each key; Spark keeps only ``k`` rows per key and task before the shuffle."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)
