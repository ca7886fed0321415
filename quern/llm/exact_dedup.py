"""Exact deduplication by progressive refinement: length, then a hash of the prefix, then a hash of the whole text.

Each step looks only at what the step before could not tell apart. The key tables hold one row per length, per prefix of
a length, or per text, of those that occur more than once. They are built by ``groupBy`` with counts and a maximum,
which Spark aggregates before the shuffle, so a group with a third of all rows reaches a reducer as one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import BROADCAST_ROWS, Bitmap, text_or_empty, written


def _repeated(df: DataFrame, key: str, *more: Column) -> DataFrame:
    """The keys that more than one row has, with their number and whatever else is asked for."""
    return written(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"), *more).where("__n > 1"))


def _flagged(df: DataFrame, keys: DataFrame, key: str, flag: str, limit: int) -> DataFrame:
    """``df`` with ``flag``: whether its ``key`` is in ``keys``. Of more than ``limit`` keys a bitmap is broadcast, by which
    some others are flagged too; they only go on to the next step."""
    n = keys.count()
    if n > limit:
        return Bitmap(keys, key, n).marked(df, key, flag)
    found = df.join(F.broadcast(keys.select(key, F.lit(True).alias(flag))), key, "left")
    return found.withColumn(flag, F.coalesce(flag, F.lit(False)))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    carry: Sequence[str] = (),
    prefix_chars: int = 128,
    digest_all: bool = False,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, the columns of ``carry``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when they are identical byte for byte; a null text counts as empty. ``keep_id`` is the largest id
    among the rows with the same text (null only if all their ids are null) and ``kept`` marks the rows that bear it:
    rows that repeat an id with the same text are both kept or both dropped. ``text_sha256`` is null for texts that
    occur once, unless ``digest_all``. Other columns are ignored unless carried. An empty table gives no rows.

    ``broadcast_rows`` bounds each key table that is broadcast as it is; of a larger one a bitmap of bounded size is, and
    the rows are the same. Up to that bound no text or carried column is shuffled; beyond it those of repeated texts
    are, in the last join, which leaves hot texts to Spark's splitting of skewed partitions.
    """
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).alias("__id"),
        F.struct(F.lit(0).alias("__none"), *(F.col(c) for c in carry)).alias("__carry"),
        text.alias("__text"),
        F.octet_length(text).cast("long").alias("__len"),
    )
    by_length = _flagged(rows, _repeated(rows, "__len"), "__len", "__shared", broadcast_rows)
    prefix = F.xxhash64("__len", F.substring("__text", 1, prefix_chars))
    by_length = by_length.withColumn("__prefix", F.when(F.col("__shared"), prefix))
    by_prefix = _flagged(by_length, _repeated(by_length, "__prefix"), "__prefix", "__again", broadcast_rows)
    digest = F.sha2(F.col("__text"), 256)
    hashed = by_prefix.select("__id", "__carry", F.when(F.col("__again"), digest).alias("__sha"))
    groups = _repeated(hashed, "__sha", F.max("__id").alias("__keep"))

    if digest_all:
        hashed = rows.select("__id", "__carry", digest.alias("__sha"))
    n = groups.count()
    if n <= broadcast_rows:
        known = hashed.join(F.broadcast(groups), "__sha", "left")
    else:
        marked = Bitmap(groups, "__sha", n).marked(hashed, "__sha", "__hit")
        single = marked.where("not __hit").withColumns({"__n": F.lit(None).cast("long"), "__keep": F.lit(None).cast(docs.schema[id_col].dataType)})
        known = marked.where("__hit").join(groups, "__sha", "left").unionByName(single)
    alone = F.col("__n").isNull()
    keep = F.when(alone, F.col("__id")).otherwise(F.col("__keep"))
    return known.select(
        F.col("__id").alias(id_col),
        *(F.col(f"__carry.`{c}`").alias(c) for c in carry),
        keep.alias("keep_id"),
        F.coalesce("__n", F.lit(1)).cast("long").alias("group_size"),
        F.col("__id").eqNullSafe(keep).alias("kept"),
        (F.col("__sha") if digest_all else F.when(~alone, F.col("__sha"))).alias("text_sha256"),
    )
