"""Connected components of a graph given as a table of edges, by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import remove_written, written


def _with_least(edges: DataFrame) -> DataFrame:
    """``edges`` with the smallest ``b`` of each ``a``: a grouped minimum joined back, so that Spark can split the edges of a hub."""
    return edges.join(edges.groupBy("a").agg(F.min("b").alias("least")), "a")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` lead from larger to smaller ids."""
    starred = _with_least(edges)
    inner = starred.select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b")
    return inner.unionByName(starred.select("a", F.col("least").alias("b"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``component`` (the smallest id reachable) of every node of ``edges`` (columns ``a``, ``b``) but the smallest ones themselves.

    Each round shuffles the remaining edges, of which there are never more than at first, and stores them in the
    shared folder; the number of rounds grows with the logarithm of the longest path. Loops and nulls are ignored.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(now)
    while mark[0]:
        between = written(_large_star(now))
        after = written(_small_star(between))
        remove_written(now, between)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
