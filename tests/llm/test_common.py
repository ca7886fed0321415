import pytest

from quern.llm import common
from quern.llm.common import Bitmap, joined, without, written


@pytest.mark.parametrize("bits", [1 << 15, 1 << 20])
def test_a_bitmap_misses_no_value(spark, bits):
    keys = written(spark.range(0, 20_000, 7).selectExpr("id as k"))
    marked = Bitmap(keys, "k", keys.count(), bits).marked(spark.range(20_000).selectExpr("id as k", "'x' as __bit").union(spark.sql("select cast(null as long), 'x'")), "k", "hit").collect()
    assert len(marked) == 20_001 and all(r["hit"] for r in marked if r["k"] is not None and r["k"] % 7 == 0)
    assert not any(r["hit"] for r in marked if r["k"] is None)
    assert bits == 1 << 15 or sum(r["hit"] for r in marked) < 4_500


@pytest.mark.parametrize("limit", [0, 10**6])
def test_joins_do_not_depend_on_what_is_broadcast(spark, limit):
    keys = written(spark.range(0, 3000, 3).selectExpr("id as k", "id * 2 as more"))
    rows = spark.range(3000).selectExpr("id as k").union(spark.sql("select cast(null as long)"))
    assert {(r["k"], r["more"]) for r in joined(rows, keys, 1000, "k", limit).collect()} == {(k, 2 * k) for k in range(0, 3000, 3)}
    left = [r["k"] for r in without(rows, keys, 1000, "k", limit).collect()]
    assert len(left) == 2001 and set(left) == {None, *(k for k in range(3000) if k % 3)}


def test_a_worker_keeps_one_table():
    assert common.worker_table("a", lambda: [1]) == [1] and common.worker_table("a", lambda: [2]) == [1]
    assert common.worker_table("b", lambda: [3]) == [3] and common.worker_table("a", lambda: [4]) == [4]
    common.forget_tables()
    assert common.worker_table("a", lambda: [5]) == [5]
