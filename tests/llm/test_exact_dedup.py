import hashlib

import pytest

from quern.llm.exact_dedup import exact_dedup

SCHEMA = "doc_id long, text string, keep_id string, kept string"
LONG = "word " * 50_000
ROWS = [
    (1, "same", "a", "b"), (2, "same", None, None), (3, "sama", "a", "b"), (4, None, "a", "b"), (5, "", "a", "b"),
    (6, LONG, "a", "b"), (7, LONG + "x", "a", "b"), (8, LONG, "a", "b"), (9, "alone and long enough", "a", "b"),
    (2, "same", None, None), (None, "same", "a", "b"), (None, "no id", "a", "b"), (11, "é", "a", "b"), (12, "é", "a", "b"),
]


def expected():
    groups = {}
    for key, text, *_ in ROWS:
        groups.setdefault(text or "", []).append(key)
    out = []
    for key, text, *_ in ROWS:
        ids = groups[text or ""]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((key, keep, len(ids), key == keep))
    return sorted(out, key=repr)


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
@pytest.mark.parametrize("digest_all", [False, True])
def test_groups_of_equal_texts(spark, broadcast_rows, digest_all):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = exact_dedup(docs, digest_all=digest_all, broadcast_rows=broadcast_rows)
    rows = got.collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in rows), key=repr) == expected()
    if digest_all:
        want = sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t, *_ in ROWS)
        assert sorted(r["text_sha256"] for r in rows) == want


def test_unique_texts_are_not_hashed(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = {r["doc_id"]: r["text_sha256"] for r in exact_dedup(docs).collect() if r["doc_id"] is not None}
    assert got[9] is None and got[3] is None and got[1] is not None


def test_hashes_are_the_same_on_either_side_of_the_broadcast_bound(spark):
    docs = spark.createDataFrame([*ROWS, (13, "word " * 100 + "a", "a", "b"), (14, "word " * 100 + "b", "a", "b")], SCHEMA)
    few, many = (sorted(map(tuple, exact_dedup(docs, broadcast_rows=n).collect()), key=repr) for n in (1000, 0))
    assert few == many
    assert all((sha is None) == (size == 1) for _, _, size, _, sha in few)


def test_empty_table(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_plan_is_native(spark):
    plan = exact_dedup(spark.createDataFrame(ROWS, SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
