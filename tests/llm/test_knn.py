import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quern.llm import knn

SCHEMA = "vec_id long, embedding array<float>, rank string"


def brute(rows, k, query):
    usable = {}
    for key, vector, _ in rows:
        if key is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            usable[key] = [math.floor(256 * float(np.float32(x))) for x in vector]
    out = []
    for q in (q for q in usable if query(q)):
        scores = sorted((-sum(a * b for a, b in zip(usable[q], v, strict=False)), key) for key, v in usable.items() if key != q)
        out += [(q, rank, key, -score) for rank, (score, key) in enumerate(scores[:k], 1)]
    return sorted(out)


def rows(seed, n=400):
    random.seed(seed)
    centres = [[random.gauss(0, 2) for _ in range(6)] for _ in range(5)]
    made = [(i, [x + random.gauss(0, 0.2) for x in random.choice(centres)], "r") for i in range(n)]
    hot = [(n + i, centres[0], "hot") for i in range(150)]
    odd = [(9001, None, "r"), (9002, [1.0, None, 1.0], "r"), (9003, [float("nan")] * 6, "r"), (9004, [float("inf")] * 6, "r"), (None, centres[0], "r"), (9005, [], "r"), (9006, [50.0, 1.0], "r")]
    return made + hot + odd + made[:3]


@pytest.mark.parametrize(("seed", "block"), [(1, 4096), (2, 16)])
def test_results_are_those_of_all_pairs(spark, monkeypatch, seed, block):
    monkeypatch.setattr(knn, "BLOCK_VECTORS", block)
    monkeypatch.setattr(knn, "BLOCK_QUERIES", max(2, block // 8))
    data = rows(seed)
    got = knn.top_k(spark.createDataFrame(data, SCHEMA), F.col("vec_id") % 20 == 0, k=5)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute(data, 5, lambda q: q % 20 == 0)


def test_few_or_no_candidates(spark):
    table = spark.createDataFrame([(0, [1.0], "a"), (50, [2.0], "b"), (51, [-1.0], "c")], SCHEMA)
    got = sorted(map(tuple, knn.top_k(table, F.col("vec_id") % 50 == 0).collect()))
    assert got == [(0, 1, 50, 256 * 512), (0, 2, 51, -256 * 256), (50, 1, 0, 256 * 512), (50, 2, 51, -512 * 256)]
    assert knn.top_k(table.limit(1), F.lit(True)).collect() == []
    assert knn.top_k(table.limit(0), F.lit(True)).collect() == []


def test_large_scores_stay_exact():
    a, b = np.array([[2**30, 1]]), np.array([[2**30, 1], [2**30, 2]])
    assert knn.inner_products(a, b).tolist() == [[2**60 + 1, 2**60 + 2]]


def test_most_cells_are_ruled_out_where_vectors_lie_in_clusters(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 16)) * 10
    vectors = centres[rng.integers(0, 8, 4000)] + rng.normal(size=(4000, 16)) * 0.1
    table = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>")
    assert knn.reached_share(table, F.col("vec_id") % 50 == 0) < 0.5
    whole = np.floor(vectors * 256).astype(np.int64)
    for query, rows in knn.top_k(table, F.col("vec_id") % 50 == 0).toPandas().groupby("query_id"):
        scores = whole @ whole[query]
        want = sorted((i for i in range(4000) if i != query), key=lambda i: (-scores[i], i))[:5]
        assert rows.sort_values("rank")["vec_id"].tolist() == want
    assert knn.reached_share(table.limit(0), F.col("vec_id") % 50 == 0) == 0.0


def test_frames_stay_small_and_a_query_is_sent_once_to_a_group(monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 100, (3000, 8))
    sizes = rng.integers(1, 40, 3000)
    group = knn.grouped(sizes, knn.near_together(centres), 500)
    held = np.bincount(group, sizes)
    assert held.max() <= 500 and len(held) < 1.2 * sizes.sum() / 500 + 1 and sorted(knn.near_together(centres).tolist()) == list(range(3000))
    assert knn.grouped(np.array([900, 1, 1]), np.array([2, 0, 1]), 500).tolist() == [1, 2, 0]
    queries = rng.integers(-300, 300, (400, 8))
    asked = pd.DataFrame({"query_id": np.arange(400), "query": list(queries), "group": group[:400], "beat": rng.normal(0, 60_000, 400)})
    monkeypatch.setattr(knn, "HANDED", 1000)
    monkeypatch.setattr(knn, "BOUNDS", 20_000)
    radius, norm = np.full(3000, 5.0), np.sqrt((centres**2).sum(1)) + 5
    frames = list(knn.reached_groups(asked, 8, group, centres, radius, norm))
    assert max(map(len, frames)) <= 1000 and len(frames) > 10
    got = [(q, g) for f in frames for q, g in zip(f["query_id"], f["group"], strict=True)]
    assert len(got) == len(set(got)) <= 400 * len(held)
    most = knn.bounds(queries, centres, radius, norm) >= asked["beat"].to_numpy()[:, None]
    assert set(got) == {(i, g) for i in range(400) for g in set(group[most[i]].tolist()) if g != asked["group"][i]}


def test_blocks_give_what_all_scores_give(monkeypatch):
    rng = np.random.default_rng(4)
    queries, vectors = rng.integers(-50, 50, (30, 6)), rng.integers(-50, 50, (200, 6))
    monkeypatch.setattr(knn, "SCORES", 500)
    got = knn.best_of_block(np.arange(30), queries, np.arange(200), vectors, 5)
    want = knn.best(np.arange(30), queries, np.arange(200), vectors, 5)
    assert got.to_numpy().tolist() == want.to_numpy().tolist()
