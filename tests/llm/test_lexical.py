import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quern.llm.lexical import Searcher, ball_tree, ranked_search, terms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_force(docs, items, k):
    split = [(key, Counter(plain_terms(text))) for key, text in docs]
    split = [(key, tf) for key, tf in split if tf]
    n, total = len(split), sum(sum(tf.values()) for _, tf in split)
    df = Counter(t for _, tf in split for t in tf)
    asked = {}
    for key, text in items:
        if key is not None:
            asked.setdefault(key, Counter()).update(plain_terms(text))
    out = []
    for item, q in asked.items():
        scores = []
        for key, tf in split:
            m = 100 - 25 + (25 * sum(tf.values()) * n) // total
            score = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 12 * m)) for t, c in q.items() if t in tf)
            if score > 0 and key is not None:
                scores.append((-score, key))
        out += [(item, rank, key, -s) for rank, (s, key) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("k", "together", "block"), [(20, 512, 8192), (3, 2, 50), (1, 1, 7)])
def test_ranks_are_those_of_all_scores(spark, k, together, block):
    rng = random.Random(k)
    words = ["a", "B", "é", "É", "x1", "don't", "über", "z_z"] + [f"t{i}" for i in range(60)]
    text = lambda n: rng.choice([" ", ", ", "\n", "-"]).join(rng.choices(words, k=n))
    docs = [(i, text(rng.randrange(1, 60))) for i in range(300)]
    docs += [(500, None), (501, ""), (502, " .!"), (None, text(30)), docs[3], docs[3], (7, text(9)), (-2, docs[8][1]), (503, "t1 " * 30_000)]
    items = [(i, text(rng.randrange(1, 12))) for i in range(9)] + [(20, None), (21, "none of these"), (None, "a B"), (3, "t1 t1"), (22, text(400))]
    frame = lambda rows, key: spark.createDataFrame([(*r, 1, "x") for r in rows], f"{key} long, text string, score int, id string").repartition(4)
    got = ranked_search(frame(docs, "doc_id"), frame(items, "item_id"), k=k, items_together=together, block=block)
    assert sorted(map(tuple, got.collect())) == brute_force(docs, items, k)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a c")], "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("doc_id = 2"), items)):
        assert ranked_search(d, i).collect() == []
    assert [r["doc_id"] for r in ranked_search(docs, items).collect()] == [1]


def sparse(matrix):
    row, col = np.nonzero(matrix)
    return row, col, matrix[row, col]


@pytest.mark.parametrize(("leaf", "most"), [(1, 1 << 20), (4, 1 << 20), (8, 100), (2, 1)])
def test_every_row_is_within_the_radius_of_its_nodes(leaf, most):
    rng = np.random.default_rng(leaf)
    matrix = rng.integers(0, 5, (200, 12)) * rng.integers(0, 2, (200, 12)) * 100_000
    matrix[:, 0] += 1
    matrix[150:] = matrix[3]
    tree = ball_tree(*sparse(matrix), 200, 12, leaf=leaf, most=most)

    def below(x):
        if tree.children[x] is None:
            return tree.order[slice(*tree.leaves[x])].tolist()
        return [r for child in tree.children[x] for r in below(child)]

    assert sorted(below(0)) == list(range(200))
    for x in range(len(tree.children)):
        assert np.sqrt(((matrix[below(x)] - tree.centroids[x]) ** 2).sum(1)).max() <= tree.radii[x]
    assert len(tree.children) * 12 <= max(most, 12)


def test_subtrees_that_cannot_hold_a_best_document_are_not_scored():
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2, (20, 40)) * 400_000
    matrix = np.repeat(centres, 100, axis=0) + rng.integers(1, 20_000, (2000, 40))
    queries = (matrix[rng.integers(0, 2000, 30)] > 200_000) * rng.integers(1, 5000, (30, 40))
    searcher = Searcher(queries, 5)
    searcher.add(np.arange(2000), *sparse(matrix))
    scores = queries @ matrix.T
    for found, own in zip(searcher.best, scores, strict=True):
        assert found == sorted((-s, i) for i, s in enumerate(own.tolist()))[:5]
    assert searcher.scored < 0.5 * scores.size


def test_terms():
    assert [t.decode() for t in terms("Don't stop_now, ÉCOLE №5 a\x00b\x7fc")] == ["don", "t", "stop", "now", "École", "№5", "a", "b", "c"]
