import random

import pytest

from quern.llm.components import components


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_random_graphs_paths_and_stars(spark, seed):
    random.seed(seed)
    edges = [(random.randint(0, 150), random.randint(0, 150)) for _ in range(90)]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(3000 - i, 2000) for i in range(50)] + [(5, 5), (7, None)]
    parent = {x: x for e in edges for x in e if x is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: root(x) for x in parent if root(x) != x}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
