import random

import pytest

from labelforge.llm.components import connected_components


@pytest.mark.parametrize("shape", ["none", "chain", "star", "random", "loops"])
def test_matches_union_find(spark, shape):
    random.seed(2)
    links = {
        "none": [],
        "chain": [(i, i + 1) for i in range(40)],
        "star": [(0, i) for i in range(1, 40)] + [(i, 50) for i in range(41, 45)],
        "random": [(random.randrange(80), random.randrange(80)) for _ in range(50)],
        "loops": [(3, 3), (3, 4), (4, 3), (7, 7)],
    }[shape]
    parent = {x: x for l in links for x in l}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in links:
        a, b = sorted((root(u), root(v)))
        parent[b] = a
    linked = {x for u, v in links if u != v for x in (u, v)}
    got = connected_components(spark.createDataFrame(links, "u long, v long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, root(x)) for x in linked)
