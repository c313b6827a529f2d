import numpy as np
import pytest

from lexmill.llm.components import connected_components


def brute(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in up if find(x) != x)


@pytest.mark.parametrize("seed,nodes,edges", [(0, 400, 300), (1, 400, 500), (2, 60, 900)])
def test_matches_brute_force(spark, seed, nodes, edges):
    r = np.random.default_rng(seed)
    names = r.integers(-(2**62), 2**62, nodes).tolist()
    rows = [(names[a], names[b]) for a, b in r.integers(0, nodes, (edges, 2))]
    rows += [(names[0], names[k]) for k in range(nodes // 3)]  # a hub
    got = connected_components(spark.createDataFrame(rows, "a long, b long").repartition(5))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_chain_and_odd_tables(spark):
    rows = [(k, k + 1) for k in range(70)] + [(500, 500)]
    df = spark.createDataFrame(rows, "a long, b long")
    assert sorted(map(tuple, connected_components(df).collect())) == [(k, 0) for k in range(1, 71)]
    assert connected_components(df.limit(0)).count() == 0
    assert connected_components(spark.createDataFrame([(5, 5)], "a long, b long")).count() == 0
