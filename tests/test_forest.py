"""Spanning forests and single linkage against Kruskal's loop."""

import random

import pytest

from tessera.operators.forest import linkage_heights, minimum_forest, single_linkage


def kruskal(n, edges, stop=None):
    """Forest edges in order; stops when that many trees are left."""
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    out, trees = [], n
    for w, a, b in sorted((w, min(a, b), max(a, b)) for a, b, w in edges if a != b and w is not None):
        p, q = find(a), find(b)
        if p != q and trees != stop:
            up[max(p, q)] = min(p, q)
            out.append((a, b, w))
            trees -= 1
    return out, [find(i) for i in range(n)]


def frames(spark, n, edges):
    return spark.createDataFrame([(i,) for i in range(n)], "id long"), spark.createDataFrame(edges, "src long, dst long, w double")


@pytest.mark.parametrize("seed,levels", [(1, 1000), (2, 4)])
def test_forest_clusters_and_heights_equal_kruskal(spark, seed, levels):
    rng = random.Random(seed)  # few levels: many ties
    n = 70
    edges = [(rng.randrange(n - 5), rng.randrange(n - 5), float(rng.randrange(levels))) for _ in range(160)] + [(0, 0, 1.0), (3, 1, None)]
    v, e = frames(spark, n, edges)
    want, _ = kruskal(n, edges)
    assert {tuple(r) for r in minimum_forest(e).collect()} == set(want)
    _, label = kruskal(n, edges, 12)
    assert {r["id"]: r["cluster"] for r in single_linkage(v, e, 12).collect()} == dict(enumerate(label))
    got = [tuple(r) for r in sorted(linkage_heights(v, e).collect())]
    assert got == [(i + 1, w, n - i - 1) for i, (_, _, w) in enumerate(want)]


def test_a_long_path_and_more_trees_than_clusters(spark):
    n = 60
    v, e = frames(spark, n, [(i, i + 1, float(i)) for i in range(n - 1) if i != 30])
    assert minimum_forest(e).count() == n - 2
    assert {r["cluster"] for r in single_linkage(v, e, 1).collect()} == {0, 31}


def test_no_edges(spark):
    v, e = frames(spark, 3, [])
    assert minimum_forest(e).count() == 0 and single_linkage(v, e, 2).count() == 3 and linkage_heights(v, e).count() == 0
