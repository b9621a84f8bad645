"""Modularity communities: known answers, invariants, and gain over label propagation."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import communities, graphs


def graph(spark, n, pairs):
    return spark.range(n), spark.createDataFrame(sorted({(min(p), max(p)) for p in pairs}), "src long, dst long")


def cliques(k, m):
    """k cliques of m nodes in a ring, one edge between neighbours."""
    inner = [(c * m + a, c * m + b) for c in range(k) for a, b in itertools.combinations(range(m), 2)]
    return inner + [(c * m, (c + 1) % k * m + 1) for c in range(k)]


def blocks(df):
    return {r["id"]: r["block"] for r in df.collect()}


def test_a_ring_of_cliques_falls_into_its_cliques(spark):
    got = blocks(communities.modularity_blocks(*graph(spark, 24, cliques(4, 6))))
    assert got == {i: i // 6 * 6 for i in range(24)}


def test_nodes_without_edges_and_empty_graphs(spark):
    n, e = graph(spark, 5, [(0, 1), (1, 2), (0, 2)])
    assert blocks(communities.modularity_blocks(n, e)) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}
    assert blocks(communities.modularity_blocks(n, e.limit(0))) == {i: i for i in range(5)}
    assert blocks(communities.modularity_blocks(n.limit(0), e.limit(0))) == {}


def test_weights_decide(spark):
    e = spark.createDataFrame([(0, 1, 9), (1, 2, 1), (2, 3, 9)], "src long, dst long, w long")
    assert blocks(communities.modularity_blocks(spark.range(4), e)) == {0: 0, 1: 0, 2: 2, 3: 2}


@pytest.mark.parametrize("seed", [2])
def test_parts_are_connected_and_no_worse_than_label_propagation(spark, seed):
    rng = random.Random(seed)
    pairs = [(a, b) for a in range(60) for b in range(a) if rng.random() < (0.25 if a % 5 == b % 5 else 0.02)]
    n, e = graph(spark, 60, pairs)
    merged = communities.merged_blocks(n, e)
    got = communities.modularity_blocks(n, e)
    q = [graphs.modularity(e, x).first()[0] for x in (merged, got, graphs.label_propagation(n, e))]
    assert q[1] >= q[0] - 1e-12 and q[1] >= q[2] - 1e-12
    again = blocks(communities.modularity_blocks(n.repartition(7), e.repartition(3)))
    own = blocks(got)
    assert own == again
    near = {i: set() for i in range(60)}
    for r in e.collect():
        if own[r["src"]] == own[r["dst"]]:
            near[r["src"]].add(r["dst"])
            near[r["dst"]].add(r["src"])
    for b in set(own.values()):
        seen, todo = {b}, [b]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert seen == {i for i in own if own[i] == b}


def test_the_tree_of_communities_goes_on_to_its_end(spark):
    # on a path the smallest label moves one node a round, so each level takes as many rounds as the path is long
    n, e = graph(spark, 16, [(i, i + 1) for i in range(15) if i != 7])
    tree = graphs.community_tree(n, e).collect()
    assert {r["id"]: r["parent"] for r in tree if r["level"] == 0} == {i: i // 8 * 8 for i in range(16)}
    assert {r["parent"] for r in tree if r["level"] == max(x["level"] for x in tree)} == {0, 8}
