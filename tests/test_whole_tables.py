"""Queries see all rows of their tables: answers by brute force over whole tables and small fixtures."""

import os

import pandas as pd
import pytest

from tessera.plans import catalog, catalog_graphs, catalog_scales, catalog_studies  # noqa: F401

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def ask(spark, name):
    return catalog.QUERIES[name](spark, SF).toPandas()


@pytest.fixture(scope="module")
def heap():
    """gt, depth, path to the root (itself first), unit, top and coarse of every order."""
    o = pd.read_parquet(f"{SF}/orders.parquet")
    gt = dict(zip(o["o_orderkey"].tolist(), (o["o_totalprice"] / 100000).tolist(), strict=True))
    path = {}
    for k in sorted(gt):
        path[k] = [k, *path[(k - 1) // 2]] if k else [0]
    depth = {k: len(p) - 1 for k, p in path.items()}
    at = lambda k, d: path[k][depth[k] - d] if depth[k] >= d else None
    below = {}
    for k in gt:
        below.setdefault(at(k, 2), []).append(gt[k])
    coarse = {k: gt[k] if depth[k] < 3 else sum(below[at(k, 2)]) / len(below[at(k, 2)]) for k in gt}
    assert len(gt) > 1023
    return gt, path, depth, at, coarse


def near(got, want):
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)


def col(df, key, value):
    return dict(zip(df[key].tolist(), df[value].tolist(), strict=True))


def test_tree_space_has_all_orders(spark, heap):
    gt, path, depth, at, coarse = heap
    got = ask(spark, "tree_space")
    near(col(got, "id", "coarse"), coarse)
    assert col(got, "id", "parent") == {k: path[k][1] if k else -1 for k in gt}
    assert col(got, "id", "unit") == {k: -1 if at(k, 3) is None else at(k, 3) for k in gt}


def unit_rho(heap):
    gt, _, _, at, coarse = heap
    err = {}
    for k in gt:
        if at(k, 3) is not None:
            err.setdefault(at(k, 3), []).append((gt[k] - coarse[k]) ** 2)
    return {u: sum(x) / len(x) for u, x in err.items()}


def test_unit_rho_and_refinement_of_the_whole_tree(spark, heap):
    gt, _, _, at, coarse = heap
    rho = unit_rho(heap)
    got = ask(spark, "unit_rho_tree").dropna(subset=["unit"])
    near(col(got, "unit", "rho"), rho)
    best = sorted(rho, key=lambda u: (-rho[u], u))[:3]
    left = {k: 0.0 if at(k, 3) in best else 1.0 for k in gt}
    for u in best:
        left[(u - 1) // 2] *= 0.7
    near(col(ask(spark, "refine_tree"), "id", "state"), {k: gt[k] - (gt[k] - coarse[k]) * left[k] for k in gt})


def test_restriction_and_prolongation_of_the_whole_tree(spark, heap):
    gt, path, depth, at, _ = heap
    low = {}
    for k in gt:
        if depth[k] >= 4:
            low.setdefault(at(k, 4), []).append(gt[k])
    v = {t: sum(x) / len(x) for t, x in low.items()}
    near(col(ask(spark, "restrict_tree"), "top", "v"), v)
    high = {}
    for t in v:
        for a in path[t][1:]:
            high.setdefault(a, []).append(v[t])
    near(col(ask(spark, "prolong_tree"), "id", "up"), {k: v[at(k, 4)] if depth[k] >= 4 else sum(high[k]) / len(high[k]) for k in gt})


def test_paths_of_the_whole_tree(spark, heap):
    gt, path, _, _, _ = heap
    size = dict.fromkeys(gt, 0)
    for p in path.values():
        for a in p:
            size[a] += 1
    assert col(ask(spark, "subtree_sizes"), "id", "size") == size
    near(col(ask(spark, "parent_child_add"), "id", "total"), {k: sum(gt[a] for a in p if a % 3) for k, p in path.items()})


def test_neighbours_and_siblings_of_the_whole_tree(spark, heap):
    gt, path, _, _, _ = heap
    kids = {}
    for k, p in path.items():
        if k:
            kids.setdefault(p[1], []).append(k)
    want = {(k, p, "parent") for p, x in kids.items() for k in x} | {(p, k, "child") for p, x in kids.items() for k in x} | {(a, b, "sibling") for x in kids.values() for a in x for b in x if a != b}
    got = ask(spark, "tree_neighbors")
    assert len(got) == len(want) and set(got[["node", "other", "kind"]].itertuples(index=False, name=None)) == want
    same = [x for x in kids.values() if len({int(gt[k] * 2 // 1) for k in x}) < len(x)]
    row = ask(spark, "sibling_sweep").iloc[0]
    assert (row["groups"], row["merges"], bool(row["triggered"])) == (len(same), len(same), len(same) > 0.05 * len(gt))
