"""Scores of clusters against plain loops."""

import math
import random

import pytest

from tessera.operators.evaluation import cluster_scores


def scores(rows):
    ks = sorted({r[0] for r in rows})
    of = {k: [r[1:] for r in rows if r[0] == k] for k in ks}
    mean = lambda ps: [sum(c) / len(ps) for c in zip(*ps, strict=True)]
    m = {k: mean(of[k]) for k in ks}
    all_ = mean([r[1:] for r in rows])
    w = sum(math.dist(p, m[k]) ** 2 for k in ks for p in of[k])
    b = sum(len(of[k]) * math.dist(m[k], all_) ** 2 for k in ks)
    s = {k: sum(math.dist(p, m[k]) for p in of[k]) / len(of[k]) for k in ks}
    db = sum(max((s[i] + s[j]) / math.dist(m[i], m[j]) for j in ks if j != i) for i in ks) / len(ks)
    return b * (len(rows) - len(ks)) / (w * (len(ks) - 1)), db


def test_scores_equal_loops(spark):
    rng = random.Random(6)
    rows = [(k, rng.gauss(k, 1), rng.gauss(-k, 2), rng.random()) for k in range(5) for _ in range(10 + 7 * k)]
    r = cluster_scores(spark.createDataFrame(rows, "cluster int, a double, b double, c double"), ["a", "b", "c"]).first()
    ch, db = scores(rows)
    assert r["n"] == len(rows) and r["clusters"] == 5
    assert r["calinski_harabasz"] == pytest.approx(ch) and r["davies_bouldin"] == pytest.approx(db)


def test_scores_of_one_cluster_and_of_points_that_coincide(spark):
    one = spark.createDataFrame([(1, 2.0), (1, 3.0)], "cluster int, a double")
    assert tuple(cluster_scores(one, ["a"]).first()) == (2, 1, None, None)
    same = spark.createDataFrame([(1, 2.0), (2, 2.0)], "cluster int, a double")
    assert tuple(cluster_scores(same, ["a"]).first()) == (2, 2, None, None)
