"""Pair studies against plain loops."""

import math
import random

import numpy as np
import pytest

from tessera.operators import pairs


def test_numbers_of_pairs_are_exact(spark):
    from pyspark.sql import functions as F

    i, j = pairs.pair_of(F.col("k"))
    got = [(r["i"], r["j"]) for r in spark.range(4950).select(F.col("id").alias("k")).select("k", i.alias("i"), j.alias("j")).orderBy("k").collect()]
    assert got == [(a, b) for b in range(100) for a in range(b)]
    for b in (2**31 - 1, 10**9 + 7, 94906267):
        k = [b * (b - 1) // 2 + d for d in (-1, 0, b - 1)]
        rows = spark.createDataFrame([(x,) for x in k], "k long").select("k", i.alias("i"), j.alias("j")).orderBy("k").collect()
        assert [(r["i"], r["j"]) for r in rows] == [(b - 2, b - 1), (0, b), (b - 1, b)]


def test_pairs_are_different_and_all_where_few(spark):
    units = spark.createDataFrame([(f"u{k:03d}",) for k in range(40)] + [("u000",), (None,)], "unit string")
    some = [(r["u"], r["v"]) for r in pairs.sampled_pairs(units, 300).collect()]
    assert len(some) == len(set(some)) == 300 and all(a < b for a, b in some)
    assert pairs.sampled_pairs(units, 10**6).select("u", "v").distinct().count() == 780
    assert pairs.sampled_pairs(units.limit(1), 5).count() == pairs.sampled_pairs(units.limit(0), 5).count() == 0


def walk(up, u, v):
    path = lambda x: [x] + (path(up[x]) if up[x] is not None else [])
    a, b = path(u), path(v)
    for i, x in enumerate(a):
        if x in b:
            return x, i + b.index(x)
    return None, len(a) + len(b)


@pytest.mark.parametrize("shape", ["random", "path"])
def test_tree_distances_equal_a_walk(spark, shape):
    rng = random.Random(4)
    n = 90
    up = {i: (None if i in (0, 50) else i - 1 if shape == "path" else rng.randrange(50 if i > 50 else 0, i)) for i in range(n)}
    tree = spark.createDataFrame([(c, p) for c, p in up.items() if p is not None], "child long, parent long")  # roots are no child
    drawn = pairs.sampled_pairs(spark.range(n).withColumnRenamed("id", "unit"), 400)
    got = pairs.tree_distance(drawn, tree).collect()
    assert len(got) == 400 and all((r["lca"], r["distance"]) == walk(up, r["u"], r["v"]) for r in got)
    assert any(r["lca"] is None for r in got) and any(r["lca"] == r["u"] for r in got)


@pytest.mark.parametrize("edges", [[(1, 2), (2, 1)], [(1, 2), (2, 3), (3, 1)], [(1, 2), (2, 3), (3, 4), (4, 5), (5, 1)]])
def test_a_cycle_is_an_error(spark, edges):
    with pytest.raises(ValueError, match="cycle"):
        pairs.lifted(spark.createDataFrame(edges, "child long, parent long"))


def test_features_are_compared_where_both_have_values(spark):
    p = spark.createDataFrame([(0, 1, 2), (1, 1, 3), (2, 2, 3)], "pair long, u long, v long")
    values = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (2, 0, 4.0), (2, 1, 6.0), (2, 2, 9.0)], "unit long, pos int, value double")
    assert [tuple(r) for r in pairs.feature_distance(p, values).collect()] == [(0, 1, 2, 5.0)]


def ranks(x):
    return np.array([np.sum(x < v) + (np.sum(x == v) + 1) / 2 for v in x])


def p_by_integration(r, n):
    """Twice the upper tail of Student's distribution, by Simpson's rule over the angle."""
    if n < 3:
        return 1.0
    df, top = n - 2, math.asin(min(1.0, abs(r)))
    x = np.linspace(top, math.pi / 2, 20001)
    w = np.ones(20001)
    w[1:-1:2], w[2:-1:2] = 4, 2
    area = lambda a, b, y: (b - a) / 20000 / 3 * np.sum(w * y)
    whole = math.sqrt(math.pi) * math.exp(math.lgamma(df / 2) - math.lgamma((df + 1) / 2)) / 2
    return area(top, math.pi / 2, np.cos(x) ** (df - 1)) / whole


@pytest.mark.parametrize("n", [3, 4, 5, 12, 61, 400])
def test_agreement_equals_numpy(spark, n):
    rng = np.random.default_rng(n)
    a = rng.integers(0, 5, n).astype(float)
    a[0], a[1] = 0, 4
    b = a * 0.1 + rng.normal(size=n)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b, strict=True)] + [(None, 1.0)], "a double, b double")
    r = pairs.agreement(df, "a", "b").first()
    pe, sp = np.corrcoef(a, b)[0, 1], np.corrcoef(ranks(a), ranks(b))[0, 1]
    assert r["n"] == n and r["pearson"] == pytest.approx(pe) and r["spearman"] == pytest.approx(sp)
    assert r["pearson_p"] == pytest.approx(p_by_integration(pe, n), abs=1e-7) and r["spearman_p"] == pytest.approx(p_by_integration(sp, n), abs=1e-7)


def test_agreement_of_nothing_and_of_constants(spark):
    for rows in ([], [(1.0, 2.0)], [(1.0, 2.0)] * 4):
        r = pairs.agreement(spark.createDataFrame(rows, "a double, b double"), "a", "b").first()
        assert (r["n"], r["pearson"], r["pearson_p"], r["spearman"], r["spearman_p"]) == (len(rows), 0.0, 1.0, 0.0, 1.0)


def test_basins_of_alike_units(spark):
    units = list(range(12))
    drawn = [(k, a, b, 0.5 if a % 2 == b % 2 else 2.0) for k, (a, b) in enumerate((a, b) for a in units for b in range(a + 1, 12))]
    p = spark.createDataFrame(drawn, "pair long, u long, v long, features double")
    r = pairs.basin_agreement(p, spark.createDataFrame([(u, u % 2) for u in units], "unit long, basin long")).first()
    assert r["n"] == 66 and r["same"] == pytest.approx(30 / 66) and r["biserial"] == pytest.approx(1.0) and r["spearman"] == pytest.approx(1.0)
    assert (r["within"], r["across"], r["separation"]) == (0.75, 0.0, 0.75)
