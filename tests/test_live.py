"""Live refinement against the loop that takes unit after unit."""

import random

import pytest

from tessera.operators.live import live_refine


def loop(cells, masks, keys, fraction, alpha=0.1):
    e = {i: gt - c for i, _, gt, c in cells}
    of = {}
    for i, u, _, _ in cells:
        if u is not None:
            of.setdefault(u, []).append(i)
    by = {}
    for u, i, m in masks:
        by.setdefault(u, []).append((i, m))
    rho = lambda u: sum(e[i] ** 2 for i in of[u]) / len(of[u])
    order = sorted((u for u, _ in keys if u in of), key=lambda u: (-rho(u), dict(keys)[u]))
    budget = max(1, int(fraction * len(order)))
    n, ema, out = 0, 0.0, {}
    for u in order:
        if n >= budget:
            out[u] = (n, None, False, ema)
            continue
        x = rho(u)
        ok = x > ema / 2 or n < max(1, budget // 3)
        before = n
        if ok:
            for i, m in by[u]:
                e[i] *= 1 - m
            n, ema = n + 1, alpha + (1 - alpha) * ema
        out[u] = (before, x, ok, ema)
    return out, {i: gt - e[i] for i, _, gt, _ in cells}


def compare(spark, cells, masks, keys, fraction, alpha=0.1):
    r = live_refine(
        spark.createDataFrame(cells, "id long, unit long, gt double, coarse double"),
        spark.createDataFrame(masks, "unit long, id long, m double"),
        spark.createDataFrame(keys, "unit long, key long"), fraction, alpha)
    want, state = loop(cells, masks, keys, fraction, alpha)
    got = {x["unit"]: x for x in r.units.collect()}
    assert got.keys() == want.keys()
    for u, (before, rho, ok, ema) in want.items():
        x = got[u]
        assert (x["before"], x["refined"]) == (before, ok)
        assert x["rho"] == (None if rho is None else pytest.approx(rho, abs=1e-9)) and x["ema"] == pytest.approx(ema)
    assert {x["id"]: x["state"] for x in r.cells.collect()} == pytest.approx(state)
    return r, want


def line(rng, units, size, reach, scale):
    """Units in a row whose masks reach over the neighbours' cells."""
    n = units * size
    cells = [(i, i // size, rng.gauss(0, scale), 0.0) for i in range(n)]
    masks = []
    for u in range(units):
        for i in range(max(0, u * size - reach), min(n, (u + 1) * size + reach)):
            masks.append((u, i, 1.0 if i // size == u else rng.choice([0.3, 0.6, 0.9])))
    keys = [(u, (u * 7) % units) for u in range(units)]
    return cells, masks, keys


@pytest.mark.parametrize("seed,reach,fraction", [(1, 3, 0.8), (2, 9, 1.0), (3, 6, 0.5)])
def test_decisions_equal_the_loop(spark, seed, reach, fraction):
    r, want = compare(spark, *line(random.Random(seed), 60, 4, reach, 0.7), fraction)
    flips = [u for u, x in want.items() if x[1] is not None and not x[2]]
    assert flips, "the governor refuses some units"
    assert r.rounds < 30


def test_a_chain_in_which_each_unit_decides_the_next(spark):
    # equal first rho, order by key: refining one takes the next one under the threshold
    n = 24
    cells = [(i, i, 1.0, 0.0) for i in range(n)]
    masks = [(u, i, 1.0 if i == u else 0.95) for u in range(n) for i in (u, u + 1) if i < n]
    _, want = compare(spark, cells, masks, [(u, u) for u in range(n)], 0.6, 0.5)
    assert {x[2] for x in want.values()} == {True, False}


def test_cells_of_no_unit_ties_and_units_without_cells(spark):
    cells = [(0, None, 5.0, 1.0), (1, 1, 2.0, 1.0), (2, 2, 2.0, 1.0), (3, 2, 2.0, 1.0)]
    masks = [(1, 1, 1.0), (1, 0, 0.3), (2, 2, 1.0), (2, 3, 1.0), (2, 0, 0.3), (9, 0, 0.5)]
    compare(spark, cells, masks, [(1, 5), (2, 4), (9, 0)], 1.0)


def test_no_units(spark):
    none = spark.createDataFrame([], "unit long, key long")
    cells = spark.createDataFrame([(0, None, 5.0, 1.0)], "id long, unit long, gt double, coarse double")
    r = live_refine(cells, spark.createDataFrame([], "unit long, id long, m double"), none, 0.5)
    assert r.units.count() == 0 and r.rounds == 0 and r.cells.first()["state"] == 1.0
