"""Spline prolongation against a dense linear solve."""

import random

import numpy as np
import pytest

from tessera.operators.splines import coefficients, spline_prolong


def solved(s):
    n = len(s)
    if n == 1:
        return np.array(s)
    a = np.diag([4.0] * n) + np.diag([1.0] * (n - 1), 1) + np.diag([1.0] * (n - 1), -1)
    a[0, 1] = a[-1, -2] = 2
    return np.linalg.solve(a, 6 * np.array(s))


def kernel(x):
    x = abs(x)
    return 2 / 3 - x * x + x**3 / 2 if x < 1 else (2 - x) ** 3 / 6 if x < 2 else 0.0


def read(s, fine):
    n, c = len(s), solved(s)
    if n == 1:
        return np.full(fine, s[0])
    mirror = lambda i: min(i % (2 * n - 2), 2 * n - 2 - i % (2 * n - 2))
    xs = [i * (n - 1) / (fine - 1) if fine > 1 else 0.0 for i in range(fine)]
    return np.array([sum(c[mirror(j)] * kernel(x - j) for j in range(int(x) - 2, int(x) + 4)) for x in xs])


def test_coefficients_of_lines_of_any_length(spark):
    rng = random.Random(4)
    for n in (1, 2, 3, 63, 64, 65, 130, 300):
        lines = [[rng.gauss(0, 3) for _ in range(n)] for _ in range(2)]
        cells = spark.createDataFrame([(k, i, v) for k, s in enumerate(lines) for i, v in enumerate(s)], "r int, c int, v double")
        got = {(x["r"], x["c"]): x["v"] for x in coefficients(cells, "r", "c", n).collect()}
        assert len(got) == 2 * n
        for k, s in enumerate(lines):
            assert [got[k, i] for i in range(n)] == pytest.approx(solved(s).tolist(), abs=1e-11)


@pytest.mark.parametrize("shape,target", [((5, 7), (11, 70)), ((70, 3), (140, 6)), ((1, 4), (3, 4)), ((2, 2), (5, 1))])
def test_prolongation_equals_the_solve(spark, shape, target):
    rng = random.Random(8)
    g = np.array([[rng.gauss(1, 2) for _ in range(shape[1])] for _ in range(shape[0])])
    cells = spark.createDataFrame([(i, j, float(g[i, j])) for i in range(shape[0]) for j in range(shape[1])], "r int, c int, v double")
    rows = np.array([read(s, target[1]) for s in g])
    want = np.array([read(s, target[0]) for s in rows.T]).T
    got = {(x["r"], x["c"]): x["v"] for x in spline_prolong(cells, shape, target).collect()}
    assert len(got) == target[0] * target[1]
    assert all(got[i, j] == pytest.approx(want[i, j], abs=1e-10) for i in range(target[0]) for j in range(target[1]))
