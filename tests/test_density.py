"""Density clusters by cells and pairs within a radius by half a ring, against all pairs."""

import math
import random

from tessera.operators import studies
from tessera.sources import spaces


def brute(pts, radius, least):
    near = {i: [j for j in pts if j != i and math.sqrt((pts[i][0] - pts[j][0]) ** 2 + (pts[i][1] - pts[j][1]) ** 2) <= radius] for i in pts}
    core = {i for i in pts if len(near[i]) + 1 >= least}
    cluster = {}
    for i in sorted(core):
        todo = [i] if i not in cluster else []
        while todo:
            k = todo.pop()
            if k not in cluster:
                cluster[k] = i
                todo += [j for j in near[k] if j in core]
    return {i: cluster[i] if i in core else min((cluster[j] for j in near[i] if j in core), default=-1) for i in pts}


def points():
    rng = random.Random(5)
    rows = [(rng.gauss(0.2 * (k % 4), 0.02), rng.gauss(-0.1 * (k % 3), 0.02)) for k in range(150)]
    rows += [(rng.uniform(-1, 1), rng.uniform(-1, 1)) for _ in range(120)] + [(0.5, 0.5)] * 9 + [(-0.03 * k, 0.9) for k in range(9)]
    ids = rng.sample(range(1000), len(rows))
    return dict(zip(ids, rows, strict=True))


def test_density_clusters_equal_all_pairs(spark):
    pts = points()
    df = spark.createDataFrame([(i, *p) for i, p in pts.items()], "id long, x double, y double")
    for radius, least in ((0.03, 8), (0.06, 4)):
        assert {r["id"]: r["cluster"] for r in studies.dbscan(df, radius, least).collect()} == brute(pts, radius, least)


def test_radius_pairs_come_once(spark):
    pts = points()
    df = spark.createDataFrame([(i, *p) for i, p in pts.items()], "id long, x double, y double")
    got = [(r["a"], r["b"]) for r in spaces.radius_pairs(df, 0.05).collect()]
    assert sorted(got) == [(a, b) for a in sorted(pts) for b in sorted(pts) if a < b and math.sqrt((pts[a][0] - pts[b][0]) ** 2 + (pts[a][1] - pts[b][1]) ** 2) <= 0.05]
