"""Gate, spectra, knees, hashed layouts, interval tests and seams against direct computation."""

import math

import numpy as np

from tessera.operators import evaluation, gating, layouts, spectra, studies, units
from tessera.sources import deltas, spaces


def _gate(run, alpha, cfg):
    ti, tf, seen, w, out = cfg.instability, cfg.fsr, [], [1.0, 0.0, 0.0], []
    for k, (f, i) in enumerate(run):
        a, b = ti, tf
        if k < cfg.pilot:
            seen.append((i, f))
            if k == cfg.pilot - 1:
                ti = min(a, sorted(x for x, _ in seen)[len(seen) // 2] * cfg.factor)
                tf = max(cfg.fsr_floor, min(b, sorted(y for _, y in seen)[len(seen) // 2] * cfg.factor))
        ok = i <= a and f <= b
        goal = 1.0 if ok else max(cfg.least, 1 - 0.5 * min(1.0, max(0.0, i - a) / max(a, 1e-6)))
        w = [x + alpha * (g - x) for x, g in zip(w, (goal, (1 - goal) * 0.6, (1 - goal) * 0.4))]
        w = [x / sum(w) for x in w]
        out.append(("healthy" if ok else "combo", *w))
    return out


def test_gate_follows_the_loop(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    runs = {r: [(float(a), float(b)) for a, b in rng.random((n, 2)) * 0.6] for r, n in ((0, 12), (1, 2), (2, 1), (3, 30))}
    rows = [(r, k, f, i) for r, run in runs.items() for k, (f, i) in enumerate(run)]
    df = spark.createDataFrame(rows, "run int, tick int, fsr double, inst double").repartition(3)
    got = gating.weighted_gate(df, ["run"], "tick", "fsr", "inst", F.lit(0.3)).orderBy("run", "tick").collect()
    want = [x for r in sorted(runs) for x in _gate(runs[r], 0.3, gating.GateConfig())]
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g["stage"] == w[0] and np.allclose((g["w_resid"], g["w_hf"], g["w_var"]), w[1:])


def test_transform_equals_fft(spark):
    g = np.random.default_rng(2).normal(size=(8, 8))
    df = spark.createDataFrame([(0, r, c, float(g[r, c]), float(g[c, r] + 0.3)) for r in range(8) for c in range(8)], "case int, r int, c int, v double, w double")
    f = np.fft.fft2(g)
    for x in spectra.dft(df, ["case"], "v", 8).collect():
        assert abs(complex(x["re"], x["im"]) - f[x["j"], x["k"]]) < 1e-9
    power, axis = abs(f) ** 2, np.fft.fftfreq(8)
    freq = np.hypot(*np.meshgrid(axis, axis, indexing="ij"))
    info = spectra.spectral_info(df, ["case"], "v", 8).first()
    assert np.allclose((info["centroid"], info["hf_ratio"], info["lf_ratio"]), ((freq * power).sum() / power.sum(), power[freq > 0.125].sum() / power.sum(), power[freq < 0.03125].sum() / power.sum()))
    h = np.fft.fft2(g.T + 0.3)
    gap, mag = np.angle(f) - np.angle(h), abs(h) + 1e-12
    gap = (gap + np.pi) % (2 * np.pi) - np.pi
    assert abs(spectra.phase_gap(df, ["case"], "v", "w", 8).first()["d_phase"] - (abs(gap) * mag).sum() / mag.sum()) < 1e-9
    none = spectra.spectral_info(df.selectExpr("case", "r", "c", "0D AS v"), ["case"], "v", 8).first()
    assert (none["centroid"], none["hf_ratio"], none["lf_ratio"]) == (0.0, 0.0, 1.0)


def test_knee_of_a_falling_and_a_flat_curve(spark):
    df = spark.createDataFrame([("a", x, y) for x, y in zip((0.0, 1.0, 2.0, 4.0), (10.0, 8.0, 2.0, 0.0))] + [("b", x, 5.0) for x in (0.0, 1.0, 2.0)], "g string, x double, y double")
    got = {r["g"]: r for r in studies.knee(df, ["g"], "x", "y").collect()}
    a = got["a"]
    assert (a["knee"], a["r80"], a["has_seam"]) == (1.0, 2.0, True) and abs(a["r95"] - 3.5) < 1e-9 and a["reduction"] == 10.0
    assert (got["b"]["knee"], got["b"]["r80"], got["b"]["reduction"], got["b"]["has_seam"]) == (0.0, 0.0, 0.0, False)


def test_hash_table_finds_every_key_by_probing(spark):
    df = spark.createDataFrame([(int(k),) for k in np.random.default_rng(3).choice(10**6, 900, replace=False)], "k long").repartition(5)
    rows = layouts.hash_table(df, "k", 10, ranges=16).collect()
    at = {r["place"]: r["key"] for r in rows}
    assert len(at) == 900
    for r in rows:
        p = r["home"]
        while at[p] != r["key"]:
            p += 1
        assert p == r["place"] >= r["home"]


def test_permutation_and_signs(spark):
    rng = np.random.default_rng(4)
    pos = rng.random(60) < 0.4
    rows = [(i, float(np.round(rng.normal() + 1.5 * p, 1)), bool(p)) for i, p in enumerate(pos)]
    df = spark.createDataFrame(rows, "id long, s double, pos boolean").repartition(4)

    def auc(labels):
        a, b = ([s for (_, s, _), t in zip(rows, labels) if t is v] for v in (True, False))
        return sum((x > y) + 0.5 * (x == y) for x in a for y in b) / (len(a) * len(b))

    seen, k = auc([bool(p) for p in pos]), int(pos.sum())
    hits = 0
    for r in range(1, 31):
        first = set(sorted(range(60), key=lambda i: (deltas.digest(5, i, r), i))[:k])
        hits += auc([i in first for i in range(60)]) >= seen
    for bins in (1, 7, 1024):
        got = evaluation.permutation_auc(df, "s", "pos", "id", 30, 5, bins).first()
        assert abs(got["auc"] - seen) < 1e-12 and abs(got["p"] - (hits + 1) / 31) < 1e-12
    z = spark.createDataFrame([(x,) for x in (0.0, 0.5, 1.96, 4.0)], "z double")
    for r in z.select("z", evaluation.two_sided(z["z"]).alias("p")).collect():
        assert abs(r["p"] - math.erfc(r["z"] / 2**0.5)) < 2e-7
    lo, hi = evaluation.auc_interval(df, "s", "pos", "id", 100).first()
    assert lo <= seen <= hi


def test_seam_of_a_path(spark):
    e = spark.createDataFrame([(a, b) for i in range(5) for a, b in ((i, i + 1), (i + 1, i))], "src long, dst long")
    v = spark.createDataFrame([(i, float(i * i)) for i in range(6)], "id long, v double")
    m = spark.createDataFrame([(7, 0), (7, 1)], "unit int, id long")
    r = units.seam_of_sets(m, e, v, 1).first()
    assert (r["jump_in"], r["jump_out"]) == (3.0, 5.0)
    r = units.seam_of_sets(m, e, v, 2).first()
    assert (r["jump_in"], r["jump_out"]) == (3.0, 7.0)


def test_perturbed_states(spark):
    df = spark.createDataFrame([(k, s, 1.0) for k in range(40) for s in range(3)], "k int, step int, v double")
    still = studies.perturbed(df, "step", "v", "k", 1, drift=0.5).collect()
    assert all(r["out"] == 1 + 0.5 * r["step"] for r in still)
    hit = studies.perturbed(df, "step", "v", "k", 1, event=1, jump=9.0, share=0.5).where("out > 1").collect()
    assert {r["step"] for r in hit} == {1} and 8 < len(hit) < 32


def test_neighbours_of_clustered_points(spark):
    rng = np.random.default_rng(6)
    xy = np.vstack([rng.normal(0, 1e-2, (300, 2)), rng.random((40, 2)) * 10, np.full((5, 2), 5.0)])
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, x double, y double")
    got = {(r["src"], r["dst"]) for r in spaces.knn_edges(p, 4).collect()}
    want = set()
    for i, a in enumerate(xy):
        d = [(math.sqrt((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2), j) for j, b in enumerate(xy) if j != i]
        want |= {(i, j) for _, j in sorted(d)[:4]}
    assert got == want


def test_deep_heap_nodes_and_large_coordinates(spark):
    import pytest
    from pyspark.sql import functions as F

    from tessera.functions.scalar import morton
    from tessera.operators import graphs

    def steps(u, v):
        n = 0
        while u != v:
            u, v = ((u - 1) // 2, v) if u > v else (u, (v - 1) // 2)
            n += 1
        return n

    pairs = [(0, 0), (0, 2**40), (2**45 + 7, 2**45 + 8), (2**50, 2**50 + 1), (5, 12), (2**33 + 1, 2**34 + 3)]
    df = spark.createDataFrame(pairs, "u long, v long").withColumn("d", graphs.heap_distance(F.col("u"), F.col("v")))
    assert all(r["d"] == steps(r["u"], r["v"]) for r in df.collect())
    big = spark.createDataFrame([(2**31 - 1, 0), (0, 2**31 - 1), (70000, 3)], "r long, c long")
    for x in big.withColumn("m", morton(F.col("r"), F.col("c"))).collect():
        assert x["m"] == sum(((x["c"] >> i) & 1) << 2 * i | ((x["r"] >> i) & 1) << 2 * i + 1 for i in range(31))
    for bad in (-1, 2**31):
        with pytest.raises(Exception, match="coordinate"):
            spark.range(1).select(morton(F.lit(bad), F.col("id"))).collect()
