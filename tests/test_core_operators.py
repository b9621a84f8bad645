"""Small hand-made tables with known answers, and invariants of what SQL does not express."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import gates, scalar
from tessera.operators import evaluation, graphs, layouts, refine, scales, select, states, trees, units
from tessera.sources import fields, spaces, tables


def val(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_probe_seed_and_region_uri(spark):
    import hashlib

    assert val(spark, scalar.probe_seed(F.lit(3), F.lit(4), 0, 42)) == 3754413862
    assert val(spark, scalar.region_uri(F.lit("a"), F.lit("b"), F.lit(3))) == hashlib.sha256(b"a|b|3").hexdigest()[:16]


@pytest.mark.parametrize("r,c,z", [(0, 0, 0), (0, 1, 1), (1, 0, 2), (3, 5, 0b011011), (65535, 65535, 2**32 - 1)])
def test_morton(spark, r, c, z):
    assert val(spark, scalar.morton(F.lit(r), F.lit(c))) == z


def test_quantize_is_half_even_and_clamped(spark):
    assert [val(spark, scalar.quantize(F.lit(x), 1.0)) for x in (-1.0, 0.0, 0.5, 2.5 / 15, 3.5 / 15, 9.0)] == [0, 0, 8, 2, 4, 15]


def test_signature_parts(spark):
    sig = scalar.pack(F.lit(7), F.lit(3), F.lit(12))
    assert val(spark, sig) == 0x73C and [val(spark, scalar.nibble(sig, k)) for k in (2, 1, 0)] == [7, 3, 12]
    assert val(spark, scalar.hamming12(F.lit(0xFFF), F.lit(0x0F0))) == 8
    assert val(spark, scalar.component_diff(F.lit(0x73C), F.lit(0x701))) == 11


def test_psnr(spark):
    assert val(spark, scalar.psnr(F.lit(0.0), F.lit(1.0))) == 100.0
    assert val(spark, scalar.psnr(F.lit(0.01), F.lit(1.0))) == pytest.approx(20)


def grid4(spark):
    return spaces.grid_cells(spark.createDataFrame([(i // 4, i % 4, float(i)) for i in range(16)], "r int, c int, gt double"), 4, 2)


def test_rho_of_a_small_grid(spark):
    got = {r["unit"]: r["rho"] for r in units.rho(grid4(spark)).collect()}
    assert got == {k: pytest.approx(4.25) for k in range(4)}


def test_masks_and_halo(spark):
    u = spark.createDataFrame([(0, 0, 0, 2, 2)], "unit int, r0 int, c0 int, r1 int, c1 int")
    m = {(r["r"], r["c"]): r["m"] for r in refine.grid_masks(u, 4, 1).collect()}
    assert len(m) == 9 and m[1, 1] == 1.0 and m[0, 1] == pytest.approx(0.5 * (1 - math.cos(math.pi / 2)))
    assert {r["m"] for r in refine.grid_masks(u, 4, 0).collect()} == {1.0}


def test_full_masks_reach_the_reference(spark):
    c = grid4(spark)
    m = c.select("unit", "r", "c", F.lit(1.0).alias("m"))
    assert refine.refined(c, m, ["r", "c"]).where(F.abs(F.col("gt") - F.col("state")) > 0).count() == 0


def test_rank_and_prefix_over_buckets_equal_plain_ones(spark):
    rng = random.Random(1)
    rows = [(i, float(rng.choice([rng.randint(0, 9), rng.random() * 10]))) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, s double")
    order = sorted(rows, key=lambda x: (-x[1], x[0]))
    got = {r["id"]: r["rank"] for r in select.ranked(df, "s", "id").collect()}
    assert [got[i] for i, _ in order] == list(range(1, 501))
    p = {r["id"]: r["spent"] for r in select.prefix_budget(df.withColumn("one", F.lit(1.0)), "one", "s", "id", 100.0).collect()}
    assert [p[i] for i, _ in order] == [float(k) for k in range(500)]


def test_threshold_top_k_keeps_ties(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 2.0), (3, 2.0), (4, 1.0)], "id int, s double")
    assert {r["id"] for r in select.threshold_top_k(df, "s", 2).collect()} == {1, 2, 3}


def test_block_projection_is_idempotent(spark):
    c = grid4(spark)
    once = scales.block_prolong(c, scales.block_restrict(c, "gt"))
    once = once.withColumnRenamed("up", "x")
    twice = scales.block_prolong(once, scales.block_restrict(once, "x"))
    assert twice.where(F.abs(F.col("x") - F.col("up")) > 1e-12).count() == 0
    assert {"r", "c"} <= set(once.columns)


def test_weights_of_linear_maps_add_to_one(spark):
    for w, key in ((scales.gaussian_weights(spark, 16, 1.5), "coarse"), (scales.bilinear_weights(spark, 16, 8), "fine"), (scales.lanczos_weights(spark, 16), "coarse")):
        assert w.groupBy(key).agg(F.sum("w").alias("s")).where(F.abs(F.col("s") - 1) > 1e-9).count() == 0


def test_gates(spark):
    z = [val(spark, gates.zone(1, F.lit(k), F.lit(g))) for k, g in ((0.1, 0.5), (-0.1, 0.1), (-0.1, 0.2))]
    assert z == ["GREEN", "YELLOW", "RED"]
    assert val(spark, gates.two_stage(F.lit(1.0), F.lit(1.0), 0.1, 0.1)) == 0.2
    assert val(spark, gates.two_stage(F.lit(0.0), F.lit(0.1), 0.1, 0.1)) == 1.0
    assert val(spark, gates.should_compress(F.lit(10), F.lit(5), F.lit(50))) == "bombardment_density"


def test_auc_with_ties_and_thresholds(spark):
    df = spark.createDataFrame([(0.1, False), (0.4, False), (0.4, True), (0.8, True)], "s double, y boolean")
    assert evaluation.roc_auc(df, "s", "y").first()["auc"] == pytest.approx(0.875)
    assert evaluation.average_precision(df, "s", "y").first()["ap"] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)
    assert evaluation.best_threshold(df, "s", "y").first()["threshold"] in (0.4, 0.8)
    one = spark.createDataFrame([(0.1, True)], "s double, y boolean")
    assert evaluation.roc_auc(one, "s", "y").first()["auc"] is None


def test_holm_variants(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "k string, p double")
    stop = {r["k"]: (round(r["adjusted"], 6), r["reject"]) for r in evaluation.holm(df, "p", "k").collect()}
    assert stop == {"a": (0.03, True), "c": (0.06, False), "b": (0.06, False)}
    free = {r["k"]: r["reject"] for r in evaluation.holm(df, "p", "k", stop=False).collect()}
    assert free == {"a": True, "c": False, "b": True}


def test_knn_equals_brute_force(spark):
    p = fields.random_points(spark, 120, 4)
    rows = [tuple(r) for r in p.collect()]
    got = {}
    for r in spaces.knn_edges(p, 4).collect():
        got.setdefault(r["src"], set()).add(r["dst"])
    for i, x, y in rows:
        near = sorted((math.hypot(x - a, y - b), j) for j, a, b in rows if j != i)[:4]
        assert got[i] == {j for _, j in near}


def test_lattice_and_components(spark):
    e = spaces.lattice_edges(spark, 5)
    assert e.count() == 40
    n = spark.range(25).union(spark.range(30, 33))
    got = {r["id"]: r["component"] for r in graphs.components(n, e).collect()}
    assert all(got[k] == 0 for k in range(25)) and got[31] == 31


def test_triangle_curvature_and_clustering(spark):
    e = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (2, 3)], "src long, dst long")
    f = {(r["src"], r["dst"]): r["curvature"] for r in graphs.forman(e).collect()}
    assert f == {(0, 1): 3.0, (0, 2): 2.0, (1, 2): 2.0, (2, 3): 0.0}
    c = {r["id"]: r["clustering"] for r in graphs.clustering(e).collect()}
    assert c == {0: 1.0, 1: 1.0, 2: pytest.approx(1 / 3), 3: 0.0}


def test_ollivier_of_known_graphs():
    k4 = [(a, b) for a in range(4) for b in range(4) if a < b]
    assert 1 - graphs.walk_distance(k4, 0, 1, 0.5) == pytest.approx(2 / 3)
    path = [(0, 1), (1, 2), (2, 3)]
    assert 1 - graphs.walk_distance(path, 1, 2, 0.5) == pytest.approx(0.0)


def test_label_propagation_gives_connected_covering_blocks(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)], "src long, dst long")
    out = graphs.label_propagation(spark.range(6), e, 6).collect()
    assert len(out) == 6 and len({r["block"] for r in out}) <= 3


def test_chains_and_segments(spark):
    t = fields.chained_tree(spark, 3, 4)
    c = trees.degree2_chains(t)
    assert c.groupBy("head").count().where("count <> 4").count() == 0 and c.count() == 6 * 4
    s = trees.segments(c, c.select("node"), most=3)
    assert s.groupBy("segment").count().where("count <> 3").count() == 0


def test_heap_distance(spark):
    got = [val(spark, graphs.heap_distance(F.lit(a), F.lit(b))) for a, b in ((0, 0), (1, 2), (3, 4), (3, 6), (0, 14))]
    assert got == [0, 2, 2, 4, 3]


def test_debounce_and_stability(spark):
    sig = [0, 0x700, 0x700, 0, 0x700]
    df = spark.createDataFrame([(1, k, s) for k, s in enumerate(sig)], "node long, step int, sig int")
    got = {r["step"]: r["trigger"] for r in states.debounce(df, "node", "step", "sig").collect()}
    assert got == {0: False, 1: False, 2: True, 3: False, 4: False}
    same = spark.createDataFrame([(1, k, 5) for k in range(3)], "node long, step int, sig int")
    assert states.stability(same, "node", "step", "sig").first()["stable"]


def test_tile_slots_and_memory(spark):
    c = grid4(spark).withColumn("active", F.col("unit").isin(1, 3))
    t = {r["unit"]: r["slot"] for r in layouts.tile_map(c).collect()}
    assert t == {0: -1, 1: 0, 2: -1, 3: 1}
    assert layouts.memory_bytes(64, 100)["compact"] == 100 * 8 + 64 * 64 * 4


def test_fields_and_masks_are_deterministic(spark):
    a, b = (sorted(map(tuple, fields.noisy(fields.blob_field(spark, 8, 3), 0.1, 2).collect())) for _ in range(2))
    assert a == b
    for pattern in ("random", "clustered", "checkerboard"):
        assert fields.active_mask(spark, 10, 0.3, pattern).where("active").count() == 30
    assert fields.wave_field(spark, 4, 2).count() == 32 and fields.swiss_roll(spark, 9).count() == 9
    n = fields.random_edges(spark, 200, 0.05, 1).count()
    assert 700 < n < 1300


def test_thresholds_from_json(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"T1_scalar_L1": 0.5, "T1_scalar_L2": 0.25}')
    assert {(r["space"], r["level"], r["tau"]) for r in tables.thresholds_from_json(spark, str(tmp_path / "t.json")).collect()} == {("T1_scalar", 1, 0.5), ("T1_scalar", 2, 0.25)}
    (tmp_path / "b.json").write_text('{"nolevel": 1.0}')
    with pytest.raises(Exception, match="no level"):
        tables.thresholds_from_json(spark, str(tmp_path / "b.json")).collect()


def test_streams_equal_tables(spark, tmp_path):
    from tessera.streaming import stateful

    rows = fields.signature_stream(spark, 12, 8, 0.4, 2)
    rows.repartition(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = stateful.debounce(src).writeStream.format("memory").queryName("deb").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(100)  # an availableNow run ends by itself
    got = sorted(map(tuple, spark.sql("select node, step, trigger from deb").collect()))
    want = sorted(map(tuple, states.debounce(rows, "node", "step", "sig").select("node", F.col("step").cast("long"), "trigger").collect()))
    assert got == want


def test_preferential_attachment_has_hubs(spark):
    from tessera.sources import generators

    e = generators.preferential_attachment(spark, 300, 2, 1)
    d = graphs.degrees(e).agg(F.max("degree").alias("m"), F.avg("degree").alias("a")).first()
    assert e.where("src >= dst").count() == 0 and d["m"] > 4 * d["a"]
    assert generators.clustered_hubs(spark, 200, 4, 2, 5).where("dst >= 200").count() == 0
    assert generators.rewired(spaces.lattice_edges(spark, 6), 36, 0.3).count() > 30


def test_edge_list_and_images(spark, tmp_path):
    import struct

    from tessera.sources import generators

    (tmp_path / "g.txt").write_text("# graph\n1 2\n2 1 5\n3,4\n\n4 4\n")
    assert {tuple(r) for r in generators.edge_list(spark, str(tmp_path / "g.txt")).collect()} == {(1, 2), (3, 4)}
    px = bytes([0, 0, 255, 255, 255, 255, 0, 0]) + bytes([0, 0, 0, 0, 255, 0, 0, 0])
    bmp = b"BM" + struct.pack("<IHHI", 54 + len(px), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2, 2, 1, 24, 0, len(px), 0, 0, 0, 0) + px
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "a.bmp").write_bytes(bmp)
    got = {(r["r"], r["c"]): round(r["gt"], 3) for r in generators.gray_images(spark, str(tmp_path / "i")).collect()}
    assert got == {(0, 0): 0.0, (0, 1): 0.587, (1, 0): 0.299, (1, 1): 1.0}


def test_greedy_blocks_cover_and_stay_small(spark):
    e = spaces.lattice_edges(spark, 6)
    out = graphs.greedy_blocks(e, graphs.components(spark.range(36), e), 9)
    assert out.count() == 36 and out.groupBy("block").count().agg(F.max("count")).first()[0] <= 9


def test_ssim_of_equal_grids_is_zero(spark):
    c = grid4(spark)
    assert scales.ssim(c, "gt", "gt", 4).first()["d_ssim"] == pytest.approx(0, abs=1e-9)
    assert scales.ssim(c, "gt", "coarse", 4).first()["d_ssim"] > 0.01


def test_gap_prefers_the_number_of_groups(spark):
    from tessera.operators import studies

    pts = spark.range(60).select((F.col("id") % 3 * 10 + fields.uniform(1, "id")).alias("x"), (F.col("id") % 3 * 7 + fields.uniform(2, "id")).alias("y"))
    gaps = dict(studies.gap_statistic(pts, ["x", "y"], [2, 3], refs=2))
    assert gaps[3] > gaps[2]
