"""Queries on labelled deltas, the soft gate, seams of sets, layouts by hash and page, and interval tests."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import evaluation, gating, layouts, refine, scales, select, spectra, studies, trees, units
from ..sources import deltas, spaces
from ..sources.tables import table
from . import refinement
from .catalog import CELL, RHO, SIDE, TILE, TREE, UND, VERT, _cases, _r, _sales, _und, query
from .catalog_graphs import STENCIL, TM, _tiles
from .catalog_scales import PV, WEIGHT, _dft, _pv, digest_sql

SEED = 42


# --- labelled deltas ---------------------------------------------------------------------------------------------


def _normal(seed: int, *keys: str) -> str:
    return f"(sqrt(-2*ln({digest_sql(seed, *keys)}))*cos(2*pi()*{digest_sql(seed + 7919, *keys)}))"


def _blur(name: str, sigma: float, seed: int) -> str:
    reach = int(4 * sigma + 0.5)
    return (f"{name}k AS (SELECT i, exp(-0.5*(i/{sigma})**2) AS k FROM range(-{reach},{reach}+1) g(i)), "
            f"{name}w AS (SELECT co, CASE WHEN x < 32 THEN x ELSE 63-x END AS f, sum(k)/(SELECT sum(k) FROM {name}k) AS w FROM (SELECT co, k, ((co+i)%64+64)%64 AS x FROM range(32) h(co), {name}k) GROUP BY ALL), "
            f"{name}a AS (SELECT co AS r, c, sum({_normal(seed, 'r', 'c')}*w) AS v FROM cell JOIN {name}w ON r = f GROUP BY ALL), "
            f"{name} AS (SELECT r, co AS c, sum(v*w) AS v FROM {name}a JOIN {name}w ON c = f GROUP BY ALL)")


_ANGLE = 2 * math.pi * deltas.digest(SEED, "angle")
_SIGN = "CASE WHEN {} THEN 1.0 ELSE -1.0 END"
DELTAS = CELL + ", " + _blur("s8", 8.0, SEED + 1) + ", " + _blur("s6", 6.0, SEED + 2) + f""", dl AS (SELECT cell.r, cell.c, unit, gt, coarse, unnest([
 struct_pack(n := 'pos_oracle', d := gt-coarse), struct_pack(n := 'pos_scaled', d := 0.5*(gt-coarse)), struct_pack(n := 'pos_noisy', d := gt-coarse+0.02*{_normal(SEED, 'cell.r', 'cell.c')}),
 struct_pack(n := 'neg_lf_drift', d := gt-coarse+0.3*sin(2*pi()*0.5*cell.c/32+{2 * math.pi * deltas.digest(SEED, 'phase')!r})), struct_pack(n := 'neg_random_lf', d := 0.5*s8.v), struct_pack(n := 'neg_semant_wrong', d := -2*coarse),
 struct_pack(n := 'neg_coarse_shift', d := gt-coarse+0.2*coarse*{_SIGN.format(digest_sql(SEED + 3, 'cell.r', 'cell.c') + ' > 0.5')}), struct_pack(n := 'neg_shift_coherent', d := gt-coarse+0.2*coarse*{_SIGN.format('s6.v > 0')}),
 struct_pack(n := 'neg_shift_block', d := gt-coarse+0.2*coarse*{_SIGN.format(digest_sql(SEED + 4, 'cell.r//8', 'cell.c//8') + ' > 0.5')}),
 struct_pack(n := 'neg_shift_gradient', d := gt-coarse+0.2*coarse*{_SIGN.format(f'{math.cos(_ANGLE)!r}*(cell.c/32-0.5)+{math.sin(_ANGLE)!r}*(cell.r/32-0.5) > 0')})]) AS s
 FROM cell JOIN s8 ON s8.r = cell.r AND s8.c = cell.c JOIN s6 ON s6.r = cell.r AND s6.c = cell.c), dt AS (SELECT r, c, unit, gt, coarse, s.n AS "case", s.n LIKE 'pos%' AS good, s.d AS delta FROM dl)"""


def _deltas(spark, d):
    return deltas.labelled(_sales(spark, d), SIDE, SEED)


@query("delta_cases", DELTAS + ' SELECT r, c, "case", good, round(delta,6) AS delta FROM dt')
def delta_cases(spark, d):
    return _deltas(spark, d).select("r", "c", "case", "good", *_r("delta"))


@query("delta_separability", DELTAS + """, dp AS (SELECT "case", good, unit, round(sqrt(count(*))*abs(avg(delta))/(sqrt(sum(delta*delta))+1e-12),6) AS s FROM dt GROUP BY ALL), cu AS (SELECT s, count(*) FILTER (NOT good) AS p, count(*) FILTER (good) AS n FROM dp GROUP BY s),
 b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS below FROM cu) SELECT round(sum(p*(below+n/2))/(sum(p)*sum(n)),6) AS auc FROM b""")
def delta_separability(spark, d):
    dp = F.sqrt(F.count("*")) * F.abs(F.avg("delta")) / (F.sqrt(F.sum(F.col("delta") * F.col("delta"))) + 1e-12)
    x = _deltas(spark, d).groupBy("case", "good", "unit").agg(F.round(dp, 6).alias("s"))
    return evaluation.roc_auc(x.withColumn("bad", ~F.col("good")), "s", "bad").select(*_r("auc"))


@query("delta_local_variance", DELTAS + """, b AS (SELECT "case", unit, avg(delta*delta) AS q, avg(delta) AS m, avg(abs(delta)) AS a FROM dt GROUP BY ALL), v AS (SELECT "case", var_pop(delta) AS v FROM dt GROUP BY ALL)
 SELECT b."case", CASE WHEN abs(avg(q-m*m)/(max(v)+1e-12)) < 5e-6 THEN 0.0 ELSE round(avg(q-m*m)/(max(v)+1e-12),5) END AS d_local_var, CASE WHEN sqrt(sum(m*m)) < 1e-9 THEN -1.0 ELSE round(sqrt(sum(a*a))/sqrt(sum(m*m)),4) END AS d_abs FROM b JOIN v ON v."case" = b."case" GROUP BY b."case\"""")
def delta_local_variance(spark, d):
    x = _deltas(spark, d)
    n = x.groupBy("case", "unit").agg(F.avg("delta").alias("m")).groupBy("case").agg((scales.norm(F.col("m")) < 1e-9).alias("none"))
    both = scales.local_variance(x, ["case"], ["unit"], "delta").join(scales.abs_vs_signed(x, ["case"], ["unit"], "delta"), "case").join(n, "case")
    local = F.when(F.abs("d_local_var") < 5e-6, 0.0).otherwise(F.round("d_local_var", 5))  # the sign of a difference near 0 depends on the order of sums
    return both.select("case", local.alias("d_local_var"), F.when(F.col("none"), -1.0).otherwise(F.round("d_abs", 4)).alias("d_abs"))


@query("spectral_info", CELL + ", " + _dft("ft", "cell", "(gt-coarse)") + " SELECT round(sum(f*p)/sum(p),6) AS centroid, round(sum(p) FILTER (f > 0.125)/sum(p),6) AS hf_ratio, round(sum(p) FILTER (f < 0.03125)/sum(p),6) AS lf_ratio FROM ft")
def spectral_info(spark, d):
    x = _sales(spark, d).select(F.lit(0).alias("case"), "r", "c", (F.col("gt") - F.col("coarse")).alias("delta"))
    return spectra.spectral_info(x, ["case"], "delta", SIDE).select(*_r("centroid", "hf_ratio", "lf_ratio"))


@query("phase_shift", CELL + ", " + _dft("ft", "cell", "(gt*0.9+r*0.01)") + ", " + _dft("fu", "cell", "gt") + """, g AS (SELECT abs(atan2(ft.im,ft.re)-atan2(fu.im,fu.re)) AS t, sqrt(fu.re*fu.re+fu.im*fu.im)+1e-12 AS m FROM ft JOIN fu ON ft.j = fu.j AND ft.k = fu.k)
 SELECT round(sum(least(t, 2*pi()-t)*m)/sum(m),6) AS d_phase FROM g""")
def phase_shift(spark, d):
    x = _sales(spark, d).select(F.lit(0).alias("case"), "r", "c", "gt", (F.col("gt") * 0.9 + F.col("r") * 0.01).alias("s"))
    return spectra.phase_gap(x, ["case"], "s", "gt", SIDE).select(*_r("d_phase"))


# --- soft gate ---------------------------------------------------------------------------------------------------


def _fold(keys: str) -> str:
    """CTEs from ``tk`` (keys, n from 0, fsr, inst, alpha): thresholds after three ticks, targets, weights."""
    on = " AND ".join(f"x.{k} = y.{k}" for k in keys.split(", "))
    px = ", ".join(f"x.{k}" for k in keys.split(", "))
    return f"""pl AS (SELECT {keys}, list_sort(list(inst) FILTER (n < 3))[2] AS mi, list_sort(list(fsr) FILTER (n < 3))[2] AS mf, count(*) AS c FROM tk GROUP BY ALL),
 th AS (SELECT x.*, CASE WHEN n < 3 THEN 0.25 ELSE least(0.25, mi*0.7) END AS ti, CASE WHEN n < 3 THEN 0.05 ELSE greatest(0.05, least(0.05, mf*0.7)) END AS tf FROM tk x JOIN pl y ON {on}),
 tg AS (SELECT *, inst <= ti AND fsr <= tf AS ok, CASE WHEN inst <= ti AND fsr <= tf THEN 1.0 ELSE greatest(0.2, 1-0.5*least(1.0, greatest(0.0, inst-ti)/greatest(ti,1e-6))) END AS w FROM th),
 gt(n, {keys}, tick, ok, r, h, v) AS (SELECT n, {keys}, tick, ok, CAST(1+alpha*(w-1) AS DOUBLE), CAST(alpha*(1-w)*0.6 AS DOUBLE), CAST(alpha*(1-w)*0.4 AS DOUBLE) FROM tg WHERE n = 0
 UNION ALL SELECT x.n, {px}, x.tick, x.ok, r+x.alpha*(w-r), h+x.alpha*((1-w)*0.6-h), v+x.alpha*((1-w)*0.4-v) FROM tg x JOIN gt y ON {on} AND x.n = y.n+1)"""


GATE = gating.GateConfig(fsr=0.05)


@query("weighted_gate", "WITH RECURSIVE tk AS (SELECT *, CAST(row_number() OVER (PARTITION BY node ORDER BY tick)-1 AS INT) AS n FROM (SELECT user_id AS node, CAST(day(ts) AS INT) AS tick, coalesce(stddev_pop(value),0)/(avg(abs(value))+1e-9) AS inst, avg(CASE WHEN value < 20 THEN 0.2 ELSE 0.0 END) AS fsr, 0.3 AS alpha FROM events GROUP BY ALL)), " + _fold("node")
       + " SELECT node, tick, CASE WHEN ok THEN 'healthy' ELSE 'combo' END AS stage, round(r+1e-9,6) AS w_resid, round(h+1e-9,6) AS w_hf, round(v+1e-9,6) AS w_var FROM gt")
def weighted_gate(spark, d):
    g = table(spark, d, "events").groupBy(F.col("user_id").alias("node"), F.dayofmonth("ts").alias("tick"))
    x = g.agg((F.stddev_pop("value") / (F.avg(F.abs("value")) + 1e-9)).alias("inst"), F.avg(F.when(F.col("value") < 20, 0.2).otherwise(0.0)).alias("fsr"))
    return gating.weighted_gate(x, ["node"], "tick", "fsr", "inst", F.lit(0.3), GATE).select("node", "tick", "stage", *[F.round(F.col(w) + 1e-9, 6).alias(w) for w in ("w_resid", "w_hf", "w_var")])


@query("gate_stress", """WITH RECURSIVE tk AS (SELECT *, inst*0.3 AS fsr FROM (SELECT profile, CAST(alpha AS DOUBLE) AS alpha, CAST(t AS INT) AS tick, CAST(t AS INT) AS n, CAST(CASE profile WHEN 'stable' THEN 0.1 WHEN 'ramp' THEN 0.1+0.7*(t/14) WHEN 'step' THEN CASE WHEN t < 7 THEN 0.1 ELSE 0.8 END ELSE CASE WHEN t%2 = 0 THEN 0.1 ELSE 0.8 END END AS DOUBLE) AS inst
 FROM range(15) g(t), (VALUES ('stable'),('ramp'),('step'),('oscillating')) p(profile), (VALUES (0.1),(0.2),(0.3),(0.5)) a(alpha))), """ + _fold("profile, alpha") + """
 SELECT profile, alpha, round(greatest(var_pop(r) FILTER (tick > 11), var_pop(h) FILTER (tick > 11), var_pop(v) FILTER (tick > 11)),8) AS spread, round(max(r) FILTER (tick = 14)+1e-9,6) AS w_resid, count(*) FILTER (ok) AS healthy, count(*) FILTER (NOT ok) AS combo,
 greatest(var_pop(r) FILTER (tick > 11), var_pop(h) FILTER (tick > 11), var_pop(v) FILTER (tick > 11)) < 0.05 AS converged FROM gt GROUP BY profile, alpha""")
def gate_stress(spark, d):
    p = gating.profiles(spark, 15).withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in (0.1, 0.2, 0.3, 0.5)])))
    g = gating.weighted_gate(p, ["profile", "alpha"], "tick", "fsr", "instability", F.col("alpha"), GATE)
    return gating.convergence(g, ["profile", "alpha"], "tick", 14).select("profile", "alpha", *_r("spread", n=8), F.round(F.col("w_resid") + 1e-9, 6).alias("w_resid"), "healthy", "combo", "converged")


# --- seams, gains and basins of graphs and trees -----------------------------------------------------------------

SETSEAM = """, halo AS (SELECT DISTINCT m.unit, dst AS id FROM mem m JOIN adj ON m.id = src EXCEPT SELECT unit, id FROM mem), e AS (SELECT h.unit, abs(a.v-b.v) AS j, m.id IS NOT NULL AS inner_ FROM halo h JOIN adj ON adj.src = h.id LEFT JOIN mem m ON m.unit = h.unit AND m.id = dst
 LEFT JOIN halo o ON o.unit = h.unit AND o.id = dst JOIN val a ON a.id = h.id JOIN val b ON b.id = dst WHERE o.id IS NULL)
 SELECT unit, round(coalesce(median(j) FILTER (NOT inner_),0),6) AS jump_out, round(coalesce(median(j) FILTER (inner_),0),6) AS jump_in, round(coalesce(quantile_cont(j,0.95) FILTER (NOT inner_),0),6) AS p95_out, round(coalesce(median(j) FILTER (NOT inner_),0)/(coalesce(median(j) FILTER (inner_),0)+1e-8),4) AS seam FROM e GROUP BY unit"""


def _seams(df):
    return df.select("unit", *_r("jump_out", "jump_in", "p95_out"), *_r("seam", n=4))


@query("seam_graph", UND + ", adj AS (SELECT src, dst FROM und UNION ALL SELECT dst, src FROM und), mem AS (SELECT community AS unit, id FROM vert), val AS (SELECT id, gt AS v FROM vert)" + SETSEAM)
def seam_graph(spark, d):
    from ..operators import graphs

    v, e = _und(spark, d)
    return _seams(units.seam_of_sets(v.select(F.col("community").alias("unit"), "id"), graphs.both_ways(e.checkpoint()), v.select("id", F.col("gt").alias("v")), 1))


@query("seam_tree", TREE + ", adj AS (SELECT id AS src, parent AS dst FROM node WHERE parent IS NOT NULL UNION ALL SELECT parent, id FROM node WHERE parent IS NOT NULL), mem AS (SELECT unit, id FROM node WHERE unit IS NOT NULL), val AS (SELECT id, gt AS v FROM node)" + SETSEAM)
def seam_tree(spark, d):
    from ..operators import graphs

    t = spaces.tree_nodes(spark, d)
    e = t.where("parent IS NOT NULL").select(F.col("id").alias("src"), F.col("parent").alias("dst"))
    return _seams(units.seam_of_sets(t.where("unit IS NOT NULL").select("unit", "id"), graphs.both_ways(e), t.select("id", F.col("gt").alias("v")), 1))


@query("interior_gain", CELL + " SELECT unit, round(greatest(0.0, avg((gt-coarse)**2)-avg((gt-coarse-0.4*(gt-coarse)-0.05)**2)),6) AS gain FROM cell GROUP BY unit")
def interior_gain(spark, d):
    c = _sales(spark, d).withColumn("s", F.col("coarse") + 0.4 * (F.col("gt") - F.col("coarse")) + 0.05)
    return units.interior_gain(c, "coarse", "s").select("unit", *_r("gain"))


@query("edge_amplitude", CELL + """, x AS (SELECT a.r AS l, 0 AS ax, avg(abs(a.gt-b.gt)) AS v FROM cell a JOIN cell b ON b.r = a.r-1 AND b.c = a.c WHERE a.r > 0 AND a.r%4 = 0 GROUP BY 1 UNION ALL SELECT a.c, 1, avg(abs(a.gt-b.gt)) FROM cell a JOIN cell b ON b.c = a.c-1 AND b.r = a.r WHERE a.c > 0 AND a.c%4 = 0 GROUP BY 1)
 SELECT round(avg(v),6) AS amplitude FROM x""")
def edge_amplitude(spark, d):
    return studies.edge_amplitude(_sales(spark, d).withColumn("case", F.lit(0)), TILE, "gt", ["case"]).select(*_r("amplitude"))


BASIN = " rho1 < 0.1*rho0 OR rho0 <= 1e-12"


@query("basins_tree", TREE + ", x AS (SELECT id, (gt-coarse)**2 AS rho0, (gt-coarse)**2*(CASE WHEN id%3 = 0 THEN 0.05 ELSE 0.5 END) AS rho1 FROM node) SELECT id AS unit, CASE WHEN" + BASIN + " THEN 'basin_' || CASE WHEN id > 0 THEN (id-1)//2 ELSE id END ELSE 'singleton_' || id END AS basin FROM x")
def basins_tree(spark, d):
    r = (F.col("gt") - F.col("coarse")) ** 2
    x = spaces.tree_nodes(spark, d).select(F.col("id").alias("unit"), r.alias("rho0"), (r * F.when(F.col("id") % 3 == 0, 0.05).otherwise(0.5)).alias("rho1"))
    return trees.basins_tree(x)


@query("basins_graph", VERT + ", x AS (SELECT id, community, (gt-coarse)**2 AS rho0, (gt-coarse)**2*(CASE WHEN id%3 = 0 THEN 0.05 ELSE 0.5 END) AS rho1 FROM vert) SELECT id AS unit, 'c' || community || CASE WHEN" + BASIN + " THEN '_converged' ELSE '_active' END AS basin FROM x")
def basins_graph(spark, d):
    r = (F.col("gt") - F.col("coarse")) ** 2
    x = spaces.vertices(spark, d).select(F.col("id").alias("unit"), "community", r.alias("rho0"), (r * F.when(F.col("id") % 3 == 0, 0.05).otherwise(0.5)).alias("rho1"))
    return trees.basins_graph(x, "community")


# --- layouts -----------------------------------------------------------------------------------------------------


@query("hash_layout", """WITH k AS (SELECT o_orderkey AS key, ((o_orderkey*2654435769) & 4294967295) >> 14 AS home FROM orders), o AS (SELECT *, row_number() OVER (ORDER BY home, key)-1 AS i FROM k)
 SELECT key, home, CAST(i + max(home-i) OVER (ORDER BY home, key ROWS UNBOUNDED PRECEDING) AS BIGINT) AS place FROM o""")
def hash_layout(spark, d):
    return layouts.hash_table(table(spark, d, "orders"), "o_orderkey", 18)


@query("page_table", CELL + """, p AS (SELECT r//8 AS py, c//8 AS px, count(*) AS n, list((r%8)*8 + c%8) AS bits FROM cell WHERE gt > 4.8 GROUP BY ALL)
 SELECT py, px, CAST(row_number() OVER (ORDER BY py, px)-1 AS BIGINT) AS slot, n, list_sort(bits)[1] AS first_bit, list_sort(bits)[-1] AS last_bit FROM p""")
def page_table(spark, d):
    p = layouts.pages(_sales(spark, d).withColumn("active", F.col("gt") > 4.8), 8)
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("mask", i) == 1)
    return p.select("py", "px", F.col("slot").cast("long").alias("slot"), "n", F.array_min(bits).alias("first_bit"), F.array_max(bits).alias("last_bit"))


@query("halo_gather", TM + """ SELECT t.unit, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(coalesce(CASE WHEN o.slot >= 0 THEN gt END, 0.0),6) AS v FROM tm t CROSS JOIN range(6) g(i) CROSS JOIN range(6) h(j)
 LEFT JOIN cell ON r = t.ti*4+i-1 AND c = t.tj*4+j-1 LEFT JOIN tm o ON o.unit = cell.unit WHERE t.slot >= 0""")
def halo_gather(spark, d):
    return layouts.gather_halo(_sales(spark, d), _tiles(spark, d), TILE, 1).select("unit", "i", "j", *_r("v"))


@query("depthwise_stencil", """WITH e AS (SELECT CAST(vec_id//20 AS INT) AS r, CAST(vec_id%20 AS INT) AS c, unnest(range(len(embedding))) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), w AS (SELECT i, j, list_extract([0.05,0.1,0.05,0.1,0.4,0.1,0.05,0.1,0.05], CAST((i+1)*3+j+2 AS BIGINT)) AS w FROM range(-1,2) g(i), range(-1,2) h(j))
 SELECT a.r, a.c, CAST(a.d AS INT) AS d, round(sum(b.x*w),5) AS v FROM e a CROSS JOIN w JOIN e b ON b.r = a.r+i AND b.c = a.c+j AND b.d = a.d GROUP BY a.r, a.c, a.d""")
def depthwise_stencil(spark, d):
    return layouts.stencil(spaces.vector_cells(spark, d), STENCIL, within="d").select("r", "c", "d", *_r("v", n=5))


@query("state_hash", CELL + """, u AS (SELECT unit, sha256(string_agg(printf('%d:%d:%.6f', r, c, round(gt,6)), ';' ORDER BY r, c)) AS h FROM cell GROUP BY unit), b AS (SELECT unit//4096 AS block, sha256(string_agg(h, ';' ORDER BY unit)) AS h FROM u GROUP BY 1)
 SELECT substr(sha256(string_agg(h, ';' ORDER BY block)),1,16) AS hash FROM b""")
def state_hash(spark, d):
    return units.state_hash(_sales(spark, d), "gt")


# --- tests -------------------------------------------------------------------------------------------------------


@query("holm_strict", PV + ", o AS (SELECT k, p, row_number() OVER (ORDER BY p, k) AS i, count(*) OVER () AS m FROM pv) SELECT k, round(0.05/(m-i+1),8) AS bound, round(least(1.0, p*(m-i+1)),6) AS adjusted, p < 0.05/(m-i+1) AS reject FROM o")
def holm_strict(spark, d):
    return evaluation.holm(_pv(spark, d), "p", "k", stop=False, strict=True, monotone=False).select("k", *_r("bound", n=8), *_r("adjusted"), "reject")


def _p(z: str) -> str:
    t = f"(1/(1+0.3275911*(abs({z})/sqrt(2))))"
    return f"({t}*(0.254829592+{t}*(-0.284496736+{t}*(1.421413741+{t}*(-1.453152027+{t}*1.061405429))))*exp(-({z})*({z})/2))"


@query("sign_test", "WITH x AS (SELECT l_suppkey%20 AS g, round(l_extendedprice/1000,1) - round(l_quantity*1.5,1) AS dd FROM lineitem), y AS (SELECT g, count(*) FILTER (dd <> 0) AS n, count(*) FILTER (dd > 0) AS plus FROM x GROUP BY g) SELECT g, n, plus, round(least(1.0, " + _p("greatest(0.0, abs(plus-n/2)-0.5)/sqrt(n/4)") + "),6) AS p FROM y")
def sign_test(spark, d):
    li = table(spark, d, "lineitem")
    x = li.select((F.col("l_suppkey") % 20).alias("g"), F.round(F.col("l_extendedprice") / 1000, 1).alias("a"), F.round(F.col("l_quantity") * 1.5, 1).alias("b"))
    return evaluation.sign_test(x, "a", "b", ["g"]).select("g", "n", "plus", *_r("p"))


ROWS = "x AS (SELECT o_orderkey AS id, round(o_totalprice/1000) AS s, o_orderstatus = 'F' AS pos FROM orders)"
AUC = "SELECT round, sum(p*(below+n/2))/(sum(p)*sum(n)) AS auc FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY round ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS below FROM c) GROUP BY round"


def _rows(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") / 1000).alias("s"), (F.col("o_orderstatus") == "F").alias("pos"))


@query("permutation_auc", ROWS + ", u AS (SELECT id, s, rd AS round, " + digest_sql(7, "id", "rd") + " AS u FROM x, range(1,20) g(rd)), t AS (SELECT round, s, row_number() OVER (PARTITION BY round ORDER BY u, id) <= (SELECT count(*) FROM x WHERE pos) AS t FROM u UNION ALL SELECT 0, s, pos FROM x), c AS (SELECT round, s, count(*) FILTER (t) AS p, count(*) FILTER (NOT t) AS n FROM t GROUP BY ALL), a AS (" + AUC
       + ") SELECT round((SELECT auc FROM a WHERE round = 0),6) AS auc, round(((SELECT count(*) FROM a WHERE round > 0 AND auc >= (SELECT auc FROM a WHERE round = 0))+1)/20,6) AS p")
def permutation_auc(spark, d):
    return evaluation.permutation_auc(_rows(spark, d), "s", "pos", "id", 19, 7).select(*_r("auc", "p"))


@query("auc_interval", ROWS + ", u AS (SELECT pos, s, rd AS round, " + digest_sql(3, "id", "rd") + " AS u FROM x, range(1,21) g(rd)), c AS (SELECT round, s, sum(CASE WHEN pos THEN w ELSE 0 END) AS p, sum(CASE WHEN pos THEN 0 ELSE w END) AS n FROM (SELECT *, " + WEIGHT + " AS w FROM u) GROUP BY ALL), a AS (" + AUC + ") SELECT round(quantile_cont(auc,0.025),6) AS lo, round(quantile_cont(auc,0.975),6) AS hi FROM a")
def auc_interval(spark, d):
    return evaluation.auc_interval(_rows(spark, d), "s", "pos", "id", 20, 0.05, 3).select(*_r("lo", "hi"))


@query("run_spread", "SELECT l_returnflag AS g, round(avg(l_extendedprice),4) AS mean, round(stddev_pop(l_extendedprice)/abs(avg(l_extendedprice)),6) AS cv FROM lineitem GROUP BY 1")
def run_spread(spark, d):
    return studies.spread(table(spark, d, "lineitem").withColumn("g", F.col("l_returnflag")), ["g"], "l_extendedprice").select("g", *_r("mean", n=4), *_r("cv"))


@query("curve_knee", """WITH y AS (SELECT l_returnflag AS g, l_linenumber AS x, sum(l_quantity)/1000 AS y FROM lineitem GROUP BY ALL), z AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, first_value(y) OVER w AS top, last_value(y) OVER (PARTITION BY g ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS low FROM y WINDOW w AS (PARTITION BY g ORDER BY x)),
 k AS (SELECT *, CASE WHEN y >= top-0.8*(top-low) AND top-0.8*(top-low) >= y2 THEN x+(y-(top-0.8*(top-low)))/(y-y2+1e-15)*(x2-x) END AS e8, CASE WHEN y >= top-0.95*(top-low) AND top-0.95*(top-low) >= y2 THEN x+(y-(top-0.95*(top-low)))/(y-y2+1e-15)*(x2-x) END AS e9, (y2-y)/(x2-x+1e-15) AS s FROM z),
 m AS (SELECT g, max(top-low) AS fall, max(top) AS top, CAST(arg_min(x, s) AS DOUBLE) AS knee, coalesce(arg_min(e8, CASE WHEN e8 IS NOT NULL THEN x END), max(x)) AS r80, coalesce(arg_min(e9, CASE WHEN e9 IS NOT NULL THEN x END), max(x)) AS r95 FROM k GROUP BY g)
 SELECT g, CASE WHEN fall >= 1e-10 THEN knee ELSE 0 END AS knee, round(CASE WHEN fall >= 1e-10 THEN r80 ELSE 0 END,5) AS r80, round(CASE WHEN fall >= 1e-10 THEN r95 ELSE 0 END,5) AS r95, round(greatest(fall,0),5) AS reduction, fall > greatest(0.05*top, 1e-10) AS has_seam FROM m""")
def curve_knee(spark, d):
    y = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("g"), F.col("l_linenumber").alias("x")).agg((F.sum("l_quantity") / 1000).alias("y"))
    return studies.knee(y, ["g"], "x", "y").select("g", F.col("knee").cast("double").alias("knee"), *_r("r80", "r95", "reduction", n=5), "has_seam")
