"""Queries on scales, enforcement, seams, signatures, decisions and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import gates, scalar
from ..operators import enforce, evaluation, refine, scales, select, states, units
from ..sources import spaces
from ..sources.tables import table
from . import refinement
from .catalog import CASES, CELL, DELTA, RHO, SIDE, SIG, TILE, TREE, VERT, _cases, _delta, _r, _sales, _sigs, query


@query("restrict_block", CELL + " SELECT CAST(r//2 AS INT) AS br, CAST(c//2 AS INT) AS bc, round(avg(gt),6) AS v FROM cell GROUP BY ALL")
def restrict_block(spark, d):
    return scales.block_restrict(_sales(spark, d), "gt").select("br", "bc", *_r("v"))


@query("restrict_graph", VERT + " SELECT community, round(avg(gt),8) AS v FROM vert GROUP BY community")
def restrict_graph(spark, d):
    return scales.cluster_restrict(spaces.vertices(spark, d), "gt", "community").select("community", *_r("v", n=8))


@query("prolong_graph", VERT + " SELECT id, round(avg(x) OVER (PARTITION BY community),8) AS up FROM vert")
def prolong_graph(spark, d):
    v = spaces.vertices(spark, d)
    return scales.cluster_prolong(v, scales.cluster_restrict(v, "x", "community"), "community").select("id", *_r("up", n=8))


TREE_R = TREE + ", rt AS (SELECT ((id+1) >> (depth-4)) - 1 AS top, avg(gt) AS v FROM node WHERE depth >= 4 GROUP BY 1)"


@query("restrict_tree", TREE_R + " SELECT CAST(top AS BIGINT) AS top, round(v,6) AS v FROM rt")
def restrict_tree(spark, d):
    return scales.subtree_restrict(spaces.tree_nodes(spark, d), "gt", 4).select("top", *_r("v"))


@query("prolong_tree", TREE_R + """, hi AS (SELECT ((top+1) >> k) - 1 AS id, avg(v) AS v FROM rt, range(1,5) g(k) GROUP BY 1)
 SELECT node.id, round(CASE WHEN depth >= 4 THEN rt.v ELSE hi.v END,6) AS up FROM node LEFT JOIN rt ON depth >= 4 AND rt.top = ((node.id+1) >> greatest(depth-4,0)) - 1 LEFT JOIN hi ON depth < 4 AND hi.id = node.id""")
def prolong_tree(spark, d):
    t = spaces.tree_nodes(spark, d)
    return scales.subtree_prolong(t, scales.subtree_restrict(t, "gt", 4), 4).select("id", *_r("up"))


@query("restrict_gaussian", CELL + """, k AS (SELECT i-4 AS o, exp(-0.5*(i-4)**2) AS w FROM range(9) g(i)), kn AS (SELECT o, w/(SELECT sum(w) FROM k) AS w FROM k),
 wt AS (SELECT f AS fine, c AS crs, sum(w) AS w FROM (SELECT c, w, CASE WHEN x < 32 THEN x ELSE 63-x END AS f FROM (SELECT CAST(j AS INT) AS c, w, ((2*j+o)%64+64)%64 AS x FROM range(16) g(j), kn)) GROUP BY ALL)
 SELECT wr.crs AS r, wc.crs AS c, round(sum(gt*wr.w*wc.w),6) AS v FROM cell JOIN wt wr ON cell.r = wr.fine JOIN wt wc ON cell.c = wc.fine GROUP BY ALL""")
def restrict_gaussian(spark, d):
    w = scales.gaussian_weights(spark, SIDE, 1.0)
    return scales.separable(_sales(spark, d), w, "gt", True).select("r", "c", *_r("v"))


@query("prolong_bilinear", CELL + """, cc AS (SELECT r//2 AS r, c//2 AS c, avg(gt) AS v FROM cell GROUP BY ALL), p AS (SELECT CAST(i AS INT) AS i, i*15/31 AS x FROM range(32) g(i)),
 wt AS (SELECT i AS fine, CAST(floor(x) AS INT) AS crs, 1-(x-floor(x)) AS w FROM p UNION ALL SELECT i, CAST(floor(x) AS INT)+1, x-floor(x) FROM p WHERE x > floor(x) AND floor(x)+1 < 16)
 SELECT wr.fine AS r, wc.fine AS c, round(sum(v*wr.w*wc.w),6) AS v FROM cc JOIN wt wr ON cc.r = wr.crs JOIN wt wc ON cc.c = wc.crs GROUP BY ALL""")
def prolong_bilinear(spark, d):
    c = scales.block_restrict(_sales(spark, d), "gt").select(F.col("br").alias("r"), F.col("bc").alias("c"), "v")
    return scales.separable(c, scales.bilinear_weights(spark, SIDE, SIDE // 2), "v", False).select("r", "c", *_r("v"))


@query("d_parent_metrics", DELTA + """ SELECT nrm.unit, round(sqrt(low*low)/(nd+1e-12),6) AS d_parent, round(nrd/(nc+1e-4*mc),6) AS d_parent_baseline, round(ln(1+nrd/(nc+1e-4*mc)),6) AS d_parent_log, round(nrd/nrs,6) AS d_parent_relative,
 round(nrd/nd,6) AS d_parent_survival, round(high/(nd+1e-4*md),6) AS d_hf, round(1-rho,5) AS d_correlation, round(1-dot/(nrc*nrs),5) AS d_cosine, round(abs(nrs**2/nrc**2-1),6) AS d_energy_ratio FROM nrm JOIN nrc ON nrm.unit = nrc.unit""")
def d_parent_metrics(spark, d):
    fine, coarse = _delta(_sales(spark, d))
    m = scales.parent_metrics(fine, coarse, ["unit"])
    five = ("d_correlation", "d_cosine")
    return m.select("unit", *[F.round(c, 5 if c in five else 6).alias(c) for c in m.columns if c != "unit"])


@query("d_parent_lf_frac", DELTA + " SELECT unit, round(low/(nd+1e-12),6) AS d_parent FROM nrm")
def d_parent_lf_frac(spark, d):
    return scales.lf_fraction(_delta(_sales(spark, d))[0], ["unit"]).select("unit", *_r("d_parent"))


@query("d_histogram_quantile", DELTA + """, a AS (SELECT unit, rc AS v, row_number() OVER (PARTITION BY unit ORDER BY rc) AS k FROM crs), b AS (SELECT unit, rc+rd AS w, row_number() OVER (PARTITION BY unit ORDER BY rc+rd) AS k FROM crs),
 h AS (SELECT a.unit, avg(abs(v-w))/(max(v)-min(v)+1e-12) AS h FROM a JOIN b ON a.unit = b.unit AND a.k = b.k GROUP BY a.unit),
 q AS (SELECT unit, list_max([abs(quantile_cont(rc, 0.0)-quantile_cont(rc+rd, 0.0)), abs(quantile_cont(rc, 0.25)-quantile_cont(rc+rd, 0.25)), abs(quantile_cont(rc, 0.5)-quantile_cont(rc+rd, 0.5)), abs(quantile_cont(rc, 0.75)-quantile_cont(rc+rd, 0.75)), abs(quantile_cont(rc, 1.0)-quantile_cont(rc+rd, 1.0))])/(max(rc)-min(rc)+1e-12) AS q FROM crs GROUP BY unit)
 SELECT h.unit, round(h,5) AS d_histogram, round(q,5) AS d_quantile FROM h JOIN q ON h.unit = q.unit""")
def d_histogram_quantile(spark, d):
    c = _delta(_sales(spark, d))[1].withColumn("rs", F.col("rc") + F.col("rd"))
    h, q = scales.order_distance(c, ["unit"], "rc", "rs"), scales.quantile_gap(c, ["unit"], "rc", "rs", 4)
    return h.join(q, "unit").select("unit", *_r("d_histogram", "d_quantile", n=5))


def _dft(name: str, src: str, v: str) -> str:
    """CTEs of the transform of a 32 x 32 grid ``src`` (r, c): ``name`` with the power by (j, k)."""
    at = "2*pi()/32*(({}*{})%32)"
    kc, jr = at.format("k", "c"), at.format("j", "r")
    f = "sqrt((CASE WHEN {0} < 16 THEN {0} ELSE {0}-32 END/32.0)**2 + (CASE WHEN {1} < 16 THEN {1} ELSE {1}-32 END/32.0)**2)".format("j", "k")
    return (f"{name}1 AS (SELECT r, k, sum({v}*cos({kc})) AS p, sum(-{v}*sin({kc})) AS q FROM {src}, range(32) g(k) GROUP BY ALL), "
            f"{name}2 AS (SELECT j, k, sum(p*cos({jr})+q*sin({jr})) AS re, sum(q*cos({jr})-p*sin({jr})) AS im FROM {name}1, range(32) g(j) GROUP BY ALL), "
            f"{name} AS (SELECT j, k, re, im, re*re+im*im AS p, {f} AS f FROM {name}2)")


LOW = "(SELECT sum(p) FILTER (f < 0.125)/(sum(p)+1e-12) FROM {})"


@query("d_spectral", DELTA + ", " + _dft("ft", "dl", "coarse") + ", " + _dft("fu", "dl", "(coarse+delta)") + f" SELECT 0 AS \"case\", round({LOW.format('ft')},6) AS lf_coarse, round({LOW.format('fu')},6) AS lf_refined, round(abs({LOW.format('fu')}-{LOW.format('ft')}),6) AS d_spectral")
def d_spectral(spark, d):
    fine, _ = _delta(_sales(spark, d))
    return scales.spectral(fine.select(F.lit(0).alias("case"), "r", "c", "coarse", "delta"), ["case"], SIDE).select("case", *_r("lf_coarse", "lf_refined", "d_spectral"))


ENF = DELTA + """, tau AS (SELECT unit, low, high, n, low/(sqrt(low*low+high*high)+1e-12) AS d, 0.3*(1+2/sqrt(n)) AS t FROM nrm),
 stp AS (SELECT *, (0.5*low)/(sqrt(0.25*low*low+high*high)+1e-12) AS d1, (0.25*low)/(sqrt(0.0625*low*low+high*high)+1e-12) AS d2, (0.125*low)/(sqrt(0.015625*low*low+high*high)+1e-12) AS d3 FROM tau),
 act AS (SELECT *, CASE WHEN d <= t THEN 'pass' WHEN d > 2*t THEN 'reject' WHEN d1 <= t OR d2 <= t OR d3 <= t THEN 'damped' ELSE 'reject' END AS action,
  CASE WHEN d <= t OR d > 2*t THEN 0 WHEN d1 <= t THEN 1 WHEN d2 <= t THEN 2 ELSE 3 END AS steps FROM stp)"""


def _enforced(spark, d):
    fine, _ = _delta(_sales(spark, d))
    n = fine.groupBy("unit").agg(scales.norm(F.col("up")).alias("low"), scales.norm(F.col("delta") - F.col("up")).alias("high"), F.count("*").alias("n"))
    return enforce.decide(n, enforce.adaptive_tau(F.lit(0.3), F.col("n"), F.lit(1.0)))


@query("enforce_batch", ENF + " SELECT unit, round(d,6) AS d_parent, action, CAST(steps AS INT) AS steps, round(CASE steps WHEN 0 THEN d WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END,6) AS d_final FROM act")
def enforce_batch(spark, d):
    return _enforced(spark, d).select("unit", *_r("d_parent"), "action", "steps", *_r("d_final"))


@query("waste_prefix", ENF + """, cost AS (SELECT unit, d, CASE WHEN action = 'reject' THEN 1.0 ELSE 0.0 END AS cost FROM act)
 SELECT unit, round(CAST(coalesce(sum(cost) OVER (ORDER BY d DESC, unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE),6) AS spent, coalesce(sum(cost) OVER (ORDER BY d DESC, unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 12 AS open FROM cost""")
def waste_prefix(spark, d):
    x = _enforced(spark, d).withColumn("cost", F.when(F.col("action") == "reject", 1.0).otherwise(0.0))
    return select.prefix_budget(x, "cost", "d_parent", "unit", enforce.waste_limit(60)).select("unit", *_r("spent"), "open")


@query("seam_score", CELL + """, pr AS (SELECT u.unit, CASE WHEN b.r < u.r0 OR b.r >= u.r0+4 OR b.c < u.c0 OR b.c >= u.c0+4 THEN 1 END AS outside0,
  a.r >= u.r0 AND a.r < u.r0+4 AND a.c >= u.c0 AND a.c < u.c0+4 AS core, b.r < u.r0-1 OR b.r >= u.r0+5 OR b.c < u.c0-1 OR b.c >= u.c0+5 AS outside1, abs(a.gt-b.gt) AS j
  FROM (SELECT DISTINCT unit, ti*4 AS r0, tj*4 AS c0 FROM cell) u JOIN cell a ON a.r >= u.r0-1 AND a.r < u.r0+5 AND a.c >= u.c0-1 AND a.c < u.c0+5 JOIN cell b ON abs(a.r-b.r)+abs(a.c-b.c) = 1)
 SELECT unit, round(coalesce(median(j) FILTER (outside1 AND NOT (core AND outside0 IS NOT NULL)),0)/(coalesce(median(j) FILTER (core AND outside0 IS NOT NULL),0)+1e-8),5) AS seam FROM pr WHERE outside1 OR (core AND outside0 IS NOT NULL) GROUP BY unit""")
def seam_score(spark, d):
    c = _sales(spark, d)
    return units.seam(c, refinement.tiles_of(c, TILE), 1, "gt").select("unit", *_r("seam", n=5))


@query("boundary_gradient", CELL + """, g AS (SELECT abs(lead(gt) OVER (PARTITION BY r ORDER BY c) - gt) AS g, c%4 = 3 AS border FROM cell UNION ALL SELECT abs(lead(gt) OVER (PARTITION BY c ORDER BY r) - gt), r%4 = 3 FROM cell)
 SELECT round(avg(g) FILTER (border),6) AS border, round(avg(g) FILTER (NOT border),6) AS inner_, round(avg(g) FILTER (border)/avg(g) FILTER (NOT border),6) AS ratio FROM g WHERE g IS NOT NULL""")
def boundary_gradient(spark, d):
    c = _sales(spark, d)
    row, col = Window.partitionBy("r").orderBy("c"), Window.partitionBy("c").orderBy("r")
    g = c.select(F.abs(F.lead("gt").over(row) - F.col("gt")).alias("g"), (F.col("c") % 4 == 3).alias("b")).unionAll(c.select(F.abs(F.lead("gt").over(col) - F.col("gt")), F.col("r") % 4 == 3))
    m = lambda v: F.avg(F.when(F.col("b") == v, F.col("g")))
    return g.agg(m(True).alias("border"), m(False).alias("inner_"), (m(True) / m(False)).alias("ratio")).select(*_r("border", "inner_", "ratio"))


@query("blend_deltas", CELL + """, dd AS (SELECT r, c, 1.0 AS w, gt-coarse AS d FROM cell WHERE ti%2 = 0 UNION ALL SELECT r, c, 0.25, 0.5*gt FROM cell WHERE tj%2 = 0), s AS (SELECT r, c, sum(w*d)/sum(w) AS d FROM dd GROUP BY ALL)
 SELECT cell.r, cell.c, round(coarse+coalesce(d,0),6) AS v FROM cell LEFT JOIN s ON s.r = cell.r AND s.c = cell.c""")
def blend_deltas(spark, d):
    c = _sales(spark, d)
    a = c.where("ti % 2 = 0").select("r", "c", F.lit(1.0).alias("w"), (F.col("gt") - F.col("coarse")).alias("d"))
    b = c.where("tj % 2 = 0").select("r", "c", F.lit(0.25).alias("w"), (0.5 * F.col("gt")).alias("d"))
    return refine.blended(c.select("r", "c", F.col("coarse").alias("v")), a.unionAll(b), ["r", "c"]).select("r", "c", *_r("v"))


@query("repeat_refine", RHO + ", pick AS (SELECT unit FROM rho ORDER BY rho DESC, unit LIMIT 10) SELECT cell.unit, round(avg((gt-coarse)*(gt-coarse)*CASE WHEN pick.unit IS NULL THEN 1 ELSE 0.7**6 END),8) AS rho FROM cell LEFT JOIN pick ON cell.unit = pick.unit GROUP BY cell.unit")
def repeat_refine(spark, d):
    c = _sales(spark, d)
    best = select.top_k(units.rho(c), "rho", "unit", 10)
    return units.rho(refine.repeated(c, best, 0.3, 3), "state").select("unit", *_r("rho", n=8))


@query("soap_control", RHO + ", pick AS (SELECT unit FROM rho ORDER BY rho DESC, unit LIMIT 10), z AS (SELECT cell.*, 0.9*gt AS s, pick.unit IS NOT NULL AS hit, avg(0.9*gt) OVER (PARTITION BY cell.unit) AS m FROM cell LEFT JOIN pick ON cell.unit = pick.unit) SELECT r, c, round(CASE WHEN hit THEN s+0.5*(m-s) ELSE s END,6) AS state FROM z")
def soap_control(spark, d):
    c = _sales(spark, d)
    best = select.top_k(units.rho(c), "rho", "unit", 10)
    return refine.soaped(c.withColumn("s", 0.9 * F.col("gt")), best, "s").select("r", "c", *_r("state"))


# --- signatures and state ----------------------------------------------------------------------------------------


@query("dirty_signature", "SELECT event_id, CAST(round_even(least(greatest(value/100,0),1)*15,0) AS INT)*256 + CAST(round_even(least(greatest(value/500,0),1)*15,0) AS INT)*16 + CAST(round_even(least(greatest(value/50,0),1)*15,0) AS INT) AS sig FROM events")
def dirty_signature(spark, d):
    q = lambda k: scalar.quantize(F.col("value") / k, 1.0)
    return table(spark, d, "events").select("event_id", scalar.pack(q(100), q(500), q(50)).alias("sig"))


LAGGED = SIG + ", p AS (SELECT node, step, sig, lag(sig) OVER (PARTITION BY node ORDER BY step) AS base FROM sig)"
COMP = "greatest(abs((sig>>8)-(base>>8)), abs(((sig>>4)&15)-((base>>4)&15)), abs((sig&15)-(base&15)))"


@query("signature_hamming", LAGGED + f" SELECT node, CAST(step AS INT) AS step, CAST(bit_count(xor(sig, base) & 4095) AS INT) AS ham, CAST({COMP} AS INT) AS comp FROM p WHERE base IS NOT NULL")
def signature_hamming(spark, d):
    w = Window.partitionBy("node").orderBy("step")
    x = _sigs(spark, d).withColumn("base", F.lag("sig").over(w)).where("base IS NOT NULL")
    return x.select("node", "step", scalar.hamming12(F.col("sig"), F.col("base")).alias("ham"), scalar.component_diff(F.col("sig"), F.col("base")).alias("comp"))


@query("debounce_triggers", SIG + f""", p AS (SELECT node, step, sig, first_value(sig) OVER (PARTITION BY node ORDER BY step) AS base FROM sig), c AS (SELECT node, step, bit_count(xor(sig, base) & 4095) >= 3 OR {COMP} >= 4 AS crossing FROM p),
 g AS (SELECT *, sum(CAST(NOT crossing AS INT)) OVER (PARTITION BY node ORDER BY step) AS g FROM c), r AS (SELECT *, sum(CAST(crossing AS INT)) OVER (PARTITION BY node, g ORDER BY step) AS run FROM g)
 SELECT node, CAST(step AS INT) AS step, crossing, CAST(run AS BIGINT) AS run, run >= 2 AS trigger FROM r""")
def debounce_triggers(spark, d):
    return states.debounce(_sigs(spark, d), "node", "step", "sig")


@query("stability_windows", SIG + f""", o AS (SELECT node, sig, row_number() OVER (PARTITION BY node ORDER BY step) AS k FROM sig), f AS (WITH RECURSIVE z AS (SELECT node, k, sig AS base, 1 AS run FROM o WHERE k = 1 UNION ALL
  SELECT o.node, o.k, CASE WHEN bit_count(xor(o.sig, base) & 4095) <= 2 AND {COMP.replace('sig', 'o.sig')} <= 2 THEN base ELSE o.sig END, CASE WHEN bit_count(xor(o.sig, base) & 4095) <= 2 AND {COMP.replace('sig', 'o.sig')} <= 2 THEN run+1 ELSE 1 END FROM z JOIN o ON o.node = z.node AND o.k = z.k+1) SELECT * FROM z)
 SELECT node, CAST(arg_max(run, k) AS INT) AS run, arg_max(run, k) >= 3 AS stable FROM f GROUP BY node""")
def stability_windows(spark, d):
    return states.stability(_sigs(spark, d), "node", "step", "sig")


@query("ema_governor", SIG + """, o AS (SELECT node, cost, row_number() OVER (PARTITION BY node ORDER BY step) AS k FROM sig), f AS (WITH RECURSIVE z AS (SELECT node, k, cost AS e, 0.8 AS s FROM o WHERE k = 1 UNION ALL
  SELECT o.node, o.k, 0.3*o.cost+0.7*e, CASE WHEN o.k <= 2 THEN s ELSE least(greatest(s + CASE WHEN 0.3*o.cost+0.7*e > 150 THEN 0.05 WHEN 0.3*o.cost+0.7*e < 80 THEN -0.05 ELSE 0 END, 0.5), 0.995) END FROM z JOIN o ON o.node = z.node AND o.k = z.k+1) SELECT * FROM z)
 SELECT node, round(arg_max(e, k),5) AS ema, round(CAST(arg_max(s, k) AS DOUBLE),5) AS strictness FROM f GROUP BY node""".replace("0.8 AS s", "CAST(0.8 AS DOUBLE) AS s"))
def ema_governor(spark, d):
    return states.governor(_sigs(spark, d), "node", "step", "cost", 80.0, 150.0).select("node", *_r("ema", "strictness", n=5))


@query("ema_step", SIG + """, o AS (SELECT node, cost, row_number() OVER (PARTITION BY node ORDER BY step) AS k, count(*) OVER (PARTITION BY node) AS n FROM sig)
 SELECT node, round(sum(cost*CASE WHEN k = 1 THEN 0.7**(n-1) ELSE 0.3*0.7**(n-k) END),5) AS ema FROM o GROUP BY node""")
def ema_step(spark, d):
    return states.ema(_sigs(spark, d), "node", "step", "cost", 0.3).select("node", *_r("ema", n=5))


@query("trajectory_features", SIG + " SELECT node, round(avg(rho),5) AS mean, round(stddev_pop(rho),5) AS sd, round(regr_slope(rho, CAST(step AS DOUBLE)),5) AS slope, count(*) AS steps FROM sig GROUP BY node")
def trajectory_features(spark, d):
    rho = table(spark, d, "events").groupBy(F.col("user_id").alias("node"), F.dayofmonth("ts").alias("step")).agg(F.avg("value").alias("rho"))
    return states.trajectories(rho, "node", "step", "rho").select("node", *_r("mean", "sd", "slope", n=5), "steps")


@query("burstiness", SIG + """, t AS (SELECT DISTINCT step FROM (SELECT step, sum(cost) AS c FROM sig GROUP BY step) WHERE c > (SELECT avg(c) FROM (SELECT sum(cost) AS c FROM sig GROUP BY step)))
 SELECT round(avg(CASE WHEN EXISTS (SELECT 1 FROM t u WHERE abs(u.step-t.step) = 1) THEN 1.0 ELSE 0.0 END),6) AS burstiness FROM t""")
def burstiness(spark, d):
    g = _sigs(spark, d).groupBy("step").agg(F.sum("cost").alias("c"))
    return states.burstiness(g.join(F.broadcast(g.agg(F.avg("c").alias("m")))).where("c > m"), "step").select(*_r("burstiness"))  # one row


@query("dedup_multistage", SIG + """, p AS (SELECT node, step, sig, rho, lag(sig) OVER w AS h, lag(rho) OVER w AS q FROM sig WINDOW w AS (PARTITION BY node ORDER BY step))
 SELECT node, CAST(step AS INT) AS step, CASE WHEN node%7 = 0 THEN 'policy' WHEN h = sig THEN 'exact' WHEN abs(rho-q) <= 2 THEN 'similar' ELSE 'process' END AS stage FROM p""")
def dedup_multistage(spark, d):
    return states.dedup_stages(_sigs(spark, d), "node", "step", "sig", "mean", F.col("node") % 7 == 0, 2.0)


@query("convergence", SIG + """, t AS (SELECT step AS tick, count(*) FILTER (cost > 400) AS accepted FROM sig GROUP BY step)
 SELECT CAST(tick AS INT) AS tick, max(accepted) OVER w = 0 AND count(*) OVER w = 3 AS stop FROM t WINDOW w AS (ORDER BY tick ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def convergence(spark, d):
    t = _sigs(spark, d).groupBy(F.col("step").alias("tick")).agg(F.count_if(F.col("cost") > 400).alias("accepted"))
    return states.converged(t).select("tick", "stop")


@query("cold_start", RHO + " SELECT round(stddev_pop(rho)/avg(rho),6) AS cv, round((0.2+0.5*stddev_pop(rho)/avg(rho))*0.7,6) AS instability, round(greatest(0.05,(0.2+0.5*stddev_pop(rho)/avg(rho))*0.35),6) AS fsr FROM rho")
def cold_start(spark, d):
    return states.cold_start(units.rho(_sales(spark, d)), 0.4).select(*_r("cv", "instability", "fsr"))


@query("strictness_path", """WITH l AS (SELECT user_id AS unit, day(ts) AS step, max(value) > 150 AS bad FROM events GROUP BY ALL), o AS (SELECT unit, bad, row_number() OVER (PARTITION BY unit ORDER BY step) AS k FROM l),
 f AS (WITH RECURSIVE z AS (SELECT unit, k, CAST(greatest(1.0, CASE WHEN bad THEN 1.35 ELSE 0.9 END) AS DOUBLE) AS s FROM o WHERE k = 1 UNION ALL SELECT o.unit, o.k, greatest(1.0, s*CASE WHEN bad THEN 1.5 ELSE 1.0 END*0.9) FROM z JOIN o ON o.unit = z.unit AND o.k = z.k+1) SELECT * FROM z) SELECT unit, round(arg_max(s,k),6) AS strictness FROM f GROUP BY unit""")
def strictness_path(spark, d):
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("unit"), F.dayofmonth("ts").alias("step")).agg(F.when(F.max("value") > 150, "reject").otherwise("pass").alias("action"))
    return enforce.strictness_path(e).select("unit", *_r("strictness"))


# --- decisions ---------------------------------------------------------------------------------------------------


@query("zone_classifier", "SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'GREEN' WHEN c_custkey%100/500 < 0.12 AND c_nationkey/25 <= 0.70 THEN 'YELLOW' ELSE 'RED' END AS zone FROM customer")
def zone_classifier(spark, d):
    return table(spark, d, "customer").select("c_custkey", gates.zone(3, F.col("c_acctbal") - 5000, F.col("c_custkey") % 100 / 500, F.col("c_nationkey") / 25).alias("zone"))


@query("layout_policy", """WITH p AS (SELECT p_partkey, CASE p_partkey%4 WHEN 0 THEN 'scalar_grid' WHEN 1 THEN 'vector_grid' WHEN 2 THEN 'irregular_graph' ELSE 'tree_hierarchy' END AS space, p_size%2 = 0 AS heavy, p_size/50 AS den, p_partkey%3 = 0 AS spatial, p_partkey%10/20 AS cut, p_size%7/7 AS waste FROM part)
 SELECT p_partkey, CASE WHEN space IN ('scalar_grid','vector_grid') THEN 'direct' WHEN space = 'tree_hierarchy' AND heavy AND den < 0.4 THEN 'direct' WHEN space = 'irregular_graph' AND spatial AND cut <= 0.35 AND waste < 0.5 THEN 'blocked' ELSE 'bitset' END AS layout FROM p""")
def layout_policy(spark, d):
    k = F.col("p_partkey")
    space = F.when(k % 4 == 0, "scalar_grid").when(k % 4 == 1, "vector_grid").when(k % 4 == 2, "irregular_graph").otherwise("tree_hierarchy")
    z = gates.layout(space, F.col("p_size") % 2 == 0, F.col("p_size") / 50, k % 3 == 0, k % 10 / 20, F.col("p_size") % 7 / 7)
    return table(spark, d, "part").select("p_partkey", z.alias("layout"))


@query("compression_guard", "SELECT o_orderkey, CASE WHEN o_custkey%40 >= 0.5*(o_orderkey%100) THEN 'bombardment_density' WHEN o_orderkey%17 < 12 THEN 'below_n_critical' ELSE 'viable' END AS guard FROM orders")
def compression_guard(spark, d):
    return table(spark, d, "orders").select("o_orderkey", gates.should_compress(F.col("o_orderkey") % 100, F.col("o_custkey") % 40, F.col("o_orderkey") % 17).alias("guard"))


@query("two_stage_gate", "SELECT c_custkey, round(CASE WHEN c_nationkey/25 <= 0.3 AND c_custkey%10/10 <= 0.5 THEN 1.0 ELSE greatest(0.2, 1-0.3*(2*c_nationkey/25+c_custkey%10/10)) END,6) AS quality FROM customer")
def two_stage_gate(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(gates.two_stage(F.col("c_nationkey") / 25, F.col("c_custkey") % 10 / 10, 0.3, 0.5), 6).alias("quality"))


@query("softmax_gate", """WITH x AS (SELECT c_nationkey AS g, c_mktsegment AS expert, avg(c_acctbal)/10000 AS corr, count(*)/20 AS stab FROM customer GROUP BY ALL), u AS (SELECT *, (0.7*corr+0.3*stab)/0.5 AS u FROM x), e AS (SELECT *, exp(u-max(u) OVER (PARTITION BY g)) AS e FROM u),
 p AS (SELECT *, least(greatest(e/sum(e) OVER (PARTITION BY g),0.2),0.55) AS p FROM e) SELECT g, expert, round(p/sum(p) OVER (PARTITION BY g),6) AS weight FROM p""")
def softmax_gate(spark, d):
    x = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("g"), F.col("c_mktsegment").alias("expert")).agg((F.avg("c_acctbal") / 10000).alias("corr"), (F.count("*") / 20).alias("stab"))
    return states.softmax_gate(x, "g", "corr", "stab").select("g", "expert", *_r("weight"))


@query("journal_summary", ENF + " SELECT action AS decision, count(*) AS n FROM act GROUP BY action")
def journal_summary(spark, d):
    return _enforced(spark, d).groupBy(F.col("action").alias("decision")).agg(F.count("*").alias("n"))


# --- evaluation --------------------------------------------------------------------------------------------------

AUC = "(sum(p*(below+n/2))/(sum(p)*sum(n)))"


def _cnt(by: str) -> str:
    k = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return CASES + f""", g AS (SELECT {k}s, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS n FROM cs GROUP BY ALL),
 cu AS (SELECT *, coalesce(sum(n) OVER ({part}ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS below, sum(p) OVER ({part}ORDER BY s DESC) AS tp, sum(n) OVER ({part}ORDER BY s DESC) AS fp, sum(p) OVER ({part.strip()}) AS ap, sum(n) OVER ({part.strip()}) AS an FROM g)"""


@query("roc_auc", _cnt("level") + f" SELECT level, round({AUC},6) AS auc FROM cu GROUP BY level")
def roc_auc(spark, d):
    return evaluation.roc_auc(_cases(spark, d), "s", "pos", ["level"]).select("level", *_r("auc"))


@query("average_precision", _cnt("level") + " SELECT level, round(sum(p*(tp/(tp+fp)))/sum(p),6) AS ap FROM cu GROUP BY level")
def average_precision(spark, d):
    return evaluation.average_precision(_cases(spark, d), "s", "pos", ["level"]).select("level", *_r("ap"))


@query("youden_threshold", _cnt("level") + """, t AS (SELECT level, s AS threshold, tp/ap AS tpr, fp/an AS fpr, 2*tp/(tp+fp+ap) AS f1 FROM cu), k AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY round(tpr-fpr,12) DESC, threshold DESC) AS k FROM t)
 SELECT level, threshold, round(tpr,6) AS tpr, round(fpr,6) AS fpr, round(f1,6) AS f1, round(tpr-fpr,6) AS youden FROM k WHERE k = 1""")
def youden_threshold(spark, d):
    return evaluation.best_threshold(_cases(spark, d), "s", "pos", ["level"]).select("level", "threshold", *_r("tpr", "fpr", "f1", "youden"))


@query("tpr90_threshold", _cnt("") + " SELECT max(s) AS threshold FROM cu WHERE tp/ap >= 0.9")
def tpr90_threshold(spark, d):
    return evaluation.best_threshold(_cases(spark, d), "s", "pos", None, "tpr90").select("threshold")


@query("cohens_d", CASES + " SELECT level, round(abs(avg(s) FILTER (pos)-avg(s) FILTER (NOT pos))/sqrt(((count(*) FILTER (pos)-1)*var_samp(s) FILTER (pos)+(count(*) FILTER (NOT pos)-1)*var_samp(s) FILTER (NOT pos))/(count(*)-2)),6) AS d FROM cs GROUP BY level")
def cohens_d(spark, d):
    return evaluation.cohens_d(_cases(spark, d), "s", "pos", ["level"]).select("level", *_r("d"))


@query("separability_grouping_sets", CASES + """, x AS (SELECT 'all' AS slice, '' AS value, s, pos FROM cs UNION ALL SELECT 'level', CAST(level AS VARCHAR), s, pos FROM cs UNION ALL SELECT 'structure', structure, s, pos FROM cs),
 g AS (SELECT slice, value, s, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS n FROM x GROUP BY ALL), cu AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY slice, value ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS below FROM g),
 a AS (SELECT slice, value, sum(p*(below+n/2))/(sum(p)*sum(n)) AS auc FROM cu GROUP BY ALL), q AS (SELECT slice, value, median(s) FILTER (NOT pos) > quantile_cont(s,0.75) FILTER (pos) AS qsep FROM x GROUP BY ALL)
 SELECT a.slice, a.value, round(auc,6) AS auc, qsep FROM a JOIN q ON a.slice = q.slice AND a.value = q.value""")
def separability_grouping_sets(spark, d):
    return evaluation.separability(_cases(spark, d), "s", "pos", ["level", "structure"]).select("slice", "value", *_r("auc"), "qsep")


@query("zscore_by_level", CASES + " SELECT id, round((s-avg(s) OVER w)/stddev_pop(s) OVER w,5) AS z FROM cs WINDOW w AS (PARTITION BY level)")
def zscore_by_level(spark, d):
    return scales.zscored(_cases(spark, d), "s", ["level"]).select("id", *_r("z", n=5))


@query("rank_normalize", CASES + " SELECT id, round((row_number() OVER (PARTITION BY level ORDER BY s, id)-1)/greatest(1,count(*) OVER (PARTITION BY level)-1),6) AS rank01 FROM cs")
def rank_normalize(spark, d):
    return scales.rank_normalised(_cases(spark, d), "s", "id", ["level"]).select("id", *_r("rank01"))


PV = "pv AS (SELECT p_brand AS k, exp(-avg(p_size)*count(*)/1500) AS p FROM part GROUP BY p_brand)"


def _pv(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("k")).agg(F.exp(-F.avg("p_size") * F.count("*") / 1500).alias("p"))


@query("holm_bonferroni", PV + """, o AS (SELECT k, p, row_number() OVER (ORDER BY p, k) AS i, count(*) OVER () AS m FROM pv)
 SELECT k, round(max(least(1.0, p*(m-i+1))) OVER w,6) AS adjusted, bool_and(p <= 0.05/(m-i+1)) OVER w AS reject FROM o WINDOW w AS (ORDER BY p, k ROWS UNBOUNDED PRECEDING)""")
def holm_bonferroni(spark, d):
    return evaluation.holm(_pv(spark, d), "p", "k").select("k", *_r("adjusted"), "reject")


@query("holm_without_stop", PV + ", o AS (SELECT k, p, row_number() OVER (ORDER BY p, k) AS i, count(*) OVER () AS m FROM pv) SELECT k, p <= 0.05/(m-i+1) AS reject FROM o")
def holm_without_stop(spark, d):
    return evaluation.holm(_pv(spark, d), "p", "k", stop=False).select("k", "reject")


@query("wilcoxon_signed_rank", """WITH x AS (SELECT l_returnflag AS g, round(l_extendedprice/1000,1) - round(l_quantity*1.5,1) AS dd FROM lineitem), y AS (SELECT *, abs(dd) AS m FROM x WHERE dd <> 0),
 r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY m) + (count(*) OVER (PARTITION BY g, m)-1)/2 AS r FROM y), s AS (SELECT g, count(*) AS n, least(coalesce(sum(r) FILTER (dd > 0),0), coalesce(sum(r) FILTER (dd < 0),0)) AS w FROM r GROUP BY g)
 SELECT g, n, round(CAST(w AS DOUBLE),1) AS w, round((w-n*(n+1)/4)/sqrt(CAST(n AS DOUBLE)*(n+1)*(2*n+1)/24),5) AS z FROM s""")
def wilcoxon_signed_rank(spark, d):
    li = table(spark, d, "lineitem")
    x = li.select(F.col("l_returnflag").alias("g"), F.round(F.col("l_extendedprice") / 1000, 1).alias("a"), F.round(F.col("l_quantity") * 1.5, 1).alias("b"))
    return evaluation.wilcoxon(x, "a", "b", ["g"]).select("g", "n", *_r("w", n=1), *_r("z", n=5))


@query("adjusted_rand", """WITH t AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY ALL), s AS (SELECT sum(n*(n-1)/2) AS s, sum(n) AS m FROM t), sa AS (SELECT sum(n*(n-1)/2) AS sa FROM (SELECT sum(n) AS n FROM t GROUP BY a)), sb AS (SELECT sum(n*(n-1)/2) AS sb FROM (SELECT sum(n) AS n FROM t GROUP BY b))
 SELECT round((s-sa*sb/(m*(m-1)/2))/((sa+sb)/2-sa*sb/(m*(m-1)/2)),8) AS ari FROM s, sa, sb""")
def adjusted_rand(spark, d):
    return evaluation.adjusted_rand(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority").select(*_r("ari", n=8))


@query("mask_iou", "SELECT round(count(*) FILTER (l_quantity > 25 AND l_discount > 0.05)/count(*) FILTER (l_quantity > 25 OR l_discount > 0.05),6) AS iou FROM lineitem")
def mask_iou(spark, d):
    x = table(spark, d, "lineitem").select((F.col("l_quantity") > 25).alias("a"), (F.col("l_discount") > 0.05).alias("b"))
    return evaluation.jaccard_masks(x, "a", "b").select(*_r("iou"))


@query("log_fit", "SELECT l_linenumber, round(regr_slope(l_extendedprice/1000, ln(l_quantity+1)),5) AS slope, round(regr_intercept(l_extendedprice/1000, ln(l_quantity+1)),5) AS intercept, round(regr_r2(l_extendedprice/1000, ln(l_quantity+1)),6) AS r2 FROM lineitem GROUP BY l_linenumber")
def log_fit(spark, d):
    x = table(spark, d, "lineitem").withColumn("y", F.col("l_extendedprice") / 1000)
    return evaluation.linear_fit(x, "y", F.log(F.col("l_quantity") + 1), ["l_linenumber"]).select("l_linenumber", *_r("slope", "intercept", n=5), *_r("r2"))


@query("spearman", RHO + """, x AS (SELECT rho.unit, rho, max(abs(gt-coarse)) AS m FROM rho JOIN cell USING (unit) GROUP BY ALL), r AS (SELECT rank() OVER (ORDER BY rho) + (count(*) OVER (PARTITION BY rho)-1)/2 AS a, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m)-1)/2 AS b FROM x) SELECT round(corr(a,b),6) AS spearman FROM r""")
def spearman(spark, d):
    c = _sales(spark, d)
    return evaluation.spearman(units.rho(c).join(units.max_abs(c), "unit"), "rho", "max_abs").select(*_r("spearman"))


WEIGHT = "CASE WHEN u > 0.99940582 THEN 6 WHEN u > 0.99634015 THEN 5 WHEN u > 0.98101184 THEN 4 WHEN u > 0.91969860 THEN 3 WHEN u > 0.73575888 THEN 2 WHEN u > 0.36787944 THEN 1 ELSE 0 END"


def digest_sql(seed: int, *keys: str) -> str:
    """SQL of ``deltas.digest_uniform``."""
    return f"((CAST('0x' || substr(md5(concat_ws(',', {', '.join([repr(str(seed)), *keys])})), 1, 12) AS BIGINT) + 0.5)/281474976710656)"


@query("bootstrap_auc", CASES + ", u AS (SELECT pos, s, CAST(rd AS INT) AS round, " + digest_sql(0, "id", "rd") + " AS u FROM cs, range(1,21) g(rd)), c AS (SELECT round, s, sum(CASE WHEN pos THEN w ELSE 0 END) AS p, sum(CASE WHEN pos THEN 0 ELSE w END) AS n FROM (SELECT *, " + WEIGHT
       + " AS w FROM u) GROUP BY ALL) SELECT round, round(sum(p*(below+n/2))/(sum(p)*sum(n)),6) AS auc FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY round ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS below FROM c) GROUP BY round")
def bootstrap_auc(spark, d):
    return evaluation.bootstrap_auc(_cases(spark, d), "s", "pos", "id", 20).select("round", *_r("auc"))


@query("multi_tick")
def multi_tick(spark, d):
    r = refinement.MultiTick().run(_sales(spark, d), SIDE, TILE)
    return r.cells.select("r", "c", *_r("state"))


@query("tick_journal")
def tick_journal(spark, d):
    r = refinement.MultiTick().run(_sales(spark, d), SIDE, TILE)
    return refinement.journal(r.log)
