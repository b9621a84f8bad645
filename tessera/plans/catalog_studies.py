"""Queries on probes, calibration, sweeps, clustering and iterated graph invariants."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluation, graphs, scales, select, studies, trees, units
from ..sources import fields, spaces
from ..sources.tables import stored, table
from . import refinement
from .catalog import CASES, CELL, RHO, SIDE, SIG, TILE, UND, VERT, _cases, _r, _sales, _sigs, _und, query
from .catalog_scales import LAGGED, _cnt, digest_sql

GAIN = RHO + ", gn AS (SELECT unit, ti, tj, rho, rho*(1+0.5*cos(unit)) AS gain, rho+0.02*sin(unit*7) AS jit FROM rho)"


def _gains(spark, d):
    return units.rho(_sales(spark, d)).select("unit", "rho", (F.col("rho") * (1 + 0.5 * F.cos("unit"))).alias("gain"), (F.col("rho") + 0.02 * F.sin(F.col("unit") * 7)).alias("jit"))


@query("probe_diagnostics", GAIN + ", m AS (SELECT median(gain) AS m FROM gn) SELECT round(max(m),6) AS median, round(avg(CASE WHEN gain < 0.9*m THEN 1.0 ELSE 0.0 END),6) AS fsr FROM gn, m")
def probe_diagnostics(spark, d):
    return studies.probe_health(_gains(spark, d), "gain", 0.9).select(*_r("median", "fsr"))


@query("instability_flips", GAIN + ", a AS (SELECT unit FROM gn ORDER BY rho DESC, unit LIMIT 19), b AS (SELECT unit FROM gn ORDER BY jit DESC, unit LIMIT 19) SELECT round(1-count(b.unit)/count(a.unit),6) AS flips FROM a LEFT JOIN b ON a.unit = b.unit")
def instability_flips(spark, d):
    return studies.membership_flips(_gains(spark, d), "rho", "jit", "unit", 19).select(*_r("flips"))


@query("probe_correlation", GAIN + " SELECT round(corr(jit, gain),6) AS corr FROM gn")
def probe_correlation(spark, d):
    return _gains(spark, d).agg(F.round(F.corr("jit", "gain"), 6).alias("corr"))


@query("miss_rates", GAIN + " SELECT round(avg(CASE WHEN gain < 0.25 THEN 1.0 ELSE 0.0 END) FILTER (jit > 0.3),6) AS fsr, round(count(*) FILTER (gain > 0.35 AND jit <= 0.3)/count(*) FILTER (gain > 0.35),6) AS miss FROM gn")
def miss_rates(spark, d):
    return studies.miss_rates(_gains(spark, d).withColumn("sel", F.col("jit") > 0.3), "gain", "sel", 0.25, 0.35).select(*_r("fsr", "miss"))


@query("delta_calibration", GAIN + " SELECT round(quantile_cont(gain,0.75),6) AS delta_miss, round(0.05*median(gain) FILTER (gain > 0),8) AS delta_false FROM gn")
def delta_calibration(spark, d):
    return studies.deltas(_gains(spark, d), "gain").select(*_r("delta_miss"), *_r("delta_false", n=8))


@query("quantile_calibration", GAIN + """, q AS (SELECT i, q, (SELECT quantile_cont(gain, q) FROM gn) AS cut FROM (VALUES (0,0.5),(1,0.6),(2,0.7),(3,0.8),(4,0.9),(5,0.95)) t(i,q)), c AS (SELECT i, q, count(*) AS n FROM q JOIN gn ON gain >= cut GROUP BY ALL)
 SELECT CAST(q AS DOUBLE) AS q, n FROM c ORDER BY abs(n-10), i LIMIT 1""".replace("(SELECT quantile_cont(gain, q) FROM gn)", "list_extract((SELECT quantile_cont(gain, [0.5,0.6,0.7,0.8,0.9,0.95]) FROM gn), i+1)"))
def quantile_calibration(spark, d):
    return studies.calibrated_quantile(_gains(spark, d), "gain", 10, [0.5, 0.6, 0.7, 0.8, 0.9, 0.95])


@query("ring_seam", CELL + """, b AS (SELECT DISTINCT unit, ti*4 AS r0, tj*4 AS c0 FROM cell), g AS (SELECT b.unit, greatest(r0-r, r-r0-3, c0-c, c-c0-3) AS ring, gt FROM b JOIN cell ON r >= r0-2 AND r < r0+6 AND c >= c0-2 AND c < c0+6),
 m AS (SELECT unit, ring, median(gt) AS median FROM g GROUP BY ALL) SELECT unit, CAST(ring AS INT) AS ring, round(median,6) AS median, round(coalesce(abs(median-lag(median) OVER (PARTITION BY unit ORDER BY ring)),-1),6) AS jump FROM m""")
def ring_seam(spark, d):
    c = _sales(spark, d)
    return studies.ring_jumps(c, refinement.tiles_of(c, TILE).select("unit", "r0", "c0", "r1", "c1"), 2, "gt").select("unit", "ring", *_r("median"), F.round(F.coalesce("jump", F.lit(-1.0)), 6).alias("jump"))


@query("edge_errors", CELL + " SELECT round(avg((gt-coarse)**2) FILTER (r%4 IN (0,3) OR c%4 IN (0,3)),6) AS edge_mse, round(avg((gt-coarse)**2) FILTER (NOT (r%4 IN (0,3) OR c%4 IN (0,3))),6) AS flat_mse, round(avg((gt-coarse)**2),6) AS mse FROM cell")
def edge_errors(spark, d):
    e = (F.col("r") % 4).isin(0, 3) | (F.col("c") % 4).isin(0, 3)
    return studies.split_errors(_sales(spark, d), "coarse", e).select(*_r("edge_mse", "flat_mse", "mse"))


TAU = _cnt("structure, level") + ", yt AS (SELECT structure, level, s AS tau, row_number() OVER (PARTITION BY structure, level ORDER BY round(tp/ap-fp/an,12) DESC, s DESC) AS k FROM cu)"


@query("depth_thresholds", TAU + " SELECT structure, level, tau FROM yt WHERE k = 1")
def depth_thresholds(spark, d):
    return evaluation.best_threshold(_cases(spark, d), "s", "pos", ["structure", "level"]).select("structure", "level", F.col("threshold").alias("tau"))


@query("space_specificity", TAU + ", t AS (SELECT structure, level, tau FROM yt WHERE k = 1) SELECT a.level, a.structure AS a, b.structure AS b, round(greatest(a.tau,b.tau)/least(a.tau,b.tau),6) AS ratio, greatest(a.tau,b.tau)/least(a.tau,b.tau) > 2 AS specific FROM t a JOIN t b ON a.level = b.level AND a.structure < b.structure")
def space_specificity(spark, d):
    t = evaluation.best_threshold(_cases(spark, d), "s", "pos", ["structure", "level"])
    return studies.tau_ratios(t, "structure", "level", "threshold").select("level", "a", "b", *_r("ratio"), "specific")


@query("held_out_thresholds", CASES + """, tr AS (SELECT * FROM cs WHERE id%2 = 0), g AS (SELECT level, s, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS n FROM tr GROUP BY ALL), cu AS (SELECT level, s, sum(p) OVER (PARTITION BY level ORDER BY s DESC) AS tp, sum(n) OVER (PARTITION BY level ORDER BY s DESC) AS fp, sum(p) OVER (PARTITION BY level) AS ap, sum(n) OVER (PARTITION BY level) AS an FROM g),
 b AS (SELECT level, s AS threshold, row_number() OVER (PARTITION BY level ORDER BY round(tp/ap-fp/an,12) DESC, s DESC) AS k FROM cu) SELECT cs.level, threshold, round(avg(CAST((s >= threshold) = pos AS INT)) FILTER (id%2 = 0),6) AS train, round(avg(CAST((s >= threshold) = pos AS INT)) FILTER (id%2 = 1),6) AS valid FROM cs JOIN b ON b.level = cs.level AND k = 1 GROUP BY cs.level, threshold""")
def held_out_thresholds(spark, d):
    return studies.held_out_accuracy(_cases(spark, d), "s", "pos", F.col("id") % 2 == 0, ["level"]).select("level", "threshold", *_r("train", "valid"))


@query("kill_criteria", _cnt("") + """, x AS (SELECT sum(p*(below+n/2))/(sum(p)*sum(n)) AS auc FROM cu), dd AS (SELECT abs(avg(s) FILTER (pos)-avg(s) FILTER (NOT pos))/sqrt(((count(*) FILTER (pos)-1)*var_samp(s) FILTER (pos)+(count(*) FILTER (NOT pos)-1)*var_samp(s) FILTER (NOT pos))/(count(*)-2)) AS d FROM cs)
 SELECT round(auc,6) AS auc, round(d,6) AS d FROM x, dd""")
def kill_criteria(spark, d):
    return studies.kill_criteria(_cases(spark, d), "s", "pos", "level").select(*_r("auc", "d"))


RUNS = "runs AS (SELECT l_orderkey%50 AS pt, l_shipdate < TIMESTAMP '1995-01-01' AS early, l_linenumber AS variant, l_returnflag AS pattern, round(avg(l_extendedprice)/1000,8) AS cost FROM lineitem GROUP BY ALL)"


def _runs(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy((F.col("l_orderkey") % 50).alias("pt"), (F.col("l_shipdate") < F.lit("1995-01-01").cast("timestamp")).alias("early"), F.col("l_linenumber").alias("variant"), F.col("l_returnflag").alias("pattern")).agg(F.round(F.avg("l_extendedprice") / 1000, 8).alias("cost"))


@query("win_rates", RUNS + ", b AS (SELECT variant, row_number() OVER (PARTITION BY pt, pattern, early ORDER BY cost, variant) AS k FROM runs) SELECT variant, count(*) AS wins, round(count(*)/sum(count(*)) OVER (),6) AS rate FROM b WHERE k = 1 GROUP BY variant")
def win_rates(spark, d):
    return studies.win_rates(_runs(spark, d), ["pt", "pattern", "early"], "variant", "cost").select("variant", "wins", *_r("rate"))


@query("break_even", RUNS + ", r AS (SELECT pattern, pt, avg(CASE WHEN cost < 60 THEN 1.0 ELSE 0.0 END) AS rate FROM runs GROUP BY ALL) SELECT pattern, max(pt) AS pt FROM r WHERE rate > 0.5 GROUP BY pattern")
def break_even(spark, d):
    return studies.break_even(_runs(spark, d).withColumn("won", F.col("cost") < 60), "pattern", "pt", "won")


@query("verdicts", RUNS + ", m AS (SELECT variant, median(cost/38-1) AS overhead FROM runs GROUP BY variant) SELECT variant, round(overhead,6) AS overhead, CASE WHEN overhead <= 0 THEN 'PASS' WHEN overhead <= 0.2 THEN 'MARGINAL' ELSE 'FAIL' END AS verdict FROM m")
def verdicts(spark, d):
    return studies.verdicts(_runs(spark, d).withColumn("overhead", F.col("cost") / 38 - 1), "variant", "overhead").select("variant", *_r("overhead"), "verdict")


@query("ridge_width", RUNS + ", g AS (SELECT pt+1 AS x, avg(cost) AS s FROM runs GROUP BY 1), b AS (SELECT max(s) AS best FROM g) SELECT round(max(best),6) AS best, round(avg(CASE WHEN s >= 0.95*best THEN 1.0 ELSE 0.0 END),6) AS share, round(ln(max(x) FILTER (s >= 0.95*best)/min(x) FILTER (s >= 0.95*best)),6) AS width FROM g, b")
def ridge_width(spark, d):
    g = _runs(spark, d).groupBy((F.col("pt") + 1).alias("x")).agg(F.avg("cost").alias("s"))
    return studies.ridge(g, "s", "x").select(*_r("best", "share", "width"))


@query("run_summary", RUNS + " SELECT pattern, variant, count(*) AS n, round(avg(cost),5) AS mean, round(quantile_cont(cost,0.5),5) AS p50, round(quantile_cont(cost,0.9),5) AS p90, round(max(cost),5) AS most FROM runs GROUP BY ALL")
def run_summary(spark, d):
    g = _runs(spark, d).groupBy("pattern", "variant").agg(F.count("*").alias("n"), F.avg("cost").alias("mean"), F.percentile("cost", 0.5).alias("p50"), F.percentile("cost", 0.9).alias("p90"), F.max("cost").alias("most"))
    return g.select("pattern", "variant", "n", *_r("mean", "p50", "p90", "most", n=5))


@query("local_update", RHO + ", m AS (SELECT median(rho) AS m FROM rho) SELECT unit, round(rho,6) AS rho FROM rho, m WHERE unit%5 = 0 OR rho >= m ORDER BY rho.rho DESC, unit LIMIT 12")
def local_update(spark, d):
    r = units.rho(_sales(spark, d))
    m = r.agg(F.median("rho").alias("m"))
    return select.top_k(r.join(F.broadcast(m)).where("unit % 5 = 0 OR rho >= m"), "rho", "unit", 12).select("unit", *_r("rho"))  # one row


@query("equality_report", RHO + " SELECT CAST(count(*) FILTER (unit%8 = 0) AS BIGINT) AS \"only\", count(*) FILTER (unit%8 <> 0 AND unit%3 = 0) AS differ, round(max(CASE WHEN unit%8 <> 0 AND unit%3 = 0 THEN 0.5 ELSE 0 END),6) AS most FROM rho")
def equality_report(spark, d):
    r = stored(units.rho(_sales(spark, d)))  # made twice, its sums might differ in their last digit
    b = r.where("unit % 8 <> 0").withColumn("rho", F.when(F.col("unit") % 3 == 0, F.col("rho") + 0.5).otherwise(F.col("rho")))
    return studies.equality(r, b, ["unit"], "rho").select("only", "differ", *_r("most"))


@query("adaptive_diagnose", RHO + """, x AS (SELECT unit, avg(abs(gt-coarse)) AS resid, avg(abs(coarse)) AS hf FROM cell GROUP BY unit), r AS (SELECT resid, rank() OVER (ORDER BY resid) AS a, rank() OVER (ORDER BY hf) AS b FROM x)
 SELECT round(corr(a,b),6) AS rho, round(stddev_pop(resid)/avg(resid),6) AS cv, corr(a,b) < 0.6 OR stddev_pop(resid)/avg(resid) < 0.75 AS combined FROM r""")
def adaptive_diagnose(spark, d):
    x = _sales(spark, d).groupBy("unit").agg(F.avg(F.abs(F.col("gt") - F.col("coarse"))).alias("resid"), F.avg(F.abs("coarse")).alias("hf"))
    y = units.average_rank(units.average_rank(x, "resid", "a"), "hf", "b").agg(F.corr("a", "b").alias("rho"), (F.stddev_pop("resid") / F.avg("resid")).alias("cv"))
    return y.select(*_r("rho", "cv"), ((F.col("rho") < 0.6) | (F.col("cv") < 0.75)).alias("combined"))


@query("evolution_policy", LAGGED + """, dd AS (SELECT step, avg(CASE WHEN bit_count(xor(sig, base) & 4095) >= 3 THEN 1.0 ELSE 0.0 END) AS dirty FROM p WHERE base IS NOT NULL GROUP BY step) SELECT CAST(step AS INT) AS step, dirty > 0.7 AS rebuild FROM dd""")
def evolution_policy(spark, d):
    from ..functions.scalar import hamming12

    w = Window.partitionBy("node").orderBy("step")
    x = _sigs(spark, d).withColumn("base", F.lag("sig").over(w)).where("base IS NOT NULL")
    s = x.groupBy("step").agg(F.avg((hamming12(F.col("sig"), F.col("base")) >= 3).cast("double")).alias("dirty"))
    return studies.evolve(s, "dirty", "dirty", 0.7)


@query("feature_matmul", VERT + " SELECT id, round(x*1.0+y*0.5,8) AS a, round(x*-1.0+y*2.0,8) AS b FROM vert")
def feature_matmul(spark, d):
    v = spaces.vertices(spark, d).select("id", F.array("x", "y").alias("f"))
    m = studies.matmul(v, "f", [[1.0, -1.0], [0.5, 2.0]])
    return m.select("id", F.round(F.col("f")[0], 8).alias("a"), F.round(F.col("f")[1], 8).alias("b"))


@query("dbscan", VERT + """, pr AS (SELECT a.id AS a, b.id AS b FROM vert a JOIN vert b ON a.id <> b.id AND sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) <= 0.03), core AS (SELECT a AS id FROM pr GROUP BY a HAVING count(*)+1 >= 8),
 rc AS (WITH RECURSIVE z AS (SELECT id, id AS root FROM core UNION SELECT pr.b, z.root FROM z JOIN pr ON pr.a = z.id WHERE pr.b IN (SELECT id FROM core)) SELECT * FROM z), cc AS (SELECT id, min(root) AS cluster FROM rc GROUP BY id), nr AS (SELECT a AS id, min(cluster) AS cluster FROM pr JOIN cc ON cc.id = pr.b GROUP BY a)
 SELECT vert.id, coalesce(cc.cluster, nr.cluster, -1) AS cluster FROM vert LEFT JOIN cc ON cc.id = vert.id LEFT JOIN nr ON nr.id = vert.id""")
def dbscan(spark, d):
    return studies.dbscan(spaces.vertices(spark, d).select("id", "x", "y"), 0.03, 8)


@query("chain_statistics", "SELECT CAST(30 AS BIGINT) AS chains, CAST(3 AS BIGINT) AS longest, CAST(3.0 AS DOUBLE) AS mean")
def chain_statistics(spark, d):
    c = trees.degree2_chains(fields.chained_tree(spark, 5, 3)).groupBy("head").agg(F.count("*").alias("n"))
    return c.agg(F.count("*").alias("chains"), F.max("n").alias("longest"), F.avg("n").alias("mean"))


@query("kmeans_clusters")
def kmeans_clusters(spark, d):
    out, _ = studies.kmeans(spaces.vertices(spark, d).select("id", "x", "y", "gt"), ["x", "y", "gt"], 4)
    return out.select("id", "cluster")


@query("spectral_gap")
def spectral_gap(spark, d):
    v, e = _und(spark, d)
    return studies.spectral_gap(v.select("id"), e)


@query("hybrid_curvature")
def hybrid_curvature(spark, d):
    return studies.hybrid_curvature(_und(spark, d)[1], 20)


GW = """k{0} AS (SELECT i, exp(-0.5*(i/{1})**2) AS k FROM range(-{2},{2}+1) g(i)), w{0} AS (SELECT co, CASE WHEN x < 32 THEN x ELSE 63-x END AS f, sum(k)/(SELECT sum(k) FROM k{0}) AS w FROM (SELECT co, k, ((co*{3}+i)%64+64)%64 AS x FROM range({4}) h(co), k{0}) GROUP BY ALL)"""


@query("idempotence", CELL + ", " + GW.format("g", 1.0, 4, 2, 16) + """, p AS (SELECT CAST(i AS INT) AS i, i*15/31 AS x FROM range(32) g(i)), up AS (SELECT i AS f, CAST(floor(x) AS INT) AS co, 1-(x-floor(x)) AS w FROM p UNION ALL SELECT i, CAST(floor(x) AS INT)+1, x-floor(x) FROM p WHERE x > floor(x) AND floor(x)+1 < 16),
 a1 AS (SELECT co AS r, c, sum(gt*w) AS v FROM cell JOIN wg ON r = f GROUP BY ALL), a AS (SELECT r, co AS c, sum(v*w) AS v FROM a1 JOIN wg ON c = f GROUP BY ALL), b1 AS (SELECT f AS r, c, sum(v*w) AS v FROM a JOIN up ON r = co GROUP BY ALL), b AS (SELECT r, f AS c, sum(v*w) AS v FROM b1 JOIN up ON c = co GROUP BY ALL),
 d1 AS (SELECT co AS r, c, sum(v*w) AS v FROM b JOIN wg ON r = f GROUP BY ALL), d AS (SELECT r, co AS c, sum(v*w) AS v FROM d1 JOIN wg ON c = f GROUP BY ALL) SELECT round(sqrt(sum((a.v-d.v)**2))/sqrt(sum(a.v**2)),6) AS gap FROM a JOIN d ON a.r = d.r AND a.c = d.c""")
def idempotence(spark, d):
    """Norm of R(c) - R(Up(R(c))) over the norm of R(c), Gaussian and bilinear."""
    c = _sales(spark, d)
    down, up = scales.gaussian_weights(spark, SIDE, 1.0), scales.bilinear_weights(spark, SIDE, SIDE // 2)
    one = scales.separable(c, down, "gt", True).checkpoint()
    two = scales.separable(scales.separable(one, up, "v", False), down, "v", True).withColumnRenamed("v", "w")
    return one.join(two, ["r", "c"]).agg((F.sqrt(F.sum((F.col("v") - F.col("w")) ** 2)) / F.sqrt(F.sum(F.col("v") ** 2))).alias("gap")).select(*_r("gap"))


@query("gradient_shift", CELL + """, g AS (SELECT unit, coalesce(lead(gt) OVER a - gt,0) AS a0, coalesce(lead(gt) OVER b - gt,0) AS a1, coalesce(lead(gt*0.9+r*0.01) OVER a - (gt*0.9+r*0.01),0) AS b0, coalesce(lead(gt*0.9+r*0.01) OVER b - (gt*0.9+r*0.01),0) AS b1 FROM cell WINDOW a AS (PARTITION BY unit, r ORDER BY c), b AS (PARTITION BY unit, c ORDER BY r))
 SELECT unit, round(sqrt(sum((a0-b0)**2+(a1-b1)**2))/(sqrt(sum(a0**2+a1**2))+1e-12),6) AS d_gradient FROM g GROUP BY unit""")
def gradient_shift(spark, d):
    c = _sales(spark, d).withColumn("s", F.col("gt") * 0.9 + F.col("r") * 0.01)
    return scales.gradient_shift(c, ["unit"], "gt", "s").select("unit", *_r("d_gradient"))


@query("sign_cancellation", CELL + " SELECT unit, round(abs(avg(gt-coarse+0.1))/(avg(abs(gt-coarse+0.1))+1e-12),6) AS d_sign FROM cell GROUP BY unit")
def sign_cancellation(spark, d):
    c = _sales(spark, d).withColumn("x", F.col("gt") - F.col("coarse") + 0.1)
    return scales.sign_cancellation(c, ["unit"], "x").select("unit", *_r("d_sign"))


@query("ssim", CELL + ", " + GW.format("g", 1.5, 6, 1, 32) + """, a AS (SELECT co AS r, c, sum(gt*w) AS ma, sum(coarse*w) AS mb, sum(gt*gt*w) AS qa, sum(coarse*coarse*w) AS qb, sum(gt*coarse*w) AS ab FROM cell JOIN wg ON r = f GROUP BY ALL),
 b AS (SELECT r, co AS c, sum(ma*w) AS ma, sum(mb*w) AS mb, sum(qa*w) AS qa, sum(qb*w) AS qb, sum(ab*w) AS ab FROM a JOIN wg ON c = f GROUP BY ALL) SELECT round(1-avg((2*ma*mb+0.0025)*(2*(ab-ma*mb)+0.0225)/((ma*ma+mb*mb+0.0025)*(qa-ma*ma+qb-mb*mb+0.0225))),6) AS d_ssim FROM b""")
def ssim(spark, d):
    return scales.ssim(_sales(spark, d), "gt", "coarse", SIDE, span=5.0).select(*_r("d_ssim"))


@query("community_contract", UND + " SELECT DISTINCT least(a.community, b.community) AS src, greatest(a.community, b.community) AS dst FROM und JOIN vert a ON a.id = und.src JOIN vert b ON b.id = und.dst WHERE a.community <> b.community")
def community_contract(spark, d):
    v, e = _und(spark, d)
    return graphs.contracted(e, v.select("id", F.col("community").alias("block")))


@query("community_tree")
def community_tree(spark, d):
    v, e = _und(spark, d)
    return graphs.community_tree(v.select("id"), e)


@query("greedy_blocks")
def greedy_blocks(spark, d):
    v, e = _und(spark, d)
    return graphs.greedy_blocks(e, graphs.components(v.select("id"), e), 32)


@query("projected_seam", """WITH e AS (SELECT CAST(vec_id//20 AS INT) AS r, CAST(vec_id%20 AS INT) AS c, unnest(range(len(embedding))) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), cell AS (SELECT r, c, (r//5)*4 + c//5 AS unit, sum(x*(sqrt(-2*ln(""" + digest_sql(5, "0", "d") + "))*cos(2*pi()*" + digest_sql(7924, "0", "d") + """))) AS gt FROM e GROUP BY ALL),
 u AS (SELECT unit, min(r) AS r0, min(c) AS c0, max(r)+1 AS r1, max(c)+1 AS c1 FROM cell GROUP BY unit), pr AS (SELECT u.unit, a.r >= r0 AND a.r < r1 AND a.c >= c0 AND a.c < c1 AS core, b.r < r0 OR b.r >= r1 OR b.c < c0 OR b.c >= c1 AS out0, b.r < r0-1 OR b.r >= r1+1 OR b.c < c0-1 OR b.c >= c1+1 AS out1, abs(a.gt-b.gt) AS j
 FROM u JOIN cell a ON a.r >= r0-1 AND a.r < r1+1 AND a.c >= c0-1 AND a.c < c1+1 JOIN cell b ON abs(a.r-b.r)+abs(a.c-b.c) = 1)
 SELECT unit, round(coalesce(median(j) FILTER (out1 AND NOT (core AND out0)),0)/(coalesce(median(j) FILTER (core AND out0),0)+1e-8),5) AS seam FROM pr WHERE out1 OR (core AND out0) GROUP BY unit""")
def projected_seam(spark, d):
    p = scales.projected(spaces.vector_cells(spark, d), ["r", "c"], "d", "gt", 1, 5)
    box = spaces.vector_cells(spark, d).groupBy("unit").agg(F.min("r").alias("r0"), F.min("c").alias("c0"), (F.max("r") + 1).alias("r1"), (F.max("c") + 1).alias("c1"))
    return units.seam(p, box, 1, "v").select("unit", *_r("seam", n=5))


@query("tree_activation", "SELECT i AS id, i%8 = 0 AND i < 8*32 AS active FROM range(256) g(i)")
def tree_activation(spark, d):
    from ..sources.generators import tree_activation as activation

    return activation(spark, 256, 32, "frontier")


@query("probe_policies", "SELECT user_id, CAST(31 - max(day(ts)) AS INT) AS age, round(var_pop(value),5) AS uncert FROM events GROUP BY user_id")
def probe_policies(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.max(F.dayofmonth("ts")).alias("last"), F.var_pop("value").alias("v"))
    return studies.policies(g, 31, 1, "last", "v", "user_id").select("user_id", "age", *_r("uncert", n=5))
