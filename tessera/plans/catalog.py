"""Queries over the driver's tables and their SQL, one entry per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import graphs, scales, select, units
from ..sources import spaces
from ..sources.tables import table
from . import frozen, refinement

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

SIDE, TILE = 32, 4

# Building blocks of the SQL.
CELL = """cell AS (SELECT r, c, r//4 AS ti, c//4 AS tj, (r//4)*8 + c//4 AS unit, gt, avg(gt) OVER (PARTITION BY r//4, c//4) AS coarse FROM (
 SELECT CAST(i//32 AS INT) AS r, CAST(i%32 AS INT) AS c, coalesce(x.gt, 0.0) AS gt FROM range(1024) g(i) LEFT JOIN (
 SELECT l_orderkey%32 AS a, l_partkey%32 AS b, avg(l_extendedprice*(1-l_discount))/10000 AS gt FROM lineitem GROUP BY ALL) x ON a = i//32 AND b = i%32))"""
RHO = CELL + ", rho AS (SELECT unit, ti, tj, avg((gt-coarse)*(gt-coarse)) AS rho FROM cell GROUP BY ALL)"
BITS = "list_sum(list_transform(range(31), lambda i : (({0} >> i) & 1) << (2*i)))"
MORTON = f"CAST({BITS.format('CAST(tj AS BIGINT)')} + 2*{BITS.format('CAST(ti AS BIGINT)')} AS BIGINT)"
VERT = """vert AS (SELECT *, avg(gt) OVER (PARTITION BY community) AS coarse FROM (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS gt, label AS community FROM embeddings))"""
KNN = VERT + """, knn AS (SELECT src, dst, dist FROM (SELECT a.id AS src, b.id AS dst, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS dist,
 row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)), b.id) AS k FROM vert a JOIN vert b ON a.id <> b.id) WHERE k <= 6)"""
UND = KNN + ", und AS (SELECT DISTINCT least(src,dst) AS src, greatest(src,dst) AS dst FROM knn), deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM und UNION ALL SELECT dst FROM und) GROUP BY id)"
TREE = """node AS (SELECT *, CASE WHEN depth < 3 THEN gt ELSE avg(gt) OVER (PARTITION BY top) END AS coarse FROM (
 SELECT id, depth, gt, CASE WHEN id > 0 THEN (id-1)//2 END AS parent, CASE WHEN depth >= 3 THEN ((id+1) >> (depth-3)) - 1 END AS unit, CASE WHEN depth >= 2 THEN ((id+1) >> (depth-2)) - 1 END AS top
 FROM (SELECT o_orderkey AS id, o_totalprice/100000 AS gt, CAST(length(bin(o_orderkey+1)) - 1 AS INT) AS depth FROM orders)))"""
SIG = """sig AS (SELECT user_id AS node, day(ts) AS step, CAST(least(15, floor(avg(value)/20)) AS INT)*256 + CAST(least(15, count(*)) AS INT)*16 + CAST(least(15, floor(coalesce(stddev_pop(value),0)/15)) AS INT) AS sig, sum(value) AS cost, avg(value) AS rho FROM events GROUP BY ALL)"""
DIRTY = "(bit_count((sig # base) & 4095) >= 3 OR greatest(abs((sig>>8)-(base>>8)), abs(((sig>>4)&15)-((base>>4)&15)), abs((sig&15)-(base&15))) >= 4)".replace(" # ", "^^")
CASES = """cs AS (SELECT l_returnflag AS structure, CAST(l_linenumber AS INT) AS level, l_shipdate >= TIMESTAMP '1995-06-17' AS pos, round(l_extendedprice*l_discount/1000, 2) + CASE WHEN l_shipdate >= TIMESTAMP '1995-06-17' THEN l_quantity/25 ELSE 0 END AS s, l_orderkey*8+l_linenumber AS id FROM lineitem)"""


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql if sql.lstrip().upper().startswith(("WITH", "SELECT")) else "WITH " + sql
        return f

    return put


def _r(*cols: str, n: int = 6):
    return [F.round(F.col(c), n).alias(c) for c in cols]


def _sales(spark, d):
    return spaces.sales_grid(spark, d, SIDE, TILE)


def _und(spark, d):
    v = spaces.vertices(spark, d)
    return v, graphs.undirected(spaces.knn_edges(v, 6)).checkpoint()  # the neighbour join is made once


def _sigs(spark, d):
    """Signature, cost, rho and mean (rho from a decimal sum) of each user's days. The signature's sums are decimals too, so neither the order nor copies of rows move it across a bin's border."""
    ev = table(spark, d, "events").select(F.col("user_id").alias("node"), F.dayofmonth("ts").alias("step"), "value")
    nib = lambda c: F.least(F.lit(15), F.floor(c)).cast("int")
    total = lambda c: F.sum(c.cast("decimal(38,18)"))
    mean = F.try_divide(total(F.col("value")), F.count("value")).cast("double")
    g = ev.groupBy("node", "step").agg(mean.alias("mean"), F.count("*").alias("rows"), F.sum("value").alias("cost"), F.avg("value").alias("rho"))
    kept = ["rows", "cost", "rho", "mean"]
    x = ev.join(g.select(F.col("node").alias("_n"), F.col("step").alias("_s"), *kept), F.col("node").eqNullSafe(F.col("_n")) & F.col("step").eqNullSafe(F.col("_s")))
    off = F.col("value") - F.col("mean")
    v = x.groupBy("node", "step").agg(F.sqrt(F.try_divide(total(off * off), F.count("value")).cast("double")).alias("sd"), *[F.first(c).alias(c) for c in kept])
    sig = scalar.pack(nib(F.col("mean") / 20), F.least(F.lit(15), F.col("rows")).cast("int"), nib(F.coalesce("sd", F.lit(0.0)) / 15))
    return v.select("node", "step", sig.alias("sig"), "cost", "rho", "mean")


def _cases(spark, d):
    li = table(spark, d, "lineitem")
    pos = F.col("l_shipdate") >= F.lit("1995-06-17").cast("timestamp")
    s = F.round(F.col("l_extendedprice") * F.col("l_discount") / 1000, 2) + F.when(pos, F.col("l_quantity") / 25).otherwise(0.0)
    return li.select(F.col("l_returnflag").alias("structure"), F.col("l_linenumber").cast("int").alias("level"), pos.alias("pos"), s.alias("s"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"))


def _delta(cells):
    """Cells with delta (reference minus coarse) and its block-mean part, and the restricted pairs."""
    x = cells.withColumn("delta", F.col("gt") - F.col("coarse") + F.lit(0.1) * F.col("gt"))
    rd = scales.block_restrict(x, "delta")
    fine = scales.block_prolong(x, rd)
    rc = scales.block_restrict(x.withColumn("cc", F.col("coarse") + 0.01 * F.col("r")), "cc").withColumnRenamed("v", "rc")
    coarse = rd.withColumnRenamed("v", "rd").join(rc, ["br", "bc"]).withColumn("unit", F.floor(F.col("br") / 2).cast("int") * 8 + F.floor(F.col("bc") / 2).cast("int"))
    return fine, coarse


DELTA = CELL + """, dl AS (SELECT *, gt-coarse+0.1*gt AS delta FROM cell), dr AS (SELECT r//2 AS bR, c//2 AS bC, avg(delta) AS rd, avg(coarse+0.01*r) AS rc FROM dl GROUP BY ALL),
 fine AS (SELECT dl.*, rd AS up FROM dl JOIN dr ON bR = r//2 AND bC = c//2), crs AS (SELECT (bR//2)*8+bC//2 AS unit, rd, rc FROM dr),
 nrm AS (SELECT unit, sqrt(sum(up*up)) AS low, sqrt(sum((delta-up)*(delta-up))) AS high, sqrt(sum(delta*delta)) AS nd, avg(abs(delta)) AS md, sqrt(sum(coarse*coarse)) AS nc, avg(abs(coarse)) AS mc, count(*) AS n FROM fine GROUP BY unit),
 nrc AS (SELECT unit, sqrt(sum(rd*rd)) AS nrd, sqrt(sum((rc+rd)*(rc+rd))) AS nrs, sqrt(sum(rc*rc)) AS nrc, sum(rc*(rc+rd)) AS dot, corr(rc, rc+rd) AS rho FROM crs GROUP BY unit)"""


# --- spaces, rho, selections -------------------------------------------------------------------------------------

MASKED = RHO + f""", pick AS (SELECT unit, ti, tj FROM rho ORDER BY rho DESC, {MORTON} LIMIT 19),
 win AS (SELECT unit, greatest(ti*4-2,0) AS r0, least(ti*4+6,32) AS r1, greatest(tj*4-2,0) AS c0, least(tj*4+6,32) AS c1 FROM pick),
 mask AS (SELECT unit, cell.r, cell.c, list_product([CASE WHEN i < 2 THEN 0.5*(1-cos(pi()*(i+0.5)/2)) ELSE 1.0 END FOR i IN [cell.r-r0, r1-1-cell.r, cell.c-c0, c1-1-cell.c]]) AS m
  FROM (SELECT r, c FROM cell) cell JOIN win ON cell.r >= r0 AND cell.r < r1 AND cell.c >= c0 AND cell.c < c1),
 fin AS (SELECT cell.*, gt - (gt-coarse)*coalesce(f, 1.0) AS state FROM cell LEFT JOIN (SELECT r, c, product(1-m) AS f FROM mask GROUP BY r, c) x ON x.r = cell.r AND x.c = cell.c)"""


@query("grid_topk_refine", MASKED + """ SELECT round(avg((gt-state)*(gt-state)),6) AS mse, round(10*log10((max(gt)-min(gt))*(max(gt)-min(gt))/avg((gt-state)*(gt-state))),4) AS psnr, round(avg((gt-coarse)*(gt-coarse)),6) AS mse_coarse FROM fin""")
def grid_topk_refine(spark, d):
    c = _sales(spark, d)
    out = refinement.topk_refine(c, SIDE, TILE, 0.3, 2)
    m = out.agg(F.avg((F.col("gt") - F.col("state")) ** 2).alias("mse"), (F.max("gt") - F.min("gt")).alias("span"), F.avg((F.col("gt") - F.col("coarse")) ** 2).alias("mse_coarse"))
    return m.select(F.round("mse", 6).alias("mse"), F.round(scalar.psnr(F.col("mse"), F.col("span")), 4).alias("psnr"), F.round("mse_coarse", 6).alias("mse_coarse"))


@query("refined_cells", MASKED + " SELECT r, c, round(state,6) AS state FROM fin")
def refined_cells(spark, d):
    return refinement.topk_refine(_sales(spark, d), SIDE, TILE, 0.3, 2).select("r", "c", *_r("state"))


@query("unit_rho_grid", RHO + " SELECT unit, round(rho,6) AS rho FROM rho")
def unit_rho_grid(spark, d):
    return units.rho(_sales(spark, d)).select("unit", *_r("rho"))


@query("unit_rho_events", """WITH cell AS (SELECT r, c, (r//4)*8 + c//4 AS unit, gt, avg(gt) OVER (PARTITION BY r//4, c//4) AS coarse FROM (SELECT CAST(i//32 AS INT) AS r, CAST(i%32 AS INT) AS c, coalesce(x.gt, 0.0) AS gt FROM range(1024) g(i) LEFT JOIN (SELECT day(ts) AS a, hour(ts) AS b, avg(value)/100 AS gt FROM events GROUP BY ALL) x ON a = i//32 AND b = i%32))
 SELECT unit, round(avg((gt-coarse)*(gt-coarse)),6) AS rho FROM cell GROUP BY unit""")
def unit_rho_events(spark, d):
    return units.rho(spaces.event_grid(spark, d)).select("unit", *_r("rho"))


VEC = "vc AS (SELECT *, avg(gt) OVER (PARTITION BY unit, d) AS coarse FROM (SELECT vec_id//20 AS r, vec_id%20 AS c, ((vec_id//20)//5)*4 + (vec_id%20)//5 AS unit, unnest(range(64)) AS d, CAST(unnest(embedding) AS DOUBLE) AS gt FROM embeddings))"


@query("unit_rho_vector", VEC + " SELECT CAST(unit AS INT) AS unit, round(avg((gt-coarse)*(gt-coarse)),8) AS rho FROM vc GROUP BY unit")
def unit_rho_vector(spark, d):
    return units.rho(spaces.vector_cells(spark, d)).select("unit", *_r("rho", n=8))


@query("unit_rho_graph", VERT + " SELECT community, round(avg((gt-coarse)*(gt-coarse)),8) AS rho FROM vert GROUP BY community")
def unit_rho_graph(spark, d):
    return units.rho(spaces.vertices(spark, d), unit="community").select("community", *_r("rho", n=8))


@query("unit_rho_tree", TREE + " SELECT unit, round(avg((gt-coarse)*(gt-coarse)),6) AS rho FROM node WHERE unit IS NOT NULL GROUP BY unit")
def unit_rho_tree(spark, d):
    return units.rho(spaces.tree_nodes(spark, d)).select("unit", *_r("rho"))


@query("unit_max_abs", CELL + " SELECT unit, round(max(abs(gt-coarse)),6) AS max_abs FROM cell GROUP BY unit")
def unit_max_abs(spark, d):
    return units.max_abs(_sales(spark, d)).select("unit", *_r("max_abs"))


@query("unit_presence", CELL + " SELECT unit, round(var_pop(gt),6) AS presence FROM cell GROUP BY unit")
def unit_presence(spark, d):
    return units.presence(_sales(spark, d)).select("unit", *_r("presence"))


HF = CELL + """, e AS (SELECT unit, r, c, gt-coarse AS e FROM cell), lp AS (SELECT unit, coalesce(lag(e) OVER a + lead(e) OVER a + lag(e) OVER b + lead(e) OVER b - 4*e, 0) AS lap FROM e
 WINDOW a AS (PARTITION BY unit, r ORDER BY c), b AS (PARTITION BY unit, c ORDER BY r)), hf AS (SELECT unit, sum(lap*lap)/count(*) AS hf FROM lp GROUP BY unit)"""


@query("unit_hf_residual", HF + " SELECT unit, round(hf,6) AS hf FROM hf")
def unit_hf_residual(spark, d):
    return units.hf_residual(_sales(spark, d)).select("unit", *_r("hf"))


@query("laplacian_field", CELL + """ SELECT r, c, round(abs(coalesce(lag(gt) OVER a, gt) + coalesce(lead(gt) OVER a, gt) + coalesce(lag(gt) OVER b, gt) + coalesce(lead(gt) OVER b, gt) - 4*gt),6) AS hf FROM cell
 WINDOW a AS (PARTITION BY r ORDER BY c), b AS (PARTITION BY c ORDER BY r)""")
def laplacian_field(spark, d):
    return units.laplacian_abs(_sales(spark, d), "gt").select("r", "c", *_r("hf"))


@query("box_variance", CELL + " SELECT a.r, a.c, round(greatest(avg(b.gt*b.gt)-avg(b.gt)*avg(b.gt),0),6) AS local_var FROM cell a JOIN cell b ON abs(a.r-b.r) <= 1 AND abs(a.c-b.c) <= 1 GROUP BY a.r, a.c")
def box_variance(spark, d):
    return units.box_variance(_sales(spark, d), "gt").select("r", "c", *_r("local_var"))


@query("rank_quantile_normalise", RHO + """, q AS (SELECT quantile_cont(rho,0.1) AS a, median(rho) AS b, quantile_cont(rho,0.9) AS c FROM rho)
 SELECT unit, round((rank() OVER (ORDER BY rho) + (count(*) OVER (PARTITION BY rho) - 1)/2)/count(*) OVER (),6) AS rk, round(least(greatest((rho-b)/(c-a+1e-8),-3),3),5) AS qn FROM rho, q""")
def rank_quantile_normalise(spark, d):
    x = units.average_rank(units.rho(_sales(spark, d)), "rho", "rk")
    return units.quantile_normalised(x, "rho", "qn").select("unit", *_r("rk"), *_r("qn", n=5))


@query("canonical_traversal", RHO + f" SELECT unit, {MORTON} AS morton, CAST(row_number() OVER (ORDER BY rho DESC, {MORTON}) AS INT) AS rank FROM rho")
def canonical_traversal(spark, d):
    c = _sales(spark, d)
    return select.ranked(units.rho(c).join(refinement.tiles_of(c, TILE), "unit"), "rho", "morton").select("unit", "morton", "rank")


@query("morton_key", f"SELECT l_orderkey, l_linenumber, CAST({BITS.format('(l_partkey%65536)')} + 2*{BITS.format('(l_orderkey%65536)')} AS BIGINT) AS morton FROM lineitem")
def morton_key(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scalar.morton(F.col("l_orderkey") % 65536, F.col("l_partkey") % 65536).alias("morton"))


@query("threshold_top_k", RHO + " SELECT unit, round(rho,6) AS rho FROM rho WHERE rho >= (SELECT min(rho) FROM (SELECT rho FROM rho ORDER BY rho DESC LIMIT 12))")
def threshold_top_k(spark, d):
    return select.threshold_top_k(units.rho(_sales(spark, d)), "rho", 12).select("unit", *_r("rho"))


QUOTA = CELL + """, p AS (SELECT unit, ti, tj, least(ti*2//8,1)*2+least(tj*2//8,1) AS cluster, var_pop(gt) AS presence FROM cell GROUP BY ALL),
 fz AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY presence DESC, unit) <= greatest(1, ceil(count(*) OVER (PARTITION BY cluster)*0.3)) AS active FROM p)"""


def _frozen(spark, d):
    c = _sales(spark, d)
    return c, frozen.freeze(c, frozen.grid_structure(c, TILE, SIDE // TILE), 0.3)


@query("cascade_quota", QUOTA + " SELECT unit, CAST(cluster AS INT) AS cluster, active FROM fz")
def cascade_quota(spark, d):
    return _frozen(spark, d)[1].select("unit", "cluster", "active")


@query("frozen_l2_mse", QUOTA + f", s AS (SELECT cell.unit, any_value(cell.ti) AS ti, any_value(cell.tj) AS tj, avg((gt-coarse)*(gt-coarse)) AS score FROM cell JOIN fz USING (unit) WHERE active GROUP BY 1) SELECT unit, round(score,6) AS score FROM s ORDER BY s.score DESC, {MORTON} LIMIT 12")
def frozen_l2_mse(spark, d):
    c, f = _frozen(spark, d)
    return frozen.ask(c, f, "mse", 64, 0.2).select("unit", *_r("score"))


@query("frozen_l2_max_abs", QUOTA + f", s AS (SELECT cell.unit, any_value(cell.ti) AS ti, any_value(cell.tj) AS tj, max(abs(gt-coarse)) AS score FROM cell JOIN fz USING (unit) WHERE active GROUP BY 1) SELECT unit, round(score,6) AS score FROM s ORDER BY s.score DESC, {MORTON} LIMIT 12")
def frozen_l2_max_abs(spark, d):
    c, f = _frozen(spark, d)
    return frozen.ask(c, f, "max_abs", 64, 0.2).select("unit", *_r("score"))


@query("frozen_l2_hf", QUOTA.replace("WITH ", "") + HF[len(CELL):] + ", s AS (SELECT unit, ti, tj, hf AS score FROM hf JOIN fz USING (unit) WHERE active)" + f" SELECT unit, round(score,6) AS score FROM s ORDER BY s.score DESC, {MORTON} LIMIT 12")
def frozen_l2_hf(spark, d):
    c, f = _frozen(spark, d)
    return frozen.ask(c, f, "hf_residual", 64, 0.2).select("unit", *_r("score"))


@query("streaming_allocation", QUOTA + """, cl AS (SELECT cluster, count(*) AS size, sum(CAST(active AS INT)) AS survivors FROM fz GROUP BY cluster),
 w AS (SELECT *, least(greatest(1, CAST(floor(0.5*64*size/sum(size) OVER ()) AS BIGINT)), survivors) AS want FROM cl)
 SELECT CAST(cluster AS INT) AS cluster, CAST(least(want, greatest(32 - coalesce(sum(want) OVER (ORDER BY cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)) AS BIGINT) AS given FROM w""")
def streaming_allocation(spark, d):
    return frozen.streaming_budgets(_frozen(spark, d)[1], 64, 0.5).select("cluster", F.col("given").cast("long").alias("given"))


@query("quadtree_order", RHO + """, q AS (SELECT *, (ti//4)*2 + tj//4 AS quadrant FROM rho), t AS (SELECT *, sum(rho) OVER (PARTITION BY quadrant) AS total FROM q)
 SELECT unit, CAST(quadrant AS INT) AS quadrant, CAST(row_number() OVER (ORDER BY total DESC, quadrant, rho DESC, unit) AS INT) AS rank FROM t""")
def quadtree_order(spark, d):
    c = _sales(spark, d)
    return select.quadtree_order(units.rho(c).join(refinement.tiles_of(c, TILE), "unit"), 4).select("unit", "quadrant", "rank")


@query("haar_detail_topk", CELL + """, g AS (SELECT unit, r//2 AS a, c//2 AS b, sum(gt) FILTER (r%2=0 AND c%2=0) AS p, sum(gt) FILTER (r%2=0 AND c%2=1) AS q, sum(gt) FILTER (r%2=1 AND c%2=0) AS s, sum(gt) FILTER (r%2=1 AND c%2=1) AS t FROM cell GROUP BY ALL)
 SELECT unit, round(sum(((p-q+s-t)/2)**2 + ((p+q-s-t)/2)**2 + ((p-q-s+t)/2)**2),6) AS energy FROM g GROUP BY unit ORDER BY sum(((p-q+s-t)/2)**2 + ((p+q-s-t)/2)**2 + ((p-q-s+t)/2)**2) DESC, unit LIMIT 10""")
def haar_detail_topk(spark, d):
    return select.top_k(units.haar_energy(_sales(spark, d)), "energy", "unit", 10).select("unit", *_r("energy"))


@query("probe_select", RHO + """, s AS (SELECT unit, sha256('(' || ti || ', ' || tj || ', 0, 42)') AS h FROM rho), v AS (SELECT unit, CAST('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2] AS BIGINT) AS seed FROM s) SELECT unit, seed FROM v ORDER BY seed, unit LIMIT 6""")
def probe_select(spark, d):
    t = refinement.tiles_of(_sales(spark, d), TILE)
    return select.probes(t, "ti", "tj", "unit", 6).select("unit", "seed")


@query("stratified_probe", RHO + """, q AS (SELECT quantile_cont(rho,[0.25,0.5,0.75]) AS q FROM rho), b AS (SELECT unit, rho, CASE WHEN rho <= q[1] THEN 0 WHEN rho <= q[2] THEN 1 WHEN rho <= q[3] THEN 2 ELSE 3 END AS bin FROM rho, q),
 k AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY rho, unit) - 1 AS pos, greatest(1, count(*) OVER (PARTITION BY bin)//3) AS step FROM b) SELECT unit, CAST(bin AS INT) AS bin FROM k WHERE pos % step = 0""")
def stratified_probe(spark, d):
    return select.stratified(units.rho(_sales(spark, d)), "rho", "unit", 3).select("unit", F.col("bin").cast("int").alias("bin"))


@query("region_uri", "SELECT o_orderkey, sha256(concat_ws('|', o_orderstatus, 'split', CAST(o_orderkey%4 AS VARCHAR)))[1:16] AS uri FROM orders")
def region_uri(spark, d):
    return table(spark, d, "orders").select("o_orderkey", scalar.region_uri(F.col("o_orderstatus"), F.lit("split"), F.col("o_orderkey") % 4).alias("uri"))


@query("ucb_policy", "SELECT user_id, round(sum(value)/count(*) + 0.5*sqrt(ln(sum(count(*)) OVER ())/count(*)),6) AS ucb FROM events GROUP BY user_id")
def ucb_policy(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.sum("value").alias("r"), F.count("*").alias("n"))
    return select.ucb(g, "r", "n", 0.5).select("user_id", *_r("ucb"))


@query("fsr_instability", RHO + """, old AS (SELECT unit, max(abs(gt-coarse)) - 0.5 AS o FROM cell GROUP BY unit), f AS (SELECT rho.unit, rho, o FROM rho JOIN old USING (unit) WHERE rho.unit % 5 <> 0)
 SELECT round(avg(CASE WHEN sign(rho) <> sign(o) THEN 1.0 ELSE 0.0 END),6) AS fsr, round(stddev_pop(abs(rho))/avg(abs(rho)),6) AS instability FROM f""")
def fsr_instability(spark, d):
    c = _sales(spark, d)
    now = units.rho(c)
    old = units.max_abs(c).select("unit", (F.col("max_abs") - 0.5).alias("rho"))
    return units.fsr_instability(now, old, now.where("unit % 5 = 0")).select(*_r("fsr", "instability"))
