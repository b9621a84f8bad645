"""Queries on graphs, trees and layouts."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from ..operators import communities, evaluation, graphs, layouts, refine, select, trees, units
from ..sources import fields, spaces
from ..sources.tables import table
from . import refinement
from .catalog import CELL, KNN, RHO, SIDE, TILE, TREE, UND, VERT, _r, _sales, _und, query


@query("knn_join", KNN + " SELECT src, dst, round(dist,8) AS dist FROM knn")
def knn_join(spark, d):
    return spaces.knn_edges(spaces.vertices(spark, d), 6).select("src", "dst", *_r("dist", n=8))


@query("radius_join", VERT + " SELECT a.id AS a, b.id AS b, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)),8) AS dist FROM vert a JOIN vert b ON a.id < b.id WHERE sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) <= 0.05")
def radius_join(spark, d):
    return spaces.radius_pairs(spaces.vertices(spark, d), 0.05).select("a", "b", *_r("dist", n=8))


@query("graph_halo", KNN + """, m AS (SELECT community AS unit, id FROM vert), h1 AS (SELECT DISTINCT m.unit, dst AS id FROM m JOIN knn ON m.id = knn.src), n1 AS (SELECT * FROM h1 EXCEPT SELECT * FROM m), h2 AS (SELECT DISTINCT unit, dst AS id FROM n1 JOIN knn ON n1.id = knn.src)
 SELECT unit, id FROM n1 UNION SELECT unit, id FROM (SELECT * FROM h2 EXCEPT SELECT * FROM m)""")
def graph_halo(spark, d):
    v = spaces.vertices(spark, d)
    return refine.halo_of(v.select(F.col("community").alias("unit"), "id"), spaces.knn_edges(v, 6), 2)


@query("refine_graph", KNN + """, m AS (SELECT community AS unit, id FROM vert), h AS (SELECT DISTINCT m.unit, dst AS id FROM m JOIN knn ON m.id = knn.src EXCEPT SELECT * FROM m), u AS (SELECT community AS unit, avg((gt-coarse)*(gt-coarse)) AS rho FROM vert GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3),
 k AS (SELECT id, 1.0 AS m FROM m WHERE unit IN (SELECT unit FROM u) UNION ALL SELECT id, 0.3 FROM h WHERE unit IN (SELECT unit FROM u)), f AS (SELECT id, product(1-m) AS f FROM k GROUP BY id) SELECT vert.id, round(gt-(gt-coarse)*coalesce(f,1),8) AS state FROM vert LEFT JOIN f ON f.id = vert.id""")
def refine_graph(spark, d):
    v = spaces.vertices(spark, d)
    best = select.top_k(units.rho(v, unit="community"), "rho", "community", 3).select(F.col("community").alias("unit"))
    m = v.select(F.col("community").alias("unit"), "id").join(best, "unit", "left_semi")
    masks = refine.set_masks(m, refine.halo_of(m, spaces.knn_edges(v, 6), 1))
    return refine.refined(v, masks, ["id"]).select("id", *_r("state", n=8))


@query("neighbor_mean", KNN + " SELECT src AS id, round(avg(gt),8) AS mean FROM knn JOIN vert ON dst = vert.id WHERE community%2 = 0 GROUP BY src")
def neighbor_mean(spark, d):
    v = spaces.vertices(spark, d)
    return graphs.neighbour_mean(spaces.knn_edges(v, 6), v.select("id", F.col("gt").alias("v")), v.where("community % 2 = 0")).select("id", *_r("mean", n=8))


@query("cross_block_ratio", UND + " SELECT round(avg(CAST(a.community <> b.community AS DOUBLE)),8) AS cut FROM und JOIN vert a ON a.id = src JOIN vert b ON b.id = dst")
def cross_block_ratio(spark, d):
    v, e = _und(spark, d)
    return graphs.cut_ratio(e, v.select("id", F.col("community").alias("block"))).select(*_r("cut", n=8))


@query("padding_waste", "SELECT round(1-count(*)/(count(DISTINCT l_orderkey//64)*64),8) AS waste FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def padding_waste(spark, d):
    a = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("id")).distinct()
    return graphs.padding_waste(a.select("id", F.floor(F.col("id") / 64).alias("block"), F.lit(True).alias("active")), 64).select(*_r("waste", n=8))


@query("degree_entropy", UND + ", p AS (SELECT count(*)/(SELECT count(*) FROM vert) AS p FROM deg GROUP BY degree) SELECT round(sum(-p*ln(p)),8) AS entropy FROM p")
def degree_entropy(spark, d):
    v, e = _und(spark, d)
    return graphs.degree_entropy(v, e).select(*_r("entropy", n=8))


TRI = UND + """, w AS (SELECT DISTINCT least(a.id, b.id) AS p, greatest(a.id, b.id) AS q, c FROM (SELECT src AS c, dst AS id FROM und UNION ALL SELECT dst, src FROM und) a JOIN (SELECT src AS c, dst AS id FROM und UNION ALL SELECT dst, src FROM und) b USING (c) WHERE a.id < b.id),
 tri AS (SELECT src, dst, count(c) AS tri FROM und LEFT JOIN w ON p = src AND q = dst GROUP BY ALL)"""


@query("forman_curvature", TRI + " SELECT src, dst, CAST(4-a.degree-b.degree+3*tri AS DOUBLE) AS curvature FROM tri JOIN deg a ON a.id = src JOIN deg b ON b.id = dst")
def forman_curvature(spark, d):
    return graphs.forman(_und(spark, d)[1])


@query("clustering_coeff", TRI + ", t AS (SELECT id, sum(tri)/2 AS t FROM (SELECT src AS id, tri FROM tri UNION ALL SELECT dst, tri FROM tri) GROUP BY id) SELECT deg.id, round(CASE WHEN degree < 2 THEN 0 ELSE 2*t/(degree*(degree-1)) END,8) AS clustering FROM deg JOIN t ON t.id = deg.id")
def clustering_coeff(spark, d):
    return graphs.clustering(_und(spark, d)[1]).select("id", *_r("clustering", n=8))


PR = UND + ", adj AS (SELECT src, dst FROM und UNION ALL SELECT dst, src FROM und), r0 AS (SELECT id, degree, 1.0/(SELECT count(*) FROM deg) AS rank FROM deg)" + "".join(
    f", r{k} AS (SELECT deg.id, degree, 0.15/(SELECT count(*) FROM deg)+0.85*coalesce(s,0) AS rank FROM deg LEFT JOIN (SELECT dst, sum(rank/degree) AS s FROM adj JOIN r{k - 1} ON src = r{k - 1}.id GROUP BY dst) x ON x.dst = deg.id)" for k in range(1, 4)
)


@query("pagerank_fixed_iter", PR + " SELECT id, round(rank,9) AS rank FROM r3")
def pagerank_fixed_iter(spark, d):
    return graphs.pagerank(_und(spark, d)[1], 3).select("id", *_r("rank", n=9))


@query("gini", "WITH x AS (SELECT c_acctbal+1000 AS v, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS i, count(*) OVER () AS n FROM customer) SELECT round(2*sum(i*v)/(max(n)*sum(v))-(max(n)+1)/max(n),8) AS gini FROM x")
def gini(spark, d):
    return graphs.gini(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") + 1000).alias("v")), "v").select(*_r("gini", n=8))


@query("modularity", UND + """, e AS (SELECT a.community AS p, b.community AS q FROM und JOIN vert a ON a.id = src JOIN vert b ON b.id = dst), dd AS (SELECT b, count(*) AS d FROM (SELECT p AS b FROM e UNION ALL SELECT q FROM e) GROUP BY b), ll AS (SELECT p AS b, count(*) AS l FROM e WHERE p = q GROUP BY p)
 SELECT round(sum(coalesce(l,0))/(sum(d)/2)-sum(d*d)/(sum(d)*sum(d)),8) AS modularity FROM dd LEFT JOIN ll USING (b)""")
def modularity(spark, d):
    v, e = _und(spark, d)
    return graphs.modularity(e, v.select("id", F.col("community").alias("block"))).select(*_r("modularity", n=8))


@query("cluster_sizes", VERT + ", s AS (SELECT count(*) AS n FROM vert GROUP BY community) SELECT count(*) AS clusters, min(n) AS least, max(n) AS most, round(avg(n),6) AS mean, round(stddev_pop(n),6) AS sd FROM s")
def cluster_sizes(spark, d):
    return graphs.cluster_sizes(spaces.vertices(spark, d).select("id", F.col("community").alias("block"))).select("clusters", "least", "most", *_r("mean", "sd"))


@query("connected_components", UND + """, sp AS (SELECT src, dst FROM und JOIN vert a ON a.id = src JOIN vert b ON b.id = dst WHERE a.community = b.community), ad AS (SELECT src, dst FROM sp UNION ALL SELECT dst, src FROM sp),
 rc AS (WITH RECURSIVE z AS (SELECT id, id AS root FROM vert UNION SELECT ad.dst, z.root FROM z JOIN ad ON ad.src = z.id) SELECT * FROM z) SELECT id, min(root) AS component FROM rc GROUP BY id""")
def connected_components(spark, d):
    v, e = _und(spark, d)
    a, b = (v.select(F.col("id").alias(s), F.col("community").alias(c)) for s, c in (("src", "p"), ("dst", "q")))
    return graphs.components(v.select("id"), e.join(a, "src").join(b, "dst").where("p = q").select("src", "dst"))


@query("topology_boost", UND + """, x AS (SELECT community AS unit, avg((gt-coarse)*(gt-coarse)) AS rho, stddev_pop(x) AS curv, max(degree) AS hub, avg(y) AS bridge FROM vert JOIN deg USING (id) GROUP BY 1)
 SELECT unit, round(rho*(1+0.3*abs(curv)/max(abs(curv)) OVER ()+0.2*hub/max(hub) OVER ()+0.5*abs(bridge)/max(abs(bridge)) OVER ()),8) AS boosted FROM x""")
def topology_boost(spark, d):
    v, e = _und(spark, d)
    x = v.join(graphs.degrees(e), "id").groupBy(F.col("community").alias("unit")).agg(F.avg((F.col("gt") - F.col("coarse")) ** 2).alias("rho"), F.stddev_pop("x").alias("curv"), F.max("degree").alias("hub"), F.avg("y").alias("bridge"))
    return graphs.topology_boost(x).select("unit", *_r("boosted", n=8))


@query("graph_hierarchy", VERT + ", c AS (SELECT community AS block, avg(x) AS x, avg(y) AS y FROM vert GROUP BY 1) SELECT block, CAST((CASE WHEN y >= (SELECT avg(y) FROM vert) THEN 2 ELSE 0 END)+(CASE WHEN x >= (SELECT avg(x) FROM vert) THEN 1 ELSE 0 END) AS INT) AS quadrant FROM c")
def graph_hierarchy(spark, d):
    v = spaces.vertices(spark, d)
    return graphs.hierarchy_of(v.select("id", F.col("community").alias("block")), v.select("id", "x", "y"))


LP = UND + ", adj AS (SELECT src, dst FROM und UNION ALL SELECT dst, src FROM und), l0 AS (SELECT id, id AS block FROM vert)" + "".join(
    f", l{k} AS (SELECT id, block FROM (SELECT id, block, row_number() OVER (PARTITION BY id ORDER BY n DESC, block) AS k FROM (SELECT id, block, count(*) AS n FROM (SELECT src AS id, block FROM adj JOIN l{k - 1} p ON p.id = dst UNION ALL SELECT id, block FROM l{k - 1}) GROUP BY ALL)) WHERE k = 1)" for k in range(1, 6)
)


@query("label_propagation", "WITH RECURSIVE " + LP + """, inn AS (SELECT src, dst FROM adj JOIN l5 a ON a.id = src JOIN l5 b ON b.id = dst WHERE a.block = b.block), rc(id, o) AS (SELECT id, id FROM vert UNION SELECT rc.id, dst FROM rc JOIN inn ON inn.src = rc.o) SELECT id, min(o) AS block FROM rc GROUP BY id""")
def label_propagation(spark, d):
    v, e = _und(spark, d)
    return graphs.label_propagation(v.select("id"), e, 5)


@query("bfs_blocks")
def bfs_blocks(spark, d):
    v, e = _und(spark, d)
    return graphs.bfs_blocks(v.select("id"), e, 0, 32)


@query("ollivier_curvature")
def ollivier_curvature(spark, d):
    return graphs.ollivier(_und(spark, d)[1].checkpoint()).select("src", "dst", *_r("kappa"))


@query("lattice_edges", "SELECT i AS src, i+1 AS dst FROM range(1024) g(i) WHERE i%32 < 31 UNION ALL SELECT i, i+32 FROM range(1024) g(i) WHERE i < 992")
def lattice_edges(spark, d):
    return spaces.lattice_edges(spark, SIDE)


# --- trees -------------------------------------------------------------------------------------------------------


@query("tree_space", TREE + " SELECT id, CAST(coalesce(parent,-1) AS BIGINT) AS parent, CAST(coalesce(unit,-1) AS BIGINT) AS unit, round(coarse,8) AS coarse FROM node")
def tree_space(spark, d):
    none = lambda c: F.coalesce(c, F.lit(-1)).cast("long").alias(c)
    return spaces.tree_nodes(spark, d).select("id", none("parent"), none("unit"), *_r("coarse", n=8))


@query("subtree_sizes", TREE + " SELECT ((id+1) >> k) - 1 AS id, count(*) AS size FROM node, range(0,63) g(k) WHERE k <= depth GROUP BY 1")
def subtree_sizes(spark, d):
    return trees.subtree_sizes(spaces.tree_nodes(spark, d))


@query("parent_child_add", TREE + " SELECT node.id, round(sum(CASE WHEN a.id%3 <> 0 THEN a.gt ELSE 0 END),8) AS total FROM node, range(0,63) g(k), node a WHERE k <= node.depth AND a.id = ((node.id+1) >> k) - 1 GROUP BY node.id")
def parent_child_add(spark, d):
    return trees.parent_added(spaces.tree_nodes(spark, d).withColumn("on", F.col("id") % 3 != 0), "gt", "on").select("id", *_r("total", n=8))


@query("tree_neighbors", TREE + """ SELECT id AS node, CAST(parent AS BIGINT) AS other, 'parent' AS kind FROM node WHERE parent IS NOT NULL UNION ALL SELECT CAST(parent AS BIGINT), id, 'child' FROM node WHERE parent IS NOT NULL
 UNION ALL SELECT a.id, b.id, 'sibling' FROM node a JOIN node b ON a.parent = b.parent AND a.id <> b.id""")
def tree_neighbors(spark, d):
    return trees.tree_neighbours(spaces.tree_nodes(spark, d).select(F.col("id").alias("child"), "parent"))


@query("refine_tree", TREE + """, u AS (SELECT unit, avg((gt-coarse)*(gt-coarse)) AS rho FROM node WHERE unit IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3), core AS (SELECT unit, id FROM node WHERE unit IN (SELECT unit FROM u)), halo AS (SELECT unit, (unit-1)//2 AS id FROM u),
 f AS (SELECT id, product(1-m) AS f FROM (SELECT id, 1.0 AS m FROM core UNION ALL SELECT id, 0.3 FROM halo) GROUP BY id) SELECT node.id, round(gt-(gt-coarse)*coalesce(f,1),8) AS state FROM node LEFT JOIN f ON f.id = node.id""")
def refine_tree(spark, d):
    t = spaces.tree_nodes(spark, d)
    best = select.top_k(units.rho(t), "rho", "unit", 3).select("unit")
    core = t.join(best, "unit", "left_semi").select("unit", "id")
    return refine.refined(t, refine.set_masks(core, best.select("unit", F.floor((F.col("unit") - 1) / 2).cast("long").alias("id"))), ["id"]).select("id", *_r("state", n=8))


@query("lca_distance", """WITH p AS (SELECT l_orderkey AS u, l_partkey AS v FROM lineitem GROUP BY ALL), c AS (SELECT u, v, bin(u+1) AS a, bin(v+1) AS b FROM p)
 SELECT u, v, CAST(length(a)+length(b)-2*list_sum(list_transform(range(1,17), lambda k : CASE WHEN k <= least(length(a),length(b)) AND a[1:k] = b[1:k] THEN 1 ELSE 0 END)) AS INT) AS dist FROM c""")
def lca_distance(spark, d):
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("u"), F.col("l_partkey").alias("v")).distinct()
    return p.select("u", "v", graphs.heap_distance(F.col("u"), F.col("v")).alias("dist"))


@query("degree2_chains", """WITH t AS (SELECT CAST(c*4+i AS BIGINT) AS child, CAST(CASE WHEN i = 3 THEN ((c-1)//2)*4 ELSE c*4+i+1 END AS BIGINT) AS parent FROM range(1,31) g(c), range(4) h(i) UNION ALL SELECT 0, NULL),
 dg AS (SELECT t.child AS node, t.parent, count(k.child) + CAST(any_value(t.parent) IS NOT NULL AS INT) AS degree FROM t LEFT JOIN t k ON k.parent = t.child GROUP BY t.child, t.parent), n AS (SELECT node, parent FROM dg WHERE degree = 2 AND parent IS NOT NULL),
 ch AS (WITH RECURSIVE z AS (SELECT node, node AS head, 0 AS pos FROM n WHERE parent NOT IN (SELECT node FROM n) UNION ALL SELECT n.node, z.head, pos+1 FROM z JOIN n ON n.parent = z.node) SELECT * FROM z) SELECT node, head, CAST(pos AS BIGINT) AS pos FROM ch""")
def degree2_chains(spark, d):
    return trees.degree2_chains(fields.chained_tree(spark, 5, 3))


@query("chain_segments", """WITH RECURSIVE t AS (SELECT CAST(c*13+i AS BIGINT) AS child, CAST(CASE WHEN i = 12 THEN ((c-1)//2)*13 ELSE c*13+i+1 END AS BIGINT) AS parent FROM range(1,15) g(c), range(13) h(i) UNION ALL SELECT 0, NULL),
 dg AS (SELECT t.child AS node, t.parent, count(k.child) + CAST(any_value(t.parent) IS NOT NULL AS INT) AS degree FROM t LEFT JOIN t k ON k.parent = t.child GROUP BY t.child, t.parent), n AS (SELECT node, parent FROM dg WHERE degree = 2 AND parent IS NOT NULL),
 z AS (SELECT node, node AS head, 0 AS pos FROM n WHERE parent NOT IN (SELECT node FROM n) UNION ALL SELECT n.node, z.head, pos+1 FROM z JOIN n ON n.parent = z.node), r AS (SELECT *, sum(CASE WHEN node%7 = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY head ORDER BY pos) AS run FROM z),
 k AS (SELECT *, row_number() OVER (PARTITION BY head, run ORDER BY pos)-1 AS k FROM r WHERE node%7 <> 3), s AS (SELECT node, head, min(node) OVER w AS segment, CAST(k%8 AS INT) AS place, count(*) OVER w AS n FROM k WINDOW w AS (PARTITION BY head, run, k//8)) SELECT node, head, segment, place FROM s WHERE n >= 2""")
def chain_segments(spark, d):
    c = trees.degree2_chains(fields.chained_tree(spark, 4, 12))
    return trees.segments(c, c.where("node % 7 <> 3").select("node"))


@query("sibling_sweep", TREE + """, g AS (SELECT parent, CAST(floor(gt*2) AS INT) AS v, count(*) AS n FROM node WHERE parent IS NOT NULL GROUP BY ALL) SELECT count(*) FILTER (n > 1) AS groups, CAST(coalesce(sum(n-1) FILTER (n > 1),0) AS BIGINT) AS merges, coalesce(sum(n-1) FILTER (n > 1),0) > 0.05*(SELECT count(*) FROM node) AS triggered FROM g""")
def sibling_sweep(spark, d):
    return trees.sibling_merges(spaces.tree_nodes(spark, d).withColumn("v", F.floor(F.col("gt") * 2).cast("int")), "v")


@query("basins_grid", RHO + """, x AS (SELECT unit, ti, tj, CASE WHEN (ti*3+tj*5)%4 < 3 THEN 0.05 ELSE 0.5 END AS ratio FROM rho), g AS (SELECT unit, l, ti//CAST(2**(l+1) AS INT) AS gi, tj//CAST(2**(l+1) AS INT) AS gj, ratio FROM x, range(0,3) h(l)),
 m AS (SELECT l, gi, gj FROM g GROUP BY ALL HAVING median(ratio) < 0.1), b AS (SELECT g.unit, min(g.l) AS l FROM g JOIN m ON g.l = m.l AND g.gi = m.gi AND g.gj = m.gj GROUP BY g.unit)
 SELECT x.unit, CAST(coalesce(b.l,-1) AS INT) AS level FROM x LEFT JOIN b ON b.unit = x.unit""")
def basins_grid(spark, d):
    c = _sales(spark, d)
    x = units.rho(c).join(refinement.tiles_of(c, TILE), "unit").select("unit", "ti", "tj", F.col("rho").alias("rho0"), (F.col("rho") * F.when((F.col("ti") * 3 + F.col("tj") * 5) % 4 < 3, 0.05).otherwise(0.5)).alias("rho1"))
    return trees.basins(x, 3).select("unit", "level")


# --- layouts -----------------------------------------------------------------------------------------------------

TM = CELL + ", tm0 AS (SELECT unit, ti, tj, bool_or(gt > 4.5) AS o FROM cell GROUP BY ALL), tm AS (SELECT unit, ti, tj, CASE WHEN o THEN row_number() OVER (PARTITION BY o ORDER BY unit)-1 ELSE -1 END AS slot FROM tm0)"


def _tiles(spark, d):
    return layouts.tile_map(_sales(spark, d).withColumn("active", F.col("gt") > 4.5))


@query("tile_map_lookup", TM + " SELECT unit, CAST(slot AS INT) AS slot FROM tm")
def tile_map_lookup(spark, d):
    return _tiles(spark, d).select("unit", F.col("slot").cast("int").alias("slot"))


@query("neighbor_table", TM + " SELECT a.unit, CAST(i AS INT) AS di, CAST(j AS INT) AS dj, CAST(coalesce(b.slot,-1) AS INT) AS slot FROM tm a CROSS JOIN range(-1,2) g(i) CROSS JOIN range(-1,2) h(j) LEFT JOIN tm b ON b.ti = a.ti+i AND b.tj = a.tj+j WHERE a.slot >= 0")
def neighbor_table(spark, d):
    return layouts.neighbour_table(_tiles(spark, d)).select("unit", "di", "dj", F.col("slot").cast("int").alias("slot"))


ST = "list_value(0.05,0.1,0.05,0.1,0.4,0.1,0.05,0.1,0.05)"
STENCIL = [[0.05, 0.1, 0.05], [0.1, 0.4, 0.1], [0.05, 0.1, 0.05]]


@query("stencil3x3", CELL + f" SELECT a.r, a.c, round(sum(b.gt*({ST})[(b.r-a.r+1)*3+(b.c-a.c+1)+1]),6) AS v FROM cell a JOIN cell b ON abs(a.r-b.r) <= 1 AND abs(a.c-b.c) <= 1 GROUP BY a.r, a.c")
def stencil3x3(spark, d):
    return layouts.stencil(_sales(spark, d), STENCIL).select("r", "c", *_r("v"))


@query("stencil_packed", CELL + f" SELECT a.r, a.c, round(sum(b.gt*({ST})[(b.r-a.r+1)*3+(b.c-a.c+1)+1]),6) AS v FROM cell a JOIN cell b ON a.unit = b.unit AND abs(a.r-b.r) <= 1 AND abs(a.c-b.c) <= 1 WHERE a.unit%3 = 0 GROUP BY a.r, a.c")
def stencil_packed(spark, d):
    return layouts.stencil(_sales(spark, d).withColumn("on", F.col("unit") % 3 == 0), STENCIL, within="unit", active="on").select("r", "c", *_r("v"))


@query("bitset_pack", "SELECT l_orderkey//32 AS word, CAST(bit_or(CAST(1 AS BIGINT) << CAST(l_orderkey%32 AS INT)) AS BIGINT) AS bits, CAST(bit_count(bit_or(CAST(1 AS BIGINT) << CAST(l_orderkey%32 AS INT))) AS INT) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 1")
def bitset_pack(spark, d):
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("i"), (F.col("l_quantity") > 45).alias("on"))
    return layouts.packed_bits(m, "i", "on")


@query("morton_blocks", CELL + """, m AS (SELECT r*32+c AS id, list_sum(list_transform(range(16), lambda i : ((CAST(c AS BIGINT) >> i) & 1) << (2*i))) + 2*list_sum(list_transform(range(16), lambda i : ((CAST(r AS BIGINT) >> i) & 1) << (2*i))) AS z FROM cell) SELECT CAST(id AS INT) AS id, CAST((row_number() OVER (ORDER BY z)-1)//64 AS BIGINT) AS block FROM m""")
def morton_blocks(spark, d):
    c = spaces.with_morton(_sales(spark, d), "r", "c").select((F.col("r") * 32 + F.col("c")).alias("id"), "morton")
    return layouts.morton_blocks(c, "morton", 64).select("id", "block")


_CENTRE = (lambda g: (g.randrange(64), g.randrange(64)))(random.Random(3))


@query("active_mask", f"SELECT CAST(i//64 AS INT) AS r, CAST(i%64 AS INT) AS c, row_number() OVER (ORDER BY (i//64-{_CENTRE[0]})**2 + (i%64-{_CENTRE[1]})**2, i//64, i%64) <= 819 AS active FROM range(4096) g(i)")
def active_mask(spark, d):
    return fields.active_mask(spark, 64, 0.2, "clustered", 3)


@query("hash_keys", "SELECT l_orderkey, l_linenumber, (((l_orderkey*2654435769) & 4294967295) >> 20) AS h FROM lineitem")
def hash_keys(spark, d):
    from ..functions.scalar import hash_keys as h

    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", h(F.col("l_orderkey"), 20).alias("h"))


MERGED = """tm AS (SELECT CAST(sum(degree) AS HUGEINT) AS m2 FROM deg), mg AS (WITH RECURSIVE z AS (SELECT id, id AS block, 0 AS it FROM vert UNION ALL (
  WITH vol AS (SELECT block, CAST(sum(degree) AS HUGEINT) AS v FROM z JOIN deg USING (id) GROUP BY block),
  be AS (SELECT least(a.block,b.block) AS p, greatest(a.block,b.block) AS q, CAST(count(*) AS HUGEINT) AS w FROM und JOIN z a ON a.id = src JOIN z b ON b.id = dst WHERE a.block <> b.block GROUP BY ALL),
  gn AS (SELECT p, q, m2*w - x.v*y.v AS gain FROM be JOIN vol x ON x.block = p JOIN vol y ON y.block = q, tm WHERE m2*w - x.v*y.v > 0),
  bs AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY gain DESC, p, q) AS k FROM (SELECT p AS block, * FROM gn UNION ALL SELECT q AS block, * FROM gn)),
  mt AS (SELECT p, q FROM bs WHERE k = 1 GROUP BY p, q HAVING count(*) = 2)
  SELECT z.id, coalesce(mt.p, z.block) AS block, z.it + 1 AS it FROM z LEFT JOIN mt ON mt.q = z.block WHERE EXISTS (SELECT 1 FROM mt))) SELECT id, block FROM z WHERE it = (SELECT max(it) FROM z))"""
SCORED = "SELECT (SELECT m2 FROM tm) * (SELECT count(*) FROM ew JOIN {0} a ON a.id = ew.id JOIN {0} b ON b.id = ew.dst WHERE a.block = b.block) - (SELECT sum(v*v) FROM (SELECT CAST(sum(degree) AS HUGEINT) AS v FROM {0} JOIN deg USING (id) GROUP BY block)) AS score"
MOVED = """ew AS (SELECT src AS id, dst FROM und UNION ALL SELECT dst, src FROM und), mv AS (WITH RECURSIVE z AS (SELECT id, block, 0 AS it FROM mg UNION ALL (
  WITH vol AS (SELECT block, CAST(sum(degree) AS HUGEINT) AS v FROM z JOIN deg USING (id) GROUP BY block),
  lk AS (SELECT ew.id, b.block AS too, CAST(count(*) AS HUGEINT) AS l FROM ew JOIN z b ON b.id = ew.dst GROUP BY ALL),
  gn AS (SELECT lk.id, lk.too, m2*(lk.l - coalesce(o.l, 0)) - d.degree*(vb.v - va.v + d.degree) AS gain FROM lk JOIN z ON z.id = lk.id AND z.block <> lk.too JOIN deg d ON d.id = lk.id LEFT JOIN lk o ON o.id = lk.id AND o.too = z.block JOIN vol va ON va.block = z.block JOIN vol vb ON vb.block = lk.too, tm),
  wt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY gain DESC, too) AS k FROM gn WHERE gain > 0) WHERE k = 1),
  bt AS (SELECT DISTINCT a.id FROM ew JOIN wt a ON a.id = ew.id JOIN wt b ON b.id = ew.dst WHERE b.gain > a.gain OR (b.gain = a.gain AND b.id < a.id)),
  nw AS (SELECT z.id, CASE WHEN bt.id IS NULL THEN coalesce(wt.too, z.block) ELSE z.block END AS block, z.it + 1 AS it FROM z LEFT JOIN wt ON wt.id = z.id LEFT JOIN bt ON bt.id = z.id)
  SELECT * FROM nw WHERE (""" + SCORED.format("nw") + ") > (" + SCORED.format("z") + """))) SELECT id, block FROM z WHERE it = (SELECT max(it) FROM z)),
 rc AS (WITH RECURSIVE z AS (SELECT id, id AS root FROM mv UNION SELECT ew.dst, z.root FROM z JOIN ew ON ew.id = z.id JOIN mv a ON a.id = ew.id JOIN mv b ON b.id = ew.dst WHERE a.block = b.block) SELECT id, min(root) AS block FROM z GROUP BY id)"""


@query("modularity_blocks", UND + ", " + MERGED + ", " + MOVED + " SELECT id, block FROM rc")
def modularity_blocks(spark, d):
    v, e = _und(spark, d)
    return communities.modularity_blocks(v.select("id"), e)


@query("cluster_scores", """t AS (SELECT c_mktsegment AS k, c_acctbal/1000 AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer), m AS (SELECT k, count(*) AS n, avg(x) AS mx, avg(y) AS my FROM t GROUP BY k),
 s AS (SELECT m.k, any_value(n) AS n, any_value(mx) AS mx, any_value(my) AS my, sum((x-mx)*(x-mx)+(y-my)*(y-my)) AS w, avg(sqrt((x-mx)*(x-mx)+(y-my)*(y-my))) AS s FROM t JOIN m ON m.k = t.k GROUP BY m.k),
 a AS (SELECT avg(x) AS ax, avg(y) AS ay FROM t), o AS (SELECT CAST(sum(n) AS BIGINT) AS n, count(*) AS clusters, sum(w) AS w, sum(n*((mx-ax)*(mx-ax)+(my-ay)*(my-ay))) AS b FROM s, a),
 r AS (SELECT p.k, max((p.s+q.s)/sqrt((p.mx-q.mx)*(p.mx-q.mx)+(p.my-q.my)*(p.my-q.my))) AS r FROM s p JOIN s q ON p.k <> q.k GROUP BY p.k)
 SELECT n, clusters, round(b*(n-clusters)/(w*(clusters-1)),6) AS calinski_harabasz, round((SELECT avg(r) FROM r),4) AS davies_bouldin FROM o""")
def cluster_scores(spark, d):
    c = table(spark, d, "customer").withColumns({"x": F.col("c_acctbal") / 1000, "y": F.col("c_nationkey").cast("double")})
    return evaluation.cluster_scores(c, ["x", "y"], "c_mktsegment").select("n", "clusters", *_r("calinski_harabasz", n=6), *_r("davies_bouldin", n=4))
