"""Trees as (child, parent) tables: chains of degree two, segments, basins, neighbour updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def node_degrees(tree: DataFrame) -> DataFrame:
    """(node, parent, kids, degree)."""
    kids = tree.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("kids"))
    n = tree.select(F.col("child").alias("node"), "parent").join(kids, "node", "left").withColumn("kids", F.coalesce("kids", F.lit(0)))
    return n.withColumn("degree", F.col("kids") + F.col("parent").isNotNull().cast("int"))


def degree2_chains(tree: DataFrame) -> DataFrame:
    """(node, head, pos): maximal parent-to-child runs of nodes of degree two with a parent, numbered from the top.

    Pointers to the node above within the run double their length in each round, so a run of n nodes takes log n joins.
    """
    d = node_degrees(tree).where("degree = 2 AND parent IS NOT NULL").select("node", "parent")
    up = d.join(d.select(F.col("node").alias("parent"), F.lit(True).alias("in")), "parent", "left")
    at = up.select("node", F.when(F.col("in"), F.col("parent")).otherwise(F.col("node")).alias("head"), F.when(F.col("in"), 1).otherwise(0).cast("long").alias("pos")).checkpoint()
    while True:
        nxt = at.join(at.select(F.col("node").alias("head"), F.col("head").alias("h2"), F.col("pos").alias("p2")), "head")
        new = nxt.select("node", F.col("h2").alias("head"), (F.col("pos") + F.col("p2")).alias("pos")).checkpoint()
        if new.join(at.select("node", F.col("head").alias("old")), "node").where("head <> old").isEmpty():
            return new
        at = new


def segments(chains: DataFrame, stable: DataFrame, least: int = 2, most: int = 8) -> DataFrame:
    """(node, head, segment, place): stable runs of a chain cut into pieces of ``most``; pieces below ``least`` are dropped. ``stable``: node."""
    x = chains.join(stable.select("node", F.lit(True).alias("ok")), "node", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    w = Window.partitionBy("head").orderBy("pos")
    x = x.withColumn("run", F.sum((~F.col("ok")).cast("int")).over(w)).where("ok")
    k = F.row_number().over(Window.partitionBy("head", "run").orderBy("pos")) - 1
    x = x.withColumn("piece", F.floor(k / most)).withColumn("place", (k % most).cast("int"))
    g = Window.partitionBy("head", "run", "piece")
    x = x.withColumn("n", F.count("*").over(g)).withColumn("segment", F.min("node").over(g)).where(F.col("n") >= least)
    return x.select("node", "head", "segment", "place")


def subtree_sizes(nodes: DataFrame) -> DataFrame:
    """(id, size) of heap nodes: each node counts for all its ancestors. ``nodes``: id, depth."""
    a = nodes.select("depth", "id", F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("k"))
    return a.groupBy(F.expr("CAST(shiftright(id + 1, k) - 1 AS BIGINT)").alias("id")).agg(F.count("*").alias("size"))


def tree_neighbours(tree: DataFrame) -> DataFrame:
    """(node, other, kind): parent, siblings and children of each node."""
    t = tree.where("parent IS NOT NULL")
    up = t.select(F.col("child").alias("node"), F.col("parent").alias("other"), F.lit("parent").alias("kind"))
    down = t.select(F.col("parent").alias("node"), F.col("child").alias("other"), F.lit("child").alias("kind"))
    sib = t.select("parent", F.col("child").alias("node")).join(t.select("parent", F.col("child").alias("other")), "parent").where("node <> other")
    return up.unionAll(down).unionAll(sib.select("node", "other", F.lit("sibling").alias("kind")))


def parent_added(nodes: DataFrame, value: str, active: str | None = None) -> DataFrame:
    """(id, total): values added from the root down; inactive ancestors add nothing. ``nodes``: id, depth, value.

    Both sides are dealt by node: a size estimate does not see that the paths hold a row for each node and ancestor.
    """
    on = F.col(active) if active else F.lit(True)
    path = nodes.select("id", F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("k"))
    path = path.select("id", F.expr("CAST(shiftright(id + 1, k) - 1 AS BIGINT)").alias("up"))
    v = nodes.select(F.col("id").alias("up"), F.when(on, F.col(value)).otherwise(0.0).alias("v"))
    return path.join(v.hint("merge"), "up").groupBy("id").agg(F.sum("v").alias("total"))


def basins(units: DataFrame, levels: int, limit: float = 0.1) -> DataFrame:
    """(unit, level, gi, gj): the finest square group whose median ratio of final to initial rho is below the limit; level -1 without one.

    ``units``: unit, ti, tj, rho0, rho1. A group of level l holds 2**(l+1) tiles on a side.
    """
    x = units.withColumn("ratio", F.col("rho1") / F.greatest(F.col("rho0"), F.lit(1e-12)))
    g = x.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    side = F.pow(F.lit(2), F.col("level") + 1)
    g = g.withColumns({"gi": F.floor(F.col("ti") / side).cast("int"), "gj": F.floor(F.col("tj") / side).cast("int")})
    med = g.groupBy("level", "gi", "gj").agg(F.median("ratio").alias("med")).where(F.col("med") < limit)
    hit = g.join(med, ["level", "gi", "gj"]).groupBy("unit").agg(F.min_by(F.struct("level", "gi", "gj"), "level").alias("b"))
    none = F.struct(F.lit(-1).alias("level"), F.col("ti").alias("gi"), F.col("tj").alias("gj"))
    return x.join(hit, "unit", "left").select("unit", F.coalesce("b", none).alias("b")).select("unit", "b.level", "b.gi", "b.gj")


def sibling_merges(nodes: DataFrame, value: str) -> DataFrame:
    """One row: groups of siblings with equal values, members beyond the first, and whether they are over 5 % of all."""
    g = nodes.where("parent IS NOT NULL").groupBy("parent", value).agg(F.count("*").alias("n"))
    n = nodes.agg(F.count("*").alias("total"))
    s = g.where("n > 1").agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("merges"))
    return s.join(F.broadcast(n)).select("groups", "merges", (F.col("merges") > 0.05 * F.col("total")).alias("triggered"))  # one row each


def basins_tree(units: DataFrame, limit: float = 0.1) -> DataFrame:
    """(unit, basin): the parent of a heap node whose rho fell below the limit's share, else the node's own name. ``units``: unit, rho0, rho1."""
    fixed = F.when(F.col("rho0") > 1e-12, F.col("rho1") / F.col("rho0")).otherwise(0.0) < limit
    up = F.when(F.col("unit") > 0, F.floor((F.col("unit") - 1) / 2)).otherwise(F.col("unit")).cast("string")
    return units.select("unit", F.when(fixed, F.concat(F.lit("basin_"), up)).otherwise(F.concat(F.lit("singleton_"), F.col("unit").cast("string"))).alias("basin"))


def basins_graph(units: DataFrame, community: str, limit: float = 0.1) -> DataFrame:
    """(unit, basin): community and whether the unit converged. ``units``: unit, rho0, rho1."""
    fixed = F.when(F.col("rho0") > 1e-12, F.col("rho1") / F.col("rho0")).otherwise(0.0) < limit
    return units.select("unit", F.concat(F.lit("c"), F.col(community).cast("string"), F.when(fixed, "_converged").otherwise("_active")).alias("basin"))
