"""The frozen index: structure and presence of units once, many queries after.

L0 scores a unit's structure and gives it a cluster, L1 keeps the units of each cluster
with most presence (a quota), L2 scores the survivors for one query and refines the
best. L0 and L1 are written as a table; a query reads only it and the cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import refine, select, units
from .refinement import tiles_of

QUERIES = {"mse": (units.rho, "rho"), "max_abs": (units.max_abs, "max_abs"), "hf_residual": (units.hf_residual, "hf")}


def grid_structure(cells: DataFrame, tile: int, tiles_side: int) -> DataFrame:
    """L0 of grids: every tile counts the same; clusters are square blocks, two to four on a side."""
    n = min(4, max(2, int(tiles_side**0.5)))
    t = tiles_of(cells, tile)
    block = lambda c: F.least(F.floor(F.col(c) * n / tiles_side), F.lit(n - 1))
    return t.withColumn("l0", F.lit(1.0)).withColumn("cluster", (block("ti") * n + block("tj")).cast("int"))


def tree_structure(nodes: DataFrame, total: int, unit_depth: int) -> DataFrame:
    """L0 of trees: (unit, l0, cluster): share of nodes below, 0.3 more if the parent is above depth 3, over the largest."""
    u = nodes.where("unit IS NOT NULL").groupBy("unit").agg(F.count("*").alias("n"))
    s = F.col("n") / total + F.lit(0.3 if unit_depth - 1 < 3 else 0.0)
    u = u.select("unit", s.alias("_s"))
    top = F.broadcast(u.agg(F.max("_s").alias("_top")))  # one row
    return u.join(top).select("unit", (F.col("_s") / F.col("_top")).alias("l0"), F.lit(unit_depth).alias("cluster"))


def graph_structure(units_: DataFrame) -> DataFrame:
    """L0 of graphs: 0.3 curvature spread, 0.2 hub, 0.5 bridge, each over its largest. Columns unit, spread, hub, boundary."""
    u = units_.select("unit", F.col("spread").alias("_a"), F.col("hub").alias("_b"), F.greatest(-F.col("boundary"), F.lit(0.0)).alias("_c"))
    most = F.broadcast(u.agg(*[F.greatest(F.max(c), F.lit(1e-12)).alias(f"{c}_top") for c in ("_a", "_b", "_c")]))  # one row
    part = lambda c: F.col(c) / F.col(f"{c}_top")
    return u.join(most).select("unit", (0.3 * part("_a") + 0.2 * part("_b") + 0.5 * part("_c")).alias("l0"), F.col("unit").alias("cluster"))


def freeze(cells: DataFrame, l0: DataFrame, ratio: float, least: float = 0.1) -> DataFrame:
    """L0 and L1 in one table: the units with l0 of at least ``least`` and ``active`` by the quota of their cluster."""
    p = l0.where(F.col("l0") >= least).join(units.presence(cells), "unit")
    return select.cascade_quota(p, "cluster", "presence", "unit", ratio)


def ask(cells: DataFrame, frozen: DataFrame, query: str, n_total: int, fraction: float) -> DataFrame:
    """L2: the survivors that a query refines, best first: unit and score."""
    metric, name = QUERIES[query]
    live = frozen.where("active").select("unit", "morton")
    scored = metric(cells.join(live.select("unit"), "unit", "left_semi")).join(live, "unit").withColumnRenamed(name, "score")
    return select.top_k(scored, "score", "morton", select.budget(n_total, fraction)).select("unit", "score")


def answer(cells: DataFrame, frozen: DataFrame, query: str, side: int, n_total: int, fraction: float, halo: int) -> DataFrame:
    best = ask(cells, frozen, query, n_total, fraction)
    t = frozen.select("unit", "r0", "c0", "r1", "c1").join(best.select("unit"), "unit", "left_semi")
    return refine.refined(cells, refine.grid_masks(t, side, halo), ["r", "c"])


def streaming_budgets(frozen: DataFrame, n_total: int, fraction: float) -> DataFrame:
    """Budget of each cluster when clusters are refined one after the other, by mean structure."""
    c = frozen.groupBy("cluster").agg(F.count("*").alias("size"), F.sum(F.col("active").cast("long")).alias("survivors"), F.avg("l0").alias("mean_score"))
    return select.allocation(c, n_total, fraction)
