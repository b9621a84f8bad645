"""Refinement as multiplication of residuals: a set of units with masks m leaves gt - state times the product of 1 - m."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import cosine_ramp


def grid_masks(units: DataFrame, side: int, halo: int) -> DataFrame:
    """(unit, r, c, m) of tiles with their halo, cut at the border: product of half-cosine factors counted from the window's edges.

    ``units``: unit, r0, c0, r1, c1.
    """
    w = units.select("unit", *[F.greatest(F.col(c) - halo, F.lit(0)).alias(c) for c in ("r0", "c0")], *[F.least(F.col(c) + halo, F.lit(side)).alias(c) for c in ("r1", "c1")])
    w = w.withColumn("r", F.explode(F.sequence(F.col("r0"), F.col("r1") - 1))).withColumn("c", F.explode(F.sequence(F.col("c0"), F.col("c1") - 1)))
    m = F.lit(1.0)
    if halo:
        for x, a, b in (("r", "r0", "r1"), ("c", "c0", "c1")):
            for i in (F.col(x) - F.col(a), F.col(b) - 1 - F.col(x)):
                m = m * F.when(i < halo, cosine_ramp(i + 0.5, halo)).otherwise(1.0)
    return w.select("unit", "r", "c", m.alias("m"))


def set_masks(core: DataFrame, halo: DataFrame, weight: float = 0.3) -> DataFrame:
    """(unit, id, m): 1 in the core, ``weight`` in the halo. Both: unit, id."""
    return core.select("unit", "id", F.lit(1.0).alias("m")).unionByName(halo.select("unit", "id", F.lit(weight).alias("m")))


def refined(cells: DataFrame, masks: DataFrame, keys: list[str], state: str = "coarse", out: str = "state") -> DataFrame:
    """``cells`` with ``out`` after all masks; factors are multiplied in a fixed order."""
    left = F.aggregate(F.array_sort(F.collect_list(1 - F.col("m"))), F.lit(1.0), lambda a, x: a * x)
    f = masks.groupBy(*keys).agg(left.alias("_f"))
    joined = cells.join(f, keys, "left")
    return joined.withColumn(out, F.col("gt") - (F.col("gt") - F.col(state)) * F.coalesce("_f", F.lit(1.0))).drop("_f")


def blended(base: DataFrame, deltas: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping deltas as weighted means: ``base`` (keys, v) plus sum(w * d) / sum(w). ``deltas``: keys, w, d."""
    d = deltas.groupBy(*keys).agg((F.sum(F.col("w") * F.col("d")) / F.sum("w")).alias("_d"))
    return base.join(d, keys, "left").withColumn("v", F.col("v") + F.coalesce("_d", F.lit(0.0))).drop("_d")


def repeated(cells: DataFrame, chosen: DataFrame, alpha: float, times: int, state: str = "coarse") -> DataFrame:
    """Residuals of the chosen units shrink by (1 - alpha) a number of times."""
    hit = chosen.select("unit", F.lit(True).alias("_hit"))
    f = F.when(F.col("_hit"), F.lit((1 - alpha) ** times)).otherwise(1.0)
    return cells.join(hit, "unit", "left").withColumn("state", F.col("gt") - (F.col("gt") - F.col(state)) * f).drop("_hit")


def soaped(cells: DataFrame, chosen: DataFrame, state: str = "coarse", strength: float = 0.5) -> DataFrame:
    """Negative control: chosen units move towards their own mean."""
    from pyspark.sql import Window

    hit = chosen.select("unit", F.lit(True).alias("_hit"))
    mean = F.avg(state).over(Window.partitionBy("unit"))
    v = F.when(F.col("_hit"), F.col(state) + strength * (mean - F.col(state))).otherwise(F.col(state))
    return cells.join(hit, "unit", "left").withColumn("state", v).drop("_hit")


def halo_of(members: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(unit, id) reached from each unit's members within some hops along edges (src, dst), members left out."""
    at, out = members.select("unit", "id"), None
    seen = at
    for _ in range(hops):
        nxt = at.join(edges.select(F.col("src").alias("id"), "dst"), "id").select("unit", F.col("dst").alias("id")).distinct()
        at = nxt.join(seen, ["unit", "id"], "left_anti")
        seen = seen.unionByName(at)
        out = at if out is None else out.unionByName(at)
    return out if out is not None else members.limit(0).select("unit", "id")
