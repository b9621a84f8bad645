"""Unit metrics: one row per unit from its cells, by aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _resid(state: str) -> Column:
    return F.col("gt") - F.col(state)


def rho(cells: DataFrame, state: str = "coarse", unit: str = "unit") -> DataFrame:
    """Mean squared residual of each unit."""
    return cells.where(F.col(unit).isNotNull()).groupBy(unit).agg(F.avg(_resid(state) ** 2).alias("rho"))


def max_abs(cells: DataFrame, state: str = "coarse", unit: str = "unit") -> DataFrame:
    return cells.groupBy(unit).agg(F.max(F.abs(_resid(state))).alias("max_abs"))


def presence(cells: DataFrame, unit: str = "unit") -> DataFrame:
    """Population variance of the reference value."""
    return cells.groupBy(unit).agg(F.var_pop("gt").alias("presence"))


def hf_residual(cells: DataFrame, state: str = "coarse") -> DataFrame:
    """Mean squared five-point Laplacian of the residual inside each tile; cells at the tile's border count as 0."""
    e = cells.select("unit", "r", "c", _resid(state).alias("e"))
    row, col = Window.partitionBy("unit", "r").orderBy("c"), Window.partitionBy("unit", "c").orderBy("r")
    lap = F.lag("e").over(row) + F.lead("e").over(row) + F.lag("e").over(col) + F.lead("e").over(col) - 4 * F.col("e")
    e = e.withColumn("lap", F.coalesce(lap, F.lit(0.0)))
    return e.groupBy("unit").agg((F.sum(F.col("lap") ** 2) / F.count("*")).alias("hf"))


def laplacian_abs(cells: DataFrame, value: str = "coarse") -> DataFrame:
    """|Laplacian| of a grid; beyond the border the border cell repeats."""
    v = cells.select("r", "c", F.col(value).alias("v"))
    row, col = Window.partitionBy("r").orderBy("c"), Window.partitionBy("c").orderBy("r")
    near = lambda w, f: F.coalesce(f("v").over(w), F.col("v"))
    lap = near(row, F.lag) + near(row, F.lead) + near(col, F.lag) + near(col, F.lead) - 4 * F.col("v")
    return v.select("r", "c", F.abs(lap).alias("hf"))


def box_variance(cells: DataFrame, value: str = "coarse") -> DataFrame:
    """Variance of the 3 x 3 box about each cell, the box cut at the border."""
    v = cells.select("r", "c", F.col(value).alias("v"))
    rows = Window.partitionBy("r").orderBy("c").rangeBetween(-1, 1)
    cols = Window.partitionBy("c").orderBy("r").rangeBetween(-1, 1)
    v = v.withColumns({"s": F.sum("v").over(rows), "q": F.sum(F.col("v") ** 2).over(rows), "n": F.count("v").over(rows)})
    n = F.sum("n").over(cols)
    m = F.sum("s").over(cols) / n
    return v.select("r", "c", F.greatest(F.sum("q").over(cols) / n - m * m, F.lit(0.0)).alias("local_var"))


def average_rank(df: DataFrame, column: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Average rank over n; 0 where the column is constant."""
    part = Window.partitionBy(*(by or [F.lit(0)]))
    ties = Window.partitionBy(*(by or []), column)
    r = F.rank().over(part.orderBy(column)) + (F.count("*").over(ties) - 1) / 2
    flat = F.max(column).over(part) == F.min(column).over(part)
    return df.withColumn(out, F.when(flat, 0.0).otherwise(r / F.count("*").over(part)))


def quantile_normalised(df: DataFrame, column: str, out: str, limit: float = 3.0, eps: float = 1e-8) -> DataFrame:
    """(x - median) / (q90 - q10 + eps), clipped."""
    q = df.agg(F.percentile(column, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("_q"))
    x = (F.col(column) - F.col("_q")[1]) / (F.col("_q")[2] - F.col("_q")[0] + eps)
    return df.join(F.broadcast(q)).withColumn(out, F.least(F.greatest(x, F.lit(-limit)), F.lit(limit))).drop("_q")  # one row


def seam(cells: DataFrame, units: DataFrame, halo: int, state: str = "coarse", eps: float = 1e-8) -> DataFrame:
    """Seam score of each tile: median jump across the outer border of its halo over the median jump across its inner border.

    ``units``: unit, r0, c0, r1, c1 (bounds of the tile, ends excluded).
    """
    v = cells.select("r", "c", F.col(state).alias("v"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (0, -1), (1, 0), (-1, 0))])
    box = units.select("unit", "r0", "c0", "r1", "c1")
    grid = box.withColumn("r", F.explode(F.sequence(F.col("r0") - halo, F.col("r1") + halo - 1)))
    grid = grid.withColumn("c", F.explode(F.sequence(F.col("c0") - halo, F.col("c1") + halo - 1)))
    out = lambda m: (F.col("r2") < F.col("r0") - m) | (F.col("r2") >= F.col("r1") + m) | (F.col("c2") < F.col("c0") - m) | (F.col("c2") >= F.col("c1") + m)
    within = (F.col("r") >= F.col("r0")) & (F.col("r") < F.col("r1")) & (F.col("c") >= F.col("c0")) & (F.col("c") < F.col("c1"))
    p = grid.withColumn("o", F.explode(steps)).withColumns({"r2": F.col("r") + F.col("o.i"), "c2": F.col("c") + F.col("o.j")})
    side = F.when(within & out(0), "in").when(out(halo), "out")
    p = p.withColumn("side", side).where("side IS NOT NULL")
    p = p.join(v, ["r", "c"]).join(v.select(F.col("r").alias("r2"), F.col("c").alias("c2"), F.col("v").alias("v2")), ["r2", "c2"])
    med = lambda s: F.median(F.when(F.col("side") == s, F.abs(F.col("v") - F.col("v2"))))
    return p.groupBy("unit").agg((F.coalesce(med("out"), F.lit(0.0)) / (F.coalesce(med("in"), F.lit(0.0)) + eps)).alias("seam"))


def quality(cells: DataFrame, state: str) -> DataFrame:
    """One row: mse and PSNR over the range of the reference."""
    from ..functions.scalar import psnr

    m = cells.agg(F.avg(_resid(state) ** 2).alias("mse"), (F.max("gt") - F.min("gt")).alias("span"))
    return m.select("mse", psnr(F.col("mse"), F.col("span")).alias("psnr"))


def haar_energy(cells: DataFrame) -> DataFrame:
    """Energy of the Haar details (three of each 2 x 2 group) by tile."""
    g = cells.groupBy("unit", F.floor(F.col("r") / 2).alias("a"), F.floor(F.col("c") / 2).alias("b"))
    at = lambda i, j: F.sum(F.when((F.col("r") % 2 == i) & (F.col("c") % 2 == j), F.col("gt")))
    q = g.agg(at(0, 0).alias("p"), at(0, 1).alias("q"), at(1, 0).alias("s"), at(1, 1).alias("t"))
    h = (F.col("p") - F.col("q") + F.col("s") - F.col("t")) / 2
    v = (F.col("p") + F.col("q") - F.col("s") - F.col("t")) / 2
    d = (F.col("p") - F.col("q") - F.col("s") + F.col("t")) / 2
    return q.groupBy("unit").agg(F.sum(h * h + v * v + d * d).alias("energy"))


def fsr_instability(now: DataFrame, before: DataFrame, refined: DataFrame) -> DataFrame:
    """One row: share of sign flips and coefficient of variation of |rho| among units that were not refined."""
    free = now.join(refined.select("unit"), "unit", "left_anti").join(before.select("unit", F.col("rho").alias("old")), "unit", "left")
    flip = F.avg((F.signum("rho") != F.signum(F.coalesce("old", "rho"))).cast("double"))
    m = F.avg(F.abs("rho"))
    return free.agg(F.coalesce(flip, F.lit(0.0)).alias("fsr"), F.when(m < 1e-10, 0.0).otherwise(F.try_divide(F.stddev_pop(F.abs("rho")), m)).alias("instability"))


def seam_of_sets(members: DataFrame, edges: DataFrame, values: DataFrame, hops: int, eps: float = 1e-8) -> DataFrame:
    """(unit, jump_out, jump_in, p95_out, seam) of sets of vertices on a graph or tree.

    ``members``: unit, id; ``edges``: src, dst in both directions; ``values``: id, v. Out:
    edges from the halo of that many hops to the outside; in: edges from the set to its halo.
    """
    from .refine import halo_of

    halo = halo_of(members, edges, hops).select("unit", "id")
    side = members.select("unit", "id", F.lit(0).alias("s")).unionAll(halo.select("unit", "id", F.lit(1).alias("s")))
    other = side.select("unit", F.col("id").alias("dst"), F.col("s").alias("s2"))
    e = halo.join(edges.select(F.col("src").alias("id"), "dst"), "id").join(other, ["unit", "dst"], "left")
    e = e.where("s2 IS NULL OR s2 = 0")
    e = e.join(values.select("id", F.col("v").alias("a")), "id").join(values.select(F.col("id").alias("dst"), F.col("v").alias("b")), "dst")
    jump = lambda c: F.when(c, F.abs(F.col("a") - F.col("b")))
    out, into = jump(F.col("s2").isNull()), jump(F.col("s2").isNotNull())
    g = e.groupBy("unit").agg(F.median(out).alias("o"), F.median(into).alias("i"), F.percentile(out, 0.95).alias("p"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return g.select("unit", z("o").alias("jump_out"), z("i").alias("jump_in"), z("p").alias("p95_out"), (z("o") / (z("i") + eps)).alias("seam"))


def seam_change(cells: DataFrame, units: DataFrame, halo: int, before: str, after: str) -> DataFrame:
    """(unit, delta): seam score after less the one before."""
    a, b = (seam(cells, units, halo, s).withColumnRenamed("seam", n) for s, n in ((before, "s0"), (after, "s1")))
    return a.join(b, "unit").select("unit", (F.col("s1") - F.col("s0")).alias("delta"))


def interior_gain(cells: DataFrame, before: str, after: str) -> DataFrame:
    """(unit, gain): fall of the mean squared error, 0 at least."""
    return cells.groupBy("unit").agg(F.greatest(F.lit(0.0), F.avg(_resid(before) ** 2) - F.avg(_resid(after) ** 2)).alias("gain"))


def state_hash(cells: DataFrame, value: str, digits: int = 6) -> DataFrame:
    """One row ``hash``: 16 hex digits of the SHA-256 over blocks of 4096 units, of the hashes of the units, of their cells; all in order."""
    line = F.format_string(f"%d:%d:%.{digits}f", "r", "c", F.round(value, digits) + 0.0)

    def digest(order: list, text) -> Column:
        rows = F.array_sort(F.collect_list(F.struct(*order, text.alias("_t"))))
        return F.sha2(F.array_join(F.transform(rows, lambda x: x["_t"]), ";"), 256)

    u = cells.groupBy("unit").agg(digest(["r", "c"], line).alias("h"))
    b = u.groupBy(F.floor(F.col("unit") / 4096).alias("block")).agg(digest(["unit"], F.col("h")).alias("h"))
    return b.agg(F.substring(digest(["block"], F.col("h")), 1, 16).alias("hash"))
