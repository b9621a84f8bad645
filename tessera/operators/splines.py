"""Prolongation of a grid by cubic splines.

A spline through the samples of a line has coefficients that a recursive filter gives: one pass
forward, one back, each step an affine map of the one before with slope ``POLE``. A line is cut
into blocks of ``BLOCK`` samples. Over a whole block the slope is POLE ** BLOCK, about 1e-37, so
the composed map of a block is a constant for doubles: its end depends on its own samples only,
and each block needs one number of its neighbour, however long the line is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POLE = math.sqrt(3) - 2
BLOCK = 64


def _scan(start: Column, rest: Column, step) -> Column:
    """Array of start and each further value step(previous, x)."""
    return F.aggregate(rest, F.array(start), lambda a, x: F.concat(a, F.array(step(F.element_at(a, -1), x))))


def coefficients(cells: DataFrame, line: str, at: str, n: int, value: str = "v") -> DataFrame:
    """(line, at, v): spline coefficients of lines of n samples at 0 to n - 1, mirrored about the first and the last sample.

    A line of one sample keeps it. Every sample of a line must be there, once, and not null.
    """
    x = cells.select(line, at, F.col(value).cast("double").alias("v"))
    if n < 2:
        return x
    z = F.lit(POLE)
    b = x.groupBy(line, F.floor(F.col(at) / BLOCK).alias("b")).agg(F.array_sort(F.collect_list(F.struct(at, "v"))).alias("s"))
    b = b.select(line, "b", F.transform("s", lambda e: 6 * e["v"]).alias("g"))
    # the sum over all mirror images of the line; what lies beyond the first block is below 1e-37 of it
    image = lambda g, i: g * (F.pow(z, i) + F.when((i > 0) & (i < n - 1), F.pow(z, F.lit(2 * n - 2) - i)).otherwise(0.0))
    first = F.aggregate(F.transform("g", image), F.lit(0.0), lambda a, e: a + e) / F.lit(1 - POLE ** (2 * n - 2))
    forward = lambda a, e: e + z * a
    rest = F.slice("g", 2, BLOCK)
    b = b.withColumn("first", F.when(F.col("b") == 0, first))
    b = b.withColumn("end", F.aggregate(rest, F.coalesce("first", F.element_at("g", 1)), forward))
    w = Window.partitionBy(line).orderBy("b")
    b = b.withColumn("carry", F.lag("end").over(w))
    b = b.withColumn("up", _scan(F.coalesce("first", forward(F.col("carry"), F.element_at("g", 1))), rest, forward))
    last = F.floor(F.lit((n - 1) // BLOCK))
    before = F.when(F.size("up") > 1, F.try_element_at("up", F.lit(-2))).otherwise(F.col("carry"))
    b = b.withColumn("last", F.when(F.col("b") == last, F.lit(POLE / (POLE * POLE - 1)) * (F.element_at("up", -1) + z * before)))
    back = lambda a, e: z * (a - e)
    down = F.slice(F.reverse("up"), 2, BLOCK)
    b = b.withColumn("head", F.aggregate(down, F.coalesce("last", -z * F.element_at("up", -1)), back))
    b = b.withColumn("next", F.lead("head").over(w))
    c = F.reverse(_scan(F.coalesce("last", back(F.col("next"), F.element_at("up", -1))), down, back))
    return b.select(line, "b", F.posexplode(c).alias("i", "v")).select(line, (F.col("b") * BLOCK + F.col("i")).cast("int").alias(at), "v")


def _taps(cells: DataFrame, n: int, fine: int) -> DataFrame:
    """(fine, at, w): the four coefficients that each of ``fine`` evenly spaced points reads, ends on ends."""
    i = cells.sparkSession.range(fine)
    x = F.col("id") * F.lit((n - 1) / (fine - 1)) if fine > 1 else F.lit(0.0)
    t = i.select(F.col("id").cast("int").alias("fine"), x.alias("x")).withColumn("f", F.least(F.floor("x"), F.lit(max(n - 2, 0))))
    t = t.withColumn("t", F.col("x") - F.col("f"))
    s = 1 - F.col("t")
    ws = [s**3 / 6, (3 * F.col("t") ** 3 - 6 * F.col("t") ** 2 + 4) / 6, (3 * s**3 - 6 * s**2 + 4) / 6, F.col("t") ** 3 / 6]
    t = t.select("fine", F.explode(F.array(*[F.struct((F.col("f") + k - 1).alias("at"), w.alias("w")) for k, w in enumerate(ws)])).alias("p"))
    period = 2 * n - 2
    at = F.pmod(F.col("p.at"), F.lit(period)) if period else F.lit(0)
    return t.select("fine", F.least(at, F.lit(period) - at).cast("int").alias("at"), F.col("p.w").alias("w"))


def _along(cells: DataFrame, line: str, at: str, n: int, fine: int) -> DataFrame:
    c = coefficients(cells, line, at, n).withColumnRenamed(at, "at")
    out = c.join(_taps(cells, n, fine), "at").groupBy(line, "fine").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return out.withColumnRenamed("fine", at)


def spline_prolong(cells: DataFrame, shape: tuple[int, int], target: tuple[int, int], value: str = "v") -> DataFrame:
    """(r, c, v): a full grid of ``shape`` read at ``target`` evenly spaced rows and columns, corners on corners."""
    x = cells.select("r", "c", F.col(value).alias("v"))
    return _along(_along(x, "r", "c", shape[1], target[1]), "c", "r", shape[0], target[0]).select("r", "c", "v")
