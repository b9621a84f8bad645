"""Fourier transforms of grids as two grouped sums, one an axis, and what is read from them.

A case's grid of n x n cells takes 2 * n**3 products spread over all tasks and summed
before the shuffle; no task holds a grid.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dft(cells: DataFrame, by: list[str], value: str, side: int) -> DataFrame:
    """(by, j, k, re, im) of square grids with columns r, c from 0."""
    turn = lambda a, b: 2 * math.pi / side * ((F.col(a) * F.col(b)) % side)
    freq = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    one = cells.select(*by, "r", "c", F.col(value).alias("x")).withColumn("k", freq)
    one = one.groupBy(*by, "r", "k").agg(F.sum(F.col("x") * F.cos(turn("k", "c"))).alias("p"), F.sum(-F.col("x") * F.sin(turn("k", "c"))).alias("q"))
    two, co, si = one.withColumn("j", freq), F.cos(turn("j", "r")), F.sin(turn("j", "r"))
    return two.groupBy(*by, "j", "k").agg(F.sum(F.col("p") * co + F.col("q") * si).alias("re"), F.sum(F.col("q") * co - F.col("p") * si).alias("im"))


def frequency(side: int) -> Column:
    """Length of the frequency vector of (j, k), half a cycle a cell at most on each axis."""
    axis = lambda a: F.when(F.col(a) < (side + 1) // 2, F.col(a)).otherwise(F.col(a) - side) / side
    return F.sqrt(axis("j") * axis("j") + axis("k") * axis("k"))


def spectral_info(cells: DataFrame, by: list[str], value: str, side: int) -> DataFrame:
    """(by, centroid, hf_ratio, lf_ratio): power's mean frequency and its shares above 1/8 and below 1/32; 0, 0, 1 without power."""
    p = dft(cells, by, value, side).select(*by, (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("p"), frequency(side).alias("f"))
    total = F.sum("p")
    share = lambda x, none: F.when(total < 1e-15, none).otherwise(F.sum(x) / total)
    part = lambda c: F.when(c, F.col("p")).otherwise(0.0)
    return p.groupBy(*by).agg(
        share(F.col("f") * F.col("p"), 0.0).alias("centroid"),
        share(part(F.col("f") > 0.125), 0.0).alias("hf_ratio"),
        share(part(F.col("f") < 0.03125), 1.0).alias("lf_ratio"),
    )


def low_share(cells: DataFrame, by: list[str], value: str, side: int, cut: float = 0.125) -> DataFrame:
    """(by, lf): share of the power below a frequency."""
    p = dft(cells, by, value, side).select(*by, (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("p"), frequency(side).alias("f"))
    return p.groupBy(*by).agg((F.sum(F.when(F.col("f") < cut, F.col("p")).otherwise(0.0)) / (F.sum("p") + 1e-12)).alias("lf"))


def phase_gap(cells: DataFrame, by: list[str], a: str, b: str, side: int) -> DataFrame:
    """(by, d_phase): mean angle between the transforms of two fields, weighted by the magnitude of ``b``'s."""
    x = dft(cells, by, a, side).select(*by, "j", "k", F.atan2("im", "re").alias("pa"))
    y = dft(cells, by, b, side).select(*by, "j", "k", F.atan2("im", "re").alias("pb"), (F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) + 1e-12).alias("m"))
    turn = F.abs(F.col("pa") - F.col("pb"))
    gap = F.least(turn, 2 * math.pi - turn)
    return x.join(y, [*by, "j", "k"]).groupBy(*by).agg((F.sum(gap * F.col("m")) / F.sum("m")).alias("d_phase"))
