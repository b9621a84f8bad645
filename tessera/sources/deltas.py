"""Labelled changes of a grid: good ones keep to the coarse field's mean, bad ones contradict it."""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import scales

PI = math.pi


def digest(seed: int, *keys) -> float:
    """A number in (0, 1) from the MD5 of the seed and the keys, the same as ``digest_uniform`` gives."""
    h = hashlib.md5(",".join(map(str, (seed, *keys))).encode()).hexdigest()
    return (int(h[:12], 16) + 0.5) / 2**48


def digest_hex(seed: int, *keys: str | Column) -> Column:
    """The twelve hex digits behind ``digest_uniform``; as text they have the order of its numbers and cost less."""
    text = F.concat_ws(",", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.substring(F.md5(text), 1, 12)


def digest_uniform(seed: int, *keys: str | Column) -> Column:
    return (F.conv(digest_hex(seed, *keys), 16, 10).cast("long") + 0.5) / float(2**48)


def digest_above(cuts: tuple[float, ...], seed: int, *keys: str | Column) -> Column:
    """How many of the cuts (rising, within 0 and 1) ``digest_uniform`` lies above."""
    least = [math.floor(Fraction(c) * 2**48 - Fraction(1, 2)) + 1 for c in cuts]
    h = digest_hex(seed, *keys)
    return sum((F.when(h >= f"{n:012x}", 1).otherwise(0) for n in least), F.lit(0))


def digest_normal(seed: int, *keys: str | Column) -> Column:
    return F.sqrt(-2 * F.log(digest_uniform(seed, *keys))) * F.cos(2 * F.lit(PI) * digest_uniform(seed + 7919, *keys))


def smooth_noise(cells: DataFrame, side: int, sigma: float, seed: int, out: str) -> DataFrame:
    """(r, c, out): normal noise under a Gaussian blur with mirrored borders. The weights have side * 8 sigma rows at most."""
    w = scales.gaussian_weights(cells.sparkSession, side, sigma, 1)
    return scales.separable(cells.select("r", "c", digest_normal(seed, "r", "c").alias("x")), w, "x", True).withColumnRenamed("v", out)


def labelled(cells: DataFrame, side: int, seed: int = 42, shift: float = 0.2) -> DataFrame:
    """``cells`` (r, c, gt, coarse) once a case: columns case, good, delta.

    Good: the true detail, half of it, the detail with a little noise. Bad: a wave longer
    than a tile, smooth noise, the coarse field turned over, and shifts by a share of the
    coarse field whose sign changes by cell, smoothly, by block of eight, or across a line.
    """
    x = cells.join(smooth_noise(cells, side, 8.0, seed + 1, "_s8"), ["r", "c"]).join(smooth_noise(cells, side, 6.0, seed + 2, "_s6"), ["r", "c"])
    o, coarse = F.col("gt") - F.col("coarse"), F.col("coarse")
    sign = lambda c: F.when(c, 1.0).otherwise(-1.0)
    angle = 2 * PI * digest(seed, "angle")
    plane = math.cos(angle) * (F.col("c") / side - 0.5) + math.sin(angle) * (F.col("r") / side - 0.5)
    cases = [
        ("pos_oracle", o),
        ("pos_scaled", 0.5 * o),
        ("pos_noisy", o + 0.02 * digest_normal(seed, "r", "c")),
        ("neg_lf_drift", o + 0.3 * F.sin(2 * PI * 0.5 * F.col("c") / side + 2 * PI * digest(seed, "phase"))),
        ("neg_random_lf", 0.5 * F.col("_s8")),
        ("neg_semant_wrong", -2 * coarse),
        ("neg_coarse_shift", o + shift * coarse * sign(digest_uniform(seed + 3, "r", "c") > 0.5)),
        ("neg_shift_coherent", o + shift * coarse * sign(F.col("_s6") > 0)),
        ("neg_shift_block", o + shift * coarse * sign(digest_uniform(seed + 4, F.floor(F.col("r") / 8), F.floor(F.col("c") / 8)) > 0.5)),
        ("neg_shift_gradient", o + shift * coarse * sign(plane > 0)),
    ]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("case"), F.lit(n.startswith("pos")).alias("good"), d.alias("delta")) for n, d in cases]))
    return x.withColumn("_k", each).select(*cells.columns, "_k.case", "_k.good", "_k.delta")
