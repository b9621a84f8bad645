"""Scale-consistency enforcement: pass, damp or reject each unit's delta.

With a block-mean R and nearest Up, Up(R(.)) is a projection: damping by half of it
leaves the high part as it is and halves the low part. So after k steps the ratio
follows from the two norms alone, and all steps are one expression per unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS = 3


def adaptive_tau(tau: Column, n: Column, strictness: Column) -> Column:
    """Threshold, wider for small samples, tighter under strictness."""
    return tau * (1 + 2 / F.sqrt(n)) / strictness


def decide(units: DataFrame, tau: Column) -> DataFrame:
    """``units``: unit, low (norm of Up(R(delta))), high (norm of the rest). Adds d_parent, steps, final ratio, action."""
    ratio = lambda k: F.col("low") * 0.5**k / (F.sqrt((F.col("low") * 0.5**k) ** 2 + F.col("high") ** 2) + 1e-12)
    steps = F.lit(None).cast("int")
    for k in range(STEPS, 0, -1):
        steps = F.when(ratio(k) <= tau, k).otherwise(steps)
    d = ratio(0)
    action = F.when(d <= tau, "pass").when(d > 2 * tau, "reject").when(steps.isNull(), "reject").otherwise("damped")
    x = units.withColumn("d_parent", d).withColumn("action", action)
    done = F.when(F.col("action") == "pass", 0).when(F.col("action") == "damped", steps).otherwise(F.when(d > 2 * tau, 0).otherwise(STEPS))
    x = x.withColumn("steps", done.cast("int"))
    final = F.lit(0.0)
    for k in range(STEPS + 1):
        final = F.when(F.col("steps") == k, ratio(k)).otherwise(final)
    return x.withColumn("d_final", final)


def strictness_path(log: DataFrame, unit: str = "unit", step: str = "step") -> DataFrame:
    """(unit, strictness) after a log of decisions: times 1.5 for each reject, times 0.9 at each step's end, dropped to 1 at or below it."""
    seq = F.array_sort(F.collect_list(F.struct(F.col(step).alias("s"), (F.col("action") == "reject").cast("int").alias("x"))))
    fold = F.aggregate(seq, F.lit(1.0), lambda a, e: F.greatest(F.lit(1.0), a * F.when(e["x"] == 1, 1.5).otherwise(1.0) * 0.9))
    return log.groupBy(unit).agg(fold.alias("strictness"))


def waste_limit(budget: int, share: float = 0.2) -> int:
    return int(budget * share)
