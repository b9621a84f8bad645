"""Order-dependent state: folds over a unit's steps, and window forms where a frame says the same.

A unit's steps are gathered into one array; they are few (tens to hundreds of ticks).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import component_diff, hamming12, is_dirty


def _steps(df: DataFrame, unit: str, step: str, *cols: str) -> DataFrame:
    return df.groupBy(unit).agg(F.array_sort(F.collect_list(F.struct(F.col(step).alias("step"), *cols))).alias("seq"))


def debounce(stream: DataFrame, unit: str, step: str, sig: str, need: int = 2) -> DataFrame:
    """(unit, step, crossing, run, trigger): crossings of the first signature, and triggers after ``need`` in a row."""
    w = Window.partitionBy(unit).orderBy(step)
    base = F.first_value(sig).over(w)
    x = stream.withColumn("crossing", is_dirty(F.col(sig), base))
    x = x.withColumn("_g", F.sum((~F.col("crossing")).cast("int")).over(w))
    run = F.sum(F.col("crossing").cast("int")).over(Window.partitionBy(unit, "_g").orderBy(step))
    return x.withColumn("run", run).withColumn("trigger", F.col("run") >= need).select(unit, step, "crossing", "run", "trigger")


def stability(stream: DataFrame, unit: str, step: str, sig: str, bits: int = 2, diff: int = 2, need: int = 3) -> DataFrame:
    """(unit, run, stable): steps in a row within bounds of a baseline that moves to each signature that leaves them."""
    init = F.struct(F.lit(-1).alias("base"), F.lit(0).alias("run"))

    def step_(a, e):
        ok = (a["base"] >= 0) & (hamming12(a["base"], e["sig"]) <= bits) & (component_diff(a["base"], e["sig"]) <= diff)
        return F.struct(F.when(ok, a["base"]).otherwise(e["sig"]).alias("base"), F.when(ok, a["run"] + 1).otherwise(1).alias("run"))

    s = _steps(stream.withColumn("sig", F.col(sig).cast("int")), unit, step, "sig")
    s = s.select(unit, F.aggregate("seq", init, step_).alias("z"))
    return s.select(unit, F.col("z.run").alias("run"), (F.col("z.run") >= need).alias("stable"))


def ema(costs: DataFrame, unit: str, step: str, cost: str, alpha: float) -> DataFrame:
    """(unit, ema): exponential mean that starts at the first cost."""
    init = F.struct(F.lit(False).alias("on"), F.lit(0.0).alias("v"))
    s = _steps(costs.withColumn("cost", F.col(cost).cast("double")), unit, step, "cost")
    fold = F.aggregate("seq", init, lambda a, e: F.struct(F.lit(True).alias("on"), F.when(a["on"], alpha * e["cost"] + (1 - alpha) * a["v"]).otherwise(e["cost"]).alias("v")))
    return s.select(unit, fold["v"].alias("ema"))


def governor(costs: DataFrame, unit: str, step: str, cost: str, low: float, high: float, alpha: float = 0.3, warm: int = 2) -> DataFrame:
    """(unit, ema, strictness): 0.05 up above the corridor and down below it after the warm-up, held in [0.5, 0.995]; starts at 0.8."""
    init = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("ema"), F.lit(0.8).alias("s"))

    def fold(a, e):
        m = F.when(a["n"] == 0, e["cost"]).otherwise(alpha * e["cost"] + (1 - alpha) * a["ema"])
        move = F.when(a["n"] + 1 <= warm, 0.0).when(m > high, 0.05).when(m < low, -0.05).otherwise(0.0)
        return F.struct((a["n"] + 1).alias("n"), m.alias("ema"), F.least(F.greatest(a["s"] + move, F.lit(0.5)), F.lit(0.995)).alias("s"))

    s = _steps(costs.withColumn("cost", F.col(cost).cast("double")), unit, step, "cost")
    s = s.select(unit, F.aggregate("seq", init, fold).alias("z"))
    return s.select(unit, F.col("z.ema").alias("ema"), F.col("z.s").alias("strictness"))


def softmax_gate(df: DataFrame, by: str, corr: str, stab: str, alpha: float = 0.7, beta: float = 0.3, temperature: float = 0.5, floor: float = 0.20, ceiling: float = 0.55) -> DataFrame:
    """``weight`` of each expert: softmax of alpha * corr + beta * stab, within bounds, adding to one."""
    w = Window.partitionBy(by)
    x = df.withColumn("_u", (alpha * F.col(corr) + beta * F.col(stab)) / temperature)
    x = x.withColumn("_e", F.exp(F.col("_u") - F.max("_u").over(w))).withColumn("_p", F.col("_e") / F.sum("_e").over(w))
    x = x.withColumn("_p", F.least(F.greatest("_p", F.lit(floor)), F.lit(ceiling)))
    return x.withColumn("weight", F.col("_p") / F.sum("_p").over(w)).drop("_u", "_e", "_p")


def burstiness(triggers: DataFrame, step: str) -> DataFrame:
    """One row: share of trigger steps with a trigger one step before or after."""
    d = triggers.select(step).distinct()
    n = d.select((F.col(step) - 1).alias(step)).unionAll(d.select((F.col(step) + 1).alias(step))).distinct().withColumn("near", F.lit(1))
    return d.join(n, step, "left").agg(F.avg(F.coalesce("near", F.lit(0)).cast("double")).alias("burstiness"))


def trajectories(log: DataFrame, unit: str, step: str, value: str) -> DataFrame:
    """(unit, mean, sd, slope, steps)."""
    return log.groupBy(unit).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.regr_slope(F.col(value), F.col(step).cast("double")).alias("slope"), F.count("*").alias("steps"))


def dedup_stages(log: DataFrame, uri: str, step: str, digest: str, rho: str, skip: Column, eps: float) -> DataFrame:
    """(uri, step, stage): policy, exact (equal digest as the visit before), similar (rho within eps), process."""
    w = Window.partitionBy(uri).orderBy(step)
    x = log.withColumn("_h", F.lag(digest).over(w)).withColumn("_r", F.lag(rho).over(w))
    stage = F.when(skip, "policy").when(F.col("_h") == F.col(digest), "exact").when(F.abs(F.col(rho) - F.col("_r")) <= eps, "similar").otherwise("process")
    return x.select(uri, step, stage.alias("stage"))


def converged(ticks: DataFrame, k: int = 3) -> DataFrame:
    """``stop``: no acceptance in this tick and the k - 1 before it."""
    w = Window.partitionBy(F.lit(0)).orderBy("tick").rowsBetween(-(k - 1), 0)
    return ticks.withColumn("stop", (F.max("accepted").over(w) == 0) & (F.count("*").over(w) == k))


def cold_start(units: DataFrame, prior: float) -> DataFrame:
    """One row: thresholds before the first tick from a zone's prior and the spread of rho."""
    cv = F.when(F.avg("rho") < 1e-10, 0.0).otherwise(F.try_divide(F.stddev_pop("rho"), F.avg("rho")))
    x = units.agg(cv.alias("cv")).withColumn("instability", (0.5 * prior + 0.5 * F.col("cv")) * 0.7)
    return x.select("cv", "instability", F.greatest(F.lit(0.05), F.col("instability") / 2).alias("fsr"))
