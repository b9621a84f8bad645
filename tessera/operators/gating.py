"""Soft gate between signals: weights move by a moving average towards the residual alone or a combination."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GateConfig:
    instability: float = 0.25
    fsr: float = 0.20
    pilot: int = 3
    factor: float = 0.7
    fsr_floor: float = 0.05
    least: float = 0.2


def weighted_gate(ticks: DataFrame, by: list[str], tick: str, fsr: str, instability: str, alpha: Column, cfg: GateConfig = GateConfig()) -> DataFrame:
    """(by, tick, stage, w_resid, w_hf, w_var) after each tick of a run.

    The first ``pilot`` ticks of a run tighten both limits for the later ones, from the
    upper median of what they saw. Unhealthy ticks pull the residual's weight down by
    half the excess of instability, 60 % of which goes to high frequencies and 40 % to
    variance. A run's ticks (tens) are folded in one array; its weights start at 1, 0, 0.
    """
    row = F.struct(F.col(tick).alias("t"), F.col(fsr).alias("f"), F.col(instability).alias("i"))
    runs = ticks.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("_x"), F.first(alpha).alias("_a"))
    head = F.slice("_x", 1, cfg.pilot)
    mid = lambda name: F.try_element_at(F.array_sort(F.transform(head, lambda s: s[name])), F.lit(cfg.pilot // 2 + 1)) * cfg.factor
    runs = runs.withColumn("_i", F.least(F.lit(cfg.instability), mid("i")))
    runs = runs.withColumn("_f", F.greatest(F.lit(cfg.fsr_floor), F.least(F.lit(cfg.fsr), mid("f"))))

    def target(s: Column, k: Column) -> Column:
        early = k < cfg.pilot
        ti = F.when(early, F.lit(cfg.instability)).otherwise(F.col("_i"))
        tf = F.when(early, F.lit(cfg.fsr)).otherwise(F.col("_f"))
        ok = (s["i"] <= ti) & (s["f"] <= tf)
        excess = F.least(F.lit(1.0), F.greatest(F.lit(0.0), s["i"] - ti) / F.greatest(ti, F.lit(1e-6)))
        w = F.when(ok, 1.0).otherwise(F.greatest(F.lit(cfg.least), 1 - 0.5 * excess))
        return F.struct(s["t"].alias("t"), ok.alias("ok"), w.alias("w"))

    def step(acc: Column, s: Column) -> Column:
        move = lambda old, goal: old + F.col("_a") * (goal - old)
        r, h, v = move(acc["r"], s["w"]), move(acc["h"], (1 - s["w"]) * 0.6), move(acc["v"], (1 - s["w"]) * 0.4)
        total = r + h + v
        one = F.struct(s["t"].alias("t"), s["ok"].alias("ok"), (r / total).alias("r"), (h / total).alias("h"), (v / total).alias("v"))
        return F.struct((r / total).alias("r"), (h / total).alias("h"), (v / total).alias("v"), F.concat(acc["out"], F.array(one)).alias("out"))

    t = ticks.schema[tick].dataType.simpleString()
    zero = F.struct(F.lit(1.0).alias("r"), F.lit(0.0).alias("h"), F.lit(0.0).alias("v"), F.array().cast(f"array<struct<t:{t},ok:boolean,r:double,h:double,v:double>>").alias("out"))
    folded = F.aggregate(F.transform("_x", target), zero, step)["out"]
    y = runs.select(*by, F.explode(folded).alias("o"))
    stage = F.when(F.col("o.ok"), "healthy").otherwise("combo")
    return y.select(*by, F.col("o.t").alias(tick), stage.alias("stage"), F.col("o.r").alias("w_resid"), F.col("o.h").alias("w_hf"), F.col("o.v").alias("w_var"))


def profiles(spark: SparkSession, n: int) -> DataFrame:
    """(profile, tick, instability, fsr): calm, rising, stepping and alternating instability."""
    t = F.col("tick")
    v = {
        "stable": F.lit(0.1),
        "ramp": 0.1 + 0.7 * (t / max(n - 1, 1)),
        "step": F.when(t < n // 2, 0.1).otherwise(0.8),
        "oscillating": F.when(t % 2 == 0, 0.1).otherwise(0.8),
    }
    p = F.explode(F.array(*[F.struct(F.lit(k).alias("profile"), e.alias("instability")) for k, e in v.items()]))
    x = spark.range(n).select(F.col("id").cast("int").alias("tick")).withColumn("p", p)
    return x.select("p.profile", "tick", "p.instability", (F.col("p.instability") * 0.3).alias("fsr"))


def convergence(gate: DataFrame, by: list[str], tick: str, last: int, last_k: int = 3, limit: float = 0.05) -> DataFrame:
    """(by, spread, converged, w_resid, healthy, combo): largest variance of a weight over the last ticks, the final weight, counts of stages."""
    late = lambda c: F.coalesce(F.var_pop(F.when(F.col(tick) > last - last_k, F.col(c))), F.lit(0.0))
    spread = F.greatest(late("w_resid"), late("w_hf"), late("w_var"))
    ok = F.col("stage") == "healthy"
    return gate.groupBy(*by).agg(spread.alias("spread"), (spread < limit).alias("converged"), F.max_by("w_resid", tick).alias("w_resid"), F.count_if(ok).alias("healthy"), F.count_if(~ok).alias("combo"))
