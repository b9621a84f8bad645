"""Plans that refine a grid within a budget.

``topk_refine`` is one declarative plan. ``MultiTick`` is the loop for many ticks: each
tick is one plan over the cells, cut by a reliable checkpoint; the driver keeps only
a few numbers a tick.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import morton
from ..operators import enforce, refine, scales, select, units


def tiles_of(cells: DataFrame, tile: int) -> DataFrame:
    """unit, ti, tj, bounds of the tile and its Morton key."""
    t = cells.select("unit", "ti", "tj").distinct()
    b = {"r0": F.col("ti") * tile, "c0": F.col("tj") * tile, "r1": (F.col("ti") + 1) * tile, "c1": (F.col("tj") + 1) * tile}
    return t.withColumns(b).withColumn("morton", morton(F.col("ti"), F.col("tj")))


def topk_refine(cells: DataFrame, side: int, tile: int, fraction: float, halo: int) -> DataFrame:
    """``cells`` with ``state``: the best tiles by rho (ties in Z-order) refined, overlapping halos multiplied."""
    t = tiles_of(cells, tile)
    k = select.budget((side // tile) ** 2, fraction)
    best = select.top_k(t.join(units.rho(cells), "unit"), "rho", "morton", k)
    return refine.refined(cells, refine.grid_masks(best, side, halo), ["r", "c"])


@dataclass(frozen=True)
class TickConfig:
    ticks: int = 4
    fraction: float = 0.3
    halo: int = 2
    tau: float = 0.6
    waste: float = 0.2
    patience: int = 3
    ema: float = 0.3
    roi: float = 0.0


@dataclass
class TickResult:
    cells: DataFrame
    log: DataFrame | None
    ticks: list[dict] = field(default_factory=list)
    reason: str = "ticks"


class MultiTick:
    """Refines a grid tick by tick: rho, order, deltas against the block means, enforcement, apply, converge.

    Within a tick each unit's delta is taken from the state at its start, so a tick is one
    plan; its halo-free core decides, and masks of accepted units apply as one product.
    A damped unit applies its mask scaled to the part that enforcement left.
    """

    def __init__(self, config: TickConfig | None = None):
        self.config = config or TickConfig()

    def run(self, cells: DataFrame, side: int, tile: int) -> TickResult:
        cfg = self.config
        spark = cells.sparkSession
        state = cells.withColumn("state", F.col("coarse")).checkpoint()
        t = tiles_of(cells, tile).checkpoint()
        n = (side // tile) ** 2
        total = select.budget(n, cfg.fraction)
        per = max(1, total // max(1, cfg.ticks))
        limit, spent, left = enforce.waste_limit(total, cfg.waste), 0.0, total
        strict = spark.createDataFrame([], "unit long, strictness double")
        done = spark.createDataFrame([], "unit long")
        out, log = TickResult(state, None), None
        quiet = 0
        for k in range(cfg.ticks):
            if left <= 0:
                out.reason = "budget_exhausted"
                break
            if spent >= limit > 0 or (limit == 0 and spent > 0):
                out.reason = "waste_exhausted"
                break
            r = units.rho(state, "state").join(t, "unit").join(done, "unit", "left_anti")
            best = r.where(F.col("rho") > cfg.roi).checkpoint()
            d = state.join(best.select("unit"), "unit").withColumn("delta", F.col("gt") - F.col("state"))
            two = Window.partitionBy("unit", F.floor(F.col("r") / 2), F.floor(F.col("c") / 2))
            d = d.withColumn("up", F.avg("delta").over(two))
            norms = d.groupBy("unit").agg(scales.norm(F.col("up")).alias("low"), scales.norm(F.col("delta") - F.col("up")).alias("high"), F.count("*").alias("n"))
            x = best.join(norms, "unit").join(strict, "unit", "left").withColumn("strictness", F.coalesce("strictness", F.lit(1.0)))
            x = enforce.decide(x, enforce.adaptive_tau(F.lit(cfg.tau), F.col("n"), F.col("strictness")))
            x = x.withColumn("kept", (F.col("action") != "reject").cast("double")).withColumn("waste", F.when(F.col("action") == "reject", F.col("strictness")).otherwise(0.0)).checkpoint()
            # in order, until the tick has its units or the waste is spent
            x = select.prefix_budget(x, "kept", "rho", "morton", min(per, left)).where("open").drop("spent", "open")
            x = select.prefix_budget(x, "waste", "rho", "morton", max(limit - spent, 1e-9)).where("open").drop("spent", "open", "kept")
            x = x.withColumn("tick", F.lit(k)).checkpoint()
            s = x.agg(F.sum((F.col("action") == "pass").cast("int")).alias("passed"), F.sum((F.col("action") == "damped").cast("int")).alias("damped"), F.sum((F.col("action") == "reject").cast("int")).alias("rejected"), F.sum("waste").alias("waste"), F.median("rho").alias("rho")).first()
            passed, damped, rejected = (s[c] or 0 for c in ("passed", "damped", "rejected"))
            scale = F.when(F.col("action") == "pass", 1.0).otherwise(F.sqrt((F.col("low") * F.pow(F.lit(0.5), F.col("steps"))) ** 2 + F.col("high") ** 2) / F.sqrt(F.col("low") ** 2 + F.col("high") ** 2))
            ok = x.where("action <> 'reject'").select("unit", "r0", "c0", "r1", "c1", scale.alias("scale"))
            masks = refine.grid_masks(ok, side, cfg.halo).join(ok.select("unit", "scale"), "unit").withColumn("m", F.col("m") * F.col("scale"))
            state = refine.refined(state.withColumnRenamed("state", "old"), masks, ["r", "c"], "old", "state").drop("old").checkpoint()
            done = done.unionByName(x.where("action <> 'reject'").select(F.col("unit").cast("long"))).checkpoint()
            log = x if log is None else log.unionByName(x)
            strict = enforce.strictness_path(log.select("unit", F.col("tick").alias("step"), "action")).withColumn("unit", F.col("unit").cast("long")).where("strictness > 1").checkpoint()
            spent += s["waste"] or 0.0
            left -= passed + damped
            out.ticks.append({"tick": k, "accepted": passed + damped, "damped": damped, "rejected": rejected, "rho": s["rho"]})
            quiet = quiet + 1 if passed + damped == 0 else 0
            if quiet >= cfg.patience:
                out.reason = "zero_accepted"
                break
        out.cells, out.log = state, log
        return out


def journal(log: DataFrame) -> DataFrame:
    """Decisions as an append-only table: region, tick, decision, metrics and thresholds as maps."""
    from ..functions.scalar import region_uri

    m = F.map_from_arrays(F.array(F.lit("rho"), F.lit("d_parent"), F.lit("d_final")), F.array("rho", "d_parent", "d_final"))
    return log.select(region_uri(F.lit("root"), F.lit("refine"), F.col("unit")).alias("region_id"), "tick", F.col("action").alias("decision"), m.alias("metrics"), F.map_from_arrays(F.array(F.lit("strictness")), F.array("strictness")).alias("thresholds"))
