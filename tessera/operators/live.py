"""Refinement unit by unit that reads each unit's rho at its turn, found as a fixed point instead of a loop over units.

A unit's turn sees the masks of refined units before it and, through the governor's average,
how many they are. So decisions of all units follow from those before them in the order, and
only one set of decisions gives itself back: the sequential one. From any guess, every round
settles at least the first unit that was wrong, and as masks reach a few neighbours and the
average soon stands still, rounds are few and do not grow with the number of units.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored
from . import select, units

#: ranks that one task counts; there are as many tasks as the order needs
SPAN = 1 << 16


@dataclass
class LiveResult:
    units: DataFrame  # unit, rank, before, rho (null once the budget is spent), refined, ema
    cells: DataFrame  # id, unit, gt, coarse, state
    rounds: int


def _before(decisions: DataFrame) -> DataFrame:
    """``before``: refined units of lower rank, counted in spans of ranks."""
    x = decisions.withColumn("_b", F.floor((F.col("rank") - 1) / SPAN))
    n = x.groupBy("_b").agg(F.sum(F.col("refined").cast("long")).alias("_n"))
    up = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row a span
    n = n.select("_b", F.coalesce(F.sum("_n").over(up), F.lit(0)).alias("_at"))
    w = Window.partitionBy("_b").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(F.col("refined").cast("long")).over(w), F.lit(0))
    return x.join(n, "_b").withColumn("before", F.col("_at") + inside).drop("_b", "_at")


def _left(keep: Column) -> Column:
    """Product of what earlier masks leave, in the order of ranks."""
    return F.aggregate(F.array_sort(F.collect_list(keep)), F.lit(1.0), lambda a, x: a * x["left"])


def live_refine(cells: DataFrame, masks: DataFrame, keys: DataFrame, fraction: float, alpha: float = 0.1) -> LiveResult:
    """Takes units by rho (ties by ``key``) and refines one if its rho at its turn is above half the governor's average,
    or while fewer than a third of the budget are refined; ends when the budget is spent.

    ``cells``: id, unit (null: in no unit), gt, coarse; ``masks``: unit, id, m, the core included;
    ``keys``: unit, key. The average gains ``alpha`` of the way to 1 with each refined unit.
    A unit without cells has no rho and is left out; without units all cells keep their coarse value.
    """
    cells = cells.select("id", "unit", "gt", "coarse")
    first = units.rho(cells)
    order = stored(select.ranked(keys.select("unit", "key").join(first, "unit"), "rho", "key").select("unit", "rank", "rho"))
    n = order.count()
    if not n:
        empty = order.select("unit", "rank", F.lit(0).cast("long").alias("before"), "rho", F.lit(False).alias("refined"), F.lit(0.0).alias("ema"))
        return LiveResult(empty, cells.withColumn("state", F.col("coarse")), 0)
    budget = select.budget(n, fraction)
    floor = max(1, budget // 3)
    low = order.select(F.col("unit").alias("by"), F.col("rank").alias("_r"))
    m = masks.select(F.col("unit").alias("by"), "id", (1 - F.col("m")).alias("left")).join(low, "by")
    core = cells.where("unit IS NOT NULL").join(order.select("unit", "rank"), "unit")
    # masks of earlier units on cells of later ones: all that a turn depends on
    reach = core.select("id", "unit", "rank", (F.col("gt") - F.col("coarse")).alias("e")).join(m, "id").where("_r < rank")
    reach = stored(reach.select("unit", "id", "e", "by", F.col("_r").alias("r"), "left"))
    sums = core.groupBy("unit").agg(F.count("*").alias("n"), F.sum((F.col("gt") - F.col("coarse")) ** 2).alias("q"))
    base = stored(order.select("unit", "rank", "rho").join(sums, "unit"))

    def turn(decisions: DataFrame) -> DataFrame:
        on = decisions.where("refined").select(F.col("unit").alias("by"))
        hit = reach.join(on, "by").groupBy("unit", "id").agg(F.first("e").alias("e"), _left(F.struct("r", "left")).alias("f"))
        less = hit.groupBy("unit").agg(F.sum(F.col("e") ** 2 * (F.col("f") ** 2 - 1)).alias("d"))
        x = base.join(less, "unit", "left").join(_before(decisions).select("unit", "before", F.col("refined").alias("old")), "unit")
        rho = F.when(F.col("d").isNull(), F.col("rho")).otherwise(F.greatest((F.col("q") + F.col("d")) / F.col("n"), F.lit(0.0)))
        half = (1 - F.pow(F.lit(1 - alpha), F.col("before"))) / 2
        x = x.withColumn("rho", rho)
        return x.withColumn("refined", (F.col("before") < budget) & ((F.col("before") < floor) | (F.col("rho") > half))).drop("q", "d", "n")

    now, rounds = order.withColumn("refined", F.col("rank") <= budget), 0
    while True:
        now = stored(turn(now))
        rounds += 1
        if now.where("refined <> old").isEmpty():
            break
    ema = 1 - F.pow(F.lit(1 - alpha), F.col("before") + F.col("refined").cast("int"))
    done = now.select("unit", "rank", "before", F.when(F.col("before") < budget, F.col("rho")).alias("rho"), "refined", ema.alias("ema"))
    f = m.join(done.where("refined").select(F.col("unit").alias("by")), "by").groupBy("id").agg(_left(F.struct(F.col("_r"), F.col("left"))).alias("_f"))
    state = F.col("gt") - (F.col("gt") - F.col("coarse")) * F.coalesce("_f", F.lit(1.0))
    return LiveResult(done, cells.join(f, "id", "left").withColumn("state", F.when(F.col("_f").isNull(), F.col("coarse")).otherwise(state)).drop("_f"), rounds)
