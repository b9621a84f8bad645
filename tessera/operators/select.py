"""Orders, top-k selections, quotas and samples; every order has a declared tie-break."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import probe_seed
from ..sources.tables import stored


def _runs(df: DataFrame, score: str, key: str) -> DataFrame:
    """``_run``: number of a row's run in the order of score descending, then key.

    Runs are cut by Spark's sampled splitters of both columns, so rows with one score spread over
    several runs; they are written once, as a second sample might cut elsewhere. Null scores come last.
    """
    return stored(df.repartitionByRange(F.desc(score), F.asc(key)).withColumn("_run", F.spark_partition_id()))


def ranked(df: DataFrame, score: str, key: str, by: list[str] | None = None) -> DataFrame:
    """``rank`` from 1: score descending, then key ascending. Over all rows, a run's ranks start where those before it end."""
    order = [F.desc(score), F.asc(key)]
    if by:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    x = _runs(df, score, key)
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)  # one row a run
    at = x.groupBy("_run").agg(F.count("*").alias("_n")).select("_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_at"))
    x = x.join(F.broadcast(at), "_run").withColumn("rank", (F.row_number().over(Window.partitionBy("_run").orderBy(*order)) + F.col("_at")).cast("int"))
    return x.drop("_run", "_at")


def top_k(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The k best rows; a limit over an order, so each task keeps k rows at most."""
    return df.orderBy(F.desc(score), F.asc(key)).limit(k)


def budget(n: int, fraction: float) -> int:
    return max(1, int(fraction * n))


def threshold_top_k(df: DataFrame, score: str, k: int) -> DataFrame:
    """All rows at or above the k-th best score: more than k on ties."""
    cut = df.select(score).orderBy(F.desc(score)).limit(k).agg(F.min(score).alias("_cut"))
    return df.join(F.broadcast(cut)).where(F.col(score) >= F.col("_cut")).drop("_cut")  # one row


def cascade_quota(df: DataFrame, cluster: str, score: str, key: str, ratio: float) -> DataFrame:
    """``active``: the best max(1, ceil(size * ratio)) units of each cluster."""
    w = Window.partitionBy(cluster)
    keep = F.greatest(F.lit(1), F.ceil(F.count("*").over(w) * F.lit(ratio)))
    return df.withColumn("active", F.row_number().over(w.orderBy(F.desc(score), F.asc(key))) <= keep)


def probes(units: DataFrame, a: str, b: str, key: str, k: int, level: int = 0, seed: int = 42) -> DataFrame:
    """The k units with the smallest hash seeds, ties by key."""
    return units.withColumn("seed", probe_seed(F.col(a), F.col(b), level, seed)).orderBy("seed", key).limit(k)


def stratified(df: DataFrame, score: str, key: str, per_bin: int) -> DataFrame:
    """Evenly spaced rows of the four quartile bins of the score: each bin gives about ``per_bin``."""
    q = df.agg(F.percentile(score, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    x = df.join(F.broadcast(q))  # one row
    b = F.when(F.col(score) <= F.col("_q")[0], 0).when(F.col(score) <= F.col("_q")[1], 1).when(F.col(score) <= F.col("_q")[2], 2).otherwise(3)
    x = x.withColumn("bin", b)
    w = Window.partitionBy("bin")
    step = F.greatest(F.lit(1), F.floor(F.count("*").over(w) / per_bin))
    at = F.row_number().over(w.orderBy(score, key)) - 1
    return x.withColumn("_at", at).withColumn("_step", step).where(F.col("_at") % F.col("_step") == 0).drop("_q", "_at", "_step")


def quadtree_order(tiles: DataFrame, half: int, score: str = "rho") -> DataFrame:
    """``rank``: quadrants by their total, tiles by score inside; ties by unit."""
    quad = (F.floor(F.col("ti") / half) * 2 + F.floor(F.col("tj") / half)).cast("int")
    t = tiles.withColumn("quadrant", quad)
    q = t.groupBy("quadrant").agg(F.sum(score).alias("_total"), F.count("*").alias("_n"))
    before = Window.orderBy(F.desc("_total"), "quadrant").rowsBetween(Window.unboundedPreceding, -1)  # one row a quadrant
    q = q.select("quadrant", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_at"))
    inside = F.row_number().over(Window.partitionBy("quadrant").orderBy(F.desc(score), "unit"))
    return t.withColumn("_i", inside).join(q, "quadrant").withColumn("rank", (F.col("_at") + F.col("_i")).cast("int")).drop("_at", "_i")


def prefix_budget(df: DataFrame, cost: str, score: str, key: str, limit: float) -> DataFrame:
    """``spent`` before each row, in order of the score descending, and ``open``: whether that had not reached the limit yet."""
    x = _runs(df, score, key)
    back = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)  # one row a run
    at = x.groupBy("_run").agg(F.sum(cost).alias("_s")).select("_run", F.coalesce(F.sum("_s").over(back), F.lit(0.0)).alias("_at"))
    w = Window.partitionBy("_run").orderBy(F.desc(score), F.asc(key)).rowsBetween(Window.unboundedPreceding, -1)
    x = x.join(F.broadcast(at), "_run").withColumn("spent", F.col("_at") + F.coalesce(F.sum(cost).over(w), F.lit(0.0)))
    return x.withColumn("open", F.col("spent") < limit).drop("_run", "_at")


def ucb(df: DataFrame, reward: str, pulls: str, c: float) -> DataFrame:
    """Upper confidence score: mean reward and sqrt(ln of all pulls over own pulls)."""
    n = F.broadcast(df.agg(F.sum(pulls).alias("_all")))  # one row
    return df.join(n).withColumn("ucb", F.col(reward) / F.col(pulls) + c * F.sqrt(F.log("_all") / F.col(pulls))).drop("_all")


def allocation(clusters: DataFrame, n_total: int, fraction: float) -> DataFrame:
    """Budget of each cluster in streaming order (mean structure score descending, then cluster): its share of the sizes,
    one at least, capped by survivors and by what earlier clusters left.

    ``clusters``: cluster, size, survivors, mean_score.
    """
    t = clusters.join(F.broadcast(clusters.agg(F.sum("size").alias("_all"))))  # one row
    want = F.greatest(F.lit(1), F.floor(F.lit(fraction * n_total) * F.col("size") / F.col("_all")).cast("long"))
    t = t.withColumn("want", F.least(want, F.col("survivors").cast("long")))
    most = budget(n_total, fraction)
    t = prefix_budget(t, "want", "mean_score", "cluster", most)
    left = F.greatest(F.lit(most) - F.col("spent").cast("long"), F.lit(0))
    return t.withColumn("given", F.least("want", left)).drop("_all", "spent", "open")
