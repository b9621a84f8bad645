"""Coarse and fine: restriction R and prolongation Up as aggregations and joins, and the metrics built on them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def block_restrict(cells: DataFrame, value: str, block: int = 2) -> DataFrame:
    """(br, bc, v): means of square blocks."""
    at = lambda c: F.floor(F.col(c) / block).cast("int")
    return cells.groupBy(at("r").alias("br"), at("c").alias("bc")).agg(F.avg(value).alias("v"))


def block_prolong(cells: DataFrame, coarse: DataFrame, block: int = 2, out: str = "up") -> DataFrame:
    at = lambda c: F.floor(F.col(c) / block).cast("int")
    x = cells.withColumns({"br": at("r"), "bc": at("c")}).join(coarse.withColumnRenamed("v", out), ["br", "bc"])
    return x.drop("br", "bc")


def cluster_restrict(nodes: DataFrame, value: str, cluster: str) -> DataFrame:
    return nodes.groupBy(cluster).agg(F.avg(value).alias("v"))


def cluster_prolong(nodes: DataFrame, coarse: DataFrame, cluster: str, out: str = "up") -> DataFrame:
    return nodes.join(coarse.withColumnRenamed("v", out), cluster, "left").withColumn(out, F.coalesce(out, F.lit(0.0)))


def ancestor(depth: int) -> Column:
    """Ancestor at a depth of heap node ``id`` of depth ``depth``; null above it."""
    return F.expr(f"CASE WHEN depth >= {depth} THEN CAST(shiftright(id + 1, depth - {depth}) - 1 AS BIGINT) END")


def subtree_restrict(nodes: DataFrame, value: str, depth: int) -> DataFrame:
    """(top, v): means of the subtrees at a depth; nodes above it take no part."""
    return nodes.withColumn("top", ancestor(depth)).where("top IS NOT NULL").groupBy("top").agg(F.avg(value).alias("v"))


def subtree_prolong(nodes: DataFrame, coarse: DataFrame, depth: int, out: str = "up") -> DataFrame:
    """Subtree value below the depth; a node above it gets the mean of its descendants at the depth."""
    low = nodes.withColumn("top", ancestor(depth)).join(coarse.withColumnRenamed("v", out), "top", "left")
    high = coarse.withColumn("up_by", F.explode(F.sequence(F.lit(1), F.lit(max(1, depth))))).withColumn("id", F.expr("CAST(shiftright(top + 1, up_by) - 1 AS BIGINT)"))
    high = high.where("id >= 0").groupBy("id").agg(F.avg("v").alias("_v"))
    return low.join(high, "id", "left").withColumn(out, F.coalesce(out, "_v", F.lit(0.0))).drop("_v", "top")


def gaussian_weights(spark: SparkSession, n: int, sigma: float, step: int = 2) -> DataFrame:
    """(fine, coarse, w) of a Gaussian blur with mirrored borders, cut at four sigma, then every ``step``-th sample."""
    radius = int(4 * sigma + 0.5)
    kernel = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    total = sum(kernel)
    rows: dict[tuple[int, int], float] = {}
    for c in range(-(-n // step)):
        for i, k in enumerate(kernel):
            x = (c * step + i - radius) % (2 * n)
            f = x if x < n else 2 * n - 1 - x
            rows[f, c] = rows.get((f, c), 0.0) + k / total
    return spark.createDataFrame([(f, c, w) for (f, c), w in sorted(rows.items())], "fine int, coarse int, w double")


def bilinear_weights(spark: SparkSession, fine: int, coarse: int) -> DataFrame:
    """(fine, coarse, w): output i reads at i * (coarse - 1) / (fine - 1)."""
    rows = []
    for i in range(fine):
        x = i * (coarse - 1) / (fine - 1) if fine > 1 else 0.0
        a = min(int(x), coarse - 1)
        rows.append((i, a, 1 - (x - a)))
        if x > a and a + 1 < coarse:
            rows.append((i, a + 1, x - a))
    return spark.createDataFrame(rows, "fine int, coarse int, w double")


def lanczos_weights(spark: SparkSession, n: int, factor: int = 2, a: int = 3) -> DataFrame:
    """(fine, coarse, w) of a windowed-sinc decimation, weights of each coarse sample adding to one, borders repeated."""
    sinc = lambda x: 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x)
    rows: dict[tuple[int, int], float] = {}
    for c in range(n // factor):
        mid = (c + 0.5) * factor - 0.5
        near = range(math.ceil(mid - a * factor), math.floor(mid + a * factor) + 1)
        ws = [(min(max(f, 0), n - 1), sinc((f - mid) / factor) * sinc((f - mid) / (a * factor))) for f in near]
        total = sum(w for _, w in ws)
        for f, w in ws:
            rows[f, c] = rows.get((f, c), 0.0) + w / total
    return spark.createDataFrame([(f, c, w) for (f, c), w in sorted(rows.items())], "fine int, coarse int, w double")


def separable(cells: DataFrame, weights: DataFrame, value: str, down: bool) -> DataFrame:
    """A separable linear map of a grid, rows then columns: (r, c, v). The weight table has a few entries per cell side and is broadcast."""
    src, dst = ("fine", "coarse") if down else ("coarse", "fine")
    w = F.broadcast(weights)
    one = cells.select("r", "c", F.col(value).alias("v")).join(w, F.col("r") == F.col(src)).groupBy(F.col(dst).alias("r"), "c").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    two = one.join(w, F.col("c") == F.col(src)).groupBy("r", F.col(dst).alias("c")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return two


def norm(x: Column) -> Column:
    return F.sqrt(F.sum(x * x))


def lf_fraction(df: DataFrame, by: list[str], delta: str = "delta", up: str = "up") -> DataFrame:
    """||Up(R(delta))|| / ||delta|| of each group, from rows that hold both."""
    return df.groupBy(*by).agg((norm(F.col(up)) / (norm(F.col(delta)) + 1e-12)).alias("d_parent"))


def parent_metrics(fine: DataFrame, coarse: DataFrame, by: list[str], alpha: float = 1.0) -> DataFrame:
    """Metrics of deltas in each group.

    ``fine``: by, delta, up (the delta restricted and prolonged); ``coarse``: by, rd (restricted delta), rc (restricted coarse value).
    """
    f = fine.groupBy(*by).agg(
        norm(F.col("delta")).alias("nd"), norm(F.col("up")).alias("nu"), norm(F.col("delta") - F.col("up")).alias("nh"),
        F.avg(F.abs("delta")).alias("md"), norm(F.col("coarse")).alias("nc"), F.avg(F.abs("coarse")).alias("mc"),
    )
    c = coarse.groupBy(*by).agg(norm(F.col("rd")).alias("nrd"), norm(F.col("rc") + F.col("rd")).alias("nrs"), F.corr(F.col("rc"), F.col("rc") + F.col("rd")).alias("rho"), F.sum(F.col("rc") * (F.col("rc") + F.col("rd"))).alias("dot"), norm(F.col("rc")).alias("nrc"))
    x = f.join(c, by)
    return x.select(
        *by,
        (F.col("nu") / (F.col("nd") + 1e-12)).alias("d_parent"),
        (F.col("nrd") / (alpha * F.col("nc") + 1e-4 * F.col("mc"))).alias("d_parent_baseline"),
        F.log1p(F.col("nrd") / (alpha * F.col("nc") + 1e-4 * F.col("mc"))).alias("d_parent_log"),
        (F.col("nrd") / F.col("nrs")).alias("d_parent_relative"),
        (F.col("nrd") / F.col("nd")).alias("d_parent_survival"),
        (F.col("nh") / (F.col("nd") + 1e-4 * F.col("md"))).alias("d_hf"),
        (1 - F.col("rho")).alias("d_correlation"),
        (1 - F.col("dot") / (F.col("nrc") * F.col("nrs"))).alias("d_cosine"),
        F.abs(F.col("nrs") ** 2 / F.col("nrc") ** 2 - 1).alias("d_energy_ratio"),
    )


def order_distance(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Wasserstein-1 distance of two samples of equal size over the range of the first: mean gap of equal ranks."""
    wa, wb = Window.partitionBy(*by).orderBy(a), Window.partitionBy(*by).orderBy(b)
    x = df.select(*by, F.col(a).alias("v"), F.row_number().over(wa).alias("k"))
    y = df.select(*by, F.col(b).alias("w"), F.row_number().over(wb).alias("k"))
    return x.join(y, [*by, "k"]).groupBy(*by).agg((F.avg(F.abs(F.col("v") - F.col("w"))) / (F.max("v") - F.min("v") + 1e-12)).alias("d_histogram"))


def quantile_gap(df: DataFrame, by: list[str], a: str, b: str, n: int = 20) -> DataFrame:
    """Largest gap of n + 1 evenly spaced quantiles over the range of the first."""
    p = F.array(*[F.lit(i / n) for i in range(n + 1)])
    g = df.groupBy(*by).agg(F.percentile(a, p).alias("p"), F.percentile(b, p).alias("q"), (F.max(a) - F.min(a) + 1e-12).alias("span"))
    gap = F.array_max(F.zip_with("p", "q", lambda x, y: F.abs(x - y)))
    return g.select(*by, (gap / F.col("span")).alias("d_quantile"))


def spectral(df: DataFrame, by: list[str], side: int) -> DataFrame:
    """Low-frequency share of the power of refined and coarse grids: (by, lf_coarse, lf_refined, d_spectral). ``df``: by, r, c, coarse, delta."""
    from .spectra import low_share

    a = low_share(df, by, "coarse", side).withColumnRenamed("lf", "lf_coarse")
    b = low_share(df.withColumn("_v", F.col("coarse") + F.col("delta")), by, "_v", side).withColumnRenamed("lf", "lf_refined")
    return a.join(b, by).withColumn("d_spectral", F.abs(F.col("lf_refined") - F.col("lf_coarse")))


def local_variance(df: DataFrame, by: list[str], block: list[str], delta: str) -> DataFrame:
    """(by, d_local_var): mean variance within a block over the variance of all."""
    b = df.groupBy(*by, *block).agg(F.avg(F.col(delta) ** 2).alias("q"), F.avg(delta).alias("m"), F.count("*").alias("n"), F.sum(delta).alias("s"), F.sum(F.col(delta) ** 2).alias("s2"))
    var = F.sum("s2") / F.sum("n") - (F.sum("s") / F.sum("n")) ** 2
    return b.groupBy(*by).agg((F.avg(F.col("q") - F.col("m") ** 2) / (var + 1e-12)).alias("d_local_var"))


def abs_vs_signed(df: DataFrame, by: list[str], block: list[str], delta: str) -> DataFrame:
    """(by, d_abs): norm of the restricted |delta| over that of the restricted delta; 1 where the latter is 0."""
    b = df.groupBy(*by, *block).agg(F.avg(F.abs(delta)).alias("a"), F.avg(delta).alias("m"))
    return b.groupBy(*by).agg(F.when(norm(F.col("m")) < 1e-12, 1.0).otherwise(norm(F.col("a")) / norm(F.col("m"))).alias("d_abs"))


def zscored(df: DataFrame, column: str, by: list[str], out: str = "z") -> DataFrame:
    w = Window.partitionBy(*by)
    sd = F.stddev_pop(column).over(w)
    return df.withColumn(out, (F.col(column) - F.avg(column).over(w)) / F.when(sd < 1e-12, 1.0).otherwise(sd))


def rank_normalised(df: DataFrame, column: str, key: str, by: list[str], out: str = "rank01") -> DataFrame:
    """Place in the order over n - 1, ties by key."""
    w = Window.partitionBy(*by)
    return df.withColumn(out, (F.row_number().over(w.orderBy(column, key)) - 1) / F.greatest(F.lit(1), F.count("*").over(w) - 1))


def combined(p: Column, s: Column, how: str) -> Column:
    return {"max": F.greatest(p, s), "weighted": 0.6 * p + 0.4 * s, "two_stage": p + 0.3 * s}[how]


def gradient_shift(cells: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, d_gradient): norm of the difference of forward differences over the norm of the first's. Columns r, c."""
    row, col = Window.partitionBy(*by, "r").orderBy("c"), Window.partitionBy(*by, "c").orderBy("r")
    step = lambda x, w: F.coalesce(F.lead(x).over(w) - F.col(x), F.lit(0.0))
    g = cells.select(*by, *[step(x, w).alias(f"{k}{j}") for k, x in (("a", a), ("b", b)) for j, w in enumerate((row, col))])
    diff = F.sqrt(F.sum((F.col("a0") - F.col("b0")) ** 2 + (F.col("a1") - F.col("b1")) ** 2))
    return g.groupBy(*by).agg((diff / (F.sqrt(F.sum(F.col("a0") ** 2 + F.col("a1") ** 2)) + 1e-12)).alias("d_gradient"))


def sign_cancellation(df: DataFrame, by: list[str], delta: str) -> DataFrame:
    """(by, d_sign): |mean delta| over mean |delta|: 1 for one-sided changes, 0 for balanced ones."""
    return df.groupBy(*by).agg((F.abs(F.avg(delta)) / (F.avg(F.abs(delta)) + 1e-12)).alias("d_sign"))


def ssim(cells: DataFrame, a: str, b: str, side: int, sigma: float = 1.5, span: float = 1.0) -> DataFrame:
    """One row: 1 - mean structural similarity of two grids with Gaussian windows."""
    w = gaussian_weights(cells.sparkSession, side, sigma, 1)
    x = cells.select("r", "c", F.col(a).alias("a"), F.col(b).alias("b"))
    parts = {"ma": "a", "mb": "b", "qa": "a * a", "qb": "b * b", "ab": "a * b"}
    one = x.join(F.broadcast(w), F.col("r") == F.col("fine")).groupBy(F.col("coarse").alias("r"), "c").agg(*[F.sum(F.expr(e) * F.col("w")).alias(k) for k, e in parts.items()])
    two = one.join(F.broadcast(w), F.col("c") == F.col("fine")).groupBy("r", F.col("coarse").alias("c")).agg(*[F.sum(F.col(k) * F.col("w")).alias(k) for k in parts])
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    m = F.col("ma") * F.col("mb")
    s = (2 * m + c1) * (2 * (F.col("ab") - m) + c2) / ((F.col("ma") ** 2 + F.col("mb") ** 2 + c1) * (F.col("qa") - F.col("ma") ** 2 + F.col("qb") - F.col("mb") ** 2 + c2))
    return two.agg((1 - F.avg(s)).alias("d_ssim"))


def projected(cells: DataFrame, keys: list[str], channel: str, value: str, k: int, seed: int = 0) -> DataFrame:
    """(keys, p, v): k random unit-scale projections of vector cells; weights follow from the channel and the seed."""
    from ..sources.deltas import digest_normal

    p = cells.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return p.groupBy(*keys, "p").agg(F.sum(F.col(value) * digest_normal(seed, "p", channel)).alias("v"))
