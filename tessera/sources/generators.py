"""Generators of graphs and activations, and loaders of images and edge lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .fields import uniform


def preferential_attachment(spark: SparkSession, n: int, m: int, seed: int = 0) -> DataFrame:
    """Undirected edges (src < dst) of a preferential-attachment graph.

    Edge i of node t goes to the end found at a random earlier place of the list of all
    ends; places that point to other places are resolved by doubling pointers, so the
    graph takes a logarithmic number of joins instead of a sequential pass.
    """
    ends = spark.range(2 * n * m).select(F.col("id").alias("at"))
    source = F.floor(F.col("at") / (2 * m)).cast("long")
    pick = F.floor(uniform(seed, "at") * F.col("at")).cast("long")
    p = ends.select("at", F.when(F.col("at") % 2 == 0, F.col("at")).otherwise(pick).alias("to")).checkpoint()
    while True:
        q = p.join(p.select(F.col("at").alias("to"), F.col("to").alias("next")), "to").select("at", F.col("next").alias("to")).checkpoint()
        if q.where(F.col("to") % 2 == 1).isEmpty():
            break
        p = q
    node = F.floor(F.col("to") / (2 * m)).cast("long")
    e = q.where(F.col("at") % 2 == 1).select(source.alias("a"), node.alias("b")).where("a <> b")
    return e.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


def clustered_hubs(spark: SparkSession, n: int, clusters: int, m: int, bridges: int, seed: int = 0) -> DataFrame:
    """Preferential attachment inside each cluster of ids and some random edges between clusters."""
    size = n // clusters
    inner = preferential_attachment(spark, size, m, seed).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(clusters - 1))))
    inner = inner.select((F.col("src") + F.col("k") * size).alias("src"), (F.col("dst") + F.col("k") * size).alias("dst"))
    a, b = (F.floor(uniform(seed + s, "id") * (size * clusters)).cast("long") for s in (1, 2))
    far = spark.range(bridges).select(a.alias("a"), b.alias("b")).where("a <> b")
    return inner.unionAll(far.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))).distinct()


def rewired(edges: DataFrame, n: int, share: float, seed: int = 0) -> DataFrame:
    """Each edge keeps its source and, with a probability, gets a random other end."""
    to = F.floor(uniform(seed, "src", "dst") * n).cast("long")
    x = edges.select("src", F.when(uniform(seed + 1, "src", "dst") < share, to).otherwise(F.col("dst")).alias("dst")).where("src <> dst")
    return x.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def tree_activation(spark: SparkSession, n: int, k: int, pattern: str, seed: int = 0) -> DataFrame:
    """(id, active) of a level of n nodes with k active ones: random, a block of neighbours, or a frontier of every (n // k)-th."""
    base = spark.range(n)
    if pattern == "random":
        rank = F.row_number().over(Window.orderBy(uniform(seed, "id"), "id"))
        return base.withColumn("active", rank <= k)
    if pattern == "block":
        start = seed % max(1, n - k + 1)
        return base.withColumn("active", (F.col("id") >= start) & (F.col("id") < start + k))
    if pattern == "frontier":
        step = max(1, n // k)
        return base.withColumn("active", (F.col("id") % step == 0) & (F.col("id") < step * k))
    raise ValueError(pattern)


def gray_images(spark: SparkSession, path: str) -> DataFrame:
    """(origin, r, c, gt) of image files: brightness from 0 to 1 by the usual weights of red, green and blue."""
    i = spark.read.format("image").load(path).select("image.*")
    at = lambda k: F.expr(f"CAST(conv(hex(substring(data, {k}, 1)), 16, 10) AS DOUBLE)")
    p = i.select("origin", "width", "nChannels", "data", F.explode(F.expr("sequence(0, width * height - 1)")).alias("p"))
    blue, green, red = at("p * nChannels + 1"), at("p * nChannels + IF(nChannels > 2, 2, 1)"), at("p * nChannels + IF(nChannels > 2, 3, 1)")
    v = (0.299 * red + 0.587 * green + 0.114 * blue) / 255
    return p.select("origin", F.floor(F.col("p") / F.col("width")).cast("int").alias("r"), (F.col("p") % F.col("width")).cast("int").alias("c"), v.alias("gt"))


def edge_list(spark: SparkSession, path: str) -> DataFrame:
    """Undirected edges of a text file with two ids a line; other columns and comment lines are ignored."""
    t = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(?:[#%].*)?$"))
    p = F.split(F.trim("value"), r"[\s,;]+")
    e = t.select(p[0].cast("long").alias("a"), p[1].cast("long").alias("b")).where("a <> b")
    return e.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
