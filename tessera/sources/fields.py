"""Invented fields, masks and trees, deterministic in their seed; hash noise stands in for random numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def uniform(seed: int, *keys) -> Column:
    """A number in (0, 1) that depends on the keys and the seed only."""
    return (F.shiftrightunsigned(F.xxhash64(*keys, F.lit(seed)), 11) + 0.5) / float(1 << 53)


def normal(seed: int, *keys) -> Column:
    return F.sqrt(-2 * F.log(uniform(seed, *keys))) * F.cos(2 * F.lit(3.141592653589793) * uniform(seed + 7919, *keys))


def cells(spark: SparkSession, side: int) -> DataFrame:
    return spark.range(side * side).select((F.col("id") / side).cast("int").alias("r"), (F.col("id") % side).cast("int").alias("c"))


def blob_field(spark: SparkSession, side: int = 64, seed: int = 0, blobs: int = 5, shift: float = 0.0) -> DataFrame:
    """Some Gaussian hills and a step at the middle; ``shift`` moves the hills, as a field that drifts does."""
    import random

    rng = random.Random(seed)
    x, y = F.col("c") / (side - 1), F.col("r") / (side - 1)
    v = F.when(x > 0.5, 0.5).otherwise(0.0)
    for _ in range(blobs):
        cx, cy, s, a = rng.random() + shift, rng.random(), rng.uniform(0.05, 0.2), rng.uniform(0.5, 1.5)
        v = v + a * F.exp(-((x - cx) ** 2 + (y - cy) ** 2) / (2 * s * s))
    return cells(spark, side).withColumn("gt", v)


def wave_field(spark: SparkSession, side: int = 32, channels: int = 16, seed: int = 0, noise: float = 0.02) -> DataFrame:
    """Products of sines and cosines by channel with a little noise: r, c, d, gt."""
    x, y, d = F.col("c") / (side - 1), F.col("r") / (side - 1), F.col("d")
    v = F.sin((d % 4 + 1) * 3.141592653589793 * x) * F.cos((F.floor(d / 4) + 1) * 3.141592653589793 * y)
    one = cells(spark, side).withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(channels - 1))))
    return one.withColumn("gt", v + noise * normal(seed, "r", "c", "d"))


def regions(spark: SparkSession, side: int = 64, seed: int = 0) -> DataFrame:
    """A field with a smooth, a boundary and a texture part and the label of each cell."""
    x = F.col("c") / (side - 1)
    label = F.when(x < 1 / 3, "smooth").when(x < 2 / 3, "boundary").otherwise("texture")
    v = F.when(label == "smooth", x).when(label == "boundary", F.when(F.col("r") > side / 2, 1.0).otherwise(0.0)).otherwise(0.5 + 0.3 * normal(seed, "r", "c"))
    return cells(spark, side).select("r", "c", label.alias("label"), v.alias("gt"))


def noisy(df: DataFrame, sigma: float, seed: int, column: str = "gt") -> DataFrame:
    return df.withColumn(column, F.col(column) + sigma * normal(seed, "r", "c"))


def varying_noise(df: DataFrame, sigma: float, seed: int, column: str = "gt") -> DataFrame:
    """Noise that grows with the brightness."""
    return df.withColumn(column, F.col(column) * (1 + sigma * normal(seed, "r", "c")))


def block_quantised(df: DataFrame, q: float, column: str = "gt") -> DataFrame:
    """Means of 2 x 2 blocks in steps of q."""
    w = Window.partitionBy(F.floor(F.col("r") / 2), F.floor(F.col("c") / 2))
    return df.withColumn(column, F.bround(F.avg(column).over(w) / q, 0) * q)


def aliased(df: DataFrame, column: str = "gt") -> DataFrame:
    """Every second sample, repeated."""
    w = Window.partitionBy(F.floor(F.col("r") / 2), F.floor(F.col("c") / 2))
    return df.withColumn(column, F.min_by(column, F.struct("r", "c")).over(w))


def heterogeneous(spark: SparkSession, side: int = 64, seed: int = 0) -> DataFrame:
    """Calm, wavy and rough quarters."""
    f = blob_field(spark, side, seed)
    q = F.when(F.col("r") < side / 2, F.when(F.col("c") < side / 2, 0.0).otherwise(0.3)).otherwise(F.when(F.col("c") < side / 2, 0.6).otherwise(1.0))
    return f.withColumn("gt", F.col("gt") * 0.2 + q * F.sin(F.col("r") * 0.9) * F.cos(F.col("c") * 1.1) + 0.2 * q * normal(seed + 1, "r", "c"))


def active_mask(spark: SparkSession, side: int, fraction: float, pattern: str = "random", seed: int = 0) -> DataFrame:
    """r, c, active: random cells (exactly the fraction), a cluster about a seeded centre, or a checkerboard cut to the fraction."""
    k = max(1, int(side * side * fraction))
    base = cells(spark, side)
    if pattern == "random":
        score = uniform(seed, "r", "c")
    elif pattern == "clustered":
        import random

        rng = random.Random(seed)
        score = (F.col("r") - rng.randrange(side)) ** 2 + (F.col("c") - rng.randrange(side)) ** 2
    elif pattern == "checkerboard":
        score = (F.col("r") + F.col("c")) % 2 + 0.0
    else:
        raise ValueError(pattern)
    rank = F.row_number().over(Window.orderBy(score, "r", "c"))
    return base.withColumn("active", rank <= k)


def random_points(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    return spark.range(n).select("id", uniform(seed, "id").alias("x"), uniform(seed + 1, "id").alias("y"))


def swiss_roll(spark: SparkSession, n: int, noise: float = 0.0, seed: int = 0) -> DataFrame:
    t = 1.5 * 3.141592653589793 * (1 + 2 * uniform(seed, "id"))
    d = spark.range(n).select("id", t.alias("t"), (21 * uniform(seed + 1, "id")).alias("h"))
    return d.select("id", (F.col("t") * F.cos("t") + noise * normal(seed + 2, "id")).alias("x"), "h", (F.col("t") * F.sin("t") + noise * normal(seed + 3, "id")).alias("y"))


def complete_tree(spark: SparkSession, depth: int, branching: int = 2) -> DataFrame:
    """(child, parent) of a complete tree in heap order; the root's parent is null."""
    n = (branching**depth - 1) // (branching - 1) if branching > 1 else depth
    return spark.range(n).select(F.col("id").alias("child"), F.when(F.col("id") > 0, F.floor((F.col("id") - 1) / branching)).cast("long").alias("parent"))


def chained_tree(spark: SparkSession, depth: int, chain: int, branching: int = 2) -> DataFrame:
    """A complete tree each of whose edges becomes a run of ``chain`` further nodes of degree two."""
    t = complete_tree(spark, depth, branching)
    inner = t.where("parent IS NOT NULL").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(chain))))
    node = lambda i: F.col("child") * (chain + 1) + i
    up = F.when(F.col("i") == chain, F.col("parent") * (chain + 1)).otherwise(node(F.col("i") + 1))
    return inner.select(node(F.col("i")).alias("child"), up.alias("parent")).unionAll(t.where("parent IS NULL").select((F.col("child") * (chain + 1)).alias("child"), "parent"))


def signature_stream(spark: SparkSession, nodes: int, steps: int, stable: float, seed: int = 0, event_step: int | None = None) -> DataFrame:
    """(step, node, sig): stable nodes keep their signature, others draw a new one each step; at the event every node does once."""
    base = F.floor(uniform(seed, "node") * 4096)
    fresh = F.floor(uniform(seed + 1, "node", "step") * 4096)
    free = uniform(seed + 2, "node") >= stable
    if event_step is not None:
        free = free | (F.col("step") == event_step)
    g = spark.range(nodes).select(F.col("id").alias("node")).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    return g.select("step", "node", F.when(free, fresh).otherwise(base).cast("int").alias("sig"))


def random_edges(spark: SparkSession, n: int, p: float, seed: int = 0) -> DataFrame:
    """Each pair a < b with probability p: a geometric walk over the partners of a, so only edges are made."""
    skip = F.greatest(F.lit(1), F.ceil(F.log(uniform(seed, "a", "k")) / F.log(F.lit(1 - p))).cast("long"))
    most = int(n * p + 8 * (n * p) ** 0.5 + 16)
    g = spark.range(n).select(F.col("id").alias("a")).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(most)))).withColumn("s", skip)
    step = Window.partitionBy("a").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return g.select("a", (F.col("a") + F.sum("s").over(step)).alias("b")).where(F.col("b") < n)
