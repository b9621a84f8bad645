"""Pairs drawn from all pairs of units, their distances in a hierarchy and between features, and how the two agree."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored
from .select import prefix_budget, ranked


def _stride(m: int) -> int:
    """A step near the golden section of m that has no factor in common with it, so that its multiples meet each rest once."""
    a = max(1, m * 618033988 // 10**9)
    while math.gcd(a, m) != 1:
        a += 1
    return a


def pair_of(k: Column) -> tuple[Column, Column]:
    """(i, j), i < j: the pair with number k where pairs are counted by j, then i. Exact up to 2**31 units."""
    j = F.floor(0.5 + F.sqrt(0.25 + 2.0 * k)).cast("long")  # may be one off, as a double has 53 bits
    below = lambda x: F.shiftright(x * (x - 1), 1)
    j = F.when(below(j) > k, j - 1).when(below(j + 1) <= k, j + 1).otherwise(j)
    return k - below(j), j


def sampled_pairs(units: DataFrame, k: int, seed: int = 999) -> DataFrame:
    """(pair, u, v), u < v: k different pairs of ``units`` (unit), spread evenly over all pairs, or all pairs if there are fewer.

    Numbers of pairs are drawn and turned into units, so no pair is made that is not drawn. Null
    units are left out, repeated ones count once; below two units there are no pairs.
    """
    one = units.select("unit").where("unit IS NOT NULL").distinct().withColumn("_s", F.lit(0))
    at = ranked(one, "_s", "unit").select((F.col("rank") - 1).cast("long").alias("at"), "unit")
    n = at.count()
    m = n * (n - 1) // 2
    wide = lambda c: c.cast("decimal(19,0)")
    number = ((wide(F.col("id")) * wide(F.lit(_stride(max(m, 1)))) + seed) % wide(F.lit(max(m, 1)))).cast("long")
    i, j = pair_of(F.col("k"))
    drawn = units.sparkSession.range(min(k, m)).select(F.col("id").alias("pair"), number.alias("k")).select("pair", i.alias("i"), j.alias("j"))
    end = lambda a, name: at.select(F.col("at").alias(a), F.col("unit").alias(name))
    return drawn.join(end("i", "u"), "i").join(end("j", "v"), "j").select("pair", "u", "v")


def lifted(tree: DataFrame) -> list[DataFrame]:
    """Tables (node, up, steps) of ``tree`` (child, parent): the ancestor 2**k steps above, or the root where it is nearer, with the steps to it.

    In the last table all nodes are at their root, so its steps are depths. A parent that is no
    child is a root. A cycle is an error.
    """
    own = F.coalesce("parent", "child")
    t = tree.select(F.col("child").alias("node"), own.alias("up"), (own != F.col("child")).cast("long").alias("steps"))
    missing = t.select(F.col("up").alias("node")).distinct().join(t.select("node"), "node", "left_anti")
    at = stored(t.unionByName(missing.select("node", F.col("node").alias("up"), F.lit(0).cast("long").alias("steps"))))
    out, n = [at], at.count()
    while True:
        above = at.select(F.col("node").alias("up"), F.col("up").alias("top"), F.col("steps").alias("more"))
        x = at.join(above, "up").select("node", F.col("top").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("top") != F.col("up")).alias("moved"))
        x = stored(x)
        s = x.agg(F.max("moved").alias("moved"), F.max("steps").alias("most")).first()
        if (s["most"] or 0) >= n > 0:  # a path without repeats has fewer steps than nodes
            raise ValueError("the tree has a cycle")
        if not s["moved"]:
            return out
        at = x.drop("moved")
        out.append(at)


def tree_distance(pairs: DataFrame, tree: DataFrame) -> DataFrame:
    """``pairs`` (pair, u, v) with ``lca`` and ``distance``: steps between u and v through their lowest common ancestor.

    Pairs climb by powers of two, so a tree of depth d takes about 3 log d joins of the drawn pairs.
    Nodes of different trees have no common ancestor; their distance is that through a further
    node above all roots. Pairs with a unit that the tree lacks are left out.
    """
    levels = lifted(tree)
    end = lambda c, up, steps: levels[-1].select(F.col("node").alias(c), F.col("up").alias(up), F.col("steps").alias(steps))
    x = pairs.join(end("u", "ru", "du"), "u").join(end("v", "rv", "dv"), "v")
    deep = F.col("du") >= F.col("dv")
    x = x.withColumns({"a": F.when(deep, F.col("u")).otherwise(F.col("v")), "b": F.when(deep, F.col("v")).otherwise(F.col("u")), "gap": F.abs(F.col("du") - F.col("dv"))})
    x = stored(x)
    up = lambda t, c: t.select(F.col("node").alias(c), F.col("up").alias(f"up_{c}"))
    for k, t in enumerate(levels):
        bit = F.shiftright("gap", k).bitwiseAND(F.lit(1)) == 1
        x = stored(x.join(up(t, "a"), "a").withColumn("a", F.when(bit, F.col("up_a")).otherwise(F.col("a"))).drop("up_a"))
    for t in reversed(levels):
        apart = F.col("up_a") != F.col("up_b")
        x = x.join(up(t, "a"), "a").join(up(t, "b"), "b").withColumn("jump", apart)
        x = stored(x.withColumns({"a": F.when(F.col("jump"), F.col("up_a")).otherwise(F.col("a")), "b": F.when(F.col("jump"), F.col("up_b")).otherwise(F.col("b"))}).drop("up_a", "up_b", "jump"))
    one = F.col("ru") == F.col("rv")
    x = x.join(up(levels[0], "a"), "a").withColumn("lca", F.when(one, F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("up_a"))))
    depth = end("lca", "_", "dl").drop("_")
    x = x.join(depth, "lca", "left").withColumn("distance", F.col("du") + F.col("dv") + F.when(one, -2 * F.col("dl")).otherwise(2))
    return x.select(*pairs.columns, "lca", "distance")


def heap_distance(pairs: DataFrame) -> DataFrame:
    """``pairs`` (u, v) of a binary heap with ``lca`` and ``distance`` as in ``tree_distance``, from the numbers of the nodes alone, so nothing is joined."""
    a, b = F.col("u") + 1, F.col("v") + 1
    da, db = F.length(F.bin(a)), F.length(F.bin(b))
    shift = lambda x, n: F.call_function("shiftright", x, n)
    x, y = shift(a, F.greatest(F.lit(0), da - db)), shift(b, F.greatest(F.lit(0), db - da))
    up = F.when(x == y, 0).otherwise(F.length(F.bin(x.bitwiseXOR(y))))
    return pairs.withColumns({"lca": shift(x, up) - 1, "distance": (F.abs(da - db) + 2 * up).cast("long")})


def quadtree_distance(a: Column, b: Column) -> Column:
    """Levels up to the common square of two Z-order keys: pairs of bits up to the highest one that differs."""
    x = a.bitwiseXOR(b)
    return F.when(x == 0, 0).otherwise(F.ceil(F.length(F.bin(x)) / 2)).cast("long")


def feature_distance(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """``pairs`` with ``features``: Euclidean distance of the values of u and v at the positions that both have.

    ``values``: unit, pos, value. Rows are joined by unit and position, so units may be of any size; pairs without a common position are left out.
    """
    side = lambda c: values.select(F.col("unit").alias(c), "pos", F.col("value").alias(f"_{c}"))
    x = pairs.join(side("u"), "u").join(side("v"), ["v", "pos"])
    return x.groupBy(*pairs.columns).agg(F.sqrt(F.sum((F.col("_u") - F.col("_v")) ** 2)).alias("features"))


def _tied_ranks(df: DataFrame, column: str, out: str) -> DataFrame:
    """``out``: average rank of the column's values, made on its distinct values."""
    v = df.groupBy(column).agg(F.count("*").alias("_n")).withColumn("_down", -F.col(column))
    v = prefix_budget(v, "_n", "_down", column, math.inf)
    return df.join(v.select(column, (F.col("spent") + (F.col("_n") + 1) / 2).alias(out)), column)


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation of n pairs by Student's distribution with n - 2 degrees of freedom, as its finite series of about n / 2 terms."""
    df, c2, s = n - 2, 1 - r * r, F.abs(r)
    even = df % 2 == 0
    last = F.when(even, F.shiftright(df, 1) - 1).otherwise(F.shiftright(df - 1, 1) - 1)
    factor = lambda j: F.when(even, (2 * j - 1) / (2 * j)).otherwise(2 * j / (2 * j + 1))
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("sum"))

    def add(acc: Column, j: Column) -> Column:
        t = acc["t"] * factor(j) * c2
        return F.struct(t.alias("t"), (acc["sum"] + t).alias("sum"))

    steps = F.when(last >= 1, F.sequence(F.lit(1).cast("long"), last)).otherwise(F.array().cast("array<bigint>"))
    series = F.when(last >= 0, F.aggregate(steps, start, add)["sum"]).otherwise(0.0)
    inside = F.when(even, s * series).otherwise((F.asin(s) + s * F.sqrt(c2) * series) * (2 / math.pi))
    return F.when(s >= 1, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - inside))


def agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, mean_a, mean_b, pearson, pearson_p, spearman, spearman_p of two columns of the pairs.

    Rows with a null in one of them don't count. With under three rows or a constant column both correlations are 0 with a p of 1.
    """
    x = stored(pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")))
    x = _tied_ranks(_tied_ranks(x, "a", "ra"), "b", "rb")
    flat = (F.count("*") < 3) | (F.min("a") == F.max("a")) | (F.min("b") == F.max("b"))
    corr = lambda p, q: F.when(~flat, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(F.covar_pop(p, q), F.stddev_pop(p) * F.stddev_pop(q)))))
    r = x.agg(F.count("*").alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), corr("a", "b").alias("pearson"), corr("ra", "rb").alias("spearman"))
    p = lambda c: F.when(F.col(c).isNull(), 1.0).otherwise(correlation_p(F.col(c), F.col("n"))).alias(f"{c}_p")
    or0 = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return r.select("n", "mean_a", "mean_b", or0("pearson"), p("pearson"), or0("spearman"), p("spearman"))


def basin_agreement(pairs: DataFrame, basin: DataFrame) -> DataFrame:
    """One row of ``pairs`` (pair, u, v, features) against ``basin`` (unit, basin): do units of one basin have similar features?

    n, same (share of pairs within a basin), biserial, biserial_p, spearman, spearman_p, within, across and
    separation (mean similarity within, across, and their difference; 0 without such pairs). Similarity is
    1 - distance / largest distance of all pairs.
    """
    side = lambda c: basin.select(F.col("unit").alias(c), F.col("basin").alias(f"_{c}"))
    x = stored(pairs.join(side("u"), "u").join(side("v"), "v").select((F.col("_u") == F.col("_v")).cast("double").alias("same"), "features"))
    most = x.agg(F.max("features").alias("most"))
    x = stored(x.join(F.broadcast(most)).select("same", (1 - F.col("features") / F.when(F.col("most") > 1e-12, F.col("most")).otherwise(1.0)).alias("similar")))  # one row
    mean = lambda on: F.coalesce(F.avg(F.when(F.col("same") == on, F.col("similar"))), F.lit(0.0))
    s = x.agg(mean(1.0).alias("within"), mean(0.0).alias("across"))
    r = agreement(x, "same", "similar").join(F.broadcast(s))  # one row each
    return r.select("n", F.coalesce("mean_a", F.lit(0.0)).alias("same"), F.col("pearson").alias("biserial"), F.col("pearson_p").alias("biserial_p"), "spearman", "spearman_p", "within", "across", (F.col("within") - F.col("across")).alias("separation"))
