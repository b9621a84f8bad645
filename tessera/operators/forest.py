"""Minimum spanning forests, and clusters by single linkage from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored


def _roots(up: DataFrame) -> DataFrame:
    """(id, up): the root of each node, by pointer doubling; a root points to itself."""
    while True:
        higher = up.select(F.col("id").alias("up"), F.col("up").alias("top"))
        new = stored(up.join(higher, "up").select("id", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
        up = new.select("id", "up")
        if new.where("moved").isEmpty():
            return up


def _grown(edges: DataFrame, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The forest's edges, and (id, part) of the nodes if given.

    Each round every part takes its least edge, parts that these join become one, and of the
    edges between two parts the least is kept, so parts at least halve and rounds grow with the
    logarithm of the nodes.
    """
    label = None if nodes is None else nodes.select("id", F.col("id").alias("part"))
    key = F.struct("w", "src", "dst")
    e = edges.where("src <> dst AND w IS NOT NULL").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.col("w").cast("double").alias("w"))
    e = stored(e.groupBy("src", "dst").agg(F.min("w").alias("w")).select(F.col("src").alias("a"), F.col("dst").alias("b"), key.alias("k")))
    out = edges.sparkSession.createDataFrame([], "src long, dst long, w double")
    while not e.isEmpty():
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "k"))
        best = stored(both.groupBy("a").agg(F.min(F.struct("k", "b")).alias("m")).select("a", "m.b", "m.k"))
        out = out.unionByName(best.select("k.src", "k.dst", "k.w").distinct())
        # two parts that take the same edge: the smaller one is the root
        back = best.select(F.col("a").alias("b"), F.col("k").alias("k2"))
        up = best.join(back, "b").select(F.col("a").alias("id"), F.when((F.col("k") == F.col("k2")) & (F.col("a") < F.col("b")), F.col("a")).otherwise(F.col("b")).alias("up"))
        up = _roots(stored(up))
        if label is not None:
            to = up.select(F.col("id").alias("part"), "up")
            label = stored(label.join(to, "part", "left").select("id", F.coalesce("up", "part").alias("part")))
        x = e.join(up.select(F.col("id").alias("a"), F.col("up").alias("p")), "a").join(up.select(F.col("id").alias("b"), F.col("up").alias("q")), "b").where("p <> q")
        e = stored(x.groupBy(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.min("k").alias("k")))
    return out, label


def minimum_forest(edges: DataFrame) -> DataFrame:
    """(src, dst, w) of the minimum spanning forest, src < dst; equal weights go by src, then dst.

    Loops are left out; of repeated edges the least counts; a null weight is no edge.
    """
    return _grown(edges)[0]


def single_linkage(nodes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(id, cluster): the forest without its heaviest edges, so that k trees are left, or all its trees if there are more.

    A cluster's name is its smallest id. Of equal weights the edge with the larger src, then dst goes first.
    """
    n = nodes.select("id").distinct()
    tree = stored(minimum_forest(edges))
    drop = max(0, k - (n.count() - tree.count()))
    cut = tree.orderBy(F.desc("w"), F.desc("src"), F.desc("dst")).limit(drop)
    _, label = _grown(tree.join(cut, ["src", "dst"], "left_anti"), n)
    return label.join(label.groupBy("part").agg(F.min("id").alias("cluster")), "part").select("id", "cluster")


def linkage_heights(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(merge, height, clusters): weights at which clusters join, in rising order, and how many are left after each."""
    from .select import ranked

    n, tree = nodes.select("id").distinct().count(), stored(minimum_forest(edges))
    r = ranked(tree.select((-F.col("w")).alias("s"), F.struct("src", "dst").alias("key"), "w"), "s", "key")
    return r.select(F.col("rank").cast("int").alias("merge"), F.col("w").alias("height"), (F.lit(n) - F.col("rank")).cast("long").alias("clusters"))
