"""Communities by modularity: merges of blocks, then moves of nodes, then connected parts.

Modularity times (2m)**2 is an integer, 2m * (twice the inner weight) - sum of squared
volumes, so every gain is compared exactly and ties go to smaller ids: the result does
not depend on partitions. Each round is a few joins on edge tables, written to the
shared folder; the driver sees one number a round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored
from .graphs import components


def _times(a: Column | str, b: Column | str) -> Column:
    """Product without overflow, for factors below 10**18."""
    wide = lambda x: (F.col(x) if isinstance(x, str) else x).cast("decimal(18,0)")
    return wide(a) * wide(b)


def _weighted(edges: DataFrame) -> DataFrame:
    w = F.col("w") if "w" in edges.columns else F.lit(1).cast("long")
    return edges.where("src <> dst").groupBy(F.least("src", "dst").alias("p"), F.greatest("src", "dst").alias("q")).agg(F.sum(w).alias("w"))


def merged_blocks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, block): neighbouring blocks merge while that raises modularity.

    Conflicts: in a round two blocks merge when their edge is the best one of both, by
    gain, then ids. Merges of a round share no block, so their gains add up. Blocks are
    contracted after each round: edges between them carry weights.
    """
    e = stored(_weighted(edges))
    ends = e.select(F.explode(F.array("p", "q")).alias("block"), "w")
    vol = stored(ends.groupBy("block").agg(F.sum("w").alias("v")))
    both = F.lit(vol.agg(F.sum("v")).first()[0] or 0).cast("long")
    label = nodes.select("id", F.col("id").alias("block"))
    while True:
        v = lambda c, n: vol.select(F.col("block").alias(c), F.col("v").alias(n))
        gain = e.join(v("p", "vp"), "p").join(v("q", "vq"), "q").select("p", "q", (_times(both, "w") - _times("vp", "vq")).alias("gain")).where("gain > 0")
        best = gain.select(F.explode(F.array("p", "q")).alias("block"), F.struct("gain", (-F.col("p")).alias("p"), (-F.col("q")).alias("q")).alias("x"))
        best = best.groupBy("block").agg(F.max("x").alias("x")).groupBy((-F.col("x.p")).alias("to"), (-F.col("x.q")).alias("block")).agg(F.count("*").alias("n"))
        into = stored(best.where("n = 2").select("block", "to"))
        if into.isEmpty():
            return label
        to = lambda df, c: df.join(into.select(F.col("block").alias(c), F.col("to").alias("_to")), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
        e = stored(to(to(e, "p"), "q").where("p <> q").groupBy(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).agg(F.sum("w").alias("w")))
        vol = stored(to(vol, "block").groupBy("block").agg(F.sum("v").alias("v")))
        label = stored(to(label, "block"))


def _score(both: int, e: DataFrame, label: DataFrame, degree: DataFrame) -> int:
    """Modularity times (2m)**2. ``e``: id, dst, w both ways."""
    inner = e.join(label, "id").join(label.select(F.col("id").alias("dst"), F.col("block").alias("b")), "dst").where("block = b").agg(F.sum("w")).first()[0] or 0
    vol = degree.join(label, "id").groupBy("block").agg(F.sum("k").alias("v"))
    return int(both) * int(inner) - int(vol.agg(F.sum(_times("v", "v"))).first()[0] or 0)


def moved_nodes(nodes: DataFrame, edges: DataFrame, label: DataFrame) -> DataFrame:
    """(id, block): nodes move to the neighbouring block with the highest gain while that raises modularity.

    Conflicts: of two neighbours that want to move, only the one with the higher gain
    does, ties by id. Moves of a round still share blocks, so the whole round is taken
    only if modularity rises, and the first round that does not raise it is the end.
    """
    w = _weighted(edges)
    e = stored(w.select(F.col("p").alias("id"), F.col("q").alias("dst"), "w").unionAll(w.select(F.col("q").alias("id"), F.col("p").alias("dst"), "w")))
    degree = stored(e.groupBy("id").agg(F.sum("w").alias("k")))
    both = degree.agg(F.sum("k")).first()[0] or 0
    label = stored(label)
    score = _score(both, e, label, degree)
    while True:
        vol = degree.join(label, "id").groupBy("block").agg(F.sum("k").alias("v"))
        link = e.join(label.select(F.col("id").alias("dst"), F.col("block").alias("to")), "dst").groupBy("id", "to").agg(F.sum("w").alias("l"))
        link = link.join(label, "id").join(degree, "id")
        here = link.where("to = block").select("id", F.col("l").alias("own"))
        try_ = link.where("to <> block").join(here, "id", "left").join(vol.select("block", F.col("v").alias("va")), "block").join(vol.select(F.col("block").alias("to"), F.col("v").alias("vb")), "to")
        gain = _times(F.lit(both).cast("long"), F.col("l") - F.coalesce("own", F.lit(0))) - _times("k", F.col("vb") - F.col("va") + F.col("k"))
        want = try_.select("id", "to", gain.alias("gain")).where("gain > 0").groupBy("id").agg(F.max(F.struct("gain", (-F.col("to")).alias("to"))).alias("x"))
        want = stored(want.select("id", (-F.col("x.to")).alias("to"), F.struct("x.gain", (-F.col("id")).alias("id")).alias("x")))
        beaten = e.join(want.select("id", F.col("x").alias("mine")), "id").join(want.select(F.col("id").alias("dst"), "x"), "dst").where("x > mine").select("id")
        go = want.join(beaten, "id", "left_anti").select("id", "to")
        new = stored(label.join(go, "id", "left").select("id", F.coalesce("to", "block").alias("block")))
        now = _score(both, e, new, degree)
        if now <= score:
            return label
        label, score = new, now


def modularity_blocks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, block), block the smallest id of a connected part: merges, then moves, then parts that a move has cut off stand alone, which never lowers modularity.

    ``nodes``: id; ``edges``: src, dst, each once, and w (long) if weighted. Nodes without an edge are blocks of their own.
    """
    label = moved_nodes(nodes, edges, merged_blocks(nodes, edges))
    a, b = (label.select(F.col("id").alias(c), F.col("block").alias(n)) for c, n in (("src", "p"), ("dst", "q")))
    inner = edges.join(a, "src").join(b, "dst").where("p = q").select("src", "dst")
    return components(nodes, inner).withColumnRenamed("component", "block")
