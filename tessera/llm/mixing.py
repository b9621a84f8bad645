"""Mixing sources to target weights by hash thresholds.

Each row has a 60-bit hash of its doc_id, its text and, where these repeat, its ordinal
among the equal rows. Sizes are summed by source and hash bucket (12 bits
a level); the bucket in which a source's running sum passes its budget is the only
one refined, level by level, until it holds one hash; a threshold on the hash then
selects the documents. Nothing is sorted but the at most 4096 buckets of a source,
and every pass is an aggregation with partial sums, so a hot source costs no more
than others. Budgets are nested: a larger one keeps all that a smaller one took.

A target above the source's size takes every document once (or twice) and selects
for the rest, so no document is taken more often than the cap rounded up.

Sources are ranked by range partitions and offsets, and targets are found by sums over
all sources, so a table with a source per host needs no task that sees them all.

Defined results: null source is a source of its own and comes last; null text has
size 0, and a source without words is taken whole, once; very long texts count whole; rows that repeat a doc_id, null ids too, are drawn
one by one; an empty table gives an empty result; input columns of any name are kept,
but names that begin with ``_tessera`` are reserved.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import joined_small, ordinals, small_batches, written
from .textscan import Scanner, chunks

BITS, LEVEL = 60, 12


def thresholds(items: DataFrame, budgets: DataFrame, n_groups: int) -> DataFrame:
    """(grp, threshold): documents with ``h < threshold`` have sizes that add up nearest to the budget.

    ``items``: grp, h, size, written; ``budgets``: grp, budget. Nearest means that the
    document at the boundary is taken if that leaves less of a difference.
    """
    state = written(budgets.select("grp", F.col("budget").cast("double").alias("budget"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("double").alias("below"), F.lit(None).cast("long").alias("threshold")))
    for level in range(BITS // LEVEL):
        if state.where("threshold IS NULL").isEmpty():
            break
        shift = BITS - LEVEL * (level + 1)
        live = state.where("threshold IS NULL").select("grp", "prefix")
        here = F.shiftright("h", shift + LEVEL) == F.col("prefix")
        sums = joined_small(items, live, "grp", n_groups).where(here).groupBy("grp", F.shiftright("h", shift).alias("b"))
        sums = sums.agg(F.sum("size").cast("double").alias("s"), F.min("h").alias("h0"), F.max("h").alias("h1"))
        upto = Window.partitionBy("grp").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        run = sums.withColumn("upto", F.sum("s").over(upto)).join(state.where("threshold IS NULL").select("grp", "budget", "below"), "grp")
        over = run.where(F.col("below") + F.col("upto") > F.col("budget"))
        first = over.groupBy("grp").agg(F.min_by(F.struct("b", "s", "upto", "h0", "h1"), "b").alias("x"))
        start = F.col("below") + F.col("x.upto") - F.col("x.s")
        nearer = start + F.col("x.s") - F.col("budget") < F.col("budget") - start
        found = (
            F.when(F.col("threshold").isNotNull(), F.col("threshold"))
            .when(F.col("x").isNull(), F.shiftleft(F.col("prefix") + 1, shift + LEVEL))
            .when(F.col("x.h0") == F.col("x.h1"), F.when(nearer, F.col("x.h1") + 1).otherwise(F.col("x.h0")))
        )
        open_ = F.col("threshold").isNull() & F.col("x").isNotNull()
        state = written(
            state.join(first, "grp", "left").select(
                "grp", "budget",
                F.when(open_, F.col("x.b")).otherwise(F.col("prefix")).alias("prefix"),
                F.when(open_, start).otherwise(F.col("below")).alias("below"),
                found.alias("threshold"),
            )
        )
    return state.select("grp", "threshold")


def word_sizes(df: DataFrame, text_col: str, keep: list[str], size: str = "size") -> DataFrame:
    """``keep`` columns and ``size``: number of words (runs without ASCII white space) of the whole text."""
    small_batches(df.sparkSession)
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(size, T.LongType())])

    def run(batches):
        scan = Scanner("space")
        for b in batches:
            sizes = [int(x) for _, _, data, offs in chunks(b.column("_tessera_text")) for x in scan.counts(data, offs)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(sizes, pa.int64())], names=[*keep, size])

    return df.select(*keep, F.col(text_col).alias("_tessera_text")).mapInArrow(run, schema)


def ranked_sources(by: DataFrame) -> DataFrame:
    """``by`` (one row a source, written) with ``grp``: the rank of the source by code points, from 0, null last."""
    n = int(by.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = by.repartitionByRange(n, F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    placed = written(placed.withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_m", 33)
    parts = placed.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))  # at most one row a partition
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_at"))
    placed = placed.withColumn("_p", part).join(F.broadcast(parts), "_p")
    return placed.withColumn("grp", F.col("_at") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_p", "_m", "_at")


def water_level(by: DataFrame, share: float) -> float | None:
    """The level at which sources of ``full`` and weight ``w`` take ``share`` of all sizes; each round fills the sources below the level so far."""
    level, filled = 0.0, -1
    while True:
        is_full = F.col("full") <= F.lit(level) * F.col("w")
        x = by.agg(
            F.sum("source_size").alias("s"), F.sum(F.when(~is_full, F.col("w"))).alias("w"),
            F.sum(F.when(is_full, F.col("full"))).alias("f"), F.count_if(is_full).alias("n"),
        ).first()
        if x["w"] is None or x["n"] == filled:
            return level if x["w"] is not None else None
        level, filled = (share * (x["s"] or 0) - (x["f"] or 0.0)) / x["w"], x["n"]


def plan_mix(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> tuple[DataFrame, int]:
    """One row per source: source, source_size, target, times (whole takes of every document), threshold (of one more take); and their number.

    ``sizes``: source, h, size, of a written table. Sources in order of code points, null last,
    take the weights in turn. Targets share ``share`` of all sizes by weight but stop at
    ``cap`` times the source's size; the excess is shared again by weight, which is
    water-filling: full sources have their cap and the others stand at one level.
    """
    by = ranked_sources(written(sizes.groupBy("source").agg(F.sum("size").alias("source_size"))))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("grp"), F.lit(len(weights))) + 1).cast("int"))
    by = written(by.withColumn("w", w).withColumn("full", F.col("source_size") * cap))
    level = water_level(by, share)
    target = F.col("full") if level is None else F.least(F.col("full"), F.lit(level) * F.col("w"))
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    by = written(by.withColumn("target", target).select("grp", "source", "source_size", "target", times.cast("long").alias("times")))
    n = by.count()
    items = joined_small(sizes, by.select("source", "grp"), sizes["source"].eqNullSafe(by["source"]), n)
    items = written(items.select("grp", "h", "size"))
    cut = thresholds(items, by.select("grp", (F.col("target") - F.col("times") * F.col("source_size")).alias("budget")), n)
    return written(by.join(cut, "grp").drop("grp")), n


def sized(docs: DataFrame, keep: list[str], id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 29) -> DataFrame:
    """``keep`` columns (named keep_...), source, size and h (the row's hash) of a table written once."""
    row = "_tessera_row"
    cols = list(dict.fromkeys(keep))
    mine = docs.select(
        *[F.col(c).alias(f"_tessera_keep_{c}") for c in cols], F.col(id_col).alias("_tessera_id"), F.col(source_col).alias("_tessera_source"),
        F.xxhash64(text_col).alias("_tessera_hash"), F.col(text_col).alias("_tessera_whole"),
    )
    held = [c for c in mine.columns if c != "_tessera_whole"]
    rows = written(word_sizes(mine, "_tessera_whole", held, "_tessera_size").withColumn(row, F.monotonically_increasing_id()))
    rows = ordinals(rows, ["_tessera_id", "_tessera_source", "_tessera_hash"], row)
    h = F.shiftrightunsigned(F.xxhash64("_tessera_id", "_tessera_hash", "_ord", F.lit(seed)), 64 - BITS)
    return rows.select(
        *[F.col(f"_tessera_keep_{c}").alias(f"keep_{c}") for c in cols], F.col("_tessera_source").alias("source"),
        F.col("_tessera_size").alias("size"), h.alias("h"),
    )


def taken(sizes: DataFrame, plan: DataFrame, n_sources: int) -> DataFrame:
    """``sizes`` with source_size, target and ``copies``: how often the mix takes the row."""
    plan = plan.withColumnRenamed("source", "_source")
    out = joined_small(sizes, plan, sizes["source"].eqNullSafe(plan["_source"]), n_sources)
    more = F.when(F.col("h") < F.col("threshold"), 1).otherwise(0)
    return out.withColumn("copies", F.col("times") + more).drop("_source", "times", "threshold")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed table: every row of ``docs`` as often as the mix takes it."""
    sizes = sized(docs, docs.columns)
    plan, n = plan_mix(sizes, **options)
    out = taken(sizes, plan, n).where("copies > 0").withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*[F.col(f"keep_{c}").alias(c) for c in docs.columns])


def op2_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = sized(docs, ["doc_id"])
    plan, n = plan_mix(sizes)
    out = taken(sizes, plan, n)
    return out.select(F.col("keep_doc_id").alias("doc_id"), "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
