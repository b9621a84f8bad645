"""Exact dedup by content sort, in DataFrame operations only.

Texts are normalised (each run of ASCII white space becomes one space), range
partitioned with splitters that Spark samples, and sorted externally, so equal texts
stand next to each other; the window over equal texts compares neighbours in full
and yields the smallest identifier of the run. The sort key is the first ``PREFIX``
characters, a hash that parts texts with equal beginnings, then the whole text;
splitters hold the first two only, so that the sample the driver sees is small.

A text held by very many rows would fill one partition. One narrow pass counts
rows by a hash of the text; texts with more than ``HOT_ROWS`` rows get a salt that
deals their rows over several runs, and the runs' minima and counts are combined
afterwards. There are at most rows / HOT_ROWS such texts; the table of their totals
is joined by broadcast where it is below ``BROADCAST_ROWS``.

Defined results: null text counts as empty; very long texts are compared whole; rows
that repeat a doc_id are rows of their own, so all rows with the kept identifier count as
kept; null doc_ids sort last, so they stay only if a group has no other; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import joined_small, written

#: Rows of one text from which its rows are dealt over several runs, and rows in such a run.
HOT_ROWS = 1000
#: Characters of the text in a splitter.
PREFIX = 24

#: Runs of ASCII white space other than one single space; replacing these by a space equals replacing all runs.
ODD_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), ODD_SPACE, " ")


def content_sort(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = df.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("norm"))
    hashed = keyed.select(F.xxhash64("norm").alias("h"))
    hot = written(hashed.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") > hot_rows))
    hot = hot.select("h", F.ceil(F.col("c") / F.lit(hot_rows)).alias("salts"))
    n_hot = hot.count()

    placed = keyed.withColumns({"h": F.xxhash64("norm"), "place": F.monotonically_increasing_id()})  # rows that share an id are dealt too
    rows = joined_small(placed, hot, "h", n_hot, "left")
    salt = F.when(F.col("salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id", "place"), F.col("salts")))
    rows = rows.select("doc_id", "norm", F.substring("norm", 1, PREFIX).alias("head"), "h", F.col("salts").isNotNull().alias("hot"), salt.cast("int").alias("salt"))
    run = Window.partitionBy("head", "h", "salt", "norm")
    runs = (
        rows.repartitionByRange(n, "head", "h", "salt")
        .withColumn("run_id", F.min("doc_id").over(run))
        .withColumn("run_rows", F.count("*").over(run))
        .select("doc_id", F.sha2("norm", 256).alias("text_sha256"), "hot", "salt", "run_id", "run_rows")
    )
    runs = written(runs)
    heads = runs.where("hot").groupBy("text_sha256", "salt").agg(F.min("run_id").alias("run_id"), F.min("run_rows").alias("run_rows"))
    totals = heads.groupBy("text_sha256").agg(F.min("run_id").alias("all_id"), F.sum("run_rows").alias("all_rows"))
    out = joined_small(runs, totals, "text_sha256", n_hot, "left")
    keep = F.when(F.col("hot"), F.col("all_id")).otherwise(F.col("run_id"))
    size = F.when(F.col("hot"), F.col("all_rows")).otherwise(F.col("run_rows"))
    return out.select("doc_id", keep.alias("keep_id"), size.cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def op10_exact_dedup(spark, sf_dir):
    return content_sort(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm
"""
