"""Shared plumbing: the shared folder, written tables, thresholds without sorting, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows in a table that may be broadcast; all such tables are narrow.
BROADCAST_ROWS = 200_000
#: Arrow batches end at so many rows or bytes, so that a batch of long texts stays small.
ARROW_ROWS, ARROW_BYTES = 50_000, 4 << 20


#: Folders made in the open scope, if one is.
_scope: list[str] | None = None


def begin_scope(spark: SparkSession, reads: DataFrame) -> None:
    """Deletes the folders of the scope before, unless ``reads`` still reads one, and opens a new one.

    For chains of steps each of which starts when the result of the one before is written.
    """
    global _scope
    if _scope:
        files = reads.inputFiles()
        for path in _scope:
            if not any(path.partition(":")[2].lstrip("/") in f for f in files):
                target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        release(spark)
    _scope = []


def end_scope() -> None:
    global _scope
    _scope = None


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; a temporary one where that is unset and the master is local (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    if _scope is not None:
        _scope.append(path)
    return path


def written(df: DataFrame, order: list | None = None, group_rows: int | None = None) -> DataFrame:
    """The table written to the shared folder and read again: lineage ends there and lost executors lose nothing.

    ``group_rows``: for tables of wide rows. The reader decodes up to 4096 rows at once, but
    none beyond a row group, so row groups of so few rows bound its memory.
    """
    path = shared_dir(df.sparkSession) + "/t"
    out = df.write.option("compression", "zstd")
    if group_rows is not None:
        out = out.option("parquet.block.row.count.limit", group_rows)
    out.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of steps whose results have been written."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ordinals(rows: DataFrame, keys: list[str], row_id: str, salts: int = 64) -> DataFrame:
    """``rows`` (written) with ``_ord``: 0, 1, ... within rows that agree in ``keys``; 0 where a row is alone.

    ``row_id``: a column that tells all rows apart. Only rows that are not alone are
    numbered; they are dealt over ``salts`` runs a key whose lengths give the offsets.
    """
    salt = F.pmod(F.xxhash64(row_id), F.lit(salts))
    key = F.xxhash64(*keys)
    runs = rows.select(key.alias("_key"), salt.alias("_salt")).groupBy("_key", "_salt").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy("_key")
    before = whole.orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumns({"_all": F.sum("_n").over(whole), "_from": F.coalesce(F.sum("_n").over(before), F.lit(0))})
    runs = written(runs.where("_all > 1").select("_key", "_salt", "_from"))
    if runs.isEmpty():
        return rows.withColumn("_ord", F.lit(0).cast("long"))
    many = rows.select(row_id, key.alias("_key"), salt.alias("_salt")).join(runs, ["_key", "_salt"])
    place = F.row_number().over(Window.partitionBy("_key", "_salt").orderBy(row_id)) - 1
    many = many.select(row_id, (F.col("_from") + place).alias("_ord"))
    return rows.join(many, row_id, "left").withColumn("_ord", F.coalesce("_ord", F.lit(0)).cast("long"))


def joined_small(df: DataFrame, small: DataFrame, on, rows: int, how: str = "inner") -> DataFrame:
    """Joins with a table of a known number of rows: broadcast up to ``BROADCAST_ROWS``, else a shuffled join."""
    return df.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on, how)


def components(edges: DataFrame, rows_a_task: int | None = None, rows: int | None = None) -> DataFrame:
    """Connected components of edges (a, b): rows (id, comp), comp the smallest id reached.

    Large-star and small-star steps on an edge table that is written to the shared
    folder in each round, until nothing changes; each step groups edges by a node
    but keeps no group in memory (window minimum joined by aggregation).
    ``rows_a_task``: steps on few edges take fewer tasks than there are shuffle partitions,
    the first one too if ``rows``, the number of ``edges``, is given.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = written(e.coalesce(rows // rows_a_task + 1) if rows_a_task and rows is not None else e)
    tasks = e.count() // rows_a_task + 1 if rows_a_task else None
    few = (lambda df: df.coalesce(tasks)) if tasks else (lambda df: df)
    before = None
    while True:
        # large star: each node links its larger neighbours to its smallest neighbour (or itself)
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = few(both.groupBy("u").agg(F.min("v").alias("m"))).select("u", F.least("u", "m").alias("m"))
        large = few(both.where("v > u").join(low, "u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: each node links its smaller neighbours and itself to its smallest neighbour
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        down = written(few(down))
        mins = few(down.groupBy("u").agg(F.min("v").alias("m")))
        small = few(down.join(mins, "u")).select(F.col("v").alias("x"), F.col("m").alias("v")).where("x <> v").select(F.col("x").alias("u"), "v")
        e = written(few(small.union(mins.select("u", F.col("m").alias("v"))).where("u <> v").distinct()))
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return few(e.groupBy("u").agg(F.min("v").alias("comp"))).select(F.col("u").alias("id"), "comp")
