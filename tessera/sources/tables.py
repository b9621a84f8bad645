"""Reading and writing tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def thresholds_from_json(spark: SparkSession, path: str) -> DataFrame:
    """(space, level, tau) of a JSON object whose keys read ``space_L<level>``; a key of another form is an error."""
    pairs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,double>")).alias("key", "tau"))
    level = F.regexp_extract("key", r"^(.*)_L([0-9]+)$", 2)
    checked = F.when(level == "", F.raise_error(F.concat(F.lit("no level in key "), F.col("key")))).otherwise(level)
    return pairs.select(F.regexp_extract("key", r"^(.*)_L([0-9]+)$", 1).alias("space"), checked.cast("int").alias("level"), "tau")


def append_chunk(df: DataFrame, path: str, chunk: int) -> None:
    """One chunk of results; writing it again replaces it, and reading the folder merges all chunks."""
    df.write.mode("overwrite").json(f"{path}/chunk={chunk}")


def merged_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def stored(df: DataFrame) -> DataFrame:
    """The table written to the checkpoint folder, which driver and executors share, and read again.

    Unlike ``checkpoint()`` it computes the rows once and starts anew with the size of
    its files, so that loops of joins don't multiply size estimates round by round.
    """
    spark = df.sparkSession
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:  # only where all runs in one process is a folder of this machine one that all share
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
