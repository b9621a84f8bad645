"""Uniform shuffle into shards of exact size, in DataFrame operations only.

Hypergeometric communication matrix: rows are tagged once with their scan
partition and their place in a random order of it, and the tags are written; the
driver draws, partition by partition, how many rows go to each shard (multivariate
hypergeometric, without replacement from the shards' capacities); each row finds
its shard from its place alone; rows are exchanged once, and a second random order
inside each shard gives the slot. Both orders follow hashes of a row's position, not
of its values, so equal rows are placed independently of each other.

The driver holds one count a partition, as Spark's own map-output tracker does, and
one row of the matrix at a time, which goes line by line to a file in the shared
folder; rows never reach it. The second order uses blocks of about ``BLOCK_ROWS``
rows (shard, block) with prefix-summed offsets, so that no task sorts a whole shard.

Defined results: law ``rows`` (counts at most one apart). Null doc_id and null text
are values like others, very long texts are rows like others, repeated and tied rows
take a slot each and share a shard only by chance, an empty table gives an empty
result, columns are kept as they are (``shard`` and ``slot`` are replaced; names that
begin with ``_tessera`` are reserved). The same input files, read in the same
partitions, give the same placing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, shared_dir, written

BLOCK_ROWS = 20_000


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Number of good ones in draws without replacement from good + bad: numpy's sampler, which ends at 10**9, then inversion."""
    lo, hi = max(0, draws - bad), min(draws, good)
    if lo == hi:
        return lo
    if max(good, bad, draws) < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    return _inverted(rng, good, bad, draws, lo, hi)


def _inverted(rng: np.random.Generator, good: int, bad: int, draws: int, lo: int, hi: int) -> int:
    """The same law for counts of any size, by inversion over 12 standard deviations around the mode.

    Probabilities relative to the mode follow from the ratio of neighbours, so no large
    factorials meet; what lies outside is less than a double's resolution of one.
    """
    total = good + bad
    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (total + 2)))
    p = good / total
    reach = int(12 * (draws * p * (1 - p) * (total - draws) / (total - 1)) ** 0.5) + 40
    a, b = max(lo, mode - reach), min(hi, mode + reach)
    up = np.arange(mode, b, dtype=np.float64)
    down = np.arange(mode, a, -1, dtype=np.float64)
    rise = np.cumsum(np.log((good - up) * (draws - up)) - np.log((up + 1) * (bad - draws + up + 1)))
    fall = np.cumsum(np.log(down * (bad - draws + down)) - np.log((good - down + 1) * (draws - down + 1)))
    chance = np.cumsum(np.exp(np.concatenate([fall[::-1], [0.0], rise])))
    return a + int(np.searchsorted(chance, rng.random() * chance[-1], side="right"))


def communication_matrix(sizes: list[int], shards: list[int], seed: int):
    """How many rows of each partition go to each shard, one partition at a time: margins are exactly ``sizes`` and ``shards``."""
    rng, left = np.random.default_rng(seed), list(shards)
    for m in sizes:
        row, rest, need = [], sum(left), m
        for s in range(len(left)):
            k = _hypergeometric(rng, left[s], rest - left[s], need)
            row.append(k)
            rest -= left[s]
            need -= k
        for s, k in enumerate(row):
            left[s] -= k
        yield row


def _cuts(spark, parts: list[int], matrix) -> DataFrame:
    """The matrix as a table (_tessera_p, _tessera_cut: running sums over the shards), read from a file that is written row by row."""
    path = shared_dir(spark) + "/matrix.json"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    lines: list[str] = []

    def flush():
        out.write(bytearray("".join(lines).encode()))
        lines.clear()

    for p, row in zip(parts, matrix, strict=True):
        lines.append('{"_tessera_p":%d,"_tessera_cut":%s}\n' % (p, np.cumsum(row).tolist()))
        if len(lines) >= 1000:
            flush()
    flush()
    out.close()
    return spark.read.schema("_tessera_p bigint, _tessera_cut array<bigint>").json(path)


def shuffle_into_shards(df: DataFrame, n_shards: int, seed: int = 17, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in each shard)."""
    spark = df.sparkSession
    base = df.drop("shard", "slot")
    m, p, r, cut, h, b, n, at, k = (f"_tessera_{x}" for x in ("m", "p", "r", "cut", "h", "b", "n", "at", "k"))
    tagged = base.withColumn(h, F.xxhash64(F.monotonically_increasing_id(), F.lit(seed))).sortWithinPartitions(h).withColumn(m, F.monotonically_increasing_id()).drop(h)
    tagged = written(tagged)
    part, place = F.shiftrightunsigned(m, 33), F.col(m).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = tagged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
    total = sum(x["n"] for x in sizes)
    shards = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    cuts = _cuts(spark, [x["p"] for x in sizes], communication_matrix([x["n"] for x in sizes], shards, seed))
    small = len(sizes) * n_shards <= BROADCAST_ROWS * 10
    placed = tagged.withColumns({p: part, r: place}).join(F.broadcast(cuts) if small else cuts, p)
    placed = placed.withColumn("shard", F.size(F.filter(cut, lambda c: c <= F.col(r))).cast("int"))
    blocks = max(16, -(-total // (n_shards * block_rows)))
    placed = placed.withColumn(h, F.xxhash64(m, F.lit(seed + 1))).withColumn(b, F.pmod(h, F.lit(blocks)))
    count = placed.groupBy("shard", b).agg(F.count("*").alias(n))
    before = Window.partitionBy("shard").orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    starts = count.select("shard", b, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(at))
    inner = Window.partitionBy("shard", b).orderBy(h, m)
    slotted = placed.withColumn(k, F.row_number().over(inner) - 1)
    slotted = slotted.join(F.broadcast(starts) if n_shards * blocks <= BROADCAST_ROWS else starts, ["shard", b])
    return slotted.select(*base.columns, "shard", (F.col(at) + F.col(k)).cast("long").alias("slot"))


def op3_sharding(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shuffle_into_shards(rows, 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
