"""Chat formatting with cumulative-snapshot collapse.

Logs hold a conversation many times, each time with more turns. A turn's prefix hash
is the running sum of hashes of (place, role, text) of it and the turns before, 128
bits in two sums; so two conversations have equal prefix hashes at a length exactly
if they agree in the turns up to it. A conversation whose whole hash is the prefix
hash of a longer one is dropped by an anti-join; of equal ones the smallest conv_id
stays. Both sides of the anti-join are distinct hashes, so a turn or conversation that
is very common counts once. Only conversations that stay are rendered.

Defined results: turns are ordered by turn (nulls first), role, text; a repeated turn
is a turn of its own; null roles and texts equal empty ones; rows with a null conv_id
are not part of a conversation and are left out; very long texts are kept whole, and a
conversation that stays is one row; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: How a turn is rendered; %s: role and text.
TURN = "<|%s|>\n%s\n"


def numbered(turns: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    t = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return t.withColumn("k", F.row_number().over(order))


def prefix_hashes(t: DataFrame) -> DataFrame:
    """conv_id, k, n (turns of the conversation), p, q: hashes of the first k turns."""
    wide = Window.partitionBy("conv_id")
    run = wide.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    h = t.select("conv_id", "k", F.xxhash64("k", "role", "text").alias("a"), F.xxhash64("text", "role", "k", F.lit(1)).alias("b"))
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).over(run)
    return h.select("conv_id", "k", F.max("k").over(wide).alias("n"), total("a").alias("p"), total("b").alias("q"))


def collapse(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(numbered turns, one row per conversation: conv_id, n_turns, n_equal, kept)."""
    t = numbered(turns)
    pre = written(prefix_hashes(t))
    whole = pre.where("k = n").groupBy("n", "p", "q").agg(F.min("conv_id").alias("first_id"), F.count("*").alias("n_equal"))
    proper = pre.where("k < n").select(F.col("k").alias("n"), "p", "q").distinct()
    kept = whole.join(proper, ["n", "p", "q"], "left_anti").select(F.col("first_id").alias("conv_id"), F.col("n").cast("long").alias("n_turns"), "n_equal")
    return t, kept


def render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_equal (logged copies, itself included), text of the maximal conversations."""
    t, kept = collapse(turns)
    kept = written(kept)
    line = F.format_string(TURN, "role", "text")
    said = t.join(kept.select("conv_id"), "conv_id", "left_semi").groupBy("conv_id")
    said = said.agg(F.array_sort(F.collect_list(F.struct("k", line.alias("line")))).alias("x"))
    return said.select("conv_id", F.concat_ws("", F.col("x.line")).alias("text")).join(kept, "conv_id").select("conv_id", "n_turns", "n_equal", "text")


def op7_chat(spark, sf_dir):
    return render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP7_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT conv_id, k, '<|' || role || '|>' || chr(10) || text || chr(10) AS line, md5(role || chr(0) || text) AS h FROM t),
p AS (SELECT conv_id, k, string_agg(h, '') OVER (PARTITION BY conv_id ORDER BY k) AS pre, count(*) OVER (PARTITION BY conv_id) AS n FROM r),
w AS (SELECT pre, min(conv_id) AS conv_id, count(*) AS n_equal, max(n) AS n_turns FROM p WHERE k = n GROUP BY pre),
kept AS (SELECT * FROM w WHERE pre NOT IN (SELECT pre FROM p WHERE k < n)),
s AS (SELECT conv_id, string_agg(line, '' ORDER BY k) AS text FROM r GROUP BY conv_id)
SELECT kept.conv_id, CAST(n_turns AS BIGINT) AS n_turns, CAST(n_equal AS BIGINT) AS n_equal, s.text FROM kept JOIN s ON kept.conv_id = s.conv_id
"""
