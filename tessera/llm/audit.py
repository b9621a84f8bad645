"""Source divergence audit: how far the word use of a language's sources lies apart, exactly.

Terms are runs of letters. A language keeps its V terms that occur in at least
``least`` of its documents. A group (language and source) with N occurrences of kept
terms gives a term with count c the smoothed share p(c) = 1 + floor(SCALE * (c + 2) /
(N + 2 V)); two shares lie f(p, q) = floor((p - q)**2 / (p + q)) apart, and two
sources the sum of f over all kept terms. That sum is taken by inclusion and exclusion
over the supports of the two groups, so that terms which a group lacks cost nothing:

  constants   V * f(p(0), q(0)), as if both lacked every term;
  histograms  for each group, how many kept terms have which count: each such term adds
              f(p(c), q(0)) - f(p(0), q(0)) as if the other side lacked it;
  postings    terms that both hold add f(p, q) - f(p, q(0)) - f(p(0), q) + f(p(0), q(0)).

Documents are scanned once; a chunk of texts is counted by (lang, source, term) in its
task, then by Spark before and after the shuffle. Postings of a term are one row, at
most one entry a source; their pairs are summed in the task by pair of sources and
only these sums are shuffled. All numbers are integers of 64 bits: p is a long division
in base 1000, exact while N + 2 V is below 9 * 10**15.

Defined results: null text, lang and source count as ''; empty and blank texts make
their group occur, with no term; very long texts and terms are read whole; rows that
repeat a doc_id are documents of their own, null ids too (ids are not read); a language
without kept terms has distance 0 between all its sources and no term rows; a language
with one source has no pair rows; ties rank by the item's UTF-8 bytes; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import joined_small, small_batches, written
from .terms import coded, coded_column, sums, term_class
from .textscan import chunks

SCALE = 1_000_000_000
#: Documents of a language that a kept term needs, and ranks of the terms listed for a group.
LEAST, TERMS = 10, 10
#: Bytes of text counted at once, and pairs of sources held at once.
CHUNK, PAIRS = 4 << 20, 1 << 20


def _counts(batches):
    """(lang, source, term, n, docs) of each chunk of texts; columns lang, source, text."""
    table = term_class("letter")
    for b in batches:
        for i, j, data, offs in chunks(b.column(2), CHUNK):
            first, code, words = coded(data, offs, table)
            if not len(code):
                continue
            (lc, langs), (sc, sources) = (coded_column(b.column(c).slice(i, j - i)) for c in (0, 1))
            v = len(words)
            doc = np.repeat(np.arange(j - i), np.diff(first))
            at, n = np.unique(doc * v + code, return_counts=True)
            group = lc * len(sources) + sc
            key, n, docs = sums(group[at // v] * v + at % v, n.astype(np.int64), np.ones(len(at), np.int64))
            g = key // v
            cols = [langs.take(pa.array(g // len(sources))), sources.take(pa.array(g % len(sources))), words.take(pa.array(key % v)).cast(pa.string()), pa.array(n), pa.array(docs)]
            yield pa.RecordBatch.from_arrays(cols, names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of ``docs`` (lang, source, text without nulls): occurrences, and documents with the term."""
    c = docs.select("lang", "source", "text").mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
    return c.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _quotient(a: str, b: str) -> Column:
    return F.expr(f"({a}) div nullif({b}, 0)")


def with_share(df: DataFrame, count: str, total: str, name: str) -> DataFrame:
    """``df`` with the smoothed share of ``count`` in ``total``; null where total is 0."""
    df = df.withColumns({"_rest": F.expr(f"{count} + 2L"), "_out": F.lit(0).cast("long")})
    for _ in range(3):
        df = df.withColumns({"_out": F.col("_out") * 1000 + _quotient("_rest * 1000", total), "_rest": F.expr(f"(_rest * 1000) % nullif({total}, 0)")})
    return df.withColumn(name, F.col("_out") + 1).drop("_rest", "_out")


def apart(p: str, q: str) -> Column:
    """floor((p - q)**2 / (p + q))."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def _overlaps(batches):
    """(lang, a, b, fix) summed over a batch, a < b; columns lang, postings (source, p, p0)."""

    def pairs(lang, first, source, p, p0, m, names, langs):
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        o = np.lexsort((source, row))
        source, p, p0 = source[o], p[o], p0[o]
        got = []
        for s in range(1, int(np.diff(first).max(initial=0))):
            x = np.flatnonzero(row[s:] == row[:-s])
            y = x + s
            fix = _f(p[x], p[y]) - _f(p[x], p0[y]) - _f(p0[x], p[y]) + _f(p0[x], p0[y])
            got.append(sums((lang[row[x]] * m + source[x]) * m + source[y], fix))
        if got:
            key, fix = sums(*(np.concatenate(c) for c in zip(*got, strict=True)))
            cols = [langs.take(pa.array(key // m // m)), names.take(pa.array(key // m % m)), names.take(pa.array(key % m)), pa.array(fix)]
            yield pa.RecordBatch.from_arrays(cols, names=["lang", "a", "b", "fix"])

    for b in batches:
        if not len(b):
            continue
        lists = b.column(1)
        flat = lists.flatten()
        size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(size)])
        lang, langs = coded_column(b.column(0))
        source, names = coded_column(flat.field(0))
        rank = np.empty(len(names), np.int64)  # codes in the order of the strings' bytes, which is Spark's
        order = sorted(range(len(names)), key=lambda i: names[i].as_py().encode())
        rank[order] = np.arange(len(names))
        source, names = rank[source], names.take(pa.array(order))
        p, p0 = (flat.field(i).to_numpy(zero_copy_only=False) for i in (1, 2))
        held = np.concatenate([[0], np.cumsum(size * (size - 1) // 2)])
        i = 0
        while i < len(size):
            j = max(i + 1, int(np.searchsorted(held, held[i] + PAIRS, side="right")) - 1)
            s = slice(first[i], first[j])
            yield from pairs(lang[i:j], first[i : j + 1] - first[i], source[s], p[s], p0[s], len(names), names, langs)
            i = j


def divergence(docs: DataFrame, least: int = LEAST, terms: int = TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has the distance to each other source of the language, part ``term`` the terms that the group uses more than its language does."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    whole = Window.partitionBy("lang", "term")
    kept = term_counts(docs).withColumns({"docs": F.sum("docs").over(whole), "n_lang": F.sum("n").over(whole)})
    kept = written(kept.where(F.col("docs") >= least).select("lang", "term", "source", "n", "n_lang"))

    hist = written(kept.groupBy("lang", "source", "n").agg(F.count("*").alias("times")))
    langs = kept.groupBy("lang", "term").agg(F.max("n_lang").alias("n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("all"))
    langs = langs.withColumn("d_lang", F.col("all") + 2 * F.col("v"))
    groups = docs.select("lang", "source").distinct()
    groups = groups.join(hist.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("times")).alias("all_here")), ["lang", "source"], "left")
    groups = groups.join(langs.select("lang", "v", "d_lang"), "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), "d_lang", (F.coalesce("all_here", F.lit(0)) + 2 * F.coalesce("v", F.lit(0))).alias("d"))
    groups = written(with_share(groups.withColumn("none", F.lit(0).cast("long")), "none", "d", "p0").drop("none"))
    rows = groups.count()

    priced = joined_small(kept, groups, ["lang", "source"], rows)
    priced = written(with_share(with_share(priced, "n", "d", "p"), "n_lang", "d_lang", "q").select("lang", "term", "source", "p", "p0", "q"))

    # one-sided: as if the other source lacked the term
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    one = with_share(joined_small(hist, groups, ["lang", "source"], rows), "n", "d", "p").select("lang", "source", "p", "p0", "times")
    one = joined_small(one, other, "lang", rows).where("source <> item")
    one = one.groupBy("lang", "source", "item").agg(F.sum(F.col("times") * (apart("p", "q0") - apart("p0", "q0"))).alias("value"))
    # both: terms that both hold
    held = priced.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("held")).where(F.size("held") > 1)
    both = held.select("lang", "held").mapInArrow(_overlaps, "lang string, a string, b string, fix long").groupBy("lang", "a", "b").agg(F.sum("fix").alias("value"))
    # neither: every kept term
    none = joined_small(groups, other, "lang", rows).where("source <> item")
    none = none.select("lang", "source", "item", F.coalesce(F.col("v") * apart("p0", "q0"), F.lit(0).cast("long")).alias("value"))
    flip = one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    there = both.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value")
    back = both.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value")
    pair = none.union(one).union(flip).union(there).union(back).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = pair.withColumn("rank", F.row_number().over(order))
    term = priced.where("p > q").select("lang", "source", F.col("term").alias("item"), apart("p", "q").alias("value"))
    term = term.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= terms)
    out = [x.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank") for name, x in (("pair", pair), ("term", term))]
    return out[0].union(out[1])


def op11_divergence(spark, sf_dir):
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x : x <> '')) AS t FROM d),
k AS (SELECT lang, t, CAST(count(*) AS HUGEINT) AS n_lang FROM w GROUP BY lang, t HAVING count(DISTINCT r) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.t, CAST(count(*) AS HUGEINT) AS n FROM w JOIN k ON w.lang = k.lang AND w.t = k.t GROUP BY w.lang, w.source, w.t),
l AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(n_lang) AS HUGEINT) AS n FROM k GROUP BY lang),
s AS (SELECT g.lang, g.source, coalesce(CAST(sum(c.n) AS HUGEINT), 0) AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
p AS (SELECT s.lang, s.source, k.t, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (s.n + 2 * l.v) AS p, 1 + (1000000000 * (k.n_lang + 2)) // (l.n + 2 * l.v) AS q
  FROM s JOIN l ON l.lang = s.lang JOIN k ON k.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.t = k.t),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term' AS part, t AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM o)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""
