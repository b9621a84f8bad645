"""Ranked lexical search over a forward index in blocks, with block-max pruning.

The index has a row for each block of consecutive documents: their ids, the block's
distinct terms, the documents that hold each, each term's largest impact in the block,
and document by document the terms and impacts. An impact is a term's part of a
document's score before the query's weight; it needs the number of documents and their
mean length, which a first pass counts. Terms are kept as strings, so equal terms are
equal words. Blocks end after ``DOCS`` documents or ``TOKENS`` terms; all rows with a
term are indexed, whole.

A query's bound in a block is the sum of its weights times the largest impacts: no
document of the block scores more. Search goes in three reads of the index. The first
counts the documents that hold the queries' terms. In the second each task scores the
block of the highest bound in each batch of its blocks and sends its ``LEADS`` best
scores a query; the k-th best of all is a threshold that the answer reaches. In the
last each task takes its blocks batch by batch, sorts a batch by a query's bound and
scores it until the bound drops below the threshold or the task's own k-th score. Only
scores that reach the threshold leave a task, at most k a query. A bound equal to the
threshold is still scored, so ties come out by document id.

Queries are held by the driver and broadcast in parts of at most ``QUERY_BYTES`` of
text, each of which reads the index (not the texts) once more. Nothing of the corpus
goes to the driver but one count for each query term and one threshold for each query. Scores are exact: integers of 64 bits.

Defined results: null, empty and blank texts hold no term, count neither in N nor in L
and are never found; very long texts and terms are read whole (one is a block by
itself); rows that repeat a doc_id, or have none, are documents of their own, null ids
after others of equal score; items without terms, or whose terms occur nowhere, find
nothing; items that repeat an item_id are searched each for itself; an empty table of
either kind gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written
from .terms import coded, term_class
from .textscan import Scanner, chunks

#: Documents and terms of a block, scores that a task sends for the threshold, and bytes of the queries that are searched at once.
DOCS, TOKENS, LEADS, QUERY_BYTES = 64, 1 << 16, 5, 4 << 20
#: Rows of the index's row groups: a row has some hundred KB, and a task decodes a row group at once.
GROUP_ROWS = 32
INDEX = "doc_id array<long>, terms array<string>, held binary, most binary, ends binary, term binary, impact binary"
_NAMES = ["doc_id", "terms", "held", "most", "ends", "term", "impact"]


def _lengths(batches):
    scan = Scanner("alnum")
    for b in batches:
        n, total = 0, 0
        for _, _, data, offs in chunks(b.column(0)):
            c = scan.counts(data, offs)
            n, total = n + int((c > 0).sum()), total + int(c.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=["n", "total"])


def lengths(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Documents with a term, and all their terms."""
    r = docs.select(text_col).mapInArrow(_lengths, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return r[0] or 0, r[1] or 0


def norms(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """100 - 25 + 25 * n * docs div total, exact at every size."""
    if 25 * int(n.max(initial=0)) * docs < 1 << 63:
        return 75 + 25 * n * docs // max(total, 1)
    return np.array([75 + 25 * x * docs // total for x in n.tolist()], dtype=np.int64)


def _cuts(n: np.ndarray) -> list[int]:
    """Bounds of blocks over documents with n terms each."""
    out, held = [0], 0
    for i, x in enumerate(n.tolist()):
        if i - out[-1] == DOCS or (held + x > TOKENS and i > out[-1]):
            out.append(i)
            held = 0
        held += x
    return [*out, len(n)]


def _block(ids: pa.Array, n_docs: int, doc: np.ndarray, code: np.ndarray, impact: np.ndarray, words: pa.Array) -> list:
    """One row of the index; postings come document by document."""
    u, term = np.unique(code, return_inverse=True)
    most = np.zeros(len(u), np.int64)
    np.maximum.at(most, term, impact)
    ends = np.searchsorted(doc, np.arange(n_docs), side="right")
    parts = [np.bincount(term, minlength=len(u)).astype("<i4"), most.astype("<i4"), ends.astype("<i4"), term.astype("<i4"), impact.astype("<i4")]
    return [ids, words.take(pa.array(u)), *(x.tobytes() for x in parts)]


def _index(n_docs: int, total: int):
    """Blocks of the texts; columns doc_id, text."""

    def run(batches):
        table = term_class("alnum")
        for b in batches:
            for i, j, data, offs in chunks(b.column(1), 4 << 20):
                first, code, words = coded(data, offs, table)
                n = np.diff(first)
                full = np.flatnonzero(n)
                if not len(full):
                    continue
                ids, n = b.column(0).slice(i, j - i).take(pa.array(full)), n[full]
                v = len(words)
                at, tf = np.unique(np.repeat(np.arange(len(full)), n) * v + code, return_counts=True)
                doc, code = at // v, at % v
                impact = 1_000_000_000 * tf // (1000 * tf + 12 * norms(n, n_docs, total)[doc])
                cuts = _cuts(n)
                bounds = np.searchsorted(doc, cuts)
                rows = [_block(ids.slice(x, y - x), y - x, doc[p:q] - x, code[p:q], impact[p:q], words) for x, y, p, q in zip(cuts, cuts[1:], bounds.tolist(), bounds[1:].tolist(), strict=False)]
                cols = list(zip(*rows, strict=True))
                lists = [pa.array([x.cast(t) for x in c], pa.list_(t)) for c, t in ((cols[0], pa.int64()), (cols[1], pa.string()))]
                yield pa.RecordBatch.from_arrays(lists + [pa.array(c, pa.binary()) for c in cols[2:]], names=_NAMES)

    return run


class Index:
    """Blocks (written) and what all scores need: the number of documents with a term and of all terms."""

    def __init__(self, blocks: DataFrame, docs: int, total: int):
        self.blocks, self.docs, self.total = blocks, docs, total


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    small_batches(docs.sparkSession)
    n, total = lengths(docs, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_index(n, total), INDEX)
    return Index(written(rows, group_rows=GROUP_ROWS), n, total)


class Queries:
    """Terms of queries: ``words``, and for query i the words ``term[first[i]:first[i + 1]]`` with their times there, later their weights."""

    def __init__(self, texts: list):
        rows, seen = [], {}
        table = term_class("alnum")
        for _, _, data, offs in chunks(pa.array(texts, pa.large_string())):
            first, code, words = coded(data, offs, table)
            number = np.array([seen.setdefault(w, len(seen)) for w in words.to_pylist()], dtype=np.int64)
            rows += [np.unique(number[code[a:b]], return_counts=True) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        self.words = pa.array(list(seen), pa.string())
        self.first = np.concatenate([[0], np.cumsum([len(t) for t, _ in rows])]).astype(np.int64)
        self.term = np.concatenate([t for t, _ in rows]) if rows else np.zeros(0, np.int64)
        self.weight = np.concatenate([c for _, c in rows]).astype(np.int64) if rows else np.zeros(0, np.int64)

    def weigh(self, df: np.ndarray, docs: int) -> None:
        w = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * d + 1))) if d else 0 for d in df.tolist()], dtype=np.int64)
        self.weight = self.weight * w[self.term]

    def __len__(self) -> int:
        return len(self.first) - 1

    def numbers(self, terms: pa.Array) -> np.ndarray:
        """The number of each term among ``words``, -1 where it is not there."""
        return pc.fill_null(pc.index_in(terms, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def bounds(self, number: np.ndarray, most: np.ndarray) -> np.ndarray:
        """For each query, the most that a document with these largest impacts can score."""
        top = np.zeros(len(self.words) + 1, np.int64)
        top[number] = most
        top[-1] = 0
        c = np.concatenate([[0], np.cumsum(top[self.term] * self.weight)])
        return c[self.first[1:]] - c[self.first[:-1]]


class Block:
    """Postings of the queries' words in one block."""

    def __init__(self, queries: Queries, number: np.ndarray, ends: bytes, term: bytes, impact: bytes):
        ends, at = np.frombuffer(ends, "<i4"), number[np.frombuffer(term, "<i4")]
        w = np.flatnonzero(at >= 0)
        self.at, self.impact = at[w], np.frombuffer(impact, "<i4")[w].astype(np.int64)
        self.ends = np.searchsorted(w, ends)
        self.queries, self.weight = queries, np.zeros(len(queries.words), np.int64)

    def scores(self, q: int) -> np.ndarray:
        s = slice(self.queries.first[q], self.queries.first[q + 1])
        t = self.queries.term[s]
        self.weight[t] = self.queries.weight[s]
        c = np.concatenate([[0], np.cumsum(self.weight[self.at] * self.impact)])
        self.weight[t] = 0
        return np.diff(c[self.ends], prepend=0)


def _numbered(queries: Queries, column) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all terms of a batch's blocks, and the bounds of the blocks."""
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return queries.numbers(column.flatten()), np.concatenate([[0], np.cumsum(size)])


def _frequencies(queries):
    """(t, df) of the queries' words, summed over a task; columns terms, held."""

    def run(batches):
        qs, df = queries.value, np.zeros(len(queries.value.words) + 1, np.int64)
        for b in batches:
            number, _ = _numbered(qs, b.column(0))
            np.add.at(df, number, np.frombuffer(b"".join(b.column(1).to_pylist()), "<i4"))
        t = np.flatnonzero(df[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(df[t])], names=["t", "df"])

    return run


class Best:
    """The best k of each query so far (score descending, ids ascending, null ids last) and the score that the next must reach."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.k, self.least = k, np.maximum(least, 1)
        none = np.zeros(0, np.int64)
        self.rows = [(none, none, none.astype(bool))] * n
        self.scored = 0

    def add(self, q: int, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        w = score >= self.least[q]
        if not w.any():
            return
        score, ids, null = (np.concatenate([old, new[w]]) for old, new in zip(self.rows[q], (score, ids, null), strict=True))
        o = np.lexsort((ids, null, -score))[: self.k]
        self.rows[q] = score[o], ids[o], null[o]
        if len(o) == self.k:
            self.least[q] = max(self.least[q], score[o[-1]])

    def take(self, qs: Queries, columns, most_blocks: int | None = None) -> None:
        """Blocks of a batch, for each query from its highest bound down, at most so many; columns doc_id, terms, most, ends, term, impact."""
        number, first = _numbered(qs, columns[1])
        parts = [c.to_pylist() for c in columns[2:]]
        at = [slice(x, y) for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        if not at:
            return
        bounds = np.stack([qs.bounds(number[s], np.frombuffer(m, "<i4")) for s, m in zip(at, parts[0], strict=True)], 1)
        ids = [(np.asarray(x.values.fill_null(0)), np.asarray(x.values.is_null())) for x in columns[0]]
        blocks: dict[int, Block] = {}
        for q in np.flatnonzero((bounds >= self.least[:, None]).any(axis=1)).tolist():
            for r in np.argsort(-bounds[q], kind="stable")[:most_blocks].tolist():
                if bounds[q, r] < self.least[q]:
                    break
                if r not in blocks:
                    blocks[r] = Block(qs, number[at[r]], *(p[r] for p in parts[1:]))
                self.add(q, blocks[r].scores(q), *ids[r])
                self.scored += 1


def _answers(queries, k: int, least=None):
    """(q, doc_id, score) of a task's best k for each query; without ``least`` of the best block of each batch only. Columns as Best.take's."""

    def run(batches):
        qs = queries.value
        best = Best(len(qs), k, np.zeros(len(qs), np.int64) if least is None else least.value)
        for b in batches:
            best.take(qs, b.columns, 1 if least is None else None)
        for q, (score, ids, null) in enumerate(best.rows):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), q, np.int64)), pa.array(ids, mask=null), pa.array(score)], names=["q", "doc_id", "score"])

    return run


def _search_part(index: Index, ids: DataFrame, texts: list, k: int) -> DataFrame:
    """Answers (q, doc_id, score, rank) for the queries numbered as in ``texts``."""
    spark, blocks = index.blocks.sparkSession, index.blocks
    qs = Queries(texts)
    share = spark.sparkContext.broadcast
    df = np.zeros(len(qs.words), np.int64)
    for t, n in blocks.select("terms", "held").mapInArrow(_frequencies(share(qs)), "t long, df long").groupBy("t").agg(F.sum("df")).collect():
        df[t] = n  # one row a query term
    qs.weigh(df, index.docs)
    queries = share(qs)
    place = lambda *by: F.row_number().over(Window.partitionBy("q").orderBy(*by))
    rows = blocks.select("doc_id", "terms", "most", "ends", "term", "impact")
    got = rows.mapInArrow(_answers(queries, LEADS), "q long, doc_id long, score long").select("q", "score")
    least = np.zeros(len(qs), np.int64)
    for q, score in got.withColumn("r", place(F.desc("score"))).where(F.col("r") == k).select("q", "score").collect():
        least[q] = score  # one row a query
    out = rows.mapInArrow(_answers(queries, k, share(least)), "q long, doc_id long, score long")
    return out.withColumn("rank", place(F.desc("score"), F.asc_nulls_last("doc_id"))).where(F.col("rank") <= k).join(F.broadcast(ids), "q").drop("q")


def search(index: Index, items: DataFrame, k: int = 20, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item id, rank, doc_id, score): the k best documents of each item with a score above 0."""
    spark = items.sparkSession
    items = items.select(F.col(item_id), F.col(item_text).alias("_text"))
    total = items.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    parts, out = int(total // QUERY_BYTES) + 1, None
    for p in range(parts):
        rows = (items if parts == 1 else items.where(F.pmod(F.xxhash64(*items.columns), F.lit(parts)) == p)).collect()
        ids = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], f"q long, `{item_id}` {items.schema[item_id].dataType.simpleString()}")
        found = _search_part(index, ids, [r[1] for r in rows], k)
        found = found if parts == 1 else written(found)
        out = found if out is None else out.union(found)
    return out.select(item_id, "rank", "doc_id", "score")


def op13_search(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return search(build_index(docs), bench)


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x : x <> '') AS w FROM documents),
s AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n, w FROM d WHERE len(w) > 0),
g AS (SELECT CAST(count(*) AS BIGINT) AS n_all, CAST(sum(n) AS BIGINT) AS l_all FROM s),
i AS (SELECT row_number() OVER () AS q, item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x : x <> '') AS w FROM benchmark),
t AS (SELECT q, item_id, t, count(*) AS times FROM (SELECT q, item_id, unnest(w) AS t FROM i) GROUP BY q, item_id, t),
p AS (SELECT r, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(w) AS t FROM s) WHERE t IN (SELECT t FROM t) GROUP BY r, t),
v AS (SELECT t, CAST(floor(1000 * ln((2 * g.n_all + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY t, g.n_all),
m AS (SELECT r, doc_id, 100 - 25 + ((25 * n * n_all) // l_all) AS m FROM s, g),
c AS (SELECT t.q, t.item_id, m.doc_id, p.r, CAST(sum(t.times * v.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * m.m))) AS BIGINT) AS score
  FROM t JOIN p ON p.t = t.t JOIN v ON v.t = t.t JOIN m ON m.r = p.r GROUP BY t.q, t.item_id, m.doc_id, p.r),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM c WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20
"""
