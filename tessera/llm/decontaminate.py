"""Benchmark decontamination by winnowing.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z folded. Every
window of ``WINDOW`` hashes of k words keeps its minimum, so two texts that share
``k + WINDOW - 1`` words (ten: five and six) share a fingerprint in that span. The
fingerprints of the test items are a sorted array at hand in every task; around each
matching fingerprint of a document, the ten-word spans that contain it are looked up
among those of the items, and spans that touch grow into one hit. Work is linear in
the words of a document however often it or an item repeats itself. Items of fewer
than ten words are one window each and are found by the hash of the whole item, for
each length that occurs. Equal items are held once.

The join needs no shuffle: documents are scanned where they lie. The test set is
read in blocks of at most ``BLOCK_BYTES`` of text; a larger set takes one more pass a
block, with the table written between two passes, so that a task and the driver hold
one block at a time, and no block is left out.

Defined results: null text has no words; very long texts are scanned whole; an item
without words never occurs; an item with null id marks its words but is not named;
equal items are each named; repeated rows are rows of their own; an empty test set hits
nothing; an empty table gives an empty result; input columns ``n_words``, ``hit_spans``
and ``hit_items`` are replaced, names that begin with ``_tessera`` are reserved.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, written
from .textscan import Scanner, chunks, ngrams

SPAN, K = 10, 5
WINDOW = SPAN - K + 1
BLOCK_BYTES = 32 << 20
_TEXT = "_tessera_text"


def winnow(g: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Positions of g that are the minimum of some valid window; ``valid[i]``: the window that starts at i lies in one text."""
    nw = len(g) - WINDOW + 1
    if nw <= 0:
        return np.zeros(0, np.int64)
    low = g[:nw].copy()
    for j in range(1, WINDOW):
        np.minimum(low, g[j : j + nw], out=low)
    sel = np.zeros(len(g), dtype=bool)
    for j in range(WINDOW):
        sel[j : j + nw] |= (g[j : j + nw] == low) & valid[:nw]
    return np.flatnonzero(sel)


class Index:
    """Fingerprints and spans of the distinct test items; ``names[i]``: the ids of item i."""

    def __init__(self, ids: list[str | None], texts: list[str | None]):
        scan, seen = Scanner("alnum"), {}
        self.names: list[set[str]] = []
        prints, spans, short = [], [], {}
        for i0, _, data, offs in chunks(pa.array(texts, pa.large_string())):
            w = scan.scan(data, offs)
            for r, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
                h = w.hash[a:b]
                if not len(h):
                    continue
                i = seen.setdefault(h.tobytes(), len(seen))
                if i == len(self.names):
                    self.names.append(set())
                    if len(h) < SPAN:
                        short.setdefault(len(h), []).append((int(ngrams(h, len(h))[0]), i))
                    else:
                        g = ngrams(h, K)
                        prints.append(np.unique(g[winnow(g, np.ones(len(g), bool))]))
                        s = np.unique(ngrams(h, SPAN))
                        spans.append((s, np.full(len(s), i, np.int32)))
                if ids[i0 + r] is not None:
                    self.names[i].add(ids[i0 + r])
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64)
        s = np.concatenate([x for x, _ in spans]) if spans else np.zeros(0, np.uint64)
        items = np.concatenate([y for _, y in spans]) if spans else np.zeros(0, np.int32)
        o = np.argsort(s, kind="stable")
        self.spans, self.items = s[o], items[o]
        self.short = {}
        for n, rows in short.items():
            rows.sort()
            self.short[n] = (np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64))

    def hits(self, h: np.ndarray, doc: np.ndarray, first: np.ndarray) -> tuple[dict[int, list[tuple[int, int]]], dict[int, set[int]]]:
        """Hit spans (first word, last word + 1) and items of each text that has any; h: word hashes of consecutive texts, doc: text of each word."""
        out: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[int]] = {}

        def add(at, n, lo, hi, of):
            """Spans of n words at ``at``, whose items are of[lo:hi]."""
            d = doc[at]
            cut = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (at[1:] > at[:-1] + n)))
            ends = np.append(cut[1:], len(at)) - 1
            for k, a, b in zip(d[cut].tolist(), at[cut].tolist(), (at[ends] + n).tolist(), strict=True):
                out.setdefault(k, []).append((a - int(first[k]), b - int(first[k])))
            pairs = np.unique(np.stack([d, lo, hi], 1), axis=0)
            for k, a, b in pairs.tolist():
                items.setdefault(k, set()).update(of[a:b].tolist())

        def found(keys, g):
            lo = np.searchsorted(keys, g, side="left")
            ok = lo < len(keys)
            ok[ok] = keys[lo[ok]] == g[ok]
            return ok, lo

        if len(self.prints) and len(h) >= SPAN:
            g = ngrams(h, K)
            valid = doc[: len(h) - SPAN + 1] == doc[SPAN - 1 :]
            p = winnow(g, valid)
            p = p[found(self.prints, g[p])[0]]
            near = np.zeros(len(valid), dtype=bool)  # spans that contain a matching fingerprint
            for j in range(WINDOW):
                at = p - j
                near[at[(at >= 0) & (at < len(near))]] = True
            at = np.flatnonzero(near & valid)
            if len(at):
                s = ngrams(h, SPAN)[at]
                ok, lo = found(self.spans, s)
                at, lo, s = at[ok], lo[ok], s[ok]
                if len(at):
                    add(at, SPAN, lo, np.searchsorted(self.spans, s, side="right"), self.items)
        for n, (keys, of) in self.short.items():
            if len(h) < n:
                continue
            g = ngrams(h, n)
            ok, lo = found(keys, g)
            ok &= doc[: len(g)] == doc[n - 1 :]
            p = np.flatnonzero(ok)
            if len(p):
                add(p, n, lo[p], np.searchsorted(keys, g[p], side="right"), of)
        return out, items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``keep`` columns, n_words, hit_spans (word ranges, merged and in order) and hit_items (sorted ids) of each document."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = int(total // BLOCK_BYTES) + 1
    keep = [c for c in keep if c not in ("n_words", "hit_spans", "hit_items")]
    added = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", SPANS), T.StructField("hit_items", T.ArrayType(T.StringType()))]
    none = F.array().cast(SPANS), F.array().cast("array<string>")
    df = docs.select(*keep, F.col(text_col).alias(_TEXT), F.lit(0).cast("long").alias("n_words"), none[0].alias("hit_spans"), none[1].alias("hit_items"))
    for k in range(n_blocks):
        part = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)) == k)
        rows = part.collect()
        index = spark.sparkContext.broadcast(Index([r[0] for r in rows], [r[1] for r in rows]))
        last = k == n_blocks - 1
        carried = keep if last else [*keep, _TEXT]
        schema = T.StructType([df.schema[c] for c in carried] + added)
        df = df.mapInArrow(_scan_with(index, carried), schema)
        if not last:
            df = written(df)
            index.unpersist()
    return df


def _scan_with(index, carried: list[str]):
    def run(batches):
        ix, scan = index.value, Scanner("alnum")
        for b in batches:
            n_words, spans, items = [], [], []
            old = b.column("hit_spans").to_pylist(), b.column("hit_items").to_pylist()
            for i, j, data, offs in chunks(b.column(_TEXT)):
                w = scan.scan(data, offs)
                size = np.diff(w.first)
                n_words += size.tolist()
                hit, named = ix.hits(w.hash, np.repeat(np.arange(j - i), size), w.first)
                for d in range(j - i):
                    s, t = old[0][i + d], old[1][i + d]
                    if d in hit:
                        s = [{"start": x, "end": y} for x, y in _merged([(x["start"], x["end"]) for x in s] + hit[d])]
                        t = sorted(set(t).union(*(ix.names[x] for x in named[d])))
                    spans.append(s)
                    items.append(t)
            cols = [pa.array(n_words, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carried), *cols], names=[*carried, "n_words", "hit_spans", "hit_items"])

    return run


def op9_decontamination(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = find_leaks(docs, bench, ["doc_id"])
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


OP9_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x : x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x : x <> '') AS w FROM benchmark),
iwin AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS p FROM iw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM iwin),
dwin AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM dw, lens WHERE len(w) >= n)),
m AS (SELECT doc_id, p, dwin.n, item_id FROM dwin JOIN iwin ON dwin.win = iwin.win AND dwin.n = iwin.n),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM m) WHERE id IS NOT NULL GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN h ON dw.doc_id = h.doc_id LEFT JOIN i ON dw.doc_id = i.doc_id
"""
