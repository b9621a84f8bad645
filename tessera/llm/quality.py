"""Quality classifier by importance resampling.

Texts are bags of hashed n-grams: words, pairs of words, runs of punctuation, and pairs
and triples of token shapes (lower case, capitals, digits, the mark itself). A text
counts an n-gram 1 + ln(times), so that one line repeated a thousand times weighs little
more than ten. Two generative models give each bucket a probability: the target model
over labelled good rows (quality 1, toxic 0), the raw model over every document, whose
counts are scaled to those of the target; both get ``PRIOR`` added. Buckets whose numbers
of documents differ by no more than ``SIGMAS`` standard deviations from what the raw
model expects have the same probability in both. A document's weight is the sum, over
its n-grams, of log p_target / p_raw.

Sampling is Gumbel top-k: each document's log weight plus Gumbel noise of its hash; the
k highest are kept. k is the number of documents whose log weight reaches the cut that
parts held-out labelled rows, which the models did not see, with the fewest errors. The
k-th highest is found by nested histograms, without a sort.

At most ``LABELLED`` labelled rows, chosen by hash, fit the target model and the cut;
all counts and scores cover all documents and whole texts. The driver sees at most
``BUCKETS`` counts of each kind, as Arrow columns, and one weight per held-out row.

Defined results: null text counts as empty and weighs 0; labels of one document are
combined (lowest quality, highest toxic); labels with nulls or without a document are
not used; of documents that share a labelled doc_id one is used; without labelled rows
of both kinds everything is kept with weight 0; rows that agree in doc_id and text share
their noise; very long texts are counted whole; an empty table gives an empty result;
input columns of any name are kept but ``log_weight``, ``cut`` and ``kept``, which are
replaced, and names that begin with ``_tessera``, which are reserved.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, written
from .mixing import BITS, thresholds
from .textscan import Scanner, byte_class, chunks, mix64

LABELLED = 40_000
WORD_BITS, PAIR_BITS = 18, 17
BUCKETS = (1 << WORD_BITS) + (1 << PAIR_BITS)
#: Added to the counts of both models, and standard deviations within which they count as equal.
PRIOR, SIGMAS = 0.5, 2.5
_ID, _TEXT = "_tessera_id", "_tessera_text"


class Bags:
    """Counts of the buckets of each text."""

    def __init__(self):
        self.words = Scanner("alnum")
        self.marks = Scanner("alnum", lower=False)
        self.marks.table = ~byte_class("alnum") & byte_class("space")
        b = np.arange(256)
        self.upper, self.lower = (b >= 0x41) & (b <= 0x5A), (b >= 0x61) & (b <= 0x7A)

    def chunk(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, bucket, 1 + ln(times)) of each text and bucket, in order of texts."""
        n = len(offs) - 1
        w, m = self.words.scan(data, offs), self.marks.scan(data, offs)
        wd = np.repeat(np.arange(n), np.diff(w.first))
        md = np.repeat(np.arange(n), np.diff(m.first))
        runs = lambda t: np.concatenate([[0], np.cumsum(t[data])])
        up, low = runs(self.upper), runs(self.lower)
        ups, lows = up[w.end] - up[w.start], low[w.end] - low[w.start]
        shape = np.where((ups > 1) & (lows == 0), 3, np.where(ups > 0, 2, np.where(lows > 0, 1, 0))).astype(np.uint64)
        order = np.argsort(np.concatenate([w.start, m.start]), kind="stable")
        code = np.concatenate([shape, m.hash | np.uint64(8)])[order]
        doc = np.concatenate([wd, md])[order]
        turn = np.uint64(0x9E3779B97F4A7C15)
        two = mix64(code[:-1] * turn + code[1:])
        three = mix64(two[:-1] * turn + code[2:])
        pair, kin, kin3 = wd[1:] == wd[:-1], doc[1:] == doc[:-1], doc[2:] == doc[:-2]
        uni = mix64(np.concatenate([w.hash, m.hash * np.uint64(3), two[kin], three[kin3]])) >> np.uint64(64 - WORD_BITS)
        bi = mix64(w.hash[:-1] * np.uint64(5) + w.hash[1:])[pair] >> np.uint64(64 - PAIR_BITS)
        text = np.concatenate([wd, md, doc[1:][kin], doc[2:][kin3], wd[1:][pair]])
        bucket = np.concatenate([uni, bi + np.uint64(1 << WORD_BITS)]).astype(np.int64)
        both, times = np.unique(text * BUCKETS + bucket, return_counts=True)
        return both // BUCKETS, both % BUCKETS, 1 + np.log(times)


def _count(batches):
    """(kind, bucket, n, mass): documents of each kind with the bucket and their counts of it; bucket -1: documents. Columns text, kind."""
    bags, total = Bags(), {}
    for b in batches:
        kind = np.asarray(b.column(1))
        for i, j, data, offs in chunks(b.column(0)):
            text, bucket, times = bags.chunk(data, offs)
            for k in np.unique(kind[i:j]).tolist():
                docs, mass = total.setdefault(k, (np.zeros(BUCKETS + 1, np.int64), np.zeros(BUCKETS + 1)))
                w = kind[i:j] == k
                at = w[text]
                docs[1:] += np.bincount(bucket[at], minlength=BUCKETS)
                mass[1:] += np.bincount(bucket[at], weights=times[at], minlength=BUCKETS)
                docs[0] += int(w.sum())
    for k, (docs, mass) in total.items():
        at = np.flatnonzero(docs)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(at - 1, pa.int64()), pa.array(docs[at]), pa.array(np.round(mass[at] * 1024).astype(np.int64))], names=["kind", "bucket", "n", "mass"])


def bucket_counts(df: DataFrame) -> DataFrame:
    """df: text, kind; masses are whole 1024ths, so that sums do not depend on their order."""
    part = df.mapInArrow(_count, "kind int, bucket long, n long, mass long")
    return part.groupBy("kind", "bucket").agg(F.sum("n").alias("n"), F.sum("mass").alias("mass"))


def _vectors(counts: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents and mass of each bucket, and documents in all."""
    k, bucket, n, mass = (counts.column(c).to_numpy() for c in ("kind", "bucket", "n", "mass"))
    docs, total = np.zeros(BUCKETS), np.zeros(BUCKETS)
    w = (k == kind) & (bucket >= 0)
    docs[bucket[w]], total[bucket[w]] = n[w], mass[w] / 1024
    return docs, total, int(n[(k == kind) & (bucket < 0)].sum())


def log_ratios(target, raw) -> np.ndarray:
    """log p_target / p_raw of each bucket; each argument: (documents with the bucket, mass, documents)."""
    (dt, ct, nt), (dr, cr, nr) = target, raw
    scaled = cr * (ct.sum() / max(cr.sum(), 1e-9))
    w = np.log((ct + PRIOR) / (scaled + PRIOR))
    expected = dr * (nt / max(nr, 1))
    w[abs(dt - expected) < SIGMAS * np.sqrt(expected + 1)] = 0
    return w.astype(np.float32)


def _scorer(shared, keep: list[str]):
    def run(batches):
        bags, w = Bags(), shared.value
        for b in batches:
            out = []
            for _, _, data, offs in chunks(b.column(_TEXT)):
                text, bucket, times = bags.chunk(data, offs)
                out.append(np.bincount(text, weights=times * w[bucket], minlength=len(offs) - 1))
            s = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(s)], names=[*keep, "log_weight"])

    return run


def best_cut(x: np.ndarray, good: np.ndarray) -> float:
    """The value that parts good rows (at or above) from the others with the fewest errors; the middle one of the widest such gap."""
    o = np.argsort(x, kind="stable")
    v, y = x[o], good[o]
    low = np.concatenate([[0], np.cumsum(y)])  # good rows below the cut
    high = np.concatenate([np.cumsum(~y[::-1])[::-1], [0]])  # others at or above it
    between = np.concatenate([[True], v[1:] > v[:-1], [True]])
    errors = np.where(between, low + high, len(x) + 1)
    at = np.flatnonzero(errors == errors.min())
    edge = np.concatenate([[v[0] - 1], v, [v[-1] + 1]])
    k = at[int(np.argmax(edge[at + 1] - edge[at]))]
    return float((edge[k] + edge[k + 1]) / 2)


def score(docs: DataFrame, labels: DataFrame, keep: list[str], labelled: int = LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``keep`` columns, log_weight and cut of each document; cut is null where no labels tell it."""
    spark = docs.sparkSession
    small_batches(spark)
    y = (F.min("quality") == 1) & (F.max("toxic") == 0)
    lab = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").alias(_ID)).agg(y.alias("good"))
    lab = written(lab.orderBy(F.xxhash64(_ID), _ID).limit(labelled))
    held = F.pmod(F.xxhash64(_ID, F.lit(5)), F.lit(10)) < 3
    mine = docs.select(F.col(id_col).cast("long").alias(_ID), F.col(text_col).alias(_TEXT))
    rows = mine.join(F.broadcast(lab), _ID)  # at most ``labelled`` rows
    rows = rows.groupBy(_ID, "good").agg(F.min(_TEXT).alias(_TEXT))
    kinds = rows.where(~held).select(_TEXT, F.when(F.col("good"), 1).otherwise(2).alias("kind"))
    seen = bucket_counts(kinds).toArrow()
    target, others = _vectors(seen, 1), _vectors(seen, 2)
    w, cut = np.zeros(BUCKETS, np.float32), None
    known = target[2] and others[2]
    if known:
        raw = bucket_counts(mine.select(_TEXT, F.lit(0).alias("kind"))).toArrow()
        w = log_ratios(target, _vectors(raw, 0))
    shared = spark.sparkContext.broadcast(w)
    keep = [c for c in keep if c not in ("log_weight", "cut", "kept")]
    field = T.StructField("log_weight", T.DoubleType())
    run = lambda df, cols: df.mapInArrow(_scorer(shared, cols), T.StructType([df.schema[c] for c in cols] + [field]))
    if known:
        curve = run(rows.where(held).select("good", _TEXT), ["good"]).toArrow()
        x, good = (np.asarray(curve.column(c).combine_chunks()) for c in ("log_weight", "good"))
        if good.any() and not good.all():
            cut = best_cut(x, good.astype(bool))
    out = run(docs.select(*keep, F.col(text_col).alias(_TEXT)), keep)
    return out.withColumn("cut", F.lit(cut).cast("double"))


def gumbel(keys: list[str], seed: int):
    u = (F.shiftrightunsigned(F.xxhash64(*keys, F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def resample(scored: DataFrame, keys: list[str], seed: int = 7) -> DataFrame:
    """``scored`` (written) with ``kept``: Gumbel top-k on log_weight, k the number of rows whose weight reaches the cut."""
    noisy = F.col("log_weight") + gumbel(keys, seed) - F.coalesce("cut", F.lit(0.0))
    h = F.floor((F.lit(0.5) - F.atan(noisy / 8) / F.lit(np.pi)) * F.lit(float(1 << BITS))).cast("long")
    h = F.least(F.greatest(h, F.lit(0)), F.lit((1 << BITS) - 1))
    k = scored.where("cut IS NULL OR log_weight >= cut").count()
    items = written(scored.select(F.lit(0).cast("long").alias("grp"), h.alias("h"), F.lit(1).cast("long").alias("size")))
    budget = scored.sparkSession.range(1).select(F.col("id").alias("grp"), F.lit(float(k)).alias("budget"))
    last = thresholds(items, budget, 1).first()["threshold"]
    return scored.withColumn("kept", h < F.lit(last))


def op8_quality(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.withColumn("_tessera_h", F.xxhash64("text"))
    scored = written(score(rows, labels, ["doc_id", "_tessera_h"]))
    return resample(scored, ["doc_id", "_tessera_h"]).select("doc_id", "log_weight", "cut", "kept")
