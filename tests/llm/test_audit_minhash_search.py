"""Source audit, MinHash near-duplicates and ranked search against brute force, with nulls, empty and long texts, ties, repeats, clashes and empty tables."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import audit, minhash, search

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, value long, row long, score long, term string"


def docs_of(spark, rows):
    """rows: (doc_id, text, lang, source); the other columns clash with names of the results."""
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, "x") for r in rows], SCHEMA)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    v = ["".join(rng.choice("abcdefgéß") for _ in range(rng.randint(1, 5))) for _ in range(50)]
    base = [" ".join(rng.choice(v) for _ in range(rng.randint(1, 90))) for _ in range(60)]
    near = []
    for t in base[:20]:
        for k in (1, 1, 2, 6):
            w = t.split()
            for _ in range(k):
                w[rng.randrange(len(w))] = rng.choice(v)
            near.append(" ".join(w))
    long = " ".join(rng.choice(v) for _ in range(20_000))
    return base + near + [None, "", " \t\n", "12 34 56", "One  two", long, long + " z", base[0].upper(), base[1], base[1]]


def placed(texts):
    rng = random.Random(4)
    return [(i, t, rng.choice(["en", "en", "de", None, ""]), rng.choice(["a", "a", "b", None, "é"])) for i, t in enumerate(texts)]


# --- 11 ---


def audited(rows, least, top):
    rows = [(lower(t), l or "", s or "") for _, t, l, s in rows]
    out = set()
    for lang in {r[1] for r in rows}:
        mine = [(Counter(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t)), s) for t, l, s in rows if l == lang]
        df = Counter(x for c, _ in mine for x in c)
        kept = [t for t in df if df[t] >= least]
        sources = sorted({s for _, s in mine}, key=str.encode)
        n = {s: Counter() for s in sources}
        for c, s in mine:
            n[s].update({t: c[t] for t in kept if c[t]})
        n[None] = sum((n[s] for s in sources), Counter())
        p = {s: {t: 1 + 10**9 * (n[s][t] + 2) // (sum(n[s].values()) + 2 * len(kept)) for t in kept} for s in n}
        f = lambda a, b, t: (p[a][t] - p[b][t]) ** 2 // (p[a][t] + p[b][t])
        for s in sources:
            pair = [(-sum(f(s, o, t) for t in kept), o.encode()) for o in sources if o != s]
            term = [(-f(s, None, t), t.encode()) for t in kept if n[s][t] and p[s][t] > p[None][t]]
            for part, found, k in (("pair", pair, len(pair)), ("term", term, top)):
                out |= {(lang, s, part, x.decode(), -y, i + 1) for i, (y, x) in enumerate(sorted(found)[:k])}
    return out


@pytest.mark.parametrize("least,top", [(10, 10), (1, 3), (10_000, 10)])
def test_divergence_equals_brute_force(spark, texts, least, top):
    rows = placed(texts)
    rows += rows[:9] + [(None, "abc abc", "en", "b"), (3, "x", "xx", "only"), (4, None, "yy", "q"), (5, "a", "yy", "r")]
    got = audit.divergence(docs_of(spark, rows).repartition(5), least, top).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == audited(rows, least, top)


def test_divergence_of_an_empty_table(spark):
    out = audit.divergence(docs_of(spark, [(1, "a", "en", "b")]).where("doc_id < 0"))
    assert out.count() == 0 and out.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_share_is_exact_for_large_counts(spark):
    rows = [(c, d) for c in (0, 1, 10**12 + 7, 4 * 10**15) for d in (4 * 10**15 + 3, 5 * 10**15, 8 * 10**15) if c + 2 <= d]
    got = audit.with_share(spark.createDataFrame(rows, "c long, d long"), "c", "d", "p").collect()
    assert len(got) == len(rows) and all(r["p"] == 1 + 10**9 * (r["c"] + 2) // r["d"] for r in got)


# --- 12 ---


def shingles(t, k):
    w = re.findall("[^\x20\x09-\x0d]+", lower(t))
    return {" ".join(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def linked(texts, k, num, den):
    sets, up = [shingles(t, k) for t in texts], list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            up[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("k,num", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, texts, k, num):
    d = docs_of(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    got = minhash.near_duplicates(d.repartition(5), shingle=k, num=num).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == linked(texts, k, num, 100)
    assert len(got) == len(texts) and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_in_large_buckets(spark, monkeypatch):
    """Members of one bucket that lie in several components: chains whose ends do not link, and near misses."""
    monkeypatch.setattr(minhash, "PLAIN", 3)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for _ in range(40):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(80)] = f"n{rng.randrange(10**6)}"
        rows.append(" ".join(w))
    got = minhash.near_duplicates(docs_of(spark, [(i, t, "en", "a") for i, t in enumerate(rows)]), shingle=3, num=85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == linked(rows, 3, 85, 100)


def test_near_duplicates_of_repeats_null_ids_and_empty_tables(spark):
    t = "a b c d e f g h"
    rows = [(7, t, "en", "a"), (7, t, "en", "a"), (None, t, "en", "a"), (9, None, "en", "a"), (None, "", "en", "a")]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs_of(spark, rows)).collect()), key=str)
    assert got == sorted([(7, 4, 7, True), (7, 4, 7, True), (None, 4, 7, False), (9, 0, 9, True), (None, 0, None, True)], key=str)
    assert minhash.near_duplicates(docs_of(spark, rows).where("doc_id < 0")).count() == 0


def test_sketches_keep_linked_sets_and_tell_others():
    n, limit = minhash.bands(0.85), minhash.sketch_limit(0.85, minhash.bands(0.85) * minhash.ROWS)
    assert (1 - 0.85**minhash.ROWS) ** n < minhash.MISS
    rng = np.random.default_rng(5)
    factors = minhash.multipliers(n * minhash.ROWS)
    far = {0.85: [], 0.4: []}
    for size in (30, 300, 3000):
        for s in far:
            for _ in range(20):
                both = round(size * s)
                u = rng.integers(0, 1 << 64, size, dtype=np.uint64)
                a, b = np.sort(u[: both + (size - both) // 2]), np.sort(np.concatenate([u[:both], u[both + (size - both) // 2 :]]))
                x, bounds = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
                odd = minhash.odd_sketches(minhash.samples(x, bounds, factors)).view(np.uint64)
                far[s].append(int(np.bitwise_count(odd[0] ^ odd[1]).sum()))
                fine = minhash.fine_sketches(x, bounds).view(np.uint64)
                most = minhash.fine_limit(85, 100, np.array([len(a)]), np.array([len(b)]))[0]
                if 100 * both >= 85 * size:
                    assert np.bitwise_count(fine[0] ^ fine[1]).sum() <= most
    assert max(far[0.85]) <= limit < min(far[0.4])


# --- 13 ---


def ranked(docs, items, k):
    terms = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower(t))
    d = [(i, Counter(terms(t))) for i, t in docs]
    d = [(i, c) for i, c in d if c]
    n, total, df = len(d), sum(sum(c.values()) for _, c in d), Counter(t for _, c in d for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in d:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(x for x in scores if x[0] < 0)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("k,docs,leads", [(20, 64, 5), (3, 4, 1), (500, 7, 5)])
def test_search_equals_brute_force(spark, texts, monkeypatch, k, docs, leads):
    monkeypatch.setattr(search, "DOCS", docs)
    monkeypatch.setattr(search, "LEADS", leads)
    rows = list(enumerate(texts)) + [(None, texts[0]), (5, texts[5])]
    items = [("p", texts[3]), ("q", "nowhere at all 12"), ("q", texts[4].upper()), (None, texts[1] + " " + texts[1]), ("e", ""), ("n", None)]
    d = docs_of(spark, [(i, t, "en", "a") for i, t in rows]).repartition(3)
    b = spark.createDataFrame(items, "item_id string, text string").withColumn("score", F.lit(1))
    got = search.search(search.build_index(d), b, k).collect()
    assert sorted((tuple(r) for r in got), key=str) == ranked(rows, items, k)


def test_search_in_parts_and_empty_tables(spark, texts, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BYTES", 300)
    rows, items = list(enumerate(texts)), [(i, t) for i, t in enumerate(texts[:12])]
    d, b = docs_of(spark, [(i, t, "en", "a") for i, t in rows]), spark.createDataFrame(items, "item_id long, text string")
    index = search.build_index(d)
    assert sorted((tuple(r) for r in search.search(index, b, 5).collect()), key=str) == ranked(rows, items, 5)
    assert search.search(index, b.limit(0)).count() == 0
    assert search.search(search.build_index(d.where("doc_id < 0")), b).count() == 0


def test_blocks_below_the_threshold_are_not_scored(monkeypatch):
    monkeypatch.setattr(search, "DOCS", 2)
    docs = ["rare word here", "rare rare word"] + ["word other"] * 40
    run = list(search._index(len(docs), 86)([pa.RecordBatch.from_arrays([pa.array(range(len(docs))), pa.array(docs)], names=["doc_id", "text"])]))
    qs = search.Queries(["rare word"])
    qs.weigh(np.array([2 if w == "rare" else 42 for w in qs.words.to_pylist()]), len(docs))
    best = search.Best(1, 2, np.zeros(1, np.int64))
    for b in run:
        best.take(qs, b.columns[:2] + b.columns[3:])
    assert best.scored == 1 and best.rows[0][1].tolist() == [1, 0]


def test_norms_beyond_64_bits():
    n = np.array([1, 10**9])
    assert search.norms(n, 10**11, 10**13).tolist() == [75 + 25 * x * 10**11 // 10**13 for x in (1, 10**9)]
