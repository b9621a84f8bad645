"""The ten operators against brute force on small tables, with nulls, empty and very long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, common, decontaminate, exactdedup, htmltext, licenses, mixing, ngramjoin, quality, sharding, textscan, tokenout

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, hit_items string"


def docs_of(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["a"] * len(texts))[i], len(t or ""), 7, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def vocabulary(seed, n=60):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 6))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng, v = random.Random(3), vocabulary(1)
    base = [" ".join(rng.choice(v) for _ in range(rng.randint(1, 120))) for _ in range(60)]
    near = []
    for t in base[:25]:
        for k in (1, 2, 5):
            w = t.split()
            for _ in range(k):
                w[rng.randrange(len(w))] = rng.choice(v)
            near.append(" ".join(w))
    odd = [None, "", " \t\n", "one", "One  two\n three", " ".join(rng.choice(v) for _ in range(20_000)), "a b   c", base[0], base[0].upper(), base[1].replace(" ", "\n"), base[2] + " "]
    return base + near + odd + base[3:6]


def split_words(t, pattern="[^\x20\x09-\x0D]+"):
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


ALNUM = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


# --- scanning ---


@pytest.mark.parametrize("kind,pattern", [("space", "[^\x20\x09-\x0D]+"), ("alnum", ALNUM)])
def test_scanner_finds_the_words(texts, kind, pattern):
    seen = {}
    scan = textscan.Scanner(kind)
    at = 0
    for i, j, data, offs in textscan.chunks(pa.array(texts), size=500):
        w = scan.scan(data, offs)
        for k in range(j - i):
            want = split_words(texts[i + k], pattern)
            got = w.hash[w.first[k] : w.first[k + 1]].tolist()
            assert len(got) == len(want)
            for a, b in zip(want, got, strict=True):
                assert seen.setdefault(a, b) == b
        at = j
    assert at == len(texts)
    assert len(set(seen.values())) == len(seen)


def test_components_are_the_smallest_ids(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)]
    par = {}

    def find(x):
        while par.setdefault(x, x) != x:
            x = par[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        par[max(p, q)] = min(p, q)
    got = {r["id"]: r["comp"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: find(x) for e in edges for x in e}
    assert {k: v for k, v in want.items() if k in got} == got
    assert all(find(k) == k for k in want if k not in got)


# --- 1 ---


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


def test_token_files_round_trip(spark, texts, tmp_path):
    path, tok = tokenizer()
    more = [*texts, "<|endoftext|> it's 12 34", "hi <|endoftext|> x", "a<|endoftext|>", "<|endoftext|", "after them", "　a b", "a  b", "x" * 3000 + " y"]
    d = docs_of(spark, more).repartition(5)
    files = tokenout.write_tokens(d, path, f"file://{tmp_path}/t", file_tokens=4000, least_tokens=100)
    assert files.count() > 2
    rows = {r["doc_id"]: r for r in tokenout.read_tokens(spark, f"file://{tmp_path}/t", files, with_ids=True).collect()}
    at = 0
    for i, t in enumerate(more):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        r = rows[i]
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["start"] == at
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert len(rows) == len(more)
    blocks = sum(1 for r in files.collect() for _ in tokenout.read_blocks(*_opened(r["path"]), np.zeros(60000, np.uint32)))
    assert blocks >= files.count()


def _opened(path):
    from pyarrow import fs

    return fs.LocalFileSystem(), path


def test_token_files_of_an_empty_table_and_repeats(spark, tmp_path):
    path, _ = tokenizer()
    empty = docs_of(spark, ["x"]).where("doc_id < 0")
    files = tokenout.write_tokens(empty, path, f"file://{tmp_path}/e")
    assert tokenout.read_tokens(spark, f"file://{tmp_path}/e", files).count() == 0
    d = docs_of(spark, ["a b", "c"])
    twice = d.union(d).union(d.withColumn("doc_id", F.lit(None).cast("long")))
    files = tokenout.write_tokens(twice, path, f"file://{tmp_path}/r")
    got = tokenout.read_tokens(spark, f"file://{tmp_path}/r", files).collect()
    assert sorted(r["start"] for r in got)[0] == 0 and len(got) == 6 and sum(r["doc_id"] is None for r in got) == 2


def test_variable_length_code_of_all_sizes():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 1 << b, n) for b, n in ((4, 0), (8, 1), (9, 2), (17, 3), (25, 4), (31, 7), (16, 1001))]
    coded = [tokenout.encode_ranks(d) for d in docs]
    c = np.frombuffer(b"".join(x for x, _ in coded), np.uint8)
    b = np.frombuffer(b"".join(y for _, y in coded), np.uint8)
    out = tokenout.decode_ranks(c, b, np.array([len(d) for d in docs]))
    assert out.tolist() == np.concatenate(docs).tolist()


def test_encoder_when_its_table_is_full(monkeypatch, texts):
    path, tok = tokenizer()
    monkeypatch.setattr(tokenout, "POOL", 500)
    monkeypatch.setattr(tokenout, "SLOTS", 64)
    enc = tokenout.Encoder(path, 2)
    for _ in range(2):
        got = []
        for _, _, ids, n in enc.encode(pa.array(texts)):
            ends = np.cumsum(n)
            got += [ids[e - k : e].tolist() for e, k in zip(ends, n, strict=True)]
        assert got == [[*tok.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


# --- 2 ---


def water_fill(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(full.values())
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if t[s] > cap * sizes[s]]
        if not over:
            return full | t
        full |= {s: cap * sizes[s] for s in over}


def test_mixing_meets_targets(spark, texts):
    rng = random.Random(8)
    many = [" ".join(["w"] * rng.randint(0, 40)) for _ in range(600)] + texts
    sources = [rng.choice(["b", "a", "z", "é", None, "hot", "hot", "hot", "hot"]) for _ in many]
    d = docs_of(spark, many, sources)
    sizes = mixing.sized(d, ["doc_id"])
    plan, n = mixing.plan_mix(sizes)
    rows = mixing.taken(sizes, plan, n).withColumnRenamed("keep_doc_id", "doc_id").collect()
    assert {r["doc_id"]: r["size"] for r in rows} == {i: len(split_words(t)) for i, t in enumerate(many)}
    total, took, target, biggest = {}, {}, {}, {}
    for r in rows:
        s = r["source"]
        total[s] = total.get(s, 0) + r["size"]
        took[s] = took.get(s, 0) + r["copies"] * r["size"]
        target[s] = r["target"]
        biggest[s] = max(biggest.get(s, 0), r["size"])
        assert 0 <= r["copies"] <= 2
    want = water_fill(total)
    for s in total:
        assert target[s] == pytest.approx(want[s]) and abs(took[s] - target[s]) <= biggest[s]
    again = mixing.taken(mixing.sized(d.repartition(3), ["doc_id"]), plan, n).withColumnRenamed("keep_doc_id", "doc_id").collect()
    assert sorted((r["doc_id"], r["copies"]) for r in rows) == sorted((r["doc_id"], r["copies"]) for r in again)
    out = mixing.mix(d)
    assert out.columns == d.columns and out.count() == sum(r["copies"] for r in rows)


def test_mixing_of_an_empty_table_and_of_equal_hashes(spark):
    d = docs_of(spark, ["a b c"])
    assert mixing.mix(d.where("doc_id < 0")).count() == 0
    same = d.union(d).union(d)
    assert 4 <= mixing.mix(same).count() <= 5  # nine words, of which 13.5 are taken
    assert mixing.mix(docs_of(spark, [None, ""])).count() == 2  # a source without words is taken whole, once


def test_mixing_draws_rows_without_ids_one_by_one(spark):
    rng = random.Random(10)
    texts = [" ".join(["w"] * rng.randint(1, 20)) for _ in range(300)]
    d = docs_of(spark, texts, [("hot", "b", "hot")[i % 3] for i in range(300)]).withColumn("doc_id", F.when(F.col("source") == "b", F.col("doc_id")))
    sizes = mixing.sized(d, ["doc_id"])
    plan, n = mixing.plan_mix(sizes)
    rows = mixing.taken(sizes, plan, n).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("took"), F.max("target").alias("target")).collect()
    assert len(rows) == 2 and all(abs(r["took"] - r["target"]) <= 20 for r in rows)


def test_mixing_with_clashing_columns(spark):
    d = docs_of(spark, ["a b", "c d e"]).withColumns({c: F.lit(1) for c in ("times", "threshold", "size", "h", "grp", "target", "_c", "_source", "_ord", "keep_text")})
    out = mixing.mix(d)
    assert out.columns == d.columns and out.where("times = 1 AND _ord = 1 AND grp = 1").count() == out.count() > 0


# --- 3 ---


def test_sharding_is_exact_and_repeatable(spark, texts):
    d = docs_of(spark, texts).repartition(6, "doc_id")
    out = sharding.shuffle_into_shards(d.union(d), 7, block_rows=5)
    rows = out.collect()
    n = 2 * len(texts)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(by) == list(range(7)) and len(rows) == n
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots))) and len(slots) in (n // 7, n // 7 + 1)
    assert out.columns == [c for c in d.columns if c != "shard"] + ["shard", "slot"]
    src = spark.read.parquet(common.written(d).inputFiles()[0].rpartition("/")[0])
    one, two = (sorted((r["doc_id"], r["shard"], r["slot"]) for r in sharding.shuffle_into_shards(src, 7).collect()) for _ in range(2))
    assert one == two
    assert sharding.shuffle_into_shards(d.where("doc_id < 0"), 7).count() == 0


def test_communication_matrix_has_its_margins_and_spread():
    sizes, shards = [0, 5, 1000, 37, 1], [209, 209, 209, 208, 208]
    m = list(sharding.communication_matrix(sizes, shards, 1))
    assert [sum(r) for r in m] == sizes and [sum(c) for c in zip(*m, strict=True)] == shards
    mean = np.mean([next(sharding.communication_matrix([50, 50], [60, 40], s))[0] for s in range(400)])
    assert abs(mean - 30) < 1


def test_inverted_hypergeometric_has_the_same_law():
    rng = np.random.default_rng(1)
    good, bad, draws = 70, 50, 30
    lo, hi = max(0, draws - bad), min(draws, good)
    got = np.array([sharding._inverted(rng, good, bad, draws, lo, hi) for _ in range(6000)])
    want = np.random.default_rng(2).hypergeometric(good, bad, draws, 6000)
    a, b = (np.bincount(x, minlength=31) for x in (got, want))
    assert abs(got.mean() - want.mean()) < 0.15 and abs(got.std() - want.std()) < 0.15 and abs(np.cumsum(a - b)).max() < 250
    big = [sharding._hypergeometric(rng, 3 * 10**9, 10**9, 2 * 10**9) for _ in range(50)]
    assert abs(np.mean(big) - 1.5 * 10**9) < 20_000 and 5_000 < np.std(big) < 30_000


def test_copies_share_a_shard_only_by_chance(spark):
    one = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    d = common.written(one.union(one).repartition(4, "doc_id"))
    out = sharding.shuffle_into_shards(d, 40)
    pairs = out.groupBy("doc_id").agg(F.countDistinct("shard").alias("n")).where("n = 1").count()
    assert 15 <= pairs <= 95  # 50 of 2000 by chance
    seen = out.groupBy("shard", "doc_id").count().groupBy("shard").count().collect()
    assert len(seen) == 40


# --- 4 ---


def test_license_windows_find_what_brute_force_finds(spark):
    rng, v = random.Random(4), vocabulary(2)
    pad = lambda n: " ".join(rng.choice(v) for _ in range(n))
    lists = []
    for _, t in licenses.TEMPLATES:
        w = t.split()
        lists.append(f"{pad(rng.randrange(40))} {t} {pad(rng.randrange(40))}")
        if len(w) > 40:
            for k in (1, 2):
                x = list(w)
                for _ in range(k):
                    x[rng.randrange(len(x))] = "changed"
                lists.append(f"{pad(rng.randrange(300))}\n{' '.join(x)}\n{pad(30)}")
            lists.append(" ".join(w[: len(w) // 2]))
    lists += [None, "", "All rights", "all RIGHTS, reserved", pad(5000), pad(20_000) + " Released under the MIT License."]
    got = {r["doc_id"]: {x["license"] for x in r["licenses"]} for r in licenses.scan_licenses(docs_of(spark, lists), ["doc_id"]).collect()}

    def grams(t):
        w = split_words(t, ALNUM)
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    for i, t in enumerate(lists):
        best = {}
        g, words = grams(t), split_words(t, ALNUM)
        for name, tpl in licenses.TEMPLATES:
            s, w = set(grams(tpl)), split_words(tpl, ALNUM)
            if len(w) < 5:
                hit = [(k, k + len(w)) for k in range(len(words) - len(w) + 1) if words[k : k + len(w)] == w]
                found = (1.0, *hit[0]) if hit else None
            else:
                at = [k for k, x in enumerate(g) if x in s]
                share = len({g[k] for k in at}) / len(s) if at else 0
                found = (share, at[0], at[-1] + 5) if share >= 0.8 else None
            if found and found[0] > best.get(name, (0,))[0]:
                best[name] = found
        want = {n for n, (s, a, b) in best.items() if not any(x > s and c < b and a < e for x, c, e in best.values())}
        assert got[i] == want, (i, t[:80] if t else t)


def test_license_result_does_not_depend_on_neighbours(spark):
    rng, v = random.Random(14), vocabulary(2)
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 300).split()
    texts = []
    for _ in range(60):
        w = list(mit)
        for _ in range(rng.randint(2, 4)):
            w[rng.randrange(len(w))] = "changed"
        w.insert(rng.randrange(len(w)), "inserted")
        texts.append(" ".join(rng.choice(v) for _ in range(rng.randrange(50))) + " " + " ".join(w))
    want = None
    for k in (1, 7, 60):
        d = docs_of(spark, [" ".join(rng.choice(v) for _ in range(k)), *texts]).where("doc_id > 0" if k == 1 else "true").repartition(k)
        got = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(d, ["doc_id"]).where("doc_id > 0").collect()}
        assert want is None or got == want
        want = got
    assert sum(bool(x) for x in want.values()) > 20
    rows = licenses.scan_licenses(docs_of(spark, texts[:2]).union(docs_of(spark, texts[:2])), ["doc_id"]).collect()
    assert len(rows) == 4 and licenses.scan_licenses(docs_of(spark, ["x"]).where("doc_id < 0"), ["doc_id"]).count() == 0


@pytest.mark.parametrize("m", [64, 100, 128, 1024])
def test_license_containment_is_exact_wherever_the_copy_stands(spark, m):
    rng, v = random.Random(m), vocabulary(6, 4000)
    body = [rng.choice(v) for _ in range(m + 4)]
    template = {tuple(body[i : i + 5]) for i in range(m)}
    filler = [f"filler{k}" for k in range(3 * m)]
    texts, want = [], []
    for k in range(24):
        w = list(body)
        at = rng.randrange(len(w))
        w[at:at] = [f"inserted{x}" for x in range(m // 8)]
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = "changed"
        words = filler[: k * m // 8] + w + filler[: rng.randrange(m)]
        if k % 6 == 5:  # the two halves too far apart
            words = body[: m // 2] + filler[: 2 * m] + body[m // 2 :]
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        held = max(len(template & set(grams[i : i + 2 * m])) for i in range(max(1, len(grams) - 2 * m + 1)))
        texts.append(" ".join(words))
        want.append(held / len(template) if held / len(template) >= 0.8 else None)
    found = licenses.scan_licenses(docs_of(spark, texts), ["doc_id"], templates=[("one", " ".join(body))])
    got = {r["doc_id"]: [x["containment"] for x in r["licenses"]] for r in found.collect()}
    assert [got[i][0] if got[i] else None for i in range(24)] == want
    assert sum(x is not None for x in want) > 12 and None in want


def test_densest_span_equals_all_spans():
    rng = random.Random(3)
    for _ in range(300):
        m = rng.randrange(1, 12)
        n = rng.randrange(1, 60)
        at = sorted(rng.sample(range(80), n))
        key = [rng.randrange(m) for _ in at]
        share, a, b = licenses._densest(np.array(at), np.array(key, dtype=np.uint64), m)
        held = {p: {k for q, k in zip(at, key, strict=True) if p <= q < p + 2 * m} for p in at}
        most = max(len(x) for x in held.values())
        if len(set(key)) >= 0.8 * m:
            assert share == most / m and a == min(p for p in at if len(held[p]) == most) and b == max(q for q in at if q < a + 2 * m)
        else:
            assert share == 0


def test_license_column_of_the_input_is_replaced_and_ties_go_to_the_first(spark):
    body = " ".join(f"word{k}" for k in range(40))
    df = docs_of(spark, [f"{body} between them {' '.join(f'gap{k}' for k in range(100))} {body}", None]).withColumn("licenses", F.lit("own"))
    r = licenses.scan_licenses(df, df.columns, templates=[("a", body), ("b", body)]).orderBy("doc_id").collect()
    assert [(x["license"], x["containment"], x["start"], x["end"]) for x in r[0]["licenses"]] == [("a", 1.0, 0, 40), ("b", 1.0, 0, 40)] and r[1]["licenses"] == []


def test_license_templates_of_a_table(spark):
    v = vocabulary(4, 300)
    rng = random.Random(2)
    body = " ".join(rng.choice(v) for _ in range(3000))
    table = spark.createDataFrame([("Own-1.0", body), (None, "x"), ("Y", None)], "license string, text string")
    got = licenses.scan_licenses(docs_of(spark, [f"one two {body} three", "none of it"]), ["doc_id"], templates=table).collect()
    assert {r["doc_id"]: [x["license"] for x in r["licenses"]] for r in got} == {0: ["Own-1.0"], 1: []}


# --- 5 ---


def brute_components(texts, k, num, den):
    sets = []
    for t in texts:
        w = split_words(t)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    par = list(range(len(texts)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and den * n >= num * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                par[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (5, 80, 100), (1, 50, 100)])
def test_jaccard_join_loses_no_link(spark, texts, k, num, den):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.link_components(docs_of(spark, texts), k, num, den).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, k, num, den)


@pytest.mark.parametrize("hot", [False, True])
def test_jaccard_join_with_large_buckets(spark, monkeypatch, hot):
    rng, v = random.Random(9), vocabulary(3, 400)
    common_part = " ".join(rng.choice(v) for _ in range(30))
    base = " ".join(rng.choice(v) for _ in range(60))
    many = []
    for _ in range(70):
        w = base.split()
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(v)
        many.append(" ".join(w))
    many += [f"{common_part} {' '.join(rng.choice(v) for _ in range(rng.randint(2, 10)))}" for _ in range(70)]
    monkeypatch.setattr(ngramjoin, "PLAIN", 3)
    monkeypatch.setattr(ngramjoin, "FILTERED", 40)
    monkeypatch.setattr(ngramjoin, "HELD", 20)
    monkeypatch.setattr(ngramjoin, "BLOCK", 10)
    monkeypatch.setattr(ngramjoin, "FOLD", 32)
    if hot:
        monkeypatch.setattr(ngramjoin, "SAMPLE", 1)
        monkeypatch.setattr(ngramjoin, "HOT", 3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.link_components(docs_of(spark, many), 4, 85, 100).collect()}
    assert [got[i] for i in range(len(many))] == brute_components(many, 4, 85, 100)


def test_jaccard_join_of_repeats_nulls_and_nothing(spark):
    d = docs_of(spark, ["a b c d e f", None, "a b c d e f", ""])
    rows = d.union(d).union(d.withColumn("doc_id", F.lit(None).cast("long")))
    out = ngramjoin.link_components(rows, 4, 85, 100).collect()
    assert len(out) == 12
    assert {r["component_id"] for r in out if r["n_shingles"]} == {0} and len({r["row"] for r in out}) == 12
    assert len({r["comp"] for r in out if r["n_shingles"]}) == 1 and {r["comp"] for r in out if not r["n_shingles"]} == {None}
    assert ngramjoin.link_components(d.where("doc_id < 0")).count() == 0


# --- 6 ---

PAGES = [
    ("<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>T &amp; U</h1><p>First <b>bold</b>\n  text here.<p>Er.<p>Another paragraph of some length follows here.</article><footer>&copy; x</footer>", "T & U\nFirst bold text here.\nEr.\nAnother paragraph of some length follows here."),
    ("<div id=menu><a href=/a>One</a> <a href=/b>Two</a></div><h1>Title of it</h1><p>Words of the first paragraph which is long enough to be read.</p><!-- <p>no</p> --><script>var a='<p>x</p>'</script><style>p{}</style><p>Second one, with a <a href=/x>link</a> inside of it.</p><div class='comments'><p>I do not agree with any of this at all.</p></div>", "Title of it\nWords of the first paragraph which is long enough to be read.\nSecond one, with a link inside of it."),
    ("<article><p>Kept text is here.</p><aside><p>A box beside the article with words.</p></aside><section class=comments><p>A reader says something.</p></section><p>All rights reserved.</p></article>", "Kept text is here.\nAll rights reserved."),
    ("<div id=content class='post has-sidebar'><h2>Head of it</h2><p>Body of the post with enough words in it.</p></div><article class='comment'><p>Someone writes a comment under the post.</p></article><div class=sidebar-left><p>Side words here for you.</p></div>", "Head of it\nBody of the post with enough words in it."),
    ("<form id=aspnetForm><h1>The title</h1><p>Some words of the article that are long enough.</p><p>More of them.</p></form>", "The title\nSome words of the article that are long enough.\nMore of them."),
    ("<div class='layout-social'><article><h1>The title</h1><p>Some words of the article that are long enough.</p></article></div>", "The title\nSome words of the article that are long enough."),
    ("<div class='news-alert-story'><h1>The title</h1><p>Some words of the article that are long enough.</p><p>More of them.</p></div>", "The title\nSome words of the article that are long enough.\nMore of them."),
    ("<nav><ul><li><a href=/>Home</a></li></ul><article><h1>The title</h1><p>Some words of the article that are long enough.</p></article>", "The title\nSome words of the article that are long enough."),
    ("<article><h1>The title</h1><p>Some words of the article that are long enough.</p></article><aside><article><h3>Another story</h3></article></aside><div class=comments><article><p>" + "A reader says no. " * 30 + "</p></article></div>", "The title\nSome words of the article that are long enough."),
    (None, ""), ("", ""), ("<p", ""), ("<article>no end <b>at all", "no end at all"), ("<article><p>a &lt;p&gt; b &#233;&nbsp;c</p></article>", "a <p> b é c"),
]


def test_html_extraction_of_templates(spark):
    rows = [(i, "u", h, "old") for i, (h, _) in enumerate(PAGES)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in htmltext.extract(d, ["page_id", "text"]).collect()}
    assert [got[i] for i in range(len(PAGES))] == [w for _, w in PAGES]
    twice = htmltext.extract(d.union(d), ["page_id"]).collect()
    assert len(twice) == 2 * len(PAGES) and all(r["text"] == got[r["page_id"]] for r in twice)
    assert htmltext.extract(d.where("page_id < 0"), ["page_id"]).count() == 0


def test_html_tree_on_held_out_pages():
    tree = htmltext.trained()
    right = total = 0
    for page, good in htmltext.labelled_table(60, seed=99):
        bs = htmltext.blocks(page)
        hit = htmltext.predict(tree, htmltext.features(bs))
        right += sum(bool(h) == (b[0] in good) for h, b in zip(hit, bs, strict=True))
        total += len(bs)
    assert right / total > 0.97


def test_html_of_a_very_long_page():
    page = "<article>" + "<p>word word word.</p>" * 50_000 + "<" * 1000 + "</article>"
    assert len(htmltext.blocks(page)) >= 50_000
    assert htmltext.blocks("<div>" * 100_000 + "</section>" * 100_000 + "x")[0][0] == "x"


# --- 7 ---


def test_chat_keeps_maximal_conversations(spark):
    rng = random.Random(6)
    convs = {}
    for c in range(30):
        convs[c] = [(("user", "assistant")[k % 2], rng.choice(["hi", "yes", "no", None, ""])) for k in range(rng.randint(1, 6))]
    for c in range(30, 60):
        src = convs[rng.randrange(30)]
        convs[c] = src[: rng.randint(1, len(src))]
    rows = [(c, k, r, t, 1) for c, turns in convs.items() for k, (r, t) in enumerate(turns)] + [(None, 0, "user", "x", 1)]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int")
    got = {r["conv_id"]: (r["n_turns"], r["n_equal"], r["text"]) for r in chat.render(d).collect()}
    plain = {c: tuple((r or "", t or "") for r, t in turns) for c, turns in convs.items()}
    want = {}
    for c, t in plain.items():
        longer = any(len(o) > len(t) and o[: len(t)] == t for o in plain.values())
        equal = [o for o in plain if plain[o] == t]
        if not longer and min(equal) == c:
            want[c] = (len(t), len(equal), "".join(f"<|{r}|>\n{x}\n" for r, x in t))
    assert got == want
    assert chat.render(d.where("conv_id < 0")).count() == 0


def test_chat_of_long_turns_repeats_and_nulls(spark):
    long = "word " * 200_000
    rows = [(1, 0, "user", long), (2, 0, "user", long), (2, 1, "assistant", "yes"), (3, 0, "user", "q"), (3, 0, "user", "q"), (4, None, None, None)]
    out = {r["conv_id"]: r for r in chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert 1 not in out and out[2]["n_turns"] == 2 and len(out[2]["text"]) > 1_000_000 and 3 in out


# --- 8 ---


def test_quality_keeps_clean_and_drops_junk(spark):
    rng, v = random.Random(7), vocabulary(5, 200)
    texts, quality_, toxic = [], [], []
    for i in range(900):
        w = [rng.choice(v) for _ in range(rng.randint(20, 80))]
        kind = i % 6
        q, x = 1, 0
        if kind == 0:
            w, q = [a + "%%%" for a in w], 0
        elif kind == 1:
            w, x = [*w, "worthless", "scum"], 1
        texts.append(" ".join(w))
        quality_.append(q)
        toxic.append(x)
    d = docs_of(spark, [*texts, None, ""])
    lab = spark.createDataFrame([(i, quality_[i], toxic[i], "x") for i in range(900) if i // 6 % 2] + [(None, 1, 0, "x"), (5000, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")
    scored = common.written(quality.score(d, lab.drop("text"), ["doc_id"]))
    kept = {r["doc_id"]: r["kept"] for r in quality.resample(scored, ["doc_id"]).collect()}
    held = [i for i in range(900) if i // 6 % 2 == 0]
    clean = [i for i in held if quality_[i] == 1 and toxic[i] == 0]
    bad = [i for i in held if i not in set(clean)]
    assert np.mean([kept[i] for i in clean]) > 0.99 and np.mean([kept[i] for i in bad]) < 0.05
    assert len(kept) == 902
    none = common.written(quality.score(d, lab.where("doc_id < 0").drop("text"), ["doc_id"]))
    assert all(r["kept"] for r in quality.resample(none, ["doc_id"]).collect())
    assert quality.score(d.where("doc_id < 0"), lab.drop("text"), ["doc_id"]).count() == 0


def test_resampling_is_gumbel_top_k(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), ((F.col("id") % 100 - 40) / 50.0).alias("log_weight"), F.lit(0.3).alias("cut"))
    scored = common.written(rows)
    out = quality.resample(scored, ["doc_id"]).withColumn("g", F.col("log_weight") + quality.gumbel(["doc_id"], 7)).collect()
    k = sum(r["log_weight"] >= 0.3 for r in out)
    best = {r["doc_id"] for r in sorted(out, key=lambda r: -r["g"])[:k]}
    assert {r["doc_id"] for r in out if r["kept"]} == best


def test_quality_weights_equal_a_plain_sum(spark):
    rng, v = random.Random(17), vocabulary(6, 40)
    texts = [" ".join(rng.choice(v) for _ in range(rng.randint(1, 60))) + rng.choice(["", "!!", " (Ab) 12", " XY?"]) for _ in range(300)] + [None, "", "one " * 5000]
    lab = [(i, int(i % 3 > 0), 0) for i in range(0, 300, 2)]
    d = docs_of(spark, texts)
    got = {r["doc_id"]: r["log_weight"] for r in quality.score(d, spark.createDataFrame(lab, "doc_id long, quality int, toxic int"), ["doc_id"]).collect()}
    held = {r[0] for r in spark.createDataFrame(lab, "id long, q int, t int").where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(10)) < 3).collect()}
    bags = quality.Bags()

    def bag(t):
        data = np.frombuffer((t or "").encode(), np.uint8)
        _, bucket, times = bags.chunk(data, np.array([0, len(data)]))
        return dict(zip(bucket.tolist(), times.tolist(), strict=True))

    each = [bag(t) for t in texts]
    fit = [i for i, q, _ in lab if q and i not in held]

    def model(ids):
        n, mass = {}, {}
        for i in ids:
            for b, x in each[i].items():
                n[b], mass[b] = n.get(b, 0) + 1, mass.get(b, 0) + x
        return n, mass

    (dt, ct), (dr, cr) = model(fit), model(range(len(texts)))
    scale = sum(ct.values()) / sum(cr.values())
    for i, b in enumerate(each):
        want = 0.0
        for g, x in b.items():
            expected = dr[g] * len(fit) / len(texts)
            if abs(dt.get(g, 0) - expected) >= quality.SIGMAS * (expected + 1) ** 0.5:
                want += x * np.log((ct.get(g, 0) + quality.PRIOR) / (cr[g] * scale + quality.PRIOR))
        assert got[i] == pytest.approx(want, rel=1e-3, abs=0.02 * (1 + len(b)) ** 0.5)


def test_quality_with_clashing_columns_repeats_and_long_texts(spark):
    v = vocabulary(5, 50)
    d = docs_of(spark, ["a b c"] * 3 + [" ".join(v * 2000), None]).withColumns({c: F.lit(1) for c in ("good", "kept", "cut", "log_weight", "quality", "kind", "bucket")})
    lab = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (0, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.score(d.union(d), lab, ["doc_id", "good", "kept", "kind"])
    assert out.columns == ["doc_id", "good", "kind", "log_weight", "cut"] and out.count() == 10


# --- 9 ---


def test_winnowing_finds_every_shared_window(spark, texts):
    rng = random.Random(12)
    items = [t for t in texts if t and 0 < len(t) < 2000][:20]
    items = [" ".join(t.split()[:60]) for t in items] + ["abc", "b", "c d", None, "", "??", "a b c d e f g h i", items[0], "x y z w v u t s r q"]
    docs = list(texts)
    for _ in range(40):
        it = rng.choice([i for i in items if i])
        w = it.split()
        a = rng.randrange(len(w))
        docs.append(f"{rng.choice(texts[:40])} {' '.join(w[a : a + rng.randint(1, 30)]).upper()}; {rng.choice(texts[:40])}")
    d = docs_of(spark, docs)
    b = spark.createDataFrame([(i if i != 3 else None, t) for i, t in enumerate(items)], "item_id long, text string")
    rows = {r["doc_id"]: r for r in decontaminate.find_leaks(d, b, ["doc_id", "hit_items"]).collect()}
    wins = []
    for i, t in enumerate(items):
        w = split_words(t, ALNUM)
        n = min(10, len(w))
        wins.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set())
    for i, t in enumerate(docs):
        w = split_words(t, ALNUM)
        hit, names = set(), set()
        for k, ws in enumerate(wins):
            for n in {len(x) for x in ws}:
                for p in range(len(w) - n + 1):
                    if tuple(w[p : p + n]) in ws:
                        hit |= set(range(p, p + n))
                        names.add(k)
        r = rows[i]
        marked = {x for s in r["hit_spans"] for x in range(s["start"], s["end"])}
        assert marked == hit and r["n_words"] == len(w)
        assert r["hit_items"] == sorted(str(k) for k in names if k != 3)


def test_winnowing_in_blocks_equals_one_pass(spark, texts, monkeypatch):
    d = docs_of(spark, texts[:80])
    b = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:30])], "item_id long, text string")
    one = sorted(map(str, decontaminate.find_leaks(d, b, ["doc_id"]).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2000)
    assert sorted(map(str, decontaminate.find_leaks(d, b, ["doc_id"]).collect())) == one
    assert decontaminate.find_leaks(d, b.where("item_id < 0"), ["doc_id"]).where("size(hit_spans) > 0").count() == 0
    assert decontaminate.find_leaks(d.where("doc_id < 0"), b, ["doc_id"]).count() == 0


def test_winnowing_of_repeated_words_is_linear(spark):
    import time

    def seconds(n):
        ix = decontaminate.Index(["i"], ["a " * n])
        h = np.full(2 * n, textscan.Scanner("alnum").scan(np.frombuffer(b"a", np.uint8), np.array([0, 1])).hash[0])
        t = time.perf_counter()
        hit, named = ix.hits(h, np.zeros(2 * n, np.int64), np.array([0, 2 * n]))
        assert decontaminate._merged(hit[0]) == [(0, 2 * n)] and named[0] == {0}
        return time.perf_counter() - t

    assert seconds(200_000) < 5


# --- 10 ---


@pytest.mark.parametrize("hot", [1000, 3])
def test_content_sort_equals_grouping(spark, texts, hot):
    many = [*texts, *["same  text\n here"] * 20, *["same text here"] * 5]
    rows = {r["doc_id"]: r for r in exactdedup.content_sort(docs_of(spark, many).repartition(5), hot_rows=hot).collect()}
    groups = {}
    for i, t in enumerate(many):
        groups.setdefault(re.sub("[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    for n, ids in groups.items():
        for i in ids:
            r = rows[i]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (ids[0], len(ids), i == ids[0])
            assert r["text_sha256"] == hashlib.sha256(n.encode()).hexdigest()
    assert len(rows) == len(many)


def test_content_sort_of_repeated_ids(spark):
    d = docs_of(spark, ["same"] * 40 + ["b"]).withColumn("doc_id", F.col("doc_id") % 2)
    out = exactdedup.content_sort(d.repartition(4), hot_rows=3).collect()
    same = [r for r in out if r["group_size"] == 40]
    assert len(out) == 41 and len(same) == 40 and {r["keep_id"] for r in same} == {0} and sum(r["kept"] for r in same) == 20


def test_content_sort_of_null_ids_and_nothing(spark):
    d = docs_of(spark, ["a", "a", None, ""])
    out = exactdedup.content_sort(d.withColumn("doc_id", F.when(F.col("doc_id") != 0, F.col("doc_id")))).collect()
    assert {r["keep_id"] for r in out if r["text_sha256"] == hashlib.sha256(b"a").hexdigest()} == {1}
    assert exactdedup.content_sort(d.where("n_chars < 0")).count() == 0


def test_normalising_only_odd_runs_equals_normalising_all(spark, texts):
    d = docs_of(spark, texts)
    both = d.select(exactdedup.normalised().alias("a"), F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ").alias("b"))
    assert both.where("a <> b").count() == 0
