"""The block comparison of the n-gram join: sketches sent in rounds, groups listed whole where that is little."""

import numpy as np
import pyarrow as pa

from tessera.llm import ngramjoin
from tessera.llm.common import written


def members(sets, comp, key=7):
    x, bounds = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    n = len(sets)
    cols = [np.full(n, key), np.zeros(n, np.int64), np.arange(n), np.array(comp), np.diff(bounds)]
    return pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), pa.array(ngramjoin._dense(x, bounds)), pa.array(np.zeros(n, bool))], names=["key", "grp", "rid", "comp", "n", "dense", "other"])


def listed(batch, forest):
    out = [(x, y) for b in ngramjoin._filtered(85, 100, forest)([batch]) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    return [p for p in out if p[1] is not None], [x for x, y in out if y is None]


def close(a, b):
    size = min(len(a), len(b))
    blobs = ngramjoin._dense(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    fold = [ngramjoin._fold(d, min(map(len, blobs))) for d in blobs]
    return 85 * max(len(a), len(b)) <= 100 * size and int(np.bitwise_count(fold[0] ^ fold[1]).sum()) * 185 <= (len(a) + len(b)) * 15


def test_groups_with_few_near_pairs_are_listed_whole_at_once():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**63, rng.integers(150, 400), dtype=np.uint64)) for _ in range(60)]
    for i in (5, 9):  # three texts close to each other, of which a forest holds two pairs
        sets[i] = sets[1].copy()
        sets[i][:i] ^= np.uint64(12345)
    want = [(i, j) for i in range(60) for j in range(i + 1, 60) if close(sets[i], sets[j])]
    assert {(1, 5), (1, 9), (5, 9)} <= set(want)
    assert listed(members(sets, range(60)), True) == (want, []) and listed(members(sets, range(60)), False) == (want, [])
    same = [0] * 10 + list(range(10, 60))
    assert listed(members(sets, same), True) == ([p for p in want if p[1] >= 10], [])


def test_groups_with_many_near_pairs_give_a_forest_and_tell():
    base = np.arange(1, 301, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sets = [np.append(base, np.uint64(k)) for k in range(30)]
    got, cut = listed(members(sets, range(30)), True)
    assert len(got) == 29 and cut == [7]
    assert len(listed(members(sets, range(30)), False)[0]) == 30 * 29 // 2


def test_sketches_go_in_rounds(spark):
    groups = written(spark.range(400).selectExpr("id % 40 AS key", "id % 2 AS grp", "id % 25 AS rid", "id AS comp", "false AS other"))
    dense = spark.range(25).selectExpr("id AS rid", "10L AS n", "CAST(repeat('x', 32) AS BINARY) AS dense")
    rounds = ngramjoin._rounds(groups, dense, 32 * 100)
    seen = [{(r["key"], r["grp"]) for r in x.collect()} for x in rounds]
    assert len(rounds) == 4 and sum(x.count() for x in rounds) == 400
    assert sum(map(len, seen)) == len(set().union(*seen)) == 40
    assert len(ngramjoin._rounds(groups, dense, 10**9)) == len(ngramjoin._rounds(groups.limit(0), dense, 0)) == 1


def test_members_get_their_component_before_their_keys(spark, monkeypatch):
    seen, labelled = [], ngramjoin._labelled
    monkeypatch.setattr(ngramjoin, "_labelled", lambda rows, comps: seen.append(rows.columns) or labelled(rows, comps))
    texts = [" ".join(f"w{i % 97 + j}" for j in range(40)) for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts + [t + " x" for t in texts])), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngramjoin.link_components(docs, 4, 85, 100).collect()}
    assert all(got[i] == got[i + 20] for i in range(20))
    assert ["rid"] in seen and ["key", "rid"] not in seen[: seen.index(["rid"]) + 1]


def test_sent_sketches_are_half_as_long_and_lose_no_link():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (3, 100, 400, 401)]
    sets[3][:400] = sets[2][:400]
    whole = members(sets, range(4))
    (thin,) = ngramjoin._thin([pa.RecordBatch.from_arrays([whole.column(i) for i in (2, 4, 5)], names=["rid", "n", "dense"])])
    old, new = whole.column(5).to_pylist(), thin.column(2).to_pylist()
    assert [len(d) for d in new] == [max(32, len(d) // 2) for d in old]
    far = [int(np.bitwise_count(np.frombuffer(d[2], np.uint8) ^ np.frombuffer(d[3], np.uint8)).sum()) for d in (old, new)]
    assert far[1] <= far[0] <= len(np.setxor1d(sets[2], sets[3]))


def test_sets_given_twice_are_compared_once():
    a, b = np.arange(1, 101, dtype=np.uint64), np.arange(1, 100, dtype=np.uint64)
    rows = [(1, 2, 1, a), (1, 2, 1, a), (1, 2, 2, b), (1, 2, 2, b), (1, 3, 1, a), (1, 3, 3, a[:10]), (2, 4, 2, b), (2, 4, 2, b)]
    cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
    batch = pa.RecordBatch.from_arrays([*cols, pa.array([r[3].tobytes() for r in rows], pa.binary())], names=["x", "y", "rid", "set"])
    assert [p for out in ngramjoin._verify(85, 100)([batch]) for p in zip(*(c.to_pylist() for c in out.columns), strict=True)] == [(1, 2)]


def test_small_tables_of_the_join_take_few_tasks(spark):
    from tessera.llm import common

    kept = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        pairs = spark.createDataFrame([(1, 2), (2, 3), (5, 9)], "x long, y long")
        values = spark.createDataFrame([(i, [i]) for i in (1, 2, 3, 5, 9)], "rid long, v array<long>")
        sides = ngramjoin._sides(pairs, values, ["v"])
        assert [tuple(r)[:3] for r in sides.collect()].count((2, 3, 3)) == 1 and sides.count() == 6
        assert sides.rdd.getNumPartitions() == 1
        many = spark.createDataFrame([(7, 1), (7, 3), (7, 5), (8, 5), (8, 9)], "key long, rid long")
        comps = common.components(pairs.select(pairs.x.alias("a"), pairs.y.alias("b")), ngramjoin.EDGES, 3)
        lab, load = ngramjoin._blocks(many, comps)
        assert [(r["key"], r["main"], r["p"]) for r in load.collect()] == [(7, 1, 2.0)] and len(load.inputFiles()) == 1
        assert {tuple(r) for r in ngramjoin._groups(lab, load).select("key", "rid", "comp").collect()} == {(7, 1, 1), (7, 3, 1), (7, 5, 5)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept[0])
        spark.conf.set("spark.sql.adaptive.enabled", kept[1])


def test_the_search_index_is_read_few_rows_at_once(spark):
    import pyarrow.parquet as pq

    from tessera.llm import search

    docs = spark.range(6400).selectExpr("id AS doc_id", "concat('w', id % 50, ' x', id) AS text").coalesce(1)
    index = search.build_index(docs)
    sizes = []
    for f in index.blocks.inputFiles():
        m = pq.ParquetFile(f.removeprefix("file://")).metadata
        sizes += [m.row_group(i).num_rows for i in range(m.num_row_groups)]
    assert sum(sizes) == 100 and max(sizes) <= search.GROUP_ROWS < 100


def test_keys_go_in_rounds(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 900, 60)) for _ in range(12)]
    docs = [(i, base[i % 12].replace(" w1", " v", i % 2) + f" x{i}") for i in range(36)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")

    def run():
        out = ngramjoin.link_components(docs, shingle=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")
        return sorted(map(tuple, out.collect()))

    whole, turns, keys = run(), [], ngramjoin._keys_of_parts
    monkeypatch.setattr(ngramjoin, "LEAST", 8000)
    monkeypatch.setattr(ngramjoin, "_keys_of_parts", lambda num, den, *turn: turns.append(turn) or keys(num, den, *turn))
    assert run() == whole and len({c for _, _, c in whole}) < 36
    n = max(t[0] for t in turns if t)
    assert n > 1 and [t for t in turns if t] == 2 * [(n, k) for k in range(n)]
