"""The pipeline's stages against what each should keep, on a small corpus with planted cases."""

import random

import pytest

import corpus_pipeline
from tessera.llm import queries


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(1)
    v = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    line = lambda n: " ".join(rng.choice(v) for _ in range(n))
    bench = [line(30) for _ in range(6)]
    texts = {}
    for i in range(360):
        t = line(rng.randint(30, 90))
        if i % 9 == 0:
            t = " ".join(w + "###" for w in t.split())
        elif i % 9 == 1:
            t += " scum loser trash"
        texts[i] = t
    for k, i in enumerate((2, 11, 20)):
        texts[400 + k] = texts[i].upper()
        texts[500 + k] = texts[i] + " extra"
    for k in range(4):
        texts[600 + k] = f"{line(20)} {bench[k]} {line(20)}"
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 9 != 0), int(i % 9 == 1)) for i in range(360) if i // 9 % 2], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts


def test_stages_keep_what_they_should(spark, corpus):
    path, texts = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, ids, steps = docs.columns, set(texts), {}
    for name, f in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(f(spark, docs, path))
        if name != "sharding":
            assert out.columns == columns
        steps[name] = [r["doc_id"] for r in out.select("doc_id").collect()]
        docs = out
    clean = {i for i in ids if i >= 360 or i % 9 > 1}
    got = set(steps["quality_classifier"])
    assert got <= ids and len(clean - got) <= 4 and len(got - clean) <= 6
    near = set(steps["ngram_jaccard_join"])
    assert near == got - {i for i in range(400, 600) if i in got and {400: 2, 401: 11, 402: 20}[400 + i % 100] in got}
    assert set(steps["benchmark_decontamination"]) == near - set(range(600, 604))
    assert set(steps["source_mixing"]) <= set(steps["benchmark_decontamination"])
    assert sorted(steps["sharding"]) == sorted(steps["source_mixing"])
    rows = docs.collect()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_run_gives_the_last_stage(spark, corpus):
    out = corpus_pipeline.run(spark, corpus[0])
    assert out.columns[-2:] == ["shard", "slot"] and out.count() > 100


def test_queries_are_registered():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 11)}
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_near_duplicates_keep_one_row_whatever_the_ids(spark, corpus):
    rng = random.Random(4)
    w, v, u = (" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40)) for _ in range(3))
    rows = [(1, w, 9), (1, w, 9), (2, v, 9), (2, w + " x", 9), (None, u, 9), (None, u, 9), (3, None, 9), (3, "", 9)]
    docs = corpus_pipeline.written(spark.createDataFrame(rows, "doc_id long, text string, row int").repartition(3))
    out = corpus_pipeline.drop_near_duplicates(spark, docs, corpus[0])
    corpus_pipeline.end_scope()
    assert out.columns == docs.columns
    got = sorted((str(r["doc_id"]), r["text"] or "") for r in out.collect())
    assert [i for i, _ in got] == ["1", "2", "3", "3", "None"] and {t for _, t in got} == {w, v, u, ""}


def test_stages_take_nulls_repeats_extra_columns_and_nothing(spark, corpus):
    path, _ = corpus
    extra = ["times", "threshold", "good", "kept", "n_words", "hit_spans", "comp", "row", "_c", "copies"]
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(60)
    odd = docs.limit(1).withColumn("text", docs["text"].substr(1, 0)).union(docs.limit(1).selectExpr("cast(null as long)", "cast(null as string)", "lang", "cast(null as string)", "n_chars"))
    docs = docs.union(docs.limit(3)).union(odd)
    docs = corpus_pipeline.written(docs.selectExpr("*", *[f"'x' AS {c}" for c in extra]))
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, path)
        assert out.columns == docs.columns + ["shard", "slot"] * (name == "sharding")
        assert out.where("times <> 'x' OR kept <> 'x'").count() == 0
        assert f(spark, docs.where("n_chars < 0"), path).count() == 0
    corpus_pipeline.end_scope()


def test_near_duplicates_leave_rows_where_few_stay(spark, corpus, monkeypatch):
    """Rows whose numbers are few are not shuffled for the last join."""
    monkeypatch.setattr(corpus_pipeline.ngramjoin, "link_components", lambda named, **_: named.selectExpr("doc_id", "_tessera_row AS row", "1L AS n_shingles", "doc_id % 3 AS comp"))
    docs = spark.createDataFrame([(i, f"text {i}", "en", "a", 6) for i in range(9)], "doc_id long, text string, lang string, source string, n_chars long")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = corpus_pipeline.drop_near_duplicates(spark, docs, corpus[0])
        assert sorted(r["doc_id"] for r in out.collect()) == [0, 1, 2]
        assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_near_duplicates_do_not_write_the_texts_again(spark, corpus, monkeypatch):
    docs = corpus_pipeline.written(spark.createDataFrame([(i // 2, f"one two three four five six {i // 2}") for i in range(40)], "doc_id long, text string").repartition(3))
    wrote, keep = [], corpus_pipeline.written
    monkeypatch.setattr(corpus_pipeline, "written", lambda df: wrote.append(df.columns) or keep(df))
    rows = corpus_pipeline.numbered(docs)
    assert rows.columns == [*docs.columns, "_tessera_row"] and rows.select("_tessera_row").distinct().count() == 40
    out = corpus_pipeline.drop_near_duplicates(spark, docs, corpus[0])
    assert out.count() == 20 and not any("_tessera_own_text" in c for c in wrote)
    assert corpus_pipeline.numbered(docs.union(docs)).select("_tessera_row").distinct().count() == 80  # not just a table in files
    corpus_pipeline.end_scope()
