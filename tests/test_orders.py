"""Orders over all rows: ties spread over runs, ranks and prefixes without gaps."""

from pyspark.sql import functions as F

from tessera.operators import select


def test_rows_of_one_score_spread_over_runs(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(20000).select((F.col("id") * 7919 % 20000).alias("id"), F.when(F.col("id") % 5 == 0, F.col("id") % 3).otherwise(0).alias("s"))
        runs = [r["count"] for r in select._runs(df, "s", "id").groupBy("_run").count().collect()]
        assert len(runs) == 4 and max(runs) < 8000
        got = sorted((r["rank"], r["s"], r["id"]) for r in select.ranked(df, "s", "id").collect())
        want = sorted(((r["s"], r["id"]) for r in df.collect()), key=lambda x: (-x[0], x[1]))
        assert got == [(i + 1, *x) for i, x in enumerate(want)]
        spent = {r["id"]: (r["spent"], r["open"]) for r in select.prefix_budget(df.withColumn("w", F.lit(2)), "w", "s", "id", 100).collect()}
        assert all(spent[x[1]] == (2 * i, i < 50) for i, x in enumerate(want))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_null_scores_come_last_and_empty_tables_stay_empty(spark):
    df = spark.createDataFrame([(1, None), (2, 0.0), (3, -1.0), (4, None)], "id long, s double")
    assert {r["id"]: r["rank"] for r in select.ranked(df, "s", "id").collect()} == {2: 1, 3: 2, 1: 3, 4: 4}
    assert select.ranked(df.limit(0), "s", "id").count() == 0
