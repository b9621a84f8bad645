"""Exact curvature of every edge."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import graphs
from tessera.plans import catalog_graphs


def test_curvature_query_covers_all_edges(spark, monkeypatch):
    n = 45  # a cycle: lazy walks at both ends of an edge are one step apart
    ring = spark.range(n).select(F.least("id", (F.col("id") + 1) % n).alias("src"), F.greatest("id", (F.col("id") + 1) % n).alias("dst"))
    monkeypatch.setattr(catalog_graphs, "_und", lambda *_: (None, ring))
    got = {(r["src"], r["dst"]): r["kappa"] for r in catalog_graphs.ollivier_curvature(spark, "").collect()}
    assert len(got) == n and all(k == pytest.approx(0.0) for k in got.values())
    assert graphs.ollivier(ring, 3).count() == 3
