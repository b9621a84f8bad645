"""The signed-rank query tests every line, not the first two of an order."""

import os

import pandas as pd
import pytest

from tessera.plans import catalog, catalog_scales  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_wilcoxon_takes_all_lines(spark):
    x = pd.read_parquet(f"{SF}/lineitem.parquet")
    a = spark.createDataFrame(x[["l_extendedprice", "l_quantity"]]).selectExpr("round(l_extendedprice / 1000, 1) - round(l_quantity * 1.5, 1) AS d").toPandas()["d"]
    x["d"] = a.to_numpy()
    got = catalog.QUERIES["wilcoxon_signed_rank"](spark, SF).toPandas().set_index("g")
    assert len(got) == x["l_returnflag"].nunique()
    for g, y in x[x["d"] != 0].groupby("l_returnflag"):
        r, n = y["d"].abs().rank(), len(y)
        w = min(r[y["d"] > 0].sum(), r[y["d"] < 0].sum())
        assert got["n"][g] == n and got["w"][g] == pytest.approx(w)
        assert got["z"][g] == pytest.approx((w - n * (n + 1) / 4) / (n * (n + 1) * (2 * n + 1) / 24) ** 0.5, abs=1e-4)
