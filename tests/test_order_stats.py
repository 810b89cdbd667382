"""Distributed order statistics against numpy / pandas brute force, on both
the single-range and the multi-range path."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from glare.operators import order_stats as OS


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    n = 3000
    pdf = pd.DataFrame({"g": rng.integers(0, 3, n), "v": np.round(rng.normal(size=n), 2), "id": np.arange(n)})
    return pdf, spark.createDataFrame(pdf)


def hdi(x, m):
    x = np.sort(x)
    n = len(x)
    k = int(np.floor(m * n))
    w = x[k:] - x[: n - k]
    i = int(np.argmin(w))
    return x[i], x[i + k]


@pytest.mark.parametrize("rpr", [10 ** 9, 200])
def test_ranks(spark, data, rpr):
    pdf, df = data
    r = OS.percent_rank_average(df, "v", groups=["g"], rows_per_range=rpr).toPandas().sort_values("id")
    assert np.allclose(r.pct.values, pdf.groupby("g")["v"].rank(pct=True).values, atol=1e-12)
    ref = np.round(np.random.default_rng(3).normal(size=1000), 2)
    r3 = OS.share_below(df, "v", spark.createDataFrame(pd.DataFrame({"w": ref})), "w",
                        rows_per_range=rpr).toPandas().sort_values("id")
    assert np.allclose(r3.pct.values, np.searchsorted(np.sort(ref), r3.v.values) / len(ref))


@pytest.mark.parametrize("rpr", [10 ** 9, 200])
def test_quantiles_and_hdi(spark, data, rpr):
    pdf, df = data
    qs = [0.03, 0.25, 0.5, 0.97]
    q = OS.quantiles(df, "v", qs, groups=["g"], rows_per_range=rpr).toPandas().sort_values(["g", "q"])
    exp = [np.percentile(pdf[pdf.g == g].v, x * 100) for g in range(3) for x in qs]
    assert np.allclose(q.value.values, exp)
    h = OS.hdi(df, "v", ["g"], 0.94, rows_per_range=rpr).toPandas().sort_values("g")
    assert np.allclose(h[["hdi_lo", "hdi_hi"]].values, [hdi(pdf[pdf.g == g].v.values, 0.94) for g in range(3)])


def test_positions_are_a_permutation(spark, data):
    pdf, df = data
    p = OS.positions(df.withColumn("u", F.rand(5)), ["g"], "u", "id", rows_per_range=100).toPandas()
    for g in range(3):
        sub = p[p.g == g].sort_values("u")
        assert list(sub["__pos"]) == list(range(len(sub)))


def test_grouped_plan_has_no_single_partition(spark, data):
    _, df = data
    plan = OS.hdi(df, "v", ["g"], 0.94)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_value_at_meets_no_block_of_runs(spark):
    """Positions are looked up in order, not by pairing a block's runs with its probes."""
    df = spark.createDataFrame([(g, float(v)) for g in "ab" for v in [1, 1, 1, 1, 1, 2, 3, 5, 8, 13]], "g string, v double")
    runs = OS.value_runs(df, ["g"], "v")
    probes = spark.createDataFrame([(g, i) for g in "ab" for i in [0, 4, 5, 9, 9, 10]] + [("c", 0), (None, 0), ("a", None)], "g string, p long")
    out = OS.value_at(runs, probes, ["g"], "p", "v", "x", block=3)
    assert sorted((r.g, r.p, r.x) for r in out.collect()) == [(g, i, x) for g in "ab" for i, x in [(0, 1.0), (4, 1.0), (5, 2.0), (9, 13.0), (9, 13.0)]]
    here = OS.value_at(spark.range(8).selectExpr("'a' g", "id v", "id start", "1L cnt"), probes, ["g"], "p", "v", "x")
    assert "Join" not in here._jdf.queryExecution().optimizedPlan().toString()
