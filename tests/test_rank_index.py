"""Rank index against numpy's searchsorted, and its plan."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from glare.operators import rank_index as R


def column(spark, values, name):
    return spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], f"id int, {name} double")


@pytest.mark.parametrize("leaf,fanout", [(4, 3), (16, 5), (1024, 1024)])
def test_equals_searchsorted(spark, tmp_path, leaf, fanout):
    rng = np.random.default_rng(3)
    ref = np.concatenate([rng.normal(size=300).round(2), np.full(200, 0.25), [1e300, -1e300]])   # a value holds 40 %
    R.write_rank_index(column(spark, [*ref, None, None], "v").repartition(3), "v", str(tmp_path / "i"), leaf, fanout)
    index = R.load_rank_index(spark, str(tmp_path / "i"))
    assert index.n == len(ref) and len(index.nodes) <= fanout
    assert (len(index.levels) > 2) == (leaf < 1024)
    probes = [*ref[:40], *rng.normal(size=200), 0.25, 0.25, float("inf"), float("-inf"), 1e300, -1e300, None]
    got = index.share_below(column(spark, probes, "x").withColumn("node", F.lit(7)), "x", "share").collect()
    assert len(got) == len(probes) and got[0].asDict().keys() == {"id", "x", "node", "share"}
    want = np.searchsorted(np.sort(ref), np.array(probes[:-1]), side="left") / len(ref)
    by_id = {r.id: r.share for r in got}
    assert by_id.pop(len(probes) - 1) is None
    assert np.allclose([by_id[i] for i in range(len(want))], want, atol=0)


def test_small_references(spark, tmp_path):
    probes = column(spark, [0.0, 1.0, 2.0, None], "x")
    for k, ref in enumerate([[], [None], [1.0], [1.0, 1.0]]):
        R.write_rank_index(column(spark, ref, "v"), "v", str(tmp_path / f"{k}"))
        got = [r.s for r in R.load_rank_index(spark, str(tmp_path / f"{k}")).share_below(probes, "x", "s").orderBy("id").collect()]
        assert got == ([None] * 4 if k < 2 else [0.0, 0.0, 1.0, None])


def test_scoring_sorts_no_reference(spark, tmp_path):
    R.write_rank_index(spark.range(5000).select(F.col("id").cast("double").alias("v")), "v", str(tmp_path / "i"), 64, 8)
    out = R.load_rank_index(spark, str(tmp_path / "i")).share_below(spark.range(100).withColumn("x", F.rand(1)), "x", "s")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Window" not in plan and "rangepartitioning" not in plan
    assert plan.count("BroadcastHashJoin") >= 3 and "SortMergeJoin" not in plan


def test_lookup_is_compiled(spark, tmp_path):
    """No step of the search is a lambda, which is interpreted and copies a node's arrays for every row."""
    R.write_rank_index(spark.range(500).select(F.col("id").cast("double").alias("v")), "v", str(tmp_path / "i"), 64, 8)
    out = R.load_rank_index(spark, str(tmp_path / "i")).share_below(spark.range(100).withColumn("x", F.rand(1)), "x", "s")
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
