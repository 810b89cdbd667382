"""Predictive bands and fitted values against dense numpy."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from glare.plans import bands, bayes, fitted


def frame_of_draws(spark, a, b):
    rows = [(p, i % 3, i, float(v)) for p, vs in (("alpha", a), ("slope", b)) for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "param string, chain int, draw long, value double")


@pytest.mark.parametrize("block,chunk", [(7, 3), (64, 1000), (10_000, 2)])
def test_band_equals_numpy(spark, block, chunk):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=211), 3 * rng.normal(size=211)
    a[:80], b[:80] = 0.25, -1.5                                  # one draw repeated
    scores = [None, *rng.random(17).round(2).tolist(), 0.5, 0.5, 0.5, 0.0, 1.0]
    rows = spark.createDataFrame([(i, s, 1.0) for i, s in enumerate(scores)], "id int, score double, p_mean double").drop("p_mean")
    got = bands.with_band(rows, "score", bands.linear_draws(frame_of_draws(spark, a, b), "alpha", "slope"), 0.4,
                          (0.03, 0.5, 0.97, 0.0, 1.0), ("m", "lo", "mid", "hi", "least", "most"), draw_block=block, score_chunk=chunk).collect()
    assert len(got) == len(scores)
    for r in got:
        if r.score is None:
            assert r.m is None and r.hi is None
            continue
        p = 1 / (1 + np.exp(-(a + b * (r.score - 0.4))))
        want = [p.mean(), *np.percentile(p, [3, 50, 97, 0, 100])]
        assert np.allclose([r.m, r.lo, r.mid, r.hi, r.least, r.most], want, atol=1e-12)


def test_one_draw_none_and_incomplete_ones(spark):
    rows = spark.createDataFrame([(1, 0.5), (2, None)], "id int, score double")
    one = bands.linear_draws(frame_of_draws(spark, [0.3], [2.0]), "alpha", "slope")
    r = bands.with_band(rows, "score", one, 0.0).where("id = 1").first()
    assert np.allclose([r.p_mean, r.p_lo, r.p_hi], 1 / (1 + np.exp(-1.3)))
    odd = frame_of_draws(spark, [0.3, float("nan")], [2.0, 1.0]).union(spark.createDataFrame([("alpha", 9, 9, 1.0)], "a string, b int, c long, d double"))
    assert bands.linear_draws(odd, "alpha", "slope").count() == 1
    none = bands.with_band(rows, "score", one.where("false"), 0.0).collect()
    assert len(none) == 2 and all(r.p_mean is None and r.p_lo is None for r in none)
    assert bands.with_band(rows.where("false"), "score", one, 0.0).count() == 0


def test_fitted_values_equal_dense_algebra(spark):
    rng = np.random.default_rng(2)
    strata, n_draws = ["x", "y_z"], 50
    d = {"alpha_s[x]": rng.normal(size=n_draws), "alpha_s[y_z]": rng.normal(size=n_draws), "b_attention_s[x]": rng.normal(size=n_draws),
         "b_attention_s[y_z]": rng.normal(size=n_draws), "b_title_len": rng.normal(size=n_draws), "sigma": rng.random(n_draws) + 0.2,
         "mu_alpha": rng.normal(size=n_draws)}
    draws = spark.createDataFrame([(p, i % 2, i, float(v)) for p, vs in d.items() for i, v in enumerate(vs)],
                                  "param string, chain int, draw long, value double")
    data = [(i, strata[i % 2], float(rng.normal()), float(rng.normal()), float(rng.normal())) for i in range(40)]
    rows = spark.createDataFrame([*data, (90, "unseen", 0.0, 0.0, 1.0), (91, None, 0.0, 0.0, 1.0), (92, "x", None, 0.0, 1.0)],
                                 "id int, stratum string, a double, t double, y double")
    p = fitted.stratum_parameters(draws)
    for few in (10, 0):                                        # broadcast, shuffle
        got = {r.id: r for r in fitted.fitted_values(rows, p, "stratum", "a", "t", "y", few).collect()}
        assert len(got) == 43
        for i, s, a, t, y in data:
            per_draw = d[f"alpha_s[{s}]"] + d[f"b_attention_s[{s}]"] * a + d["b_title_len"] * t
            var = per_draw.var(ddof=1) + (d["sigma"] ** 2).mean()
            r = got[i]
            want = [per_draw.mean(), per_draw.std(ddof=1), np.sqrt(var), y - per_draw.mean(), (y - per_draw.mean()) / np.sqrt(var)]
            assert np.allclose([r.fitted, r.fitted_sd, r.predictive_sd, r.residual, r.z], want)
            assert np.isclose(r.log_density, -0.5 * want[4] ** 2 - np.log(want[2]) - 0.5 * np.log(2 * np.pi))
        assert got[90].fitted is None and got[91].z is None and got[92].residual is None
    report = {r.stratum: r for r in fitted.residual_report(fitted.fitted_values(rows, p, "stratum", "a", "t", "y"), "stratum").collect()}
    mine = [got[i] for i, s, *_ in data if s == "x"]
    assert report["x"].n == len(mine) and np.isclose(report["x"].rmse, np.sqrt(np.mean([r.residual ** 2 for r in mine])))
    assert np.isclose(report["x"].share_inside, np.mean([abs(r.z) <= 1.8807936081512509 for r in mine]))


def test_hierarchical_fit_recovers_its_strata(spark):
    """Fitted values of M8's own draws: residuals centred, bands hold about their mass."""
    rng = np.random.default_rng(5)
    rows = []
    for k, (s, al, be) in enumerate([("p", 1.0, 0.5), ("q", 3.0, -0.5), ("r", 2.0, 1.0)]):
        for i in range(150):
            a, t = rng.normal(size=2)
            rows.append((len(rows), s, float(a), float(t), float(al + be * a + 0.3 * t + 0.7 * rng.normal())))
    df = spark.createDataFrame(rows, "id int, stratum string, a double, t double, y double")
    post = bayes.bayes_hierarchical(bayes.stratum_sums(df, "stratum", "a", "t", "y"), grid=(15, 20, 20))
    f = fitted.fitted_values(df, fitted.stratum_parameters(bayes.posterior_frame(spark, post)), "stratum", "a", "t", "y")
    for r in fitted.residual_report(f, "stratum").collect():
        assert r.n == 150 and abs(r.mean_residual) < 0.1 and 0.6 < r.rmse < 0.8 and r.share_inside > 0.88
