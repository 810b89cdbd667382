"""Fits from distributed sums against dense numpy algebra and brute force."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from glare.operators.gram import gram, gram_long
from glare.operators import scale
from glare.plans import bayes, linear


@pytest.fixture(scope="module")
def xy(spark):
    rng = np.random.default_rng(11)
    n = 400
    X = rng.normal(size=(n, 3))
    y = 0.5 + X @ np.array([0.8, -0.3, 0.0]) + rng.normal(scale=0.7, size=n)
    z = (rng.random(n) < 1 / (1 + np.exp(-(X @ np.array([1.0, -0.5, 0.2]))))).astype(float)
    w2 = rng.uniform(0.5, 2.0, n)
    pdf = pd.DataFrame({"x0": X[:, 0], "x1": X[:, 1], "x2": X[:, 2], "y": y, "z": z, "w2": w2, "one": 1.0})
    return pdf, spark.createDataFrame(pdf)


def test_gram_both_ways(spark, xy):
    pdf, df = xy
    Z = np.c_[np.ones(len(pdf)), pdf[["x0", "x1", "x2", "y"]].values]
    exp = (Z * pdf.w2.values[:, None]).T @ Z
    for m in ("sql", "arrow"):
        assert np.allclose(gram(df, ["x0", "x1", "x2"], "y", "w2", method=m).m, exp)
    long = gram_long(df, ["x0", "x1", "x2"], "y", "w2").toPandas()
    assert len(long) == 15


def test_ridge_matches_closed_form(spark, xy):
    pdf, df = xy
    X = pdf[["x0", "x1", "x2"]].values
    mu, sd = X.mean(0), X.std(0)
    Zs = (X - mu) / sd
    yc = pdf.y.values - pdf.y.mean()
    exp = np.linalg.solve(Zs.T @ Zs + np.eye(3), Zs.T @ yc)
    m = linear.fit_ridge(df, ["x0", "x1", "x2"], "y", 1.0)
    assert np.allclose(m.coef, exp) and m.intercept == pytest.approx(pdf.y.mean())
    raw = df.select(m.raw_score().alias("r")).toPandas().r.values
    assert np.allclose(raw, pdf.y.mean() + Zs @ exp)


def test_logistic_mode(spark, xy):
    pdf, df = xy
    post = bayes.bayes_logistic(df, ["one", "x0", "x1", "x2"], "z", [2.5, 1, 1, 1])
    X = pdf[["one", "x0", "x1", "x2"]].values
    P = np.diag(1 / np.array([2.5, 1, 1, 1]) ** 2)
    p = 1 / (1 + np.exp(-(X @ post.mean)))
    grad = X.T @ (pdf.z.values - p) - P @ post.mean
    assert np.max(np.abs(grad)) < 1e-6                      # a stationary point of the log posterior
    H = (X * (p * (1 - p))[:, None]).T @ X + P
    assert np.allclose(post.cov, np.linalg.inv(H), rtol=1e-6)


def test_weighted_linear_against_brute_force(spark, xy):
    pdf, df = xy
    xs = ["x0", "x1", "x2"]
    post = bayes.bayes_linear(df, xs, "y", [0.5] * 3, 1.0, w2="w2")
    # brute force: integrate over sigma on a fine grid from the raw rows
    X, y, w2 = pdf[xs].values, pdf.y.values, pdf.w2.values
    P = np.eye(3) / 0.25
    grid = np.linspace(0.3, 1.6, 4001)
    lw, means = [], []
    for s in grid:
        Q = (X * w2[:, None]).T @ X / s ** 2 + P
        b = np.linalg.solve(Q, (X * w2[:, None]).T @ y / s ** 2)
        r = y - X @ b
        # log p(y|s) by completing the square on the rows themselves
        lw.append(-len(y) * np.log(s) - (w2 * r * r).sum() / (2 * s * s) - 0.5 * b @ P @ b
                  - 0.5 * np.linalg.slogdet(Q)[1] - s * s / 2)
        means.append(b)
    lw = np.array(lw)
    w = np.exp(lw - lw.max())
    w /= w.sum()
    assert np.allclose(post.mean[:3], w @ np.array(means), atol=1e-6)
    assert post.mean[3] == pytest.approx(w @ grid, abs=1e-4)


def test_standardize_policies(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, c double")
    out, used = scale.standardize(df, ["a", "c"], ddof=1, zero_policy="replace")
    assert used["c"][1] == 1.0
    assert [r.c for r in out.collect()] == [0.0, 0.0]
    _, used_e = scale.standardize(df, ["c"], ddof=1, zero_policy="epsilon")
    assert used_e["c"][1] == pytest.approx(1e-9)


def test_center_within_means_are_zero(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 10.0), (2, 14.0), (2, 0.0)], "g int, v double")
    c = scale.center_within(df, "g", ["v"]).groupBy("g").agg(F.sum("v").alias("s")).collect()
    assert all(abs(r.s) < 1e-12 for r in c)


def test_rows_with_nulls_do_not_count(spark, xy):
    pdf, df = xy
    more = df.unionByName(df.limit(30).withColumn("x1", F.lit(None).cast("double")))
    a, b = (bayes.bayes_linear(d, ["x0", "x1"], "y", [1, 1], 1.0, w2="w2") for d in (df, more))
    assert a.extra["n"] == b.extra["n"] == len(pdf) and np.allclose(a.mean, b.mean)


def test_few_rows_keep_the_tail_of_sigma(spark):
    df = spark.createDataFrame([(1.0, 0.3), (1.0, -0.9), (1.0, 1.4)], "one double, y double")
    post = bayes.bayes_linear(df, ["one"], "y", [1.0], 2.0)
    y = np.array([0.3, -0.9, 1.4])
    s = np.exp(np.linspace(np.log(1e-3), np.log(40), 20001))
    # marginal of y given s: covariance s^2 I + 11', half-normal prior, log grid
    V = s ** 2
    det, quad = V ** 2 * (V + 3), (y @ y) / V - y.sum() ** 2 / (V * (V + 3))
    lw = -0.5 * np.log(det) - 0.5 * quad - s ** 2 / 8 + np.log(s)
    w = np.exp(lw - lw.max())
    w /= w.sum()
    assert post.mean[1] == pytest.approx(w @ s, rel=1e-3)
    assert post.mean[0] == pytest.approx(w @ (y.sum() / (V + 3)), rel=1e-3)


def test_newton_raises_when_it_has_not_converged(spark, xy):
    with pytest.raises(ValueError):
        bayes.bayes_logistic(xy[1], ["one", "x0"], "z", [2.5, 1], max_iter=1)


def test_hierarchical_against_the_marginal_likelihood(spark):
    """Independent algebra: y has covariance sig^2 I + X C X' with C the prior
    covariance of all effects; the same scale grid is summed point by point."""
    rng = np.random.default_rng(2)
    n, k = 24, 2
    g = np.arange(n) % k
    a, t = rng.normal(size=n), rng.normal(size=n)
    y = np.array([0.5, -0.4])[g] + np.array([0.6, 0.1])[g] * a - 0.3 * t + rng.normal(scale=0.5, size=n)
    pdf = pd.DataFrame({"stratum": [f"s{i}" for i in g], "a": a, "t": t, "y": y})
    grid = (9, 10, 10)
    post = bayes.bayes_hierarchical(bayes.stratum_sums(spark.createDataFrame(pdf), "stratum", "a", "t", "y"), grid=grid)
    X = np.zeros((n, 2 * k + 3))
    X[np.arange(n), 1 + g] = 1
    X[np.arange(n), k + 2 + g] = a
    X[:, -1] = t
    S = np.array([[np.sum(g == s), a[g == s].sum(), t[g == s].sum(), y[g == s].sum(), (a * a)[g == s].sum(), (a * t)[g == s].sum(),
                   (a * y)[g == s].sum(), (t * t)[g == s].sum(), (t * y)[g == s].sum(), (y * y)[g == s].sum()] for s in range(k)])
    G, v, yy, _ = bayes._hier_system(S)
    assert np.allclose(G, X.T @ X) and np.allclose(v, X.T @ y) and yy == pytest.approx(y @ y)
    r = np.linalg.solve(G + np.eye(len(v)) * 1e-6, v)
    shat, half = np.sqrt((yy - 2 * r @ v + r @ G @ r) / n), min(0.95, 7 / np.sqrt(2 * n))
    lw, means = [], []
    for sig in shat * (1 + np.linspace(-half, half, grid[0])):
        for sa in np.exp(np.linspace(np.log(1e-3), np.log(10), grid[1])):
            for sb in np.exp(np.linspace(np.log(1e-3), np.log(5), grid[2])):
                C = np.zeros((2 * k + 3,) * 2)
                C[:k + 1, :k + 1] = 25
                C[k + 1:-1, k + 1:-1] = 1
                C[range(1, k + 1), range(1, k + 1)] += sa ** 2
                C[range(k + 2, 2 * k + 2), range(k + 2, 2 * k + 2)] += sb ** 2
                C[-1, -1] = 4
                V = sig ** 2 * np.eye(n) + X @ C @ X.T
                z = np.linalg.solve(V, y)
                lw.append(-0.5 * np.linalg.slogdet(V)[1] - 0.5 * y @ z - sig ** 2 / 8 - sa ** 2 / 8 - sb ** 2 / 2 + np.log(sa * sb))
                means.append(C @ X.T @ z)
    w = np.exp(np.array(lw) - max(lw))
    w /= w.sum()
    assert np.allclose(post.mean[:2 * k + 3], w @ np.array(means), atol=1e-6)
