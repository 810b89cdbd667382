"""Posterior tables: effective sizes of known chains, files read back."""
import numpy as np
import pandas as pd
import pytest

from conftest import SF_SMALL
from glare.plans import bayes, linear, posterior
from glare.plans import studies as S


def chains(rho, n=4000, m=4, seed=0):
    rng = np.random.default_rng(seed)
    x = np.empty((m, n))
    x[:, 0] = rng.normal(size=m)
    for t in range(1, n):
        x[:, t] = rho * x[:, t - 1] + np.sqrt(1 - rho ** 2) * rng.normal(size=m)
    return x


@pytest.mark.parametrize("rho", [0.0, 0.5, 0.9])
def test_effective_size_of_autoregressions(rho):
    x = chains(rho)
    assert posterior.effective_size(x) == pytest.approx(x.size * (1 - rho) / (1 + rho), rel=0.2)


def test_summary_of_a_draws_table(spark):
    x = chains(0.5, n=500)
    rows = [("m", p, c, d, float(v + p)) for p in range(2) for c, row in enumerate(x) for d, v in enumerate(row)]
    df = spark.createDataFrame(rows, "model string, param int, chain int, draw long, value double")
    out = posterior.summarize(df).orderBy("param").collect()
    flat = x.ravel()
    for r in out:
        assert r.mean == pytest.approx(flat.mean() + r.param) and r.sd == pytest.approx(flat.std(ddof=1))
        assert r.ess_bulk == pytest.approx(2000 / 3, rel=0.3) and 0.98 < r.r_hat < 1.05
        assert r.mcse == pytest.approx(r.sd / np.sqrt(2000 / 3), rel=0.2)
    assert out[0].ess_bulk == pytest.approx(out[1].ess_bulk)     # a shift changes no rank


def brute_size(halves):
    """Effective size of sequences of any lengths, lag by lag."""
    n, m = sum(map(len, halves)), len(halves)
    c = [h - h.mean() for h in halves]
    acov = np.array([sum(float(h[:len(h) - t] @ h[t:]) for h in c if len(h) > t) / n for t in range(max(map(len, c)))])
    grand = np.concatenate(halves).mean()
    between = sum(len(h) * (h.mean() - grand) ** 2 for h in halves) / (m - 1) * m / n
    rho = 1 - (acov[0] * n / (n - m) - acov) / (acov[0] + between)
    rho[0], pairs = 1, []
    for t in range(0, len(rho) - 1, 2):
        if rho[t] + rho[t + 1] <= 0:
            break
        pairs.append(min([rho[t] + rho[t + 1], *pairs[-1:]]))
    return n / max(2 * sum(pairs) - 1, 1 / np.log10(n))


def test_ess_of_all_draws_of_unequal_chains(spark):
    from statistics import NormalDist

    tables = {"a": [chains(0.6, n, 1, n)[0] for n in (900, 301, 5, 1)], "b": [chains(0.97, n, 1, n)[0] for n in (700, 150)],
              "ties": [np.round(chains(0.3, n, 1, n)[0]) for n in (64, 333)], "one": [chains(0.2, 200, 1, 7)[0]]}
    rows = [(p, c, d, float(v)) for p, t in tables.items() for c, x in enumerate(t) for d, v in enumerate(x)]
    rows += [("short", 0, d, float(d)) for d in range(7)] + [("equal", 0, d, 0.1) for d in range(90)]
    rows += [("null", 0, d, None if d == 3 else float(d)) for d in range(90)]
    df = spark.createDataFrame(rows, "param string, chain int, draw long, value double").repartition(5)
    out = {r.param: r for r in posterior.ess_table(df, ["param"], rows_per_range=250, block=16).collect()}
    assert set(out) == {*tables, "short", "equal", "null"}
    assert all(out[p].ess_bulk is None and out[p].mcse is None for p in ("short", "equal", "null"))
    for p, t in tables.items():
        x = np.concatenate(t)
        z = np.array([NormalDist().inv_cdf((r - 0.375) / (len(x) + 0.25)) for r in pd.Series(x).rank()])
        halves = lambda v: [h for c in np.split(v, np.cumsum([len(c) for c in t])[:-1])
                            for h in (c[:len(c) // 2], c[len(c) // 2:]) if len(h)]
        assert out[p].ess_bulk == pytest.approx(brute_size(halves(z)), rel=1e-6), p
        assert out[p].mcse == pytest.approx(x.std(ddof=1) / np.sqrt(brute_size(halves(x))), rel=1e-6), p


def test_posterior_file(spark, tmp_path):
    df = spark.createDataFrame(pd.DataFrame({"one": 1.0, "x": np.linspace(-1, 1, 50), "y": np.linspace(-1, 1, 50) * 0.4 + 0.1}))
    post = bayes.bayes_linear(df, ["one", "x"], "y", [1, 1], 1.0, chains=2, draws=300)
    posterior.write_posterior(bayes.posterior_frame(spark, post), str(tmp_path / "p"))
    back = posterior.read_posterior(spark, str(tmp_path / "p"), "linear")
    s = {r.param: r for r in posterior.summarize(back).collect()}
    for i, name in enumerate(post.names):
        assert s[name].mean == pytest.approx(post.draws[..., i].mean())
    assert s["x"].mean == pytest.approx(0.4, abs=0.05)


def test_bundle_file(spark, tmp_path):
    ranked, model = S.attention_holdout(spark, SF_SMALL)
    linear.save_bundle(model, ranked.select("raw_score"), str(tmp_path / "b"))
    again, ref = linear.load_bundle(spark, str(tmp_path / "b"))
    rows = ranked.select("doc_id", *model.features)
    a, b = (linear.score_against_reference(rows, m, r).select("doc_id", "attention_score").orderBy("doc_id").collect()
            for m, r in ((model, ranked.select("raw_score")), (again, ref)))
    assert a == b and len(a) > 0


def test_ranked_coefficients(spark):
    out = [abs(r.coef) for r in S.coefficient_report(spark, SF_SMALL).collect()]
    assert out == sorted(out, reverse=True) and len(out) == len(S.SCORE_FEATURES)
    assert S.coefficient_report(spark, SF_SMALL, 3).count() == 3
