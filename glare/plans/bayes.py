"""Bayesian regressions fitted from distributed sums (M5-M9), no MCMC.

The study samples its posteriors with NUTS on one machine. Here the data pass
is a Spark aggregate (a Gram matrix, or per-stratum sums, or one
gradient/Hessian aggregate per Newton step); only that small summary reaches
the driver, where the posterior is computed exactly (Gaussian blocks
integrated analytically over a grid of scale parameters) or by a Laplace
approximation (logistic models). Posterior draws, when wanted for intervals,
are generated from that closed form with a seeded generator.

Conjugate block (fixed sigma), for prior beta ~ N(0, P^-1) and noise sd
sigma / w_i:  Q = G / sigma^2 + P,  r = v / sigma^2,  beta | sigma ~ N(Q^-1 r, Q^-1),

    log p(y | sigma) = -n log sigma - s / (2 sigma^2) + 1/2 log|P| - 1/2 log|Q| + 1/2 r'Q^-1 r
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.gram import gram


@dataclass
class Posterior:
    """Named parameters with exact moments and seeded draws (chain, draw, k)."""

    model: str
    names: list[str]
    mean: np.ndarray
    cov: np.ndarray
    draws: np.ndarray                      # (chains, draws, k)
    extra: dict = field(default_factory=dict)

    def sd(self) -> np.ndarray:
        return np.sqrt(np.clip(np.diag(self.cov), 0, None))


def hdi_np(x: np.ndarray, mass: float) -> tuple[float, float]:
    """Shortest interval holding ``mass`` of the draws (first minimum)."""
    x = np.sort(np.asarray(x).ravel())
    n = len(x)
    k = int(np.floor(mass * n))
    if n == 0 or k >= n:
        return (float("nan"), float("nan"))
    w = x[k:] - x[: n - k]
    i = int(np.argmin(w))
    return float(x[i]), float(x[i + k])


#: most posterior mass that the edge points of a sigma grid may hold
EDGE_MASS = 1e-9


def _logdet(a: np.ndarray) -> np.ndarray:
    return np.linalg.slogdet(a)[1]


def conjugate_sigma_grid(G: np.ndarray, v: np.ndarray, s: float, n: float,
                         prior_prec: np.ndarray, sigma_scale: float,
                         points: int = 201) -> dict:
    """Posterior over a grid of log sigma for the conjugate linear model.

    Returns grid, normalized weights, per-point means and covariances.
    The grid is centred on the residual sd of the ridge-regularized fit and
    first spans +-7 standard errors of log sigma; it is widened until its two
    edge points hold less than EDGE_MASS, and raises if that never happens.
    """
    p = len(v)
    b0 = np.linalg.solve(G + prior_prec * max(1e-12, 1.0), v)
    rss = max(s - 2 * b0 @ v + b0 @ G @ b0, 1e-12)
    shat = np.sqrt(rss / max(n, 1.0))
    half, logdetP = 7.0 / np.sqrt(2.0 * max(n, 1.0)), _logdet(prior_prec)
    for _ in range(12):
        grid = shat * np.exp(np.linspace(-half, half, points))
        lw = np.empty(points)
        mus = np.empty((points, p))
        covs = np.empty((points, p, p))
        for k, sg in enumerate(grid):
            Q = G / sg ** 2 + prior_prec
            r = v / sg ** 2
            cov = np.linalg.inv(Q)
            mu = cov @ r
            lw[k] = (-n * np.log(sg) - s / (2 * sg ** 2) + 0.5 * logdetP - 0.5 * _logdet(Q)
                     + 0.5 * r @ mu - sg ** 2 / (2 * sigma_scale ** 2) + np.log(sg))
            mus[k], covs[k] = mu, cov
        w = np.exp(lw - lw.max())
        w /= w.sum()
        if w[0] + w[-1] < EDGE_MASS:
            return {"grid": grid, "w": w, "mu": mus, "cov": covs}
        half *= 1.5
    raise ValueError("the posterior of sigma does not fit on its grid")


def _mixture_moments(w, mus, covs, sig):
    mean = np.einsum("k,kp->p", w, mus)
    second = np.einsum("k,kpq->pq", w, covs + np.einsum("kp,kq->kpq", mus, mus))
    cov = second - np.outer(mean, mean)
    ms = float(w @ sig)
    vs = float(w @ sig ** 2) - ms ** 2
    k = len(mean)
    full_mean = np.append(mean, ms)
    full_cov = np.zeros((k + 1, k + 1))
    full_cov[:k, :k] = cov
    full_cov[k, k] = max(vs, 0.0)
    return full_mean, full_cov


def _mixture_draws(rng, w, mus, covs, sig, chains, draws):
    total = chains * draws
    idx = rng.choice(len(w), size=total, p=w)
    out = np.empty((total, mus.shape[1] + 1))
    for k in np.unique(idx):
        sel = idx == k
        out[sel, :-1] = rng.multivariate_normal(mus[k], covs[k], size=int(sel.sum()), method="cholesky")
        out[sel, -1] = sig[k]
    return out.reshape(chains, draws, -1)


def bayes_linear(df: DataFrame, xcols: Sequence[str], y: str, prior_sd: Sequence[float],
                 sigma_scale: float, w2: str | None = None, names: Sequence[str] | None = None,
                 model: str = "linear", seed: int = 42, chains: int = 4, draws: int = 1000,
                 gram_method: str = "auto") -> Posterior:
    """M5 / M9: Normal likelihood with noise sd sigma/w (``w2`` = w^2 column),
    independent Normal(0, prior_sd) coefficients, HalfNormal(sigma_scale) sigma.
    Include a constant column in ``xcols`` for a free intercept."""
    g = gram(df, list(xcols), y, w2, method=gram_method)
    G, v, s, nobs = g.xtx(), g.xty(), g.yty(), g.rows
    P = np.diag(1.0 / np.asarray(prior_sd, float) ** 2)
    res = conjugate_sigma_grid(G, v, s, nobs, P, sigma_scale)
    mean, cov = _mixture_moments(res["w"], res["mu"], res["cov"], res["grid"])
    rng = np.random.default_rng(seed)
    d = _mixture_draws(rng, res["w"], res["mu"], res["cov"], res["grid"], chains, draws)
    labels = list(names or xcols) + ["sigma"]
    return Posterior(model, labels, mean, cov, d, {"n": nobs, "sigma_grid_edge_mass": float(res["w"][[0, -1]].sum())})


# ------------------------------------------------------------- logistic
MAX_STEP = 8.0


def _logit_step_sql(d: DataFrame, q: int, beta: np.ndarray):
    eta = sum(F.lit(float(beta[i])) * F.col(f"__x{i}") for i in range(q))
    p = 1.0 / (1.0 + F.exp(-eta))
    dd = d.select(*[F.col(f"__x{i}") for i in range(q)], "__y", p.alias("__p"))
    aggs = [F.sum((F.col("__y") - F.col("__p")) * F.col(f"__x{i}")).alias(f"g{i}") for i in range(q)]
    aggs += [F.sum(F.col("__p") * (1 - F.col("__p")) * F.col(f"__x{i}") * F.col(f"__x{j}")).alias(f"h{i}_{j}")
             for i in range(q) for j in range(i, q)]
    row = dd.agg(*aggs).first()
    g = np.array([row[f"g{i}"] for i in range(q)], float)
    H = np.zeros((q, q))
    for i in range(q):
        for j in range(i, q):
            H[i, j] = H[j, i] = row[f"h{i}_{j}"]
    return g, H


def _logit_step_arrow(d: DataFrame, q: int, beta: np.ndarray):
    b = beta.copy()

    def run(batches):
        import pandas as pd
        g = np.zeros(q)
        H = np.zeros((q, q))
        for pdf in batches:
            X = pdf[[f"__x{i}" for i in range(q)]].to_numpy(float)
            yv = pdf["__y"].to_numpy(float)
            p = 1.0 / (1.0 + np.exp(-(X @ b)))
            g += X.T @ (yv - p)
            H += (X * (p * (1 - p))[:, None]).T @ X
        ii, jj = np.triu_indices(q)
        yield pd.DataFrame({"i": np.r_[np.arange(q), ii].astype("int32"),
                            "j": np.r_[np.full(q, -1), jj].astype("int32"),
                            "v": np.r_[g, H[ii, jj]]})

    rows = d.mapInPandas(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    g = np.zeros(q)
    H = np.zeros((q, q))
    for r in rows:
        if r.j < 0:
            g[r.i] = r.v
        else:
            H[r.i, r.j] = H[r.j, r.i] = r.v
    return g, H


def bayes_logistic(df: DataFrame, xcols: Sequence[str], y: str, prior_sd: Sequence[float],
                   names: Sequence[str] | None = None, model: str = "logistic", seed: int = 42,
                   chains: int = 4, draws: int = 1000, tol: float = 1e-10, max_iter: int = 50,
                   method: str = "auto") -> Posterior:
    """M6 / M7: Bernoulli-logit with independent Normal priors; Newton to the
    posterior mode, one distributed aggregate per step, then the Laplace
    (Gaussian) posterior N(mode, H^-1). Perfect separation is fine: the prior
    keeps H invertible."""
    q = len(xcols)
    d = df.select(*[F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(xcols)],
                  F.col(y).cast("double").alias("__y")).na.drop()
    d = d.persist(StorageLevel.MEMORY_AND_DISK)
    P = np.diag(1.0 / np.asarray(prior_sd, float) ** 2)
    if method == "auto":
        # literals change every step, so the SQL form recompiles each time
        method = "arrow"
    step = _logit_step_sql if method == "sql" else _logit_step_arrow
    beta = np.zeros(q)
    it = 0
    try:
        for it in range(1, max_iter + 1):
            g, H = step(d, q, beta)
            g = g - P @ beta
            H = H + P
            delta = np.linalg.solve(H, g)
            # a step is at most MAX_STEP long in any coefficient
            beta = beta + delta * min(1.0, MAX_STEP / max(np.max(np.abs(delta)), 1e-300))
            if np.max(np.abs(delta)) < tol:
                break
        else:
            raise ValueError(f"Newton's method has not converged in {max_iter} steps")
    finally:
        d.unpersist()
    # curvature from the last step: the mode moved by < tol since it was taken
    cov = np.linalg.inv(H)
    rng = np.random.default_rng(seed)
    dr = rng.multivariate_normal(beta, cov, size=chains * draws, method="cholesky").reshape(chains, draws, q)
    return Posterior(model, list(names or xcols), beta, cov, dr, {"newton_steps": it})


# ---------------------------------------------------------- hierarchical
STRATUM_SUMS = ("n", "sa", "st", "sy", "saa", "sat", "say", "stt", "sty", "syy")


def stratum_sums(df: DataFrame, stratum: str, a: str, t: str, y: str) -> DataFrame:
    """Per-stratum sufficient statistics (one partial aggregate)."""
    A, T, Y = F.col(a), F.col(t), F.col(y)
    return df.groupBy(stratum).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(A).alias("sa"), F.sum(T).alias("st"),
        F.sum(Y).alias("sy"), F.sum(A * A).alias("saa"), F.sum(A * T).alias("sat"),
        F.sum(A * Y).alias("say"), F.sum(T * T).alias("stt"), F.sum(T * Y).alias("sty"),
        F.sum(Y * Y).alias("syy"))


def _hier_system(S: np.ndarray):
    """Data Gram G, v, s, n for u = (mu_a, a_1..a_S, mu_b, b_1..b_S, b_len)."""
    k = S.shape[0]
    dim = 2 * k + 3
    G = np.zeros((dim, dim))
    v = np.zeros(dim)
    ia = lambda s: 1 + s
    ib = lambda s: k + 2 + s
    il = dim - 1
    for s in range(k):
        n, sa, st, sy, saa, sat, say, stt, sty, syy = S[s]
        G[ia(s), ia(s)] += n
        G[ia(s), ib(s)] += sa
        G[ib(s), ia(s)] += sa
        G[ia(s), il] += st
        G[il, ia(s)] += st
        G[ib(s), ib(s)] += saa
        G[ib(s), il] += sat
        G[il, ib(s)] += sat
        G[il, il] += stt
        v[ia(s)] += sy
        v[ib(s)] += say
        v[il] += sty
    return G, v, float(S[:, 9].sum()), float(S[:, 0].sum())


def _hier_prior(k: int, sda, sdb, mu_a_sd=5.0, mu_b_sd=1.0, len_sd=2.0):
    """Prior precision (vectorized over grid points) and its log-determinant."""
    m = len(sda)
    dim = 2 * k + 3
    P = np.zeros((m, dim, dim))
    ca, cb = 1.0 / sda ** 2, 1.0 / sdb ** 2
    P[:, 0, 0] = 1.0 / mu_a_sd ** 2 + k * ca
    P[:, k + 1, k + 1] = 1.0 / mu_b_sd ** 2 + k * cb
    for s in range(k):
        P[:, 1 + s, 1 + s] = ca
        P[:, 0, 1 + s] = P[:, 1 + s, 0] = -ca
        P[:, k + 2 + s, k + 2 + s] = cb
        P[:, k + 1, k + 2 + s] = P[:, k + 2 + s, k + 1] = -cb
    P[:, -1, -1] = 1.0 / len_sd ** 2
    logdet = (np.log(1 / mu_a_sd ** 2) + np.log(1 / mu_b_sd ** 2) + np.log(1 / len_sd ** 2)
              - 2 * k * np.log(sda) - 2 * k * np.log(sdb))
    return P, logdet


def _hier_eval(G, v, s, n, k, sig, sda, sdb, scales):
    P, logdetP = _hier_prior(k, sda, sdb)
    Q = G[None] / sig[:, None, None] ** 2 + P
    r = v[None] / sig[:, None] ** 2
    mu = np.linalg.solve(Q, r[..., None])[..., 0]
    lw = (-n * np.log(sig) - s / (2 * sig ** 2) + 0.5 * logdetP - 0.5 * np.linalg.slogdet(Q)[1]
          + 0.5 * np.einsum("mp,mp->m", r, mu)
          - sig ** 2 / (2 * scales[0] ** 2) - sda ** 2 / (2 * scales[1] ** 2) - sdb ** 2 / (2 * scales[2] ** 2)
          + np.log(sda) + np.log(sdb))          # log-scale grid for the two sds
    return lw, mu, Q


def bayes_hierarchical(sums: DataFrame, stratum: str = "stratum", seed: int = 42,
                       chains: int = 4, draws: int = 1000, grid=(25, 48, 48),
                       scales=(2.0, 2.0, 1.0), model: str = "hierarchical") -> Posterior:
    """M8: partially pooled stratum intercepts and slopes.

    The Gaussian block is integrated exactly; the three scale parameters
    (sigma, sd_alpha, sd_b) live on a grid that Spark evaluates in parallel
    with ``mapInPandas`` (each task: a slice of grid points, batched numpy).
    """
    rows = sums.orderBy(stratum).collect()          # one row per stratum
    strata = [r[stratum] for r in rows]
    S = np.array([[float(r[c] or 0.0) for c in STRATUM_SUMS] for r in rows])
    k = len(strata)
    G, v, s, n = _hier_system(S)
    # residual scale from unpooled per-stratum fits centres the sigma grid
    ridge = np.linalg.solve(G + np.eye(len(v)) * 1e-6, v)
    rss = max(s - 2 * ridge @ v + ridge @ G @ ridge, 1e-12)
    shat = np.sqrt(rss / n)
    half = min(0.95, 7.0 / np.sqrt(2.0 * n))
    sig_grid = shat * (1.0 + np.linspace(-half, half, grid[0]))
    la = np.linspace(np.log(1e-3), np.log(10.0), grid[1])
    lb = np.linspace(np.log(1e-3), np.log(5.0), grid[2])
    total = grid[0] * grid[1] * grid[2]
    spark = sums.sparkSession
    nparts = max(1, min(64, total // 2000))

    def run(batches):
        import pandas as pd
        for pdf in batches:
            idx = pdf["id"].to_numpy()
            i0 = idx // (grid[1] * grid[2])
            i1 = (idx // grid[2]) % grid[1]
            i2 = idx % grid[2]
            lw, _, _ = _hier_eval(G, v, s, n, k, sig_grid[i0], np.exp(la[i1]), np.exp(lb[i2]), scales)
            yield pd.DataFrame({"id": idx, "lw": lw})

    lw_rows = spark.range(0, total, numPartitions=nparts).mapInPandas(run, "id long, lw double").toPandas()
    ids = lw_rows["id"].to_numpy()
    lw = lw_rows["lw"].to_numpy()
    keep = lw > lw.max() - 40.0
    ids, lw = ids[keep], lw[keep]
    w = np.exp(lw - lw.max())
    w /= w.sum()
    i0 = ids // (grid[1] * grid[2])
    i1 = (ids // grid[2]) % grid[1]
    i2 = ids % grid[2]
    sig, sda, sdb = sig_grid[i0], np.exp(la[i1]), np.exp(lb[i2])
    _, mu, Q = _hier_eval(G, v, s, n, k, sig, sda, sdb, scales)
    cov = np.linalg.inv(Q)
    # moments of (u, sigma, sd_alpha, sd_b)
    mean_u = w @ mu
    second = np.einsum("m,mpq->pq", w, cov + np.einsum("mp,mq->mpq", mu, mu))
    cov_u = second - np.outer(mean_u, mean_u)
    extra_vals = np.stack([sig, sda, sdb], axis=1)
    mean_e = w @ extra_vals
    cov_e = np.einsum("m,mp,mq->pq", w, extra_vals, extra_vals) - np.outer(mean_e, mean_e)
    dim = len(mean_u)
    mean = np.r_[mean_u, mean_e]
    full = np.zeros((dim + 3, dim + 3))
    full[:dim, :dim] = cov_u
    full[dim:, dim:] = cov_e
    rng = np.random.default_rng(seed)
    pick = rng.choice(len(w), size=chains * draws, p=w)
    out = np.empty((chains * draws, dim + 3))
    for m in np.unique(pick):
        sel = pick == m
        out[sel, :dim] = rng.multivariate_normal(mu[m], cov[m], size=int(sel.sum()), method="cholesky")
        out[sel, dim:] = extra_vals[m]
    names = (["mu_alpha"] + [f"alpha_s[{x}]" for x in strata] + ["mu_b_attention"]
             + [f"b_attention_s[{x}]" for x in strata] + ["b_title_len", "sigma", "sd_alpha", "sd_b_attention"])
    edge = float(w[(i0 == 0) | (i0 == grid[0] - 1)].sum())
    return Posterior(model, names, mean, full, out.reshape(chains, draws, -1),
                     {"strata": strata, "grid_points": total, "sigma_edge_mass": edge})


def summary_frame(spark, post: Posterior, mass: float = 0.94):
    """Summary rows (model, param, mean, sd, hdi_lo, hdi_hi) from a posterior."""
    rows = []
    sd = post.sd()
    flat = post.draws.reshape(-1, post.draws.shape[-1])
    for i, name in enumerate(post.names):
        lo, hi = hdi_np(flat[:, i], mass)
        rows.append((post.model, name, float(post.mean[i]), float(sd[i]), lo, hi))
    return spark.createDataFrame(rows, "model string, param string, mean double, sd double, "
                                       "hdi_lo double, hdi_hi double")


def posterior_frame(spark, post: Posterior):
    """The long posterior table (model, param, chain, draw, value)."""
    import pandas as pd
    c, d, k = post.draws.shape
    ci, di, ki = np.meshgrid(np.arange(c), np.arange(d), np.arange(k), indexing="ij")
    pdf = pd.DataFrame({"model": post.model, "param": np.array(post.names)[ki.ravel()],
                        "chain": ci.ravel().astype("int32"), "draw": di.ravel().astype("int64"),
                        "value": post.draws.ravel()})
    return spark.createDataFrame(pdf)
