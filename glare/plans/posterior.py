"""Posterior tables and their summaries.

A posterior is a long table ``(model, param, chain, draw, value)``. Its
summaries are Spark aggregates, so a trace of any length summarizes without
leaving the cluster: mean and sd are one aggregate; the HDI comes from the
exact order-statistics operator; split R-hat is grouped variances by
(param, chain half).
"""
from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import order_stats
from ..session import cut_lineage

#: draws of a block of a chain half, and most blocks of lags that one round adds
LAG_BLOCK, MOST_BLOCKS = 256, 16

# Gauss-Hermite nodes/weights are generated (numpy) rather than listed.


def write_posterior(df: DataFrame, path: str) -> None:
    """S6 sink: partitioned by model so one model's trace is read alone."""
    df.write.mode("overwrite").partitionBy("model").parquet(path)


def read_posterior(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.where(F.col("model") == model) if model else df


def moments(draws: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    return draws.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"),
                                    F.stddev_samp(value).alias("sd"))


def hdi_table(draws: DataFrame, keys: Sequence[str], value: str = "value", mass: float = 0.94,
              rows_per_range: int = order_stats.ROWS_PER_RANGE, runs: DataFrame | None = None) -> DataFrame:
    return order_stats.hdi(draws, value, keys, mass, rows_per_range, runs)


def percentile_table(draws: DataFrame, keys: Sequence[str], qs: Sequence[float],
                     value: str = "value",
                     rows_per_range: int = order_stats.ROWS_PER_RANGE) -> DataFrame:
    """A7 per key, wide: one column ``p{q*100}`` per requested q."""
    long = order_stats.quantiles(draws, value, qs, keys, rows_per_range)
    return long.groupBy(*keys).pivot("q", [float(q) for q in qs]).agg(F.first("value")) \
        .withColumnsRenamed({str(float(q)): f"p{round(q * 100, 3):g}".replace(".", "_") for q in qs})


def split_rhat(draws: DataFrame, keys: Sequence[str], chain: str = "chain", draw: str = "draw",
               value: str = "value",
               rows_per_range: int = order_stats.ROWS_PER_RANGE) -> DataFrame:
    """M13 split R-hat: each chain's first and last ``floor(len/2)`` draws
    are separate sequences (a middle draw of an odd chain is dropped);
    R = sqrt(((h-1)/h * W + B/h) / W) with h the half length,
    W the mean within-sequence variance and B/h the variance of sequence means."""
    keys = list(keys)
    pos = order_stats.positions(draws, [*keys, chain], draw, draw, rows_per_range)
    half = F.floor(F.col("__n") / 2)
    seq = pos.withColumn("__half", F.when(F.col("__pos") < half, 0)
                         .when(F.col("__pos") >= F.col("__n") - half, 1)) \
        .where(F.col("__half").isNotNull())
    per = seq.groupBy(*keys, chain, "__half").agg(
        F.count(F.lit(1)).alias("h"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    agg = per.groupBy(*keys).agg(F.min("h").alias("h"), F.var_samp("m").alias("bh"),
                                 F.avg("v").alias("w"))
    # a constant parameter has no R-hat
    r = F.sqrt(((F.col("h") - 1) / F.col("h") * F.col("w") + F.col("bh")) / F.col("w"))
    return agg.select(*keys, F.when(F.col("w") > 0, r).alias("r_hat"))


def _size(acov, n: int, m: int, between: float, last: bool = True) -> tuple[float, bool]:
    """(size, settled) of ``m`` sequences with ``n`` draws in all, from the mean
    lagged products of the centred draws and the variance between the sequences.
    Not settled: Geyer's pairs stay positive so far and lags are left (not ``last``)."""
    import numpy as np
    within = acov[0] * n / (n - m)
    total = acov[0] + between
    if not total > 0:
        return float("nan"), True
    rho = 1 - (within - acov) / total
    rho[0] = 1.0
    pairs = rho[:len(rho) - len(rho) % 2].reshape(-1, 2).sum(axis=1)      # neighbours in pairs
    stop = np.flatnonzero(pairs <= 0)
    pairs = np.minimum.accumulate(pairs[:stop[0]] if len(stop) else pairs)
    tau = max(2 * pairs.sum() - 1, 1 / np.log10(n))
    return float(n / tau), bool(len(stop) or last)


def effective_size(x) -> float:
    """Effective sample size of sequences x (sequences, draws): Geyer's initial
    monotone sequence over the combined autocorrelations (Vehtari et al., 2021)."""
    import numpy as np
    m, n = x.shape
    if n < 4 or not np.isfinite(x).all():
        return float("nan")
    c = x - x.mean(axis=1, keepdims=True)
    f = np.fft.rfft(c, 2 * n, axis=1)
    acov = (np.fft.irfft(f * np.conj(f), 2 * n, axis=1)[:, :n] / n).mean(axis=0)
    return _size(acov, m * n, m, x.mean(axis=1).var(ddof=1) if m > 1 else 0.0)[0]


def _ddl(df: DataFrame, columns: Sequence[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in columns)


def _slices(batches, most: int = 256):
    for b in batches:
        for at in range(0, b.num_rows, most):
            yield b.slice(at, most)


def _blocks(draws: DataFrame, keys: list[str], rows_per_range: int, block: int) -> DataFrame:
    """(keys, __c, __h, __b, x, z): the halves of every chain in blocks of
    ``block`` draws, in order, as they are (x) and rank-normalized per key (z).
    The middle draw of an odd chain is in its second half."""
    runs = order_stats.value_runs(draws, keys, "__v", rows_per_range=rows_per_range)
    ranks = runs.select(*keys, "__v", ((F.col("start") + (F.col("cnt") + 1) / 2 - 0.375) / (F.col("n") + 0.25)).alias("__p"))
    half = F.floor(F.col("__n") / 2)
    at = F.col("__pos") - F.when(F.col("__h"), half).otherwise(0)
    rows = order_stats.positions(draws, [*keys, "__c"], "__d", "__v", rows_per_range) \
        .withColumn("__h", F.col("__pos") >= half).withColumn("__at", at).join(ranks, [*keys, "__v"]) \
        .groupBy(*keys, "__c", "__h", F.floor(F.col("__at") / block).alias("__b")) \
        .agg(F.sort_array(F.collect_list(F.struct("__at", "__v", "__p"))).alias("__s")) \
        .select(*keys, "__c", "__h", "__b", F.col("__s.__v").alias("x"), F.col("__s.__p").alias("z"))

    def normal(batches):
        import pyarrow as pa
        inv = NormalDist().inv_cdf
        for part in _slices(batches):
            z = pa.array([[inv(p) for p in s] for s in part.column("z").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], z], part.schema.names)

    return cut_lineage(rows.mapInArrow(normal, _ddl(rows, rows.columns)[:-2]))


def _lagged(blocks: DataFrame, keys: list[str], first: int, end: int, block: int) -> DataFrame:
    """(keys, __lag, x, z): sums of the lagged products of centred blocks, for
    lags from ``first * block`` to below ``end * block``: a block meets the blocks
    that many blocks after it, and each task adds up what it has."""
    seq = [*keys, "__c", "__h"]
    ahead = blocks.select(*seq, F.col("__b").alias("__t"), F.col("x").alias("x1"), F.col("z").alias("z1"))
    pairs = blocks.select(*seq, "__b", "x", "z", F.explode(F.sequence(F.lit(first), F.lit(end))).alias("__k")) \
        .withColumn("__t", F.col("__b") + F.col("__k")).join(ahead, [*seq, "__t"]) \
        .select(*keys, "__k", "x", "z", "x1", "z1")

    def products(batches):
        import numpy as np
        import pyarrow as pa

        def padded(column):
            off = column.offsets.to_numpy()
            n = np.diff(off)
            out = np.zeros((len(n), block))
            out[np.arange(block) < n[:, None]] = column.values.to_numpy()[off[0]:off[-1]]
            return out, n

        def all_lags(a, b):
            f = np.conj(np.fft.rfft(a, 2 * block, axis=1)) * np.fft.rfft(b, 2 * block, axis=1)
            return np.fft.irfft(f, 2 * block, axis=1)

        for part in _slices(batches):
            groups: dict = {}
            which = [groups.setdefault(t, len(groups)) for t in zip(*(part.column(k).to_pylist() for k in keys))]
            k = part.column("__k").to_numpy()
            b, n = padded(part.column("x1"))
            lags = min(int((k * block + n).max()), end * block) - first * block
            if lags <= 0:
                continue
            sums = np.zeros((2, len(groups), (end - first) * block))
            for out, r in zip(sums, (all_lags(padded(part.column("x"))[0], b),
                                     all_lags(padded(part.column("z"))[0], padded(part.column("z1"))[0]))):
                for g, at, row in zip(which, (k - first) * block, r):
                    if at < out.shape[1]:
                        out[g, at:at + block] += row[:block]
                    if at > 0:
                        out[g, at - block + 1:at] += row[block + 1:]
            rows = pa.array(np.repeat([which.index(g) for g in range(len(groups))], lags))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c).take(rows) for c in keys), pa.array(np.tile(np.arange(lags, dtype=np.int64) + first * block, len(groups))),
                 *(pa.array(s[:, :lags].ravel()) for s in sums)], [*keys, "__lag", "x", "z"])

    return pairs.mapInArrow(products, _ddl(blocks, keys) + "__lag long, x double, z double") \
        .groupBy(*keys, "__lag").agg(F.sum("x").alias("x"), F.sum("z").alias("z"))


def ess_table(draws: DataFrame, keys: Sequence[str], chain: str = "chain", draw: str = "draw",
              value: str = "value", rows_per_range: int = order_stats.ROWS_PER_RANGE,
              block: int = LAG_BLOCK) -> DataFrame:
    """Bulk effective sample size (split chains, rank-normalized) and the
    Monte Carlo standard error of the mean, per key, from all draws of every chain.

    Sequences of unequal length weigh by their draws. Lagged products are summed
    by Spark, a few blocks of lags at a time, for the keys whose pairs are still
    positive; a key's sums per lag are all that meets in one place. Both are null
    where a value is null or not finite, all are equal, or no chain has 8 draws."""
    keys = list(keys)
    v = F.col("__v")
    d = draws.select(*keys, F.col(chain).alias("__c"), F.col(draw).alias("__d"), F.col(value).cast("double").alias("__v")) \
        .where(F.col("__c").isNotNull())
    totals = cut_lineage(d.groupBy(*keys).agg(
        F.stddev_samp("__v").alias("__sd"),
        (F.min(F.coalesce(F.abs(v) < float("inf"), F.lit(False))) & (F.min("__v") < F.max("__v"))).alias("__ok")))
    blocks = _blocks(d.join(totals.where("__ok").select(*keys), keys, "left_semi"), keys, rows_per_range, block)

    seq = [*keys, "__c", "__h"]
    added = {c: F.sum(F.aggregate(c, F.lit(0.0), lambda a, e: a + e)) for c in "xz"}
    means = blocks.groupBy(*seq).agg(F.sum(F.size("x")).alias("__n"), *(s.alias(f"m{c}") for c, s in added.items())) \
        .select(*seq, "__n", *((F.col(f"m{c}") / F.col("__n")).alias(f"m{c}") for c in "xz"))
    means = cut_lineage(means)
    grand = means.groupBy(*keys).agg(F.sum("__n").alias("__all"), F.count(F.lit(1)).alias("__m"),
                                     *((F.sum(F.col(f"m{c}") * F.col("__n")) / F.sum("__n")).alias(f"g{c}") for c in "xz"))
    off = {c: F.sum(F.col("__n") * (F.col(f"m{c}") - F.col(f"g{c}")) ** 2) for c in "xz"}
    stats = means.join(grand, keys).groupBy(*keys, "__all", "__m").agg(
        F.max("__n").alias("__longest"), F.max(F.when(~F.col("__h"), F.col("__n"))).alias("__half"),
        *((F.coalesce(s / (F.col("__m") - 1), F.lit(0.0)) * F.col("__m") / F.col("__all")).alias(f"b{c}") for c, s in off.items())) \
        .where("__half >= 4").drop("__half")
    stats = cut_lineage(stats)

    def minus(mean):
        return lambda e: e - mean

    centred = cut_lineage(blocks.join(means, seq).join(stats.select(*keys), keys, "left_semi").select(
        *seq, "__b", *(F.transform(c, minus(F.col(f"m{c}"))).alias(c) for c in "xz")))

    def sizes(end):
        def one(pdf):
            import numpy as np
            import pandas as pd
            s = pdf.iloc[0]
            lags = min(int(s["__longest"]), end * block)
            out, more = {k: [pdf[k].iloc[0]] for k in keys}, False
            for c in "xz":
                acov = np.zeros(lags)
                near = pdf[pdf["__lag"] < lags]
                acov[near["__lag"].to_numpy()] = near[c].to_numpy() / s["__all"]
                size, settled = _size(acov, int(s["__all"]), int(s["__m"]), float(s[f"b{c}"]), lags == s["__longest"])
                out[f"e{c}"], more = [size], more or not settled
            return pd.DataFrame(out | {"__more": [more]})
        return one

    known = done = None
    left, first, end = centred, 0, 1
    while True:
        part = cut_lineage(_lagged(left, keys, first, end, block))
        known = part if known is None else known.unionByName(part)
        state = cut_lineage(known.join(stats, keys).groupBy(*keys).applyInPandas(
            sizes(end), _ddl(draws, keys) + "ex double, ez double, __more boolean"))
        done = state.where("not __more") if done is None else done.unionByName(state.where("not __more"))
        more = state.where("__more").select(*keys)
        if more.isEmpty():
            break
        known, left = cut_lineage(known.join(more, keys, "left_semi")), centred.join(more, keys, "left_semi")
        first, end = end, end + min(end, MOST_BLOCKS)
    size = {c: F.when(~F.isnan(f"e{c}"), F.col(f"e{c}")) for c in "xz"}
    return totals.join(done, keys, "left").select(*keys, size["z"].alias("ess_bulk"), (F.col("__sd") / F.sqrt(size["x"])).alias("mcse"))


def summarize(draws: DataFrame, keys: Sequence[str] = ("model", "param"), mass: float = 0.94,
              rows_per_range: int = order_stats.ROWS_PER_RANGE) -> DataFrame:
    """Mean, sd, HDI, split R-hat, bulk ESS and MCSE per parameter."""
    keys = list(keys)
    runs = cut_lineage(order_stats.value_runs(draws, keys, "value", rows_per_range=rows_per_range))
    return moments(draws, keys).join(hdi_table(draws, keys, mass=mass, rows_per_range=rows_per_range, runs=runs), keys) \
        .join(split_rhat(draws, keys, rows_per_range=rows_per_range), keys, "left") \
        .join(ess_table(draws, keys, rows_per_range=rows_per_range), keys, "left")


def gap_posterior(df: DataFrame, gap: str, mass: float = 0.89) -> DataFrame:
    """Flat-prior posterior of a mean paired gap: Normal(m, sd / sqrt(n)),
    central interval of ``mass`` in closed form (no sampling)."""
    z = NormalDist().inv_cdf(0.5 + mass / 2)
    s = df.agg(F.count(gap).alias("n"), F.avg(gap).alias("mean_gap"), F.stddev_samp(gap).alias("sd_gap"),
               F.avg((F.col(gap) > 0).cast("double")).alias("share_positive"))
    se = F.col("sd_gap") / F.sqrt(F.col("n"))
    return s.select("n", "mean_gap", "sd_gap", "share_positive",
                    (F.col("mean_gap") - z * se).alias("ci_lo"), (F.col("mean_gap") + z * se).alias("ci_hi"))


def _hermite(n: int):
    import numpy as np
    x, w = np.polynomial.hermite.hermgauss(n)
    return [float(v) for v in x], [float(v) for v in w]


def logistic_band(mu: Column, sd: Column, lo_q: float = 0.03, hi_q: float = 0.97,
                  nodes: int = 20) -> dict[str, Column]:
    """M12 in closed form for a Gaussian linear predictor eta ~ N(mu, sd^2):
    mean of sigmoid(eta) by Gauss-Hermite quadrature (a fixed sum of column
    terms), percentiles as sigmoid(mu + z_q sd) (sigmoid is monotone)."""
    xs, ws = _hermite(nodes)
    mean = None
    for x, w in zip(xs, ws):
        term = F.lit(w / math.sqrt(math.pi)) / (1.0 + F.exp(-(mu + F.lit(math.sqrt(2.0) * x) * sd)))
        mean = term if mean is None else mean + term
    zl, zh = NormalDist().inv_cdf(lo_q), NormalDist().inv_cdf(hi_q)
    return {"p_mean": mean,
            "p_lo": 1.0 / (1.0 + F.exp(-(mu + F.lit(zl) * sd))),
            "p_hi": 1.0 / (1.0 + F.exp(-(mu + F.lit(zh) * sd)))}
