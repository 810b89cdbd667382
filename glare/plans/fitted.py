"""Fitted values and residuals of the hierarchical model per row.

The parameters come from a draws table: one row per stratum with the means of
its intercept and slope and of the shared length slope, their covariances, and
the mean squared noise. Each row gathers its stratum's parameters; the fit, its
uncertainty and the posterior predictive residual are then plain columns.
"""
from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement
from statistics import NormalDist

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

COEFFICIENTS = ("alpha", "beta", "gamma")        # intercept, slope of a, slope of t
#: most strata whose parameters are broadcast; more are joined by shuffle
BROADCAST_STRATA = 10_000


def stratum_parameters(draws: DataFrame, intercept: str = "alpha_s", slope: str = "b_attention_s", shared: str = "b_title_len",
                       noise: str = "sigma", keys: Sequence[str] = ("chain", "draw")) -> DataFrame:
    """(stratum, n_draws, alpha, beta, gamma, their covariances, noise2) from
    parameters named ``intercept[stratum]``, ``slope[stratum]``, ``shared`` and ``noise``."""
    keys = list(keys)
    d = draws.select(*keys, F.regexp_extract("param", r"^(.*)\[(.*)\]$", 1).alias("__p"),
                     F.regexp_extract("param", r"^(.*)\[(.*)\]$", 2).alias("stratum"), "param", F.col("value").cast("double").alias("v"))

    def of(column, name):
        return F.max(F.when(F.col(column) == name, F.col("v")))

    own = d.where(F.col("__p").isin(intercept, slope)).groupBy(*keys, "stratum").agg(
        of("__p", intercept).alias("alpha"), of("__p", slope).alias("beta"))
    common = d.where(F.col("param").isin(shared, noise)).groupBy(*keys).agg(
        of("param", shared).alias("gamma"), of("param", noise).alias("__s"))
    wide = own.join(common, keys).na.drop()
    return wide.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n_draws"), *(F.avg(c).alias(c) for c in COEFFICIENTS),
        *(F.covar_samp(p, q).alias(f"c_{p}_{q}") for p, q in combinations_with_replacement(COEFFICIENTS, 2)),
        F.avg(F.col("__s") * F.col("__s")).alias("noise2"))


def fitted_values(rows: DataFrame, parameters: DataFrame, stratum: str, a: str, t: str, y: str,
                  broadcast_strata: int = BROADCAST_STRATA) -> DataFrame:
    """``rows`` with fitted, fitted_sd (of the fit), predictive_sd (of a new
    observation), residual, z (residual in predictive sds) and log_density.

    Every row gathers its stratum's parameters; a stratum without parameters, or a
    null in a, t or y, leaves the columns that need it null. Parameters are
    broadcast while they are few by count, else joined by shuffle."""
    parameters = cut_lineage(parameters)
    few = parameters.limit(broadcast_strata + 1).count() <= broadcast_strata
    p = parameters.select(F.col("stratum").alias("__stratum"),
                          F.struct(*(c for c in parameters.columns if c != "stratum")).alias("__p"))
    j = rows.join(F.broadcast(p) if few else p, F.col(stratum) == F.col("__stratum"), "left")
    x = {"alpha": F.lit(1.0), "beta": F.col(a).cast("double"), "gamma": F.col(t).cast("double")}
    fit = sum(F.col(f"__p.{c}") * v for c, v in x.items())
    var = sum(F.col(f"__p.c_{p}_{q}") * x[p] * x[q] * (1 if p == q else 2) for p, q in combinations_with_replacement(COEFFICIENTS, 2))
    out = j.withColumns({"fitted": fit, "__v": F.greatest(var, F.lit(0.0))})
    out = out.withColumns({"fitted_sd": F.sqrt("__v"), "predictive_sd": F.sqrt(F.col("__v") + F.col("__p.noise2")),
                           "residual": F.col(y).cast("double") - F.col("fitted")})
    out = out.withColumn("z", F.try_divide("residual", "predictive_sd"))
    density = -0.5 * F.col("z") * F.col("z") - F.log("predictive_sd") - 0.5 * math.log(2 * math.pi)
    return out.withColumn("log_density", density).drop("__stratum", "__p", "__v")


def residual_report(fitted: DataFrame, stratum: str, mass: float = 0.94) -> DataFrame:
    """Per stratum: rows, mean residual, root mean square, share of rows within the
    central ``mass`` of their predictive distribution, mean log density."""
    edge = NormalDist().inv_cdf(0.5 + mass / 2)
    return fitted.groupBy(stratum).agg(
        F.count("residual").alias("n"), F.avg("residual").alias("mean_residual"),
        F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rmse"),
        F.avg((F.abs("z") <= edge).cast("double")).alias("share_inside"), F.avg("log_density").alias("mean_log_density"))
