"""Centering and standardizing.

Global statistics are one aggregate whose few numbers re-enter the plan as
literals (no global window). Group centering aggregates per group and joins
the means back: the aggregate combines map-side, and a hot group on the join
is split by AQE's skew-join rule rather than sorted in one window task.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ZERO_POLICIES = ("one", "none", "replace", "epsilon")


def column_stats(df: DataFrame, cols: Sequence[str], ddof: int = 1) -> dict[str, tuple[float, float]]:
    """One pass: {col: (mean, sd)} with sample (ddof=1) or population (0) sd."""
    sd = F.stddev_samp if ddof == 1 else F.stddev_pop
    row = df.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
                 *[sd(c).alias(f"s_{i}") for i, c in enumerate(cols)]).first()
    return {c: (row[f"m_{i}"], row[f"s_{i}"]) for i, c in enumerate(cols)}


def guard_sd(sd: float | None, policy: str) -> float | None:
    """W5 zero-sd policies: 'one'/'replace' -> 1.0 for 0, 'epsilon' adds 1e-9,
    'none' leaves 0 (the division then yields null, i.e. an undefined column)."""
    if policy not in ZERO_POLICIES:
        raise ValueError(f"zero policy must be one of {ZERO_POLICIES}")
    if sd is None:
        return None
    if policy in ("one", "replace"):
        return 1.0 if sd == 0 else sd
    if policy == "epsilon":
        return sd + 1e-9
    return sd


def standardize(df: DataFrame, cols: Sequence[str], ddof: int = 1, zero_policy: str = "replace",
                center: bool = True, stats: dict | None = None,
                suffix: str = "") -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """(x - mean) / sd per column with literals from one aggregate.

    Returns the frame and the {col: (mean, guarded sd)} used, so the same
    transform can score new rows (the study's fitted scaler).
    """
    stats = stats or column_stats(df, cols, ddof)
    used = {}
    exprs = {}
    for c in cols:
        m, s = stats[c]
        s = guard_sd(s, zero_policy)
        used[c] = (m, s)
        x = F.col(c).cast("double") - (F.lit(m) if center else F.lit(0.0))
        exprs[c + suffix] = x / F.lit(s) if s else F.lit(None).cast("double")
    return df.withColumns(exprs), used


def center_within(df: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    """X - mean(x) within ``group`` (unweighted), all columns in one aggregate."""
    means = df.groupBy(group).agg(*[F.avg(c).alias(f"__m{i}") for i, c in enumerate(cols)])
    j = df.join(means, group, "inner")
    return j.withColumns({c: F.col(c) - F.col(f"__m{i}") for i, c in enumerate(cols)}) \
        .drop(*[f"__m{i}" for i in range(len(cols))])


def precision_weight(df: DataFrame, impressions: str, out: str = "w") -> DataFrame:
    """sqrt(impressions / mean impressions)."""
    m = df.agg(F.avg(impressions)).first()[0]
    return df.withColumn(out, F.sqrt(F.col(impressions) / F.lit(float(m))))
