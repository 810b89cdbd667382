"""Corpus preparation: keep-first dedup, seeded samples and splits, group filters.

Design notes for scale:

* Dedup is a hash aggregate with ``min_by``: map-side partial aggregation
  collapses a hot title before the shuffle, and the winner depends only on the
  explicit load-order key, never on partition layout.
* Seeded randomness is ``md5(seed-key)``: a pure function of the row, so a
  retried task or a different partition count gives the same rows.
* Group filters (tests with two or more distinct headlines) aggregate per
  group and semi-join back; with AQE a hot group is split by the skew-join
  rule instead of landing in one window task.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import order_stats


def seeded_uniform(seed: int, *keys) -> Column:
    """A deterministic pseudo-random number in [0, 1) per row from its key."""
    h = F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]))
    # first 13 hex digits = 52 bits -> exact in a double
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / float(16 ** 13)


def seeded_key(seed: int, *keys) -> Column:
    """Sort key for seeded samples: the md5 hex string (same in DuckDB)."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def dedup_keep_first(df: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """A3: one row per ``key`` (nulls dropped first), the one smallest in ``order``."""
    cols = [c for c in df.columns if c != key]
    packed = F.struct(*[F.col(c) for c in cols])
    out = df.where(F.col(key).isNotNull()).groupBy(key) \
        .agg(F.min_by(packed, F.col(order)).alias("__row"))
    return out.select(key, *[F.col("__row." + c).alias(c) for c in cols])


def sample_rows(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """Exactly ``min(n, rows)`` rows chosen by seeded hash order.

    The limit is the feature here (an exact-n sample); Spark plans it as a
    per-partition top-n and a merge of the partial tops.
    """
    return df.withColumn("__k", seeded_key(seed, key)).orderBy("__k", key).limit(n).drop("__k")


def qualifying_groups(df: DataFrame, group: str, value: str,
                      min_distinct: int = 2) -> DataFrame:
    """A4: groups with at least ``min_distinct`` distinct non-null ``value``s.

    For the common threshold of 2 this is ``min <> max`` (partial aggregates,
    no distinct shuffle); otherwise an exact ``count(distinct)``.
    """
    g = df.where(F.col(group).isNotNull())
    if min_distinct == 2:
        return g.groupBy(group).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi")) \
            .where(F.col("__lo") != F.col("__hi")).select(group)
    return g.groupBy(group).agg(F.countDistinct(value).alias("__n")) \
        .where(F.col("__n") >= min_distinct).select(group)


def sample_groups(keys: DataFrame, group: str, max_groups: int | None, seed: int) -> DataFrame:
    """At most ``max_groups`` whole groups, seeded; all of them when fewer."""
    if max_groups is None:
        return keys
    return sample_rows(keys, max_groups, seed, group)


def keep_groups(df: DataFrame, keys: DataFrame, group: str) -> DataFrame:
    """Left-semi join on qualifying keys (null keys never match)."""
    return df.join(keys, group, "left_semi")


def stratified_split(df: DataFrame, strata: Sequence[str], key: str, seed: int,
                     fraction: float = 0.5, exact: bool = False) -> DataFrame:
    """Adds ``split`` = 'A' (train) or 'B' (held out).

    Default: a per-row hash threshold, no shuffle, about ``fraction`` per
    stratum. ``exact=True``: within each stratum the first
    ``floor(n * fraction)`` rows in seeded hash order go to A, ranked with the
    distributed order-statistics operator (no single-stratum window).
    """
    u = seeded_uniform(seed, key)
    if not exact:
        return df.withColumn("split", F.when(u < fraction, "A").otherwise("B"))
    h = df.withColumn("__h", u)
    pos = order_stats.positions(h, list(strata), "__h", tiebreak=key, uniform=True)
    return pos.withColumn("split", F.when(F.col("__pos") < F.floor(F.col("__n") * fraction), "A")
                          .otherwise("B")).drop("__pos", "__n", "__h")
