"""Exact order statistics without a single-partition sort.

``rank().over(Window.orderBy(v))`` and a window per group both funnel a whole
group into one task. The operators here keep every task bounded:

1. ties collapse first (``groupBy(group, v)``, partial aggregation), so a hot
   value is one row;
2. each large group is cut into value ranges with ``percentile_approx``
   (the cuts only balance load; the answer stays exact), and each row finds
   its range with a binary search of a few projections;
3. range totals are prefix-summed over the small (group, range) table;
4. within a range a window of bounded size finishes the ordering.

Everything is a deterministic function of the data, so a retried task gets
the same positions. On top of the run table (distinct values with start
position and multiplicity) sit: average-tie percentile rank (W2), share of a
reference strictly below (W3), linear-interpolated quantiles (A7), highest
density intervals (W6) and exact per-row positions (exact splits).
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_RANGE = 1_000_000


def with_bisect(df: DataFrame, arr: Column, v: Column, max_len: int, out: str, right: bool = False) -> DataFrame:
    """``df`` with the number of elements of the sorted array ``arr`` (of at most
    ``max_len``) that are < ``v``, or <= ``v`` (``right``); 0 for a null array or value.

    A binary search from the highest bit of the number down, one projection of plain
    column operations a bit, so it is compiled with the join or scan that it follows
    and the array's row is not copied."""
    df = df.withColumn(out, F.lit(0))
    for k in reversed(range(max_len.bit_length())):
        e = F.get(arr, F.col(out) + F.lit((1 << k) - 1))
        df = df.withColumn(out, F.col(out) + F.when(e <= v if right else e < v, F.lit(1 << k)).otherwise(F.lit(0)))
    return df


def _with_ranges(df: DataFrame, groups: Sequence[str], value: str,
                 rows_per_range: int, uniform: bool = False) -> DataFrame:
    """Add ``__b``: the value-range index of each row inside its group.

    ``uniform=True`` is for values spread evenly over [0, 1) (seeded hashes):
    the range is ``floor(v * k)`` with ``k`` a multiple of the shuffle
    partition count, so no sizing pass is needed.
    """
    groups = list(groups)
    if uniform:
        k = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
        return df.withColumn("__b", F.least(F.floor(F.col(value) * k), F.lit(k - 1)).cast("int"))
    if groups:
        sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("__gn"))
        nmax = sizes.agg(F.max("__gn")).first()[0] or 0
    else:
        sizes = None
        nmax = df.count()
    k = math.ceil(nmax / rows_per_range) if nmax else 1
    if k <= 1:
        return df.withColumn("__b", F.lit(0))
    fractions = [i / k for i in range(1, k)]
    accuracy = max(10_000, 8 * k)
    if groups:
        big = sizes.where(F.col("__gn") > rows_per_range).select(*groups)
        cuts = df.join(big, groups, "left_semi").groupBy(*groups) \
            .agg(F.percentile_approx(value, fractions, accuracy).alias("__cuts"))
        # one row per large group; AQE broadcasts it at runtime when small
        out = df.join(cuts, groups, "left")
    else:
        cut_values = df.agg(F.percentile_approx(value, fractions, accuracy)).first()[0]
        out = df.withColumn("__cuts", F.lit(cut_values))
    return with_bisect(out, F.col("__cuts"), F.col(value), k, "__b", right=True).drop("__cuts")


def _range_offsets(ranged: DataFrame, groups: list[str], weight: str) -> DataFrame:
    """(groups, __b) -> __off (weight in earlier ranges), __n (group total)."""
    tot = ranged.groupBy(*groups, "__b").agg(F.sum(weight).alias("__bw"))
    w_run = (Window.partitionBy(*groups) if groups else Window.partitionBy()).orderBy("__b") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w_all = Window.partitionBy(*groups) if groups else Window.partitionBy()
    # the (group, range) table has at most k rows per group
    return tot.select(*groups, "__b",
                      (F.sum("__bw").over(w_run) - F.col("__bw")).alias("__off"),
                      F.sum("__bw").over(w_all).alias("__n"))


def value_runs(df: DataFrame, groups: Sequence[str], value: str,
               weight: str | None = None,
               rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Distinct (groups, value) with ``cnt`` (rows or summed weight),
    ``start`` (weight strictly below within the group) and ``n`` (group total)."""
    groups = list(groups)
    w = F.col(weight) if weight else F.lit(1)
    d = df.where(F.col(value).isNotNull()).groupBy(*groups, value) \
        .agg(F.sum(w).cast("long").alias("cnt"))
    ranged = _with_ranges(d, groups, value, rows_per_range)
    offs = _range_offsets(ranged, groups, "cnt")
    within = Window.partitionBy(*groups, "__b").orderBy(value) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.join(offs, [*groups, "__b"], "inner")
    return out.select(*groups, value, "cnt",
                      (F.col("__off") + F.sum("cnt").over(within) - F.col("cnt")).alias("start"),
                      F.col("__n").alias("n"))


def positions(df: DataFrame, groups: Sequence[str], value: str, tiebreak: str,
              rows_per_range: int = ROWS_PER_RANGE, uniform: bool = False) -> DataFrame:
    """Per-row 0-based ``__pos`` in (value, tiebreak) order within the group,
    plus the group size ``__n``. Meant for near-unique keys (hashes, ids);
    ``uniform`` for values evenly spread over [0, 1)."""
    groups = list(groups)
    ranged = _with_ranges(df.withColumn("__one", F.lit(1)), groups, value, rows_per_range, uniform)
    offs = _range_offsets(ranged, groups, "__one")
    within = Window.partitionBy(*groups, "__b").orderBy(value, tiebreak)
    out = ranged.join(offs, [*groups, "__b"], "inner")
    return out.withColumn("__pos", F.col("__off") + F.row_number().over(within) - 1) \
        .drop("__b", "__off", "__one")


def value_at(runs: DataFrame, probes: DataFrame, groups: Sequence[str], pos: str,
             value: str, out: str, block: int = ROWS_PER_RANGE) -> DataFrame:
    """Attach to each probe row the ``value`` found at 0-based position ``pos``
    of its group (from ``value_runs``), as column ``out``.

    Runs and probes meet in windows on (group, position block), in the order of
    their positions, and a probe takes the last run before it: work grows with
    their number times its logarithm. A run is repeated once per block it covers,
    so no task holds more than a block's worth of runs.
    """
    groups = list(groups)
    end, known = F.col("start") + F.col("cnt"), F.lit(True)
    for g in groups:
        known = known & F.col(g).isNotNull()
    r = runs.where((F.col("cnt") > 0) & known).select(
        *groups, F.col("start").alias("__at"), F.lit(0).alias("__kind"), F.struct(F.col(value).alias("v"), end.alias("end")).alias("__run"),
        F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))).alias("__blk"))
    p = probes.where(known & F.col(pos).isNotNull()).select(
        *groups, F.col(pos).alias("__at"), F.lit(1).alias("__kind"), F.floor(F.col(pos) / block).alias("__blk"),
        F.struct(*[c for c in probes.columns if c not in groups]).alias("__probe"))
    before = Window.partitionBy(*groups, "__blk").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j = r.unionByName(p, allowMissingColumns=True).withColumn("__run", F.last("__run", True).over(before)) \
        .where((F.col("__kind") == 1) & (F.col("__at") < F.col("__run.end")))
    return j.select(*groups, "__probe.*", F.col("__run.v").alias(out))


# --------------------------------------------------------------- consumers
def percent_rank_average(df: DataFrame, value: str, out: str = "pct",
                         groups: Sequence[str] = (),
                         rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Pandas ``rank(pct=True)``: (start + (ties + 1) / 2) / N, null stays null."""
    groups = list(groups)
    runs = value_runs(df, groups, value, rows_per_range=rows_per_range)
    runs = runs.select(*groups, value,
                       ((F.col("start") + (F.col("cnt") + 1) / 2.0) / F.col("n")).alias(out))
    return df.join(runs, [*groups, value], "left")


def share_below(df: DataFrame, value: str, reference: DataFrame, ref_value: str,
                out: str = "pct", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """For each row, the share of reference values strictly below it
    (``searchsorted(sorted_ref, v) / len(ref)``)."""
    q = df.select(F.col(value).alias("__v")).distinct().withColumn("__w", F.lit(0))
    r = reference.select(F.col(ref_value).alias("__v")).where(F.col("__v").isNotNull()) \
        .withColumn("__w", F.lit(1))
    runs = value_runs(q.unionByName(r), [], "__v", "__w", rows_per_range)
    runs = runs.select(F.col("__v").alias(value), (F.col("start") / F.col("n")).alias(out))
    return df.join(runs, value, "left")


def quantiles(df: DataFrame, value: str, qs: Sequence[float], groups: Sequence[str] = (),
              rows_per_range: int = ROWS_PER_RANGE, runs: DataFrame | None = None) -> DataFrame:
    """Numpy-style linear-interpolated quantiles, one row per (group, q);
    ``runs``: the table's ``value_runs``, where the caller has them."""
    groups = list(groups)
    runs = value_runs(df, groups, value, rows_per_range=rows_per_range) if runs is None else runs
    sizes = runs.groupBy(*groups).agg(F.first("n").alias("n")) if groups else \
        runs.agg(F.first("n").alias("n"))
    # one probe per group and q
    probes = sizes.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs]))) \
        .withColumn("h", F.col("q") * (F.col("n") - 1)) \
        .withColumn("lo", F.floor("h")).withColumn("hi", F.ceil("h"))
    lo = value_at(runs, probes, groups, "lo", value, "v_lo", rows_per_range)
    both = value_at(runs, lo, groups, "hi", value, "v_hi", rows_per_range)
    return both.select(*groups, "q",
                       (F.col("v_lo") + (F.col("h") - F.col("lo")) * (F.col("v_hi") - F.col("v_lo")))
                       .alias("value"))


def hdi(df: DataFrame, value: str, groups: Sequence[str], mass: float = 0.94,
        rows_per_range: int = ROWS_PER_RANGE, runs: DataFrame | None = None) -> DataFrame:
    """Shortest interval holding ``mass`` of the draws, per group;
    ``runs``: the table's ``value_runs``, where the caller has them.

    Candidate lower ends are the first position of each distinct value; the
    upper end is the value ``floor(mass * n)`` positions later; ties on width
    keep the lowest start (the first minimum).
    """
    groups = list(groups)
    runs = value_runs(df, groups, value, rows_per_range=rows_per_range) if runs is None else runs
    cand = runs.withColumn("__k", F.floor(F.col("n") * mass).cast("long")) \
        .withColumn("__t", F.col("start") + F.col("__k")) \
        .where(F.col("__t") <= F.col("n") - 1) \
        .select(*groups, F.col(value).alias("hdi_lo"), F.col("start").alias("__s"), "__t")
    hit = value_at(runs, cand, groups, "__t", value, "hdi_hi", rows_per_range)
    best = hit.groupBy(*groups).agg(F.min(F.struct(
        (F.col("hdi_hi") - F.col("hdi_lo")).alias("w"), F.col("__s").alias("s"),
        "hdi_lo", "hdi_hi")).alias("__m"))
    return best.select(*groups, "__m.hdi_lo", "__m.hdi_hi")
