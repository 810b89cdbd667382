"""Predictive bands from a table of posterior draws.

For a score s and draws (a, b) the band is the mean and two percentiles of
sigmoid(a + b * (s - centre)) over all draws. Rows share scores, so the product
is taken once per distinct score; it is cut into blocks of draws and chunks of
scores, and no task holds more than a slice of one block by one chunk.

Percentiles are exact. The draws are dealt into blocks by hash, so the same rank
within each block brackets the wanted rank of all: below the least of the lower
values lie too few draws, up to the greatest of the upper ones lie enough. A
second pass counts the draws below the bracket and keeps only the few inside it.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import sigmoid
from ..session import cut_lineage

#: draws of a block, scores of a chunk (by hash, so about), and scores at a time in a task
DRAW_BLOCK, SCORE_CHUNK, SLICE = 8192, 1024, 64


def linear_draws(draws: DataFrame, intercept, slope, keys: Sequence[str] = ("chain", "draw"), param: str = "param",
                 value: str = "value") -> DataFrame:
    """(keys, a, b) of a long draws table: one row per draw that has both parameters finite."""
    def of(name):
        return F.max(F.when(F.col(param) == F.lit(name), F.col(value).cast("double")))

    wide = draws.where(F.col(param).isin([intercept, slope])).groupBy(*keys).agg(of(intercept).alias("a"), of(slope).alias("b"))
    return wide.where((F.abs("a") < float("inf")) & (F.abs("b") < float("inf")))


def _grid(chunks: DataFrame, blocks: DataFrame, n_chunks: int, n_blocks: int):
    """Every chunk with every block, one row each."""
    left = chunks.withColumn("__blk", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    right = blocks.withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))))
    return left.groupBy("__chunk", "__blk").cogroup(right.groupBy("__chunk", "__blk"))


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().values.to_numpy()


def band_table(scores: DataFrame, draws: DataFrame, centre: float, quantiles: Sequence[float] = (0.03, 0.97),
               keys: Sequence[str] = ("chain", "draw"), draw_block: int = DRAW_BLOCK, score_chunk: int = SCORE_CHUNK) -> DataFrame:
    """(score, p_mean, q0, q1, ...) for the distinct non-null scores of a
    one-column frame; ``draws`` is (keys, a, b), one row for each key. Quantiles
    interpolate linearly between neighbouring draws. Without draws: no rows."""
    u = cut_lineage(scores.select(F.col(scores.columns[0]).cast("double").alias("score")).where("score is not null").distinct())
    d = cut_lineage(draws.select(F.xxhash64(*keys).alias("__h"), "a", "b"))
    total, n_chunks = d.count(), max(1, math.ceil(u.count() / score_chunk))
    if not total:
        return u.where("false").select("score", *(F.lit(None).cast("double").alias(c) for c in
                                                  ("p_mean", *(f"q{i}" for i in range(len(quantiles))))))
    n_blocks = math.ceil(total / draw_block)
    blocks = d.groupBy(F.pmod("__h", F.lit(n_blocks)).cast("int").alias("__blk")).agg(
        F.collect_list(F.struct("a", "b")).alias("d")).select("__blk", F.col("d.a").alias("a"), F.col("d.b").alias("b"))
    blocks = cut_lineage(blocks)
    chunk = F.pmod(F.xxhash64("score"), F.lit(n_chunks)).cast("int").alias("__chunk")
    # ranks around each quantile among all draws
    at = [(q, math.floor(q * (total - 1)), min(math.floor(q * (total - 1)) + 1, total - 1)) for q in quantiles]

    def slices(left, right):
        s, a, b = _column(left, "s"), _column(right, "a"), _column(right, "b")
        for lo in range(0, len(s), SLICE):
            part = slice(lo, lo + SLICE)
            yield part, s[part], a[None, :] + (s[part] - centre)[:, None] * b[None, :]

    def bracket(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], []] + [[] for _ in range(2 * len(at))]
        if left.num_rows and right.num_rows:
            n = len(_column(right, "a"))
            ranks = [r for _, low, high in at for r in (low * n // total, -(-(high + 1) * n // total) - 1)]
            for _, s, eta in slices(left, right):
                with np.errstate(over="ignore"):
                    mass = (1 / (1 + np.exp(-eta))).sum(axis=1)
                eta.partition(sorted(set(ranks)), axis=1)
                for col, v in zip(out, (s, mass, *(eta[:, r] for r in ranks))):
                    col.append(v)
        return pa.table([pa.array(np.concatenate(c) if c else [], pa.float64()) for c in out],
                        names=["score", "mass", *(f"{e}{i}" for i in range(len(at)) for e in ("lo", "hi"))])

    def inside(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["score", *(f"{e}{i}" for i in range(len(at)) for e in ("below", "in"))]
        out = [[] for _ in names]
        if left.num_rows and right.num_rows:
            for part, s, eta in slices(left, right):
                out[0].extend(s.tolist())
                for i in range(len(at)):
                    lo, hi = (_column(left, f"{e}{i}")[part][:, None] for e in ("lo", "hi"))
                    out[2 * i + 1].extend((eta < lo).sum(axis=1).tolist())
                    out[2 * i + 2].extend(row[keep] for row, keep in zip(eta, (eta >= lo) & (eta <= hi)))
        kinds = [pa.float64(), *[pa.int64(), pa.list_(pa.float64())] * len(at)]
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    ends = [f"{e}{i}" for i in range(len(at)) for e in ("lo", "hi")]
    first = _grid(u.groupBy(chunk).agg(F.collect_list("score").alias("s")), blocks, n_chunks, n_blocks).applyInArrow(
        bracket, "score double, mass double" + "".join(f", {e} double" for e in ends))
    brackets = cut_lineage(first.groupBy("score").agg(
        (F.sum("mass") / F.lit(float(total))).alias("p_mean"),
        *((F.min if e.startswith("lo") else F.max)(e).alias(e) for e in ends)))

    chunks = brackets.groupBy(chunk).agg(F.collect_list(F.struct("score", *ends)).alias("c")).select(
        "__chunk", F.col("c.score").alias("s"), *(F.col(f"c.{e}").alias(e) for e in ends))
    second = _grid(chunks, blocks, n_chunks, n_blocks).applyInArrow(
        inside, "score double" + "".join(f", below{i} long, in{i} array<double>" for i in range(len(at))))
    counted = second.groupBy("score").agg(
        *(F.sum(f"below{i}").alias(f"below{i}") for i in range(len(at))),
        *(F.sort_array(F.flatten(F.collect_list(f"in{i}"))).alias(f"in{i}") for i in range(len(at))))

    def value(i, rank):
        return sigmoid(F.element_at(f"in{i}", (F.lit(rank) - F.col(f"below{i}") + 1).cast("int")))

    found = counted.select("score", *(
        (value(i, low) + F.lit(q * (total - 1) - low) * (value(i, high) - value(i, low))).alias(f"q{i}") for i, (q, low, high) in enumerate(at)))
    return brackets.select("score", "p_mean").join(found, "score")


def with_band(rows: DataFrame, score: str, draws: DataFrame, centre: float, quantiles: Sequence[float] = (0.03, 0.97),
              names: Sequence[str] = ("p_mean", "p_lo", "p_hi"), keys: Sequence[str] = ("chain", "draw"), **sizes) -> DataFrame:
    """``rows`` with the mean and the quantiles of their predictive probability
    (null for a null score, and for all if there are no draws)."""
    bands = band_table(rows.select(score), draws, centre, quantiles, keys, **sizes)
    bands = bands.select(F.col("score").alias("__score"), F.col("p_mean").alias(names[0]),
                         *(F.col(f"q{i}").alias(n) for i, n in enumerate(names[1:])))
    return rows.join(bands, F.col(score).cast("double") == F.col("__score"), "left").drop("__score")
