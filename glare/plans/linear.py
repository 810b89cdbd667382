"""Ridge attention score (M1-M4) and the scoring bundle.

The fit is a closed-form ridge on population-standardized features, solved on
the driver from one distributed Gram aggregate; scoring is a plain column
expression with the coefficients as literals, so it stays in codegen.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import order_stats
from ..operators.gram import gram
from ..operators.rank_index import RankIndex, load_rank_index, write_rank_index
from ..session import cut_lineage


@dataclass
class RidgeModel:
    features: list[str]
    means: np.ndarray
    sds: np.ndarray
    coef: np.ndarray
    intercept: float
    alpha: float

    def raw_score(self) -> Column:
        """M2: intercept + sum coef * (x - mean) / sd."""
        expr = F.lit(float(self.intercept))
        for f, m, s, c in zip(self.features, self.means, self.sds, self.coef):
            expr = expr + F.lit(float(c)) * ((F.col(f).cast("double") - F.lit(float(m))) / F.lit(float(s)))
        return expr

    def coefficients(self, spark: SparkSession) -> DataFrame:
        rows = [(f, float(m), float(s), float(c)) for f, m, s, c in
                zip(self.features, self.means, self.sds, self.coef)]
        rows.append(("(intercept)", 0.0, 1.0, float(self.intercept)))
        return spark.createDataFrame(rows, "feature string, mean double, sd double, coef double")

    @staticmethod
    def from_coefficients(df: DataFrame, alpha: float = 1.0) -> "RidgeModel":
        rows = df.collect()
        body = [r for r in rows if r.feature != "(intercept)"]
        icpt = [r.coef for r in rows if r.feature == "(intercept)"][0]
        return RidgeModel([r.feature for r in body], np.array([r.mean for r in body]),
                          np.array([r.sd for r in body]), np.array([r.coef for r in body]), icpt, alpha)


def fit_ridge(df: DataFrame, features: Sequence[str], y: str, alpha: float = 1.0) -> RidgeModel:
    """M1: ridge with a free intercept on population-standardized features
    (a zero sd is treated as 1, as a standard scaler does)."""
    g = gram(df, list(features), y)
    n = g.n
    xbar = g.sx() / n
    ybar = g.sy() / n
    sxx = g.xtx() - n * np.outer(xbar, xbar)
    sxy = g.xty() - n * xbar * ybar
    sd = np.sqrt(np.clip(np.diag(sxx) / n, 0, None))
    sd = np.where(sd == 0, 1.0, sd)
    zz = sxx / np.outer(sd, sd)
    zy = sxy / sd
    coef = np.linalg.solve(zz + alpha * np.eye(len(sd)), zy)
    return RidgeModel(list(features), xbar, sd, coef, ybar, alpha)


def attention_score(train: DataFrame, held: DataFrame, features: Sequence[str], y: str,
                    alpha: float = 1.0, out: str = "attention_score",
                    raw: str = "raw_score") -> tuple[DataFrame, RidgeModel]:
    """M3: fit on split A, score split B, percentile-rank B (average ties)."""
    model = fit_ridge(train, features, y, alpha)
    scored = held.withColumn(raw, model.raw_score())
    ranked = order_stats.percent_rank_average(scored, raw, out)
    return ranked, model


def score_against_reference(df: DataFrame, model: RidgeModel, reference: DataFrame,
                            ref_col: str = "raw_score", out: str = "attention_score") -> DataFrame:
    """M4: out-of-sample score = share of the reference raw scores strictly
    below this row's raw score."""
    # the scored rows are read twice (distinct scores, then the join back);
    # a checkpoint keeps both plans short
    scored = cut_lineage(df.withColumn("__raw", model.raw_score()))
    return order_stats.share_below(scored, "__raw", reference, ref_col, out).drop("__raw")


def score_against_index(df: DataFrame, model: RidgeModel, index: RankIndex, out: str = "attention_score") -> DataFrame:
    """M4 against a persisted reference: share of it strictly below each row's raw
    score. Rows are looked up, nothing is sorted; also for streams."""
    return index.share_below(df.withColumn("__raw", model.raw_score()), "__raw", out).drop("__raw")


def ranked_coefficients(spark: SparkSession, model: RidgeModel, k: int | None = None) -> DataFrame:
    """O1 + O2: coefficients in descending size, the ``k`` largest where asked for."""
    out = model.coefficients(spark).where(F.col("feature") != "(intercept)").orderBy(F.abs("coef").desc(), "feature")
    return out if k is None else out.limit(k)


def save_bundle(model: RidgeModel, reference: DataFrame, path: str, ref_col: str = "raw_score") -> None:
    """Coefficient table, reference raw scores in order (O3) and their rank
    index, all parquet."""
    spark = reference.sparkSession
    model.coefficients(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/coefficients")
    ref = reference.select(F.col(ref_col).alias("raw_score"))
    ref.repartitionByRange("raw_score").sortWithinPartitions("raw_score").write.mode("overwrite").parquet(f"{path}/reference")
    write_rank_index(spark.read.schema(ref.schema).parquet(f"{path}/reference"), "raw_score", f"{path}/rank_index")


def load_bundle(spark: SparkSession, path: str) -> tuple[RidgeModel, DataFrame]:
    return (RidgeModel.from_coefficients(spark.read.parquet(f"{path}/coefficients")),
            spark.read.parquet(f"{path}/reference"))


def load_scorer(spark: SparkSession, path: str) -> tuple[RidgeModel, RankIndex]:
    """The bundle for scoring: coefficients and rank index; the reference is not read."""
    return RidgeModel.from_coefficients(spark.read.parquet(f"{path}/coefficients")), load_rank_index(spark, f"{path}/rank_index")
