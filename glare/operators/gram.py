"""Weighted Gram aggregate (A12): every model here is fitted from these sums.

For a design z = [1, x_1..x_p, y] and weight w the aggregate is the
(p+2)x(p+2) matrix sum(w * z z^T): it holds n, the column sums, X'WX, X'Wy
and y'Wy. Two equal ways to compute it:

* ``sql``: one ``agg`` of (p+2)(p+3)/2 sums (used for small p and for the
  oracle-checked query);
* ``arrow``: ``mapInPandas`` builds each partition's partial matrix with one
  numpy product and Spark sums the partials by cell; faster for large p.

Both are map-side reductions: a data partition emits one small row set, and
only (p+2)^2 numbers reach the driver.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Gram:
    def __init__(self, names: Sequence[str], m: np.ndarray, rows: float | None = None):
        self.names = list(names)          # ["1", x..., y]
        self.m = m
        self.rows = float(m[0, 0]) if rows is None else float(rows)   # unweighted count of the rows summed

    @property
    def n(self) -> float:
        return float(self.m[0, 0])

    @property
    def p(self) -> int:
        return len(self.names) - 2

    def xtx(self) -> np.ndarray:
        return self.m[1:-1, 1:-1]

    def xty(self) -> np.ndarray:
        return self.m[1:-1, -1]

    def sx(self) -> np.ndarray:
        return self.m[0, 1:-1]

    def sy(self) -> float:
        return float(self.m[0, -1])

    def yty(self) -> float:
        return float(self.m[-1, -1])


def _design(df: DataFrame, xcols: Sequence[str], y: str, w: str | None) -> DataFrame:
    cols = [F.lit(1.0).alias("__z0")] + [F.col(c).cast("double").alias(f"__z{i + 1}") for i, c in enumerate(xcols)]
    cols.append(F.col(y).cast("double").alias(f"__z{len(xcols) + 1}"))
    cols.append((F.col(w).cast("double") if w else F.lit(1.0)).alias("__w"))
    return df.select(*cols)


def gram_long(df: DataFrame, xcols: Sequence[str], y: str, w: str | None = None) -> DataFrame:
    """Upper triangle as rows (row_name, col_name, value) via SQL sums."""
    names = ["1", *xcols, y]
    d = _design(df, xcols, y, w)
    q = len(names)
    aggs = [F.sum(F.col("__w") * F.col(f"__z{i}") * F.col(f"__z{j}")).alias(f"g_{i}_{j}")
            for i in range(q) for j in range(i, q)]
    wide = d.agg(*aggs)
    stack = ", ".join(f"'{names[i]}', '{names[j]}', g_{i}_{j}" for i in range(q) for j in range(i, q))
    return wide.selectExpr(f"stack({q * (q + 1) // 2}, {stack}) as (row_name, col_name, value)")


def _partial_gram(q: int):
    def run(batches):
        import pandas as pd
        acc, rows = np.zeros((q, q)), 0
        for b in batches:
            z = b[[f"__z{i}" for i in range(q)]].to_numpy(dtype=float)
            w = b["__w"].to_numpy(dtype=float)
            acc += (z * w[:, None]).T @ z
            rows += len(b)
        ii, jj = np.triu_indices(q)
        yield pd.DataFrame({"i": np.append(ii, -1).astype("int32"), "j": np.append(jj, -1).astype("int32"),
                            "v": np.append(acc[ii, jj], float(rows))})
    return run


def gram(df: DataFrame, xcols: Sequence[str], y: str, w: str | None = None,
         method: str = "auto") -> Gram:
    """Collect the weighted Gram matrix (rows with a null anywhere are dropped)."""
    names = ["1", *xcols, y]
    q = len(names)
    d = _design(df.na.drop(subset=[*xcols, y] + ([w] if w else [])), xcols, y, w)
    if method == "auto":
        method = "sql" if len(xcols) <= 5 else "arrow"
    m, rows = np.zeros((q, q)), 0.0
    if method == "sql":
        aggs = [F.sum(F.col("__w") * F.col(f"__z{i}") * F.col(f"__z{j}")).alias(f"g_{i}_{j}")
                for i in range(q) for j in range(i, q)]
        row = d.agg(*aggs, F.count(F.lit(1)).alias("n_rows")).first()
        rows = row["n_rows"]
        for i in range(q):
            for j in range(i, q):
                m[i, j] = m[j, i] = row[f"g_{i}_{j}"] or 0.0
    else:
        parts = d.mapInPandas(_partial_gram(q), "i int, j int, v double") \
            .groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
        for r in parts:
            if r.i < 0:
                rows = r.v
            else:
                m[r.i, r.j] = m[r.j, r.i] = r.v
    return Gram(names, m, rows)
