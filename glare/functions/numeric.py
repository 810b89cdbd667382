"""Column arithmetic used by the models."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def log_engagement(c) -> Column:
    """C4: log(1 + x)."""
    return F.log1p(_c(c).cast("double"))


def empirical_logit(clicks, impressions) -> Column:
    """log((c + .5) / (i - c + .5))."""
    c, i = _c(clicks).cast("double"), _c(impressions).cast("double")
    return F.log((c + 0.5) / (i - c + 0.5))


def sigmoid(x) -> Column:
    """C7."""
    return 1.0 / (1.0 + F.exp(-_c(x)))


def indicator(c, value) -> Column:
    """1.0 where ``c == value`` else 0.0."""
    return (_c(c) == F.lit(value)).cast("double")


def label_name(c, names: dict) -> Column:
    """Map codes to names."""
    expr = None
    for k, v in names.items():
        expr = F.when(_c(c) == F.lit(k), F.lit(v)) if expr is None else expr.when(_c(c) == F.lit(k), F.lit(v))
    return expr


def stratum(source, fake) -> Column:
    """``source_real`` / ``source_fake``."""
    return F.concat_ws("_", _c(source), label_name(fake, {0: "real", 1: "fake"}))


def row_sum(cols: Sequence) -> Column:
    """Sum across columns within a row."""
    return reduce(add, [_c(c) for c in cols])


def share(pred) -> Column:
    """Share of rows where ``pred`` holds (as an aggregate)."""
    return F.avg(_c(pred).cast("double"))
