"""Persisted rank index (O3, S7, M4): the share of a reference below a value.

The reference is sorted once and written as a search tree of tables. A leaf is a
row with the distinct values of about ``leaf`` consecutive ranks, how much of the
reference lies before each, and how much up to its end; a node of a higher level
is a row with the first values of its children. The few nodes at the top are the
root. A value descends by one equi-join a level on the node's number, so scoring
neither sorts nor aggregates anything, reads no reference row, and is as valid
for a stream as for a table. Equal values are one entry, however many they are.

Leaves are range-partitioned and sorted by number; ``meta`` is written last, so a
folder without it is no index.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import order_stats

#: ranks of a leaf, children of a node, and most nodes at the top (the root is collected)
LEAF, FANOUT = 1024, 1024


def bisect_left(arr: Column, v: Column, max_len: int) -> Column:
    """Number of elements of the sorted array ``arr`` that are < ``v``, by binary search."""
    init = F.struct(F.lit(0).alias("lo"), F.greatest(F.size(arr), F.lit(0)).alias("hi"))

    def step(acc, _):
        mid = F.shiftright(acc["lo"] + acc["hi"], 1)
        return F.when(acc["lo"] >= acc["hi"], acc) \
            .when(F.element_at(arr, mid + 1) < v, F.struct((mid + 1).alias("lo"), acc["hi"].alias("hi"))) \
            .otherwise(F.struct(acc["lo"].alias("lo"), mid.alias("hi")))

    steps = max(1, math.ceil(math.log2(max_len + 1)))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), init, step)["lo"]


def _sorted_write(df: DataFrame, path: str) -> None:
    df.repartitionByRange("node").sortWithinPartitions("node").write.mode("overwrite").parquet(path)


def write_rank_index(reference: DataFrame, value: str, path: str, leaf: int = LEAF, fanout: int = FANOUT) -> None:
    """Sort the non-null values of ``reference`` once and write the tree. An empty
    reference gives an index of size 0 (every share is null)."""
    spark = reference.sparkSession
    runs = cut_lineage(order_stats.value_runs(reference.select(F.col(value).cast("double").alias("v")), [], "v"))
    n = (runs.agg(F.max("n")).first()[0]) or 0
    # a leaf's values start in the same run of ``leaf`` ranks, so they are at most that many
    entry = F.sort_array(F.collect_list(F.struct("v", "start")))
    leaves = runs.groupBy(F.floor(F.col("start") / leaf).alias("node")).agg(entry.alias("e"), F.max(F.col("start") + F.col("cnt")).alias("end"))
    _sorted_write(leaves.select("node", F.col("e.v").alias("firsts"), F.col("e.start").alias("starts"), "end"), f"{path}/level=0")
    levels = 0
    while True:
        below = spark.read.parquet(f"{path}/level={levels}").select("node", F.get("firsts", F.lit(0)).alias("first"))
        if below.count() <= fanout:
            break
        levels += 1
        entry = F.sort_array(F.collect_list(F.struct("first", "node")))
        up = below.groupBy(F.floor(F.col("node") / fanout).alias("up")).agg(entry.alias("e"))
        _sorted_write(up.select(F.col("up").alias("node"), F.col("e.first").alias("firsts"), F.col("e.node").alias("children")),
                      f"{path}/level={levels}")
    spark.createDataFrame([(n, levels, leaf, fanout)], "n long, levels int, leaf int, fanout int") \
        .write.mode("overwrite").parquet(f"{path}/meta")


@dataclass
class RankIndex:
    """A written index: its size, its tables from the leaves up, and the root's entries."""

    n: int
    leaf: int
    fanout: int
    levels: list[DataFrame]
    firsts: list[float]
    nodes: list[int]

    def share_below(self, df: DataFrame, value: str, out: str) -> DataFrame:
        """``df`` with the share of the reference strictly below ``value`` (null for a
        null value). Rows keep their number; NaN counts as above all numbers."""
        v, width = F.col(value).cast("double"), max(self.leaf, self.fanout)
        if not self.n:
            return df.withColumn(out, F.lit(None).cast("double"))

        names = df.columns
        d = order_stats.with_bisect(df, F.lit(self.firsts), v, len(self.firsts), "__at")
        d = d.withColumn("__node", self._child(F.lit(self.nodes), v).cast("long")).drop("__at")
        for table in reversed(self.levels[1:]):
            t = table.select(F.col("node").alias("__n"), F.col("firsts").alias("__f"), F.col("children").alias("__c"))
            d = order_stats.with_bisect(d.join(t, F.col("__node") == F.col("__n"), "left"), F.col("__f"), v, width, "__at")
            d = d.select(*names, self._child(F.col("__c"), v).alias("__node"))
        t = self.levels[0].select(F.col("node").alias("__n"), F.col("firsts").alias("__f"), "starts", F.col("end").alias("__e")) \
            .withColumnRenamed("starts", "__s")
        d = order_stats.with_bisect(d.join(t, F.col("__node") == F.col("__n"), "left"), F.col("__f"), v, width, "__at")
        below = F.coalesce(F.get(F.col("__s"), F.col("__at")), F.col("__e"), F.lit(0)) / F.lit(float(self.n))
        return d.select(*(c for c in names if c != out), F.when(v.isNotNull(), below).alias(out))

    @staticmethod
    def _child(of: Column, v: Column) -> Column:
        """The last child that begins below the value (none: null)."""
        return F.when(v.isNotNull() & (F.col("__at") > 0), F.get(of, F.col("__at") - 1))


def load_rank_index(spark: SparkSession, path: str) -> RankIndex:
    """Open a written index: reads its size and the root (at most ``fanout`` entries)."""
    meta = spark.read.parquet(f"{path}/meta").first()
    levels = [spark.read.parquet(f"{path}/level={k}") for k in range(meta.levels + 1)]
    root = levels[-1].select(F.get("firsts", F.lit(0)).alias("f"), "node").orderBy("f").collect()
    return RankIndex(meta.n, meta.leaf, meta.fanout, levels, [r.f for r in root], [r.node for r in root])
