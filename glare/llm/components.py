"""Union-find grouping of links: connected components without a driver."""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glare.llm.common import materialize


def _forest(batches):
    """Union-find over the links of one partition: (node, smallest of its group)."""
    up: dict[int, int] = {}

    def find(x):
        root = x
        while up.setdefault(root, root) != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = find(x), find(y)
            up[max(x, y)] = min(x, y)
    rows = [(v, r) for v in list(up) if (r := find(v)) != v]
    yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in rows], pa.int64()),
                                      pa.array([r for _, r in rows], pa.int64())], ["v", "r"])


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has a link, component being the
    smallest node reachable. Links may be repeated, in any order; no links give
    no rows. Each partition's links are first reduced to a forest, then parents
    are replaced by grandparents and competing parents linked, until every node
    has one parent that is a root: a logarithmic number of rounds, each written
    to the shared folder."""
    e = links.select(F.col(a).cast("long"), F.col(b).cast("long")).mapInArrow(_forest, "v long, r long")
    while True:
        e = materialize(e.distinct(), "links")
        m = materialize(e.groupBy("v").agg(F.min("r").alias("m"), F.count("*").alias("k")), "parents")
        up = m.select(F.col("v").alias("m"), F.col("m").alias("g"))
        step = m.join(up, "m", "left")
        if step.filter("k > 1 or g is not null").isEmpty():
            return m.select(F.col("v").alias("node"), F.col("m").alias("component")).unionByName(
                m.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct())
        rivals = e.join(m.filter("k > 1").select("v", "m"), "v").filter("r <> m")
        e = (step.select("v", F.coalesce("g", "m").alias("r"))
             .unionByName(rivals.select(F.col("r").alias("v"), F.col("m").alias("r"))))
