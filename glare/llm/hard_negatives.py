"""Operator 12: hard-negative mining by anchor-clustered shared lists."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glare.llm.common import materialize, table
from glare.llm.shared_lists import BLOCK, LEAST, MOST, TILE, directions, pack_vectors, tiles_of, top_scores

#: components become floor(SCALE * x)
SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: a negative's score as a percentage of its positive's
LOW_PERCENT, HIGH_PERCENT = 30, 90
#: clusters of anchor directions, and the most anchors that teach them
CLUSTERS, SAMPLE = 16, 4096


def _usable(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, v): the rows that take part."""
    v = F.transform(vector_col, lambda x: x.cast("double"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return (df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("v"))
            .filter("id is not null and label is not null and v is not null").filter((F.size("v") > 0) & F.forall("v", finite)))


def anchor_centres(anchors: DataFrame, clusters: int = CLUSTERS, sample: int = SAMPLE, rounds: int = 8) -> dict[int, np.ndarray]:
    """Unit centres by vector length, by spherical k-means on at most ``sample``
    anchors (by hash of the id). They only decide which vectors share a list."""
    rows = anchors.select(F.xxhash64("id").alias("h"), "v").orderBy("h", "v").limit(sample).collect()
    out = {}
    for d in {len(r.v) for r in rows}:
        x, _ = directions(np.array([r.v for r in rows if len(r.v) == d]))
        c = x[:1]
        while len(c) < min(clusters, len(x)):  # the vector farthest from the centres so far
            c = np.concatenate([c, x[[(x @ c.T).max(axis=1).argmin()]]])
        for _ in range(rounds):
            nearest = (x @ c.T).argmax(axis=1)
            c = np.stack([directions(x[nearest == i].sum(axis=0)[None])[0][0] if (nearest == i).any() else c[i] for i in range(len(c))])
        out[d] = c
    return out


def quantised_vectors(rows: DataFrame, centres: dict[int, np.ndarray], scale: int = SCALE) -> DataFrame:
    """(d, cluster, row, id, label, q): components floor(scale * x), nearest centre of
    the vector's length, a number for each row. Written."""
    def run(batches):
        for b in batches:
            made = [[], [], []]
            for v in b.column("v").to_pylist():
                q = np.floor(scale * np.array(v))
                c = centres.get(len(q))
                made[0].append(len(q))
                made[1].append(0 if c is None else int((c @ directions(q[None])[0][0]).argmax()))
                made[2].append(pack_vectors(q))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(made[0], pa.int32()),
                                              pa.array(made[1], pa.int32()), pa.array(made[2], pa.binary())],
                                             ["id", "label", "d", "cluster", "q"])

    made = rows.mapInArrow(run, "id long, label long, d int, cluster int, q binary")
    # written, so that a row keeps its number
    return materialize(made.withColumn("row", F.monotonically_increasing_id()), "vectors")


def hard_negatives(df: DataFrame, is_anchor: str, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW_PERCENT, high: int = HIGH_PERCENT,
                   scale: int = SCALE, clusters: int = CLUSTERS, sample: int = SAMPLE, tile: int = TILE,
                   block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for
    each anchor (SQL condition ``is_anchor`` on ``id`` and ``label``) and each of its
    first ``positives`` rows of the same label, the first ``negatives`` rows of
    another label whose score lies between ``low`` and ``high`` percent of the
    positive's. Scores are exact integer inner products; ties go to the smaller id.

    Both searches are exact (``shared_lists``): anchors are a stated query set
    against all rows, in blocks; no list of a whole cluster, and no pair below a
    request's floor, is ever shuffled. Only centres are learnt from a sample.

    Rows with a null id, label or vector, an empty vector, or a null or non-finite
    component take no part; vectors of different length have no score. Rows are
    told apart by position: a repeated row is another row, also for its copies,
    and a repeated anchor gives its rows again. A positive with a negative score
    has no negatives. Scores beyond 64 bits count as the nearest 64-bit number. An
    empty table, or one without anchors, gives no rows; other columns are not read."""
    rows = _usable(df, id_col, vector_col, label_col)
    vectors = quantised_vectors(rows, anchor_centres(rows.filter(is_anchor), clusters, sample), scale)
    tiles = tiles_of(vectors, tile)
    anchors = vectors.filter(is_anchor)
    wanted = anchors.select("d", "cluster", "row", "label", "q", F.col("row").alias("rid"),
                            F.lit(LEAST).cast("long").alias("lo"), F.lit(MOST).cast("long").alias("hi"))
    pos = top_scores(wanted, tiles, positives, True, block).select(
        F.col("rid").alias("row"), (F.col("rid") * positives + F.col("rank") - 1).alias("rid"),
        F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    pos = materialize(pos.join(anchors, "row").withColumnRenamed("id", "anchor_id"), "positives")
    whole, part = F.expr("positive_score div 100"), F.col("positive_score") % 100
    asked = pos.filter("positive_score >= 0").select(
        "d", "cluster", "row", "label", "q", "rid", (whole * low + F.ceil(part * low / 100)).cast("long").alias("lo"),
        (whole * high + F.floor(part * high / 100)).cast("long").alias("hi"))
    found = top_scores(asked, tiles, negatives, False, block)
    return (found.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).drop("row")
            .join(pos.select("rid", "anchor_id", "positive_id", "positive_score"), "rid")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", "embedding", label.alias("label")), "id % 100 = 0")


SQL = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND {LOW_PERCENT} * positive_score <= 100 * score AND 100 * score <= {HIGH_PERCENT} * positive_score
QUALIFY rank <= {NEGATIVES}"""
