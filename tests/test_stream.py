"""The stream scores the same rows as the batch plan."""
import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from glare.plans import studies as S
from glare.streaming.scoring import start_scoring


def test_stream_equals_batch(spark):
    art = S.scoring_artifacts(spark, SF_SMALL)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").where("doc_id < 40")
    docs = docs.unionByName(docs.where("doc_id < 3"))  # repeated ids
    root = tempfile.mkdtemp(prefix="glare-stream-")
    src = os.path.join(root, "in")
    docs.repartition(3).write.parquet(src)
    q = start_scoring(spark, src, os.path.join(root, "out"), os.path.join(root, "ckpt"), art, max_files_per_trigger=2,
                      trigger_once=True)
    q.awaitTermination(300)
    def rows(df):
        return sorted((r.doc_id, r.version, r.text, round(r.score, 9), round(r.p_mean, 9) if "p_mean" in r else 0,
                       round(r.score_vs_original, 9), round(r.vader_neg, 9)) for r in df.collect())
    got, exp = rows(spark.read.parquet(os.path.join(root, "out"))), rows(S.score_versions(spark, docs, *art))
    assert got == exp and len(exp) == 3 * docs.count()
    assert len([p for p in os.listdir(os.path.join(root, "out")) if p.startswith("batch_id=")]) == 2
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()
