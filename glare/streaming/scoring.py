"""Score headlines as they arrive, three versions each, with bands.

A file-source stream of ``(doc_id, text)`` rows. Each micro-batch goes through the
very plan of the three-version scoring query (``studies.score_versions``) inside
``foreachBatch``: the fitted model, the lexicon and the band are literals, and the
reference is a persisted rank index, looked up by stream-static equi-joins, so no
micro-batch sorts, groups or rereads the reference. Output goes to
``{out}/batch_id=N`` with overwrite: a micro-batch replayed after a failure
rewrites its own folder. Progress lives in the checkpoint location.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..plans import studies

TEXT_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def start_scoring(spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str,
                  artifacts, fmt: str = "parquet", max_files_per_trigger: int = 100,
                  trigger_once: bool = False) -> StreamingQuery:
    """Start the stream; ``artifacts`` = (model, index, band) from
    :func:`glare.plans.studies.scoring_artifacts`."""
    src = spark.readStream.format(fmt).schema(TEXT_SCHEMA) \
        .option("maxFilesPerTrigger", max_files_per_trigger).load(source_dir)

    def each(batch: DataFrame, batch_id: int) -> None:
        scored = studies.score_versions(batch.sparkSession, batch, *artifacts)
        scored.write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

    w = src.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="10 seconds")
    return w.start()
