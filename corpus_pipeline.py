"""Training-data pipeline: five operators of ``glare.llm`` over ``documents``.

Each stage takes (spark, docs, sf_dir); ``run`` writes what it returns to the
shared checkpoint folder and hands the reread table to the next one. Stages with
Python workers bound what these are sent at once, as all of them share the executors.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glare.llm import minhash, packing, pii, quality, toxicity
from glare.llm.bpe_codec import tokenizer_path
from glare.llm.common import materialize, table
from glare.session import bound_arrow_batches


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars again follows the text, where the table has it."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without lines that too many documents of their host share."""
    return _counted(quality.cleaned(docs))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; the labels of the held-out fold are not used."""
    bound_arrow_batches(spark)
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    bound_arrow_batches(spark)
    return minhash.keep_one_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by the name of its kind."""
    bound_arrow_batches(spark)
    return _counted(pii.redact(docs, pii.fit(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    bound_arrow_batches(spark)
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("near_dedup", near_dedup),
    ("pii", personal_data),
    ("packing", pack),
]

#: training, near duplicates by signature and packing have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
