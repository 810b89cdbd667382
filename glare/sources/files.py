"""File sources and sinks: CSV corpora, parquet tables, column checks."""
from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words a pandas CSV reader turns into missing values (pandas default list).
# Fixed values.
CSV_NULL_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

CORPUS_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("news_url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("tweet_ids", T.StringType()),
])

ARMS_SCHEMA = T.StructType([
    T.StructField("clickability_test_id", T.StringType()),
    T.StructField("headline", T.StringType()),
    T.StructField("impressions", T.LongType()),
    T.StructField("clicks", T.LongType()),
])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             null_words: Sequence[str] | None = CSV_NULL_WORDS,
             keep_literal: Iterable[str] = ()) -> DataFrame:
    """Header CSV with quoted fields and embedded newlines.

    Columns go by the header's names: the file is read as strings, a ``schema``
    then checks that its columns are there (S8), selects them and casts them, so
    reordered or extra columns do no harm. A value that does not fit its type
    becomes null. ``escape='"'`` makes doubled quotes work (Spark's default
    escape is a backslash). ``multiLine`` files are not splittable, so convert a
    large corpus to parquet once and scan that. ``null_words`` become null as
    they stand, without trimming, in every column except ``keep_literal``.
    """
    df = spark.read.option("header", True).option("multiLine", True).option("inferSchema", False) \
        .option("quote", '"').option("escape", '"').option("nullValue", "").option("mode", "PERMISSIVE").csv(path)
    if schema is not None:
        df = require_columns(df, schema.names, path)
    keep, words = set(keep_literal), list(null_words or ())

    def value(name: str) -> Column:
        c = F.col(f"`{name}`")
        return F.when(~c.isin(words), c) if words and name not in keep else c

    if schema is None:
        return df.select(*[value(n).alias(n) for n in df.columns])
    return df.select(*[value(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def require_columns(df: DataFrame, need: Iterable[str], what: str = "input") -> DataFrame:
    """Fail early, naming what is missing and what is there."""
    missing = set(need) - set(df.columns)
    if missing:
        raise ValueError(f"{what} is missing expected columns: {sorted(missing)} - "
                         f"columns found: {df.columns[:20]}")
    return df


def read_labelled_corpus(spark: SparkSession, data_dir: str, sources: Sequence[str],
                         labels: Sequence[tuple[str, int]] = (("fake", 1), ("real", 0)),
                         schema: T.StructType = CORPUS_SCHEMA) -> DataFrame:
    """S3: one CSV per source x label (``{source}_{label}.csv``), tagged with
    constants and an explicit load-order ``ord`` (source rank, label rank,
    file row) so keep-first dedup is deterministic on any cluster."""
    frames = []
    for si, source in enumerate(sources):
        for li, (name, value) in enumerate(labels):
            df = read_csv(spark, f"{data_dir}/{source}_{name}.csv", schema)
            df = df.withColumn("__row", F.monotonically_increasing_id())
            frames.append(df.withColumns({
                "source": F.lit(source), "fake": F.lit(value).cast("int"),
                "ord": F.struct(F.lit(si).alias("s"), F.lit(li).alias("l"), F.col("__row").alias("r")),
            }).drop("__row"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Parquet scan; Catalyst pushes filters and prunes columns into it."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition ``df`` by ``key`` only when the scan gives fewer
    partitions than the cluster has cores (a few large files): heavy per-row
    text work then uses every core. On a cluster scan the file splits
    already exceed the core count and nothing is added."""
    par = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < par:
        return df.repartition(par, key)
    return df


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet sink (overwrite), optionally partitioned."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def nulls_to(c: Column | str, value) -> Column:
    """P9."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.lit(value))
