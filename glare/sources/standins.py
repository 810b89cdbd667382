"""Study-shaped tables derived by Spark from the shared test tables.

The study reads a labelled headline corpus and a file of randomized headline
tests; neither ships with it. These builders derive tables of the same shape
from the driver tables, so every query's work grows with the input:

* ``headlines``: ``documents`` -> first non-blank line as ``title``; the 20
  ``source`` values fold into two groups; ``tweet_ids`` = the text's lines as a
  tab list, so ``n_tweets`` counts non-blank lines; ``news_url`` from
  ``pages`` by id; ``fake`` from ``labels.toxic`` when labels are wanted.
* ``arms``: ``part`` joined with per-part ``lineitem`` counts: three
  consecutive parts form one test; impressions = line items, clicks = returned
  line items.
* ``draws``: ``embeddings`` unnested as posterior draws (param = position).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicons import Lexicons
from ..functions.text import LINE_BREAK, first_line, item_count, strip, url_host
from .files import read_table, spread

SOURCE_GROUPS = ("g0", "g1")

# Test lexicons made of words that occur in the stand-in tables (the study's
# English lists never occur in the invented corpus; they are covered by the
# hand-written golden rows in tests/).
CORPUS_LEXICONS = Lexicons(
    sensational=("the", "le", "der"),
    urgency=("and", "of"),
    second_person=("in", "en"),
    replacements=(("the", "a"),),
)
ARMS_LEXICONS = Lexicons(
    sensational=("hot", "red"),
    urgency=("old", "small"),
    second_person=("blue", "your"),
    replacements=(("hot", "warm"),),
)

# Sentiment test lexicon: frequent corpus tokens with hand-set valences.
CORPUS_SENTIMENT = (
    ("the", 1.8), ("and", 0.9), ("la", 2.0), ("en", 1.2), ("good", 1.9),
    ("le", -1.4), ("der", -2.1), ("of", -0.6), ("die", -1.7), ("bad", -2.5),
)


# The same for the arms' headlines.
ARMS_SENTIMENT = (
    ("small", -0.8), ("hot", 1.4), ("old", -1.5), ("new", 1.6), ("red", 0.7), ("promo", 1.1),
)


def sentiment_lexicon(spark: SparkSession, words=CORPUS_SENTIMENT) -> DataFrame:
    return spark.createDataFrame(list(words), "token string, valence double")


def lines(spark: SparkSession, base: str) -> DataFrame:
    """doc_id, line (0-based), title: every non-blank line of every document,
    stripped; the headline rules apply to each."""
    docs = spread(read_table(spark, base, "documents").select("doc_id", "text"), "doc_id")
    rows = docs.select("doc_id", F.posexplode(F.split("text", LINE_BREAK)).alias("line", "title"))
    return rows.withColumn("title", strip("title")).where(F.col("title") != "")


def headlines(spark: SparkSession, base: str, labelled: bool = False,
              with_url: bool = False) -> DataFrame:
    """doc_id, title, source, tweet_ids, n_tweets [, news_url, domain] [, fake, ord].

    Only ``doc_id``/``text``/``source`` are read from ``documents``; the full
    text never crosses a shuffle (``title`` and ``n_tweets`` are computed in
    the scan stage).
    """
    docs = spread(read_table(spark, base, "documents").select("doc_id", "text", "source"), "doc_id")
    num = F.regexp_extract("source", r"(\d+)$", 1).try_cast("int")
    df = docs.select(
        "doc_id",
        first_line("text").alias("title"),
        F.when(num % 2 == 0, F.lit(SOURCE_GROUPS[0])).otherwise(F.lit(SOURCE_GROUPS[1])).alias("source"),
        F.regexp_replace("text", "\n", "\t").alias("tweet_ids"),
    ).withColumn("n_tweets", item_count("tweet_ids")).drop("tweet_ids")
    if with_url:
        pages = read_table(spark, base, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("news_url"))
        df = df.join(pages, "doc_id", "left") \
            .withColumn("news_url", F.coalesce("news_url", F.lit(""))) \
            .withColumn("domain", url_host("news_url"))
    if labelled:
        labels = read_table(spark, base, "labels").select("doc_id", F.col("toxic").cast("int").alias("fake"))
        df = df.join(labels, "doc_id", "inner")
        # load order of the four files: group, then fake before real, then row
        df = df.withColumn("ord", F.struct(
            F.when(F.col("source") == SOURCE_GROUPS[0], 0).otherwise(1).alias("s"),
            (1 - F.col("fake")).alias("l"),
            F.col("doc_id").alias("r")))
    return df


def arms(spark: SparkSession, base: str) -> DataFrame:
    """test_id, arm_id, headline, impressions, clicks (one row per part).

    The per-part line-item counts are a partial hash aggregate; parts with no
    line items get 0 impressions and fall to the ``impressions > 0`` filter.
    """
    part = read_table(spark, base, "part").select("p_partkey", "p_name", "p_type", "p_size")
    li = read_table(spark, base, "lineitem").select("l_partkey", "l_returnflag") \
        .groupBy("l_partkey").agg(
            F.count(F.lit(1)).alias("impressions"),
            F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).cast("long").alias("clicks"))
    # headlines vary in every style feature: mark, number, opener, shouting
    suffix = F.when(F.col("p_size") % 4 == 0, "!").when(F.col("p_size") % 4 == 1, "?").otherwise("")
    opener = F.when(F.col("p_size") % 7 == 1, "Why ").when(F.col("p_size") % 7 == 2, "Your ").otherwise("")
    name = F.when(F.col("p_size") % 5 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    kind = F.when(F.col("p_size") % 2 == 0, F.initcap("p_type")).otherwise(F.col("p_type"))
    number = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"))).otherwise("")
    df = part.join(li, part.p_partkey == li.l_partkey, "left")
    return df.select(
        F.floor(F.col("p_partkey") / 3).cast("long").alias("test_id"),
        F.col("p_partkey").alias("arm_id"),
        F.concat(opener, kind, F.lit(" "), name, number, suffix).alias("headline"),
        F.coalesce("impressions", F.lit(0)).cast("long").alias("impressions"),
        F.coalesce("clicks", F.lit(0)).cast("long").alias("clicks"),
    )


def draws(spark: SparkSession, base: str, chains: int = 4) -> DataFrame:
    """param, chain, draw, value: each embedding is one draw of a 64-d vector."""
    emb = read_table(spark, base, "embeddings").select("vec_id", "embedding")
    return emb.select(
        F.col("vec_id").alias("draw"),
        (F.col("vec_id") % chains).cast("int").alias("chain"),
        F.posexplode("embedding").alias("param", "value"),
    ).select("param", "chain", "draw", F.col("value").cast("double").alias("value"))


#: strata of the stand-in corpus, as ``numeric.stratum`` names them, in order
STRATA = tuple(f"{g}_{k}" for g in SOURCE_GROUPS for k in ("fake", "real"))


def stratum_draws(spark: SparkSession, base: str, chains: int = 4) -> DataFrame:
    """param, chain, draw, value shaped like the hierarchical model's trace: each
    embedding gives an intercept and a slope for every stratum, a shared slope
    and a positive noise."""
    names = [f"alpha_s[{s}]" for s in STRATA] + [f"b_attention_s[{s}]" for s in STRATA] + ["b_title_len", "sigma"]
    d = draws(spark, base, chains).where(F.col("param") < len(names))
    value = F.when(F.col("param") == len(names) - 1, 0.5 + F.abs("value")).otherwise(F.col("value"))
    return d.select(F.element_at(F.array(*map(F.lit, names)), F.col("param") + 1).alias("param"), "chain", "draw", value.alias("value"))
