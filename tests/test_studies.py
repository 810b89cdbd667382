"""The study queries work on all their rows."""
import inspect

from pyspark.sql import functions as F

from conftest import SF_SMALL
from glare.plans import studies as S
from glare.sources import standins


def test_every_test_enters_the_causal_fit(spark, monkeypatch):
    n = 8001

    def arms(spark, base):
        r = spark.range(2 * n).withColumn("test_id", F.floor(F.col("id") / 2))
        return r.select("test_id", F.col("id").alias("arm_id"), F.concat(F.lit("hot old Gear "), F.col("id")).alias("headline"),
                        F.lit(10).cast("long").alias("impressions"), (F.col("id") % 5).alias("clicks"))

    monkeypatch.setattr(standins, "arms", arms)
    assert inspect.signature(S.ab_effects).parameters["max_tests"].default is None
    design = S.causal_design(spark, "unused")
    assert design.select("test_id").distinct().count() == n and design.count() == 2 * n


def test_causal_features_all_vary(spark):
    arms = S.clean_arms(spark, "/root/testdata/sf0.01")
    f = S.featurize(spark, arms, "headline", standins.ARMS_LEXICONS, standins.ARMS_SENTIMENT)
    sd = f.agg(*[F.stddev_samp(c).alias(c) for c in S.CAUSAL_FEATURES]).first().asDict()
    assert all(v > 0 for v in sd.values()), sd


def test_pairs_are_all_real_holdout_titles(spark):
    ranked, _ = S.attention_holdout(spark, SF_SMALL)
    real = ranked.where("fake = 0").count()
    assert S.pair_gap(spark, SF_SMALL).count() == real
    assert S.pair_table(spark, SF_SMALL, 7).count() == min(7, real)


def test_lines_cover_the_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text").collect()
    want = sum(bool(x.strip()) for r in docs for x in (r.text or "").split("\n"))
    assert S.lexicon_sentiment(spark, SF_SMALL).count() == want == S.tone_down(spark, SF_SMALL).count()
