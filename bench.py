"""Headline benchmark: the study's entry points Q1-Q6 plus the rank operators.

Runs each query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` and prints one JSON line. Results are consumed by a
no-op sink, so the timing covers the full plan without driver collection.
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from glare.plans import studies as S  # noqa: E402

HEADLINE = {
    "q1_corpus_features": S.corpus_features,
    "q2_attention_score": S.attention_score,
    "q2_pooled_linear": S.pooled_linear,
    "q2_pooled_logit": S.pooled_logit,
    "q3_style_logit": S.style_logit,
    "q3_hier_engagement": S.hier_engagement,
    "q4_ab_effects": S.ab_effects,
    "q5_pair_summary": S.pair_summary,
    "q6_variant_scores": S.variant_scores,
    "w2_percentile_rank_avg": S.percentile_rank_avg,
    "w3_percentile_vs_reference": S.percentile_vs_reference,
    "w6_posterior_hdi": S.posterior_hdi,
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("glare-bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "16g")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    # JIT warm-up (untimed): one small run of the text-feature path, on the
    # smallest table set, so the first timed query does not carry class
    # loading and codegen start-up
    warm = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm):
        S.corpus_features(spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name, fn in HEADLINE.items():
        t0 = time.perf_counter()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
