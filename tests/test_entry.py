"""Driver contract: entry runs, every oracle has a query, queries run at sf0.001."""
import importlib

import pytest

from conftest import SF_SMALL


def test_entry_and_registry(spark):
    E = importlib.import_module("__spark_entry__")
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ["title_features", "qualifying_tests", "percentile_rank_avg", "tone_down",
                                  "lexicon_sentiment", "stratified_split"])
def test_queries_run_small(spark, name):
    E = importlib.import_module("__spark_entry__")
    assert E.queries()[name](spark, SF_SMALL).count() >= 0


def test_split_disjoint_and_complete(spark):
    from glare.plans import studies as S
    s = S.stratified_split(spark, SF_SMALL).toPandas()
    c = S.corpus(spark, SF_SMALL).count()
    assert len(s) == c and s.doc_id.is_unique and set(s.split) <= {"A", "B"}
