"""Hand-computed golden rows for the feature, corpus and headline rules."""
import pytest
from pyspark.sql import functions as F

from glare.functions import text as TX
from glare.functions.text import with_style_features


def one(spark, value, col):
    return spark.createDataFrame([(value,)], "t string").select(col.alias("x")).first()["x"]


def feats(spark, title):
    df = spark.createDataFrame([(1, title)], "id int, title string")
    return with_style_features(df, "title").first().asDict()


def test_tokens(spark):
    assert one(spark, "Étion you’re DON'T '' x", TX.tokens("t")) == ["tion", "you", "re", "DON'T", "''", "x"]


def test_headline_golden(spark):
    f = feats(spark, "SHOCKING: you won't believe THIS secret!!")
    assert f["sensational_ratio"] == pytest.approx(2 / 6)
    assert f["urgency_ratio"] == 0
    assert f["caps_ratio"] == pytest.approx(12 / 32)
    assert f["all_caps_words"] == pytest.approx(2 / 6)
    assert (f["exclamations"], f["questions"], f["clickbait_opener"], f["has_number"]) == (2, 0, 0, 0)
    assert f["second_person"] == pytest.approx(1 / 6)
    assert f["title_len_words"] == 6


@pytest.mark.parametrize("title,expected", [
    ("You won't believe this", 1), ("You wont believe", 1), ("here's why", 1), ("Here is why", 1),
    ("  watch now", 1), ("thisé x", 0), ("Watching paint", 0), ("The real reason it fell", 1), ("Why?", 1),
])
def test_opener(spark, title, expected):
    assert feats(spark, title)["clickbait_opener"] == expected


def test_all_caps_and_digits(spark):
    assert feats(spark, "NASA and US")["all_caps_words"] == pytest.approx(1 / 3)
    assert feats(spark, "''' x")["all_caps_words"] == 0
    assert feats(spark, "٣ ways")["has_number"] == 1
    assert feats(spark, "3 ways")["has_number"] == 1
    assert feats(spark, "three ways")["has_number"] == 0


def test_empty_and_null(spark):
    f = feats(spark, "")
    assert f["title_len_words"] == 0 and f["sensational_ratio"] == 0 and f["caps_ratio"] == 0
    g = feats(spark, None)
    assert g["title_len_words"] is None and g["caps_ratio"] is None


def test_domain(spark):
    assert one(spark, "HTTP://www.A.com/x", TX.url_host("t")) == "HTTP:"
    assert one(spark, "https://www.a.com?q=1", TX.url_host("t")) == "a.com?q=1"
    assert one(spark, "a.com/x", TX.url_host("t")) == "a.com"
    assert one(spark, None, TX.url_host("t")) == ""


def test_item_count(spark):
    assert one(spark, "a\t\t b \t", TX.item_count("t")) == 2
    assert one(spark, "", TX.item_count("t")) == 0
    assert one(spark, None, TX.item_count("t")) == 0


def test_first_line(spark):
    assert one(spark, "\n\n  Title here  \nsecond", TX.first_line("t")) == "Title here"
    assert one(spark, "   \n  ", TX.first_line("t")) is None
    assert one(spark, None, TX.first_line("t")) is None


def test_features_stay_in_jvm(spark):
    df = spark.createDataFrame([(1, "a b")], "id int, title string")
    plan = with_style_features(df, "title")._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_first_line_and_items_split_no_text(spark):
    for c in (TX.first_line("t"), TX.item_count("t")):
        df = spark.createDataFrame([("  \x85 \r\n　 a b \x1c\n c\t\t d",)], "t string").select(c.alias("x"))
        assert "split(" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert one(spark, "  \x85 \r\n　 a b \x1c\n c", TX.first_line("t")) == "a b"
    assert one(spark, " \t a\t 　\tb c\t", TX.item_count("t")) == 2
