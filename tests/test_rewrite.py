"""Tone-down / tone-up rules against expectations worked out by hand."""
import pytest
from pyspark.sql import functions as F

from glare.functions import rewrite as R


def test_tone_down_golden(spark):
    df = spark.createDataFrame([("POLICE slams, blasts Plan!",)], "t string")
    assert df.select(R.tone_down("t").alias("d")).first()["d"] == "Police criticizes criticizes Plan."


def test_tone_down_idempotent_without_lexicon_words(spark):
    df = spark.createDataFrame([("Mayor opens the new bridge today",)], "t string")
    once = df.select(R.tone_down("t").alias("d"))
    twice = once.select(R.tone_down("d").alias("d2"))
    assert once.first()["d"] == twice.first()["d2"]


# worked out by hand: strip the prefixes in order, sum the code points of the
# rest (h), prefix number h mod 6, one mark if h is even else two; with more than
# three words the longest word after the first is shouted (the earliest of equal
# ones), and the second longest too if h mod 3 is 0 and there are over five words
GOLDEN = [
    # 97+32+98 = 227: prefix 5, odd
    ("a b", "ALERT: a b!!"),
    # no text left: h = 0
    ("", "SHOCKING: !"),
    ("ALERT: ", "SHOCKING: !"),
    # 120+32+121+32+122+32+119+63 = 641: prefix 5, odd; all words equally long
    ("x y z w?", "ALERT: x Y z w!!"),
    # 97+32+2*98+32+3*99+32+4*100+32 = 1118, +5*101 = 1623, +32+6*102 = 2267, +46 = 2313:
    # prefix 3, odd, divisible by 3, six words: the last two are shouted
    ("ALERT: a bb ccc dddd eeeee ffffff.", "EXPOSED: a bb ccc dddd EEEEE FFFFFF!!"),
    # prefixes are stripped once each, in their order: BREAKING once, then none is left to strip
    # "BREAKING: ab" = 66+82+69+65+75+73+78+71+58+32 = 669, +97+98 = 864: prefix 0, even
    ("Breaking: BREAKING: ab", "SHOCKING: BREAKING: ab!"),
    # 233+32+98 = 363: prefix 3, odd
    ("\u00e9 b", "EXPOSED: \u00e9 b!!"),
]


@pytest.mark.parametrize("text,expected", GOLDEN)
def test_tone_up_golden(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert R.with_tone_up(df, "t", "u").first()["u"] == expected


def test_code_point_sum_emoji(spark):
    df = spark.createDataFrame([("a😀",)], "t string")
    assert df.select(R.code_point_sum("t").alias("h")).first()["h"] == 97 + 128512


def test_seeded_tone_up_is_deterministic(spark):
    from glare.operators.prep import seeded_uniform
    df = spark.createDataFrame([(i, f"word{i} alpha beta gamma delta") for i in range(20)], "id long, t string")
    a = R.with_tone_up_seeded(df, "t", "s", seeded_uniform(1, "id", F.lit("w")), seeded_uniform(1, "id", F.lit("p")))
    b = R.with_tone_up_seeded(df.repartition(3), "t", "s", seeded_uniform(1, "id", F.lit("w")),
                              seeded_uniform(1, "id", F.lit("p")))
    ra = {r.id: r.s for r in a.collect()}
    assert ra == {r.id: r.s for r in b.collect()}
    for r in a.collect():
        words = r.s.split(": ", 1)[1].rstrip("!").split()
        shouted = [i for i, w in enumerate(words) if w.isupper()]
        assert len(shouted) == 1 and 0 < shouted[0] < len(words) - 1


def test_external_rewrites_join(spark):
    df = spark.createDataFrame([(1, "A b c"), (2, "D e f")], "id long, t string")
    ext = spark.createDataFrame([(1, "rewritten")], "id long, rewrite string")
    out = R.with_external_rewrites(df, ext, "id", "down", fallback=R.tone_down("t"))
    got = {r.id: r.down for r in out.collect()}
    assert got == {1: "rewritten", 2: "D e f"}
