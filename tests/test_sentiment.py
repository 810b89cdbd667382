"""The sentiment job against values worked out by hand from the published rules."""
import math
import random

import pytest

from glare.functions import sentiment as SN
from glare.functions.text import with_style_features

LEX = [("good", 1.9), ("bad", -2.5), ("great", 3.1), ("awful", -2.0), ("very", 0.5)]


def norm(s):
    return s / math.sqrt(s * s + 15)


# text, sum of valences with punctuation, positive share, negative share
GOLDEN = [
    ("This is good", 1.9, 2.9 / 4.9, 0.0),
    # 1.9 * -0.74 = -1.406, two marks 0.584 on the negative side; shouted NOT, but no other emphasis on good
    ("not good at all!!", -1.406 - 0.584, 0.0, (2.406 + 0.584) / (2.406 + 0.584 + 3)),
    # very is in the lexicon, so it does not boost; before "but" half, after it one and a half
    ("very good but bad", 1.9 * 0.5 - 2.5 * 1.5, 1.95 / (1.95 + 4.75 + 2), 4.75 / (1.95 + 4.75 + 2)),
    # a shouted word among others: 1.9 + 0.733
    ("GOOD news", 2.633, 3.633 / 4.633, 0.0),
    # all shouted: no emphasis
    ("GOOD NEWS", 1.9, 2.9 / 3.9, 0.0),
    # boosters: one word before 0.293, two words before 0.293 * 0.95, three 0.293 * 0.9
    ("really good", 1.9 + 0.293, 3.193 / 4.193, 0.0),
    ("really x good", 1.9 + 0.293 * 0.95, (2.9 + 0.27835) / (4.9 + 0.27835), 0.0),
    ("really x y good", 1.9 + 0.293 * 0.9, (2.9 + 0.2637) / (5.9 + 0.2637), 0.0),
    ("slightly bad", -2.5 + 0.293, 0.0, 3.207 / 4.207),
    # two-word boosters
    ("a kind of good day", 1.9 - 0.293, 2.607 / 6.607, 0.0),
    # one question mark counts nothing, two 0.36, four 0.96
    ("good?", 1.9, 1.0, 0.0),
    ("good??", 2.26, 1.0, 0.0),
    ("good????", 2.86, 1.0, 0.0),
    # at most four exclamation marks: 1.168
    ("great!!!!!!", 3.1 + 1.168, 1.0, 0.0),
    # negation within three words, also n't
    ("I don't think great", 3.1 * -0.74, 0.0, (1 + 2.294) / (4 + 2.294)),
    ("never a b c good", 1.9, 2.9 / 6.9, 0.0),
    # equal masses: the marks change neither side, the sum is zero
    ("plain words only", 0.0, 0.0, 0.0),
    ("", 0.0, 0.0, 0.0),
]


@pytest.fixture
def lexicon(spark):
    return spark.createDataFrame(LEX, "token string, valence double")


def test_rules(spark, lexicon):
    df = spark.createDataFrame([(i, g[0]) for i, g in enumerate(GOLDEN)], "id long, t string")
    got = {r.id: r for r in SN.with_sentiment(df, "t", lexicon).collect()}
    assert len(got) == len(GOLDEN)
    for i, (t, total, pos, neg) in enumerate(GOLDEN):
        assert got[i].vader_compound == pytest.approx(norm(total), abs=1e-12), t
        assert (got[i].vader_pos, got[i].vader_neg) == pytest.approx((pos, neg), abs=1e-12), t
        assert got[i].emotional_intensity == pytest.approx(abs(norm(total)), abs=1e-12)


def test_rows_keep_their_own_scores(spark, lexicon):
    """Repeated ids are not merged, copies count once, a null text is null."""
    df = spark.createDataFrame([(1, "good"), (1, "nothing at all"), (2, "good"), (2, "good"), (3, None)], "id long, t string")
    out = [(r.id, r.t, r.vader_pos) for r in SN.with_sentiment(df, "t", lexicon).collect()]
    assert sorted(out, key=str) == sorted([(1, "good", 1.0), (1, "nothing at all", 0.0), (2, "good", 1.0), (2, "good", 1.0),
                                           (3, None, None)], key=str)
    f = {r.t: r for r in with_style_features(df, "t", valences=lexicon).collect()}
    assert f[None].vader_neg is None and f["good"].emotional_intensity > 0


def test_unbounded_exceptions_raise(spark):
    many = spark.createDataFrame([(f"w{i}n't", 1.0) for i in range(SN.MOST_NT_WORDS + 60)], "token string, valence double")
    with pytest.raises(ValueError):
        SN.with_sentiment(spark.createDataFrame([("a",)], "t string"), "t", many)


def test_inline_form_equals_the_job(spark, lexicon):
    words = [w for w, _ in LEX] + ["not", "really", "GOOD", "kind", "of", "but", "BAD!", "x", "don't", "hardly", "VERY", "news??"]
    rng = random.Random(6)
    texts = [g[0] for g in GOLDEN] + [" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(400)] + [None, "  ", "good good"]
    df = spark.createDataFrame([(i % 50, t, 1.0) for i, t in enumerate(texts)], "id long, t string, v double")
    job, inline = SN.with_sentiment(df, "t", lexicon), SN.with_inline_sentiment(df, "t", SN.InlineLexicon(lexicon))
    assert inline.columns == job.columns
    key = lambda r: (r.id, str(r.t))
    for a, b in zip(sorted(job.collect(), key=key), sorted(inline.collect(), key=key), strict=True):
        assert (a.id, a.t) == (b.id, b.t) and list(b)[2:] == (pytest.approx(list(a)[2:], abs=1e-12) if a.t is not None else list(a)[2:]), a.t
    plan = inline._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Aggregate" not in plan


def test_inline_lexicon_is_bounded(spark):
    many = spark.range(SN.MOST_INLINE_WORDS + 5).selectExpr("concat('w', id) as token", "1.0D as valence")
    with pytest.raises(ValueError):
        SN.InlineLexicon(many)
    none = SN.InlineLexicon(many.where("false"))
    r = SN.with_inline_sentiment(spark.createDataFrame([("w1 w2",)], "t string"), "t", none).first()
    assert r.vader_pos == 0.0 and r.vader_compound == 0.0


def test_rules_are_for_lexicon_words_only(spark):
    """The neighbour rules (regular expressions of the words around) are computed after
    the lexicon join; a text's other words are dropped where they lie."""
    from glare.functions import sentiment as SN
    lex = spark.createDataFrame([("good", 1.9), ("bad", -2.5)], "token string, valence double")
    out = SN.with_sentiment(spark.createDataFrame([("VERY good, not bad!",)], "t string"), "t", lex)
    generate = next(x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "transform(" in x and "struct(" in x)
    assert "RLIKE" not in generate.upper()
    words = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "good" in x]
    assert any("lambda" in x for x in words)
