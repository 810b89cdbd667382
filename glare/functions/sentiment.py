"""Lexicon sentiment (N1) as a Spark job: pos / neg shares and |compound|.

The study scores every headline with a rule-based valence model (Hutto and
Gilbert, 2014) through a per-row Python library. Here the same kind of rules
run as DataFrame operations, with the valence lexicon as an input table
``(token, valence)`` that the user supplies (the ~7,500-word published
lexicon is not bundled, so results are not claimed to equal that package's):

1. per text: whitespace tokens (surrounding punctuation stripped unless that
   leaves two characters or fewer), shouting flag, first "but", ``!``/``?``;
2. ``explode`` the tokens, each with the three words before it; lexicon join
   on the lower-cased token (broadcast when the lexicon's bytes are under a
   checked bound, a shuffle join otherwise). Tokens outside a lexicon of
   bounded size are dropped before the explode;
3. neighbour rules on the hits that the join leaves: boosters
   within three words (damped 1, .95, .9), negations (x -0.74) when the
   neighbour is not a lexicon word, two-word boosters ("kind of") among the
   three words before, shouting emphasis, the "but" rule (x .5 before, x 1.5
   after);
4. hash aggregates over the lexicon hits only: sum, positive / negative mass,
   non-zero count (neutral = tokens - non-zero), then punctuation emphasis and
   normalization s / sqrt(s^2 + 15).

A score belongs to the text, not to a row's key: hits are gathered by the
text's digest, where copies of a text meet, rows that share a key keep
their own scores, and texts without a hit score 0 (null texts null).

``with_inline_sentiment`` applies the same rules to each row by itself, with a
lexicon of bounded size inside the plan.

Rules of the published set that are left out: the fixed idioms ("bad ass" and
the like), "least", "never so", "without doubt", emoji and negated boosters; a
two-word booster counts whatever word stands before it.
"""
from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rank_index import bisect_left
from .rewrite import is_upper, split_words
from .text import PY_SPACE

# Constants of the published rule set (Hutto and Gilbert, 2014).
BOOST = 0.293
CAPS_BOOST = 0.733
NEGATION_SCALAR = -0.74
NORMALIZE_ALPHA = 15.0
EXCLAMATION_STEP = 0.292
EXCLAMATION_MAX = 4
QUESTION_STEP = 0.18
QUESTION_MANY = 0.96
BUT_BEFORE = 0.5
BUT_AFTER = 1.5
DAMPING = (1.0, 0.95, 0.9)

# Small default word lists; callers pass their own with their lexicon.
BOOSTERS_UP = ("absolutely", "completely", "extremely", "highly", "incredibly", "really",
               "so", "totally", "very", "most", "more", "especially", "hugely", "utterly")
BOOSTERS_DOWN = ("barely", "hardly", "kind of", "less", "little", "marginally", "slightly",
                 "somewhat", "sort of", "scarcely")
NEGATIONS = ("not", "no", "never", "nor", "none", "nothing", "nobody", "neither", "nowhere",
             "cannot", "without", "rarely", "seldom", "despite")

#: largest lexicon that is broadcast, and most lexicon words with "n't" in them
LEXICON_BROADCAST_BYTES = 64 << 20
MOST_NT_WORDS = 1000
#: largest lexicon that travels inside a plan
MOST_INLINE_WORDS = 10_000
SENTIMENT = ("vader_pos", "vader_neg", "vader_compound", "emotional_intensity")

PUNCT = "".join("\\" + c for c in string.punctuation)
#: a run of non-whitespace that ``is_upper`` holds for
UPPER_RUN = r"(?<!{0})[^{1}\p{{Lu}}\p{{Ll}}\p{{Lt}}]*+\p{{Lu}}[^{1}\p{{Ll}}\p{{Lt}}]*+(?!{0})".format(
    PY_SPACE.replace("[", "[^", 1), PY_SPACE[1:-1])


def _with_tokens(df: DataFrame, text: str, out: str) -> DataFrame:
    """Whitespace tokens, punctuation stripped at both ends unless that leaves
    two characters or fewer (keeps emoticons)."""
    def clean(w, bare):
        return F.when(F.length(bare) <= 2, w).otherwise(bare)

    df = df.withColumn(out, split_words(text))
    return df.withColumn(out, F.zip_with(out, F.transform(out, lambda w: F.btrim(w, F.lit(string.punctuation))), clean))


class _Rules:
    """The neighbour rules of one set of word lists; ``special`` are the words of the
    lists, or with n't, that are lexicon words themselves and so carry no rule."""

    def __init__(self, boosters_up, boosters_down, negations, special):
        bup, bdown = list(boosters_up), list(boosters_down)
        self.one_up, self.one_down = [b for b in bup if " " not in b], [b for b in bdown if " " not in b]
        self.pairs = {b: BOOST for b in bup if " " in b} | {b: -BOOST for b in bdown if " " in b}
        self.negations, self.special = list(negations), list(special)

    def neighbour(self, word: Column, k: int) -> dict[str, Column]:
        """Flags of the word k places before a lexicon word (null before the first)."""
        lo = F.lower(word)
        plain = ~lo.isin(self.special) if self.special else F.lit(True)
        boost = F.when(lo.isin(self.one_up), F.lit(BOOST)).when(lo.isin(self.one_down), F.lit(-BOOST))
        return {f"b{k}": F.when(plain, boost), f"u{k}": is_upper(word),
                f"n{k}": (lo.isin(self.negations) | lo.contains("n't")) & plain}

    def flags(self, w1: Column, w2: Column, w3: Column) -> dict[str, Column]:
        """Flags of the three words before a lexicon word, the nearest first."""
        out = {}
        for k, w in enumerate((w1, w2, w3), 1):
            out |= self.neighbour(w, k)
        idiom = F.lit(0.0)
        for far, near in ((w2, w1), (w3, w2)):
            two = F.lower(F.concat(far, F.lit(" "), near))
            for b, v in self.pairs.items():
                idiom = idiom + F.when(two == b, F.lit(v)).otherwise(F.lit(0.0))
        return out | {"idiom": idiom}


def _before(i: Column, k: int) -> Column:
    """The word k places before position i (0-based) of __w, null if there is none."""
    return F.when(i >= k, F.get("__w", i - k))


def _sign(v: Column) -> Column:
    return F.when(v < 0, F.lit(-1.0)).otherwise(F.lit(1.0))


def _shouted(v: Column, up: Column, capdiff: Column) -> Column:
    """A lexicon word's valence, stressed if it is shouted among words that are not."""
    return v + F.when(up & capdiff, _sign(v) * CAPS_BOOST).otherwise(0.0)


def _with_neighbour(val: Column, b: Column, u: Column, n: Column, capdiff: Column, damp: float) -> Column:
    """The valence after one neighbour's booster and negation."""
    stress = F.when(u & capdiff, F.when(b > 0, F.lit(CAPS_BOOST)).otherwise(F.lit(-CAPS_BOOST))).otherwise(0.0)
    boosted = val + F.when(b.isNull(), F.lit(0.0)).otherwise((b + stress) * _sign(val) * damp)
    return boosted * F.when(F.coalesce(n, F.lit(False)), F.lit(NEGATION_SCALAR)).otherwise(F.lit(1.0))


def _around_but(val: Column, i: Column, but: Column) -> Column:
    return F.when((but > 0) & (i + 1 < but), val * BUT_BEFORE).when((but > 0) & (i + 1 > but), val * BUT_AFTER).otherwise(val)


def _text_flags(df: DataFrame, text: str) -> DataFrame:
    """``df`` with __w, __lw (words and their lower case), __nt, __capdiff, __but, __ex, __qm."""
    t = _with_tokens(df, text, "__w")
    t = t.withColumn("__lw", F.transform("__w", lambda w: F.lower(w)))
    n_up = F.regexp_count(text, F.lit(UPPER_RUN))
    return t.withColumns({
        "__nt": F.size("__w"), "__capdiff": (n_up > 0) & (n_up < F.size("__w")),
        "__but": F.array_position(F.col("__lw"), "but"),
        "__ex": F.least(F.regexp_count(text, F.lit("!")), F.lit(EXCLAMATION_MAX)), "__qm": F.regexp_count(text, F.lit(r"\?"))})


def _with_scores(agg: DataFrame) -> DataFrame:
    """``agg`` (sum_s, pos_sum, neg_sum, nonzero, nt, ex, qm) with the three scores."""
    agg = agg.withColumn("neu", F.col("nt") - F.col("nonzero"))
    qm = F.col("qm")
    agg = agg.withColumn("punct", F.col("ex") * EXCLAMATION_STEP + F.when(qm > 3, F.lit(QUESTION_MANY))
                         .when(qm > 1, qm * QUESTION_STEP).otherwise(F.lit(0.0)))
    punct, sum_s = F.col("punct"), F.col("sum_s")
    agg = agg.withColumn("total_s", F.when(sum_s > 0, sum_s + punct).when(sum_s < 0, sum_s - punct).otherwise(sum_s))
    ts = F.col("total_s")
    compound = F.least(F.greatest(ts / F.sqrt(ts * ts + NORMALIZE_ALPHA), F.lit(-1.0)), F.lit(1.0))
    ps, ns = F.coalesce(F.col("pos_sum"), F.lit(0.0)), F.coalesce(F.col("neg_sum"), F.lit(0.0))
    agg = agg.withColumns({
        "ps2": F.when(ps > F.abs(ns), ps + punct).otherwise(ps),
        "ns2": F.when(ps < F.abs(ns), ns - punct).otherwise(ns),
        "vader_compound": F.when(sum_s != 0, compound).otherwise(0.0)})
    tot = F.col("ps2") + F.abs(F.col("ns2")) + F.col("neu")
    return agg.withColumns({"vader_pos": F.when(tot > 0, F.abs(F.col("ps2") / tot)).otherwise(0.0),
                            "vader_neg": F.when(tot > 0, F.abs(F.col("ns2") / tot)).otherwise(0.0)})


def _merged(lexicon: DataFrame, token: str, valence: str) -> DataFrame:
    return lexicon.select(F.lower(F.col(token)).alias("__lt"), F.col(valence).cast("double").alias("__v")) \
        .groupBy("__lt").agg(F.avg("__v").alias("__v"))


def _listed(word: Column, words: list[str]) -> Column:
    return word.isin(words) if words else F.lit(False)


def sentiment_by_text(df: DataFrame, text: str, lexicon: DataFrame, token: str = "token",
                      valence: str = "valence", boosters_up=BOOSTERS_UP, boosters_down=BOOSTERS_DOWN,
                      negations=NEGATIONS) -> DataFrame:
    """``__key`` (md5 of the text) and the four scores, one row for every
    distinct text of ``df`` with a lexicon word.

    Neighbour rules need to know whether a booster or negation word is itself
    a lexicon word; that set is bounded (the lists, and MOST_NT_WORDS), so it is
    collected. A token takes the three words before it along; their flags are
    computed after the join, for lexicon words only.
    """
    lex = _merged(lexicon, token, valence)
    listed = [*boosters_up, *boosters_down, *negations]
    special = [r["__lt"] for r in lex.where(F.col("__lt").isin(listed) | F.col("__lt").contains("n't"))
               .select("__lt").limit(len(listed) + MOST_NT_WORDS + 1).collect()]
    if len(special) > len(listed) + MOST_NT_WORDS:
        raise ValueError(f"the lexicon has more than {MOST_NT_WORDS} words with n't")
    rules = _Rules(boosters_up, boosters_down, negations, special)
    size = lex.agg(F.sum(F.length("__lt") * 4 + 48)).first()[0] or 0
    if size <= LEXICON_BROADCAST_BYTES:
        lex = F.broadcast(lex)
    # a short lexicon is in the plan too, so that only its words leave their text
    words = [r["__lt"] for r in lex.select("__lt").where(F.col("__lt").isNotNull()).limit(MOST_INLINE_WORDS + 1).collect()]
    words = words if len(words) <= MOST_INLINE_WORDS else None

    t = df.select(F.md5(F.col(text).cast("binary")).alias("__id"), F.col(text).alias("__x")).where(F.col("__x").isNotNull())
    t = _text_flags(t, "__x").drop("__x")
    at = F.transform("__lw", lambda x, i: F.when(_listed(x, words), i) if words is not None else i)
    at = F.array_compact(at)
    entry = F.transform(at, lambda i: F.struct(i.alias("i"), F.get("__w", i).alias("tok"), F.get("__lw", i).alias("__lt"),
                                               *[_before(i, k).alias(f"w{k}") for k in (1, 2, 3)]))
    # an empty array gives a row without a token, which the join drops: no array is made twice to test its size
    rows = t.select("__id", "__nt", "__capdiff", "__but", "__ex", "__qm", F.explode_outer(entry).alias("__e")).select("*", "__e.*").drop("__e")
    rows = rows.join(lex, "__lt", "inner")       # only lexicon words carry valence
    rows = rows.where(~F.col("__lt").isin(rules.one_up + rules.one_down))   # boosters score 0
    rows = rows.withColumns({"__up": is_upper(F.col("tok"))} | rules.flags(F.col("w1"), F.col("w2"), F.col("w3")))

    # each rule step is its own projection, so the expression stays linear
    rows = rows.withColumn("__val", _shouted(F.col("__v"), F.col("__up"), F.col("__capdiff")))
    for k, damp in zip((1, 2, 3), DAMPING):
        rows = rows.withColumn("__val", _with_neighbour(F.col("__val"), F.col(f"b{k}"), F.col(f"u{k}"), F.col(f"n{k}"),
                                                        F.col("__capdiff"), damp))
    rows = rows.withColumn("__val", F.col("__val") + F.col("idiom"))
    rows = rows.withColumn("__s", _around_but(F.col("__val"), F.col("i"), F.col("__but")))
    # copies of a text meet here, after the join: a task merges its own first
    hits = rows.groupBy("__id", "i").agg(*[F.first(c).alias(c) for c in ("__s", "__nt", "__ex", "__qm")])
    agg = hits.groupBy("__id").agg(
        F.sum("__s").alias("sum_s"),
        F.sum(F.when(F.col("__s") > 0, F.col("__s") + 1)).alias("pos_sum"),
        F.sum(F.when(F.col("__s") < 0, F.col("__s") - 1)).alias("neg_sum"),
        F.sum(F.when(F.col("__s") != 0, 1).otherwise(0)).alias("nonzero"),
        F.first("__nt").alias("nt"), F.first("__ex").alias("ex"), F.first("__qm").alias("qm"))
    out = _with_scores(agg).select(F.col("__id").alias("__key"), "vader_pos", "vader_neg", "vader_compound")
    return out.withColumn("emotional_intensity", F.abs("vader_compound"))


class InlineLexicon:
    """A lexicon small enough to travel inside a plan: sorted words and their
    valences, looked up by binary search. At most MOST_INLINE_WORDS words."""

    def __init__(self, lexicon: DataFrame, token: str = "token", valence: str = "valence"):
        rows = _merged(lexicon, token, valence).where("__lt is not null and __v is not null").orderBy("__lt") \
            .limit(MOST_INLINE_WORDS + 1).collect()
        if len(rows) > MOST_INLINE_WORDS:
            raise ValueError(f"the lexicon has more than {MOST_INLINE_WORDS} words: use with_sentiment")
        self.words, self.valences = [r["__lt"] for r in rows], [r["__v"] for r in rows]

    def of(self, word: Column) -> Column:
        """Valence of a lower-case word, null if it has none."""
        if not self.words:
            return F.lit(None).cast("double")
        words = F.lit(self.words)
        return F.aggregate(F.array(bisect_left(words, word, len(self.words))), F.lit(None).cast("double"),
                           lambda _, i: F.when(F.get(words, i) == word, F.get(F.lit(self.valences), i)))


def with_inline_sentiment(df: DataFrame, text: str, lexicon: InlineLexicon, boosters_up=BOOSTERS_UP,
                          boosters_down=BOOSTERS_DOWN, negations=NEGATIONS) -> DataFrame:
    """The same scores as ``with_sentiment``, by columns of the row alone: nothing is
    exploded, joined or grouped, so it works on a stream in append mode. For short
    texts and a lexicon that fits a plan."""
    listed = {*boosters_up, *boosters_down, *negations}
    rules = _Rules(boosters_up, boosters_down, negations, [w for w in lexicon.words if w in listed or "n't" in w])
    boosters = rules.one_up + rules.one_down
    t = _text_flags(df.withColumn("__x", F.col(text)), "__x")
    capdiff, but = F.col("__capdiff"), F.col("__but")
    t = t.withColumn("__v", F.transform("__lw", lambda w: F.when(~w.isin(boosters), lexicon.of(w))))
    t = t.withColumn("__at", F.array_compact(F.transform("__v", lambda v, i: F.when(v.isNotNull(), i))))

    def entry(i):
        return F.struct(F.get("__w", i).alias("tok"), i.alias("i"), F.get("__v", i).alias("v"),
                        *[c.alias(n) for n, c in rules.flags(*(_before(i, k) for k in (1, 2, 3))).items()])

    t = t.withColumn("__e", F.transform("__at", entry))

    def stage(e, val):
        return F.struct(*[e[c].alias(c) for c in ("i", "idiom", *(f"{f}{k}" for k in (1, 2, 3) for f in "bun"))], val.alias("v"))

    t = t.withColumn("__e", F.transform("__e", lambda e: stage(e, _shouted(e["v"], is_upper(e["tok"]), capdiff))))

    def with_neighbour(k, damp):
        return lambda e: stage(e, _with_neighbour(e["v"], e[f"b{k}"], e[f"u{k}"], e[f"n{k}"], capdiff, damp))

    for k, damp in zip((1, 2, 3), DAMPING):
        t = t.withColumn("__e", F.transform("__e", with_neighbour(k, damp)))
    t = t.withColumn("__s", F.transform("__e", lambda e: _around_but(e["v"] + e["idiom"], e["i"], but)))

    def total(values):
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

    agg = t.withColumns({
        "sum_s": total(F.col("__s")),
        "pos_sum": total(F.transform("__s", lambda x: F.when(x > 0, x + 1).otherwise(0.0))),
        "neg_sum": total(F.transform("__s", lambda x: F.when(x < 0, x - 1).otherwise(0.0))),
        "nonzero": F.size(F.filter("__s", lambda x: x != 0)), "nt": F.col("__nt"), "ex": F.col("__ex"), "qm": F.col("__qm")})
    agg = agg.withColumn("has", F.col("__x").isNotNull())
    out = _with_scores(agg).withColumn("emotional_intensity", F.abs("vader_compound"))
    hit = F.size("__s") > 0
    return out.select(*df.columns, *[F.when(F.col("has"), F.when(hit, F.col(c)).otherwise(0.0)).alias(c) for c in SENTIMENT])


def with_sentiment(df: DataFrame, text: str, lexicon: DataFrame, **rules) -> DataFrame:
    """``df`` with the four scores of each row's own text: 0 without a lexicon
    word, null for a null text. Rows are neither merged nor multiplied."""
    scores = sentiment_by_text(df, text, lexicon, **rules)
    j = df.withColumn("__key", F.md5(F.col(text).cast("binary"))).join(scores, "__key", "left").drop("__key")
    return j.select(*df.columns, *[F.when(F.col(text).isNotNull(), F.coalesce(c, F.lit(0.0))).alias(c) for c in SENTIMENT])
