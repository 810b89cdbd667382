"""Headline style features and corpus text columns as Catalyst expressions.

Everything here is a native column expression (regex, higher-order array
functions), so it runs inside whole-stage codegen with no Python worker.
Semantics follow Python's ``re``/``str`` rules: ``\\p{..}`` classes are used
where Python is Unicode-aware (letters, digits, whitespace).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexicons import DEFAULT_LEXICONS, OPENER_ALTERNATIVES, Lexicons

# Python's str.isspace() set, written so both Java regex and RE2 read it.
PY_SPACE = r"[\t\n\x0b\x0c\r\x1c-\x1f\x85\p{Z}]"
#: the same set as characters: controls, NEL and the Unicode separators
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                           0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
WORD_PATTERN = "[A-Za-z']+"
ALL_CAPS_TOKEN = "^[A-Z']*[A-Z][A-Z']*$"
OPENER_PATTERN = rf"(?iU)^{PY_SPACE}*({OPENER_ALTERNATIVES})\b"
LINE_BREAKS = r"\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}"
LINE_BREAK = rf"\r\n|[{LINE_BREAKS}]"
NON_SPACE = PY_SPACE.replace("[", "[^", 1)

STYLE_FEATURES = (
    "sensational_ratio", "urgency_ratio", "caps_ratio", "all_caps_words",
    "exclamations", "questions", "clickbait_opener", "second_person",
    "has_number", "vader_pos", "vader_neg", "emotional_intensity",
)
LEXICAL_FEATURES = tuple(f for f in STYLE_FEATURES
                         if f not in ("vader_pos", "vader_neg", "emotional_intensity"))
SENTIMENT_FEATURES = ("vader_pos", "vader_neg", "emotional_intensity")
ALL_FEATURES = STYLE_FEATURES + ("title_len_words",)
INT_FEATURES = ("exclamations", "questions", "clickbait_opener", "has_number", "title_len_words")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Python ``str.strip()``: trim Unicode whitespace at both ends."""
    return F.btrim(_c(c), F.lit(SPACES))


def tokens(c) -> Column:
    """runs of ASCII letters and straight apostrophes."""
    return F.regexp_extract_all(_c(c), F.lit(WORD_PATTERN), 0)


def lower_tokens(tok) -> Column:
    return F.transform(_c(tok), lambda x: F.lower(x))


def _count_in(ltok: Column, words) -> Column:
    words = list(words)
    if not words:
        return F.lit(0)
    return F.size(F.filter(ltok, lambda x: x.isin(words)))


def regex_count(c, pattern: str) -> Column:
    return F.regexp_count(_c(c), F.lit(pattern))


def first_line(c) -> Column:
    """First non-blank line, stripped; blank or null text -> null. Line breaks
    are white space, so it begins with the text's first visible character; what
    follows it is not read."""
    return strip(F.regexp_substr(_c(c), F.lit(f"{NON_SPACE}[^{LINE_BREAKS}]*")))


def item_count(c, sep: str = "\t") -> Column:
    """Number of non-blank items of a list separated by a white-space
    character; null -> 0. Each match runs from an item's first visible character
    to its end."""
    return regex_count(F.coalesce(_c(c), F.lit("")), f"{NON_SPACE}[^{sep}]*+")


def url_host(c) -> Column:
    """Strip scheme and ``www.``, cut at the first ``/``; null -> ""."""
    s = F.coalesce(_c(c), F.lit(""))
    s = F.regexp_replace(s, "^https?://", "")
    s = F.regexp_replace(s, r"^www\.", "")
    return F.split(s, "/", 2).getItem(0)


def lexical_feature_columns(text: str, tok: str, ltok: str,
                            lex: Lexicons = DEFAULT_LEXICONS) -> dict[str, Column]:
    """F2-F12 from a text column and its (lower-cased) token arrays."""
    t, tk, lt = F.col(text), F.col(tok), F.col(ltok)
    n = F.greatest(F.size(tk), F.lit(1)).cast("double")
    caps = F.size(F.filter(tk, lambda x: (F.length(x) > 2) & x.rlike(ALL_CAPS_TOKEN)))
    out = {
        "sensational_ratio": _count_in(lt, lex.sensational) / n,
        "urgency_ratio": _count_in(lt, lex.urgency) / n,
        "caps_ratio": regex_count(t, r"\p{Lu}")
        / F.greatest(regex_count(t, r"\p{L}"), F.lit(1)).cast("double"),
        "all_caps_words": caps / n,
        "exclamations": regex_count(t, "!"),
        "questions": regex_count(t, r"\?"),
        "clickbait_opener": t.rlike(OPENER_PATTERN).cast("int"),
        "second_person": _count_in(lt, lex.second_person) / n,
        "has_number": t.rlike(r"\p{Nd}").cast("int"),
        "title_len_words": F.size(tk),
    }
    # null text gives null features (the study would score the string "None")
    return {k: F.when(t.isNotNull(), v) for k, v in out.items()}


def with_style_features(df: DataFrame, text: str = "title",
                        lex: Lexicons = DEFAULT_LEXICONS,
                        valences: DataFrame | None = None,
                        keep: list[str] | None = None) -> DataFrame:
    """append the 13 style features to ``df``.

    Tokens are materialized once in their own projection so the regex is not
    re-run per feature. Sentiment columns come from the lexicon table
    ``valences`` (:mod:`glare.functions.sentiment`); when absent they are 0.0,
    as before a lexicon is supplied. A null text has null features.
    """
    from .sentiment import with_sentiment
    keep = list(df.columns) if keep is None else keep
    staged = df.select(*keep, F.col(text).alias("__t"))
    staged = staged.withColumn("__tok", tokens("__t"))
    staged = staged.withColumn("__ltok", lower_tokens("__tok"))
    feats = lexical_feature_columns("__t", "__tok", "__ltok", lex)
    out = staged.select(*keep, *[v.alias(k) for k, v in feats.items()], "__t")
    if valences is not None:
        out = with_sentiment(out, "__t", valences)
    else:
        out = out.withColumns({c: F.when(F.col("__t").isNotNull(), F.lit(0.0)) for c in SENTIMENT_FEATURES})
    return out.select(*keep, *ALL_FEATURES)
