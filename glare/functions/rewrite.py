"""Rule-based headline rewriting (T1-T7) as column expressions.

No Python UDF: tokens are split with a regex, rewritten with higher-order
array functions and a map literal, and re-joined, all inside codegen.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexicons import DEFAULT_LEXICONS, RANDOM_TONE_UP_PREFIX_COUNT, TONE_UP_PREFIXES, Lexicons
from .text import PY_SPACE

NON_SPACE_RUN = PY_SPACE.replace("[", "[^", 1) + "+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_upper(w: Column) -> Column:
    """Python ``str.isupper``: some uppercase letter and no lower/title-case one."""
    return w.rlike(r"\p{Lu}") & ~w.rlike(r"[\p{Ll}\p{Lt}]")


def split_words(c) -> Column:
    """``str.split()``: runs of non-whitespace."""
    return F.regexp_extract_all(_c(c), F.lit(NON_SPACE_RUN), 0)


def tone_down(c, lex: Lexicons = DEFAULT_LEXICONS) -> Column:
    """Drop or replace sensational words, de-shout all-caps words, ``!`` -> ``.``."""
    mapping = lex.neutralize_map()
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])

    def rewrite(w):
        key = F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}_]", ""))
        return F.when(F.map_contains_key(m, key), F.element_at(m, key)) \
            .when((F.length(key) > 2) & is_upper(w), F.initcap(w)) \
            .otherwise(w)

    words = F.filter(F.transform(split_words(c), rewrite), lambda x: x != "")
    joined = F.replace(F.array_join(words, " "), F.lit("!"), F.lit("."))
    return F.when(_c(c).isNotNull(), F.regexp_replace(joined, rf"^{PY_SPACE}+|{PY_SPACE}+$", ""))


def with_stripped_prefixes(df: DataFrame, src: str, out: str, prefixes=TONE_UP_PREFIXES) -> DataFrame:
    """One pass over the prefixes in order, case-insensitive. One
    projection per prefix keeps the expression tree linear."""
    df = df.withColumn(out, F.col(src))
    for p in prefixes:
        t = F.col(out)
        df = df.withColumn(out, F.when(F.upper(t).startswith(p.upper()),
                                       F.substring(t, len(p) + 1, 1 << 30)).otherwise(t))
    return df


def code_point_sum(c) -> Column:
    """T4: sum of the code points of the text."""
    chars = F.regexp_extract_all(_c(c), F.lit("(?s)."), 0)
    return F.aggregate(chars, F.lit(0).cast("long"), lambda acc, ch: acc + F.ascii(ch).cast("long"))


def _two_longest(words: Column) -> Column:
    """One pass over indices 1..n-1: the longest and second-longest words
    (earliest on ties), as struct(i1, i2); i = 0 means none."""
    init = F.struct(F.lit(-1).alias("l1"), F.lit(0).alias("i1"), F.lit(-1).alias("l2"), F.lit(0).alias("i2"))

    def step(acc, i):
        ln = F.length(F.element_at(words, i + 1))
        return F.when(ln > acc["l1"], F.struct(ln.alias("l1"), i.alias("i1"), acc["l1"].alias("l2"), acc["i1"].alias("i2"))) \
            .when(ln > acc["l2"], F.struct(acc["l1"].alias("l1"), acc["i1"].alias("i1"), ln.alias("l2"), i.alias("i2"))) \
            .otherwise(acc)

    idx = F.when(F.size(words) > 1, F.sequence(F.lit(1), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(idx, init, step)


def _shout_at(words: Column, n: Column, a: Column, b: Column) -> Column:
    """Words joined by spaces with the words at 0-based indices ``a`` and ``b``
    (``a`` < ``b``; ``b`` may be null) upper-cased; slices, no per-word lambda."""
    one = F.concat(F.slice(words, 1, a), F.array(F.upper(F.element_at(words, a + 1))),
                   F.slice(words, a + 2, F.greatest(n - a - 1, F.lit(0))))
    two = F.concat(F.slice(words, 1, a), F.array(F.upper(F.element_at(words, a + 1))),
                   F.slice(words, a + 2, F.greatest(b - a - 1, F.lit(0))),
                   F.array(F.upper(F.element_at(words, b + 1))),
                   F.slice(words, b + 2, F.greatest(n - b - 1, F.lit(0))))
    return F.array_join(F.when(b.isNull(), one).otherwise(two), " ")


def with_tone_up(df: DataFrame, src: str, out: str, prefixes=TONE_UP_PREFIXES) -> DataFrame:
    """T5: deterministic sensationalizer (prefix by code-point hash, shout the
    longest word or two, one or two ``!``). Staged projections; the temporary
    columns are dropped. Per-word work is linear in the title length."""
    df = with_stripped_prefixes(df, src, "__tu_t", prefixes)
    df = df.withColumn("__tu_h", code_point_sum("__tu_t")) \
        .withColumn("__tu_w", split_words(F.regexp_replace("__tu_t", r"[.!? ]+$", "")))
    words, h = F.col("__tu_w"), F.col("__tu_h")
    df = df.withColumns({"__tu_n": F.size(words), "__tu_top": _two_longest(words)})
    n, top = F.col("__tu_n"), F.col("__tu_top")
    first = top["i1"]
    second = F.when((n > 5) & (h % 3 == 0), top["i2"])
    a = F.least(first, F.coalesce(second, first))
    b = F.when(second.isNotNull(), F.greatest(first, second))
    body = F.when(n > 3, _shout_at(words, n, a, b)).otherwise(F.array_join(words, " "))
    bang = F.when(h % 2 == 0, F.lit("!")).otherwise(F.lit("!!"))
    pre = F.element_at(F.array(*[F.lit(p) for p in prefixes]), (h % len(prefixes)).cast("int") + 1)
    return df.withColumn(out, F.when(F.col(src).isNotNull(), F.concat(pre, body, bang))) \
        .drop("__tu_t", "__tu_h", "__tu_w", "__tu_n", "__tu_top")


def with_tone_up_seeded(df: DataFrame, src: str, out: str, u_word: Column, u_prefix: Column,
                        prefixes=TONE_UP_PREFIXES[:RANDOM_TONE_UP_PREFIX_COUNT]) -> DataFrame:
    """Shout one interior word (never first or last) and add a prefix and
    ``!``; the two uniforms come from a seeded row hash, so the choice is
    reproducible under any partitioning (not the study's random stream)."""
    df = df.withColumn("__ts_w", split_words(F.regexp_replace(F.col(src), r"[.!? ]+$", "")))
    words = F.col("__ts_w")
    n = F.size(words)
    pick = (F.lit(1) + F.floor(u_word * (n - 2))).cast("int")
    df = df.withColumn("__ts_i", F.when(n > 3, pick))
    i = F.col("__ts_i")
    shouted = F.when(i.isNull(), F.array_join(words, " ")).otherwise(_shout_at(words, n, i, F.lit(None).cast("int")))
    pre = F.element_at(F.array(*[F.lit(p) for p in prefixes]),
                       (F.floor(u_prefix * len(prefixes))).cast("int") + 1)
    return df.withColumn(out, F.when(F.col(src).isNotNull(), F.concat(pre, shouted, F.lit("!")))) \
        .drop("__ts_w", "__ts_i")


def variants(original: str, down: str, up: str, name: str = "version", text: str = "text") -> Column:
    """One row per version (down, original, up) via ``inline``-able structs."""
    return F.explode(F.array(
        F.struct(F.lit("down").alias(name), F.col(down).alias(text)),
        F.struct(F.lit("original").alias(name), F.col(original).alias(text)),
        F.struct(F.lit("up").alias(name), F.col(up).alias(text))))


def with_external_rewrites(df: DataFrame, rewrites: DataFrame, key: str, out: str,
                           rewrite_col: str = "rewrite", fallback: Column | None = None) -> DataFrame:
    """Rewrites produced outside the engine (for example by a language
    model run elsewhere) arrive as a table ``(key, rewrite)`` and are joined
    by id; rows without one fall back to ``fallback`` (a rule rewrite) or
    stay null. The engine itself makes no network calls."""
    r = rewrites.select(F.col(key), F.col(rewrite_col).alias("__ext"))
    j = df.join(r, key, "left")
    val = F.col("__ext") if fallback is None else F.coalesce(F.col("__ext"), fallback)
    return j.withColumn(out, val).drop("__ext")
