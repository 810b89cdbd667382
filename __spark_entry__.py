"""


Queries whose last step is driver algebra over collected sums or a posterior
(model fits, pair experiment, variant scoring) have no SQL oracle; ``tests/``
checks the algebra behind them on small inputs.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from glare.functions import sentiment as SN  # noqa: E402
from glare.functions.lexicons import OPENER_ALTERNATIVES, TONE_UP_PREFIXES  # noqa: E402
from glare.functions.text import LINE_BREAK, PY_SPACE  # noqa: E402
from glare.plans import studies as S  # noqa: E402
from glare.sources import standins  # noqa: E402

try:  # the training-data operators and the pipeline; the rest works without them
    import glare.llm.registry as training_data  # noqa: E402
except ModuleNotFoundError as missing:
    if missing.name not in ("glare.llm", "glare.llm.registry", "corpus_pipeline"):
        raise
    training_data = None


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: within-test causal effects of headline style (Q4) on sf0.001."""
    return S.ab_effects(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "title_features": S.title_features,
        "corpus_features": S.corpus_features,
        "feature_describe": S.feature_describe,
        "domain_counts": S.domain_counts,
        "list_item_count": S.list_item_count,
        "dedup_keep_first": S.dedup_keep_first,
        "label_style_profile": S.label_style_profile,
        "stratified_split": S.stratified_split,
        "sample_titles": S.sample_titles,
        "qualifying_tests": S.qualifying_tests,
        "within_test_centering": S.within_test_centering,
        "weighted_gram": S.weighted_gram,
        "ridge_one_feature": S.ridge_one_feature,
        "percentile_rank_avg": S.percentile_rank_avg,
        "percentile_vs_reference": S.percentile_vs_reference,
        "score_against_index": S.score_against_index,
        "posterior_hdi": S.posterior_hdi,
        "rhat_table": S.rhat_table,
        "posterior_summary": S.posterior_summary,
        "coefficient_report": S.coefficient_report,
        "corpus_report": S.corpus_report,
        "tone_down": S.tone_down,
        "tone_up": S.tone_up,
        "ab_effects": S.ab_effects,
        "attention_score": S.attention_score,
        "pooled_linear": S.pooled_linear,
        "pooled_logit": S.pooled_logit,
        "style_logit": S.style_logit,
        "hier_engagement": S.hier_engagement,
        "hier_residuals": S.hier_residuals,
        "fitted_values": S.fitted_values,
        "predictive_band": S.predictive_band,
        "pair_gap": S.pair_gap,
        "pair_summary": S.pair_summary,
        "variant_scores": S.variant_scores,
        "lexicon_sentiment": S.lexicon_sentiment,
    } | (training_data.QUERIES if training_data else {})


# ----------------------------------------------------------------- oracle
NWS = PY_SPACE.replace("[", "[^", 1)
OPENER_RE2 = rf"(?i)^{PY_SPACE}*({OPENER_ALTERNATIVES})\b"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(words) -> str:
    return "(" + ", ".join(_q(w) for w in words) + ")"


HEADLINES = f"""
h AS (
  SELECT doc_id,
    regexp_replace(list_filter(string_split_regex(text, {_q(LINE_BREAK)}),
                               lambda x: regexp_matches(x, {_q(NWS)}))[1],
                   {_q(f'^{PY_SPACE}+|{PY_SPACE}+$')}, '', 'g') AS title,
    CASE WHEN TRY_CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) % 2 = 0 THEN 'g0' ELSE 'g1' END AS source,
    CAST(len(list_filter(string_split(replace(coalesce(text, ''), chr(10), chr(9)), chr(9)),
                         lambda x: regexp_matches(x, {_q(NWS)}))) AS INTEGER) AS n_tweets
  FROM documents)"""

CORPUS = HEADLINES + """,
lab AS (SELECT h.*, CAST(l.toxic AS INTEGER) AS fake FROM h JOIN labels l USING (doc_id)),
u AS (SELECT lab.*, coalesce(p.url, '') AS news_url FROM lab LEFT JOIN pages p ON p.page_id = lab.doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY title
        ORDER BY CASE WHEN source = 'g0' THEN 0 ELSE 1 END, 1 - fake, doc_id) AS rn
      FROM u WHERE title IS NOT NULL),
c0 AS (SELECT doc_id, title, source, fake, n_tweets,
         split_part(regexp_replace(regexp_replace(news_url, '^https?://', ''), '^www\\.', ''), '/', 1) AS domain
       FROM k WHERE rn = 1)"""


def _features(text: str, lex) -> str:
    tok = f"regexp_extract_all({text}, '[A-Za-z'']+')"
    ltok = f"list_transform({tok}, lambda x: lower(x))"
    n = f"CAST(greatest(len({tok}), 1) AS DOUBLE)"

    def cnt(words):
        return f"len(list_filter({ltok}, lambda x: x IN {_in(words)}))" if words else "0"

    def g(e):
        return f"CASE WHEN {text} IS NOT NULL THEN {e} END"

    f = {
        "sensational_ratio": f"{cnt(lex.sensational)} / {n}",
        "urgency_ratio": f"{cnt(lex.urgency)} / {n}",
        "caps_ratio": f"len(regexp_extract_all({text}, '\\p{{Lu}}')) / "
                      f"CAST(greatest(len(regexp_extract_all({text}, '\\p{{L}}')), 1) AS DOUBLE)",
        "all_caps_words": f"len(list_filter({tok}, lambda x: length(x) > 2 AND "
                          f"regexp_full_match(x, '[A-Z'']*[A-Z][A-Z'']*'))) / {n}",
        "exclamations": f"CAST(len(regexp_extract_all({text}, '!')) AS INTEGER)",
        "questions": f"CAST(len(regexp_extract_all({text}, '\\?')) AS INTEGER)",
        "clickbait_opener": f"CASE WHEN regexp_matches({text}, {_q(OPENER_RE2)}) THEN 1 ELSE 0 END",
        "second_person": f"{cnt(lex.second_person)} / {n}",
        "has_number": f"CASE WHEN regexp_matches({text}, '\\p{{Nd}}') THEN 1 ELSE 0 END",
        "title_len_words": f"CAST(len({tok}) AS INTEGER)",
    }
    return ",\n    ".join(f"{g(e)} AS {k}" for k, e in f.items())


LEX_COLS = ["sensational_ratio", "urgency_ratio", "caps_ratio", "all_caps_words", "exclamations",
            "questions", "clickbait_opener", "second_person", "has_number", "title_len_words"]

LINES = f"""
ln AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line,
    regexp_replace(parts[i], {_q(f'^{PY_SPACE}+|{PY_SPACE}+$')}, '', 'g') AS title
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, string_split_regex(text, {_q(LINE_BREAK)}) AS parts FROM documents))),
lines AS (SELECT * FROM ln WHERE title <> '')"""


def _upper(w: str) -> str:
    return f"(regexp_matches({w}, '\\p{{Lu}}') AND NOT regexp_matches({w}, '[\\p{{Ll}}\\p{{Lt}}]'))"


def _sentiment(n: str, src: str, text: str, words) -> str:
    """CTEs up to ``n``: x (every distinct text of src), vader_pos, vader_neg, vader_compound."""
    lex = [w for w, _ in words]
    up1, down1 = [b for b in SN.BOOSTERS_UP if " " not in b], [b for b in SN.BOOSTERS_DOWN if " " not in b]
    down2 = [b for b in SN.BOOSTERS_DOWN if " " in b]
    strip = f"regexp_replace(a, {_q(f'^[{SN.PUNCT}]+|[{SN.PUNCT}]+$')}, '', 'g')"
    out = f"""
{n}_lex AS (SELECT * FROM (VALUES {", ".join(f"({_q(w)}, CAST({v} AS DOUBLE))" for w, v in words)}) AS z(tok, v)),
{n}_t AS (SELECT DISTINCT {text} AS x FROM {src} WHERE {text} IS NOT NULL),
{n}_w AS (SELECT x, list_transform(regexp_extract_all(x, {_q(NWS + '+')}),
    lambda a: CASE WHEN length({strip}) <= 2 THEN a ELSE {strip} END) AS w FROM {n}_t),
{n}_c AS (SELECT x, w, list_transform(w, lambda a: lower(a)) AS lw, len(w) AS nt,
    len(list_filter(w, lambda a: {_upper('a')})) AS nu,
    least(len(regexp_extract_all(x, '!')), {SN.EXCLAMATION_MAX}) AS ex, len(regexp_extract_all(x, '\\?')) AS qm FROM {n}_w),
{n}_e AS (SELECT *, nu > 0 AND nu < nt AS capdiff, coalesce(list_position(lw, 'but'), 0) AS but,
    unnest(range(1, nt + 1)) AS i FROM {n}_c),
{n}_0 AS (SELECT e.*, v + CASE WHEN {_upper('w[i]')} AND capdiff THEN CASE WHEN v < 0 THEN -{SN.CAPS_BOOST} ELSE {SN.CAPS_BOOST} END
    ELSE 0 END AS val FROM {n}_e e JOIN {n}_lex ON tok = lw[i] WHERE lw[i] NOT IN {_in(up1 + down1)})"""
    for k, damp in zip((1, 2, 3), SN.DAMPING):
        out += f""",
{n}_{k}a AS (SELECT * EXCLUDE (val), val, CASE WHEN i > {k} AND lw[i - {k}] NOT IN {_in(lex)} THEN lw[i - {k}] END AS nb FROM {n}_{k - 1}),
{n}_{k}b AS (SELECT *, CASE WHEN nb IN {_in(up1)} THEN {SN.BOOST} WHEN nb IN {_in(down1)} THEN -{SN.BOOST} END AS b FROM {n}_{k}a),
{n}_{k}c AS (SELECT *, val + CASE WHEN b IS NULL THEN 0 ELSE (b + CASE WHEN {_upper(f'w[i - {k}]')} AND capdiff
    THEN CASE WHEN b > 0 THEN {SN.CAPS_BOOST} ELSE -{SN.CAPS_BOOST} END ELSE 0 END) * CASE WHEN val < 0 THEN -1 ELSE 1 END * {damp} END
    AS val2 FROM {n}_{k}b),
{n}_{k} AS (SELECT * EXCLUDE (val, val2, nb, b), CASE WHEN nb IN {_in(SN.NEGATIONS)} OR contains(nb, 'n''t')
    THEN val2 * {SN.NEGATION_SCALAR} ELSE val2 END AS val FROM {n}_{k}c)"""
    two = " + ".join(f"CASE WHEN i > {j + 1} AND lw[i - {j + 1}] || ' ' || lw[i - {j}] IN {_in(down2)} THEN -{SN.BOOST} ELSE 0 END"
                     for j in (1, 2))
    return out + f""",
{n}_s AS (SELECT *, (val + {two}) * CASE WHEN but > 0 AND i < but THEN {SN.BUT_BEFORE} WHEN but > 0 AND i > but THEN {SN.BUT_AFTER}
    ELSE 1 END AS s FROM {n}_3),
{n}_g AS (SELECT x, sum(s) AS ss, coalesce(sum(CASE WHEN s > 0 THEN s + 1 END), 0) AS ps,
    coalesce(sum(CASE WHEN s < 0 THEN s - 1 END), 0) AS ns, any_value(nt) - sum(CASE WHEN s <> 0 THEN 1 ELSE 0 END) AS neu,
    any_value(ex) * {SN.EXCLAMATION_STEP} + CASE WHEN any_value(qm) > 3 THEN {SN.QUESTION_MANY}
      WHEN any_value(qm) > 1 THEN any_value(qm) * {SN.QUESTION_STEP} ELSE 0 END AS punct FROM {n}_s GROUP BY x),
{n}_p AS (SELECT x, ss, neu, CASE WHEN ps > abs(ns) THEN ps + punct ELSE ps END AS ps,
    CASE WHEN ps < abs(ns) THEN ns - punct ELSE ns END AS ns,
    CASE WHEN ss > 0 THEN ss + punct WHEN ss < 0 THEN ss - punct ELSE ss END AS ts FROM {n}_g),
{n} AS (SELECT t.x, CASE WHEN ps + abs(ns) + neu > 0 THEN abs(ps / (ps + abs(ns) + neu)) ELSE 0 END AS vader_pos,
    CASE WHEN ps + abs(ns) + neu > 0 THEN abs(ns / (ps + abs(ns) + neu)) ELSE 0 END AS vader_neg,
    CASE WHEN ss <> 0 THEN greatest(-1, least(1, ts / sqrt(ts * ts + {SN.NORMALIZE_ALPHA}))) ELSE 0 END AS vader_compound
  FROM {n}_t t LEFT JOIN {n}_p p ON t.x = p.x)"""


def _tone_up_sql() -> str:
    out = f"WITH {LINES},\nu0 AS (SELECT doc_id, line, title AS t FROM lines)"
    for k, prefix in enumerate(TONE_UP_PREFIXES, 1):
        out += (f",\nu{k} AS (SELECT doc_id, line, CASE WHEN starts_with(upper(t), {_q(prefix.upper())}) "
                f"THEN substr(t, {len(prefix) + 1}) ELSE t END AS t FROM u{k - 1})")
    last = f"u{len(TONE_UP_PREFIXES)}"
    pre = ", ".join(_q(p) for p in TONE_UP_PREFIXES)
    shout = "replace(upper(replace(w, 'ß', 'ss')), 'ß', 'SS')"
    return out + f""",
a AS (SELECT doc_id, line, list_sum(list_transform(regexp_extract_all(t, '(?s).'), lambda c: unicode(c))) AS h,
    regexp_extract_all(regexp_replace(t, '[.!? ]+$', ''), {_q(NWS + '+')}) AS words FROM {last}),
b AS (SELECT *, list_sort(list_transform(range(2, len(words) + 1), lambda i: {{'l': -length(words[i]), 'i': i}})) AS o FROM a)
SELECT doc_id, line, [{pre}][CAST(coalesce(h, 0) % {len(TONE_UP_PREFIXES)} AS INTEGER) + 1]
  || array_to_string(CASE WHEN len(words) > 3 THEN list_transform(words, lambda w, i:
       CASE WHEN i = o[1].i OR (i = o[2].i AND h % 3 = 0 AND len(words) > 5) THEN {shout} ELSE w END) ELSE words END, ' ')
  || CASE WHEN coalesce(h, 0) % 2 = 0 THEN '!' ELSE '!!' END AS up FROM b"""


CORPUS_FEATURES = CORPUS + f""",{_sentiment('sen', 'c0', 'title', standins.CORPUS_SENTIMENT)},
c AS (SELECT doc_id, title, source, fake, n_tweets, domain,
    {_features('title', standins.CORPUS_LEXICONS)}, vader_pos, vader_neg, abs(vader_compound) AS emotional_intensity
  FROM c0 JOIN sen ON c0.title = sen.x)"""

ARMS = """
li AS (SELECT l_partkey, count(*) AS impressions,
         CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS clicks
       FROM lineitem GROUP BY l_partkey),
arms AS (SELECT CAST(floor(p_partkey / 3) AS BIGINT) AS test_id, p_partkey AS arm_id,
    CASE p_size % 7 WHEN 1 THEN 'Why ' WHEN 2 THEN 'Your ' ELSE '' END
      || CASE WHEN p_size % 2 = 0 THEN upper(p_type[1]) || lower(p_type[2:]) ELSE p_type END || ' '
      || CASE WHEN p_size % 5 = 0 THEN upper(p_name) ELSE p_name END
      || CASE WHEN p_size % 3 = 0 THEN ' ' || p_size ELSE '' END
      || CASE p_size % 4 WHEN 0 THEN '!' WHEN 1 THEN '?' ELSE '' END AS headline,
    CAST(coalesce(impressions, 0) AS BIGINT) AS impressions, CAST(coalesce(clicks, 0) AS BIGINT) AS clicks
  FROM part LEFT JOIN li ON p_partkey = l_partkey),
clean AS (SELECT * FROM arms WHERE headline IS NOT NULL AND impressions > 0),
keys AS (SELECT test_id FROM clean WHERE test_id IS NOT NULL GROUP BY test_id HAVING min(headline) <> max(headline)),
ok AS (SELECT * FROM clean WHERE test_id IN (SELECT test_id FROM keys))"""

_CT = ["sensational_ratio", "urgency_ratio", "caps_ratio", "all_caps_words", "exclamations", "questions",
       "clickbait_opener", "second_person", "has_number", "title_len_words",
       "vader_pos", "vader_neg", "emotional_intensity"]

CAUSAL = ARMS + f""",{_sentiment('sen', 'ok', 'headline', standins.ARMS_SENTIMENT)},
f AS (SELECT arm_id, test_id, impressions, ln((clicks + 0.5) / (impressions - clicks + 0.5)) AS y,
    {_features('headline', standins.ARMS_LEXICONS)}, vader_pos, vader_neg, abs(vader_compound) AS emotional_intensity
  FROM ok JOIN sen ON ok.headline = sen.x),
ce AS (SELECT arm_id, test_id, impressions, y - avg(y) OVER (PARTITION BY test_id) AS y,
    {", ".join(f"{c} - avg({c}) OVER (PARTITION BY test_id) AS {c}" for c in _CT)}
  FROM f),
st AS (SELECT avg(impressions) AS mi, {", ".join(f"stddev_samp({c}) AS s_{c}" for c in _CT)} FROM ce),
z AS (SELECT arm_id, test_id, y, sqrt(impressions / mi) AS w,
    sqrt(impressions / mi) * sqrt(impressions / mi) AS w2,
    {", ".join(f"{c} / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END AS {c}" for c in _CT)}
  FROM ce CROSS JOIN st)"""

DRAWS = """
d AS (SELECT vec_id AS draw, CAST(vec_id % 4 AS INTEGER) AS chain,
        CAST(unnest(range(0, len(embedding))) AS INTEGER) AS param,
        CAST(unnest(embedding) AS DOUBLE) AS value
      FROM embeddings)"""


SHARE_BELOW = """WITH u AS (
  SELECT l_extendedprice AS v, 0 AS w FROM lineitem WHERE l_extendedprice IS NOT NULL
  UNION ALL SELECT o_totalprice, 1 FROM orders WHERE o_totalprice IS NOT NULL),
r AS (SELECT v, sum(w) OVER (ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
             - sum(w) OVER (PARTITION BY v) AS below FROM u),
dv AS (SELECT DISTINCT v, below FROM r),
n AS (SELECT count(*) AS n FROM orders WHERE o_totalprice IS NOT NULL)
SELECT l_orderkey, l_linenumber, round(below / n, 9) AS pct
FROM lineitem LEFT JOIN dv ON l_extendedprice = dv.v CROSS JOIN n"""


def _gram_sql() -> str:
    names = ["1", "sensational_ratio", "caps_ratio", "exclamations", "questions", "y"]
    expr = {n: ("1.0" if n == "1" else n) for n in names}
    parts = []
    for i, a in enumerate(names):
        for b in names[i:]:
            parts.append(f"SELECT {_q(a)} AS row_name, {_q(b)} AS col_name, "
                         f"round(sum(w2 * {expr[a]} * {expr[b]}), 9) AS value FROM z")
    return "WITH " + CAUSAL + "\n" + "\nUNION ALL\n".join(parts)


def _fitted_sql() -> str:
    pairs = [("alpha", "alpha"), ("alpha", "beta"), ("alpha", "gamma"), ("beta", "beta"), ("beta", "gamma"), ("gamma", "gamma")]
    k = len(standins.STRATA)
    rows = ", ".join(f"({i}, {_q(x)})" for i, x in enumerate(standins.STRATA))
    factor = {"alpha": "1", "beta": "a", "gamma": "t"}
    var = " + ".join(f"c_{p}_{q} * {factor[p]} * {factor[q]} * {1 if p == q else 2}" for p, q in pairs)
    return f"""WITH {CORPUS},
f AS (SELECT doc_id, source || '_' || CASE fake WHEN 0 THEN 'real' WHEN 1 THEN 'fake' END AS stratum, ln(1 + n_tweets) AS y,
    {_features('title', standins.CORPUS_LEXICONS)} FROM c0),
x AS (SELECT doc_id, stratum, y, caps_ratio - avg(caps_ratio) OVER () AS a, (title_len_words - avg(title_len_words) OVER ())
    / CASE WHEN stddev_samp(title_len_words) OVER () = 0 THEN 1 ELSE stddev_samp(title_len_words) OVER () END AS t FROM f),
d AS (SELECT stratum, CAST(embedding[i + 1] AS DOUBLE) AS alpha, CAST(embedding[i + {k + 1}] AS DOUBLE) AS beta,
    CAST(embedding[{2 * k + 1}] AS DOUBLE) AS gamma, 0.5 + abs(CAST(embedding[{2 * k + 2}] AS DOUBLE)) AS s
  FROM embeddings CROSS JOIN (VALUES {rows}) AS z(i, stratum)),
g AS (SELECT stratum, avg(alpha) AS alpha, avg(beta) AS beta, avg(gamma) AS gamma, avg(s * s) AS noise2,
    {", ".join(f"covar_samp({p}, {q}) AS c_{p}_{q}" for p, q in pairs)} FROM d GROUP BY stratum),
v AS (SELECT doc_id, x.stratum, y, alpha + beta * a + gamma * t AS fitted, greatest({var}, 0) AS v, noise2
  FROM x LEFT JOIN g ON x.stratum = g.stratum),
w AS (SELECT *, y - fitted AS residual, sqrt(v + noise2) AS ps FROM v)
SELECT doc_id, stratum, round(y, 9) AS y, round(fitted, 9) AS fitted, round(sqrt(v), 9) AS fitted_sd, round(ps, 9) AS predictive_sd,
  round(residual, 9) AS residual, round(residual / ps, 9) AS z,
  round(-0.5 * (residual / ps) * (residual / ps) - ln(ps) - 0.5 * ln(2 * pi()), 9) AS log_density FROM w"""


def _tone_down_sql() -> str:
    mapping = standins.CORPUS_LEXICONS.neutralize_map()
    key = "lower(regexp_replace(w, '[^\\p{L}\\p{N}_]', '', 'g'))"
    case_map = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in mapping.items())
    rewrite = (f"CASE WHEN {key} IN {_in(mapping)} THEN (CASE {key} {case_map} END) "
               f"WHEN length({key}) > 2 AND regexp_matches(w, '\\p{{Lu}}') "
               f"AND NOT regexp_matches(w, '[\\p{{Ll}}\\p{{Lt}}]') THEN upper(left(w, 1)) || lower(substr(w, 2)) "
               f"ELSE w END")
    words = f"regexp_extract_all(title, {_q(NWS + '+')})"
    joined = f"replace(array_to_string(list_filter(list_transform({words}, lambda w: {rewrite}), lambda x: x <> ''), ' '), '!', '.')"
    strip = f"regexp_replace({joined}, {_q(f'^{PY_SPACE}+|{PY_SPACE}+$')}, '', 'g')"
    return f"WITH {LINES}\nSELECT doc_id, line, {strip} AS down FROM lines"


def oracle_sql() -> dict[str, str]:
    lex_cols = ", ".join(LEX_COLS)
    return {
        "title_features": f"""WITH {HEADLINES}
SELECT doc_id, title,
    {_features('title', standins.CORPUS_LEXICONS)}
FROM h""",
        "corpus_features": f"""WITH {CORPUS_FEATURES}
SELECT doc_id, title, source, fake, n_tweets, domain, {lex_cols}, round(vader_pos, 9) AS vader_pos,
  round(vader_neg, 9) AS vader_neg, round(emotional_intensity, 9) AS emotional_intensity FROM c""",
        "feature_describe": f"""WITH {CORPUS_FEATURES},
long AS (SELECT 'sensational_ratio' AS feature, sensational_ratio AS value FROM c
         UNION ALL SELECT 'urgency_ratio', urgency_ratio FROM c
         UNION ALL SELECT 'caps_ratio', caps_ratio FROM c)
SELECT feature, count(value) AS count, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS std,
  round(min(value), 9) AS min, round(quantile_cont(value, 0.25), 9) AS q25,
  round(quantile_cont(value, 0.5), 9) AS q50, round(quantile_cont(value, 0.75), 9) AS q75,
  round(max(value), 9) AS max
FROM long GROUP BY feature""",
        "corpus_report": f"""WITH {CORPUS}
SELECT count(*) AS n_rows, round(avg(CASE WHEN fake = 1 THEN 1.0 ELSE 0.0 END), 9) AS share_fake FROM c0""",
        "domain_counts": """SELECT domain, count(*) AS n_pages FROM (
  SELECT split_part(regexp_replace(regexp_replace(coalesce(url, ''), '^https?://', ''), '^www\\.', ''), '/', 1)
    AS domain FROM pages) GROUP BY domain""",
        "list_item_count": f"""SELECT doc_id,
  CAST(len(list_filter(string_split(replace(coalesce(text, ''), chr(10), chr(9)), chr(9)),
                       lambda x: regexp_matches(x, {_q(NWS)}))) AS INTEGER) AS n_items
FROM documents""",
        "dedup_keep_first": f"WITH {CORPUS}\nSELECT title, doc_id, source, fake FROM c0",
        "label_style_profile": f"""WITH {CORPUS_FEATURES},
s AS (SELECT *, source || '_' || CASE fake WHEN 0 THEN 'real' WHEN 1 THEN 'fake' END AS stratum FROM c)
SELECT stratum, count(*) AS n,
  round(avg(sensational_ratio), 9) AS mean_sensational_ratio, round(avg(caps_ratio), 9) AS mean_caps_ratio,
  round(avg(all_caps_words), 9) AS mean_all_caps_words, round(avg(exclamations), 9) AS mean_exclamations,
  round(avg(title_len_words), 9) AS mean_title_len_words, round(stddev_samp(caps_ratio), 9) AS sd_caps_ratio,
  round(quantile_cont(n_tweets, 0.5), 9) AS median_n_tweets
FROM s GROUP BY stratum""",
        "stratified_split": f"""WITH {CORPUS},
s AS (SELECT doc_id, source || '_' || CASE fake WHEN 0 THEN 'real' WHEN 1 THEN 'fake' END AS stratum FROM c0)
SELECT doc_id, stratum,
  CASE WHEN row_number() OVER (PARTITION BY stratum ORDER BY md5('42-' || CAST(doc_id AS VARCHAR)), doc_id) - 1
            < floor(count(*) OVER (PARTITION BY stratum) * 0.5) THEN 'A' ELSE 'B' END AS split
FROM s""",
        "sample_titles": f"""WITH {CORPUS}
SELECT doc_id, title FROM c0 WHERE fake = 0
ORDER BY md5('42-' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 50""",
        "qualifying_tests": f"""WITH {ARMS}
SELECT test_id, count(*) AS n_arms, count(DISTINCT headline) AS n_headlines FROM ok GROUP BY test_id""",
        "within_test_centering": f"""WITH {CAUSAL}
SELECT arm_id, test_id, round(y, 9) AS y, round(w, 9) AS w,
  {", ".join(f"round({c}, 9) AS {c}" for c in _CT)}
FROM z""",
        "weighted_gram": _gram_sql(),
        "ridge_one_feature": f"""WITH {CORPUS_FEATURES},
f AS (SELECT caps_ratio AS x, ln(1 + n_tweets) AS y FROM c),
m AS (SELECT avg(x) AS mx, avg(y) AS my, count(*) AS n FROM f),
s AS (SELECT sum((x - mx) * (x - mx)) AS sxx, sum((x - mx) * (y - my)) AS sxy, any_value(n) AS n,
        any_value(my) AS my FROM f CROSS JOIN m),
t AS (SELECT *, CASE WHEN sqrt(sxx / n) = 0 THEN 1 ELSE sqrt(sxx / n) END AS sd FROM s)
SELECT 'caps_ratio' AS feature, round((sxy / sd) / (sxx / (sd * sd) + 1.0), 9) AS coef,
  round(my, 9) AS intercept FROM t""",
        "percentile_rank_avg": """SELECT o_orderkey,
  CASE WHEN o_totalprice IS NOT NULL THEN round((rank() OVER (ORDER BY o_totalprice) - 1
     + (count(*) OVER (PARTITION BY o_totalprice) + 1) / 2.0) / count(o_totalprice) OVER (), 9) END AS pct
FROM orders""",
        "percentile_vs_reference": SHARE_BELOW,
        "score_against_index": SHARE_BELOW,
        "posterior_hdi": f"""WITH {DRAWS},
s AS (SELECT param, value, row_number() OVER (PARTITION BY param ORDER BY value) - 1 AS i,
        count(*) OVER (PARTITION BY param) AS n FROM d WHERE value IS NOT NULL),
cand AS (SELECT a.param, a.value AS lo, b.value AS hi, a.i,
           row_number() OVER (PARTITION BY a.param ORDER BY b.value - a.value, a.i) AS rk
         FROM s a JOIN s b ON a.param = b.param AND b.i = a.i + CAST(floor(a.n * 0.94) AS BIGINT)),
h AS (SELECT param, lo AS hdi_lo, hi AS hdi_hi FROM cand WHERE rk = 1),
m AS (SELECT param, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd,
        quantile_cont(value, 0.03) AS p3, quantile_cont(value, 0.97) AS p97 FROM d GROUP BY param)
SELECT m.param, n, round(mean, 9) AS mean, round(sd, 9) AS sd, round(hdi_lo, 9) AS hdi_lo,
  round(hdi_hi, 9) AS hdi_hi, round(p3, 9) AS p3, round(p97, 9) AS p97
FROM m JOIN h USING (param)""",
        "rhat_table": f"""WITH {DRAWS},
p AS (SELECT param, chain, value, row_number() OVER (PARTITION BY param, chain ORDER BY draw) - 1 AS pos,
        count(*) OVER (PARTITION BY param, chain) AS n FROM d),
q AS (SELECT *, CASE WHEN pos < floor(n / 2) THEN 0 WHEN pos >= n - floor(n / 2) THEN 1 END AS half FROM p),
per AS (SELECT param, chain, half, count(*) AS h, avg(value) AS m, var_samp(value) AS v
        FROM q WHERE half IS NOT NULL GROUP BY param, chain, half),
agg AS (SELECT param, min(h) AS h, var_samp(m) AS bh, avg(v) AS w FROM per GROUP BY param)
SELECT param, round(sqrt(((h - 1) / h * w + bh) / w), 9) AS r_hat FROM agg""",
        "fitted_values": _fitted_sql(),
        "predictive_band": f"""WITH {HEADLINES},
s AS (SELECT doc_id, (rank() OVER (ORDER BY n_tweets) - 1) / CAST(count(*) OVER () AS DOUBLE) AS score FROM h),
u AS (SELECT DISTINCT score, score - (SELECT avg(score) FROM s) AS c FROM s),
p AS (SELECT score, 1 / (1 + exp(-(CAST(embedding[1] AS DOUBLE) + CAST(embedding[2] AS DOUBLE) * c))) AS p FROM u CROSS JOIN embeddings),
b AS (SELECT score, avg(p) AS p_mean, quantile_cont(p, 0.03) AS p_lo, quantile_cont(p, 0.97) AS p_hi FROM p GROUP BY score)
SELECT doc_id, round(score, 9) AS score, round(p_mean, 9) AS p_mean, round(p_lo, 9) AS p_lo, round(p_hi, 9) AS p_hi
FROM s JOIN b USING (score)""",
        "tone_down": _tone_down_sql(),
        "tone_up": _tone_up_sql(),
        "lexicon_sentiment": f"""WITH {LINES},{_sentiment('sen', 'lines', 'title', standins.CORPUS_SENTIMENT)}
SELECT doc_id, line, round(vader_pos, 9) AS vader_pos, round(vader_neg, 9) AS vader_neg,
  round(vader_compound, 9) AS vader_compound, round(abs(vader_compound), 9) AS emotional_intensity
FROM lines JOIN sen ON title = x""",
    } | (training_data.ORACLES if training_data else {})
