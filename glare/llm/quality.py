"""Operator 2: quality rules with cross-document line frequency (DataFrame functions only)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glare.llm.common import ASCII_SPACE, BROADCAST_IDS, materialize, table

#: base rules of the contract
LEAST_WORDS, MOST_REPEAT_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = "#*$%&|<>"
#: a line is above the limits if more distinct documents of its host hold it than
#: both this many and this percentage of the host's distinct documents
LINE_DOCS, LINE_PERCENT = 6, 5
#: for lines of at least so many words only LINE_DOCS is asked for: the percentage
#: would spare ever more copies of them as a host grows
LONG_LINE_WORDS = 3
#: a document is depleted if more than this percentage of its words are in removed lines
DEPLETED_PERCENT = 50


def _words(text: Column) -> Column:
    return F.filter(F.split(text, f"{ASCII_SPACE}+"), lambda w: w != "")


def _normal(text: Column) -> Column:
    """Lower case, white space runs but line ends as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09\x0B-\x0D]+", " "))


def _normal_lines(text: Column) -> Column:
    """Normalised lines with a word."""
    return F.filter(F.transform(F.split(_normal(text), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def base_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` columns but the text, plus n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words and base_failed. Per row, no shuffle."""
    keep = [c for c in docs.columns if c != text_col]
    t = F.coalesce(F.col(text_col), F.lit(""))
    space = " \t\n\x0b\x0c\r"
    d = docs.select(*keep, t.alias("__t"), _words(t).alias("__w"),
                    F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{ASCII_SPACE[1:-1]}]")).alias("__l"))
    n = F.size("__w")
    windows = F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)),
                                             lambda i: F.xxhash64(F.slice("__w", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    d = d.select(*keep, "__w", F.size("__w").cast("long").alias("n_words"),
                 F.length(F.translate("__t", space, "")).cast("long").alias("word_chars"),
                 (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
                 (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
                 windows.alias("__h"))
    # windows in hash order, where any repeats; equal neighbours are the repeated ones
    found = F.when(F.size(F.array_distinct("__h")) < F.size("__h"),
                   F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    d = d.withColumn("__s", found)

    def same(x, y):
        return (x["h"] == y["h"]) & (F.slice("__w", x["i"] + 1, WINDOW) == F.slice("__w", y["i"] + 1, WINDOW))

    def repeated(x, j):
        s = F.col("__s")
        return F.coalesce((j > 0) & same(x, F.get(s, j - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, j + 1)), F.lit(False))

    d = d.withColumn("__p", F.sort_array(F.transform(F.filter("__s", repeated), lambda x: x["i"])))
    covered = F.aggregate("__p", F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).cast("long").alias("n")),
                          lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(F.lit(WINDOW), i - a["at"])).alias("n")),
                          lambda a: a["n"])
    return (d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
            .drop("__w", "__h", "__s", "__p")
            .withColumn("base_failed", (F.col("n_words") < LEAST_WORDS)
                        | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))))


def _units(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """One row per row of ``docs``: host, a hash of the whole text, id, text."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
                       F.xxhash64(t, F.length(t)).alias("th"), F.col(id_col).alias("id"), t.alias("t"))


def line_verdicts(docs: DataFrame, id_col: str, text_col: str, host_col: str, line_docs: int = LINE_DOCS,
                  line_percent: float = LINE_PERCENT, long_words: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lines, above): per (host, document, line) the words it holds; and the
    (host, line) above the limits with the one document that keeps the line. The
    percentage does not hold for lines of ``long_words`` words or more, if given.

    Documents are counted by their whole text, so exact copies count once. The
    document with the smallest id keeps a line, so that a passage does not
    disappear everywhere. Lines are compared by 64-bit hashes."""
    lines = materialize(
        _units(docs, id_col, text_col, host_col)
        .select("host", "th", "id", F.explode(_normal_lines(F.col("t"))).alias("line"))
        .select("host", "th", "id", F.xxhash64("line").alias("h"), F.size(F.split("line", " ")).alias("w"))
        .groupBy("host", "th", "h").agg(F.sum("w").alias("w"), F.min("id").alias("id"), F.max("w").alias("one")), "lines")
    hosts = materialize(lines.select("host", "th").distinct().groupBy("host").agg(F.count("*").alias("docs")), "hosts")
    often = materialize(lines.groupBy("host", "h").agg(F.count("*").alias("n"), F.min(F.struct("id", "th")).alias("first"),
                                                         F.max("one").alias("one"))
                        .filter(F.col("n") > line_docs), "frequent")
    share = F.col("n") * 100 > F.col("docs") * line_percent
    above = materialize(often.join(hosts, "host").filter(share if long_words is None else share | (F.col("one") >= long_words))
                        .select("host", "h", F.col("first.th").alias("first")), "above")
    return lines, above


def depleted_texts(lines: DataFrame, above: DataFrame, depleted_percent: float = DEPLETED_PERCENT) -> DataFrame:
    """(host, th, hashes): the texts of a host that lose lines, with the hashes
    of the lost lines, and depleted."""
    gone = F.col("first").isNotNull() & (F.col("first") != F.col("th"))
    return materialize(
        lines.join(above, ["host", "h"], "left").groupBy("host", "th")
        .agg(F.sum("w").alias("all"), F.sum(F.when(gone, F.col("w")).otherwise(0)).alias("removed"),
             F.collect_list(F.when(gone, F.col("h"))).alias("hashes"))
        .filter("removed > 0").select("host", "th", "hashes",
                                      (F.col("removed") * 100 > F.col("all") * depleted_percent).alias("depleted")),
        "depleted")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
            depleted_percent: float = DEPLETED_PERCENT, long_words: int | None = LONG_LINE_WORDS) -> DataFrame:
    """One row per input row: ``id_col``, the base measures, base_failed, kept.

    Lines of ``long_words`` words or more go above LINE_DOCS whatever the host's
    size, shorter ones above both limits.

    A null or empty text has no words and fails the base rules; a null host is
    a host of its own; rows that repeat an id are judged each by its own text and
    host; an empty table gives no rows; other columns are not read."""
    texts = depleted_texts(*line_verdicts(docs, id_col, text_col, host_col, long_words=long_words), depleted_percent)
    depleted = texts.filter("depleted").select("host", "th", "depleted")
    # written: a filter on the result must not be pushed into the measures
    measured = materialize(base_measures(_units(docs, id_col, text_col, host_col), "t"), "measures")
    return (measured.join(depleted, ["host", "th"], "left")
            .select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", (~F.col("base_failed") & F.col("depleted").isNull()).alias("kept")))


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
            depleted_percent: float = DEPLETED_PERCENT, long_words: int | None = LONG_LINE_WORDS) -> DataFrame:
    """The rows that pass the base rules and are not depleted, with all their
    columns, their texts without the lines above the limits: the rows that
    ``quality`` keeps. Null or empty texts fail the base rules; rows that repeat an
    id are judged each by its own text; an empty table gives no rows."""
    texts = depleted_texts(*line_verdicts(docs, id_col, text_col, host_col, long_words=long_words), depleted_percent)
    failed = materialize(base_measures(_units(docs, id_col, text_col, host_col), "t").select("host", "th", "base_failed"),
                         "measures").filter("base_failed").distinct()
    texts = materialize(texts.join(failed, ["host", "th"], "full").select(
        "host", "th", "hashes", (F.coalesce("depleted", F.lit(False)) | F.coalesce("base_failed", F.lit(False))).alias("drop")),
        "verdicts")
    if (texts.agg(F.sum(F.greatest(F.size("hashes"), F.lit(0)) + 4)).first()[0] or 0) <= BROADCAST_IDS:
        texts = F.broadcast(texts)
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
                       F.xxhash64(t, F.length(t)).alias("th")).join(texts, ["host", "th"], "left")
    text = F.col(f"row.`{text_col}`")
    lines = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("hashes", F.xxhash64(_normal(x))))
    kept = F.when(F.col("hashes").isNull(), text).otherwise(F.array_join(lines, "\n"))
    return (rows.filter("drop is null or not drop")
            .select(*(kept.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns)))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


SQL = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) >= {WINDOW})),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, CAST(sum(least({WINDOW}, coalesce(i - p, {WINDOW}))) AS BIGINT) AS n_repeat_words
  FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM rep) GROUP BY doc_id),
ln AS (SELECT host, t, doc_id, trim(regexp_replace(unnest(string_split(lower(t), chr(10))),
    '[\\x20\\x09\\x0B-\\x0D]+', ' ', 'g')) AS line FROM w),
u AS (SELECT host, t, line, sum(len(string_split(line, ' '))) AS n, min(doc_id) AS d FROM ln WHERE line <> ''
  GROUP BY host, t, line),
hosts AS (SELECT host, count(DISTINCT t) AS docs FROM u GROUP BY host),
above AS (SELECT host, line, arg_min(t, d) AS first FROM u JOIN hosts USING (host) GROUP BY host, line, docs
  HAVING count(*) > {LINE_DOCS} AND (count(*) * 100 > docs * {LINE_PERCENT} OR len(string_split(line, ' ')) >= {LONG_LINE_WORDS})),
depleted AS (SELECT u.host, u.t FROM u LEFT JOIN above a ON u.host = a.host AND u.line = a.line
  GROUP BY u.host, u.t
  HAVING sum(CASE WHEN a.first IS NOT NULL AND a.first <> u.t THEN n ELSE 0 END) * 100 > sum(n) * {DEPLETED_PERCENT}),
m AS (SELECT doc_id, host, t, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND d.t IS NULL AS kept
FROM b LEFT JOIN depleted d ON b.host = d.host AND b.t = d.t"""
