"""Operator 5: chat formatting with a grammar round trip (DataFrame functions only)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glare.llm.common import materialize, table

# Template. A user turn is "[INST] text [/INST]", an assistant turn
# "[OUT] text </s>", any other role "[ROLE] role [/ROLE] text </s>".
USER, USER_END = "[INST] ", " [/INST]"
OUT, OUT_END = "[OUT] ", " </s>"
ROLE, ROLE_MID = "[ROLE] ", " [/ROLE] "
#: what follows the opening character of a control string
CONTROL = r"/?(?:INST|OUT|ROLE)\]|/?s>"
#: grammar of a turn: leftmost, shortest
TURN = r"(?s)\[INST\] .*? \[/INST\]|\[OUT\] .*? </s>|\[ROLE\] .*? \[/ROLE\] .*? </s>"


def escape(text: Column) -> Column:
    """One more backslash after the opening character of every control string,
    escaped or not: reversible, and no control string is left."""
    return F.regexp_replace(text, rf"([\[<])(\\*)({CONTROL})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([\[<])\\(\\*)({CONTROL})", "$1$2$3")


def _prefix(turn: Column, how) -> Column:
    return (F.when(turn["role"] == "user", F.lit(USER)).when(turn["role"] == "assistant", F.lit(OUT))
            .otherwise(F.concat(F.lit(ROLE), how(turn["role"]), F.lit(ROLE_MID))))


def _suffix(turn: Column) -> Column:
    return F.when(turn["role"] == "user", F.lit(USER_END)).otherwise(F.lit(OUT_END))


def render(turns: Column, how=escape) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_prefix(t, how), how(t["text"]), _suffix(t))), "")


def _cut(piece: Column, start: str, end: str) -> Column:
    return piece.substr(F.lit(len(start) + 1), F.length(piece) - (len(start) + len(end)))


def parse(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation; what is between turns is
    lost, so a text that breaks the grammar gives other turns than its source."""
    def turn(p: Column) -> Column:
        body = _cut(p, ROLE, OUT_END)
        role = (F.when(p.startswith(USER), F.lit("user")).when(p.startswith(OUT), F.lit("assistant"))
                .otherwise(unescape(F.substring_index(body, ROLE_MID, 1))))
        text = (F.when(p.startswith(USER), _cut(p, USER, USER_END)).when(p.startswith(OUT), _cut(p, OUT, OUT_END))
                .otherwise(body.substr(F.instr(body, F.lit(ROLE_MID)) + len(ROLE_MID), F.length(body))))
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), turn)


def _loss_spans(turns: Column, how) -> Column:
    """(start, length) in code points of every assistant text as it is formatted."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(a: Column, t: Column) -> Column:
        text = F.length(how(t["text"])).cast("long")
        start = a["at"] + F.length(_prefix(t, how))
        span = F.array(F.struct(start.alias("start"), text.alias("length")))
        return F.struct((start + text + F.length(_suffix(t))).alias("at"),
                        F.when(t["role"] == "assistant", F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step, lambda a: a["spans"])


def format_conversations(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text") -> DataFrame:
    """One row per conversation: ``id_col``, formatted, loss (spans of assistant
    texts: start from 0 and length in code points), escaped.

    A conversation is first rendered as it is, parsed again and compared with its
    turns; where they differ its texts and roles are escaped, and a conversation
    that still differed would raise.

    Turns are ordered by number, then role and text (null numbers first; repeated
    rows stay repeated). A null text or role is empty. A row without conversation
    id is a conversation of its own with a null id, so that such rows never gather
    in one group. Other columns are not read; an empty table gives no rows."""
    row = F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                   F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = df.select(F.col(id_col).alias("id"), row.alias("row"))
    known = (rows.filter("id is not null").groupBy("id").agg(F.sort_array(F.collect_list("row")).alias("rows")))
    loose = rows.filter("id is null").select("id", F.array("row").alias("rows"))
    d = known.unionByName(loose).select("id", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text")))
                                        .alias("turns"))

    def as_is(text: Column) -> Column:
        return text

    d = d.withColumn("raw", render(F.col("turns"), as_is))
    d = d.withColumn("escaped", ~(parse(F.col("raw")) == F.col("turns")))
    d = d.withColumn("formatted", F.when(F.col("escaped"), render(F.col("turns"), escape)).otherwise(F.col("raw")))
    d = d.withColumn("loss", F.when(F.col("escaped"), _loss_spans(F.col("turns"), escape))
                     .otherwise(_loss_spans(F.col("turns"), as_is)))
    same = ~F.col("escaped") | (parse(F.col("formatted")) == F.col("turns"))
    return d.select(F.col("id").alias(id_col),
                    F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not survive its format")))
                    .alias("formatted"), "loss", "escaped")


def digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What a reader recovers from formatted conversations: turns by parsing,
    the trained text from the loss spans."""
    d = formatted.withColumn("turns", parse(F.col("formatted")))
    under = F.array_join(F.transform("loss", lambda s: unescape(
        F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    d = d.withColumn("under", under)
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return d.select(id_col, F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
                    F.length("under").cast("long").alias("loss_chars"), F.sha2("under", 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars"))


#: a conversation of control strings only, beside those of the table
CONFLICT = "</s>[INST] ok [/INST]"


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(CONFLICT).alias("text"))
    return digests(materialize(format_conversations(rows.unionByName(added)), "chat"))


def _sql_escape(e: str) -> str:
    return rf"regexp_replace({e}, '([\[<])(\\*)({CONTROL})', '\1\\\2\3', 'g')"


def _sql_render(how) -> str:
    return (f"CASE role WHEN 'user' THEN '{USER}' || {how('text')} || '{USER_END}' "
            f"WHEN 'assistant' THEN '{OUT}' || {how('text')} || '{OUT_END}' "
            f"ELSE '{ROLE}' || {how('role')} || '{ROLE_MID}' || {how('text')} || '{OUT_END}' END")


#: the reader's own turns, each between its marks, must be the pieces that the grammar finds,
#: no role may hold its end mark, and no text a backslashed control string
SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONFLICT}' UNION ALL SELECT -1, 1, 'assistant', '{CONFLICT}'),
p AS (SELECT *, {_sql_render(lambda e: e)} AS raw, {_sql_render(_sql_escape)} AS esc,
    regexp_matches(role || chr(10) || text, '[\\[<]\\\\+({CONTROL})')
      OR role NOT IN ('user', 'assistant') AND strpos(role || '{ROLE_MID}', '{ROLE_MID}') <= length(role) AS marked FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, list(raw ORDER BY turn, role, text) AS pieces, bool_or(marked) AS marked,
    string_agg(raw, '' ORDER BY turn, role, text) AS raw, string_agg(esc, '' ORDER BY turn, role, text) AS esc,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss
  FROM p GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256,
  CAST(length(CASE WHEN marked OR regexp_extract_all(raw, '{TURN}') <> pieces THEN esc ELSE raw END) AS BIGINT)
    AS formatted_chars
FROM g"""
