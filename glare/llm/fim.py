"""Operator 11: fill-in-middle transformation by a wavelet matrix over character classes."""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glare.llm.common import table
from glare.llm.wavelet import UNITS, WaveletMatrix, classes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: out of 100: texts that are cut, and cut texts whose suffix comes first
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 90, 20
#: bytes of text under one wavelet matrix (a longer text has one of its own)
MATRIX_BYTES = 1 << 22


def hash_words(ids, seed: str) -> np.ndarray:
    """h1 to h4 of each id, (rows, 4): the first four 32-bit words of the sha256
    of seed, colon and the id in decimal (null: nothing after the colon)."""
    digests = [hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids]
    return np.frombuffer(b"".join(digests), ">u4").astype(np.int64).reshape(-1, 4)


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after the other, and the offsets of the texts in them."""
    large = texts.cast(pa.large_binary())
    _, offsets, data = large.buffers()
    at = np.frombuffer(offsets, np.int64)[large.offset:large.offset + len(large) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0]:at[-1]], at - at[0]


def _runs(texts: pa.Array, most: int):
    """(from, to) ranges of rows that hold at most ``most`` bytes, or one row."""
    _, at = _buffers(texts)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def _transform(ids: pa.Array, texts: pa.Array, unit: str, seed: str) -> list[pa.Array]:
    data, at = _buffers(texts)
    lo, hi, wanted = at[:-1], at[1:], UNITS[unit]
    matrix = WaveletMatrix(classes(data, lo))
    h, n = hash_words(ids.to_pylist(), seed), matrix.count(wanted, lo, hi)
    k = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    first, second = (matrix.cut_after(wanted, lo, hi, k[:, j]) for j in (0, 1))
    chars = UNITS["char"]
    prefix_chars, middle_chars = matrix.count(chars, lo, first), matrix.count(chars, first, second)
    whole, marks = data.tobytes(), [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    forms, outputs = [], []
    for i, (a, p, q, b) in enumerate(zip(lo.tolist(), first.tolist(), second.tolist(), hi.tolist())):
        text = whole[a:b]
        if not text or h[i, 2] % 100 >= CUT_PERCENT or any(m in text for m in marks):
            forms.append("plain")
            outputs.append(text)
            continue
        prefix, middle, suffix = marks[0] + whole[a:p], marks[2] + whole[p:q], marks[1] + whole[q:b]
        suffix_first = h[i, 3] % 100 < SUFFIX_FIRST_PERCENT
        forms.append("spm" if suffix_first else "psm")
        outputs.append((suffix + prefix if suffix_first else prefix + suffix) + middle)
    plain = np.array([f == "plain" for f in forms], bool)
    return [ids, pa.array(n), pa.array(forms, pa.string()), pa.array(prefix_chars, mask=plain),
            pa.array(middle_chars, mask=plain), pa.array(outputs, pa.binary()).cast(pa.string())]


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "char",
                   seed: str = "1") -> DataFrame:
    """One row per input row: ``id_col``, n (units), form, prefix_chars,
    middle_chars, output (the transformed text).

    A text is cut before two of its units (``unit``: char, word or line; words are
    runs of what is not ASCII white space, lines end after \\n) that the id's hash
    draws; what lies before the first unit goes to the prefix. Forms: plain, psm,
    spm. Both cuts are found by rank queries on one wavelet matrix over the texts
    of a few megabytes, so a row costs no Python loop over its characters. Per row:
    no shuffle, memory of one Arrow batch, a retried task gives the same rows.

    A null or empty text is plain with n = 0 and an empty output; a text that
    contains a marker is plain, so ``restored`` is exact for all; null ids draw
    from the seed alone, repeated ids draw alike; an empty table gives no rows;
    other columns are not read."""
    if unit not in UNITS:
        raise ValueError(f"unit is one of {sorted(UNITS)}")
    names = [id_col, "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches):
        for b in batches:
            for lo, hi in _runs(b.column(1), MATRIX_BYTES):
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(_transform(part.column(0), part.column(1), unit, seed), names)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("__text")).mapInArrow(
        run, f"`{id_col}` {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from. Markers start with their
    only ``<``, so the ones that were put in are the only ones in the output."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (F.when(form == "psm", F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(3)), F.get(part, F.lit(2))))
            .when(form == "spm", F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(1))))
            .otherwise(output))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
    sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
w AS (SELECT *, {", ".join(f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS UBIGINT) AS h{k + 1}" for k in range(4))} FROM d),
c AS (SELECT *, CAST(least(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS p, CAST(greatest(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS q,
    CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {CUT_PERCENT}
      THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM w)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '{PREFIX}' || substr(t, 1, p) || '{SUFFIX}' || substr(t, q + 1) || '{MIDDLE}' || substr(t, p + 1, q - p)
    WHEN 'spm' THEN '{SUFFIX}' || substr(t, q + 1) || '{PREFIX}' || substr(t, 1, p) || '{MIDDLE}' || substr(t, p + 1, q - p)
    ELSE t END) AS output_sha256, sha256(t) AS restored_sha256
FROM c"""
