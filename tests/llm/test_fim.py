"""Operator 11: wavelet matrix against plain counting, the transformation against plain Python and SQL."""
import hashlib
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest

from glare.llm import fim
from glare.llm.wavelet import UNITS, WaveletMatrix, classes

ODD = "a <é漢🙂\n\t PSM>Z"
SCHEMA = "doc_id long, text string, n string, output int, form string, __text string"


def texts():
    rng = random.Random(4)
    out = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 90))) for _ in range(300)]
    return out + ["", None, "<P>", "x<S>y", "<M", "<", "<<<<", " \n ", "\n", "é", "long 🙂 word\n" * 20000, "<" * 5000]


def starts(text, unit):
    """Character positions where units start, by plain rules."""
    if unit == "char":
        return list(range(len(text)))
    if unit == "word":
        return [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    return [i for i in range(len(text)) if i == 0 or text[i - 1] == "\n"]


def expected(doc_id, text, unit="char", seed="1"):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    s = starts(text, unit)
    n = len(s)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, q = ((s + [len(text)])[k] for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    a, b, c = "<P>" + text[:p], "<S>" + text[q:], "<M>" + text[p:q]
    return (n, "spm", p, q - p, b + a + c) if h4 % 100 < 20 else (n, "psm", p, q - p, a + b + c)


def test_ranks_and_cuts_equal_plain_counting():
    data = np.frombuffer("".join(t for t in texts()[:60] if t).encode(), np.uint8)
    c = classes(data, np.array([0]))
    m, rng = WaveletMatrix(c), np.random.default_rng(1)
    lo = rng.integers(0, len(c) + 1, 200)
    hi = rng.integers(0, len(c) + 1, 200)
    lo, hi = np.minimum(lo, hi), np.maximum(lo, hi)
    for wanted in [*UNITS.values(), (0,), (7,), (), tuple(range(8)), (1, 6)]:
        assert m.count(wanted, lo, hi).tolist() == [int(np.isin(c[a:b], wanted).sum()) for a, b in zip(lo, hi)]
    k = rng.integers(0, 30, 200)
    got = m.cut_after(UNITS["word"], lo, hi, k)
    for a, b, n, p in zip(lo, hi, k, got):
        at = a + np.flatnonzero(np.isin(c[a:b], UNITS["word"]))
        assert p == (at[n] if n < len(at) else b)


@pytest.mark.parametrize("unit,seed", [("char", "1"), ("word", "1"), ("line", "other")])
def test_rows_equal_plain_python(spark, unit, seed):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "no id at all"), (3, "repeated id"), (-7, "negative id"), (3, "repeated id")]
    df = spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in rows], SCHEMA).repartition(3)
    got = fim.fill_in_middle(df, unit=unit, seed=seed)
    back = got.withColumn("back", fim.restored(got.output, got.form)).collect()
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in back), key=key) == \
        sorted(((i, *expected(i, t, unit, seed)) for i, t in rows), key=key)
    assert sorted(r.back for r in back) == sorted(t or "" for _, t in rows)
    assert {r.form for r in back} == {"plain", "psm", "spm"}


def test_small_matrices_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in enumerate(texts()[:100])], SCHEMA).coalesce(1)
    whole = fim.fill_in_middle(df).collect()
    monkeypatch.setattr(fim, "MATRIX_BYTES", 64)
    assert fim.fill_in_middle(df).collect() == whole


def test_empty_table(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_equals_sql(spark):
    got = fim.op11_fim(spark, "/root/testdata/sf0.001").toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.execute("create view documents as from '/root/testdata/sf0.001/documents.parquet'")
    want = con.execute(fim.SQL).df().sort_values("doc_id").reset_index(drop=True)
    for c in want.columns:
        a, b = got[c].astype(object), want[c].astype(object)
        assert a.where(pd.notna(a), None).tolist() == b.where(pd.notna(b), None).tolist(), c
    assert got.restored_sha256.tolist() == want.restored_sha256.tolist()
