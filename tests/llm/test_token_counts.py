"""Operator 13 against the tokenizers library."""
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from glare.llm import token_counts as T

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, n_tokens string, __text int, n_bytes string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def whole():
    return T.prove_whole(PATH)


def odd_texts():
    rng = random.Random(7)
    alphabet = list(" \n\t\r\x0b\x0c\x1c\x00\x7f\x85\xa0  　'stdmlrev_A1ééßÿ×÷²½漢\U0001f642​!?.,-|<>σΣİſKÅ") + ["é", "́", "가"]
    alphabet += ["<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "'re", "''s", "'LL", "  ", "there", "Été!!", "the&&&", "123"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += [f"a{chr(c)}{chr(c)} b {chr(c)}!{chr(c)} {chr(c)}" for c in range(0x2200) if not 0xD800 <= c < 0xE000]
    return texts + ["", "x" * 50000, "Aé" * 3000, " " * 5000, "it's we'll '' 's", "<|endoftext|>" * 50]


def test_counts_equal_the_library(library, whole):
    c = T.WholeTokenCounter(PATH, whole, entries=300)  # generations change often
    for t in odd_texts():
        assert c.count(t) == len(library.encode(t, add_special_tokens=False).ids), repr(t[:80])


def test_proven_strings_are_one_token(library, whole):
    """Each proven string is one token of the model; whatever the proof leaves out is not."""
    vocab = library.get_vocab(with_added_tokens=False)
    assert 10_000 < len(whole) <= len(vocab)
    for s in random.Random(3).sample(sorted(v[:-4] for v in vocab if v.endswith("</w>") and len(v) > 4), 4000):
        assert (len(library.model.tokenize(s)) == 1) == (s in whole)
    text = [s for s in sorted(whole) if s.isascii() and s.isalpha() and s == s.lower()]
    assert len(text) > 10_000
    for s in random.Random(4).sample(text, 2000):
        assert len(library.encode(s, add_special_tokens=False).ids) == 1


def test_only_the_rest_is_merged(whole):
    c = T.WholeTokenCounter(PATH, whole)
    merged = []
    real = c.merge
    c.merge = lambda p: merged.append(p) or real(p)
    assert c.count("The dog, and the cat! ungzulich") == 7 + len(real("ungzulich"))
    assert merged == ["ungzulich"]


def test_rows(spark, library):
    rows = [(1, "Hello there, hello there. 123"), (2, None), (3, ""), (4, "word " * 9000), (5, "same"), (5, "same"), (None, "no id"),
            (7, "tail <|endoftext|> é漢🙂"), (8, "dog " * 2048), (9, "dog " * 2049)]
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA).repartition(3)
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in rows]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, T.count_tokens(df, PATH).collect()), key=key) == sorted(want, key=key)
    assert T.count_tokens(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_query_equals_the_library(spark, library):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in T.op13_token_counts(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert got.pop(r.doc_id) == (len((r.text or "").encode()), n, n > 2048)
    assert got == {}


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        T.prove_whole(public_tokenizers.path("byte_bpe_50k.json"))
