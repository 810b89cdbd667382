"""Operators 1, 3 and 4 against the tokenizers library and exact round trips."""
import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from glare.llm import bpe_codec, packing, rans
from glare.llm.common import slices_of_bytes
from glare.llm.tokens import ForcedBoundaryBPE, SpacedWordBPE

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids string, __text string, n_tokens int"


def odd_texts():
    rng = random.Random(5)
    alphabet = list(" \n\t\r\x0b\x0c\x1c\x85\xa0 　'stdmlrev A1ééß漢\U0001f642​!?.,-|<>σΣİ")
    alphabet += ["<|endoftext|>", "<|startoftext|>", "'re", "  ", "\n\n", "there", " Été"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += [f"a{chr(c)}{chr(c)} b {chr(c)}!{chr(c)}" for c in range(0x2100) if not 0xD800 <= c < 0xE000]
    return texts + ["", "x" * 50000, "Aé" * 3000, " " * 5000]


@pytest.mark.parametrize("kind,path", [(ForcedBoundaryBPE, BYTE), (SpacedWordBPE, WORD)])
def test_ids_equal_the_library(kind, path):
    mine, lib = kind(path, entries=500), Tokenizer.from_file(path)
    for t in odd_texts():
        assert np.frombuffer(mine.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t[:80])


def test_many_texts_equal_the_library():
    mine, lib = ForcedBoundaryBPE(BYTE, entries=500), Tokenizer.from_file(BYTE)
    rng = random.Random(7)
    parts = [*" \n\t\x85\xa0\u2003<'!.-(0129aZ", *"éÉß×÷ÿĀ½漢\u0301", "the", "'re", "<|endoftext|>"]
    texts = odd_texts() + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(20000)]
    texts += ["".join(rng.choice("etaoinsrhé") for _ in range(n)) for n in range(200)]
    got = mine.encode_many(pa.array(["cut off", *texts, None, ""]).slice(1))
    assert [x.tolist() for x in got[:-2]] == [x.ids for x in lib.encode_batch(texts, add_special_tokens=False)]
    assert [len(x) for x in got[-2:]] == [0, 0] and mine.encode_many(pa.array([], pa.string())) == []


def test_new_words_are_merged_without_a_call_each(monkeypatch):
    enc, calls, rng = ForcedBoundaryBPE(BYTE), [], random.Random(8)
    model = enc.tokenize
    monkeypatch.setattr(enc, "tokenize", lambda piece: calls.append(piece) or model(piece))
    text = " ".join("".join(rng.choice("aeinrstlé") for _ in range(rng.randint(3, 12))) for _ in range(5000))
    got = enc.encode_many(pa.array([text]))
    assert not calls and got[0].tobytes() == enc.encode(text) and calls


def test_slices_hold_at_most_so_many_bytes():
    sizes = [3, 0, 4, 50, 0, 1, 10, 9, 1, 0]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array(["x" * n for n in sizes])], ["i", "t"])
    got = [p.column(0).to_pylist() for p in slices_of_bytes(batch.slice(1), 1, most=10)]
    assert got == [[1, 2], [3], [4, 5], [6], [7, 8, 9]]
    assert list(slices_of_bytes(batch.slice(10), 1)) == []


def test_decode_equals_the_library():
    mine, lib = ForcedBoundaryBPE(BYTE), Tokenizer.from_file(BYTE)
    rng = random.Random(1)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(20)]  # broken UTF-8 among them
        assert mine.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_cuts_are_forced():
    enc = ForcedBoundaryBPE(BYTE)
    tokens = [t for t in enc.bytes_of if len(t) > 1]
    for t in random.Random(2).sample(tokens, 2000):
        if t not in {s.encode() for s in enc.added}:
            stand_in = "".join(enc.chars[b] for b in t)
            assert enc.inside.issuperset(zip(stand_in, stand_in[1:]))


@pytest.fixture
def docs(spark):
    rows = [(1, "Hello there, hello there. 123"), (2, None), (3, ""), (4, "word " * 9000), (5, "same"), (5, "same"),
            (None, "no id"), (7, "tail <|endoftext|> é漢🙂")]
    return spark.createDataFrame([(i, t, "x", "y", 3) for i, t in rows], SCHEMA)


def test_codec_digests(spark, docs):
    lib = Tokenizer.from_file(BYTE)
    out = bpe_codec.encode_decode_digests(docs, BYTE).collect()
    assert len(out) == 8
    want = sorted((str(r.doc_id), r.text or "") for r in docs.collect())
    for (i, t), r in zip(want, sorted(out, key=lambda r: (str(r.doc_id), r.n_tokens))):
        ids = lib.encode(t, add_special_tokens=False).ids
        assert (str(r.doc_id), r.n_tokens) == (i, len(ids))
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe_codec.encode_decode_digests(docs.limit(0), BYTE).count() == 0


def test_encode_then_decode_frames(spark, docs):
    from pyspark.sql import functions as F

    rows = docs.select("doc_id", "text")
    ids = bpe_codec.encode_texts(rows, F.col("text"), BYTE, [F.col("doc_id"), F.col("text")])
    back = bpe_codec.decode_ids(ids, BYTE, ["doc_id", "text"]).collect()
    assert all(r.decoded == (r.text or "") for r in back) and len(back) == 8


def test_packing_is_a_partition_of_every_document(spark, docs):
    lib = Tokenizer.from_file(WORD)
    out = packing.pack_documents(docs.filter("doc_id is null or doc_id <> 5"), WORD, capacity=256, window=4096).toPandas()
    for r in docs.filter("doc_id is null or doc_id <> 5").collect():
        ids = np.array(lib.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
        mine = out[out.doc_id.isna()] if r.doc_id is None else out[out.doc_id == r.doc_id]
        mine = mine.sort_values("start")
        assert (mine.start == mine.length.cumsum() - mine.length).all() and mine.length.sum() == len(ids)
        assert (mine.doc_tokens == len(ids)).all()
        for p in mine.itertuples():
            assert p.ids_crc32 == zlib.crc32(ids[p.start:p.start + p.length].tobytes())
    for _, s in out.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset == s.length.cumsum() - s.length).all() and s.length.sum() <= s.sequence_size.iloc[0] <= 256
    assert packing.pack_documents(docs.limit(0), WORD).count() == 0
    assert packing.pack_documents(docs.filter("doc_id = 5"), WORD).count() == 2


def test_pack_balances_and_pads_little():
    rng = random.Random(3)
    lengths = [rng.randint(1, 9000) for _ in range(500)]
    pieces, sizes = packing.pack(lengths, 4096)
    used = np.zeros(len(sizes), int)
    for _, _, n, s, _ in pieces:
        used[s] += n
    assert used.sum() == sum(lengths) and (used <= sizes).all() and sum(sizes) - used.sum() < packing.LEAST_TAIL
    assert packing.pack([], 4096) == ([], []) and packing.pack([0], 4096)[0] == []
    # equal short documents: each sequence gets as many
    pieces, sizes = packing.pack([64] * 640, 4096)
    assert len(sizes) == 10 and all(sum(p[3] == s for p in pieces) == 64 for s in range(10))


@pytest.mark.parametrize("tokens", [np.array([], int), np.array([7]), np.full(5000, 3), np.arange(60000) % 50257,
                                    np.random.default_rng(0).zipf(1.3, 40000) % 50257])
def test_rans_round_trip(tokens):
    tab = rans.Table(rans.normalise(np.bincount(tokens, minlength=8)))
    tab = rans.Table.from_bytes(tab.to_bytes())
    w = rans.SegmentWriter(tab)
    parts = np.array_split(tokens, 7)
    for i, p in enumerate(parts):
        w.add(None if i == 3 else i, p)
    chunks, about = w.close()
    assert about == {"n_docs": 7, "n_tokens": len(tokens)}
    data = b"".join(chunks)
    back = list(rans.read_segment(data, tab, tab.slots()))
    assert [i for i, _ in back] == [0, 1, 2, None, 4, 5, 6]
    assert all((a == b).all() and len(a) == len(b) for (_, a), b in zip(back, parts))
    if len(tokens) > 100:
        broken = bytearray(data)
        broken[len(data) // 3] ^= 1
        with pytest.raises(ValueError):
            list(rans.read_segment(bytes(broken), tab, tab.slots()))


def test_rans_is_close_to_the_entropy():
    tokens = np.random.default_rng(1).zipf(1.4, 300000) % 5000
    p = np.bincount(tokens) / len(tokens)
    bits = -(p[p > 0] * np.log2(p[p > 0])).sum() * len(tokens)
    w = rans.SegmentWriter(rans.Table(rans.normalise(np.bincount(tokens))))
    w.add(1, tokens)
    size = sum(map(len, w.close()[0]))
    assert size * 8 < bits * 1.03 + 2 * 64 * rans.LANES + 2000


def test_archive(spark, docs, tmp_path):
    lib = Tokenizer.from_file(BYTE)
    rans.write_archive(docs, BYTE, f"file://{tmp_path}/a")
    out = rans.read_archive(spark, f"file://{tmp_path}/a").toPandas().sort_values("start")
    rows = sorted(((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in docs.collect()))
    at = 0
    for (i, t), r in zip(rows, out.itertuples()):
        ids = np.array(lib.encode(t, add_special_tokens=False).ids + [2], "<u4")
        assert (-1 if pd.isna(r.doc_id) else r.doc_id, r.start, r.n_tokens) == (i, at, len(ids))
        assert r.ids_crc32 == zlib.crc32(ids.tobytes()) and r.ids == ids.tobytes()
        at += len(ids)
    assert len(out) == 8
    rans.write_archive(docs.limit(0), BYTE, f"file://{tmp_path}/b")
    assert rans.read_archive(spark, f"file://{tmp_path}/b").count() == 0


def test_operators_share_a_worker(monkeypatch):
    """A worker that counted tokens then packs: each finds its own objects."""
    import sys

    from glare.llm import tokens, token_counts
    from glare.llm.bpe_codec import tokenizer_path
    monkeypatch.setitem(sys.__dict__, "_glare_worker_store", {})
    path = tokenizer_path("word_bpe_49k.json")

    class Whole:
        value = frozenset()

    class Frame:
        sparkSession = type("S", (), {"sparkContext": type("C", (), {"broadcast": staticmethod(lambda x: Whole)})})
        schema = {"doc_id": type("T", (), {"dataType": type("D", (), {"simpleString": staticmethod(lambda: "long")})})}

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    import pyarrow as pa
    monkeypatch.setattr(token_counts, "prove_whole", lambda p: frozenset())
    monkeypatch.setattr(token_counts, "F", type("F", (), {"coalesce": staticmethod(lambda *a: type("A", (), {"alias": lambda *_: 0})()),
                                                          "col": staticmethod(str), "lit": staticmethod(str)}))
    run = token_counts.count_tokens(Frame(), path)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some words"])], ["doc_id", "__text"])
    assert list(run([batch]))[0].column("n_tokens").to_pylist()[0] > 0
    assert tokens.encoder(tokens.SpacedWordBPE, path).encode("some words")
