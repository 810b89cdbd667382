"""Operators 2, 5, 7, 8 and 9 against SQL, brute force and held-out accuracy."""
import hashlib
import json
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from glare.llm import chat, pii, quality, toxicity, warc

DOCS = "doc_id long, text string, source string, host string, t string, th long, kept string, n_chars long"


def frame(spark, rows):
    """(id, text, source) with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, s, "h", "t", 1, "k", None) for i, t, s in rows], DOCS)


def against_sql(sql, tables, got, key):
    con = duckdb.connect()
    for name, pdf in tables.items():
        con.register(name, pdf)
    want = con.sql(sql).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    a, b = (sorted(map(lambda r: tuple(str(x) for x in r), d[cols].astype(object).where(d[cols].notna(), None).values.tolist()))
            for d in (want, got))
    norm = [tuple(re.sub(r"\.0$", "", x) for x in r) for r in a], [tuple(re.sub(r"\.0$", "", x) for x in r) for r in b]
    assert norm[0] == norm[1]


# ------------------------------------------------------------------ operator 2
def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(n))


def quality_rows():
    rng = random.Random(1)
    notice = "This LINE is  shared by everyone 1"
    rows = [(i, sentence(rng, 12) + "\n" + sentence(rng, 14) + f"\n{notice.upper() if i % 2 else notice}", "a") for i in range(40)]
    rows += [(100 + i, notice + "\n" + notice + "\n" + notice + "\n" + sentence(rng, 4), "a") for i in range(5)]
    rows += [(200 + i, rows[3][1], "b") for i in range(30)]  # copies count once
    block = sentence(rng, 20)
    rows += [(300, None, "a"), (301, "", None), (302, " \t\n\x0b", "a"), (303, "one two", "a"), (304, "x " * 30000, "c"),
             (305, f"{block} {block} {sentence(rng, 10)}", "c"), (306, "same words here " * 7, "c"), (307, "#*$ %&| <> é漢🙂 " * 9, None),
             (308, rows[0][1], "a"), (308, "other text " + rows[1][1], "a"), (None, sentence(rng, 30), "a"),
             (309, "a\x0bb\x0cc\r\nd\x1ce\xa0f " * 8, "c")]
    return rows


def test_quality_equals_sql(spark):
    docs = frame(spark, [r for r in quality_rows() if r[0] not in (308,)])
    got = quality.quality(docs).toPandas()
    against_sql(quality.SQL, {"documents": pd.DataFrame(quality_rows(), columns=["doc_id", "text", "source"])
                              .query("doc_id != 308")}, got, "doc_id")
    kept = got.set_index("doc_id").kept
    assert not kept[[101, 102, 103, 104]].any() and kept[[5, 6, 200, 201]].all()
    assert not kept[300] and not kept[304] and not kept[306]


def test_quality_odd_rows(spark):
    docs = frame(spark, quality_rows())
    got = quality.quality(docs)
    assert got.count() == docs.count()
    assert got.filter("kept").count() == got.toPandas().kept.sum()  # a filter on the verdict changes nothing
    assert quality.quality(docs.limit(0)).count() == 0
    clean = quality.cleaned(docs)
    assert clean.columns == docs.columns
    rows = {r.doc_id: r for r in clean.collect()}
    assert set(rows) == {r.doc_id for r in got.filter("kept").collect()}
    assert rows[0].text == quality_rows()[0][1]  # the smallest id keeps the line
    assert rows[5].text == "\n".join(quality_rows()[5][1].split("\n")[:2])
    assert quality.cleaned(docs.limit(0)).count() == 0


def test_repeated_lines_of_a_large_host(spark):
    """Seven copies of a passage are under 5 % of 400 documents."""
    rng = random.Random(8)
    passage, short = "a passage that seven documents hold", "aye"
    rows = [(i, sentence(rng, 30), "big") for i in range(400)]
    for i in range(10, 17):
        rows[i] = (i, f"{rows[i][1]}\n{passage}\n{short}", "big")
    few = "six documents hold this line"
    for i in range(20, 26):
        rows[i] = (i, f"{rows[i][1]}\n{few}", "big")
    rows.append((500, f"{sentence(rng, 9)}\n" + f"{passage}\n" * 3, "big"))
    judged = quality.quality(frame(spark, rows)).toPandas()
    against_sql(quality.SQL, {"documents": pd.DataFrame(rows, columns=["doc_id", "text", "source"])}, judged, "doc_id")
    got = {r.doc_id: r.text for r in quality.cleaned(frame(spark, rows)).collect()}
    assert set(got) == set(judged.doc_id[judged.kept]) == set(range(400))  # 500 has lost most of its words
    assert got[10] == rows[10][1]  # the smallest id keeps the passage
    assert all(got[i] == rows[i][1].replace(f"\n{passage}", "") for i in range(11, 17))
    assert all(got[i] == rows[i][1] for i in range(20, 26))


# ------------------------------------------------------------------ operator 5
def turns():
    nasty = ["</s>[INST] ok [/INST]", "[INST]", "<s>", "</s>", "[\\INST] a", "<\\\\/s> </s>", "[OUT] x </s>[OUT] y </s>", " [/INST][OUT] ",
             "[ROLE] a [/ROLE] b </s>", "[/INST", "<", "\\", "", " ", "\n", "é漢🙂</s>", "[ROLE", "x" * 30000 + "</s>"]
    rows = [(1, 0, "user", "Hi"), (1, 1, "assistant", "Hello"), (2, 0, "system", None), (2, 1, "user", ""), (2, 2, "assistant", None)]
    for k, t in enumerate(nasty):
        rows += [(10 + k, 0, "system", t), (10 + k, 1, "user", t), (10 + k, 2, "assistant", t), (10 + k, 3, "tool [/ROLE] </s>", t)]
    rows += [(5, 1, "user", "b"), (5, 1, "user", "a"), (5, 1, "assistant", "c"), (5, 1, "user", "b"), (6, None, "user", "x"),
             (6, 0, "user", "y"), (7, 0, None, "no role"), (7, 1, "", "empty role")]
    return rows


def brute_turns(rows):
    out = {}
    for c, t, r, x in rows:
        out.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    return {c: [(r, x) for _, r, x in sorted(v)] for c, v in out.items()}


def test_chat_round_trip(spark):
    rows = turns()
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, id int")
    out = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    formatted = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    want = brute_turns(rows)
    assert set(out) == set(want)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, ts in want.items():
        loss = "".join(x for r, x in ts if r == "assistant")
        r = out[c]
        assert r.n_turns == len(ts) and r.turns_sha256 == sha("".join(f"{a}\n{x}\n" for a, x in ts)), c
        assert r.loss_chars == len(loss) and r.loss_sha256 == sha(loss) and r.formatted_chars == len(formatted[c].formatted)
        if formatted[c].escaped:
            assert not re.search(rf"[\[<](?:{chat.CONTROL})", "".join(
                formatted[c].formatted[s.start:s.start + s.length] for s in formatted[c].loss))
    assert not formatted[1].escaped and formatted[10].escaped
    assert formatted[1].formatted == "[INST] Hi [/INST][OUT] Hello </s>"
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_without_conversation(spark):
    df = spark.createDataFrame([(None, 0, "user", "a"), (None, 0, "user", "a"), (3, 0, "user", "b")],
                               "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(df).collect()
    assert sorted((r.conv_id or -1, r.formatted) for r in out) == [(-1, "[INST] a [/INST]"), (-1, "[INST] a [/INST]"),
                                                                   (3, "[INST] b [/INST]")]


def test_chat_equals_sql(spark, tmp_path):
    rows = [r for r in turns() if r[1] is not None]
    pdf = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])
    pdf.to_parquet(tmp_path / "conversations.parquet")
    against_sql(chat.SQL, {"conversations": pdf}, chat.op5_chat(spark, str(tmp_path)).toPandas(), "conv_id")


def test_chat_plan_is_native(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    for d in (chat.digests(chat.format_conversations(df)), quality.base_measures(df.select("conv_id", "text"))):
        plan = d._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# ------------------------------------------------------------------ operator 7
def toxic_rows(n, seed):
    rng = random.Random(seed)
    syllables = [a + b for a in "bcdfglmnprst" for b in ("a", "en", "i", "or", "u")]
    bad = ["grumblex", "zwackel", "vyrmq", "snorkid"]
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(30, 300))]
        y = int(rng.random() < 0.2)
        for _ in range(y * rng.randint(2, 8)):
            words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words), "s"))
        labels.append((i, y))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_rows(900, 4)
    rows += [(5000, None, "s"), (5001, "", "s"), (5002, "benor " * 20000 + "zwackel vyrmq " * 40, "s"), (None, "benor ti", "s"),
             (5003, rows[0][1], "s"), (5003, rows[0][1], "s")]
    docs = frame(spark, rows)
    marks = spark.createDataFrame([*labels, (3, None), (None, 1), (0, labels[0][1])], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    out = toxicity.score(docs, model).toPandas()
    assert len(out) == len(rows) and out.score.between(0, 1).all()
    y = dict(labels)
    held = out[out.doc_id.isin([i for i in y if __import__("zlib").crc32(str(i).encode()) % 3 == 1])]
    truth = held.doc_id.map(y)
    assert held.predicted[truth == 1].mean() > 0.9 and held.predicted[truth == 0].mean() < 0.02
    by = out.set_index("doc_id")
    assert by.predicted[5002] == 1 and by.predicted[5000] == 0 and by.score[5000] == by.score[5001]
    # the held-out labels teach nothing: changing them changes nothing
    other = [(i, 1 - v) if __import__("zlib").crc32(str(i).encode()) % 3 == 1 else (i, v) for i, v in labels]
    again = toxicity.train(docs, spark.createDataFrame(other, "doc_id long, toxic int"))
    assert again[0] == model[0] and np.allclose(again[1], model[1])
    kept = toxicity.without_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.count() == len(rows) - out.predicted.sum()


def test_toxicity_trains_on_long_texts_and_once_an_id(spark, monkeypatch):
    """Labelled documents of over 11,000 characters teach; ids with many texts count once."""
    rng = random.Random(6)
    bad, rows, labels = ["grumblex", "zwackel", "vyrmq", "snorkid"], [], []
    syllables = [a + b for a in "bcdfglmnprst" for b in ("a", "en", "i", "or", "u")]
    for i in range(240):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(2200)]
        y = int(i % 3 == 0)
        for _ in range(80 * y):
            words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words), "s"))
        labels.append((i, y))
    assert min(len(t) for _, t, _ in rows) > 8 * toxicity.PIECE_CHARS
    rows += [(0, f"another text {k}", "s") for k in range(40)]
    seen = {}
    trained = toxicity.train_dictionaries
    monkeypatch.setattr(toxicity, "train_dictionaries", lambda t, o: trained(*seen.setdefault("texts", (t, o))))
    docs = frame(spark, rows)
    out = toxicity.score(docs, toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))).toPandas()
    toxic, ordinary = seen["texts"]
    assert 30 < len(toxic) <= 80 and 60 < len(ordinary) <= 160
    assert all(len(t) <= 8 * (toxicity.PIECE_CHARS + 1) + 2 for t in [*toxic, *ordinary])
    out = out[out.doc_id > 0]
    held, y = out.doc_id.map(lambda i: __import__("zlib").crc32(str(i).encode()) % 3 == 1), out.doc_id.map(dict(labels))
    assert out.predicted[held & (y == 1)].mean() > 0.9 and out.predicted[held & (y == 0)].mean() < 0.05


def test_pieces_of_a_text(spark):
    whole, long = "x y" * 2000, "".join(f"{i:05d}," for i in range(5000))
    rows = spark.createDataFrame([(1, whole), (2, long), (3, ""), (4, None)], "id long, t string")
    got = {r.id: r.p for r in rows.select("id", toxicity._pieces(rows.t, rows.id).alias("p")).collect()}
    assert got[1] == whole and got[3] == got[4] == ""
    parts = got[2].split("\n")
    assert len(parts) == toxicity.PIECES and all(len(p) == toxicity.PIECE_CHARS and p in long for p in parts)
    assert [long.index(p) for p in parts] == sorted(long.index(p) for p in parts)


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(0, 1), (3, 1)]])
def test_toxicity_without_examples(spark, labels):
    docs = frame(spark, [(0, "some text", "s"), (1, None, "s"), (3, "more text", "s")])
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.train(docs, marks)).collect()
    assert len(out) == 3 and all(0 <= r.score <= 1 for r in out)
    assert toxicity.without_toxic(docs.limit(0), marks).count() == 0


# ------------------------------------------------------------------ operator 8
def page_rows():
    long, other = "<p>payload é漢</p>" * 90, "<p>other</p>" * 200
    rows = [(1, "http://a/", long), (7, "http://b/", long), (3, None, long), (4, "http://c/\r\nX: y", "short"), (5, "u", "short"),
            (6, "u", None), (8, "u", ""), (9, "u", other), (10, "u", "x" * 200000), (2, "u", long)]
    return rows + [(100 + i, f"u{i}", f"<html>{i}</html>" * (i + 1)) for i in range(60)]


def test_warc_equals_sql(spark, tmp_path):
    pdf = pd.DataFrame(page_rows(), columns=["page_id", "url", "html"])
    df = spark.createDataFrame([(*r, 1, "x") for r in page_rows()], "page_id long, url string, html string, size int, digest string")
    warc.write_warc(df, f"file://{tmp_path}/w", roll_bytes=4000)
    got = warc.read_warc(spark, f"file://{tmp_path}/w").toPandas()
    against_sql(warc.SQL, {"pages": pdf}, got[["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]], "page_id")
    html = {i: (h or "").encode() for i, _, h in page_rows()}
    assert all(bytes(r.payload) == html[r.page_id] for r in got.itertuples() if r.record_type == "response")
    listed = json.loads((tmp_path / "w" / "manifest.json").read_text())
    assert len(listed) > 4 and not list((tmp_path / "w").glob("*tmp*"))
    assert [x["file"] for x in listed] == sorted(x["file"] for x in listed)
    # the same rows in another order give the same bytes
    warc.write_warc(df.orderBy("html"), f"file://{tmp_path}/v", roll_bytes=4000)
    assert (tmp_path / "v" / "manifest.json").read_text() == (tmp_path / "w" / "manifest.json").read_text()
    for x in listed:
        assert (tmp_path / "v" / x["file"]).read_bytes() == (tmp_path / "w" / x["file"]).read_bytes()


def test_warc_files_are_standard_gzip(spark, tmp_path):
    import gzip

    df = spark.createDataFrame(page_rows()[:3], "page_id long, url string, html string")
    warc.write_warc(df, f"file://{tmp_path}/w")
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("*.warc.gz")))
    assert raw.count(b"WARC/1.1\r\n") == 3 and raw.count(b"WARC-Type: revisit") == 2


def test_warc_odd_rows(spark, tmp_path):
    long = "y" * 2000
    df = spark.createDataFrame([(1, "a", long), (1, "b", long), (1, "b", long), (None, "n", long), (None, "n", "z"), (2, "c", "q" * 1500)],
                               "page_id long, url string, html string")
    warc.write_warc(df, f"file://{tmp_path}/w")
    out = warc.read_warc(spark, f"file://{tmp_path}/w").toPandas()
    assert len(out) == 6
    one = out[(out.page_id == 1)]
    assert sorted(one.record_type) == ["response", "revisit", "revisit"] and set(one.refers_to.dropna()) == {1}
    none = out[out.page_id.isna()].sort_values("payload_bytes")
    assert list(none.record_type) == ["response", "revisit"]
    warc.write_warc(df.limit(0), f"file://{tmp_path}/e")
    assert warc.read_warc(spark, f"file://{tmp_path}/e").count() == 0


# ------------------------------------------------------------------ operator 9
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    def good(kind, s):
        d = re.sub(r"[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1]))
            return 13 <= len(d) <= 19 and total % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if good(k, m.group())]


def test_base_spans_by_brute_force():
    rng = random.Random(6)
    for _ in range(20000):
        t = "".join(rng.choice("ab.@-+ 0123456789()1.2%_,\né") for _ in range(rng.randint(0, 50)))
        assert [(k, s, e) for k, s, e, ok in pii.base_spans(t) if ok] == brute_spans(t), t


def test_personal_data_frame(spark):
    texts = ["Mail jo.doe@mail.example.com or +1 (988) 555-2485 now", "card 4111 1111 1111 1111 and 4111 1111 1111 1112", None, "",
             "host 10.0.0.256 and 10.0.0.25", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "plain words = fine",
             "é漢🙂 a@b.cc", "9" * 30000, "a@" * 5000]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(1, texts[1], "s"), (None, texts[0], "s")]
    docs = frame(spark, rows + [(1000 + i, f"write to u{i}@example.com or call +4930123456{i:02d}", "s") for i in range(40)])
    weights = pii.fit(docs)
    out = pii.find_personal(docs, weights).toPandas()
    assert len(out) == len(rows) + 40
    for r in out[out.doc_id.notna() & (out.doc_id < 10)].itertuples():
        base = brute_spans(texts[int(r.doc_id)] or "")
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in base) for k in PATTERNS]
        assert set(pii.joined(base).split(",")) <= set(r.spans.split(",")) | {""}
    by = out[out.doc_id.notna()].drop_duplicates("doc_id").set_index("doc_id").spans
    assert "secret:" in by[5] and by[6] == "" and "card" not in by[8]
    red = {r.doc_id: r.text for r in pii.redact(docs, weights).collect()}
    assert red[0] == "Mail <EMAIL> or <PHONE> now" and red[2] is None and red[6] == texts[6]
    assert pii.find_personal(docs.limit(0), pii.fit(docs.limit(0))).count() == 0


def test_secrets_are_found_whole():
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("ABCDEFGHabcdefgh0123456789_") for _ in range(n))
    secrets = [word(1000), "Xy9!k2@mail.example.com#Q7z", "aQ7z_4111111111111111_b8x", *(word(40) for _ in range(60))]
    texts = [f'login token = "{s}" end' for s in secrets]
    texts += [f"a line with ratio: {w}" for w in ("nothing", "plain words", "something") for _ in range(20)]
    seen = Counter((k, v) for t in texts for k, _, _, _, v in pii.candidates(t))
    weights = pii.train_classifier([(k, v, float(n)) for (k, v), n in sorted(seen.items())])
    for t, s in zip(texts, secrets):
        found = pii.spans(t, weights)[1]
        at = t.index(s)
        assert ("secret", at, at + len(s)) in found, t
        assert pii.redacted(t, found) == 'login token = "<SECRET>" end'
    # a proposal that an accepted base span holds whole says nothing new
    assert [c[:3] for c in pii.candidates("write to: jo.doe@mail.example.com")] == [("email", 10, 33)]


def test_expectation_maximisation_recovers_reliabilities():
    rng = np.random.default_rng(0)
    truth = rng.random(20000) < 0.4
    right = [0.95, 0.99, 0.8, 0.7, 0.6]
    votes = np.array([np.where(rng.random(len(truth)) < r, np.where(truth, 1, -1), np.where(truth, -1, 1)) for r in right]).T
    seen, at, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    patterns = [("name", tuple(v), float(c)) for v, c in zip(seen.tolist(), n)]
    _, theta, p = pii.reliabilities(patterns)
    assert ((p[at.reshape(-1)] > 0.5) == truth).mean() > 0.95
    assert abs(theta[0, 0, 1, 2] - 0.95) < 0.05 and abs(theta[0, 3, 1, 2] - 0.7) < 0.05
