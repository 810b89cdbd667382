"""Operators 6 and 10, union-find and the pipeline against brute force."""
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glare.llm import components, embeddings, minhash, pii, quality, toxicity

DOCS = "doc_id long, text string, rep long, id string, comp int, n int"


def find(up, x):
    while up[x] != x:
        x = up[x]
    return x


def brute_groups(rows):
    """id -> (set size, smallest id reachable) by all pairs of distinct sets."""
    sets, first = {}, {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
        sets.setdefault(i, []).append(s)
        if i is not None and s:
            first[s] = min(i, first.get(s, i))
    up = {i: i for i in sets if i is not None}
    for i, ss in sets.items():
        for s in ss:
            if i is not None and s:
                a, b = find(up, i), find(up, first[s])
                up[max(a, b)] = min(a, b)
    kinds = list(first)
    for k, s in enumerate(kinds):
        for z in kinds[:k]:
            if 100 * len(s & z) >= 75 * len(s | z):
                a, b = find(up, first[s]), find(up, first[z])
                up[max(a, b)] = min(a, b)
    return {i: find(up, i) for i in up}, {i: sorted(map(len, ss)) for i, ss in sets.items()}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return " ".join(words)


def texts(seed, groups, size, edits):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randint(60, 160))]
        rows += [edited(rng, base, rng.randint(0, edits)) for _ in range(size)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0, "x", 0, 0) for i, t in rows], DOCS)


def test_near_duplicates_by_brute_force(spark):
    rows = texts(1, 40, 6, 6)
    # one large group of near copies, many of them linked to few others only
    rows += [(1000 + i, t) for i, t in texts(2, 1, 150, 7)]
    rows += [(2000, None), (2001, ""), (2002, " \n\t"), (2003, "one two"), (2004, "ONE  two\n"), (2005, "one two three four five"),
             (2006, "One\x0btwo three FOUR five"), (2007, "É two"), (2008, "é two"), (2009, "z " * 20000), (2010, "Z " * 20001)]
    rows += [(3000, rows[0][1])] * 3 + [(3001, rows[0][1] + " tail"), (5, rows[0][1])]
    docs = frame(spark, rows)
    want, sizes = brute_groups(rows)
    out = minhash.near_duplicates(docs).toPandas()
    assert len(out) == len(rows)
    for r in out.itertuples():
        assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id), r
        assert r.n_shingles in sizes[r.doc_id]
    kept = minhash.keep_one_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c in want.items() if i == c)


def test_repeated_id_in_a_large_residual_bucket(spark):
    """One id with two texts, of which one has only lone shingles."""
    rng = random.Random(4)
    words = lambda n: [f"w{rng.random()}" for _ in range(n)]
    base, rows = words(100), []
    rows += [(7, " ".join(base)), (7, " ".join(base)), (7, " ".join(words(900))), (8, " ".join(base + ["tail"]))]
    rows += [(100 + i, " ".join(words(rng.randint(60, 140)))) for i in range(40)]
    shingles = sorted({(i, minhash.shingles(t.encode()).tobytes()) for i, t in rows})
    members = spark.createDataFrame([(1, i, len(s) // 8) for i, s in shingles], "key long, rep long, n long")
    sets = spark.createDataFrame([(i, minhash.shingles(t.encode()).tobytes()) for i, t in rows], "id long, s binary")
    groups, links = minhash._remaining_links(members, spark.createDataFrame([], "a long, b long"), sets)
    assert {(r.a, r.b) for r in links.collect()} <= {(7, 8), (8, 7)}
    assert {r.node: r.component for r in groups.collect()} == {7: 7, 8: 7}


@pytest.mark.parametrize("tile", [4, 7, 256])
def test_residual_buckets_by_tiles(spark, monkeypatch, tile):
    """Buckets of near copies of several originals: every link between components
    that share a bucket is found, whatever the tiles, and none else."""
    monkeypatch.setattr(minhash, "TILE_SETS", tile)
    rows = texts(7, 6, 12, 14) + [(500, "z " * 300), (501, "z")]
    sets = {i: minhash.shingles(t.encode()) for i, t in rows}
    rng = random.Random(8)
    held = [(1, i) for i in sets] + [(2, i) for i in sets if i % 2] + [(3, i) for i in sets] + [(k, rng.choice(list(sets))) for k in range(4, 9)]
    members = spark.createDataFrame([(k, i, len(sets[i])) for k, i in set(held)], "key long, rep long, n long")
    table = spark.createDataFrame([(i, s.tobytes()) for i, s in sets.items()], "id long, s binary")
    known = [(a, b) for a in range(20) for b in range(a) if alike(sets[a], sets[b])]
    groups, links = minhash._remaining_links(members, spark.createDataFrame(known, "a long, b long"), table)
    links = {(r.a, r.b) for r in links.collect()}
    assert links > set(known) and all(alike(sets[a], sets[b]) for a, b in links)
    up = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and alike(sets[a], sets[b]):
                x, y = find(up, a), find(up, b)
                up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in groups.collect()}
    assert {i: got.get(i, i) for i in sets} == {i: find(up, i) for i in sets}
    assert len(links - set(known)) < len(sets) * 8


def alike(x, y):
    both = len(np.intersect1d(x, y))
    return 100 * both >= 75 * (len(x) + len(y) - both)


def test_bound_of_a_tile_pair_is_never_too_low():
    rng = np.random.default_rng(3)
    pool = minhash.mix(rng.integers(0, 1 << 62, 9000).astype(np.uint64))
    sets = [np.sort(rng.choice(pool, n, replace=False)) for n in (3, 40, 700, 3000, 6000, 8000)]
    bits, lost = minhash._bits(sets)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            assert len(np.intersect1d(x, y)) <= bits[i] @ bits[j] + min(lost[i], lost[j])


def test_near_duplicates_odd_tables(spark):
    empty = frame(spark, [(1, "a")]).limit(0)
    assert minhash.near_duplicates(empty).count() == 0 and minhash.keep_one_each(empty).count() == 0
    docs = frame(spark, [(None, "same text here"), (None, "same text here"), (4, "same text here"), (2, None)])
    out = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert out == [("2", 0, 2, True), ("4", 1, 4, True), ("None", 1, None, True), ("None", 1, None, True)]
    assert minhash.keep_one_each(docs).count() == 4


def test_super_minhash_by_the_sequential_definition():
    """Element by element, with the permutation kept as an array."""
    m, elements = 16, minhash.mix(np.arange(1, 40, dtype=np.uint64))
    want = [None] * m
    for e in elements:
        e, p = np.array([e]), list(range(m))
        for j in range(m):
            r = minhash.mix(e + np.uint64((2 * j + 1) * minhash._STEP & (1 << 64) - 1))
            draw = int(minhash.mix(r + np.uint64(minhash._STEP))[0]) >> 32
            k = j + (draw * (m - j) >> 32)
            p[j], p[k] = p[k], p[j]
            value = (j << 48) | int(r[0]) >> 16
            if want[p[j]] is None or value < want[p[j]]:
                want[p[j]] = value
    got = minhash.super_minhash(elements, np.zeros(len(elements), np.int64), 1, m)[0]
    assert got.tolist() == want
    few = minhash.super_minhash(elements[:2], np.zeros(2, np.int64), 1, m)[0]
    assert (few < np.iinfo(np.uint64).max).all()  # two elements fill all slots


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for k in range(60):
        pool = minhash.mix(rng.integers(0, 1 << 62, 300).astype(np.uint64))
        a, b = pool[:200], pool[50:250]
        h = minhash.super_minhash(np.concatenate([a, b]), np.repeat([0, 1], 200), 2)
        errors.append((h[0] == h[1]).mean() - 150 / 250)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < np.sqrt(0.6 * 0.4 / 128) * 1.1


@pytest.mark.parametrize("seed,n,m", [(1, 300, 250), (2, 50, 400), (3, 2, 1)])
def test_components(spark, seed, n, m):
    rng = random.Random(seed)
    links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(k, k + 1) for k in range(1000, 1200)]
    links += [(5000, 6000 + k) for k in range(300)]
    up = {x: x for e in links for x in e}
    for a, b in links:
        a, b = find(up, a), find(up, b)
        up[max(a, b)] = min(a, b)
    df = spark.createDataFrame(links, "a long, b long").repartition(7)
    out = {r.node: r.component for r in components.connected_components(df.filter("a <> b")).collect()}
    assert out == {x: find(up, x) for a, b in links if a != b for x in (a, b)}
    assert components.connected_components(df.limit(0)).count() == 0


# ------------------------------------------------------------------ operator 10
def brute_vectors(rows, threshold):
    good = [k for k, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and np.any(v)]
    n, up = [0] * len(rows), list(range(len(rows)))
    scaled = {k: np.array(rows[k][1]) / np.abs(rows[k][1]).max() for k in good}
    unit = {k: v / np.linalg.norm(v) for k, v in scaled.items()}
    for x, a in enumerate(good):
        for b in good[:x]:
            if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                n[a] += 1
                n[b] += 1
                i, j = find(up, a), find(up, b)
                up[max(i, j)] = min(i, j)
    same = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            a, b = find(up, k), find(up, same.setdefault(i, k))
            up[max(a, b)] = min(a, b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(up, k)] = min(i, least.get(find(up, k), i))
    return [(i, n[k], least.get(find(up, k)) if i is not None else None) for k, (i, _) in enumerate(rows)]


def vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 12))
    rows = [(i, (centres[i % 30] + rng.normal(size=12) * 0.12 * (i % 7)).tolist()) for i in range(400)]
    rows += [(500 + k, (centres[0] * (k + 1)).tolist()) for k in range(60)]
    x = centres[1] / np.linalg.norm(centres[1])
    y = np.cross(x[:3], [1, 2, 3]).tolist() + [0.0] * 9
    y = np.array(y) / np.linalg.norm(y)
    edge = [0.95 * x + np.sqrt(1 - 0.95 ** 2) * s * (y - (y @ x) * x) / np.linalg.norm(y - (y @ x) * x) for s in (0.999, 1.001)]
    rows += [(600, edge[0].tolist()), (601, edge[1].tolist()), (602, None), (603, []), (604, [0.0] * 12), (605, [1.0, None] * 6),
             (606, [float("nan")] * 12), (607, [float("inf")] + [0.0] * 11), (608, [1.0, 2.0]), (609, [2.0, 4.0]),
             (None, centres[2].tolist()), (None, centres[2].tolist()), (3, rows[3][1]), (610, (centres[4] * 1e200).tolist()),
             (611, (centres[4] * 1e-200).tolist())]
    return rows


def test_near_vectors_by_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, row int, n int").repartition(3)
    out = embeddings.near_vectors(df, tile=64).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in out), key=key) == sorted(brute_vectors(rows, 0.95), key=key)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in out)
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_error_bound_is_rigorous():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, s, e, n = embeddings.quantised(x)
    near = (q * s[:, None]) @ (q * s[:, None]).T
    assert (np.abs(x @ x.T - near) <= e[:, None] * n[None, :] + e[None, :]).all()


# ------------------------------------------------------------------ pipeline
def test_pipeline_stages(spark):
    from conftest import SF_SMALL

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "near_dedup", "pii", "packing"]
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialize(stage(spark, docs, SF_SMALL), name)
        assert after.columns == columns and [f.dataType for f in after.schema] == [f.dataType for f in docs.schema]
        kept = {r.doc_id for r in after.select("doc_id").collect()}
        assert kept <= ids and (name != "pii" or kept == ids) and len(kept) > 0.5 * len(ids)
        docs, ids = after, kept
    groups, _ = brute_groups([(r.doc_id, None) for r in docs.collect()])
    assert set(groups) == ids
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL).toPandas()
    assert set(packed.doc_id) == ids
    assert (packed.groupby("doc_id").length.sum() == packed.groupby("doc_id").doc_tokens.first()).all()
    # the stages also take an empty table
    none = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF_SMALL).count() == 0


def test_run_is_the_stages(spark):
    from conftest import SF_SMALL

    out = corpus_pipeline.run(spark, SF_SMALL).toPandas()
    assert isinstance(out, pd.DataFrame) and out.length.gt(0).all()


def test_stages_send_small_batches(spark, monkeypatch):
    """Rows of 4 MB in one partition reach the workers of every stage by about 2 MB at once."""
    from glare.llm import common, packing

    def small(batch, most=256):
        assert batch.nbytes < 3 << 20, batch.nbytes
        return common.slices(batch, most)

    for module in (minhash, packing, pii, toxicity):
        monkeypatch.setattr(module, "slices", small)
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.hex(F.xxhash64("id", i))), " ")
    docs = spark.range(0, 1200, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"),
                                             F.lit("s").alias("source"), F.length(text).cast("int").alias("n_chars"))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key, None)
    for _, stage in corpus_pipeline.STAGES[1:]:
        spark.conf.unset(key)
        try:
            assert stage(spark, docs, "/root/testdata/sf0.001").count() >= 1200
        finally:
            spark.conf.unset(key) if held is None else spark.conf.set(key, held)
    spark.conf.set(key, "5m")  # a bound of the session's own stays
    corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert spark.conf.get(key) == "5m"
    spark.conf.unset(key) if held is None else spark.conf.set(key, held)


def plain_pipeline(spark, rows, sf_dir):
    """id -> text after each stage but packing, in plain Python with the operators' own verdicts."""
    import re

    import duckdb

    # quality: the SQL's verdicts; lines of three words above 6 documents go, but for the smallest id
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(i, *r) for i, r in rows.items()], columns=["doc_id", "text", "source"]))
    kept = {i for i, k in con.execute(f"SELECT doc_id, kept FROM ({quality.SQL})").fetchall() if k}
    normal = lambda x: re.sub(r"[\x20\t\x0b-\r]+", " ", x.lower()).strip(" ")
    holders, texts = {}, {}
    for i, (t, h) in rows.items():
        for x in {normal(x) for x in (t or "").split("\n")} - {""}:
            holders.setdefault((h, x), {}).setdefault(t, i)
            holders[h, x][t] = min(i, holders[h, x][t])
    docs = {h: len({t for t, s in rows.values() if s == h and normal((t or "").replace("\n", " "))}) for _, h in rows.values()}
    gone = {k: min(v, key=v.get) for k, v in holders.items()
            if len(v) > 6 and (len(k[1].split(" ")) >= 3 or len(v) * 100 > docs[k[0]] * 5)}
    for i in kept:
        t, h = rows[i]
        lines = t.split("\n")
        stay = [x for x in lines if gone.get((h, normal(x)), t) == t]
        n = sum(len(normal(x).split(" ")) for x in lines if normal(x))
        if 200 * sum(len(normal(x).split(" ")) for x in stay if normal(x)) >= 100 * n:
            texts[i] = "\n".join(stay)
    yield texts
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    scores = toxicity.score(df, toxicity.train(df, spark.read.parquet(f"{sf_dir}/labels.parquet"))).collect()
    texts = {r.doc_id: texts[r.doc_id] for r in scores if not r.predicted}
    yield texts
    groups, _ = brute_groups(list(texts.items()))
    texts = {i: t for i, t in texts.items() if groups[i] == i}
    yield texts
    weights = pii.fit(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    yield {i: pii.redacted(t, pii.spans(t, weights)[1]) for i, t in texts.items()}


def test_pipeline_by_plain_python(spark, tmp_path):
    from conftest import SF_SMALL
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    first = docs.orderBy("doc_id").first()
    rng = random.Random(12)
    notice = "a notice that ten documents hold"
    more = [(10 ** 6 + i, " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(60)) + f"\n{notice}\nmail x{i}@example.com", first.source)
            for i in range(10)]
    more += [(10 ** 6 + 50 + i, more[0][1].split("\n")[0] + f" more{i}", first.source) for i in range(2)]
    extra = spark.createDataFrame(more, "doc_id long, text string, source string")
    extra = extra.select(*(F.lit(first[c]).cast(docs.schema[c].dataType).alias(c) if c not in extra.columns
                           else F.col(c).cast(docs.schema[c].dataType) for c in docs.columns))
    docs.unionByName(extra).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF_SMALL}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    want = None
    for (name, stage), want in zip(corpus_pipeline.STAGES, plain_pipeline(spark, rows, str(tmp_path))):
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), name)
        assert {r.doc_id: r.text for r in docs.collect()} == want, name
    assert "<EMAIL>" in want[10 ** 6 + 1] and notice not in want[10 ** 6 + 1] and 10 ** 6 + 50 not in want
    lib = Tokenizer.from_file(corpus_pipeline.tokenizer_path("word_bpe_49k.json"))
    ids = {i: [*lib.encode(t, add_special_tokens=False).ids, 2] for i, t in want.items()}
    pieces = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        piece = np.array(ids[r.doc_id][r.start:r.start + r.length])
        assert r.doc_tokens == len(ids[r.doc_id]) and len(piece) == r.length
        assert r.ids_crc32 == zlib.crc32(piece.astype("<u4").tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    assert set(pieces) == set(ids)
    for i, found in pieces.items():
        assert [s for s, _ in sorted(found)] == [0, *np.cumsum([n for _, n in sorted(found)])[:-1]]
        assert sum(n for _, n in found) == len(ids[i])
