"""Operator 12 against brute force and SQL."""
import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from glare.llm import hard_negatives as H
from glare.llm import shared_lists as L

SCHEMA = "vec_id long, embedding array<float>, label int, id string, row int, q string, cluster int, d string"


def brute(rows, positives=5, negatives=10, low=30, high=90):
    """rows: (id, vector, label) by position; anchors: ids divisible by 10."""
    usable = [(i, [math.floor(256 * float(np.float32(x))) for x in v], l) for i, v, l in rows
              if i is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    clip = lambda x: max(L.LEAST, min(L.MOST, x))
    out = []
    for a, (aid, av, al) in enumerate(usable):
        if aid % 10:
            continue
        s = [(-clip(sum(x * y for x, y in zip(av, v))), i, l) for b, (i, v, l) in enumerate(usable) if b != a and len(v) == len(av)]
        for ps, pid, _ in sorted(x for x in s if x[2] == al)[:positives]:
            good = sorted(x for x in s if x[2] != al and -low * ps <= -100 * x[0] <= -high * ps)
            out += [(aid, pid, r, nid, -ps, -ns) for r, (ns, nid, _) in enumerate(good[:negatives], 1)]
    return Counter(out)


def rows_of(kind):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(5, 12))
    def vec(c, spread=0.6):
        v = centres[c] + spread * rng.normal(size=12)
        return (v / np.linalg.norm(v)).astype(np.float32).tolist()
    rows = [(i, vec(i % 5 if i % 3 else 0), int(rng.integers(0, 4))) for i in range(400)]  # direction 0 holds a third and more
    if kind == "ties":
        same = vec(1)
        rows += [(1000 + i, same, i % 3) for i in range(150)] + [(1000, same, 0), (1000, same, 1), (20, vec(2), 1)]
        rows += [(2000 + i, [float(x) for x in rng.integers(-1, 2, 12)], i % 4) for i in range(80)]
    if kind == "odd":
        rows += [(500, None, 1), (501, [], 1), (510, vec(0), None), (None, vec(1), 1), (520, [float("nan")] + vec(1)[1:], 1),
                 (530, vec(2)[:-1] + [float("inf")], 2), (540, [None] * 12, 1), (550, [0.0] * 12, 1), (551, [0.0] * 12, 2),
                 (560, [1.0, 2.0, 3.0], 1), (561, [1.0, 2.0, 3.5], 1), (562, [2.0, 1.0, 0.5], 2), (570, [5.0], 3),
                 (580, [1e7] * 12, 1), (581, [9e6] * 12, 1), (582, [5e6] * 12, 2), (583, [8e6] + [7e6] * 11, 0),
                 (590, [1e18] * 12, 1), (591, [2e18] * 12, 1), (592, [-1e18] * 12, 0), (-600, vec(3), 2)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, l, "x", 1, "q", 9, "d") for i, v, l in rows], SCHEMA)


@pytest.mark.parametrize("kind", ["plain", "ties", "odd"])
def test_equals_brute_force(spark, kind):
    rows = rows_of(kind)
    got = H.hard_negatives(frame(spark, rows).repartition(3), "id % 10 = 0", clusters=4, tile=40, block=8).collect()
    want = brute(rows)
    assert Counter(map(tuple, got)) == want and len(want) > 500


def test_other_parameters(spark):
    rows = rows_of("plain")
    got = H.hard_negatives(frame(spark, rows), "id % 10 = 0", positives=2, negatives=3, low=50, high=75, clusters=1, sample=1,
                           tile=4096, block=3).collect()
    assert Counter(map(tuple, got)) == brute(rows, 2, 3, 50, 75)


def test_no_rows_and_no_anchors(spark):
    assert H.hard_negatives(frame(spark, []), "id % 10 = 0").collect() == []
    assert H.hard_negatives(frame(spark, [(1, [1.0], 1), (2, [1.0], 1)]), "id % 10 = 0").collect() == []
    # one row: no other
    assert H.hard_negatives(frame(spark, [(10, [1.0], 1)]), "id % 10 = 0").collect() == []


def test_members_stop_when_certified():
    rng = np.random.default_rng(2)
    axis = np.zeros(16)
    axis[0] = 1
    x = np.rint(256 * np.concatenate([axis + 0.05 * rng.normal(size=(600, 16)), -axis + 0.05 * rng.normal(size=(3000, 16))]))
    x = x[rng.permutation(len(x))]
    n = np.arange(len(x))
    tile = L.Candidates(n, n, np.zeros(len(x), int), x)
    u = np.rint(256 * (axis + 0.05 * rng.normal(size=(20, 16))))
    m = len(u)
    block = L.Requests(-1 - np.arange(m), np.arange(m), np.zeros(m, int), u, np.full(m, L.LEAST), np.full(m, L.MOST))
    (i, j, s), seen = L.walk(block, tile, 5, True)
    assert seen < 1000
    full = (u @ x.T).astype(int)
    for r in range(m):
        want = sorted((-v, c) for c, v in enumerate(full[r]))[:5]
        assert [(-b, a) for a, b in zip(j[i == r], s[i == r])] == want


def test_tiles_left_out_hold_nothing(spark):
    """Opposite directions: only pairs whose bound reaches the floor are searched."""
    rng = np.random.default_rng(3)
    rows = [(i, (np.array([1.0 if i % 2 else -1.0, 0, 0]) + 0.01 * rng.normal(size=3)).tolist(), i % 3) for i in range(400)]
    usable = H._usable(frame(spark, rows), "vec_id", "embedding", "label")
    vectors = H.quantised_vectors(usable, H.anchor_centres(usable.filter("id % 10 in (0, 1)"), clusters=2))
    tiles = L.tiles_of(vectors, 50)
    blocks = L._packed(L._dealt(vectors.filter("id % 10 in (0, 1)").withColumns({"rid": F.col("row")}), "row", 8, "block"), "block", "rid", "b")
    pairs = L._pairs(blocks, tiles)
    ahead = pairs.filter("most > 1").count()
    assert tiles.count() >= 8 and 0 < ahead <= 0.6 * pairs.count()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    got = H.op12_hard_negatives(spark, f"/root/testdata/{sf}").collect()
    con = duckdb.connect()
    con.execute(f"create view embeddings as from '/root/testdata/{sf}/embeddings.parquet'")
    rel = con.execute(H.SQL)
    names = [c[0] for c in rel.description]
    want = rel.fetchall()
    assert Counter(tuple(r[n] for n in names) for r in got) == Counter(want) and len(want) > 50
