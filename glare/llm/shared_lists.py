"""Exact top scores by anchor-clustered shared lists (MAXIMUS-style).

A block is a few hundred requests whose vectors point the same way. For unit
vectors u of a block and i of a candidate, with angles at most ``a`` and exactly
``b`` to the block's centre, u.i <= cos(max(0, b - a)). Times the candidate's
length that is one bound for all members of the block: the candidates are sorted
by it once, and every member walks that one list until its k-th best score is
certified, that is, until its length times the list's bound falls below it.

Candidates lie in tiles of vectors that point the same way; the same bound from
centre to centre tells which tiles a block can leave out altogether.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glare.llm.common import materialize

#: candidates of a tile and requests of a block (both by hash, so about)
TILE, BLOCK = 2048, 256
#: blocks that travel together to a tile
TOGETHER = 128
#: candidates taken from a list at a time
STRIP = 256
#: slack of the bound, as a share of the product of lengths: arc cosines are only
#: good to the root of the rounding error
SLACK = 1e-6
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: scores below this are exact in double precision in whatever order they are summed
EXACT = 1 << 53


def pack_vectors(x: np.ndarray) -> bytes:
    """A row of whole numbers: 4 bytes each where that is exact, else 8."""
    return x.astype("<f4" if np.abs(x).max(initial=0) <= 1 << 24 else "<f8").tobytes()


def unpack_vectors(rows: list[bytes], d: int) -> np.ndarray:
    if all(len(r) == 4 * d for r in rows):
        return np.frombuffer(b"".join(rows), "<f4").reshape(-1, d).astype(float)
    return np.array([np.frombuffer(r, "<f4" if len(r) == 4 * d else "<f8") for r in rows], float).reshape(-1, d)


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and lengths (a zero vector has no direction: zeros)."""
    top = np.abs(x).max(axis=1, initial=0)
    scaled = x / np.where(top == 0, 1, top)[:, None]
    length = np.sqrt(np.einsum("ij,ij->i", scaled, scaled))
    return scaled / np.where(length == 0, 1, length)[:, None], length * top


def centre_of(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean direction and the angle of each vector to it."""
    c = directions(unit.sum(axis=0)[None])[0][0]
    return c, np.arccos(np.clip(unit @ c, -1, 1))


def scores(x: np.ndarray, y: np.ndarray, top: float) -> np.ndarray:
    """Integer inner products; ``top`` bounds their size. Beyond 64 bits they are cut off there."""
    if top < EXACT:
        return (x @ y.T).astype(np.int64)
    big = lambda m: np.array([[int(v) for v in r] for r in m], object).reshape(m.shape)
    return np.minimum(np.maximum(big(x) @ big(y).T, LEAST), MOST).astype(np.int64)


@dataclass
class Candidates:
    """Unpacked tile: positions and ids of rows, labels, vectors."""

    rows: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray

    def __post_init__(self):
        self.unit, self.length = directions(self.x)


@dataclass
class Requests:
    """Unpacked block: the k best candidates of (not of) a request's label with
    lo <= score <= hi, other than the request's own row."""

    rows: np.ndarray
    rids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


def walk(block: Requests, tile: Candidates, k: int, same: bool):
    """Per request its first k of the tile by score, then id, as arrays (request,
    candidate, score); and the candidates that were looked at."""
    _, first, member = np.unique(block.rows, return_index=True, return_inverse=True)
    u = block.x[first]
    unit, length = directions(u)
    centre, own = centre_of(unit)
    away = np.arccos(np.clip(tile.unit @ centre, -1, 1)) - own.max()
    bound = tile.length * (np.cos(np.clip(away, 0, np.pi)) + SLACK)
    order = np.argsort(-bound, kind="stable")
    reach, weakest, best = length[member], block.lo.astype(float), np.full((len(member), k), LEAST)
    seen, hits = 0, []
    for at in range(0, len(order), STRIP):
        live = np.flatnonzero(reach * bound[order[at]] >= weakest - 1)
        if not len(live):
            break
        cols = order[at:at + STRIP]
        seen += len(cols)
        who, place = np.unique(member[live], return_inverse=True)
        s = scores(u[who], tile.x[cols], length[who].max() * tile.length[cols].max())[place]
        good = (s >= block.lo[live, None]) & (s <= block.hi[live, None])
        good &= (block.labels[live, None] == tile.labels[cols]) == same
        good &= block.rows[live, None] != tile.rows[cols]
        good &= s >= best[live].min(axis=1)[:, None]
        i, j = np.nonzero(good)
        hits.append((live[i], cols[j], s[i, j]))
        both = np.concatenate([best[live], np.where(good, s, LEAST)], axis=1)
        best[live] = np.partition(both, -k, axis=1)[:, -k:]
        weakest[live] = np.maximum(block.lo[live], best[live].min(axis=1))
    if not hits:
        return np.zeros((3, 0), np.int64), seen
    i, j, s = map(np.concatenate, zip(*hits))
    keep = s >= best.min(axis=1)[i]
    i, j, s = i[keep], j[keep], s[keep]
    order = np.lexsort((tile.ids[j], -s, i))
    i, j, s = i[order], j[order], s[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    return np.stack([i, j, s])[:, rank < k], seen


# ------------------------------------------------------------- packed groups
#: a block's or tile's columns: b is rids or ids
PACKED = "rows binary, b binary, labels binary, lo binary, hi binary, x binary"
META = "centre array<double>, angle double, length double"


def _dealt(rows: DataFrame, key: str, size: int, out: str) -> DataFrame:
    """``rows`` with ``out``: groups of about ``size`` rows of one (d, cluster), dealt
    by hash of ``key`` and numbered without gaps for each d; a hot cluster is many groups."""
    counts = materialize(rows.groupBy("d", "cluster").count(), "cluster-sizes")
    # one row per cluster of vectors of one length: a bounded number
    w = Window.partitionBy("d").orderBy("cluster")
    parts = F.ceil(F.col("count") / size)
    numbers = counts.select("d", "cluster", parts.alias("parts"), (F.sum(parts).over(w) - parts).alias("first"))
    return (rows.join(numbers, ["d", "cluster"])
            .withColumn(out, F.col("first") + F.pmod(F.xxhash64(key), "parts")).drop("parts", "first"))


def _packed(rows: DataFrame, number: str, b: str, what: str) -> DataFrame:
    """One row per (d, ``number``): the group's columns, centre, widest angle, greatest length."""
    def pack(group: pa.Table) -> pa.Table:
        d = group.column("d")[0].as_py()
        x = unpack_vectors(group.column("q").to_pylist(), d)
        unit, length = directions(x)
        centre, angle = centre_of(unit)
        cols = [pa.array([group.column(c).to_numpy().astype("<i8").tobytes()], pa.binary()) for c in ("row", b, "label", "lo", "hi")]
        return pa.table([pa.array([d], pa.int32()), pa.array([group.column(number)[0].as_py()], pa.int64()), *cols,
                         pa.array([pack_vectors(x)], pa.binary()), pa.array([centre.tolist()]), pa.array([angle.max()]),
                         pa.array([length.max()])], names=["d", number, "rows", "b", "labels", "lo", "hi", "x", "centre", "angle", "length"])

    lo, hi = (F.col(c) if c in rows.columns else F.lit(0).cast("long").alias(c) for c in ("lo", "hi"))
    groups = rows.select("d", number, "row", F.col(b), "label", lo, hi, "q").groupBy("d", number)
    return materialize(groups.applyInArrow(pack, f"d int, {number} long, {PACKED}, {META}"), what)


def tiles_of(vectors: DataFrame, size: int = TILE) -> DataFrame:
    """Candidate rows (d, cluster, row, id, label, q) as tiles."""
    return _packed(_dealt(vectors, "row", size, "tile"), "tile", "id", "tiles")


def _pairs(blocks: DataFrame, tiles: DataFrame) -> DataFrame:
    """(d, block, tile, most): the highest score that the block and the tile allow.
    Blocks against all tiles, a few numbers each."""
    n = materialize(tiles.groupBy("d").agg(F.count("*").alias("n")), "tile-counts")
    b = blocks.select("d", "block", F.col("centre").alias("bc"), F.col("angle").alias("ba"), F.col("length").alias("bl"))
    b = b.join(n, "d").withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    dot = F.aggregate(F.zip_with("bc", "centre", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    between = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))
    least = F.greatest(F.lit(0.0), between - F.col("angle") - F.col("ba"))
    cos = F.when(least >= np.pi / 2, 0.0).otherwise(F.cos(least)) + SLACK
    return (b.join(tiles.select("d", "tile", "centre", "angle", "length"), ["d", "tile"])
            .select("d", "block", "tile", (cos * F.col("bl") * F.col("length")).alias("most")))


def _search(blocks: DataFrame, tiles: DataFrame, pairs: DataFrame, k: int, same: bool, what: str) -> DataFrame:
    """(rid, id, row, score, seen): the first k of each request in each paired tile."""
    def search(group: pa.Table) -> pa.Table:
        d = group.column("d")[0].as_py()
        parts = sorted(group.to_pylist(), key=lambda r: r["block"])  # the tile is block -1
        ints = lambda r, *cs: (np.frombuffer(r[c], "<i8") for c in cs)
        matrix = lambda r: unpack_vectors([r["x"]], len(r["rows"]) // 8 * d).reshape(-1, d)
        tile = Candidates(*ints(parts[0], "rows", "b", "labels"), matrix(parts[0]))
        out = []
        for r in parts[1:]:
            rows, rids, labels, lo, hi = ints(r, "rows", "b", "labels", "lo", "hi")
            (i, j, s), _ = walk(Requests(rows, rids, labels, matrix(r), lo, hi), tile, k, same)
            out.append((rids[i], tile.ids[j], tile.rows[j], s))
        return pa.table([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], names=["rid", "id", "row", "score"])

    # blocks that travel to a tile together
    paired = pairs.withColumn("part", F.floor(F.col("block") / TOGETHER))
    cols = ["d", "tile", "part", "block", "rows", "b", "labels", "lo", "hi", "x"]
    asked = paired.join(blocks, ["d", "block"]).select(*cols)
    lists = paired.select("d", "tile", "part").distinct().join(tiles, ["d", "tile"]).withColumn("block", F.lit(-1).cast("long")).select(*cols)
    return materialize(asked.unionByName(lists).groupBy("d", "tile", "part")
                       .applyInArrow(search, "rid long, id long, row long, score long"), what)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k of each request by score, then id, with their rank (a request
    has at most k rows from a tile)."""
    w = Window.partitionBy("rid").orderBy(F.col("score").desc(), "id", "row")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_scores(requests: DataFrame, tiles: DataFrame, k: int, same: bool, block: int = BLOCK) -> DataFrame:
    """(rid, id, row, score, rank): for each request (d, cluster, rid, row, label, lo,
    hi, q) the first ``k`` candidates by score, then id, whose label is (``same``) or
    is not its own, whose score lies in [lo, hi], and which are another row.

    Each block first walks the tile that allows it the highest scores; the k-th
    best found there is then a floor for all others, so that the other tiles
    return about as many rows as end up in the result, and tiles whose bound is
    below the floors of a whole block are not sent to it."""
    requests = _dealt(requests, "row", block, "block")
    asked = _packed(requests, "block", "rid", "blocks")
    pairs = materialize(_pairs(asked, tiles), "pairs")
    home = materialize(pairs.groupBy("d", "block").agg(F.max_by("tile", F.struct("most", "tile")).alias("tile")), "home")
    near = _search(asked, tiles, home, k, same, "near")
    floors = _first(near, k).filter(F.col("rank") == k).select("rid", F.col("score").alias("floor"))
    raised = materialize(requests.join(floors, "rid", "left").withColumn("lo", F.greatest("lo", F.coalesce("floor", "lo"))).drop("floor"), "floors")
    weakest = raised.groupBy("d", "block").agg(F.min("lo").alias("weakest"))
    rest = (pairs.join(home.withColumnRenamed("tile", "home"), ["d", "block"]).join(weakest, ["d", "block"])
            .filter((F.col("tile") != F.col("home")) & (F.col("most") + 1 >= F.col("weakest"))).select("d", "block", "tile"))
    far = _search(_packed(raised, "block", "rid", "raised"), tiles, materialize(rest, "rest"), k, same, "far")
    return _first(near.unionByName(far), k)
