"""Operator 10: embedding near-duplicates by int8 tile products."""
from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from glare.llm.common import materialize, open_fs, shared_path, table
from glare.llm.components import connected_components

THRESHOLD = 0.95
#: most rows of a tile, the piece of a file that is written at once
TILE = 4096
#: most components of all vectors of a group of tiles (or one tile), of which a
#: task holds two; fewer vectors of one length are dealt to about that many groups
GROUP, GROUPS = 1 << 21, 8
#: rows and columns of one product: the block of products stays in the cache
STRIP, COLUMNS = 256, 512
#: components in the first product; what the others can add is bounded
FIRST = 29
#: share of a block's pairs from which it is computed as one product
DENSE = 1 / 64
#: pairs that are settled together
TOGETHER = 1 << 16


def unit(x: np.ndarray) -> np.ndarray:
    """Finite vectors other than zero, in double precision, at length one."""
    x = x.astype(float)
    x /= np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors as int8 times a scale: codes, scales, and per vector the
    norms of the quantisation error and of the quantised vector."""
    scale = np.abs(x).max(axis=1) / 127.0
    q = np.rint(x / scale[:, None]).astype(np.int8)
    near = q * scale[:, None]
    # rounding of these sums themselves is far below the slack
    return q, scale, np.linalg.norm(x - near, axis=1) + 1e-12, np.linalg.norm(near, axis=1) + 1e-12


#: columns of a tile in its file, one after the other: codes, then these, then the vectors as given
SIDE = ("scale", "error", "norm", "row", "node")


def tile_bytes(x: np.ndarray, row: np.ndarray, node: np.ndarray, kind: str) -> bytes:
    q, *side = quantised(unit(x))
    side = [*(c.astype("<f8") for c in side), row.astype("<i8"), node.astype("<i8")]
    return b"".join(c.tobytes() for c in (q, *side, x.astype(kind)))


class Group:
    """Tiles of vectors of one length, read from their files; ``kind`` is the type
    of the vectors as given, which are only read where codes do not decide."""

    def __init__(self, fs, folder: str, d: int, tiles: list[dict], kind: str):
        self.fs, self.d, self.kind, self.whole = fs, d, kind, {}
        self.files = [(f"{folder}/{t['file']}", t["at"], t["n"]) for t in tiles]
        self.ends = np.cumsum([t["n"] for t in tiles])
        parts: list[list[np.ndarray]] = [[] for _ in range(1 + len(SIDE))]
        for path, at, n in self.files:
            with fs.open_input_file(path) as f:
                b = f.read_at(n * (d + 8 * len(SIDE)), at)
            parts[0].append(np.frombuffer(b, np.int8, n * d).reshape(n, d))
            for k, c in enumerate(SIDE):
                parts[k + 1].append(np.frombuffer(b, "<i8" if c in ("row", "node") else "<f8", n, n * (d + 8 * k)))
        self.q, self.scale, self.error, self.norm, self.row, self.node = map(np.concatenate, parts)

    def __len__(self) -> int:
        return len(self.q)

    def vectors(self, at: np.ndarray) -> np.ndarray:
        """Unit vectors of ascending positions."""
        out, size = np.empty((len(at), self.d), self.kind), self.d * int(self.kind[-1])
        places = np.searchsorted(self.ends, at, side="right")
        for k in np.unique(places):
            path, start, n = self.files[k]
            mine = np.flatnonzero(places == k)
            own = at[mine] - (self.ends[k] - n)
            start += n * (self.d + 8 * len(SIDE))
            if k not in self.whole and 16 * len(own) > n:
                with self.fs.open_input_file(path) as f:
                    self.whole[k] = np.frombuffer(f.read_at(n * size, start), self.kind).reshape(n, self.d)
            if k in self.whole:
                out[mine] = self.whole[k][own]
                continue
            with self.fs.open_input_file(path) as f:
                for i, r in zip(mine, own):
                    out[i] = np.frombuffer(f.read_at(size, start + int(r) * size), self.kind)
        return unit(out)


def _first_products(x: Group, y: Group) -> tuple[np.ndarray, np.ndarray]:
    """Matrices whose product is, but for rounding, never below the cosine: the
    components that vary most, the lengths of the rest, and the bound of ``links_of``."""
    some = np.concatenate([g.q[:: max(1, len(g) // 2048)] * g.scale[:: max(1, len(g) // 2048), None] for g in (x, y)])
    first = np.argsort(-some.var(axis=0), kind="stable")[:FIRST]

    def of(g: Group, *bound: np.ndarray) -> np.ndarray:
        part = g.q[:, first] * g.scale[:, None]
        rest = np.sqrt(np.maximum(0, g.norm ** 2 - np.einsum("ij,ij->i", part, part)))
        return np.column_stack([part, rest, *bound]).astype(np.float32)

    return of(x, x.error * y.norm.max(), np.ones(len(x))), of(y, np.ones(len(y)), y.error)


def links_of(x: Group, y: Group, threshold: float = THRESHOLD):
    """Yields (row of x, rows of y) arrays of the pairs with x.y >= threshold; if x
    is y, only pairs i < j count.

    |x.y - x'.y'| <= |x - x'| |y'| + |y - y'| for unit x and quantised x', y', so a
    pair whose int8 product is away from the threshold by more than that is
    decided; all others are computed in double precision. Before, a product of some
    components leaves out pairs that cannot come near: the others add at most the
    product of their lengths there."""
    exact = np.float32 if x.d * 127 * 127 < 1 << 24 else np.float64  # products of codes are exact
    u, v = _first_products(x, y)
    v = [np.ascontiguousarray(v[c:c + COLUMNS].T) for c in range(0, len(y), COLUMNS)]
    bar, made = np.float32(threshold - 1e-5), np.empty(STRIP * COLUMNS, np.float32)
    waiting: list[list] = [[], []]  # pairs whose codes are to be looked at, and pairs that need the vectors

    def taken(k: int, least: int):
        """The waiting pairs, if there are so many."""
        if sum(len(i) for i, _ in waiting[k]) >= least:
            i, j = map(np.concatenate, zip(*waiting[k]))
            waiting[k].clear()
            return [(i[p:p + TOGETHER], j[p:p + TOGETHER]) for p in range(0, len(i), TOGETHER)]
        return []

    def decided(i, j, products):
        """Links by their codes; what these leave open waits."""
        near, error = products * (x.scale[i] * y.scale[j]), x.error[i] * y.norm[j] + y.error[j]
        sure = near - error >= threshold + 1e-9
        open_ = ~sure & (near + error >= threshold - 1e-9)
        if open_.any():
            waiting[1].append((i[open_], j[open_]))
        return i[sure], j[sure]

    def settle(least):
        for i, j in taken(0, least):
            yield decided(i, j, np.concatenate([np.einsum("ij,ij->i", x.q[i[p:p + 4096]].astype(exact), y.q[j[p:p + 4096]].astype(exact))
                                                for p in range(0, len(i), 4096)]).astype(float))
        for i, j in taken(1, least):
            (ui, i_), (uj, j_) = np.unique(i, return_inverse=True), np.unique(j, return_inverse=True)
            a, b = x.vectors(ui), y.vectors(uj)
            if len(i) > DENSE * len(ui) * len(uj):
                cos = (a @ b.T)[i_, j_]
            else:
                cos = np.concatenate([np.einsum("ij,ij->i", a[i_[p:p + 4096]], b[j_[p:p + 4096]]) for p in range(0, len(i), 4096)])
            yield i[cos >= threshold], j[cos >= threshold]

    for k, part in enumerate(v):
        c, w = k * COLUMNS, part.shape[1]
        for at in range(0, min(len(x), c + w) if x is y else len(x), STRIP):
            n = min(STRIP, len(x) - at)
            most = np.matmul(u[at:at + n], part, out=made[:n * w].reshape(n, w))
            if most.max() < bar:
                continue
            i, j = np.nonzero(most >= bar)
            i, j = i + at, j + c
            if x is y:
                keep = i < j
                i, j = i[keep], j[keep]
            if len(i) > DENSE * n * w:
                products = x.q[at:at + n].astype(exact) @ y.q[c:c + w].astype(exact).T
                yield decided(i, j, products[i - at, j - c].astype(float))
            elif len(i):
                waiting[0].append((i, j))
            yield from settle(TOGETHER)
    while waiting[0] or waiting[1]:
        yield from settle(1)


class _Forest:
    """Union-find over positions; ``join`` takes arrays of pairs."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.roots(i), self.roots(j)
            new = a != b
            if not new.any():
                return
            i, j, a, b = i[new], j[new], a[new], b[new]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))

    def roots(self, i: np.ndarray) -> np.ndarray:
        r = self.up[i]
        while (self.up[r] != r).any():
            r = self.up[r]
        self.up[i] = r
        return r


#: vectors without an id are nodes from here on, above all ids
NO_ID = 1 << 62


def _usable(vectors: pa.Array):
    """Yields (positions, matrix) of the vectors of each length that take part."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == d)
        flat = vectors.take(pa.array(at)).flatten()
        whole = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, d).all(axis=1)
        x = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).reshape(-1, d)
        good = whole & np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        if good.any():
            yield at[good], x[good]


def _tiles(rows: DataFrame, tile: int, kind: str, folder: str) -> DataFrame:
    """(row, id, d, file, at, n): a number and the id of each row of (id, v), where file
    is null, and the tiles of at most ``tile`` vectors of one length that were written
    to files of ``folder``, in the order of row. Written; a repeated task has files of its own."""
    def write(batches):
        part, seen, made, at, held, out = TaskContext.get().partitionId() << 33, 0, 0, 0, {}, None
        fs, path = open_fs(folder)
        name = uuid.uuid4().hex

        def flush(d):
            nonlocal made, at, out
            x, row, node = map(np.concatenate, zip(*held.pop(d)))
            if out is None:
                fs.create_dir(path, recursive=True)
                out = fs.open_output_stream(f"{path}/{name}")
            b = tile_bytes(x, row, node, kind)
            out.write(b)
            made, at = made + 1, at + len(b)
            return batch([part + made], [None], [x.shape[1]], [name], [at - len(b)], [len(x)])

        def batch(*columns):
            types = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["row", "id", "d", "file", "at", "n"])

        try:
            for b in batches:
                ids = b.column("id")
                row = part + seen + np.arange(b.num_rows)
                seen += b.num_rows
                none = pa.nulls(b.num_rows)
                yield batch(row, ids, none.cast(pa.int32()), none.cast(pa.string()), none.cast(pa.int64()), none.cast(pa.int32()))
                node = np.where(ids.is_null().to_numpy(zero_copy_only=False), row + NO_ID, pc.fill_null(ids, 0).to_numpy(zero_copy_only=False))
                for places, x in _usable(b.column("v")):
                    d, p = x.shape[1], 0
                    while p < len(x):
                        waiting = held.setdefault(d, [])
                        to = p + tile - sum(len(h[0]) for h in waiting)
                        waiting.append((x[p:to], row[places[p:to]], node[places[p:to]]))
                        if to <= len(x):
                            yield flush(d)
                        p = to
            for d in list(held):
                yield flush(d)
        finally:
            if out is not None:
                out.close()

    return materialize(rows.mapInArrow(write, "row long, id long, d int, file string, at long, n int"), "vectors")


def _pairs_of_groups(tiles: DataFrame, tile: int) -> DataFrame:
    """(d, a, b, left, right): each unordered pair of groups of tiles of one length
    once, with the places of their tiles; no vectors."""
    by = Window.partitionBy("d")
    size = F.expr(f"greatest({tile}, least({GROUP} div d, {tile} * ceil(sum(n) over (partition by d) / {GROUPS * tile})))")
    dealt = tiles.select("d", F.struct("row", "file", "at", "n").alias("t"), F.sum("n").over(by.orderBy("row")).alias("end"), size.alias("size"))
    # tiles are no larger than groups, so that groups are numbered without gaps
    groups = dealt.groupBy("d", F.expr("(end - t.n) div size").alias("a")).agg(F.sort_array(F.collect_list("t")).alias("left"))
    groups = materialize(groups.withColumn("groups", F.count("*").over(by)), "groups-of-tiles")
    # Spark would gather these few bytes in one task
    pairs = groups.agg(F.coalesce(F.sum(F.col("groups") - F.col("a")), F.lit(0))).first()[0]
    other = groups.select("d", F.col("a").alias("b"), F.col("left").alias("right"))
    return (groups.withColumn("b", F.explode(F.sequence("a", F.col("groups") - 1))).join(other, ["d", "b"])
            .select("d", "a", "b", "left", "right").repartition(max(1, min(pairs, 1 << 12))))


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD,
                 tile: int = TILE) -> DataFrame:
    """One row per input row: ``id_col``, n_links, component_id, kept.

    Unit vectors are dealt into tiles of at most ``tile`` rows, written once as int8
    codes and as given to files of the shared folder. A task reads two groups of
    tiles from there, so that nothing but the places of tiles is shuffled, whatever
    the number of groups; it gives only link counts per row and a forest of its
    links, never pairs, so large groups of copies cost no more than others. Work
    grows with the square of the rows (the method compares all tiles); rows and
    memory of a task do not, and disk grows with the rows.

    Null, zero, non-finite or empty vectors, and vectors with a null component,
    link with nothing; vectors of different length do not link. Rows are told
    apart by position, so repeated rows link with each other, and rows that share
    an id share its component; rows with a null id count as partners, and they
    have a null component and are kept. An empty table gives no rows; other
    columns are not read."""
    given = df.schema[vector_col].dataType
    plain = isinstance(given, ArrayType) and isinstance(given.elementType, FloatType | DoubleType)
    kind = "<f4" if plain and isinstance(given.elementType, FloatType) else "<f8"
    vector = F.col(vector_col) if plain else F.transform(vector_col, lambda x: x.cast("double"))
    folder = shared_path(df.sparkSession, "tiles")
    written = _tiles(df.select(F.col(id_col).cast("long").alias("id"), vector.alias("v")), tile, kind, folder)
    rows = written.filter("file is null").select("id", "row").withColumn("node", F.coalesce("id", F.col("row") + NO_ID))

    def compare(batches):
        fs, path = open_fs(folder)
        for r in (r for b in batches for r in b.to_pylist()):
            x = Group(fs, path, r["d"], r["left"], kind)
            y = x if r["a"] == r["b"] else Group(fs, path, r["d"], r["right"], kind)
            row, node = (x.row, x.node) if x is y else (np.concatenate(c) for c in ((x.row, y.row), (x.node, y.node)))
            counts, forest, shift = np.zeros(len(row), np.int64), _Forest(len(row)), 0 if x is y else len(x)
            for i, j in links_of(x, y, threshold):
                counts += np.bincount(i, minlength=len(row)) + np.bincount(j + shift, minlength=len(row))
                forest.join(i, j + shift)
            linked = np.flatnonzero(counts)
            root = forest.roots(linked)
            tree = linked != root
            none = pa.nulls(int(tree.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([pa.array(row[linked]), none]),
                pa.concat_arrays([pa.array(counts[linked]), none]),
                pa.concat_arrays([pa.nulls(len(linked), pa.int64()), pa.array(node[linked[tree]])]),
                pa.concat_arrays([pa.nulls(len(linked), pa.int64()), pa.array(node[root[tree]])])], ["row", "n", "a", "b"])

    pairs = _pairs_of_groups(written.filter("file is not null").drop("id"), tile)
    found = materialize(pairs.mapInArrow(compare, "row long, n long, a long, b long"), "tile-links")
    counts = materialize(found.filter("row is not null").groupBy("row").agg(F.sum("n").alias("n")), "link-counts")
    groups = materialize(connected_components(found.filter("row is null and a <> b")), "groups")
    component = F.when(F.coalesce("component", "node") < NO_ID, F.coalesce("component", "node"))
    return (rows.select("id", "row", "node").join(counts, "row", "left").join(groups, "node", "left")
            .select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
                    F.when(F.col("id").isNotNull(), component).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
