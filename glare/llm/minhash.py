"""Operator 6: near-duplicate groups by SuperMinHash."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glare.llm.common import anti, bounded, materialize, semi, slices, table, worker_store
from glare.llm.components import connected_components

SHINGLE_WORDS = 5
#: signature slots; 32 bands of 4 miss a pair at similarity 0.75 with probability 5e-6
SLOTS, BANDS = 128, 32
#: similarity threshold as a fraction
NUM, DEN = 75, 100
#: most distinct words cached by a worker
CACHE_WORDS = 250_000
#: a tile of a residual bucket has about this many sets and shingles
TILE_SETS, TILE_SHINGLES = 256, 400_000
#: bits of the map that bounds what two sets share, drawn for more pairs than these
SKETCH_BITS, DIRECT_PAIRS = 4096, 64

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: bytes | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a UTF-8 text: A-Z
    lower-cased, words between ASCII white space; fewer than ``width`` words are
    one shingle, none give an empty set."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    cache = bounded(worker_store("words").setdefault("words", _Words()), CACHE_WORDS)
    w = mix(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)))
    n = max(1, len(w) - width + 1)
    h = np.full(n, min(len(w), width), np.uint64)
    for k in range(min(len(w), width)):
        h = h * np.uint64(_STEP) + w[k:k + n]
    return np.unique(mix(h))


def super_minhash(elements: np.ndarray, docs: np.ndarray, n_docs: int, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures of many sets at once, as (n_docs, slots).

    In step j every element draws one fraction and the j-th entry of its own
    random permutation of the slots (Fisher-Yates, one swap per step), and the
    slot keeps the least ``j + fraction``. The steps run over all sets together;
    a set leaves as soon as its largest slot is below the next j (early
    stopping: nothing later could be smaller). Fractions have 48 bits, below j."""
    h = np.full((n_docs, slots), np.iinfo(np.uint64).max, dtype=np.uint64)
    flat, swaps, j = h.reshape(-1), [], 0
    while j < slots and len(elements):
        r = mix(elements + np.uint64((2 * j + 1) * _STEP & (1 << 64) - 1))
        draw = mix(r + np.uint64(_STEP)) >> np.uint64(32)
        at = (np.uint64(j) + (draw * np.uint64(slots - j) >> np.uint64(32))).astype(np.int16)
        swaps.append(at)
        for i in range(j - 1, -1, -1):  # which slot the earlier swaps left at this place
            at = np.where(swaps[i] == at, np.int16(i), at)
        np.minimum.at(flat, docs * slots + at, np.uint64(j << 48) | (r >> np.uint64(16)))
        j += 1
        go = (h.max(axis=1) >= np.uint64(j << 48))[docs]
        if not go.all():
            elements, docs, swaps = elements[go], docs[go], [s[go] for s in swaps]
    return h


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key per set and band; keys of different bands do not meet."""
    rows = sig.shape[1] // bands
    parts = sig.reshape(len(sig), bands, rows)
    k = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(sig), bands))
    for r in range(rows):
        k = mix(k * np.uint64(_STEP) + parts[:, :, r])
    return k.view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, digest, keys): set size, 128-bit digest of the set and its band
    keys; digest and keys are null for empty sets."""
    def run(batches):
        for b in batches:
            for part in slices(b):
                sets = [shingles(t) for t in part.column(1).to_pylist()]
                sizes = np.array([len(s) for s in sets], np.int64)
                keys = band_keys(super_minhash(np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), len(sets)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes),
                     pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                     pa.array([k.tolist() if n else None for k, n in zip(keys, sizes)], pa.list_(pa.int64()))],
                    ["id", "n", "digest", "keys"])

    return (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
            .mapInArrow(run, "id long, n long, digest binary, keys array<long>"))


def shingle_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, s): the sorted set of each document as bytes."""
    def run(batches):
        for b in batches:
            for part in slices(b):
                sets = [shingles(t).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["id", "s"])

    return (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
            .mapInArrow(run, "id long, s binary"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) whose full sets have ``DEN * intersection >= NUM * union``."""
    def run(batches):
        for b in batches:
            for part in slices(b):
                keep = []
                for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(DEN * both >= NUM * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("id").alias("a"), F.col("s").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("s").alias("y"))
    both = pairs.select("a", "b").distinct().join(left, "a").join(right, "b")
    return materialize(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")


def _alike(n: str, m: str):
    """Sizes that allow the similarity at all."""
    return F.least(F.col(n), F.col(m)) * DEN >= F.greatest(F.col(n), F.col(m)) * NUM


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col`` (as long), n_shingles, component_id, kept.

    Equal sets are one class from the start. Classes whose signatures agree in
    a band form a bucket. Within a bucket every class is compared on the full
    sets with one centre (a star, never all pairs); the links found are grouped
    by union-find. Only buckets that then still hold several components are
    looked at again, once: they are dealt to tiles, and each pair of tiles is
    settled in one task by an exact bound on what two sets share and, where that
    allows a link, on the full sets.

    Null or empty texts, and texts without words, have an empty set and link
    with nothing. Rows with a null id are reported with a null component and
    kept. Rows that repeat an id share its component (their links count for it),
    and all of them are kept or not together. An empty table gives no rows; only
    the two columns are read."""
    sig = materialize(signatures(docs, id_col, text_col), "signatures")
    classes = materialize(sig.filter("id is not null and digest is not null").groupBy("digest")
                          .agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys")),
                          "classes")
    rows = classes.select("rep", "n", F.explode("keys").alias("key"))
    buckets = materialize(rows.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("c"), F.count("*").alias("k"))
                          .filter("k > 1").select("key", F.col("c.rep").alias("centre"), F.col("c.n").alias("m")),
                          "buckets")
    found = materialize(rows.join(buckets, "key"), "members")
    members = found.select("key", "rep", "n")
    ids = materialize(members.select(F.col("rep").alias("id")).distinct(), "candidates")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    sets = materialize(shingle_sets(semi(texts, ids, "id"), "id", "t"), "sets")
    links = verified(found.filter(_alike("n", "m") & (F.col("rep") != F.col("centre")))
                     .select(F.col("centre").alias("a"), F.col("rep").alias("b")), sets)
    # an id that stands for several sets joins their classes
    several = materialize(sig.filter("id is not null").groupBy("id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi"))
                          .filter("lo <> hi").select("id"), "several")
    if not several.isEmpty():
        links = links.unionByName(materialize(
            sig.join(several, "id").join(classes.select("digest", "rep"), "digest").filter("id <> rep")
            .select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct(), "links"))
    groups, links = _remaining_links(members, links, sets)
    return (sig.join(classes.select("digest", "rep"), "digest", "left").withColumn("node", F.coalesce("rep", "id"))
            .join(groups, "node", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.when(F.col("id").isNotNull(), F.coalesce("component", "node")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))))


def _split_buckets(members: DataFrame, groups: DataFrame) -> DataFrame:
    """(key, rep, comp, large, tb, tr): the members of the buckets that hold
    several components; whether they are in the bucket's largest component; and
    how many tiles that component and all others take.

    Buckets with the same members (by two 64-bit sums) are taken once."""
    m = materialize(members.join(groups.withColumnRenamed("node", "rep"), "rep", "left")
                    .select("key", "rep", "n", F.coalesce("component", "rep").alias("comp")), "grouped")
    mark = [F.xxhash64(F.lit(k), "rep", "n").cast("decimal(20,0)") for k in (1, 2)]
    parts = (m.groupBy("key", "comp").agg(F.count("*").alias("k"), F.sum("n").alias("w"),
                                          *(F.sum(x).alias(f"x{i}") for i, x in enumerate(mark)))
             .groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum("k").alias("k"), F.sum("w").alias("w"),
                                 F.max(F.struct("k", "w", "comp")).alias("big"), F.sum("x0").alias("x0"), F.sum("x1").alias("x1"))
             .filter("lo <> hi"))

    def tiles(k, w):
        return F.greatest(F.ceil(k / F.lit(TILE_SETS)), F.ceil(w / F.lit(TILE_SHINGLES))).cast("int")

    split = materialize(
        parts.select("key", "k", "x0", "x1", F.col("big.comp").alias("most"), tiles(F.col("big.k"), F.col("big.w")).alias("tb"),
                     tiles(F.col("k") - F.col("big.k"), F.col("w") - F.col("big.w")).alias("tr"))
        .groupBy("k", "x0", "x1").agg(F.min(F.struct("key", "most", "tb", "tr")).alias("b")).select("b.*"), "split")
    return materialize(m.join(split, "key").select("key", "rep", "comp", (F.col("comp") == F.col("most")).alias("large"), "tb", "tr"),
                       "residual")


def _bits(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A bitmap of each set (as 0.0 and 1.0) and how many of its shingles share
    a bit with another one."""
    bits = np.zeros((len(sets), SKETCH_BITS), np.float32)
    for k, s in enumerate(sets):
        bits[k, (s >> np.uint64(40)) % np.uint64(SKETCH_BITS)] = 1
    return bits, np.array([len(s) for s in sets]) - bits.sum(axis=1)


def tile_links(reps: list[int], comps: list[int], left: list[bool], right: list[bool],
               sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join all components of a tile pair which its sets link.

    Compared are sets of ``left`` with sets of ``right`` in different
    components. What two sets share is at most the bits that their bitmaps share
    plus the lesser number of shingles without a bit of their own, so most pairs
    need no look at the sets; the others are settled on the full sets, unless
    links found before have joined their components already."""
    n = np.array([len(s) for s in sets])
    comp, x, y = np.array(comps), np.flatnonzero(left), np.flatnonzero(right)
    may = ((comp[x][:, None] != comp[y][None, :])
           & (np.minimum.outer(n[x], n[y]) * DEN >= np.maximum.outer(n[x], n[y]) * NUM))
    if may.sum() > DIRECT_PAIRS:
        bits, lost = _bits(sets)
        most = bits[x] @ bits[y].T + np.minimum.outer(lost[x], lost[y])
        may &= np.add.outer(n[x], n[y]) * NUM <= most * (NUM + DEN)
    up: dict[int, int] = {}

    def find(c):
        while (d := up.get(c, c)) != c:
            up[c] = c = up.get(d, d)
        return c

    found = []
    for i, j in zip(*np.nonzero(may)):
        i, j = x[i], y[j]
        a, b = find(comps[i]), find(comps[j])
        if a == b:
            continue
        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if DEN * both >= NUM * (n[i] + n[j] - both):
            up[a] = b
            found.append((reps[i], reps[j]))
    return found


def _residual_links(residual: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links that join what is alike in each bucket of ``residual``.

    A bucket's largest component and its other members are dealt to tiles of
    about TILE_SETS sets and TILE_SHINGLES shingles by a hash of the id. Each
    pair of tiles is one group of the shuffle, except two tiles of the largest
    component, which have nothing to join. A group's sets are in memory, at most
    a forest of its components leaves it."""
    def tile(n):
        return F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")

    at = F.when(F.col("large"), F.col("tr") + tile("tb")).otherwise(tile("tr"))
    to = F.sequence(F.lit(0), F.when(F.col("large"), F.col("tr")).otherwise(F.col("tr") + F.col("tb")) - 1)
    rows = (residual.distinct().join(sets.withColumnRenamed("id", "rep"), "rep")
            .select("key", "rep", "comp", "s", at.alias("at"), to.alias("to"))
            .select("key", "rep", "comp", "s", "at", F.explode("to").alias("to"))
            .select("key", F.least("at", "to").alias("i"), F.greatest("at", "to").alias("j"), "at", "rep", "comp", "s")
            .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"))

    def settled(key, group):
        _, i, j = key
        at, reps, comps, sets = zip(*group)
        links = tile_links(reps, comps, [a == i for a in at], [a == j for a in at], sets)
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()),
                                           pa.array([b for _, b in links], pa.int64())], ["a", "b"])

    def run(batches):
        last, group = None, []
        for b in batches:
            for part in slices(b):
                for key, i, j, at, rep, comp, s in zip(*(c.to_pylist() for c in part.columns)):
                    if (key, i, j) != last:
                        if group:
                            yield settled(last, group)
                        last, group = (key, i, j), []
                    group.append((at, rep, comp, np.frombuffer(s, np.uint64)))
        if group:
            yield settled(last, group)

    return materialize(rows.mapInArrow(run, "a long, b long"), "links")


def _remaining_links(members: DataFrame, links: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components after every pair that shares a bucket has been settled."""
    groups = materialize(connected_components(links), "groups")
    residual = _split_buckets(members, groups)
    if residual.isEmpty():
        return groups, links
    links = links.unionByName(_residual_links(residual, sets))
    return materialize(connected_components(links), "groups"), links


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near duplicates, with all its columns: that of
    the smallest id. Of rows that repeat an id, that with the least text stays;
    rows with a null id all stay."""
    gone = materialize(near_duplicates(docs, id_col, text_col).filter("not kept").select(id_col).distinct(), "copies")
    kept = anti(docs, gone, id_col)
    again = materialize(kept.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1")
                        .select(id_col), "repeated")
    if again.isEmpty():
        return kept
    one = (semi(kept, again, id_col).groupBy(F.col(id_col).alias("__id"))
           .agg(F.min_by(F.struct(*kept.columns), F.coalesce(text_col, F.lit(""))).alias("__row")))
    return anti(kept, again, id_col).unionByName(one.select("__row.*"))
