"""Operator 7: toxicity by compression distance."""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glare.llm.common import materialize, semi, slices, table, worker_store

#: score from which a document is called toxic
THRESHOLD = 0.7
#: most labelled documents per class whose text trains the dictionaries, and of
#: both classes that calibrate the scores; chosen by a hash of the id
TRAIN_DOCS, CALIBRATION_DOCS = 3000, 20000
#: of a training text, at most so many pieces of so many characters are read (the
#: whole text, if it has no more), chosen by a hash: the driver holds at most
#: 2 x 3,000 texts of 6,000 characters
PIECES, PIECE_CHARS = 8, 750
#: bytes of the ordinary dictionary, of one window and of what it shares with the
#: one before, and of a distinctive run
ORDINARY_BYTES, WINDOW, SHARED, RUN = 16_000, 64, 8, (5, 7, 8)
#: letters are written twice and spaces six times: four letters are the least
#: match, a match costs much less than its letters, and word edges count
WIDTH, SPACE_WIDTH, LEAST_MATCH = 2, 6, 7
#: a run trains the toxic dictionary if it is in this many toxic training
#: documents at least and this many times (log) as frequent there
RUN_DOCS, RUN_LIFT, RUNS_PER_DOC = 3, 3.0, 6
FOLDS, HELD_OUT, CALIBRATION_SHARE = 3, 1, 4

_FOLD = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def plain(text: str | None) -> bytes:
    """Lower case; everything below 128 but letters separates words by one space."""
    return b" " + b" ".join((text or "").lower().encode().translate(_FOLD).split()) + b" "


def fold_of(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % FOLDS


def _runs(b: bytes) -> np.ndarray:
    """Distinct runs of each length in RUN as big-endian integers; those with an
    inner space are left out."""
    a = np.frombuffer(b, np.uint8).astype(np.uint64)
    out = [np.empty(0, np.uint64)]
    for size in RUN:
        n = len(a) - size + 1
        if n < 1:
            continue
        g, inner = np.zeros(n, np.uint64), np.zeros(n, bool)
        for k in range(size):
            part = a[k:k + n]
            g = (g << np.uint64(8)) | part
            if 0 < k < size - 1:
                inner |= part == 32
        out.append(np.unique(g[~inner]))
    return np.concatenate(out)


def _text_of(run: int) -> bytes:
    return int(run).to_bytes(8, "big").lstrip(b"\0")


def toxic_content(toxic: list[bytes], ordinary: list[bytes]) -> bytes:
    """The toxic dictionary's own content: runs far more frequent in toxic than
    in ordinary documents, chosen greedily until every toxic document holds
    RUNS_PER_DOC of them or no run is left; the most useful come last, where
    offsets are short. A byte that no text has separates them."""
    if not toxic:
        return b""
    sets = [_runs(b) for b in toxic]
    runs, n1 = np.unique(np.concatenate(sets), return_counts=True)
    others, n0 = np.unique(np.concatenate([_runs(b) for b in ordinary] or [runs[:0]]), return_counts=True)
    at = np.searchsorted(others, runs)
    at[at == len(others)] = 0
    seen = np.where(others[at] == runs, n0[at], 0) if len(others) else np.zeros(len(runs), int)
    lift = np.log((n1 + 0.5) / (len(toxic) + 1)) - np.log((seen + 0.5) / (len(ordinary) + 1))
    good = runs[(n1 >= RUN_DOCS) & (lift > RUN_LIFT)]
    sets = [s[np.isin(s, good)].tolist() for s in sets]
    holders: dict[int, list[int]] = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    gain, need, chosen = {g: len(h) for g, h in holders.items()}, [RUNS_PER_DOC] * len(sets), []
    while gain:
        best = max(gain, key=lambda g: (gain[g], -g))
        if gain.pop(best) < RUN_DOCS:
            break
        chosen.append(_text_of(best))
        for i in holders[best]:
            need[i] -= 1
            if need[i] == 0:
                for g in sets[i]:
                    if g in gain:
                        gain[g] -= 1
    return b"".join(g + b"\x02" for g in reversed(chosen))


def _wide(b: bytes) -> bytes:
    a = np.frombuffer(b, np.uint8)
    return np.repeat(a, np.where(a == 32, SPACE_WIDTH, WIDTH)).tobytes()


def train_dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """Contents of the ordinary and of the toxic dictionary, equally long.

    The ordinary one is trained by zstandard on windows of ordinary text. The
    toxic one has the runs trained on toxic text in front of that same content
    (the ordinary one has unused bytes there): common text then compresses alike
    with both, and a difference of lengths comes from toxic content alone."""
    own = toxic_content(toxic, ordinary)
    windows = [b[i:i + 256] for b in ordinary for i in range(0, len(b), 256)]
    try:
        base = zstandard.train_dictionary(ORDINARY_BYTES, windows).as_bytes()
    except zstandard.ZstdError:  # too little text to train on
        base = b"".join(windows)[:ORDINARY_BYTES]
    front, base = _wide(own), _wide(base)
    return b"\x01" * len(front) + base, front + base


def compressors(contents: tuple[bytes, bytes]):
    store = worker_store("toxicity")
    key = ("toxicity", zlib.crc32(contents[0]), zlib.crc32(contents[1]))
    if key not in store:
        how = zstandard.ZstdCompressionParameters(
            window_log=18, hash_log=17, chain_log=17, search_log=1, min_match=LEAST_MATCH, target_length=1,
            strategy=zstandard.STRATEGY_FAST, write_content_size=0, write_checksum=0, write_dict_id=0)
        made = []
        for c in contents:
            d = zstandard.ZstdCompressionDict(c or b"\x01" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            made.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress)
        store[key] = made
    return store[key]


def measures(text: str | None, contents: tuple[bytes, bytes]) -> tuple[float, ...]:
    """Of the whole text's windows: the largest number of bytes that the toxic
    dictionary saves, and as logarithms of one more the sum of what it saves, the
    windows where it does, and all windows."""
    ordinary, toxic = compressors(contents)
    b = plain(text)
    most = total = n = 0
    for at in range(0, len(b), WINDOW):
        w = _wide(b[max(0, at - SHARED):at + WINDOW])  # windows overlap, so that no run is cut
        saved = len(ordinary(w)) - len(toxic(w))
        if saved > 1:
            most, total, n = max(most, saved), total + saved, n + 1
    return float(most), float(np.log1p(total)), float(np.log1p(n)), float(np.log1p(len(b) / WINDOW))


MEASURES = ("m0", "m1", "m2", "m3")


def calibrate(x: np.ndarray, y: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Logistic weights (intercept first) of the measures, so that a score is
    the share of toxic documents among labelled ones with such measures."""
    x = np.column_stack([np.ones(len(x)), x])
    beta, ridge = np.zeros(x.shape[1]), np.array([1e-3, *[0.1] * (x.shape[1] - 1)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (y - p) - ridge * beta
        hess = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        beta = beta + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return beta


def _measured(docs: DataFrame, contents: tuple[bytes, bytes], keep: list[str], text_col: str) -> DataFrame:
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches):
        for b in batches:
            for part in slices(b):
                m = [measures(t, contents) for t in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(len(keep))), *(pa.array([x[i] for x in m], pa.float64()) for i in range(len(MEASURES)))],
                    [*keep, *MEASURES])

    return docs.select(*keep, text_col).mapInArrow(run, ddl + "".join(f", {m} double" for m in MEASURES))


def _pieces(text: Column, key: Column) -> Column:
    """The text, if it has at most PIECES pieces; else that many of them, chosen
    by a hash of key and place, in order, a line end between any two."""
    text = F.coalesce(text, F.lit(""))
    n = F.ceil(F.length(text) / F.lit(PIECE_CHARS)).cast("int")
    places = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.xxhash64(key, i).alias("h"), i.alias("i")))
    chosen = F.sort_array(F.transform(F.slice(F.sort_array(places), 1, PIECES), lambda p: p["i"]))
    parts = F.transform(chosen, lambda i: F.substr(text, i * PIECE_CHARS + 1, F.lit(PIECE_CHARS)))
    return F.when(n <= PIECES, text).otherwise(F.array_join(parts, "\n"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> tuple[tuple[bytes, bytes], np.ndarray]:
    """Dictionaries and calibration from labelled rows outside the held-out fold.

    One row in CALIBRATION_SHARE (by hash of the id) calibrates, the others train
    the dictionaries. Both are bounded samples, by another hash of the id (see
    TRAIN_DOCS, CALIBRATION_DOCS, PIECES): documents of every length train, long
    ones by some of their pieces. Rows without a label or id teach nothing; a
    repeated label row counts once; an id with several texts teaches by one of
    them; with labels of one class only, every score is that class's share."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    known = known.filter(fold_of(F.col("id")) != HELD_OUT).withColumn("h", F.xxhash64("id"))
    calibrates = F.pmod(F.xxhash64(F.lit("calibration"), "id"), F.lit(CALIBRATION_SHARE)) == 0

    def sample(rows: DataFrame, most: int) -> DataFrame:
        return materialize(rows.orderBy("h", "id").limit(most).select("id", "y"), "labelled")

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    parts = []
    for y in (1, 0):
        ids = sample(known.filter(~calibrates & (F.col("y") == y)), TRAIN_DOCS)
        rows = (semi(texts, ids, "id").select("id", _pieces(F.col("t"), F.col("id")).alias("t"))
                .groupBy("id").agg(F.min_by("t", F.xxhash64("t")).alias("t")).orderBy(F.xxhash64("id"), "id").collect())
        parts.append([plain(r["t"]) for r in rows])
    contents = train_dictionaries(*parts)
    ids = sample(known.filter(calibrates), CALIBRATION_DOCS)
    rows = (_measured(semi(texts, ids, "id"), contents, ["id"], "t")
            .groupBy("id").agg(F.min(F.struct(*MEASURES)).alias("m")).join(ids, "id")
            .select("y", "m.*").orderBy("y", *MEASURES).collect())
    x = np.array([[r[m] for m in MEASURES] for r in rows]).reshape(-1, len(MEASURES))
    y = np.array([r["y"] for r in rows], dtype=int)
    return contents, calibrate(x, y)


def score(docs: DataFrame, model: tuple[tuple[bytes, bytes], np.ndarray], id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, score (0 to 1), predicted (0 or 1).

    Only the text counts; the whole text does. Null and empty texts get the score
    of a text without toxic content; null and repeated ids are carried along."""
    contents, beta = model
    m = _measured(docs, contents, [id_col], text_col)
    z = F.lit(float(beta[0]))
    for name, b in zip(MEASURES, beta[1:]):
        z = z + float(b) * F.col(name)
    p = 1 / (1 + F.exp(-z))
    return m.select(id_col, p.alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all columns, less the rows predicted toxic. Null and empty
    texts stay unless ``score`` calls them toxic; null and repeated ids are judged
    each by its own text; an empty table gives no rows."""
    contents, beta = train(docs, labels, id_col, text_col)
    at, w = docs.columns.index(text_col), beta.tolist()

    def run(batches):
        for b in batches:
            for part in slices(b):
                keep = []
                for t in part.column(at).to_pylist():
                    z = w[0] + sum(a * m for a, m in zip(w[1:], measures(t, contents)))
                    keep.append(1 / (1 + np.exp(-z)) < THRESHOLD)
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold_of(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", "predicted")
