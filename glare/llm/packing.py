"""Operator 3: cost-balanced packing of token sequences."""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glare.llm.bpe_codec import tokenizer_path
from glare.llm.common import slices, table
from glare.llm.tokens import SpacedWordBPE, encoder

#: estimated cost of attending over a piece of n tokens: LINEAR * n + QUADRATIC * n * n
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: tokens that one packing window holds in memory (1,024 sequences of 4,096)
WINDOW_TOKENS = 1 << 22
#: smallest power-of-two sequence opened for the rest of a window
LEAST_TAIL = 256


def capacities(total: int, capacity: int) -> list[int]:
    """Sequence sizes for ``total`` tokens: full ones, then powers of two for
    the rest, so that only the last and smallest one needs padding."""
    sizes, rest = [capacity] * (total // capacity), total % capacity
    p = 1 << max(capacity.bit_length() - 1, 0)
    while p >= LEAST_TAIL:
        if rest >= p:
            sizes.append(p)
            rest -= p
        p >>= 1
    if rest:
        sizes.append(min(capacity, 1 << (rest - 1).bit_length()))
    return sizes


def pack(lengths: list[int], capacity: int, linear: float = LINEAR,
         quadratic: float = QUADRATIC) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """Pieces (document, start, length, sequence, offset) and sequence sizes.

    Documents at least as long as a sequence give full sequences of their own;
    what remains is taken in descending length (ties in input order), each to
    the cheapest sequence that still has room. Where none has room the piece is
    cut, filling the cheapest open one."""
    pieces, sizes, rest = [], [], []
    for d, n in enumerate(lengths):
        full = n // capacity
        for k in range(full):
            pieces.append((d, k * capacity, capacity, len(sizes), 0))
            sizes.append(capacity)
        if n - full * capacity:
            rest.append((n - full * capacity, d, full * capacity))
    base, open_sizes = len(sizes), capacities(sum(n for n, _, _ in rest), capacity)
    room = np.array(open_sizes, dtype=np.int64)
    cost, used = np.zeros(len(room)), np.zeros(len(room), dtype=np.int64)
    for n, d, start in sorted(rest, key=lambda x: (-x[0], x[1])):
        while n:
            fits = room >= n
            at = int(np.argmin(np.where(fits if fits.any() else room > 0, cost, np.inf)))
            take = min(n, int(room[at]))
            pieces.append((d, start, take, base + at, int(used[at])))
            room[at] -= take
            used[at] += take
            cost[at] += linear * take + quadratic * take * take
            n, start = n - take, start + take
    return pieces, sizes + open_sizes


def pack_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                   end_id: int = 2, capacity: int = 4096, window: int = WINDOW_TOKENS) -> DataFrame:
    """One row per piece: ``id_col``, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, sequence_size (the padded length).

    Documents are packed where they lie, in windows of about ``window`` tokens of
    one partition: no shuffle, bounded memory (a single longer document is a
    window by itself), and a retried task gives the same sequences. Only the
    last sequence of a window is padded. ``sequence_id`` is unique: partition,
    then number within it.

    A null or empty text is the end id alone; null and repeated ids are packed
    like others; an empty table gives no rows; other columns are not read."""
    def flush(ids, docs, first):
        pieces, sizes = pack([len(x) for x in docs], capacity)
        cols = [[], [], [], [], [], [], [], []]
        for d, start, n, seq, offset in pieces:
            crc = zlib.crc32(docs[d][start:start + n].tobytes())
            for c, v in zip(cols, (ids[d], start, n, crc, len(docs[d]), first + seq, offset, sizes[seq])):
                c.append(v)
        return cols, len(sizes)

    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_size"]

    def run(batches):
        enc = encoder(SpacedWordBPE, path)
        end = int(end_id).to_bytes(4, "little")
        first, held, ids, docs, id_type = TaskContext.get().partitionId() << 33, 0, [], [], None

        def out():
            nonlocal first
            cols, n = flush(ids, docs, first)
            first += n
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:])], names)

        for b in batches:
            id_type = b.column(0).type
            for part in slices(b):
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    x = np.frombuffer(enc.encode(t or "") + end, "<u4")
                    ids.append(i)
                    docs.append(x)
                    held += len(x)
                    if held >= window:
                        yield out()
                        held, ids, docs = 0, [], []
        if docs:
            yield out()

    return df.select(id_col, F.col(text_col).alias("__text")).mapInArrow(
        run, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
             "sequence_id long, offset long, sequence_size long")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
