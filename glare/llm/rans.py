"""Operator 4: token ids in a static range asymmetric numeral system."""
from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glare.llm.bpe_codec import tokenizer_path
from glare.llm.common import materialize, open_fs, shared_path, slices, slices_of_bytes, table
from glare.llm.tokens import ForcedBoundaryBPE, encoder

PROB_BITS = 20
#: interleaved states of a block, and tokens of a block
LANES, BLOCK_TOKENS = 1024, 1 << 18
#: states stay in [2**32, 2**64); 32 bits are moved out at a time
LOW = np.uint64(1 << 32)
MAGIC, TABLE_MAGIC = b"GRANS001", b"GRTAB001"
BLOCK = "<IIIIII"  # tokens, lanes, words, crc of tokens, crc of payload, crc of table


def normalise(counts: np.ndarray, bits: int = PROB_BITS) -> np.ndarray:
    """Frequencies that sum to ``2**bits``, at least 1 for each symbol seen and
    below ``2**bits`` for each (a second symbol gets 1 if there is only one)."""
    counts = np.asarray(counts, dtype=np.float64)
    if (counts > 0).sum() < 2:
        counts = np.resize(counts, max(2, len(counts))) if len(counts) < 2 else counts.copy()
        counts[:2] = np.maximum(counts[:2], 1e-9)
    seen, total = counts > 0, 1 << bits
    if seen.sum() > total // 2:
        raise ValueError(f"{int(seen.sum())} symbols need more than {bits} bits")
    f = np.where(seen, np.maximum(1, np.floor(counts * (total - seen.sum()) / counts.sum())), 0).astype(np.int64)
    top = int(np.argmax(f))
    f[top] += total - f.sum()
    return f


def encode_block(tokens: np.ndarray, freq: np.ndarray, start: np.ndarray, pad: int, lanes: int = LANES):
    """States and 32-bit words of one block; step s holds tokens [s*lanes, (s+1)*lanes)."""
    steps = -(-len(tokens) // lanes)
    grid = np.full(steps * lanes, pad, dtype=np.int64)
    grid[:len(tokens)] = tokens
    f, c = freq[grid].reshape(steps, lanes), start[grid].reshape(steps, lanes)
    x, words = np.full(lanes, LOW, dtype=np.uint64), []
    for s in range(steps - 1, -1, -1):
        full = x >= (f[s] << np.uint64(64 - PROB_BITS))
        words.append(x[full].astype(np.uint32))
        x = np.where(full, x >> np.uint64(32), x)
        q = x // f[s]
        x = (q << np.uint64(PROB_BITS)) + (x - q * f[s]) + c[s]
    return x, np.concatenate(words[::-1]) if words else np.empty(0, np.uint32)


def decode_block(n: int, x: np.ndarray, words: np.ndarray, freq, start, slots) -> np.ndarray:
    lanes = len(x)
    steps, at = -(-n // lanes), 0
    out, mask, x = np.empty((steps, lanes), dtype=np.uint32), np.uint64((1 << PROB_BITS) - 1), x.copy()
    for s in range(steps):
        slot = x & mask
        sym = slots[slot]
        out[s] = sym
        x = freq[sym] * (x >> np.uint64(PROB_BITS)) + slot - start[sym]
        low = np.flatnonzero(x < LOW)
        if len(low):
            x[low] = (x[low] << np.uint64(32)) | words[at:at + len(low)]
            at += len(low)
    if at != len(words) or (x != LOW).any():
        raise ValueError("block does not end in its initial states")
    return out.reshape(-1)[:n]


class Table:
    """Shared frequency table: one for all files of an archive."""

    def __init__(self, freq: np.ndarray):
        self.raw = np.asarray(freq, dtype="<u4").tobytes()
        self.crc = zlib.crc32(self.raw)
        self.freq = np.asarray(freq, dtype=np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.pad = int(np.argmax(self.freq))

    def slots(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))

    def to_bytes(self) -> bytes:
        return TABLE_MAGIC + struct.pack("<III", PROB_BITS, len(self.freq), self.crc) + self.raw

    @classmethod
    def from_bytes(cls, b: bytes) -> "Table":
        bits, n, crc = struct.unpack_from("<III", b, 8)
        if b[:8] != TABLE_MAGIC or bits != PROB_BITS or zlib.crc32(b[20:20 + 4 * n]) != crc:
            raise ValueError("broken frequency table")
        return cls(np.frombuffer(b, "<u4", n, 20))


def write_bytes(uri: str, chunks) -> None:
    """Under a temporary name of this attempt, then renamed: a killed or
    repeated task leaves either the whole file or none."""
    fs, path = open_fs(uri)
    ctx = TaskContext.get()
    part = f"{path}.tmp-{ctx.taskAttemptId() if ctx else 0}"
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(part) as f:
        for c in chunks:
            f.write(c)
    fs.move(part, path)


def read_bytes(uri: str) -> bytes:
    fs, path = open_fs(uri)
    with fs.open_input_stream(path) as f:
        return f.read()


class SegmentWriter:
    """Documents of one run, in order: blocks, then the document index and the
    checkpoints (offset, first token and first document of every block)."""

    def __init__(self, tab: Table):
        self.tab, self.chunks, self.size, self.checks = tab, [MAGIC], len(MAGIC), []
        self.docs, self.held, self.n_held, self.done = [], [], 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK_TOKENS:
            self._blocks(BLOCK_TOKENS)

    def _blocks(self, size: int) -> None:
        all_ids = np.concatenate(self.held)
        at = 0
        while len(all_ids) - at >= size or (size < BLOCK_TOKENS and at < len(all_ids)):
            part = all_ids[at:at + BLOCK_TOKENS]
            lanes = min(LANES, max(1, len(part) // 64))
            x, words = encode_block(part, self.tab.freq, self.tab.start, self.tab.pad, lanes)
            body = x.astype("<u8").tobytes() + words.astype("<u4").tobytes()
            head = struct.pack(BLOCK, len(part), lanes, len(words), zlib.crc32(part.astype("<u4").tobytes()),
                              zlib.crc32(body), self.tab.crc)
            self.checks.append((self.size, self.done))
            self.chunks += [head, body]
            self.size += len(head) + len(body)
            self.done += len(part)
            at += len(part)
        self.held, self.n_held = [all_ids[at:]], len(all_ids) - at

    def close(self) -> tuple[list[bytes], dict]:
        if self.n_held:
            self._blocks(1)
        index = np.array([(0 if d is None else d, n, d is not None) for d, n in self.docs], dtype="<i8").tobytes()
        checks = np.array(self.checks, dtype="<i8").tobytes()
        tail = struct.pack("<QQQI", self.size, len(self.docs), len(self.checks), zlib.crc32(index + checks))
        return [*self.chunks, index, checks, tail], {"n_docs": len(self.docs), "n_tokens": self.done}


def read_segment(b: bytes, tab: Table, slots: np.ndarray):
    """Documents (id, ids) of a file; every block is checked against its sums.
    Blocks are independent: any of them can be read alone from its checkpoint."""
    at, n_docs, n_checks, crc = struct.unpack("<QQQI", b[-28:])
    meta = b[at:-28]
    if b[:8] != MAGIC or zlib.crc32(meta) != crc:
        raise ValueError("broken index")
    docs = np.frombuffer(meta, "<i8", 3 * n_docs).reshape(-1, 3)
    checks = np.frombuffer(meta, "<i8", 2 * n_checks, 24 * n_docs).reshape(-1, 2)
    blocks, rest = (read_block(b, int(o), tab, slots) for o, _ in checks), np.empty(0, np.uint32)
    for doc_id, n, known in docs.tolist():
        while len(rest) < n:
            rest = np.concatenate([rest, next(blocks)])
        yield (doc_id if known else None), rest[:n]
        rest = rest[n:]


def read_block(b: bytes, at: int, tab: Table, slots: np.ndarray) -> np.ndarray:
    n, lanes, n_words, crc, body_crc, table_crc = struct.unpack_from(BLOCK, b, at)
    body = b[at + struct.calcsize(BLOCK):at + struct.calcsize(BLOCK) + 8 * lanes + 4 * n_words]
    if table_crc != tab.crc or zlib.crc32(body) != body_crc:
        raise ValueError("broken block")
    x = np.frombuffer(body, "<u8", lanes)
    ids = decode_block(n, x, np.frombuffer(body, "<u4", n_words, 8 * lanes), tab.freq, tab.start, slots)
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("wrong ids")
    return ids


def write_archive(df: DataFrame, path: str, out: str, id_col: str = "doc_id", text_col: str = "text",
                  end_id: int = 2) -> DataFrame:
    """Write the ids of all rows in ascending id order below ``out``; returns the
    manifest: file, base (ids before it), n_docs, n_tokens, in order.

    Range-partitions the texts by id (equal ids may share a file; null ids come
    first), tokenizes once into a shared table, counts all symbols, and encodes
    the runs of that table with one shared frequency table. Null or empty text:
    the end id alone. An empty table gives an archive without files."""
    spark = df.sparkSession
    rows = (df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
            .repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
            .sortWithinPartitions("doc_id", "text"))

    def tokenize(batches):
        enc, shard, pos = encoder(ForcedBoundaryBPE, path), TaskContext.get().partitionId(), 0
        width = "<u2" if max(len(enc.bytes_of), end_id + 1) <= 1 << 16 else "<u4"
        end = np.array([end_id], "<u4")
        for b in batches:
            for part in slices_of_bytes(b, 1):
                ids = [np.concatenate([x, end]).astype(width).tobytes() for x in enc.encode_many(part.column(1))]
                n = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * n, pa.int32()), pa.array(range(pos, pos + n), pa.int64()), part.column(0),
                     pa.array([int(width[2])] * n, pa.int32()), pa.array(ids, pa.binary())],
                    ["shard", "pos", "doc_id", "width", "ids"])
                pos += n

    ids = materialize(rows.mapInArrow(tokenize, "shard int, pos long, doc_id long, width int, ids binary"), "token-ids")

    def count(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            for part in slices(b):
                # all ids of the slice at once: one width per table
                got = np.bincount(np.frombuffer(b"".join(part.column(1).to_pylist()), f"<u{part.column(0)[0].as_py()}"))
                if len(got) > len(total):
                    total = np.concatenate([total, np.zeros(len(got) - len(total), np.int64)])
                total[:len(got)] += got
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    # one row per vocabulary entry at most
    counts = ids.select("width", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    totals = np.zeros(max([1, *(r["id"] for r in counts)]) + 1)
    for r in counts:
        totals[r["id"]] = r["n"]
    tab = Table(normalise(totals))
    write_bytes(f"{out}/table.bin", [tab.to_bytes()])
    raw = tab.to_bytes()

    def encode(batches):
        tab, writer, key, last = Table.from_bytes(raw), None, None, None

        def close():
            chunks, about = writer.close()
            name = f"ids-{key[0]:06d}-{key[1]:012d}.rans"
            write_bytes(f"{out}/{name}", chunks)
            return pa.RecordBatch.from_pylist([{"shard": key[0], "pos": key[1], "file": name, **about}], schema)

        for b in batches:
            for shard, pos, doc_id, w, x in (r for part in slices(b) for r in zip(*(c.to_pylist() for c in part.columns))):
                if writer is None or last != (shard, pos - 1):
                    if writer:
                        yield close()
                    writer, key = SegmentWriter(tab), (shard, pos)
                writer.add(doc_id, np.frombuffer(x, f"<u{w}"))
                last = (shard, pos)
        if writer:
            yield close()

    schema = pa.schema([("shard", pa.int32()), ("pos", pa.int64()), ("file", pa.string()),
                        ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
    # one row per file; also the commit record of the archive
    files = materialize(ids.mapInArrow(encode, "shard int, pos long, file string, n_docs long, n_tokens long"),
                        "token-files").collect()
    base, manifest = 0, []
    for r in sorted(files, key=lambda r: (r["shard"], r["pos"])):
        manifest.append((r["file"], base, r["n_docs"], r["n_tokens"]))
        base += r["n_tokens"]
    write_bytes(f"{out}/manifest.json", [json.dumps({"files": manifest, "tokens": base}).encode()])
    return read_manifest(spark, out)


def read_manifest(spark: SparkSession, out: str) -> DataFrame:
    files = json.loads(read_bytes(f"{out}/manifest.json"))["files"]
    return spark.createDataFrame([tuple(x) for x in files], "file string, base long, n_docs long, n_tokens long")


def read_archive(spark: SparkSession, out: str) -> DataFrame:
    """One row per document of the archive: doc_id, start, n_tokens, ids_crc32,
    and ids (binary, little-endian unsigned 32-bit); files are read in parallel."""
    manifest = read_manifest(spark, out)

    def run(batches):
        tab = Table.from_bytes(read_bytes(f"{out}/table.bin"))
        slots = tab.slots()
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = []
                for doc_id, ids in read_segment(read_bytes(f"{out}/{name}"), tab, slots):
                    raw = ids.astype("<u4").tobytes()
                    rows.append((doc_id, base, len(ids), zlib.crc32(raw), raw))
                    base += len(ids)
                    if len(rows) == 512:
                        yield as_batch(rows)
                        rows = []
                if rows:
                    yield as_batch(rows)

    def as_batch(rows):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                          ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    n = max(1, manifest.count())
    return (manifest.select("file", "base").repartitionByRange(n, "base")
            .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"))


def op4_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_path(spark, "rans")
    write_archive(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), out)
    return read_archive(spark, out).select("doc_id", "start", "n_tokens", "ids_crc32")
