"""Operator 1: BPE encoding and decoding by forced-boundary splitting."""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glare.llm.common import slices, table
from glare.llm.tokens import ForcedBoundaryBPE, encoder


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_texts(df: DataFrame, text: Column, path: str, keep: list[Column]) -> DataFrame:
    """``keep`` columns plus ``ids`` (binary, little-endian unsigned 32-bit).

    Every row gives one row; a null text is empty, an empty text has no ids.
    Stateless per row: no shuffle, any partitioning, memory of one Arrow batch
    plus bounded caches."""
    kept = df.select(*keep)
    names = kept.columns
    schema = kept.schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", ids binary"

    def run(batches):
        enc = encoder(ForcedBoundaryBPE, path)
        for b in batches:
            for part in slices(b):
                ids = [enc.encode(t or "") for t in part.column("__text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(ids, pa.binary())],
                                                 [*names, "ids"])

    return df.select(*keep, F.coalesce(text, F.lit("")).alias("__text")).mapInArrow(run, ddl)


def decode_ids(df: DataFrame, path: str, keep: list[str], out: str = "decoded") -> DataFrame:
    """``keep`` columns plus the text that ``ids`` decode to (null ids: null)."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema) + f", `{out}` string"

    def run(batches):
        enc = encoder(ForcedBoundaryBPE, path)
        for b in batches:
            for part in slices(b):
                texts = [None if x is None else enc.decode(np.frombuffer(x, "<u4").tolist())
                         for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in keep), pa.array(texts, pa.string())],
                                                 [*keep, out])

    return df.select(*keep, "ids").mapInArrow(run, ddl)


def encode_decode_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    Encodes the whole text, then decodes those very ids. Null text: as empty
    (0 tokens, digests of nothing); null or repeated ids are carried along; other
    columns are not read."""
    def run(batches):
        enc = encoder(ForcedBoundaryBPE, path)
        for b in batches:
            for part in slices(b):
                n, a, d = [], [], []
                for t in part.column("__text").to_pylist():
                    ids = enc.encode(t or "")
                    n.append(len(ids) // 4)
                    a.append(hashlib.sha256(ids).hexdigest())
                    text = enc.decode(np.frombuffer(ids, "<u4").tolist())
                    d.append(hashlib.sha256(text.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_col), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())],
                    [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).alias("__text")).mapInArrow(
        run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
