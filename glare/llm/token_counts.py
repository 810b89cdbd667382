"""Operator 13: token counts by the whole-token shortcut.

Offline, every string of the vocabulary is tried alone: the ones that the
model's merges turn into exactly one token are proven whole. A text's
pre-tokens that are proven whole count one each without any merging; only the
rest are merged by the model.
"""
from __future__ import annotations

import json
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glare.llm.bpe_codec import tokenizer_path
from glare.llm.common import slices, table, worker_store
from glare.llm.tokens import byte_alphabet, byte_level, load_tokenizer

LIMIT = 2048
#: distinct words whose counts one generation of a worker's cache holds, and the longest
CACHE_WORDS, CACHE_CHARS = 200_000, 64

#: characters that the normaliser only lower-cases and whose kind (letter, digit,
#: other) is plain: visible ASCII and the letters of Latin-1
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: the tokenizer file's pre-token pattern, on lower-cased plain characters
PRE_TOKENS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@[-`{-~]+")


def _checked(tok) -> str:
    """The word-end mark of a tokenizer of the supported kind, else an error: words
    end at white space, which is dropped, and the model is BPE with word ends."""
    spec = json.loads(tok.to_str())
    parts = spec["normalizer"].get("normalizers", []) if spec["normalizer"] else []
    pre = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    end = spec["model"].get("end_of_word_suffix")
    if ([p["type"] for p in parts] != ["NFC", "Replace", "Lowercase"] or parts[1]["content"] != " "
            or pre[0].get("behavior") != "Removed" or not pre[0].get("invert") or spec["model"]["type"] != "BPE" or not end):
        raise ValueError("token counts need a lower-casing BPE with word ends that drops white space")
    return end


def prove_whole(path: str) -> frozenset[str]:
    """Offline: the pre-tokens (in byte stand-ins) that the model turns into one
    token. At most as many as the vocabulary has strings."""
    tok = load_tokenizer(path)
    end, merge = _checked(tok), tok.model.tokenize
    vocab = tok.get_vocab(with_added_tokens=False)
    alone = (s[:-len(end)] for s in vocab if s.endswith(end) and len(s) > len(end))
    return frozenset(s for s in alone if [t.id for t in merge(s)] == [vocab[s + end]])


class WholeTokenCounter:
    """Counts of a worker: proven pre-tokens, and a cache of words in two
    generations (a full young one becomes the old one, whose words move back when
    they are seen; what neither holds is counted again)."""

    words = re.compile("[^ \t\n\r]+")

    def __init__(self, path: str, whole: frozenset[str], entries: int = CACHE_WORDS):
        self.tok, self.whole, self.entries = load_tokenizer(path), whole, entries
        self.chars = {b: c for c, b in byte_alphabet().items()}
        self.merge = self.tok.model.tokenize
        self.added = [t["content"] for t in json.loads(self.tok.to_str())["added_tokens"]]
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def _pre_tokens(self, word: str) -> list[str]:
        """Pre-tokens of a word in byte stand-ins."""
        if PLAIN.fullmatch(word):
            pieces = PRE_TOKENS.findall(word.lower())
            return pieces if word.isascii() else [byte_level(p, self.chars) for p in pieces]
        return [p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(word))]

    def _count(self, word: str) -> int:
        if any(a in word for a in self.added):
            return len(self.tok.encode(word, add_special_tokens=False).ids)
        pieces = self._pre_tokens(word)
        rest = [p for p in pieces if p not in self.whole]
        return len(pieces) - len(rest) + sum(len(self.merge(p)) for p in rest)

    def _word(self, word: str) -> int:
        n = self.old.get(word)
        if n is None:
            n = self._count(word)
        if len(word) <= CACHE_CHARS:
            if len(self.young) >= self.entries:
                self.old, self.young = self.young, {}
            self.young[word] = n
        return n

    def count(self, text: str) -> int:
        """Tokens of the whole text."""
        total, rest = 0, []
        for w, n in zip(ws := self.words.findall(text), map(self.young.get, ws)):
            if n is None:
                rest.append(w)
            else:
                total += n
        return total + sum(map(self._word, rest))


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per input row: ``id_col``, n_bytes (UTF-8), n_tokens, over_limit
    (more than ``limit`` tokens).

    Words end at ASCII white space, which the tokenizer drops and never joins
    across; each is counted by its pre-tokens. The table of proven strings is made
    once on the driver and broadcast: it is bounded by the vocabulary file. Per
    row: no shuffle, memory of one Arrow batch and two cache generations.

    A null or empty text has 0 bytes and tokens; null and repeated ids are carried
    along; an empty table gives no rows; other columns are not read."""
    whole = df.sparkSession.sparkContext.broadcast(prove_whole(path))
    names = [id_col, "n_bytes", "n_tokens", "over_limit"]

    def run(batches):
        # beside the tokenizer that it loads, under a key of its own
        store, key = worker_store("tokens"), (WholeTokenCounter.__name__, path)
        if key not in store:
            store[key] = WholeTokenCounter(path, whole.value)
        counter = store[key]
        for b in batches:
            for part in slices(b):
                n = pa.array([counter.count(t) for t in part.column(1).to_pylist()], pa.int64())
                size = pc.binary_length(part.column(1)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), size, n, pc.greater(n, limit)], names)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("__text")).mapInArrow(
        run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
