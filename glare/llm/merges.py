"""Byte-level BPE over many texts at once: cut all of them into pre-tokens, keep
the distinct ones, and merge those by columns instead of one call a word."""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from glare.llm.common import SPACE

#: longest pre-token (bytes) that is merged here; the model takes longer ones
MERGE_BYTES = 32

LETTER, MARK, DIGIT, WHITE, OTHER = range(5)
#: kind of each byte by itself; an apostrophe may begin another pre-token
KIND = np.full(256, OTHER, np.uint8)
KIND[0x21:0x7F] = MARK
KIND[0x27] = OTHER
KIND[0x30:0x3A] = DIGIT
KIND[0x41:0x5B] = KIND[0x61:0x7B] = LETTER
KIND[0x09:0x0E] = KIND[0x20] = WHITE
#: second byte of the letters U+00C0 to U+00FF, whose first one is C3
LATIN = np.zeros(256, bool)
LATIN[0x80:0xC0] = True
LATIN[[0x97, 0xB7]] = False
#: by kind before * 5 + kind after: a pre-token always ends here. White space after
#: a visible character, or another of the three kinds whose longest run is taken
EDGE = np.array([a != b and a != WHITE and (b == WHITE or max(a, b) < WHITE) for a in range(5) for b in range(5)])
#: the last two or three bytes of white space beyond ASCII
_WIDE = [c.encode() for c in map(chr, range(0x80, 0x3001)) if re.match(f"[{SPACE}]", c)]
WIDE_SPACES = [(n, [int.from_bytes(c, "big") for c in _WIDE if len(c) == n]) for n in (2, 3)]


def kinds(data: np.ndarray) -> np.ndarray:
    """Kind of every byte of UTF-8 texts; both bytes of a Latin-1 letter are LETTER."""
    kind = KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[LATIN[data[lead + 1]]]
    kind[lead] = kind[lead + 1] = LETTER
    return kind


def piece_starts(data: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where pieces of the texts begin: only at edges of pre-tokens, on both sides
    of which the pattern decides alone. A piece may hold several pre-tokens."""
    kind, edge = kinds(data), np.zeros(len(data), bool)
    edge[1:] = EDGE[kind[:-1] * np.uint8(5) + kind[1:]]
    # other white space is no visible character
    at = np.flatnonzero(edge[1:] & (data[:-1] >= 0x80)) + 1
    for n, codes in WIDE_SPACES:
        last = sum(data[np.maximum(at - k, 0)].astype(np.int64) << (8 * (k - 1)) for k in range(1, n + 1))
        edge[at[np.isin(last, codes)]] = False
    edge[text_starts] = True
    # a line end alone before a visible character is a pre-token
    at = np.flatnonzero((data[:-1] == 0x0A) & edge[:-1] & (kind[1:] < WHITE)) + 1
    edge[at] = True
    return np.flatnonzero(edge)


def whole(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a piece surely is one pre-token: letters, digits or marks after at
    most one space, or one line end."""
    kind = kinds(data)
    spaced = start[(data[start] == 0x20) & (size > 1)]
    kind[spaced] = kind[spaced + 1]
    low, high = np.minimum.reduceat(kind, start), np.maximum.reduceat(kind, start)
    return (low == high) & (high < WHITE) | (size == 1) & (data[start] == 0x0A)


class Merges:
    """The merges of a BPE model as a hash table from pairs of ids to ranks."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, model: dict, chars: dict[int, str]):
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.n = max(vocab.values()) + 1
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        # of a repeated pair the last one counts
        rank = {vocab[a] * self.n + vocab[b]: r for r, (a, b) in enumerate(pairs)}
        bits = max(4, (4 * len(rank)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, self.NONE, np.int32)
        for key, r in rank.items():
            at = int(self._slot(np.array([key]))[0])
            while self.keys[at] >= 0:
                at = (at + 1) & self.mask
            self.keys[at], self.ranks[at] = key, r
        self.first = np.array([vocab[chars[b]] for b in range(256)], np.int32)
        self.byte_ranks = self.find(np.repeat(self.first, 256), np.tile(self.first, 256))

    @classmethod
    def of(cls, model: dict, chars: dict[int, str]) -> "Merges | None":
        """None for a model that does more than merge the characters of a pre-token."""
        plain = model["type"] == "BPE" and not any(model.get(k) for k in (
            "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
        return cls(model, chars) if plain and all(c in model["vocab"] for c in chars.values()) else None

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; NONE for those that are never merged."""
        key = a.astype(np.int64) * self.n + b
        slot = self._slot(key)
        held = self.keys[slot]
        out = np.where(held == key, self.ranks[slot], self.NONE)
        left = np.flatnonzero((held != key) & (held >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            held, want = self.keys[slot[left]], key[left]
            out[left] = np.where(held == want, self.ranks[slot[left]], self.NONE)
            left = left[(held != want) & (held >= 0)]
        return out

    def apply(self, data: np.ndarray, start: np.ndarray, size: np.ndarray):
        """Yields (pieces, their ids as rows) until every piece has come once.

        Each piece is merged at its pair of lowest rank, the leftmost of equal ones,
        as long as it has one. A merge shortens it by one, so pieces of a width are a
        matrix: those of that many bytes, and those that were one longer and merged."""
        order = np.argsort(size, kind="stable")
        ends = np.searchsorted(size[order], np.arange(int(size.max(initial=0)) + 2))
        which, ids, ranks = np.zeros(0, np.int64), None, None
        for width in range(len(ends) - 2, 0, -1):
            new = order[ends[width]:ends[width + 1]]
            raw = data[start[new][:, None] + np.arange(width)]
            new_ids, new_ranks = self.first[raw], self.byte_ranks[raw[:, :-1].astype(np.int32) * 256 + raw[:, 1:]]
            if len(which):
                new, new_ids, new_ranks = (np.concatenate(x) for x in ((which, new), (ids, new_ids), (ranks, new_ranks)))
            which, ids, ranks = new, new_ids, new_ranks
            if width == 1:
                yield which, ids
                return
            rows = np.arange(len(which))
            at = ranks.argmin(axis=1)
            rank = ranks[rows, at]
            live = rank != self.NONE
            yield which[~live], ids[~live]
            which, at, rank, rows = which[live], at[live], rank[live], rows[:live.sum()]
            keep = np.ones((len(rows), width), bool)
            keep[rows, at + 1] = False
            ids = ids[live][keep].reshape(len(rows), width - 1)
            ids[rows, at] = self.made[rank]
            keep = np.ones((len(rows), width - 1), bool)
            keep[rows, at] = False
            ranks = ranks[live][keep].reshape(len(rows), width - 2)
            for r, k in ((rows[at > 0], at[at > 0] - 1), (rows[at < width - 2], at[at < width - 2])):
                ranks[r, k] = self.find(ids[r, k], ids[r, k + 1])


def encode_plain(texts: pa.Array, merges: Merges, other) -> list[np.ndarray]:
    """Ids of each text, none of which is null or holds an added token. ``other``
    gives the ids (little-endian unsigned 32-bit) of a piece that may hold several
    pre-tokens or is long. Equal pieces are merged once a call."""
    texts = texts.cast(pa.large_string())
    texts.validate(full=True)
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int64, n + 1, 8 * texts.offset) if n else np.zeros(1, np.int64)
    if ends[-1] == ends[0]:
        return [np.empty(0, np.uint32)] * n
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    starts = piece_starts(data, ends[:-1][ends[:-1] < ends[1:]])
    coded = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts),
        [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)]).dictionary_encode()
    pieces = coded.dictionary
    bounds = np.frombuffer(pieces.buffers()[1], np.int64, len(pieces) + 1)
    raw, at, size = np.frombuffer(pieces.buffers()[2], np.uint8)[:bounds[-1]], bounds[:-1], np.diff(bounds)
    mine = whole(raw, at, size) & (size <= MERGE_BYTES)
    done = [(p, m) for p, m in merges.apply(raw, at[mine], size[mine]) if len(p)]
    chosen, rest = np.flatnonzero(mine), np.flatnonzero(~mine)
    odd = [other(p.decode()) for p in pieces.take(pa.array(rest)).to_pylist()]
    lengths = np.zeros(len(pieces) + 1, np.int64)
    for p, m in done:
        lengths[chosen[p] + 1] = m.shape[1]
    lengths[rest + 1] = [len(x) // 4 for x in odd]
    first = np.cumsum(lengths)
    flat = np.empty(first[-1], "<u4")
    for p, m in done:
        flat[first[chosen[p]][:, None] + np.arange(m.shape[1])] = m
    for p, x in zip(rest.tolist(), odd):
        flat[first[p]:first[p + 1]] = np.frombuffer(x, "<u4")
    got = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(pieces), [None, pa.py_buffer(first * 4), pa.py_buffer(flat)]).take(coded.indices)
    ids = np.frombuffer(got.buffers()[2], "<u4")
    cuts = np.frombuffer(got.buffers()[1], np.int64, len(got) + 1)[np.searchsorted(starts, ends)] // 4
    return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
