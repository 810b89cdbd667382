"""Exact, cached encoding of whole texts with the public tokenizer files.

Both encoders cut a text where the tokenizer provably treats the two sides
independently, encode each fragment once, and join the cached little-endian
ids. Caches are bounded; what one has forgotten only costs time.
"""
from __future__ import annotations

import json
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from glare.llm.common import SPACE, worker_store
from glare.llm.merges import Merges, encode_plain

#: fragments of one generation of a cache, of which a worker has two, and the
#: longest fragment kept
CACHE_ENTRIES = 300_000
CACHE_CHARS = 64


def load_tokenizer(path: str):
    """The file's tokenizer without truncation and padding, one per worker."""
    store = worker_store("tokens")
    if path not in store:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        store[path] = tok
    return store[path]


def byte_alphabet() -> dict[str, int]:
    """Byte-level BPE's printable stand-in of each byte, as character -> byte:
    printable Latin-1 bytes stand for themselves, the others follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: a word whose pre-tokens are plain: Latin letters (of which both tokenizers'
#: patterns take the longest run), then marks (of which they take the longest run
#: too; an apostrophe may begin another token and "<" a special one)
SIMPLE = re.compile("([ \n]?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:;=-@\\[-`{-~]*)")


class Recent(dict):
    """Values of ``make``, cached in two generations: an entry that is used stays
    when the young generation is full and becomes the old one. ``turn`` is called
    between texts."""

    def __init__(self, make, most: int):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > CACHE_CHARS:
                return value
        self[key] = value
        return value

    def turn(self) -> None:
        if len(self) >= self.most:
            self.old = self.copy()
            self.clear()


def byte_level(letters: str, chars: dict[int, str]) -> str:
    """The stand-ins of the bytes of letters; ASCII letters stand for themselves."""
    if letters.isascii():
        return letters
    return "".join(map(chars.__getitem__, letters.encode()))


def little_endian(ids) -> bytes:
    out = array(_UINT32, ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


_UINT32 = next(c for c in "IL" if array(c).itemsize == 4)


class ForcedBoundaryBPE:
    """Byte-level BPE by forced-boundary splitting.

    A pair of adjacent bytes that occurs inside no vocabulary token can never
    be merged, nor lie inside a merge, so the text may be cut there and the
    fragments encoded independently. Cuts are placed before white space that
    follows a visible character (always an edge of the pre-tokenizer), at its
    other edges, and inside words at every forbidden byte pair.
    """

    words = re.compile(f"[{SPACE}]+[^{SPACE}]*|[^{SPACE}]+")

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        self.tok = load_tokenizer(path)
        spec = json.loads(self.tok.to_str())
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        alphabet, vocab = byte_alphabet(), self.tok.get_vocab(with_added_tokens=False)
        as_bytes = {t: bytes(alphabet[c] for c in t) for t in vocab if all(c in alphabet for c in t)}
        #: adjacent stand-ins of bytes that lie inside some token
        self.inside = {p for t in as_bytes for p in zip(t, t[1:])}
        self.alphabet, self.chars = alphabet, {b: c for c, b in alphabet.items()}
        self.space, self.line_end, self.tokenize = self.chars[0x20], self.chars[0x0A], self.tok.model.tokenize
        self.merges = None
        self.bytes_of = [b""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for t, i in vocab.items():
            self.bytes_of[i] = as_bytes.get(t, t.encode())
        for t, i in self.added.items():
            self.bytes_of[i] = t.encode()
        self.word_ids, self.piece_ids = Recent(self._word, entries), Recent(self._piece, entries)

    def _piece(self, piece: str) -> bytes:
        """Ids of one pre-token in stand-ins: cut at every pair of bytes that no
        token holds, each fragment encoded by itself."""
        if self.inside.issuperset(zip(piece, piece[1:])):
            return little_endian([t.id for t in self.tokenize(piece)])
        cuts = [i for i, p in enumerate(zip(piece, piece[1:]), 1) if p not in self.inside]
        return little_endian([t.id for a, b in zip([0, *cuts], [*cuts, len(piece)]) for t in self.tokenize(piece[a:b])])

    def _word(self, word: str) -> bytes:
        simple, piece_ids = SIMPLE.fullmatch(word), self.piece_ids
        if simple is None:
            return b"".join([piece_ids[piece] for piece, _ in self.tok.pre_tokenizer.pre_tokenize_str(word)])
        space, letters, marks = simple.groups()
        letters = byte_level(letters, self.chars)
        out = piece_ids[self.space + letters] if space == " " else piece_ids[letters]
        if space == "\n":
            out = piece_ids[self.line_end] + out
        return out + piece_ids[marks] if marks else out

    def _plain(self, text: str) -> bytes:
        out = b"".join(map(self.word_ids.__getitem__, self.words.findall(text)))
        self.word_ids.turn()
        self.piece_ids.turn()
        return out

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of the whole text."""
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self._plain(text[at:m.start()]), self.added[m.group()].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def encode_many(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text (null: none), as ``encode`` gives them. The texts are cut
        together, and their distinct pre-tokens are merged together."""
        if self.merges is None:
            self.merges = Merges.of(json.loads(self.tok.to_str())["model"], self.chars) or False
        texts = pc.fill_null(texts, "")
        if not self.merges:
            return [np.frombuffer(self.encode(t), "<u4") for t in texts.to_pylist()]
        out = encode_plain(texts, self.merges, self.word_ids.__getitem__)
        self.word_ids.turn()
        self.piece_ids.turn()
        for token in self.added:
            for i in pc.indices_nonzero(pc.match_substring(texts, token)).to_pylist():
                out[i] = np.frombuffer(self.encode(texts[i].as_py()), "<u4")
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class SpacedWordBPE:
    """Encoder for tokenizers that drop white space and never join across it:
    each run between ASCII white space is encoded once. Plain words go to the
    file's model directly, all others through the whole tokenizer (normaliser,
    pre-tokenizer, added tokens)."""

    words = re.compile("[^ \t\n\r]+")

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        self.tok = load_tokenizer(path)
        self.chars, self.tokenize = {b: c for c, b in byte_alphabet().items()}, self.tok.model.tokenize
        self.word_ids, self.piece_ids = Recent(self._word, entries), Recent(self._piece, entries)

    def _piece(self, piece: str) -> bytes:
        """Ids of a run of Latin letters or of marks, which is one pre-token."""
        return little_endian([t.id for t in self.tokenize(byte_level(piece.lower(), self.chars))])

    def _word(self, word: str) -> bytes:
        simple = SIMPLE.fullmatch(word)
        if simple is None:
            return little_endian(self.tok.encode(word, add_special_tokens=False).ids)
        _, letters, marks = simple.groups()
        out = self.piece_ids[letters]
        return out + self.piece_ids[marks] if marks else out

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of the whole text."""
        out = b"".join(map(self.word_ids.__getitem__, self.words.findall(text)))
        self.word_ids.turn()
        self.piece_ids.turn()
        return out


def encoder(kind: type, path: str):
    """The worker's encoder of a kind for a tokenizer file."""
    store = worker_store("tokens")
    key = (kind.__name__, path)
    if key not in store:
        store[key] = kind(path)
    return store[key]
