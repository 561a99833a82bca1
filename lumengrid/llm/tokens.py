"""Whole-text tokenisation with a public byte-level BPE vocabulary.

The tokenizers library spends most of its time on words that it has met before.  A byte-level BPE
encodes each pre-token on its own, so a text's ids are the ids of its pre-tokens put together; each
worker therefore keeps the ids of space-led chunks in a sorted table (by a 64-bit hash, confirmed by
a 32-bit one) and of words in dictionaries, all of bounded size, and the library's model sees a word
only when it is new there.  Chunks are hashed, looked up and put together as arrays, PART bytes at a time.  The
split into words is done here only for texts whose characters all lie in a plain set (ASCII, Latin
letters, some quotes) and that hold no two white-space characters in a row; every other text, and each
text that could hold a special token's string, goes to the library whole.  Both ways give the same ids.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

END_ID = 0
#: What a worker keeps: chunks (about 30 bytes each with their ids; past that number they start anew), and two
#: generations of words of WORD_BYTES bytes at most (about 200 bytes each): some 150 MB when all are full.
CACHE_CHUNKS, CACHE_WORDS, WORD_BYTES = 1_500_000, 250_000, 64
#: Bytes that are hashed and put together at once; each takes about 40 bytes of arrays for that time.
PART = 1 << 20

_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_MARKS = "!-/:-@\\[-`{-~¡¿«»–—‘’“”…€"
_UNUSUAL = re.compile(f"[^{_LETTERS}{_MARKS}0-9 \t\n\r]|<\\||[ \t\n\r][ \t\n\r]")
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[{_MARKS}]+|[ \t\n\r]")


def _alphabet() -> dict[int, str]:
    """Byte -> the character that stands for it in byte-level vocabularies: printable Latin-1 stands for itself."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


_ALPHABET = _alphabet()


class _Chunks:
    """Ids of chunks: rows sorted by hash, and one pool that all ids lie in."""

    def __init__(self):
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.uint16), 0

    def find(self, keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the keys stand or belong, and whether they are there."""
        at = np.searchsorted(self.keys, keys)
        there = np.minimum(at, max(len(self.keys) - 1, 0))
        return at, (self.keys[there] == keys) & (self.checks[there] == checks) if len(self.keys) else np.zeros(len(keys), bool)

    def add(self, at: np.ndarray, keys: np.ndarray, checks: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint16)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.keys, self.checks = np.insert(self.keys, at, keys), np.insert(self.checks, at, checks)
        self.starts = np.insert(self.starts, at, self.used + np.cumsum(sizes) - sizes)
        self.sizes = np.insert(self.sizes, at, sizes)
        self.used += len(ids)


class _Known(dict):
    """Pre-token -> its ids, by the library's BPE model on its byte alphabet; what was known in the generation before moves over."""

    def __init__(self, model):
        self.model, self.older = model, {}

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            mapped = word if word.isascii() else word.encode().decode("latin-1")
            found = array("H", [x.id for x in self.model.tokenize(mapped.translate(_ALPHABET))]).tobytes()
        if len(word) <= WORD_BYTES:
            if len(self) >= CACHE_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


_BASES = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Encoder:
    """A worker's tokenizer for one vocabulary file with its tables of chunks and words.

    Ids are little-endian unsigned 16-bit bytes: vocabularies of more than 65,536 ids are refused.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids of more than 16 bits are not supported")
        self.chunks = _Chunks()
        self.words = _Known(self.library.model)
        self.powers = [np.ones(1, np.uint64)] * 2

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids of each text by the library alone."""
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(x.ids, dtype="<u2").tobytes() for x in found]

    def _words(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, _WORDS.findall(text)))

    def _new(self, chunks: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks that lie one after the other (each begins with its only space), and how many each has."""
        words = _WORDS.findall(chunks)
        found = list(map(self.words.__getitem__, words))
        sizes = np.fromiter(map(len, found), np.int32, len(found)) // 2
        heads = np.flatnonzero(np.fromiter([x[0] == " " for x in words], bool, len(words)))
        return np.frombuffer(b"".join(found), np.uint16), np.add.reduceat(sizes, heads)

    def _hashes(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        most = int(sizes.max())
        if most > len(self.powers[0]):
            self.powers = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(most, b)])) for b in _BASES]
        offset = np.arange(len(raw)) - np.repeat(starts, sizes)
        value = raw.astype(np.uint64) + np.uint64(1)
        return [np.add.reduceat(value * p[offset], starts) for p in self.powers]

    def _plain(self, rests: list[str]) -> list[bytes]:
        """Ids of texts that each begin with a space: cut at spaces into parts of about PART bytes, and longer chunks by themselves."""
        out: list[list[bytes]] = [[] for _ in rests]
        held: list[tuple[int, bytes]] = []
        size = 0
        for i, rest in enumerate(rests):
            data = rest.encode()
            at = 0
            while at < len(data):
                stop = len(data)
                if stop - at > PART:
                    stop = data.rfind(b" ", at + 1, at + PART)
                    if stop < 0:
                        stop = data.find(b" ", at + PART)
                        stop = len(data) if stop < 0 else stop
                if stop - at > PART:  # one chunk: not worth keeping
                    self._put(held, out)
                    held, size = [], 0
                    out[i].append(self._words(data[at:stop].decode()))
                else:
                    held.append((i, data[at:stop]))
                    size += stop - at
                    if size >= PART:
                        self._put(held, out)
                        held, size = [], 0
                at = stop
        self._put(held, out)
        return [b"".join(x) for x in out]

    def _put(self, parts: list[tuple[int, bytes]], out: list[list[bytes]]) -> None:
        """Adds the ids of each part (text's number, bytes that begin with a space) to its text's."""
        if not parts:
            return
        data = b"".join(x for _, x in parts)
        raw = np.frombuffer(data, np.uint8)
        starts = np.flatnonzero(raw == 32)
        sizes = np.diff(np.append(starts, len(raw)))
        keys, checks = self._hashes(raw, starts, sizes)
        keys, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        checks = (checks[first] >> np.uint64(32)).astype(np.uint32)
        if len(self.chunks.keys) > CACHE_CHUNKS or self.chunks.used > 8 * CACHE_CHUNKS:
            self.chunks = _Chunks()
        at, known = self.chunks.find(keys, checks)
        new = np.flatnonzero(~known)
        if len(new):
            cut = zip(starts[first[new]].tolist(), (starts + sizes)[first[new]].tolist(), strict=True)
            self.chunks.add(at[new], keys[new], checks[new], *self._new(b"".join([data[a:b] for a, b in cut]).decode()))
            at = np.searchsorted(self.chunks.keys, keys)  # of two chunks with one 64-bit hash, the newer stands first
        n = self.chunks.sizes[at][inverse]
        end = np.cumsum(n)
        ids = self.chunks.pool[np.repeat(self.chunks.starts[at][inverse] - end + n, n) + np.arange(end[-1])]
        stops = end[np.cumsum([x.count(b" ") for _, x in parts]) - 1].tolist()
        start = 0
        for (i, _), stop in zip(parts, stops, strict=True):
            out[i].append(ids[start:stop].tobytes())
            start = stop

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each whole text (null: none), without an end id."""
        out: list[bytes] = [b""] * len(texts)
        plain, rests, others = [], [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            if _UNUSUAL.search(text):
                others.append(i)
                continue
            first, space, rest = text.partition(" ")
            out[i] = self._words(first)
            if space:
                plain.append(i)
                rests.append(" " + rest)
        if plain:
            for i, ids in zip(plain, self._plain(rests), strict=True):
                out[i] += ids
        for i, ids in zip(others, self.whole([texts[i] for i in others]), strict=True):
            out[i] = ids
        return out


_LOADED: dict[str, Encoder] = {}


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed public vocabulary lies; the file is never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> Encoder:
    """The worker's encoder for the vocabulary file at path, loaded once."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]
