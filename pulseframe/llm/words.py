"""Words of Arrow text columns as numpy arrays, many documents at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa

#: A word is a run of anything but these six ASCII characters.
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
CHUNK = 1 << 20  #: bytes of text held in arrays at once, unless one document is longer
BLOCK = 1 << 18  #: bytes hashed at once, unless one word is longer
BASE = 0x9E3779B97F4A7C15 | 1
GRAM = np.uint64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the powers 0 to n - 1, and their inverses, modulo 2 ** 64."""
    inverse = pow(BASE, -1, 1 << 64)
    return tuple(np.cumprod(np.array([1] + [x] * (n - 1), np.uint64)) for x in (BASE, inverse))


@dataclass
class Words:
    """Words of consecutive documents. Word i is data[start[i] : start[i] + size[i]]."""

    first: int  #: row of the first document in its column
    begin: np.ndarray  #: of each document, the number of its first word; one more entry for the end
    size: np.ndarray
    data: np.ndarray
    start: np.ndarray

    @cached_property
    def at(self) -> np.ndarray:
        """Where each word begins in text."""
        return np.cumsum(self.size + 1) - (self.size + 1)

    @cached_property
    def text(self) -> np.ndarray:
        """The words, each followed by one space; word i is text[at[i] : at[i] + size[i]]."""
        out = np.full(int(self.size.sum()) + len(self.size), 32, np.uint8)
        letters = np.ones(len(out), bool)
        letters[self.at + self.size] = False
        out[letters] = self.data[~SPACE[self.data]]
        return out

    def joined(self, doc: int, kept: np.ndarray | None = None) -> bytes:
        """The document's words, or those that kept marks, joined by one space."""
        a, b = self.begin[doc], self.begin[doc + 1]
        if a == b:
            return b""
        text = self.text[self.at[a] : self.at[b - 1] + self.size[b - 1] + 1]
        if kept is not None:
            text = text[np.repeat(kept, self.size[a:b] + 1)]
        return text[:-1].tobytes()

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial in its bytes, by differences of running sums."""
        out, start, stop = np.empty(len(self.start), np.uint64), self.start, self.start + self.size
        i = 0
        while i < len(start):
            a = start[i]
            j = max(i + 1, int(np.searchsorted(stop, a + BLOCK, "right")))
            n = int(stop[j - 1] - a)
            up, down = _powers(max(BLOCK, 1 << (n - 1).bit_length()))
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE[self.data[a : a + n]] * up[:n])))
            out[i:j] = (sums[stop[i:j] - a] - sums[start[i:j] - a]) * down[start[i:j] - a]
            i = j
        return mix(out + self.size.astype(np.uint64))


def _words(first: int, data: np.ndarray, ends: np.ndarray) -> Words:
    """ends: where each document ends in data."""
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[0] = True
    edge[ends] = True
    before = np.concatenate(([False], solid[:-1])) & ~edge[:-1]
    after = np.concatenate((solid[1:], [False])) & ~edge[1:]
    start = np.flatnonzero(solid & ~before)
    size = np.flatnonzero(solid & ~after) + 1 - start
    begin = np.concatenate(([0], np.searchsorted(start, ends, "left")))
    return Words(first, begin, size, data, start)


def columns(texts: pa.Array) -> Iterator[Words]:
    """The column's documents in chunks; null counts as empty."""
    texts = texts.cast(pa.large_string()) if pa.types.is_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        yield _words(i, raw[offsets[i] : offsets[j]], offsets[i + 1 : j + 1] - offsets[i])
        i = j


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive words, documents' borders ignored."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for j in range(n):
        out = out * GRAM + hashes[j : j + len(out)]
    return mix(out)


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    if len(x) < n:
        return x[:0]
    width = 1
    while width * 2 <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (n - width)], x[n - width :]) if n > width else x
