"""Words and word windows of many texts at once, in numpy.

A word is a run of bytes other than space and 09-0D, as ``bytes.split`` cuts them. Texts are laid end to end with one
space after each word, so that a word, a window of words and a whole text are all slices of one buffer, and the hash of
any slice comes from two entries of a prefix sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest

_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)
_tables: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    global _tables
    if not _tables or len(_tables[0]) < n:
        size = ((n - 1 >> 17) + 1) << 17
        made = []
        for base in (_MULT, _INV):
            out, done = np.ones(size, np.uint64), 1
            while done < size:
                more = min(done, size - done)
                np.multiply(out[:more], np.uint64(pow(base, done, 1 << 64)), out=out[done : done + more])
                done += more
            made.append(out)
        if size > 1 << 21:  # a very long text: not kept
            return made
        _tables = made
    return _tables


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def row_slices(texts: pa.Array, target: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about target bytes of text each; a longer text is a range of its own."""
    if not len(texts):
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    off = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(off, off[i] + target, "right")) - 1)
        yield i, j
        i = j


def as_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null gives b''."""
    return [x or b"" for x in texts.cast(pa.binary() if not pa.types.is_large_string(texts.type) else pa.large_binary()).to_pylist()]


class Words:
    """Words of a list of texts. offsets[d]:offsets[d+1] are the words of text d; buf has one space after each word."""

    def __init__(self, docs: list[bytes]):
        split = [d.split() for d in docs]
        self.joined = [b" ".join(w) for w in split]
        self.offsets = np.zeros(len(docs) + 1, np.int64)
        np.cumsum([len(w) for w in split], out=self.offsets[1:])
        del split
        text = b" ".join(x for x in self.joined if x)
        self._lay(text + b" " if text else b"")

    @classmethod
    def packed(cls, text: bytes, counts: np.ndarray) -> "Words":
        """Of text that is already laid out with a space after each word, counts[d] words for each text."""
        self = cls.__new__(cls)
        self.offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self._lay(text)
        return self

    def _lay(self, raw: bytes) -> None:
        self.raw = raw
        self.buf = np.frombuffer(self.raw, np.uint8)
        self.ends = np.flatnonzero(self.buf == 32)
        self.starts = np.zeros(len(self.ends), np.int64)
        np.add(self.ends[:-1], 1, out=self.starts[1:])
        self._sums = None

    def __len__(self) -> int:
        return len(self.starts)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hash of the bytes start:end of each span. A polynomial: what it finds equal is still to be compared."""
        up, down = _powers(len(self.buf) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.buf) + 1, np.uint64)
            said = self._sums[1:]
            np.add(self.buf, np.uint64(1), out=said)
            said *= up[: len(self.buf)]
            np.cumsum(said, out=said)
        return mix((self._sums[end] - self._sums[start]) * down[start])

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word: of each distinct word once, by a hash that no pattern of letters defeats."""
        words, place = self.distinct()
        return np.fromiter(map(xxh3_64_intdigest, words.to_pylist()), np.uint64, len(words))[place]

    def distinct(self) -> tuple[pa.Array, np.ndarray]:
        """(distinct words, the place of each word among them). Exact: bytes are compared."""
        kept = self.buf[self.buf != 32]
        off = np.zeros(len(self) + 1, np.int64)
        np.subtract(self.ends, self.starts, out=off[1:])
        np.cumsum(off, out=off)
        arr = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(off), pa.py_buffer(kept)]).dictionary_encode()
        return arr.dictionary, arr.indices.to_numpy(zero_copy_only=False)

    def ids(self) -> np.ndarray:
        """Exact small integers, equal where the words are equal."""
        return self.distinct()[1]

    def window_starts(self, k: int) -> np.ndarray:
        """First word of each window of k words that lies within one text."""
        ok = np.ones(len(self), bool)
        last = self.offsets[1:]
        n = np.diff(self.offsets)
        for back in range(1, k):
            at = last[n >= back] - back
            ok[at] = False
        return np.flatnonzero(ok)


def combine(ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k values of ids from each place of at on."""
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        out *= np.uint64(_MULT)
        out += ids[at + j].astype(np.uint64, copy=False)
    return mix(out)


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of each k consecutive values."""
    width, cur = 1, x
    while width * 2 <= k:
        cur = np.minimum(cur[: len(cur) - width], cur[width:])
        width *= 2
    rest = k - width
    return np.minimum(cur[: len(cur) - rest], cur[rest:]) if rest else cur
