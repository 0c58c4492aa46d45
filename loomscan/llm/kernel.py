"""Vectorised text kernels over Arrow string columns.

A slice of texts is one UTF-8 byte array with offsets; words, word hashes and n-gram
hashes are computed for all of it at once with numpy.  Every hash is 64 bits wide, so
over 10^8 distinct n-grams a false match has a chance of about 10^-3.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_STEP = _RNG.integers(1, 2**63, 64, dtype=U64) * U64(2) + U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Words of letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: Words of anything but ASCII white space.
SOLID = np.ones(256, bool)
SOLID[[32, 9, 10, 11, 12, 13]] = False

#: Bytes of text that are worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every bit of the result depends on all bits of x."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def column(batch, name: str) -> pa.Array:
    """A column of a batch or table as one array."""
    c = batch.column(name)
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins (one more for the end); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    begin, end = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8)[begin:end] if data is not None and end > begin else np.zeros(0, np.uint8)
    return raw, offsets - begin


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with about SLICE_BYTES of text each."""
    _, offsets = utf8(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """The words of a slice of texts.

    start, end: byte positions; first: index of each text's first word, and the end;
    hashes: a 64-bit hash of each word with A-Z lower-cased.
    """

    def __init__(self, texts: pa.Array, letters: np.ndarray):
        self.raw, self.offsets = utf8(texts)
        inside = letters[self.raw]
        if len(self.raw):
            before = np.empty_like(inside)
            before[0], before[1:] = False, inside[:-1]
            begins = self.offsets[:-1][self.offsets[:-1] < len(self.raw)]
            before[begins] = False
            after = np.empty_like(inside)
            after[-1], after[:-1] = False, inside[1:]
            lasts = self.offsets[1:][self.offsets[1:] > 0] - 1
            after[lasts] = False
            self.start = np.flatnonzero(inside & ~before)
            self.end = np.flatnonzero(inside & ~after) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, self.offsets)
        self.counts = np.diff(self.first)
        self.hashes = self._hash(inside)

    def _hash(self, inside: np.ndarray) -> np.ndarray:
        size = self.end - self.start
        if not len(size):
            return np.zeros(0, U64)
        where = np.flatnonzero(inside)
        begin = np.cumsum(size) - size
        place = np.arange(len(where)) - np.repeat(begin, size)
        powers = np.multiply.accumulate(np.full(int(size.max()), _BASE, U64))
        return mix(np.add.reduceat(_BYTE[_LOWER[self.raw[where]]] * powers[place], begin))

    def doc(self) -> np.ndarray:
        """The index of each word's text."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def word(self, i: int) -> bytes:
        return _LOWER[self.raw[self.start[i] : self.end[i]]].tobytes()

    def phrase(self, i: int, n: int) -> bytes:
        """n words from the i-th on, joined by single spaces."""
        return b" ".join(self.word(k) for k in range(i, i + n))


def combine(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n consecutive word hashes, across ends of texts as well."""
    if len(hashes) < n:
        return np.zeros(0, U64)
    out = np.zeros(len(hashes) - n + 1, U64)
    for k in range(n):
        out += hashes[k : len(hashes) - n + 1 + k] * _STEP[k % 64] + U64(k)
    return mix(out + U64(n))


def ngrams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the n-grams that lie within one text, and how many each text has."""
    counts = np.maximum(words.counts - n + 1, 0)
    every = combine(words.hashes, n)
    first = words.first[:-1]
    total = int(counts.sum())
    if not total:
        return np.zeros(0, U64), counts
    begin = np.cumsum(counts) - counts
    return every[np.arange(total) - np.repeat(begin - first, counts)], counts


def shingle_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's sorted distinct n-word shingles; a shorter text's is the whole sequence."""
    grams, counts = ngrams(words, n)
    counts = counts.copy()
    few = np.flatnonzero((words.counts > 0) & (words.counts < n))
    if len(few):
        whole = np.array([combine(words.hashes[words.first[i] : words.first[i] + words.counts[i]], int(words.counts[i]))[0] for i in few], U64)
        at = (np.cumsum(counts) - counts)[few]
        grams = np.insert(grams, at, whole)
        counts[few] = 1
    ends = np.cumsum(counts)
    for a, b in zip((ends - counts).tolist(), ends.tolist()):
        grams[a:b].sort()
    if not len(grams):
        return grams, counts
    new = np.empty(len(grams), bool)
    new[0], new[1:] = True, grams[1:] != grams[:-1]
    new[(ends - counts)[counts > 0]] = True
    sizes = np.zeros(len(counts), np.int64)
    sizes[counts > 0] = np.add.reduceat(new.astype(np.int64), (ends - counts)[counts > 0])
    return grams[new], sizes


def squeeze(values: np.ndarray) -> bytes:
    """Integers as compressed bytes; sorted ones as differences."""
    return pa.compress(np.ascontiguousarray(values).tobytes(), codec="zstd", asbytes=True)


def spread(data: bytes, kind, size: int) -> np.ndarray:
    """The inverse of squeeze."""
    return np.frombuffer(pa.decompress(data, decompressed_size=size * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind) if size else np.zeros(0, kind)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as the planes of their differences' bytes, compressed: the high planes are nearly all zero."""
    gaps = np.diff(keys, prepend=U64(0))
    return squeeze(gaps.view(np.uint8).reshape(-1, 8).T)


def unpack_sorted(data: bytes, size: int) -> np.ndarray:
    planes = spread(data, np.uint8, size * 8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(planes).view(U64).ravel(), dtype=U64)
