"""Words of Arrow string columns, and their 64-bit hashes, found with whole-array numpy operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are taken together up to so many bytes, which bounds the working arrays; a longer text is taken alone.
BLOCK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _weights(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def string_parts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return off - off[0], raw


def blocks(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of texts of at most size bytes together."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        b = min(b, n)
        yield a, b
        a = b


class Words:
    """The words of some texts: start, end (bytes of raw), doc (text each belongs to), in order."""

    def __init__(self, offsets: np.ndarray, raw: np.ndarray, lower: bool = True):
        self.raw = _LOWER[raw] if lower else raw
        self.n_docs = len(offsets) - 1
        solid = ~_SPACE[self.raw]
        n = len(solid)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], after[-1] = False, False
            before[1:], after[:-1] = solid[:-1], solid[1:]
        self.start = np.flatnonzero(solid & (~before | edge[:-1])) if n else np.zeros(0, np.int64)
        self.end = np.flatnonzero(solid & (~after | edge[1:])) + 1 if n else np.zeros(0, np.int64)
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.first = np.searchsorted(self.start, offsets)  # of each text, and one past the last

    def hashes(self, seed: int = 1) -> np.ndarray:
        return span_hashes(self.raw, self.start, self.end, seed)


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each span: its bytes, each times a random odd number of its place, summed and mixed. Spans ascend."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    where = np.concatenate([[0], np.cumsum(size)])
    within = np.arange(where[-1]) - np.repeat(where[:-1], size)
    at = within + np.repeat(start, size)
    value = (raw[at].astype(np.uint64) + np.uint64(1)) * _weights(int(size.max()), seed)[within]
    return mix64(np.add.reduceat(value, where[:-1]) + size.astype(np.uint64))


_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def shingles(words: Words, n: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(hash, doc) of every n-word window; a text with fewer words, but some, has its whole sequence as the only one."""
    h = words.hashes()
    count = np.diff(words.first)
    out, docs = [], []
    if len(h) >= n:
        total = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            total = mix64(total * _P[0] + h[k : len(h) - n + 1 + k] * _P[1 + k % 2])
        same = words.doc[: len(h) - n + 1] == words.doc[n - 1 :]
        out.append(total[same])
        docs.append(words.doc[: len(h) - n + 1][same])
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = []
        for d in short:
            total = np.array([count[d]], np.uint64)
            for k in range(words.first[d], words.first[d + 1]):
                total = mix64(total * _P[0] + h[k : k + 1] * _P[2])
            whole.append(total)
        out.append(np.concatenate(whole))
        docs.append(short)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, d = np.concatenate(out), np.concatenate(docs)
    order = np.argsort(d, kind="stable")
    return h[order], d[order]
