"""How tasks pack sorted arrays of numbers that they send one another."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

#: So many numbers are packed at a time.
AT_ONCE = 1 << 18


def shards_of(total: int, most: int, tasks: int) -> int:
    """Into how many shards numbers go of which each holds at most most; small totals still keep the given number of tasks busy."""
    return max(1, -(-total // most), min(tasks, -(-total // (most // 8))))


def runs(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal values of a sorted array begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _turned(a: np.ndarray) -> bytes:
    """The first bytes of all the numbers, then the second ones and so on, which compress better."""
    a = np.ascontiguousarray(a)
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() if len(a) else b""


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(_turned(a) for a in arrays))


def unpack(raw: bytes, *kinds: str) -> list[np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    size = [np.dtype(k).itemsize for k in kinds]
    n, out, at = len(data) // sum(size), [], 0
    for k, s in zip(kinds, size, strict=True):
        out.append(np.ascontiguousarray(data[at : at + n * s].reshape(s, n).T).view(k).ravel())
        at += n * s
    return out


def pack_sorted(first: np.ndarray, *more: np.ndarray) -> bytes:
    """The same, where the first array ascends: its gaps are kept."""
    return pack(np.diff(first.astype(np.uint64), prepend=np.zeros(1, np.uint64)), *more)


def unpack_sorted(raw: bytes, *kinds: str) -> list[np.ndarray]:
    gaps, *more = unpack(raw, "<u8", *kinds)
    return [np.cumsum(gaps, dtype=np.uint64), *more]


def packed_small(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers of seven bits a byte, low bits first, the last byte below 128; and where each number begins, with the end."""
    v = values.astype(np.uint64, copy=False)
    size = np.ones(len(v), np.uint8)
    for k in range(1, 10):
        size += v >= np.uint64(1 << 7 * k)
    at = np.zeros(len(v) + 1, np.int64)
    np.cumsum(size, dtype=np.int64, out=at[1:])
    out = np.zeros(at[-1], np.uint8)
    for a in range(0, len(v), AT_ONCE):
        some = slice(a, min(a + AT_ONCE, len(v)))
        for k in range(int(size[some].max())):
            there = a + np.flatnonzero(size[some] > k)
            out[at[there] + k] = ((v[there] >> np.uint64(7 * k)) & np.uint64(127)) | (np.uint64(128) * (size[there] > k + 1)).astype(np.uint64)
    return out, at


def unpacked_small(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers, and where each ends."""
    end = np.flatnonzero(data < 128) + 1
    if not len(end):
        return np.zeros(0, np.int64), end
    begin = np.concatenate([[0], end[:-1]])
    place = np.arange(len(data)) - np.repeat(begin, end - begin)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), begin), end


def by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Batches of rows that are sorted by keys, cut so that no key goes on in the next."""
    rest = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        rest = part if rest is None else pa.concat_tables([rest, part])
        if not rest.num_rows:
            continue
        columns = [rest[c].combine_chunks() for c in keys]
        same = np.ones(rest.num_rows, bool)
        for c in columns:
            same &= pc.equal(c, c[-1]).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield rest.slice(0, cut)
            rest = rest.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest
