"""An n-gram trie in Elias-Fano levels, with quantised smoothed probabilities.

Order 3, stored by context from the nearest word out: a context word w2 has successors (bigrams) and longer contexts (w1 w2), which
have successors of their own (trigrams). The children of a context lie together and ascend, so a level is one
monotone sequence context * words + word, and the pointers into it are another; both are Elias-Fano coded. A lookup is a search for
the successor within its context's pointers. All levels lie in one memory-mapped block.

Probabilities are smoothed by adding STRENGTH tokens of the next lower order's distribution to each context, down to unigrams with one
added. They need a context's count and the n-gram's, nothing else, so any part of a corpus's n-grams makes a trie that agrees with
every other part. One-byte codes stand for fixed values, closer for likely words, so equal n-grams have equal codes in every trie.
"""

from __future__ import annotations

import mmap
from typing import NamedTuple

import numpy as np

#: How many tokens of the lower order's distribution a context of one and of two words gets.
STRENGTH = (30.0, 2.0)
#: Codes 0-255 stand for probabilities of 1 down to 10 ** -LEAST.
LEAST = 13.0
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: _NTH[b, k]: place of the k-th one of byte b.
_NTH = np.array([([p for p in range(8) if b >> p & 1] + [0] * 8)[:8] for b in range(256)], np.uint8)


#: Masks and numbers for counting the ones of 64-bit words byte by byte.
_N = {k: np.uint64(k) for k in (1, 2, 3, 4, 7, 8, 56, 255)}
_M = [np.uint64(x) for x in (0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F)]
_EACH, _TOP = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)


class Block:
    """A memory-mapped block that arrays are laid in one after another."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.size = 0
        self.map: mmap.mmap | None = None

    def add(self, a: np.ndarray) -> tuple[int, int, str]:
        a = np.ascontiguousarray(a)
        self.size = -(-self.size // 8) * 8
        at = (self.size, len(a), a.dtype.str)
        self.parts.append(a)
        self.size += a.nbytes
        return at

    def seal(self) -> None:
        self.map = mmap.mmap(-1, max(self.size, 8))
        at = 0
        for a in self.parts:
            at = -(-at // 8) * 8
            self.map[at : at + a.nbytes] = a.tobytes()
            at += a.nbytes
        self.parts = []

    def view(self, at: tuple[int, int, str]) -> np.ndarray:
        start, n, kind = at
        return np.frombuffer(self.map, np.dtype(kind), n, start)


class EliasFano:
    """A monotone sequence of integers: low bits as they are, high bits as gaps in unary, with the ones counted at every 64 bits."""

    def __init__(self, values: np.ndarray, block: Block):
        self.n = len(values)
        top = int(values[-1]) if self.n else 0
        self.low_bits = max(0, (top // max(self.n, 1)).bit_length() - 1)
        self.most = top >> self.low_bits
        values = values.astype(np.uint64)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64) + np.arange(self.n)
        # a zero ends each high part, the last one too
        bits = np.zeros(-(-(self.most + self.n + 1) // 64) * 64, bool)
        bits[high] = True
        packed = np.packbits(bits, bitorder="little")
        ones = _POP[packed].reshape(-1, 8).sum(1, dtype=np.int64)
        self._low = block.add(_pack(values & np.uint64((1 << self.low_bits) - 1), self.low_bits))
        self._high = block.add(packed.view(np.uint64))
        self._rank = block.add((np.cumsum(ones) - ones).astype(np.uint32))
        self.block = block

    def _place(self, i: np.ndarray, of_ones: bool) -> np.ndarray:
        """Where the i-th one (or zero) of the high bits is: the word by its count of ones before, the byte by the word's running counts, the bit by table."""
        rank, words = self.block.view(self._rank), self.block.view(self._high)
        before = rank.astype(np.int64) if of_ones else 64 * np.arange(len(rank)) - rank
        at = np.searchsorted(before, i, "right") - 1
        left = (i - before[at]).astype(np.uint64)
        w = words[at] if of_ones else ~words[at]
        x = w - ((w >> _N[1]) & _M[0])
        x = (x & _M[1]) + ((x >> _N[2]) & _M[1])
        upto = ((x + (x >> _N[4])) & _M[2]) * _EACH  # byte k: ones of bytes 0 to k
        byte = ((((((left * _EACH) | _TOP) - upto) & _TOP) >> _N[7]) * _EACH) >> _N[56]  # bytes of which left is past
        left = left - (((upto << _N[8]) >> (byte << _N[3])) & _N[255])
        return at * 64 + (byte << _N[3]).astype(np.int64) + _NTH[(w >> (byte << _N[3])) & _N[255], left]

    def _lows(self, i: np.ndarray) -> np.ndarray:
        return _unpack(self.block.view(self._low), self.low_bits, i)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        return ((self._place(i, True) - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._lows(i)

    def find(self, want: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Where want is within [lo, hi), or -1: its high part names a few neighbours, among which its low bits are searched."""
        out = np.full(len(want), -1, np.int64)
        part = (want >> np.uint64(self.low_bits)).astype(np.int64)
        k = np.flatnonzero((part <= self.most) & (lo < hi))
        if not len(k):
            return out
        part, low = part[k], want[k] & np.uint64((1 << self.low_bits) - 1)
        # so many values have a smaller or the same high part
        upto = self._place(part, False) - part
        below = np.where(part > 0, self._place(np.maximum(part - 1, 0), False) - part + 1, 0)
        lo, end = np.maximum(lo[k], below), np.minimum(hi[k], upto)
        a, b = lo.copy(), end.copy()
        while True:
            open_ = np.flatnonzero(a < b)
            if not len(open_):
                break
            mid = (a[open_] + b[open_]) // 2
            less = self._lows(mid) < low[open_]
            a[open_[less]] = mid[less] + 1
            b[open_[~less]] = mid[~less]
        inside = np.flatnonzero(a < end)
        hit = inside[self._lows(a[inside]) == low[inside]]
        out[k[hit]] = a[hit]
        return out


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Numbers of so many bits, end to end in 64-bit words: 64 of them fill width words."""
    groups = -(-len(values) // 64)
    out = np.zeros((groups, width + 1), np.uint64)
    v = np.zeros(groups * 64, np.uint64)
    v[: len(values)] = values
    v = v.reshape(groups, 64)
    for j in range(64 if width else 0):
        word, bit = j * width >> 6, j * width & 63
        out[:, word] |= v[:, j] << np.uint64(bit)
        if bit + width > 64:
            out[:, word + 1] |= v[:, j] >> np.uint64(64 - bit)
    return np.append(out[:, :width].ravel(), np.uint64(0))


def _unpack(packed: np.ndarray, width: int, i: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(i), np.uint64)
    at = i * width
    word, bit = at >> 6, (at & 63).astype(np.uint64)
    # what the next word holds of it, shifted in two steps as a shift by 64 isn't defined
    over = (packed[np.minimum(word + 1, len(packed) - 1)] << (np.uint64(63) - bit)) << np.uint64(1)
    return ((packed[word] >> bit) | over) & np.uint64((1 << width) - 1)


def quantise(log10: np.ndarray) -> np.ndarray:
    """One-byte codes of log probabilities. The steps are a hundredth of a decade near 1 and a twentieth at 10 ** -3."""
    return np.rint(255 * np.sqrt(np.minimum(-log10, LEAST) / LEAST)).astype(np.uint8)


VALUES = -LEAST * (np.arange(256) / 255) ** 2


class Counts(NamedTuple):
    """Training counts of some n-grams, over the whole corpus; only those that occur. words: how many word numbers there are.

    one, n1: context words and how often each is followed; two1, two2, n2: contexts w1 w2 (two2 * words + two1 ascends) and how often each is followed;
    pairs, c2: w2 * words + w3, ascending; of, w3, pair, c3: trigrams by the index of their context in two (of * words + w3 ascends), and the index of their
    bigram in pairs.
    """

    words: int
    one: np.ndarray
    n1: np.ndarray
    pairs: np.ndarray
    c2: np.ndarray
    two1: np.ndarray
    two2: np.ndarray
    n2: np.ndarray
    of: np.ndarray
    w3: np.ndarray
    pair: np.ndarray
    c3: np.ndarray


class Trie:
    """p1: the probability of each word. Every trigram's bigram and contexts are among the counts."""

    def __init__(self, c: Counts, p1: np.ndarray, strength: tuple[float, float] = STRENGTH):
        self.words, self.log1 = c.words, np.log10(p1)
        s1, s2 = strength
        first, word = c.pairs // c.words, c.pairs % c.words
        place = np.full(c.words, -1)
        place[c.one] = np.arange(len(c.one))
        parent, up = place[first], place[c.two2]
        p2 = (c.c2 + s1 * p1[word]) / (c.n1[parent] + s1)
        p3 = (c.c3 + s2 * p2[c.pair]) / (c.n2[c.of] + s2)
        self.block = block = Block()
        starts = lambda owner, n: EliasFano(np.searchsorted(owner, np.arange(n + 1)), block)
        self.contexts1 = EliasFano(c.one, block)
        self.bigrams, self.to_bigrams = EliasFano(parent * c.words + word, block), starts(parent, len(c.one))
        self.contexts2, self.to_contexts2 = EliasFano(up * c.words + c.two1, block), starts(up, len(c.one))
        self.trigrams, self.to_trigrams = EliasFano(c.of * c.words + c.w3, block), starts(c.of, len(c.two1))
        self.codes = [block.add(np.append(quantise(np.log10(x)), np.uint8(0))) for x in (p2, s1 / (c.n1 + s1), p3, s2 / (c.n2 + s2))]
        block.seal()

    def _value(self, level: int, at: np.ndarray) -> np.ndarray:
        return VALUES[self.block.view(self.codes[level])[at]]

    def log10(self, w1: np.ndarray, w2: np.ndarray, w3: np.ndarray) -> np.ndarray:
        """log10 P(w3 | w1 w2) of each row."""
        pairs, pair = np.unique(w2 * self.words + w3, return_inverse=True)
        contexts, context = np.unique(w2 * self.words + w1, return_inverse=True)
        return self.scores(pairs, contexts, pair, context, w3)

    def _children(self, level: EliasFano, pointers: EliasFano, heads: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Where each key (parent * words + word, parents by their place in heads' order) is among its parent's children; -1 if it isn't. Keys ascend."""
        at = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1]])) if len(heads) else np.zeros(0, np.int64)
        each, size = heads[at], np.diff(np.append(at, len(heads)))
        known = np.maximum(each, 0)
        lo, hi = (np.where(each >= 0, pointers.access(x).astype(np.int64), 0) for x in (known, known + 1))
        return level.find((np.maximum(heads, 0) * self.words + keys).astype(np.uint64), np.repeat(lo, size), np.repeat(hi, size))

    def scores(self, pairs: np.ndarray, contexts: np.ndarray, pair: np.ndarray, context: np.ndarray, w3: np.ndarray) -> np.ndarray:
        """log10 P of trigrams. pairs: different w2 * words + w3; contexts: different w2 * words + w1, both ascending; each trigram by its place in either, and its
        last word. Trigrams are in the order of their contexts."""
        if not self.contexts1.n or not len(pairs):
            return self.log1[w3]
        # the same words head pairs and contexts
        first = pairs // self.words
        at = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
        heads = first[at].astype(np.uint64)
        root = self.contexts1.find(heads, np.zeros(len(heads), np.int64), np.full(len(heads), self.contexts1.n))
        parent = np.repeat(root, np.diff(np.append(at, len(first))))
        at = self._children(self.bigrams, self.to_bigrams, parent, pairs % self.words)
        two = np.where(at >= 0, self._value(0, np.maximum(at, 0)), self.log1[pairs % self.words] + np.where(parent >= 0, self._value(1, np.maximum(parent, 0)), 0.0))
        out = two[pair]
        if not self.contexts2.n:
            return out
        first = contexts // self.words
        at = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
        parent = np.repeat(root, np.diff(np.append(at, len(first))))
        own = self._children(self.contexts2, self.to_contexts2, parent, contexts % self.words)
        k = np.flatnonzero(own[context] >= 0)
        k = k[np.argsort(own[context[k]], kind="stable")] if len(k) and (np.diff(own[context[k]]) < 0).any() else k
        c = own[context[k]]
        at = self._children(self.trigrams, self.to_trigrams, c, w3[k])
        out[k] = np.where(at >= 0, self._value(2, np.maximum(at, 0)), out[k] + self._value(3, c))
        return out
