"""Phrases whose words stand together more often than chance has it, counted with bitmaps of positions.

A shard is some megabytes of texts. Its words have positions in order, with a position left free wherever a piece ends, so that nothing
reaches from one piece into the next. A word's bitmap has a bit for each of its positions, in bytes of eight; only bytes that
aren't zero are kept.

A phrase's bitmap marks where it ends. The bitmap of words 1..k shifted up by one position, ANDed with that of words 2..k+1,
marks the ends of words 1..k+1, and its popcount is how often they occur in the shard. All pairs of bitmaps that share a byte are
ANDed at once. Counts are summed over the shards, phrases that are frequent overall get a number, and each shard goes on
with those. As the threshold holds for sums over all shards, phrases grow by one word in all shards together, not depth first
within one; whatever is frequent grows from two frequent phrases, so no other is ever counted. Phrases are told apart by the
numbers of the two phrases they grew from, never by hashes.

What travels: the different left phrases of a shard, each with all that follow it and their counts in few bytes, what is frequent of a shard's phrases, ANSWERS
of all shards at a time in a row for each shard, and a shard's bitmaps once a length. Followers of a frequent left phrase are dealt over as many keys as its count asks, so no key gathers more than some occurrences.

Defined cases: a null or empty text has no words; a null language is `und`, together with texts that say so; repeated rows count as often as
they stand; ties rank by count, then by the phrase's bytes; an empty table gives an empty result; other columns are ignored,
whatever their names. A document is in one shard, so a shard's memory follows the longest text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import partial
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, settled, stored
from .exchange import by_key, pack, packed_small, runs, unpack, unpacked_small
from .textops import blocks, mix64, string_parts

#: Bytes of text to a shard, and to a step in which its words are numbered.
SHARD_BYTES, STEP_BYTES = 24 << 20, 2 << 20
#: So many pairs of bytes are ANDed at a time.
PAIRS = 1 << 20
#: The pairs of a left phrase are dealt over one key for each so many of its occurrences.
DEAL = 1 << 20
#: Left phrases are sent together by buckets of their numbers: at least so many, and one for each so many words of the corpus.
BUCKETS, BUCKET_WORDS = 1 << 12, 1 << 18
#: A task tells shards what is frequent when it has so many answers for them, all those of a shard in one row.
ANSWERS = 1 << 20
#: Phrases of so many words are sought, and so many occurrences make one a candidate.
LONGEST, LEAST = 5, 100
#: So many phrases of each language are reported.
TOP = 2000
#: Letters to lower case, ends of pieces to newlines, tabs to spaces.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")
_EMPTY, _END, _FIRST = 0, 1, 2


class Bitmaps(NamedTuple):
    """Bitmaps of positions by number: those of ids[k] are the bytes first[k] to first[k + 1]; block is a byte's place. total: counts in the whole corpus."""

    ids: np.ndarray
    total: np.ndarray
    first: np.ndarray
    block: np.ndarray
    byte: np.ndarray

    @staticmethod
    def of(code: np.ndarray, block: np.ndarray, byte: np.ndarray, ids: np.ndarray, total: np.ndarray) -> Bitmaps:
        """From bytes in any order: of the bitmap with number ids[code]. Bytes of one place are ORed."""
        order = np.lexsort((block, code))
        code, block, byte = code[order], block[order], byte[order]
        new = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (block[1:] != block[:-1])])) if len(code) else np.zeros(0, np.int64)
        byte = np.bitwise_or.reduceat(byte, new) if len(new) else byte
        first = np.searchsorted(code[new], np.arange(len(ids) + 1))
        return Bitmaps(ids, total, first, block[new], byte)

    def packed(self) -> tuple[bytes, bytes]:
        gaps = np.diff(self.block, prepend=0)
        gaps[self.first[:-1][np.diff(self.first) > 0]] = self.block[self.first[:-1][np.diff(self.first) > 0]]
        return pack(self.ids.astype(np.int64), self.total.astype(np.int64), np.diff(self.first).astype(np.uint32)), pack(gaps.astype(np.int32), self.byte)

    @staticmethod
    def unpacked(heads: bytes, body: bytes) -> Bitmaps:
        ids, most, size = unpack(heads, "<i8", "<i8", "<u4")
        gaps, byte = unpack(body, "<i4", "u1")
        first = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        # what passes 32 bits in the sum falls out in the difference, as no place does
        total = np.concatenate([np.zeros(1, np.int32), np.cumsum(gaps, dtype=np.int32)])
        block = np.repeat(total[first[:-1]], size)
        return Bitmaps(ids, most, first, np.subtract(total[1:], block, out=block), byte)

    def followed(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(left, right, block, byte): the bitmap of each left shifted up by one position, ANDed with that of each right; zeros are left out."""
        row = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.first))
        order = np.argsort(self.block, kind="stable")
        row, block, byte = row[order], self.block[order].astype(np.int32), self.byte[order]
        begin = np.searchsorted(block, np.arange((int(block[-1]) if len(block) else 0) + 3)).astype(np.int32)
        for shifted, to in ((byte << 1, block), (byte >> 7, block + 1)):
            some = np.flatnonzero(shifted)
            n = begin[to[some] + 1] - begin[to[some]]
            total = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
            a = 0
            while a < len(some):
                b = max(a + 1, int(np.searchsorted(total, total[a] + PAIRS, "right")) - 1)
                k, m = some[a:b], n[a:b]
                right = np.arange(total[b] - total[a], dtype=np.int32) + np.repeat(begin[to[k]] - (total[a:b] - total[a]).astype(np.int32), m)
                both = np.repeat(shifted[k], m) & byte[right]
                hit = np.flatnonzero(both)
                right = right[hit]
                yield np.repeat(row[k], m)[hit], row[right], block[right], both[hit]
                a = b

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(left place, right number, popcount) of all pairs that ever follow each other."""
        size = len(self.ids)
        keys, bits = [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
        for left, right, _, byte in self.followed():
            keys.append(left.astype(np.int64) * size + right)
            bits.append(np.bitwise_count(byte))
        key, bit = np.concatenate(keys), np.concatenate(bits)
        del keys, bits
        order = np.argsort(key)
        key, bit = key[order], bit[order]
        del order
        new = runs(key)
        n = np.add.reduceat(bit, new, dtype=np.int64) if len(new) else np.zeros(0, np.int64)
        key = key[new]
        left, right = np.divmod(key, max(size, 1))
        return left.astype(np.int32), self.ids[right], n

    def grown(self, left: np.ndarray, right: np.ndarray, ids: np.ndarray, total: np.ndarray) -> Bitmaps:
        """The bitmaps of the given pairs, under the given numbers."""
        by = np.argsort(self.ids)
        at = lambda x: by[np.searchsorted(self.ids, x, sorter=by)]
        size = len(self.ids)
        key = at(left).astype(np.int64) * size + at(right)
        order = np.argsort(key)
        key, ids, total = key[order], ids[order], total[order]
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint8))]
        for a, b, block, byte in self.followed():
            pair = a.astype(np.int64) * size + b
            place = np.minimum(np.searchsorted(key, pair), len(key) - 1)
            there = key[place] == pair
            parts.append((place[there], block[there], byte[there]))
        return Bitmaps.of(*(np.concatenate(p) for p in zip(*parts, strict=True)), ids, total)


def read(batch_texts: Iterator[tuple[list[bytes], dict]]) -> tuple[dict[str, dict[bytes, int]], Bitmaps, np.ndarray]:
    """What a shard's texts hold, given as steps of {language: texts}: the numbers of each language's words, bitmaps by number, and counts."""
    number = count(_FIRST).__next__
    known: dict[str, dict[bytes, int]] = {}
    parts, at = [np.zeros(0, np.int64)], 0
    for step in batch_texts:
        for lang, texts in step.items():
            words = known.setdefault(lang, defaultdict(number, {b"": _EMPTY, b"\n": _END}))
            tokens = b"\n".join(texts).translate(_FOLD).replace(b"\n", b" \n ").split(b" ")
            code = np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens))
            parts.append(np.append(code[code != _EMPTY], _END))
    code = np.concatenate(parts)
    at = np.flatnonzero(code != _END)
    word = (code[at] - _FIRST).astype(np.int32)
    del code, parts
    n = int(word.max()) + 1 if len(word) else 0
    bit, block = np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)), (at >> 3).astype(np.int32)
    del at
    return known, Bitmaps.of(word, block, bit, np.arange(n), np.zeros(n, np.int64)), np.bincount(word, minlength=n)


_SHARD = "chunk long, heads binary, body binary, bucket long, lefts binary, followers binary"


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, language) of a partition as shards: their bitmaps, and a row for each different word."""
    chunk = TaskContext.get().partitionId() << 28

    def shards():
        steps, size = [], 0
        for batch in batches:
            offsets, raw = string_parts(batch.column(0))
            langs = batch.column(1).to_pylist()
            for a, b in blocks(offsets, STEP_BYTES):
                step = defaultdict(list)
                for k in range(a, b):
                    step[langs[k]].append(raw[offsets[k] : offsets[k + 1]].tobytes())
                steps.append(step)
                size += int(offsets[b] - offsets[a])
                if size >= SHARD_BYTES:
                    yield steps
                    steps, size = [], 0
        if steps:
            yield steps

    for steps in shards():
        known, bitmaps, n = read(iter(steps))
        heads, body = bitmaps.packed()
        langs, words, codes = [None], [None], [0]
        for lang, numbers in known.items():
            own = [(w, c) for w, c in numbers.items() if c >= _FIRST]
            langs += [lang] * len(own)
            words += [w for w, _ in own]
            codes += [c - _FIRST for _, c in own]
        m = len(codes) - 1
        counts = np.append(0, n[np.array(codes[1:], np.int64)])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(m + 1, chunk), pa.int64()), pa.array([heads] + [None] * m, pa.binary()), pa.array([body] + [None] * m, pa.binary()),
                pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(codes, pa.int64()), pa.array(counts, pa.int64()),
            ],
            names=["chunk", "heads", "body", "lang", "word", "p", "n"],
        )
        chunk += 1


def _followers(b: Bitmaps, buckets: int) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Rows (bucket, left numbers, what follows them). By turns: the step from one left number to the next, and how many follow it; the step from one right
    number of these to the next, and a count."""
    left, q, n = b.counted()
    parts = 1 + b.total[left] // DEAL
    part = np.zeros(len(q), np.uint64)
    some = np.flatnonzero(parts > 1)
    part[some] = mix64(q[some].astype(np.uint64)) % parts[some].astype(np.uint64)
    p = b.ids[left]
    part += mix64(b.ids.astype(np.uint64))[left]
    del left, parts
    bucket = (mix64(part) % np.uint64(buckets)).astype(np.int64)
    del part
    order = np.lexsort((q, p, bucket))
    p, q, n, bucket = p[order], q[order], n[order], bucket[order]
    del order
    rows, groups = runs(bucket), _edges(bucket, p)
    step = np.diff(q, prepend=0)
    step[groups] = q[groups]
    both = np.column_stack([step, n]).ravel()
    del q, step, n
    data, at = packed_small(both)
    at, both = at[2 * rows], None
    heads = p[groups]
    new = np.searchsorted(groups, rows)  # a row's first group
    lead = np.diff(heads, prepend=0)
    lead[new] = heads[new]
    names, where = packed_small(np.column_stack([lead, np.diff(np.append(groups, len(p)))]).ravel())
    return bucket[rows], _cut(names, np.append(where[2 * new], len(names))), _cut(data, np.append(at, len(data)))


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Where the runs of rows that are equal in all columns begin."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _cut(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def _joined(rows: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two columns of small numbers of all rows, and how many of them each row has."""
    packed = rows.to_pylist()
    value, end = unpacked_small(np.frombuffer(b"".join(packed), np.uint8))
    size = np.diff(np.searchsorted(end, np.concatenate([[0], np.cumsum(list(map(len, packed)))]), "right")) // 2
    return value[::2], value[1::2], size


def _sums(steps: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Running sums within runs of the given sizes, none of them empty."""
    upto = np.concatenate([[0], np.cumsum(steps)])
    return upto[1:] - np.repeat(upto[np.cumsum(size) - size], size)


def _rows(chunk: int, bitmaps: Bitmaps, buckets: int) -> pa.Table:
    """A shard's own row, and its rows of followers."""
    heads, body = bitmaps.packed()
    bucket, names, followers = _followers(bitmaps, buckets)
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
    own = [pa.array([x], t) for x, t in zip((chunk, heads, body, None, None, None), kinds, strict=True)]
    m = len(bucket)
    rest = [pa.array(np.full(m, chunk), pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), pa.array(bucket, pa.int64()), names, followers]
    return pa.table([pa.chunked_array([a, b]) for a, b in zip(own, rest, strict=True)], names=["chunk", "heads", "body", "bucket", "lefts", "followers"])


def _none() -> pa.Table:
    return _rows(0, Bitmaps(*[np.zeros(0, np.int64)] * 2, np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)), 1).slice(0, 0)


def _kept_words(buckets: int, own: pa.Table, answers: pa.Table) -> pa.Table:
    """A shard's bitmaps with those of infrequent words left out, and what follows each."""
    if not own.num_rows or not answers.num_rows:
        return _none()
    b = Bitmaps.unpacked(own["heads"][0].as_py(), own["body"][0].as_py())
    ids, total = np.full(len(b.ids), -1), np.zeros(len(b.ids), np.int64)
    number, a, p = _told(answers, 1)
    ids[p], total[p] = number, a
    known = ids >= 0
    size = np.diff(b.first)
    kept = np.repeat(known, size)
    # what is left out is given back before followers are counted
    b = Bitmaps(ids[known], total[known], np.concatenate([[0], np.cumsum(size[known])]), b.block[kept], b.byte[kept])
    return _rows(own["of"][0].as_py(), b, buckets)


def _kept_pairs(buckets: int, own: pa.Table, answers: pa.Table) -> pa.Table:
    """A shard's bitmaps of the frequent pairs, and what follows each."""
    if not own.num_rows or not answers.num_rows:
        return _none()
    b = Bitmaps.unpacked(own["heads"][0].as_py(), own["body"][0].as_py())
    ids, total, p, q = _told(answers, 2)
    return _rows(own["of"][0].as_py(), b.grown(p, q, ids, total), buckets)


def _answered(shards: DataFrame, answers: DataFrame, f) -> DataFrame:
    own = shards.filter(F.col("heads").isNotNull()).select(F.col("chunk").alias("of"), "heads", "body")
    to = answers.filter(F.col("chunk").isNotNull()).select(F.col("chunk").alias("to"), "answers")
    return own.groupBy("of").cogroup(to.groupBy("to")).applyInArrow(f, _SHARD)


class _Numbers:
    """Numbers that no other task gives."""

    def __init__(self):
        self.next = TaskContext.get().partitionId() << 33

    def take(self, n: int) -> np.ndarray:
        self.next += n
        return np.arange(self.next - n, self.next)


class _Answers:
    """What tasks tell shards: (number, count, names) of frequent phrases, gathered by shard. A row has all that a shard is told at a time."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, chunk: np.ndarray, *columns: np.ndarray) -> bool:
        """Whether enough has been gathered."""
        self.parts.append((chunk, *columns))
        self.size += len(chunk)
        return self.size >= ANSWERS

    def rows(self, **heads: pa.DataType) -> Iterator[pa.RecordBatch]:
        """Rows (heads, chunk, answers), where heads are null."""
        if self.size:
            chunk, ids, *columns = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            order = np.argsort(chunk, kind="stable")
            chunk, ids, columns = chunk[order], ids[order], [c[order] for c in columns]
            first = runs(chunk)
            packed = [pack(np.diff(ids[x:y], prepend=0), *(c[x:y] for c in columns)) for x, y in zip(first, np.append(first[1:], len(chunk)), strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(first), t) for t in heads.values()), pa.array(chunk[first]), pa.array(packed, pa.binary())], names=[*heads, "chunk", "answers"])
        self.parts, self.size = [], 0


def _told(answers: pa.Table, names: int) -> list[np.ndarray]:
    """(number, count, names) of all that a shard is told."""
    ids, *columns = zip(*(unpack(x, *["<i8"] * (2 + names)) for x in answers["answers"].to_pylist()), strict=True)
    return [np.concatenate([np.cumsum(x) for x in ids]), *(np.concatenate(c) for c in columns)]


def _heads(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """Rows (columns, chunk, answers) for no shard."""
    n = len(columns["id"])
    return pa.RecordBatch.from_arrays([*columns.values(), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=[*columns, "chunk", "answers"])


def _frequent_words(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (lang, word, chunk, p, n) sorted by word: the frequent words with number and count, and what shards are told of them."""
    numbers, told = _Numbers(), _Answers()
    kinds = {"id": pa.int64(), "lang": pa.string(), "word": pa.string(), "a": pa.int64()}
    for rows in by_key(batches, ["lang", "word"]):
        lang, word = (rows[c].combine_chunks() for c in ("lang", "word"))
        new = np.ones(len(word), bool)
        new[1:] = np.logical_or(*(pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False) for c in (lang, word)))
        first = np.flatnonzero(new)
        total = np.add.reduceat(rows["n"].to_numpy(), first)
        ids = np.full(len(first), -1)
        ids[total >= least] = numbers.take(int((total >= least).sum()))
        group = np.cumsum(new) - 1
        at = np.flatnonzero(ids[group] >= 0)
        many = total >= least
        head = pa.array(first[many])
        yield _heads({"id": pa.array(ids[many]), "lang": lang.take(head), "word": word.take(head), "a": pa.array(total[many])})
        if told.add(rows["chunk"].to_numpy()[at], ids[group[at]], total[group[at]], rows["p"].to_numpy()[at]):
            yield from told.rows(**kinds)
    yield from told.rows(**kinds)


def _frequent_pairs(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows of followers sorted by bucket: the frequent pairs with number and count, and what shards are told of them."""
    numbers, told = _Numbers(), _Answers()
    kinds = dict.fromkeys(("id", "p", "q", "a"), pa.int64())
    for rows in by_key(batches, ["bucket"]):
        lead, size, groups = _joined(rows["lefts"])
        step, n, _ = _joined(rows["followers"])
        p, q = np.repeat(_sums(lead, groups), size), _sums(step, size)
        row = np.repeat(np.repeat(np.arange(len(groups)), groups), size)
        order = np.lexsort((q, p))
        p, q, n, row = p[order], q[order], n[order], row[order]
        new = np.ones(len(p), bool)
        new[1:] = (p[1:] != p[:-1]) | (q[1:] != q[:-1])
        first = np.flatnonzero(new)
        total = np.add.reduceat(n, first)
        ids = np.full(len(first), -1)
        ids[total >= least] = numbers.take(int((total >= least).sum()))
        group = np.cumsum(new) - 1
        at = np.flatnonzero(ids[group] >= 0)
        many = total >= least
        yield _heads({c: pa.array(x[many]) for c, x in zip(kinds, (ids, p[first], q[first], total), strict=True)})
        if told.add(rows["chunk"].to_numpy()[row[at]], ids[group[at]], total[group[at]], p[at], q[at]):
            yield from told.rows(**kinds)
    yield from told.rows(**kinds)


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST) -> tuple[list[DataFrame], DataFrame]:
    """The phrases of 1, 2, ... longest words that occur least times, and each language's number of words.

    A phrase: id, lang, phrase, last (its last word), a (its count), heads and tails (counts of its first and last 1, 2, ... words), p and q (the phrases without
    its last and its first word).
    """
    texts = docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"))
    shards = stored(texts.mapInArrow(_first, "chunk long, heads binary, body binary, lang string, word string, p long, n long"), "phrase-words")
    words = shards.filter(F.col("word").isNotNull()).select("lang", "word", "chunk", "p", "n")
    totals = stored(words.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    dealt = words.repartition("lang", "word").sortWithinPartitions("lang", "word")
    told = stored(dealt.mapInArrow(partial(_frequent_words, least), "id long, lang string, word string, a long, chunk long, answers binary"), "phrase-counts")
    none = F.array().cast("array<bigint>")
    level = told.filter(F.col("chunk").isNull()).select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "a", none.alias("heads"), none.alias("tails"), *(F.lit(None).cast("long").alias(c) for c in "pq"))
    level = stored(level, "phrases")
    levels = [level]
    # so many buckets that one holds the followers of at most about so many words
    buckets = max(BUCKETS, (totals.agg(F.sum("n")).first()[0] or 0) // BUCKET_WORDS)
    before, shards = shards, stored(_answered(shards, told, partial(_kept_words, buckets)), "phrase-shards")
    discard(before)
    discard(told)
    for k in range(2, longest + 1):
        dealt = shards.filter(F.col("heads").isNull()).select("bucket", "chunk", "lefts", "followers").repartition("bucket").sortWithinPartitions("bucket")
        told = stored(dealt.mapInArrow(partial(_frequent_pairs, least), "id long, p long, q long, a long, chunk long, answers binary"), "phrase-counts")
        left = level.select(F.col("id").alias("p"), "lang", "phrase", "heads", F.col("a").alias("head"))
        right = level.select(F.col("id").alias("q"), "last", "tails", F.col("a").alias("tail"))
        grown = told.filter(F.col("chunk").isNull()).drop("chunk", "answers").join(left, "p").join(right, "q")
        heads, tails = F.concat("heads", F.array("head")).alias("heads"), F.concat("tails", F.array("tail")).alias("tails")
        level = stored(grown.select("id", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "a", heads, tails, "p", "q"), "phrases")
        levels.append(level)
        before = shards
        if k < longest:
            shards = stored(_answered(shards, told, partial(_kept_pairs, buckets)), "phrase-shards")
        discard(before)
        discard(told)
    return levels, totals


def _worst_cut(n: Column) -> Column:
    """(score, cut, l, r) of the lowest-scoring cut, the first of equal ones. Products are decimals of 38 digits."""

    def cut(k: Column) -> Column:
        first, rest = F.get("heads", k - 1), F.get("tails", F.size("tails") - k)
        top = F.lit(1000).cast("decimal(4,0)") * F.col("a").cast("decimal(16,0)") * n.cast("decimal(16,0)")
        below = first.cast("decimal(18,0)") * rest.cast("decimal(18,0)")
        return F.struct(F.call_function("div", top, below).alias("score"), k.alias("cut"), first.alias("l"), rest.alias("r"))

    return F.array_min(F.transform(F.sequence(F.lit(1), F.size("heads")), cut))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases of two words or more.

    A phrase that some longer one holds as often as it occurs is left out; it is enough to look at those of one word more.
    """
    return settled(docs.sparkSession, "collocations", lambda: _collocations(*frequent_phrases(docs, text, lang, least, longest), top))


def _collocations(levels: list[DataFrame], totals: DataFrame, top: int) -> DataFrame:
    out = None
    for k, level in enumerate(levels[1:], 1):
        if k + 1 < len(levels):
            longer = levels[k + 1].select(F.explode(F.array("p", "q")).alias("id"), "a").groupBy("id").agg(F.max("a").alias("within"))
            level = level.join(longer, "id", "left").filter(F.col("within").isNull() | (F.col("within") < F.col("a")))
        level = level.select("lang", "phrase", "a", "heads", "tails")
        out = level if out is None else out.unionByName(level)
    scored = out.join(F.broadcast(totals), "lang").withColumn("cut", _worst_cut(F.col("n")))
    best = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = scored.select("*", F.row_number().over(best).alias("rank")).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
