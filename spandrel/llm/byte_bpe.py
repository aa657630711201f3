"""Byte-level BPE by a file of ranks: encoding and decoding.

Pre-tokens. A text's pre-tokens are the matches of the pattern, found by Spark's regular expressions; `\\s` counts Unicode's white space.

Merging. A pre-token's bytes are merged in Spark's higher-order functions. Every span of its bytes that is a token is a
candidate; tasks find them in a trie, for a batch of pre-tokens at once. Candidates are folded in the order of their ranks over a bit set of the places where pieces
begin, and one is merged where exactly two pieces fill its span. For ranks that training gave, this is the merging of the
lowest-ranked neighbours first: when a token's turn comes, whatever fills its span has been merged as far as lower ranks go, which
are the token's own two parts. The set has a byte for each place instead of a bit in pre-tokens above WIDEST bytes.

Words met often. Pre-tokens are counted over the whole corpus; the at most FREQUENT most frequent ones are merged once and their ids sent to every
task (their number and length are bounded), in PARTS that tasks have packed and the driver passes on one by one. Any other is merged where it stands. What is in that table changes no result.

Decoding. Each id's bytes come from a literal array, as a string of one character per byte; they are joined and turned into binary.

Defined cases: a null or empty text has no ids and decodes to no bytes; null ids decode to no bytes, an id outside the vocabulary or null to nothing; texts of any length
are taken whole; rows are independent, so repeated rows are encoded alike; an empty table gives an empty result; other columns are
carried if asked for, else ignored, whatever their names.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Shared, fresh, scratch, stored
from .exchange import pack, pack_sorted, unpack, unpack_sorted
from .textops import blocks, span_hashes, string_parts

#: Spans of longer pre-tokens have no bit set of their own.
WIDEST = 62
#: So many pre-tokens at most are kept with their ids in every task.
FREQUENT = 1_500_000
#: They travel in so many parts.
PARTS = 24
#: Bytes of pre-tokens that are counted together, and that are looked up together; longer texts are taken alone.
COUNTED, LOOKED_UP = 8 << 20, 1 << 20
#: A place among the spans of a pre-token: 64 times its first byte, and its number of bytes.
_STEP = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks: a line has a token in base 64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _literal(value, kind: str) -> Column:
    """A constant that the optimiser folds into a literal."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Spans:
    """The tokens as a trie. A node's number is 1 more than the place of the edge to it among all edges, which are sorted by node and byte."""

    def __init__(self, ranks: dict[bytes, int]):
        edges, nodes, node = [], {b"": 0}, 0
        self.rank = [-1]
        for n in range(1, max(map(len, ranks), default=0) + 1):
            below = {}
            for t in sorted({t[:n] for t in ranks if len(t) >= n}, key=lambda t: (nodes[t[:-1]], t[-1])):
                below[t] = node = node + 1
                edges.append(nodes[t[:-1]] << 8 | t[-1])
                self.rank.append(ranks.get(t, -1))
            nodes = below
        self.edges, self.rank = np.array(edges, np.int64), np.array(self.rank, np.int64)
        heads = self.edges[self.edges < 256]
        self.first = np.zeros(256, np.int64)  # the nodes of single bytes
        self.first[heads] = np.arange(1, len(heads) + 1)

    def found(self, offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, first byte in it, number of bytes, rank) of every span of a word that is a token, by word, rank and place."""
        end = np.repeat(offsets[1:], np.diff(offsets))
        at, node, n, out = np.arange(len(raw)), self.first[raw], 1, []
        while len(at):
            rank = self.rank[node]
            token = rank >= 0
            out.append((at[token], np.full(np.count_nonzero(token), n), rank[token]))
            more = (node > 0) & (at + n < end[at])
            at, edge = at[more], node[more] << 8
            edge |= raw[at + n]
            place = np.searchsorted(self.edges, edge)
            there = self.edges[np.minimum(place, len(self.edges) - 1)] == edge
            at, node, n = at[there], place[there] + 1, n + 1
        at, size, rank = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        word = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[at]
        order = np.argsort(word << 32 | rank, kind="stable")  # a rank has one length, so its places ascend
        word, at = word[order], at[order]
        return word, at - offsets[word], size[order], rank[order]

    def of(self, words: pa.Array) -> pa.StructArray:
        """The spans of each pre-token, null for null, as Ranks.with_ids takes them."""
        offsets, raw = string_parts(words)
        size = np.diff(offsets)
        word, at, n, rank = self.found(offsets, raw)

        def lists(those: np.ndarray, values: pa.Array) -> pa.ListArray:
            ends = np.concatenate([[0], np.cumsum(np.bincount(word[those], minlength=len(words)))])
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

        short = size[word] <= WIDEST
        bits = lists(short, pa.array(rank[short] << 12 | at[short] * _STEP | n[short]))
        columns = [pa.array(x[~short], pa.int32()) for x in (at, n, rank)]
        places = lists(~short, pa.StructArray.from_arrays(columns, ["at", "size", "id"]))
        return pa.StructArray.from_arrays([pa.array(size, pa.int32()), bits, places], ["size", "bits", "places"], mask=words.is_null())


class Ranks:
    """Tokens and their ranks: tasks look spans up, a fold merges them, a literal array decodes."""

    #: A pre-token's number of bytes and its spans that are tokens, by rank: the rank, 12 bits higher, and the place; of longer pre-tokens the place, size and rank.
    SPANS = "struct<size int, bits array<bigint>, places array<struct<at int, size int, id int>>>"

    def __init__(self, ranks: dict[bytes, int]):
        self.spans = Spans(ranks)
        places = [divmod(c, _STEP) for c in range(_STEP * _STEP)]
        masks = lambda f: [f(i, i + n) if n and i + n <= WIDEST else 0 for i, n in places]
        value = {
            "starts": [(1 << (n + 1)) - 1 for n in range(WIDEST + 1)],
            "ends": masks(lambda a, b: 1 << a | 1 << b),
            "inner": masks(lambda a, b: (1 << b) - (1 << (a + 1))),
            "outside": masks(lambda a, b: ~((1 << b) - (1 << (a + 1)))),
        }
        #: for each length all begin bits; for each place the bits at its ends, within it and all others
        self.table = _literal(value, "starts array<bigint>, ends array<bigint>, inner array<bigint>, outside array<bigint>")
        self.pieces = _literal([t.decode("latin-1") for t in sorted(ranks, key=ranks.get)], "array<string>") if sorted(ranks.values()) == list(range(len(ranks))) else None

    def _folded(self, table: Column, word: Column) -> Column:
        """The ids of a pre-token of at most WIDEST bytes."""
        place = lambda c: c.bitwiseAND(_STEP * _STEP - 1).cast("int")

        def filled(begins: Column, at: Column, n: int) -> Column:
            """Whether so many pieces fill a span."""
            return (F.bit_count(begins.bitwiseAND(F.get(table.inner, at))) == n - 1) & (F.bit_count(begins.bitwiseAND(F.get(table.ends, at))) == 2)

        def step(begins: Column, c: Column) -> Column:
            at = place(c)
            return F.when(filled(begins, at, 2), begins.bitwiseAND(F.get(table.outside, at))).otherwise(begins)

        def ids(begins: Column) -> Column:
            left = F.transform(F.filter(word.bits, lambda c: filled(begins, place(c), 1)), lambda c: F.shiftleft(place(c).cast("long"), 32).bitwiseOR(F.shiftright(c, 12)))
            return F.transform(F.sort_array(left), lambda x: x.bitwiseAND((1 << 32) - 1).cast("int"))

        return _let(F.aggregate(word.bits, F.get(table.starts, word["size"]), step), ids)

    def _folded_long(self, word: Column) -> Column:
        """The ids of a pre-token of any length: the set has a byte for each place, 1 where a piece begins."""
        span = lambda begins, s: F.substring(begins, s["at"] + 1, s["size"] + 1).cast("string")
        zeros = lambda s: F.repeat(F.lit("0"), s["size"] - 1).cast("binary")

        def step(begins: Column, s: Column) -> Column:
            return F.when(span(begins, s).rlike("^10*10*1$"), F.overlay(begins, zeros(s), s["at"] + 2)).otherwise(begins)

        def ids(begins: Column) -> Column:
            return F.transform(F.sort_array(F.filter(word.places, lambda s: span(begins, s).rlike("^10*1$"))), lambda s: s["id"])

        return _let(F.aggregate(word.places, F.repeat(F.lit("1"), word["size"] + 1).cast("binary"), step), ids)

    def with_ids(self, body: Callable[[Callable[[Column], Column]], Column]) -> Column:
        """body(ids), where ids gives a pre-token's ids from its spans. The literal masks stand once in the expression, however often they are used."""

        def ids(table: Column) -> Callable[[Column], Column]:
            return lambda word: F.when(word["size"] <= WIDEST, self._folded(table, word)).otherwise(self._folded_long(word))

        return _let(self.table, lambda table: body(ids(table)))

    def decoded(self, ids: Column) -> Column:
        """The bytes that an array of ids stands for."""
        if self.pieces is None:
            raise ValueError("ranks don't run from 0 without gaps")
        return F.encode(F.array_join(F.transform(F.coalesce(ids, F.array().cast("array<int>")), lambda i: F.get(self.pieces, i)), ""), "ISO-8859-1")


def pretokens(text: Column, pattern: str) -> Column:
    """The matches of the pattern, in order; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + pattern), F.lit(0))


def _hashes(offsets: np.ndarray, raw: np.ndarray, seed: int = 1) -> np.ndarray:
    """The hash of each string, a block of them at a time."""
    parts = [span_hashes(raw[offsets[a] : offsets[b]], offsets[a:b] - offsets[a], offsets[a + 1 : b + 1] - offsets[a], seed) for a, b in blocks(offsets)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _slices(lists: pa.ListArray, size: int) -> Iterator[pa.ListArray]:
    """A column of lists of strings in runs of at most so many bytes together."""
    first = np.asarray(lists.offsets, np.int64) - lists.offsets[0].as_py()
    at, _ = string_parts(lists.flatten())
    for a, b in blocks(at[first], size):
        yield lists.slice(a, b - a)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lists in _slices(batch.column(0), COUNTED):
            words = lists.flatten()
            if len(words):
                word, n = pc.value_counts(words).flatten()
                yield pa.RecordBatch.from_arrays([word.cast(pa.string()), n], names=["word", "n"])


class Known:
    """The ids of frequent pre-tokens, by two hashes of their bytes."""

    def __init__(self, parts: list[tuple[int, int, bytes, bytes]]):
        n, n_ids = (sum(x[k] for x in parts) for k in (0, 1))
        self.key, self.check, self.size, self.ids = np.empty(n, np.uint64), np.empty(n, np.uint64), np.empty(n, np.uint8), np.empty(n_ids, np.int32)
        at = to = 0
        for m, m_ids, heads, ids in parts:  # no part outlives its turn
            self.key[at : at + m], self.check[at : at + m], self.size[at : at + m] = unpack_sorted(heads, "<u8", "u1")
            (self.ids[to : to + m_ids],) = unpack(ids, "<i4")
            at, to = at + m, to + m_ids
        order = np.argsort(self.key, kind="stable")
        self.first = (np.cumsum(self.size, dtype=np.int64) - self.size)[order]
        for name in ("key", "check", "size"):
            setattr(self, name, getattr(self, name)[order])

    @staticmethod
    def packed(words: pa.Array, ids: pa.ListArray) -> tuple[int, int, bytes, bytes]:
        """A part of words of at most WIDEST bytes: how many words and ids, the words' hashes and numbers of ids, and the ids."""
        offsets, raw = string_parts(words)
        key = _hashes(offsets, raw)
        order = np.argsort(key)
        ids = ids.take(pa.array(order))
        heads = pack_sorted(key[order], _hashes(offsets, raw, 2)[order], np.diff(np.asarray(ids.offsets)).astype(np.uint8))
        ids = np.asarray(ids.flatten(), np.int32)
        return len(key), len(ids), heads, pack(ids)

    def find(self, offsets: np.ndarray, raw: np.ndarray, place: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Where each string is kept, -1 if it isn't."""
        if not len(self.key):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.key, h), len(self.key) - 1)
        size = (offsets[1:] - offsets[:-1])[place]
        order = np.argsort(place)  # spans ascend
        check = np.empty(len(h), np.uint64)
        check[order] = span_hashes(raw, offsets[:-1][place][order], (offsets[:-1][place] + size)[order], 2)
        return np.where((self.key[at] == h) & (self.check[at] == check), at, -1)


def _parts(known: Known, spans: Spans, lists: pa.ListArray) -> pa.Array:
    """For each list of pre-tokens, runs of known ids, each with the spans of the unknown pre-token after it (null after the last run)."""
    words = lists.flatten()
    size = np.diff(np.asarray(lists.offsets, np.int64))
    coded = words.dictionary_encode()
    offsets, raw = string_parts(coded.dictionary)
    at = known.find(offsets, raw, np.arange(len(coded.dictionary)), _hashes(offsets, raw))[np.asarray(coded.indices)]
    doc = np.repeat(np.arange(len(lists)), size)
    new = at < 0
    n_parts = np.bincount(doc[new], minlength=len(lists)) + 1
    part_of_doc = np.concatenate([[0], np.cumsum(n_parts)])
    part = doc + np.cumsum(new) - new
    n = np.where(new, 0, known.size[at]).astype(np.int64) if len(known.key) else np.zeros(len(at), np.int64)
    n_ids = np.bincount(part, weights=n, minlength=part_of_doc[-1]).astype(np.int64)
    which = np.repeat(at, n)
    end = np.cumsum(n)
    ids = known.ids[known.first[which] + np.arange(len(which)) - np.repeat(end - n, n)]
    word = np.full(part_of_doc[-1], -1)
    word[part[new]] = np.flatnonzero(new)
    taken = spans.of(words.take(pa.array(word, pa.int64(), mask=word < 0)))
    runs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_ids)]), pa.int32()), pa.array(ids, pa.int32()))
    return pa.ListArray.from_arrays(pa.array(part_of_doc, pa.int32()), pa.StructArray.from_arrays([runs, taken], ["ids", "word"]))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if found := list(batches):
        words, ids = (c.combine_chunks() for c in pa.Table.from_batches(found).columns)
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in Known.packed(words, ids)], names=["n", "n_ids", "heads", "ids"])


def frequent(docs: DataFrame, ranks: Ranks, text: str, pattern: str) -> list[Broadcast]:
    """Parts of the ids of the pre-tokens that are most frequent in all texts: all from some count on, at most FREQUENT."""
    words = docs.select(pretokens(F.col(text), pattern).alias("words")).mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    with scratch(docs.sparkSession):
        words = stored(words.filter(F.octet_length("word") <= WIDEST), "bpe-words")
        levels = words.groupBy(F.least("n", F.lit(1000)).alias("n")).agg(F.count("*").alias("kinds")).orderBy(F.desc("n")).collect()
        least, total = 1 << 62, 0
        for level in levels:  # at most 1000
            total += level.kinds
            if total > FREQUENT:
                break
            least = level.n
        shared = Shared(docs.sparkSession, ranks.spans)

        def spans(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), shared.value.of(batch.column(0))], names=["word", "spans"])

        found = words.filter(F.col("n") >= least).select("word").repartition(PARTS).mapInArrow(spans, f"word string, spans {Ranks.SPANS}")
        # stored in between, so that no task needs two Python workers
        found = stored(found.select("word", ranks.with_ids(lambda ids: ids(F.col("spans"))).alias("ids")), "bpe-ids")
        parts = stored(found.repartition(PARTS).mapInArrow(_packed, "n long, n_ids long, heads binary, ids binary"), "bpe-frequent")
        return [docs.sparkSession.sparkContext.broadcast((x.n, x.n_ids, bytes(x.heads), bytes(x.ids))) for x in parts.toLocalIterator()]


def encode(docs: DataFrame, ranks: Ranks, pattern: str, text: str = "text", carry: list[str] | None = None, out: str = "ids") -> DataFrame:
    """The columns of carry, and every text's ids as an array of int."""
    carry = [] if carry is None else carry
    words, parts = fresh(docs, "words"), fresh(docs, "parts")
    shared, spans = frequent(docs, ranks, text, pattern), Shared(docs.sparkSession, ranks.spans)

    def split(batches):
        known = None
        for batch in batches:
            known = known or Known([part.value for part in shared])
            *others, lists = batch.columns
            at = 0
            for some in _slices(lists, LOOKED_UP):
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(some)) for c in others), _parts(known, spans.value, some)], names=[*batch.schema.names[:-1], parts])
                at += len(some)

    kept = docs.select(*carry, pretokens(F.col(text), pattern).alias(words))
    schema = StructType([*kept.select(*carry).schema.fields, *StructType.fromDDL(f"{parts} array<struct<ids array<int>, word {Ranks.SPANS}>>").fields])
    whole = F.flatten(ranks.with_ids(lambda ids: F.transform(parts, lambda p: F.when(p.word.isNull(), p.ids).otherwise(F.concat(p.ids, ids(p.word))))))
    return kept.mapInArrow(split, schema).select(*carry, whole.alias(out))
