"""Language-model scores of whole documents, learnt from the corpus itself.

The model is an order-3 trie (lm_trie) of all the corpus's words and n-grams: none is pruned, capped or estimated from a part.
It is never in one place. Every chunk of documents gets the trie of the n-grams that its own texts hold, with the
counts of the whole corpus, and is scored by it; as smoothing needs an n-gram's and its context's counts only, these tries agree.

1. Chunks send their different words by hash to shards, which gives the number of training tokens and of different words.
2. Chunks send their different bigrams and trigrams with their training counts, as sorted hashes of BITS more bits
   than the text has, to shards of the hash space, their different words apart from those, as full hashes of 64 bits, and their own words in order to themselves.
3. A shard adds the counts and answers each chunk, in the chunk's order.
4. A chunk builds its trie and returns its documents' scores.

However frequent an n-gram or a context, a chunk sends it once, and no shard gathers the successors of a context; a shard's size doesn't
grow with the corpus, their number does. A document is in one chunk, so memory follows the longest text.

Base score: unigrams with one added. Defined cases: a null or empty text is its end token alone; repeated rows are scored
alike and trained on as often as they stand; equal texts get equal scores; an empty table gives an empty result; without training
documents every word is unknown; a null doc_id counts as the empty string for the split; other columns are ignored.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .exchange import pack, pack_sorted, runs, shards_of, unpack, unpack_sorted
from .lm_trie import Counts, Trie
from .textops import Words, blocks, mix64, string_parts

#: Documents and bytes of text to a chunk, and about how many n-grams to a shard.
CHUNK, CHUNK_BYTES = 4096, 4 << 20
SHARD = 2_000_000
#: Hashes have so many bits more than the number of bytes of all texts: about one n-gram in ten thousand meets another.
BITS, LEAST_BITS = 12, 40
#: The split: of crc32(doc_id) modulo 7, this remainder is held out.
FOLDS, HELD = 7, 2
#: Word numbers within a chunk: before a text, its end, and the first word.
BEGIN, END, FIRST = 0, 1, 2
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def held_out(ids: list) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS == HELD for i in ids], bool)


def _chunks(batches):
    """(number, ids, held-out flags, words of each text, hash of each word, in order) of chunks of rows (doc_id, text)."""
    number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 28
    for batch in batches:
        offsets, raw = string_parts(batch.column(1))
        for x, y in blocks(offsets, CHUNK_BYTES):
            for lo in range(x, y, CHUNK):
                hi = min(lo + CHUNK, y)
                ids = batch.column(0).slice(lo, hi - lo)
                parts = []
                for a, b in blocks(offsets[lo : hi + 1]):
                    w = Words(offsets[lo + a : lo + b + 1] - offsets[lo + a], raw[offsets[lo + a] : offsets[lo + b]])
                    parts.append((np.diff(w.first), w.hashes()))
                size, h = (np.concatenate(p) for p in zip(*parts, strict=True))
                yield number, ids, held_out(ids.to_pylist()), size.astype(np.int64), h
                number += 1


def count_tokens(docs: DataFrame, shards: int) -> DataFrame:
    """tokens and kinds (training words and different ones, by shard of the hash space) and all_tokens (of all documents)."""

    def send(batches):
        for _, _, held, size, h in _chunks(batches):
            h, n = np.unique(h[np.repeat(~held, size)], return_counts=True)
            cut = np.searchsorted((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32), np.arange(shards + 1, dtype=np.uint64))
            rows = [(s, pack_sorted(h[x:y], n[x:y].astype(np.uint32)), 0) for s, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if y > x]
            s, w, a = zip(*[*rows, (0, None, int(size.sum()))], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(w, pa.binary()), pa.array(a, pa.int64())], names=["shard", "words", "tokens"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack_sorted(b, "<u4") for b in group["words"] if b is not None]
        kinds = len(np.unique(np.concatenate([p[0] for p in parts]))) if parts else 0
        return pd.DataFrame({"tokens": [sum(int(p[1].sum()) for p in parts)], "kinds": [kinds], "all_tokens": [int(group["tokens"].sum())]})

    return docs.mapInArrow(send, "shard int, words binary, tokens long").groupBy("shard").applyInPandas(add, "tokens long, kinds long, all_tokens long")


class Plan(NamedTuple):
    """tokens and kinds: of the training documents, with their ends; shards and bits of the n-grams' hash space, and shards of the words', which are numbered after those."""

    n_docs: int
    tokens: int
    kinds: int
    shards: int
    bits: int
    word_shards: int


class Grams:
    """The different n-grams of a chunk. words: the hashes of its different words by their numbers; seq: its texts' word numbers, each text with its end."""

    def __init__(self, words: np.ndarray, seq: np.ndarray, doc: np.ndarray):
        self.size = size = len(words) + FIRST
        new = np.concatenate([[True], doc[1:] != doc[:-1]])
        w2 = np.concatenate([[BEGIN], seq[:-1]])
        w2[new] = BEGIN
        # each level by its context, and an event's place in it
        self.pairs, self.pair_of = np.unique(w2 * size + seq, return_inverse=True)
        # an event's context w1 w2 is the bigram of the event before it; before a text's first word there is the beginning alone
        c1, c2 = self.pairs // size, self.pairs % size
        leads = np.flatnonzero(c2 != END)
        leads = leads[np.argsort((c2 * size + c1)[leads])]
        self.as_pair = np.concatenate([[0], leads])
        c1, c2 = (np.concatenate([[BEGIN], c[leads]]) for c in (c1, c2))
        self.contexts = c2 * size + c1
        self.first = np.arange(len(leads) + 1) == 0
        place = np.zeros(len(self.pairs), np.int64)
        place[leads] = np.arange(1, len(leads) + 1)
        of = np.concatenate([[0], place[self.pair_of[:-1]]])
        of[new] = 0
        self.triples, self.triple_of = np.unique(of * size + seq, return_inverse=True)
        self.pair_of_triple = np.empty(len(self.triples), np.int64)
        self.pair_of_triple[self.triple_of] = self.pair_of
        self.seq = seq
        h = np.concatenate([np.array([3, 5], np.uint64), words])
        two = mix64(h[self.pairs // size] * _SEEDS[0] + h[self.pairs % size] * _SEEDS[1])
        t = self.triples // size
        three = mix64(h[c1[t]] * _SEEDS[2] + mix64(h[c2[t]] * _SEEDS[0] + h[self.triples % size] * _SEEDS[1]))
        self.words, self.hashes = h, np.concatenate([two, three])

    def counts(self, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each word, and how often each bigram and trigram occurs in the training texts of the chunk."""
        n = [np.bincount(x[train], minlength=m) for x, m in ((self.seq, self.size), (self.pair_of, len(self.pairs)), (self.triple_of, len(self.triples)))]
        return n[0], np.concatenate(n[1:])

    def orders(self, plan: Plan) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of words and of n-grams: in the order of their hashes, these, and where each shard's begin."""
        return _in_order(self.words, 64, plan.word_shards), _in_order(self.hashes, plan.bits, plan.shards)


def _in_order(hashes: np.ndarray, bits: int, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key = hashes >> np.uint64(64 - bits)
    order = np.argsort(key)  # equal hashes are asked and answered alike, in whatever order
    key = key[order]
    return order, key, np.searchsorted((key >> np.uint64(bits - 32)) * np.uint64(shards) >> np.uint64(32), np.arange(shards + 1, dtype=np.uint64))


def _ranked(often: np.ndarray) -> np.ndarray:
    """The order in which a chunk's words are numbered: the most frequent first, so that numbers are small."""
    return np.argsort(-often.astype(np.int64), kind="stable")


def _asked(plan: Plan, batches):
    """Rows of chunks for the shards (own null), and each chunk's own row for itself, under a shard below zero."""
    for number, ids, held, size, h in _chunks(batches):
        words, at, often = np.unique(h, return_inverse=True, return_counts=True)
        rank = _ranked(often)
        doc = np.repeat(np.arange(len(ids)), size + 1)
        seq = np.full(len(doc), END, np.int64)
        seq[np.arange(len(h)) + np.repeat(np.arange(len(ids)), size)] = np.argsort(rank)[at] + FIRST
        grams = Grams(words[rank], seq, doc)
        known = np.array([0 if i is None else i for i in ids.to_pylist()], np.int64)
        none = np.array([i is None for i in ids.to_pylist()], bool)
        rows = [(-1 - number, number, pack_sorted(words, often.astype(np.uint32)), pack(seq.astype(np.uint32)), pack(known, size, held, none))]
        for (order, key, cut), n, base in zip(grams.orders(plan), grams.counts(~held[doc]), (plan.shards, 0), strict=True):
            n = n[order].astype(np.uint32)
            rows += [(base + s, number, pack_sorted(key[x:y], n[x:y]), None, None) for s, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if y > x]
        columns = zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["shard", "chunk", "grams", "seq", "docs"])


def _answered(group: pd.DataFrame) -> pd.DataFrame:
    """The corpus's count of each n-gram that a chunk asked for, in its order. A chunk's own row passes through."""
    if group["shard"].iloc[0] < 0:
        return group
    parts = [unpack_sorted(g, "<u4") for g in group["grams"]]
    size = np.array([len(p[0]) for p in parts])
    key = np.concatenate([p[0] for p in parts])
    n = np.concatenate([p[1] for p in parts]).astype(np.int64)
    order = np.argsort(key, kind="stable")
    at = runs(key[order])
    total = np.empty(len(key), np.int64)
    total[order] = np.repeat(np.add.reduceat(n[order], at), np.diff(np.append(at, len(key))))
    end = np.cumsum(size)
    return group.assign(grams=[pack(total[y - k : y]) for k, y in zip(size, end, strict=True)])


def _scored(plan: Plan, group: pd.DataFrame) -> pd.DataFrame:
    mine = group["shard"] < 0
    own = group[mine].iloc[0]
    known, size, held, none = unpack(own["docs"], "<i8", "<i8", "?", "?")
    words, often = unpack_sorted(own["grams"], "<u4")
    words = words[_ranked(often)]
    seq = unpack(own["seq"], "<u4")[0].astype(np.int64)
    doc = np.repeat(np.arange(len(known)), size + 1)
    g = Grams(words, seq, doc)
    answers, counts = group[~mine].sort_values("shard"), []
    for (order, _, _), own_kind in zip(g.orders(plan), (answers["shard"] >= plan.shards, answers["shard"] < plan.shards), strict=True):
        count = np.empty(len(order), np.int64)
        count[order] = np.concatenate([unpack(b, "<i8")[0] for b in answers["grams"][own_kind]])
        counts.append(count)
    c1, (c2, c3) = counts[0], np.split(counts[1], [len(g.pairs)])
    # each training text begins once
    follows = c1.copy()
    follows[BEGIN], follows[END] = plan.n_docs, 0
    of, w3 = g.triples // g.size, g.triples % g.size
    # an n-gram occurs no more often than its parts, even where its hash has met another's
    c2 = np.minimum(c2, np.minimum(follows[g.pairs // g.size], c1[g.pairs % g.size]))
    n2 = np.where(g.first, plan.n_docs, c2[g.as_pair])
    c3 = np.minimum(c3, np.minimum(n2[of], c2[g.pair_of_triple]))
    one, two, there = np.flatnonzero(follows), n2 > 0, c3 > 0
    place = np.cumsum(two) - 1
    w2, w1 = g.contexts // g.size, g.contexts % g.size
    seen = c2 > 0
    pair = (np.cumsum(seen) - 1)[g.pair_of_triple[there]]
    counts = Counts(g.size, one, follows[one], g.pairs[seen], c2[seen], w1[two], w2[two], n2[two], place[of[there]], w3[there], pair, c3[there])
    trie = Trie(counts, (c1 + 1) / (plan.tokens + plan.kinds + 1))
    score = trie.scores(g.pairs, g.contexts, g.pair_of_triple, of, w3)[g.triple_of]
    n = len(known)
    doc_ids = pd.array(known, "Int64")
    doc_ids[none] = pd.NA
    return pd.DataFrame(
        {
            "doc_id": doc_ids,
            "held_out": held,
            "n_tokens": size + 1,
            "n_known": np.bincount(doc, weights=c1[seq] > 0, minlength=n).astype(np.int64),
            "train_tokens": plan.tokens,
            "base_score": np.bincount(doc, weights=np.log10(c1[seq] + 1.0), minlength=n) - (size + 1) * np.log10(plan.tokens + plan.kinds + 1),
            "score": np.bincount(doc, weights=score, minlength=n),
        }
    )


def lm_scores(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = docs.sparkSession
    docs = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text"))
    trained = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) != HELD
    seen = docs.agg(F.count(F.when(trained, 1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = shards_of(int(seen["size"]), 1 << 26, tasks)
    told = stored(count_tokens(docs, shards), "lm-words").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "kinds", "all_tokens")]).first()
    n_docs = int(seen["n"])
    bits = min(64, max(LEAST_BITS, BITS + int(seen["size"]).bit_length()))
    grams = shards_of(2 * int(told["all_tokens"]), SHARD, tasks)
    plan = Plan(n_docs, int(told["tokens"]) + n_docs, int(told["kinds"]) + (n_docs > 0), grams, bits, shards_of(int(told["all_tokens"]) // 2, SHARD, tasks))
    schema = "shard long, chunk long, grams binary, seq binary, docs binary"
    asked = docs.mapInArrow(lambda batches: _asked(plan, batches), schema)
    answers = asked.groupBy("shard").applyInPandas(_answered, schema)
    columns = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return answers.groupBy("chunk").applyInPandas(lambda g: _scored(plan, g), columns)
