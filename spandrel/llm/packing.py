"""Packing documents into sequences: tokens, best fit, and a swap-based local search.

Tokens. The tokenizer splits text into pre-tokens before it merges, so equal pre-tokens always give equal ids. Each block
of texts is cut at white space into units (a word with the single space before it, or a run of white space), every different unit
is encoded once, and the ids are laid out again. Texts with white space beyond ASCII, or with one of the tokenizer's own added
tokens, are encoded whole.

Cutting. A document is its ids and an end id. Longer ones are cut into full sequences; their first piece is the
remainder. A full piece is a sequence by itself.

Packing. The other pieces are dealt by hash into groups of about GROUP pieces, so a task's memory is bounded and
each group wastes at most its own last bins. A group is packed best-fit decreasing; then underfull bins are searched: a
document moves to a fuller bin that has room, one is exchanged for one, or two small ones for one large, whenever that raises the
sum of squared fills, until a pass over all of them finds no change. Emptied bins disappear.

Defined cases: a null or empty text is the end id alone; texts of any length are handled whole; repeated rows are
packed as separate documents, and so are rows that share a doc_id or have none; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .textops import blocks, span_hashes, string_parts

SEQUENCE = 2048
END_ID = 0
GROUP = 30_000
#: Local search takes underfull bins in windows of so many, each half over the one before.
BENCH = 256
#: Bytes of text that are cut into units together.
BLOCK = 2 << 20


def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer's file, loaded once a worker; it keeps what it has learnt from task to task."""
    import tokenizers

    loaded = tokenizers.__dict__.setdefault("_encoders", {})
    if path not in loaded:
        loaded[path] = Encoder(path)
    return loaded[path]


class Encoder:
    """ids of whole texts. Different units are encoded once a worker and kept; the store is emptied when it has grown too large."""

    KEEP = 1_000_000

    def __init__(self, path: str):
        import tokenizers

        self.tokenizer = t = tokenizers.Tokenizer.from_file(path)
        # the number of bytes that each id stands for, and the strings that become one id wherever they stand
        self.bytes_of = np.array([len(s) for _, s in sorted((i, s) for s, i in t.get_vocab(with_added_tokens=False).items())], np.int64)
        self.added = [x.content.encode() for x in t.get_added_tokens_decoder().values()]
        self._reset()

    def _reset(self):
        self.keys = np.zeros(0, np.uint64)
        self.first = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, keys: np.ndarray, units: list[bytes]) -> None:
        """Encode the units, each alone; those that begin with a space and go on with none are encoded as one text."""
        alone = np.array([len(u) < 2 or u[0] != 32 or u[1] in _SPACES for u in units], bool)
        joined, rest = np.flatnonzero(~alone), np.flatnonzero(alone)
        ids = self.plain(b"".join([units[k] for k in joined]).decode("utf-8"))
        ends = np.cumsum(self.bytes_of[ids])
        want = np.cumsum([len(units[k]) for k in joined])
        at = np.minimum(np.searchsorted(ends, want), max(len(ends) - 1, 0))
        if len(joined) and (ends[-1] != want[-1] or (ends[at] != want).any()):  # a unit was not taken alone
            joined, rest, ids, at = joined[:0], np.arange(len(units)), ids[:0], at[:0]
        more = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([units[k].decode("utf-8") for k in rest], add_special_tokens=False)]
        n = np.concatenate([np.diff(self.first), np.diff(at, prepend=-1), [len(m) for m in more]]).astype(np.int64)
        every = np.concatenate([self.keys, keys[joined], keys[rest]])
        ids = np.concatenate([self.ids, ids, *more])
        begin = np.cumsum(n) - n
        order = np.argsort(every, kind="stable")
        self.keys, n2 = every[order], n[order]
        at = np.repeat(begin[order], n2) + (np.arange(n2.sum()) - np.repeat(np.cumsum(n2) - n2, n2))
        self.ids, self.first = ids[at], np.concatenate([[0], np.cumsum(n2)])

    def block(self, offsets: np.ndarray, raw: np.ndarray) -> list[np.ndarray]:
        """The ids of each text of a block."""
        n_docs = len(offsets) - 1
        odd = np.zeros(n_docs, bool)
        data = raw.tobytes()
        hits = np.concatenate([_odd_space(raw), *(_places(data, a) for a in self.added)])
        if len(hits):
            odd[np.searchsorted(offsets, hits, "right") - 1] = True
        space = _IS_SPACE[raw]
        n = len(raw)
        if not n:
            return [np.zeros(0, np.uint32)] * n_docs
        begins_text = np.zeros(n + 1, bool)
        begins_text[offsets] = True
        begins_text = begins_text[:n]
        prev = np.concatenate([[False], space[:-1]])
        prev[begins_text] = False
        word = ~space & (prev | begins_text | np.concatenate([[True], np.zeros(n - 1, bool)]))
        at = np.flatnonzero(word)
        # a single blank before a word belongs to it
        lead = (at > 0) & ~begins_text[at] & (raw[np.maximum(at - 1, 0)] == 32) & space[np.maximum(at - 1, 0)]
        unit = begins_text.copy()
        unit[at[~lead]] = True
        unit[at[lead] - 1] = True
        # white space that is not such a blank: a run of k before a word is k - 1 together and then the last one alone
        run = space & ~prev
        unit[run] = True
        last = space & np.concatenate([~space[1:], [False]])
        last[np.concatenate([begins_text[1:], [True]])] = False
        unit[last] = True
        start = np.flatnonzero(unit)
        end = np.concatenate([start[1:], [n]])
        doc = np.searchsorted(offsets, start, "right") - 1
        usual = ~odd[doc]
        start, end, doc = start[usual], end[usual], doc[usual]
        key = span_hashes(raw, start, end, 7)
        different, where = np.unique(key, return_index=True)
        if len(self.keys) > self.KEEP:
            self._reset()
        pos = np.minimum(np.searchsorted(self.keys, different), max(len(self.keys) - 1, 0))
        fresh = self.keys[pos] != different if len(self.keys) else np.ones(len(different), bool)
        if fresh.any():
            w = where[fresh]
            self._learn(different[fresh], [data[a:b] for a, b in zip(start[w].tolist(), end[w].tolist(), strict=True)])
        pos = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        count = np.diff(self.first)[pos] if len(self.keys) else np.zeros(len(key), np.int64)
        out_at = np.repeat(self.first[:-1][pos], count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) if len(self.keys) else np.zeros(0, np.int64)
        ids = self.ids[out_at]
        total = np.bincount(doc, weights=count, minlength=n_docs).astype(np.int64)
        parts = np.split(ids, np.cumsum(total)[:-1])
        for d in np.flatnonzero(odd):
            parts[d] = self.plain(raw[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8"))
        return parts


_SPACES = (0x20, *range(0x09, 0x0E))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(_SPACES)] = True


def _odd_space(raw: np.ndarray) -> np.ndarray:
    """Where a text may hold white space beyond the six ASCII characters: 1C-1F, and what UTF-8 writes C2 85, C2 A0, E1 9A, E2 80, E2 81, E3 80."""
    lone = np.flatnonzero((raw >= 0x1C) & (raw <= 0x1F))
    if len(raw) < 2:
        return lone
    a, b = raw[:-1], raw[1:]
    two = ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A)) | ((a == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((a == 0xE3) & (b == 0x80))
    return np.concatenate([lone, np.flatnonzero(two)])


def _places(data: bytes, what: bytes) -> np.ndarray:
    out, at = [], data.find(what)
    while at >= 0:
        out.append(at)
        at = data.find(what, at + 1)
    return np.array(out, np.int64)


def pieces(docs: DataFrame, path: str, ident: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and with_ids the ids as bytes."""

    def run(batches):
        known = encoder(path)
        for batch in batches:
            offsets, raw = string_parts(batch.column(1))
            ident = batch.column(0)
            for a, b in blocks(offsets, BLOCK):
                out = []
                for k, ids in enumerate(known.block(offsets[a : b + 1] - offsets[a], raw[offsets[a] : offsets[b]])):
                    ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                    rest = len(ids) % SEQUENCE or SEQUENCE
                    begin = 0
                    for p, stop in enumerate(range(rest, len(ids) + 1, SEQUENCE)):
                        part = ids[begin:stop].tobytes()
                        out.append((a + k, p, begin, stop - begin, zlib.crc32(part), part))
                        begin = stop
                i, p, s, n, c, x = zip(*out, strict=True)
                i = pa.array(i, pa.int64())
                columns = [ident.take(i), pa.array(p, pa.int32()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(x, pa.binary())] if with_ids else []), names=names + (["ids"] if with_ids else []))

    given = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return given.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def best_fit(lengths: np.ndarray, size: int = SEQUENCE) -> list[list[int]]:
    """Best-fit decreasing: indexes of each bin. Bins are kept by the room they have, of which there are at most size kinds."""
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []
    bins: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        at = bisect.bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
        else:
            room, b = size, len(bins)
            bins.append([])
        bins[b].append(i)
        room -= n
        if room:
            if not by_room.get(room):
                bisect.insort(rooms, room)
                by_room[room] = []
            by_room[room].append(b)
    return bins


def _offer(small: list[int], lengths: list[int]) -> tuple[list[int], list[tuple[int, tuple[int, ...]]]]:
    """What a bin can give: one document of each of its lengths, and two together, as sorted sums and the documents of each. Lengths of one bin sum to its
    size at most, so few differ."""
    of: dict[int, list[int]] = {}
    for i in sorted(small):
        of.setdefault(lengths[i], []).append(i)
    sizes = sorted(of)
    choices = [(n, (of[n][0],)) for n in sizes]
    for x, n in enumerate(sizes):
        choices += [(n + m, (of[n][0], of[m][0])) for m in sizes[:x]]
        if len(of[n]) > 1:
            choices.append((2 * n, tuple(of[n][:2])))
    choices.sort()
    return [c[0] for c in choices], choices


def _improve(small: list[int], large: list[int], lengths: list[int], room: int, offer) -> int:
    """One change that moves fill from the bin small to the fuller bin large, which has room: a move, or the exchange of one or two of small's
    documents (its offer) for one of large's. Raising the fuller bin raises the sum of squared fills. Returns by how much large grew."""
    keys, choices = offer
    best = None  # (gain, out of small, out of large)
    if keys[0] <= room:  # the largest single document that fits moves
        at = bisect.bisect_right(keys, room) - 1
        while len(choices[at][1]) > 1:
            at -= 1
        best = (keys[at], choices[at][1], None)
    else:
        for n, j in {lengths[j]: j for j in large}.items():
            at = bisect.bisect_right(keys, n + room) - 1
            if at >= 0 and keys[at] > n and (best is None or keys[at] - n > best[0]):
                best = (keys[at] - n, choices[at][1], j)
    if best is None:
        return 0
    gain, out, j = best
    for i in out:
        small.remove(i), large.append(i)
    if j is not None:
        large.remove(j), small.append(j)
    return gain


def local_search(bins: list[list[int]], lengths: np.ndarray, size: int = SEQUENCE) -> list[list[int]]:
    """Bins after moves and exchanges between underfull ones, without those that became empty.

    Windows over the underfull bins, least full first, are searched until a pass changes nothing, or until no fewer bins could hold the documents. Every
    change raises the sum of squared fills, so it ends.
    """
    known, least = lengths.tolist(), -(-int(lengths.sum()) // size)
    fill = [sum(known[i] for i in b) for b in bins]
    gained = True
    while gained and len(bins) > least:
        gained = False
        under = sorted((k for k in range(len(bins)) if fill[k] < size), key=fill.__getitem__)
        for start in range(0, max(1, len(under) - BENCH // 2), BENCH // 2):
            window = under[start : start + BENCH]
            for place, k in enumerate(window):
                offer = _offer(bins[k], known) if bins[k] else None
                for other in reversed(window[place + 1 :]):
                    while bins[k] and fill[other] < size and fill[k] <= fill[other]:
                        gain = _improve(bins[k], bins[other], known, size - fill[other], offer)
                        if not gain:
                            break
                        fill[k], fill[other], gained = fill[k] - gain, fill[other] + gain, True
                        offer = _offer(bins[k], known) if bins[k] else None
                    if not bins[k]:
                        break
        fill = [f for f, b in zip(fill, bins, strict=True) if b]
        bins = [b for b in bins if b]
    return bins


def pack_lengths(lengths: np.ndarray, size: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length."""
    bins = local_search(best_fit(lengths, size), lengths, size)
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for b, members in enumerate(bins):
        at = 0
        for i in members:
            where[i], offset[i] = b, at
            at += int(lengths[i])
    return where, offset


def pack(docs: DataFrame, path: str, ident: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of every piece."""
    # written at once, so that the rows' numbers stay
    found = stored(pieces(docs, path, ident, text, with_ids).withColumn("own", F.monotonically_increasing_id()), "pieces")
    part = found.filter(F.col("length") < SEQUENCE)
    groups = max(1, -(-part.count() // GROUP))
    keyed = part.select("own", "length").withColumn("group", F.pmod(F.xxhash64("own"), F.lit(groups)))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "own"], ascending=[False, True])
        where, offset = pack_lengths(group["length"].to_numpy())
        return pd.DataFrame({"own": group["own"], "sequence_id": group["group"] * (1 << 32) + where, "offset": offset})

    # small rows, but much work: a task for each group
    placed = keyed.repartition(groups, "group").groupBy("group").applyInPandas(run, "own long, sequence_id long, offset long")
    rest = ["ids"] if with_ids else []
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *rest]
    packed = part.join(placed, "own").select(*columns)
    # a full piece is a sequence of its own; these are numbered below zero
    full = found.filter(F.col("length") == SEQUENCE).withColumn("sequence_id", -(F.col("own") + 1)).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(full.select(*columns))
