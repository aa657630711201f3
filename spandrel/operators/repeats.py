"""Tandem repeats with insertions and deletions, by wraparound alignment.

A repeat is aligned with its motif laid end to end: a table with a column for each base of the motif, where the last column leads to the first again.
The table goes through the sequence base by base, for all candidates of a batch that have motifs of one length at once, as array operations. Deleted
bases of the motif may run round its end; the best way into each column from all others is a running maximum over two copies of the row.

Candidates are motifs that stand twice in a row somewhere in the sequence. Where one has an alignment that scores enough, what lies left and right of it is
searched again. Of overlapping repeats the one with the higher score stays.

Different sequences are searched once and rows follow by their sequence. Sequences of one length of motif and about one length are taken together, at most
CELLS columns at a time, so memory doesn't follow the batch.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Scores: a base that agrees, one that doesn't, and one that is inserted or deleted.
MATCH, MISMATCH, GAP = 2, 5, 5
CELLS = 1 << 18


class Hit(NamedTuple):
    """A repeat: bases start to end, columns of its alignment and how many of them agree."""

    start: int
    end: int
    score: int
    agree: int
    columns: int


def seeds(seq: np.ndarray, least: int, most: int) -> list[np.ndarray]:
    """Motifs that stand twice in a row in a sequence and repeat nothing shorter, each in one of its rotations."""
    found = {}
    for p in range(least, min(most, len(seq) // 2) + 1):
        same = np.concatenate([[False], seq[p:] == seq[:-p], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            if b - a >= p:
                motif = seq[a : a + p].tobytes()
                if (motif + motif).find(motif, 1) == p:
                    found.setdefault(min(motif[k:] + motif[:k] for k in range(p)), None)
    return [np.frombuffer(m, np.uint8) for m in found]


def align(seqs: list[np.ndarray], motifs: list[np.ndarray]) -> list[Hit]:
    """The best local alignment of each sequence with its motif; all motifs are of one length. Of equal scores the one that ends first."""
    m, n, many = len(motifs[0]), max(map(len, seqs)), len(seqs)
    text = np.zeros((n, many), np.uint8)
    for k, s in enumerate(seqs):
        text[: len(s), k] = s
    unit = np.stack(motifs)
    score, start, agree, columns = (np.zeros((many, m), np.int64) for _ in range(4))
    best = np.zeros((many, 5), np.int64)  # score, start, end, agree, columns
    place = np.arange(2 * m)
    for i in range(n):
        same = unit == text[i][:, None]
        s, b, g, c = (np.roll(x, 1, axis=1) for x in (score, start, agree, columns))
        new = s == 0
        diagonal = s + np.where(same, MATCH, -MISMATCH)
        insertion = score - GAP
        keep = diagonal >= insertion
        now = np.maximum(np.maximum(diagonal, insertion), 0)
        begin = np.where(keep, np.where(new, i, b), start)
        good = np.where(keep, np.where(new, 0, g) + same, agree)
        wide = np.where(keep, np.where(new, 0, c), columns) + 1
        # deletions: the best of all columns before, up to a whole turn
        key = (np.concatenate([now, now], axis=1) + GAP * place) * (2 * m) + place
        key = np.maximum.accumulate(key, axis=1)[:, m:]
        origin = key % (2 * m)
        other = key // (2 * m) - GAP * place[m:]
        jump = other > now
        at = origin % m
        turned = [np.take_along_axis(x, at, axis=1) for x in (begin, good, wide)]
        score = np.where(jump, other, now)
        start, agree = np.where(jump, turned[0], begin), np.where(jump, turned[1], good)
        columns = np.where(jump, turned[2] + place[m:] - origin, wide)
        column = score.argmax(axis=1)
        top = score[np.arange(many), column]
        rows = np.flatnonzero((top > best[:, 0]) & (text[i] > 0))
        at = rows, column[rows]
        best[rows] = np.column_stack([score[at], start[at], np.full(len(rows), i + 1), agree[at], columns[at]])
    return [Hit(int(a), int(e), int(s), int(g), int(c)) for s, a, e, g, c in best]


def find(seqs: list[np.ndarray], min_motif: int, max_motif: int, min_copies: float, min_identity: float, min_length: int, min_score: int) -> list[list[tuple[Hit, str]]]:
    """Every sequence's repeats with their motifs, in order, none overlapping another."""
    waiting: dict[int, list[tuple[int, int, int, np.ndarray]]] = defaultdict(list)  # by length of motif: sequence, the part to search, motif
    for k, seq in enumerate(seqs):
        for motif in seeds(seq, min_motif, max_motif):
            waiting[len(motif)].append((k, 0, len(seq), motif))
    found: list[list[tuple[Hit, str]]] = [[] for _ in seqs]
    for m, todo in waiting.items():
        while todo:
            todo.sort(key=lambda w: w[2] - w[1])
            some, todo = todo[-max(1, CELLS // m) :], todo[: -max(1, CELLS // m)]
            hits = align([seqs[k][a:b] for k, a, b, _ in some], [w[3] for w in some])
            for (k, a, b, motif), h in zip(some, hits, strict=True):
                if h.score < min_score:
                    continue
                found[k].append((h._replace(start=a + h.start, end=a + h.end), motif.tobytes().decode("latin-1")))
                todo += [(k, x, y, motif) for x, y in ((a, a + h.start), (a + h.end, b)) if MATCH * (y - x) >= min_score]
    for k, hits in enumerate(found):
        kept: list[tuple[Hit, str]] = []
        for h, motif in sorted(hits, key=lambda x: (-x[0].score, len(x[1]), x[0].start, x[1])):
            enough = h.end - h.start >= max(min_length, min_copies * len(motif)) and h.agree >= min_identity * h.columns
            if enough and all(h.end <= o.start or h.start >= o.end for o, _ in kept):
                kept.append((h, motif))
        found[k] = sorted(kept)
    return found


def indel_repeats(df: DataFrame, seq: str, min_motif: int = 1, max_motif: int = 100, min_copies: float = 3, min_identity: float = 0.7, min_length: int = 10, min_score: int = 20) -> DataFrame:
    """df with a row for each repeat of its sequence: rep_start, rep_end, motif (its first rotation), purity (the share of agreeing columns of the alignment), score, motif_length, rep_length, rep_units.

    Case doesn't matter; null, empty and sequences without repeats give no rows; characters beyond ASCII agree with nothing.
    """
    asked = df.select(F.upper(seq).alias("_seq")).filter(F.col("_seq") != "").distinct()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            seqs = [np.frombuffer(t.encode("latin-1", "replace"), np.uint8) for t in texts]
            rows = [(t, h.start, h.end, motif, round(h.agree / h.columns, 3), h.score) for t, hits in zip(texts, find(seqs, min_motif, max_motif, min_copies, min_identity, min_length, min_score), strict=True) for h, motif in hits]
            columns = zip(zip(*rows, strict=True) if rows else [()] * 6, (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["_seq", "rep_start", "rep_end", "motif", "purity", "score"])

    hits = asked.mapInArrow(search, "_seq string, rep_start int, rep_end int, motif string, purity double, score int")
    out = df.withColumn("_up", F.upper(seq)).join(hits, F.col("_up") == F.col("_seq")).drop("_up", "_seq")
    length = F.col("rep_end") - F.col("rep_start")
    return out.withColumns({"motif_length": F.length("motif"), "rep_length": length, "rep_units": F.floor(length / F.length("motif")).cast("int")})
