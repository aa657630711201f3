"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage is encoded: its statistics and hashed character classes and words go
through a tanh layer; a gated attention (tanh times sigmoid) weighs the passages, and the weighted mean of their
encodings is scored by a logistic unit. Weights are learnt from document labels alone, with numpy, on the driver.

Training uses the SAMPLE labelled documents of smallest hash (bounded, a parameter) whose crc32(doc_id) modulo 3 is not 1. Of a document of
more than DRAWN passages so many are learnt from, evenly spread over its whole text; so what comes to the driver is bounded however long texts are.
Scoring uses every passage of every whole text. Inputs are the text only.

Defined cases: a null or empty text is one empty passage; repeated rows score alike; without any label, or only one kind, the
score is the same for all, the smoothed share of label 1; several labels for a doc_id count as several rows; of several
texts of a doc_id the smallest is learnt from; null labels are ignored; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shared
from .textops import Words, blocks, string_parts

PASSAGE = 64
SAMPLE = 4000
#: Passages of a document that are learnt from.
DRAWN = 128
FOLDS, HELD = 3, 1
STATS, HASHED = 20, 44
HIDDEN, ATTENTION = 24, 16
EPOCHS, RATE, BATCH, SEED = 30, 0.01, 64, 5

_KIND = np.zeros(256, np.uint8)  # 1 lower, 2 upper, 3 digit, 4 mark of prose, 5 symbol, 6 beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
_KIND[[ord(c) for c in ".,;:?'\"-()"]] = 4
_KIND[[ord(c) for c in "#*$%&|<>!@^~=+/\\{}[]_`"]] = 5
_KIND[128:] = 6


def passages(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, first): a row for each passage, and where each text's passages begin, and one past the last."""
    w = Words(offsets, raw, lower=False)
    n_docs = len(offsets) - 1
    count = np.diff(w.first)
    per = np.maximum(1, -(-count // PASSAGE))
    first = np.concatenate([[0], np.cumsum(per)])
    n = first[-1]
    x = np.zeros((n, STATS + HASHED), np.float32)
    if len(w.start):
        within = np.arange(len(w.start)) - w.first[w.doc]
        passage = first[w.doc] + within // PASSAGE
        words = np.bincount(passage, minlength=n)
        size = w.end - w.start
        some = np.maximum(words, 1)
        chars = np.bincount(passage, weights=size, minlength=n)
        begin = np.concatenate([[0], np.cumsum(size)])[:-1]
        at = np.arange(size.sum()) - np.repeat(begin, size) + np.repeat(w.start, size)
        kind = _KIND[w.raw[at]]
        owner = np.repeat(passage, size)
        kinds = np.bincount(owner * 8 + kind, minlength=n * 8).reshape(n, 8)
        h = w.hashes(3)
        # words that stood before in the same passage, and right before
        order = np.lexsort((h, passage))
        same = (h[order][1:] == h[order][:-1]) & (passage[order][1:] == passage[order][:-1])
        again = np.bincount(passage[order][1:][same], minlength=n)
        next_same = np.bincount(passage[1:][(h[1:] == h[:-1]) & (passage[1:] == passage[:-1])], minlength=n)
        last = _KIND[w.raw[w.end - 1]]
        head = _KIND[w.raw[w.start]]
        stat = [
            np.log1p(words) / 4, chars / some / 10, *(kinds[:, k] / np.maximum(chars, 1) for k in range(1, 7)), again / some, next_same / some,
            np.bincount(passage, weights=last == 4, minlength=n) / some, np.bincount(passage, weights=last == 5, minlength=n) / some,
            np.bincount(passage, weights=head == 2, minlength=n) / some, np.bincount(passage, weights=size == 1, minlength=n) / some,
            np.bincount(passage, weights=size > 15, minlength=n) / some, np.bincount(passage, weights=(size == 1) & (head == 5), minlength=n) / some,
            np.sqrt(np.maximum(np.bincount(passage, weights=size.astype(float) ** 2, minlength=n) / some - (chars / some) ** 2, 0)) / 10,
            np.bincount(passage, weights=last == 3, minlength=n) / some,
        ]
        for k, s in enumerate(stat):
            x[:, k] = s
        slot = (h % np.uint64(HASHED)).astype(np.int64)
        bag = np.bincount(passage * HASHED + slot, minlength=n * HASHED).reshape(n, HASHED)
        x[:, STATS:] = np.sqrt(bag / some[:, None])
    # what a passage can't see: how much of its document repeats earlier lines' words is left to the attention
    x[:, STATS - 2] = np.repeat(np.minimum(np.log1p(count) / 10, 1), per)
    x[:, STATS - 1] = 1
    assert len(first) == n_docs + 1
    return x, first


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """encode -> gated attention -> logistic. p: parameters by name; mean and scale standardise the inputs."""

    def __init__(self, p: dict[str, np.ndarray], mean: np.ndarray, scale: np.ndarray):
        self.p, self.mean, self.scale = p, mean, scale

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict:
        p = self.p
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        e = (t * g) @ p["a"]
        top = np.maximum.reduceat(e, first[:-1])
        size = np.diff(first)
        e = np.exp(e - np.repeat(top, size))
        a = e / np.repeat(np.add.reduceat(e, first[:-1]), size)
        z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "y": _sigmoid(z @ p["o"] + p["c"])}

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.forward(x, first)["y"]

    def gradients(self, f: dict, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, size = self.p, np.diff(first)
        d = (f["y"] - y) / len(y)
        out = {"o": f["z"].T @ d, "c": np.array([d.sum()])}
        dz = np.repeat(d[:, None] * p["o"][None, :], size, axis=0)
        da = (dz * f["h"]).sum(1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, first[:-1]), size))
        out["a"] = (f["t"] * f["g"]).T @ de
        dt = de[:, None] * p["a"] * f["g"] * (1 - f["t"] ** 2)
        dg = de[:, None] * p["a"] * f["t"] * f["g"] * (1 - f["g"])
        out["v"], out["u"] = f["h"].T @ dt, f["h"].T @ dg
        dh = (f["a"][:, None] * dz + dt @ p["v"].T + dg @ p["u"].T) * (1 - f["h"] ** 2)
        out["w"], out["b"] = f["x"].T @ dh, dh.sum(0)
        return out


def train(bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Adam over mini-batches of documents. The bags are in a fixed order, so training is repeatable."""
    rng = np.random.default_rng(seed)
    n = STATS + HASHED
    if not len(bags) or len(np.unique(labels)) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        p = {"w": np.zeros((n, 1)), "b": np.zeros(1), "v": np.zeros((1, 1)), "u": np.zeros((1, 1)), "a": np.zeros(1), "o": np.zeros(1), "c": np.array([np.log(share / (1 - share))])}
        return Model(p, np.zeros(n), np.ones(n))
    every = np.concatenate(bags).astype(np.float64)
    mean, scale = every.mean(0), every.std(0) + 1e-3
    shapes = {"w": (n, HIDDEN), "b": (HIDDEN,), "v": (HIDDEN, ATTENTION), "u": (HIDDEN, ATTENTION), "a": (ATTENTION,), "o": (HIDDEN,), "c": (1,)}
    p = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if k not in "bc" else np.zeros(s) for k, s in shapes.items()}
    model = Model(p, mean, scale)
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for k in range(0, len(order), BATCH):
            use = order[k : k + BATCH]
            first = np.concatenate([[0], np.cumsum([len(bags[i]) for i in use])])
            f = model.forward(np.concatenate([bags[i] for i in use]), first)
            step += 1
            for name, g in model.gradients(f, first, labels[use]).items():
                g = g + 1e-4 * p[name]
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.999 * v[name] + 0.001 * g * g
                p[name] -= RATE * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
    return model


def drawn(first: int, last: int) -> np.ndarray:
    """The passages from first to before last, or DRAWN of them, evenly spread."""
    n = last - first
    return first + (np.arange(n) if n <= DRAWN else np.arange(DRAWN) * n // DRAWN)


def fold(ident: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def fit(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """The model, learnt from at most sample documents outside the held-out fold."""
    usable = labels.filter(F.col(label).isNotNull() & F.col(ident).isNotNull() & (fold(F.col(ident)) != HELD))
    # the sample is bounded, and so are its ids
    chosen = usable.select(F.col(ident).alias("doc_id"), (F.col(label) == 1).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)

    def bags(batches):
        for batch in batches:
            offsets, raw = string_parts(batch.column(2))
            for a, b in blocks(offsets):
                x, first = passages(offsets[a : b + 1] - offsets[a], raw[offsets[a] : offsets[b]])
                out = [x[drawn(first[k], first[k + 1])].tobytes() for k in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(out, pa.binary())], names=["doc_id", "label", "bag"])

    texts = docs.select(F.col(ident).alias("doc_id"), F.col(text).alias("text"))
    # however often a doc_id stands, one text of it is collected
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy(F.col("doc_id").cast("long").alias("doc_id"), "label").agg(F.min("text").alias("text"))
    rows = found.mapInArrow(bags, "doc_id long, label int, bag binary").toPandas().sort_values(["doc_id", "label", "bag"])
    return train([np.frombuffer(b, np.float32).reshape(-1, STATS + HASHED) for b in rows["bag"]], rows["label"].to_numpy(np.float64))


def quality_scores(docs: DataFrame, model: Model, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    shared = Shared(docs.sparkSession, model)

    def run(batches):
        for batch in batches:
            offsets, raw = string_parts(batch.column(1))
            ids = batch.column(0).to_pylist()
            for a, b in blocks(offsets):
                x, first = passages(offsets[a : b + 1] - offsets[a], raw[offsets[a] : offsets[b]])
                score = np.clip(shared.value.score(x, first), 0.0, 1.0)
                held = [zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS == HELD for i in ids[a:b]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(held), pa.array(score.astype(np.float64)), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
                )

    given = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return given.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
