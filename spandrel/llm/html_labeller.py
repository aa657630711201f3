"""HTML extraction by a recurrent block labeller.

A page's leaf blocks are read in order by a bidirectional LSTM in numpy. A block comes in as its tag path and its words, both
hashed, and a few counts; each output sees the whole page in both directions and says whether the block is main text. The labeller is trained on
made-up pages (html_pages) with a fixed seed, so it needs no labelled pages and is the same everywhere.

The text of a page is its main blocks: character references decoded, white space inside a block made one space, trimmed, joined in order by
line breaks. A <br> is white space.

Defined cases: null and empty pages give an empty text; pages of any length are read whole, long ones in windows that carry the state on; broken markup is read as browsers do, as far as
open elements go; repeated rows give equal results; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared
from .html_blocks import Block, blocks_of
from .html_pages import MARK, Maker

PATH, WORDS, COUNTS = 160, 24, 10
INPUT, HIDDEN = PATH + WORDS + COUNTS, 20
PAGES, EPOCHS, RATE, BATCH, SEED = 900, 8, 0.01, 24, 11


#: A page of more blocks is read in windows of so many.
LONG = 20_000
#: So many different paths are kept at a time.
KEPT_PATHS = 20_000


def _path_vector(path: tuple[str, ...], known: dict) -> np.ndarray:
    if path not in known:
        if len(known) >= KEPT_PATHS:
            known.clear()
        v = np.zeros(PATH, np.float32)
        for token in path:
            if token not in ("html", "body"):
                v[zlib.crc32(token.encode("utf-8", "replace")) % PATH] += 1
        known[path] = np.sqrt(v)
    return known[path]


def features(blocks: list[Block], known: dict | None = None, first: int = 0, last: int | None = None) -> np.ndarray:
    """A row for each block of a page, or for those from first to last."""
    n, known = len(blocks), {} if known is None else known
    last = n if last is None else min(last, n)
    x = np.zeros((last - first, INPUT), np.float32)
    for j, b in enumerate(blocks[first:last]):
        k, words = j, b.text.split()
        x[k, :PATH] = _path_vector(b.path, known)
        for w in words:
            x[k, PATH + zlib.crc32(w.lower().encode("utf-8", "replace")) % WORDS] += 1
        m, chars = len(words), len(b.text)
        x[k, PATH : PATH + WORDS] /= max(1.0, float(x[k, PATH : PATH + WORDS].sum()))
        x[k, PATH + WORDS :] = (
            np.log1p(m) / 4, min(1.0, b.linked / max(1, chars)), b.text.count(".") / m, b.text.count(",") / m, float("©" in b.text),
            b.text[-1] in ".!?", (first + k) / n, (n - 1 - first - k) / n, len(b.path) / 10, 1.0,
        )
    return x


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _lstm(x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: bool = False, state: list | None = None):
    """x: steps, batch, inputs. Returns the outputs, and with keep what the backward pass needs. state: where to begin, and then where it ended."""
    steps, n, _ = x.shape
    h, c = state or (np.zeros((n, HIDDEN), x.dtype), np.zeros((n, HIDDEN), x.dtype))
    out, saved = np.zeros((steps, n, HIDDEN), x.dtype), []
    into = (x.reshape(steps * n, -1) @ w + b).reshape(steps, n, -1)
    for t in range(steps):
        z = into[t] + h @ u
        i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        new = f * c + i * g
        th = np.tanh(new)
        m = mask[t][:, None]
        if keep:
            saved.append((h, c, i, f, o, g, th, m))
        c = np.where(m, new, c)
        h = np.where(m, o * th, h)
        out[t] = h
    if state is not None:
        state[:] = h, c
    return out, saved


def _lstm_back(x, saved, dout, w, u):
    dw, du, db = np.zeros_like(w), np.zeros_like(u), np.zeros(w.shape[1], w.dtype)
    dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
    for t in range(len(saved) - 1, -1, -1):
        h0, c0, i, f, o, g, th, m = saved[t]
        dh = dh + dout[t]
        on = np.where(m, dh, 0)
        ds = np.where(m, dc, 0) + on * o * (1 - th**2)
        dz = np.concatenate([ds * g * i * (1 - i), ds * c0 * f * (1 - f), on * th * o * (1 - o), ds * i * (1 - g**2)], 1)
        dw += x[t].T @ dz
        du += h0.T @ dz
        db += dz.sum(0)
        dh = np.where(m, 0, dh) + dz @ u.T
        dc = np.where(m, 0, dc) + ds * f
    return dw, du, db


class Labeller:
    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p

    def _run(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        p = self.p
        ahead, sa = _lstm(x, mask, p["wf"], p["uf"], p["bf"], keep)
        back, sb = _lstm(x[::-1], mask[::-1], p["wb"], p["ub"], p["bb"], keep)
        both = np.concatenate([ahead, back[::-1]], 2)
        return _sigmoid(both @ p["o"] + p["c"]), both, sa, sb

    def label_long(self, blocks: list[Block], known: dict, window: int) -> np.ndarray:
        """Main or not, for the blocks of one long page, window by window in each direction: only the outputs are kept for all of it."""
        p, n = self.p, len(blocks)
        out, windows = np.zeros((n, 2 * HIDDEN), np.float32), [(a, min(a + window, n)) for a in range(0, n, window)]
        zeros = lambda: [np.zeros((1, HIDDEN), np.float32) for _ in range(2)]
        ahead, back = zeros(), zeros()
        for a, b in windows:
            x = features(blocks, known, a, b)[:, None]
            out[a:b, :HIDDEN] = _lstm(x, np.ones((b - a, 1), bool), p["wf"], p["uf"], p["bf"], state=ahead)[0][:, 0]
        for a, b in reversed(windows):
            x = features(blocks, known, a, b)[::-1, None]
            out[a:b, HIDDEN:] = _lstm(x, np.ones((b - a, 1), bool), p["wb"], p["ub"], p["bb"], state=back)[0][::-1, 0]
        return _sigmoid(out @ p["o"] + p["c"]) >= 0.5

    def main_of(self, pages: list[list[Block]], known: dict) -> list[np.ndarray]:
        """Main or not, for the blocks of each page. Pages of more than LONG blocks run in windows, by themselves."""
        short = [k for k, page in enumerate(pages) if len(page) <= LONG]
        found = dict(zip(short, self.label([features(pages[k], known) for k in short]), strict=True))
        return [found[k] if k in found else self.label_long(page, known, LONG) for k, page in enumerate(pages)]

    def label(self, pages: list[np.ndarray], area: int = 200_000) -> list[np.ndarray]:
        """Main or not, for the blocks of each page. Pages of like length run together, up to an area of steps times pages."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = [k for k in sorted(range(len(pages)), key=lambda k: len(pages[k])) if len(pages[k])]
        while order:
            steps = len(pages[order[-1]])
            use = order[-max(1, min(256, area // (steps * 8))) :]
            del order[-len(use) :]
            x, mask = _batch([pages[k] for k in use])
            y = self._run(x, mask)[0]
            for j, k in enumerate(use):
                out[k] = y[: len(pages[k]), j] >= 0.5
        return out


def _batch(pages: list[np.ndarray]):
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), INPUT), np.float32), np.zeros((steps, len(pages)), bool)
    for j, p in enumerate(pages):
        x[: len(p), j] = p
        mask[: len(p), j] = True
    return x, mask


def made_pages(n: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    maker, out = Maker(seed), []
    for _ in range(n):
        blocks = blocks_of(maker.page())
        truth = np.array([MARK in b.text for b in blocks], np.float32)
        for b in blocks:
            b.text = b.text.replace(MARK, "") or "x"
        if blocks:
            out.append((features(blocks), truth))
    return out


@lru_cache(1)
def trained(pages: int = PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    rng = np.random.default_rng(seed)
    shapes = {"wf": (INPUT, 4 * HIDDEN), "uf": (HIDDEN, 4 * HIDDEN), "bf": (4 * HIDDEN,), "wb": (INPUT, 4 * HIDDEN), "ub": (HIDDEN, 4 * HIDDEN), "bb": (4 * HIDDEN,), "o": (2 * HIDDEN,), "c": (1,)}
    p = {k: (rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 or k == "o" else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}
    model, data = Labeller(p), made_pages(pages, seed)
    data.sort(key=lambda d: len(d[0]))
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    batches = [data[k : k + BATCH] for k in range(0, len(data), BATCH)]
    total = epochs * len(batches)
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            x, mask = _batch([d[0] for d in batches[k]])
            truth = np.zeros(mask.shape, np.float32)
            for j, d in enumerate(batches[k]):
                truth[: len(d[1]), j] = d[1]
            y, both, sa, sb = model._run(x, mask, keep=True)
            d = np.where(mask, y - truth, 0).astype(np.float32) / mask.sum()
            dboth = d[:, :, None] * p["o"]
            g = {"o": np.einsum("tbh,tb->h", both, d), "c": np.array([d.sum()], np.float32)}
            g["wf"], g["uf"], g["bf"] = _lstm_back(x, sa, dboth[:, :, :HIDDEN], p["wf"], p["uf"])
            g["wb"], g["ub"], g["bb"] = _lstm_back(x[::-1], sb, dboth[::-1, :, HIDDEN:], p["wb"], p["ub"])
            norm = np.sqrt(sum(float((q**2).sum()) for q in g.values()))
            step += 1
            rate = RATE * (1 - step / (total + 1))
            for name, q in g.items():
                q = q * min(1.0, 1.0 / (norm + 1e-9))
                m[name] = 0.9 * m[name] + 0.1 * q
                v[name] = 0.999 * v[name] + 0.001 * q * q
                p[name] -= (rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def extract(pages: DataFrame, ident: str = "page_id", url: str = "url", html: str = "html", model: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    shared = Shared(pages.sparkSession, model or trained())

    def run(batches):
        known: dict = {}
        for batch in batches:
            sources = batch.column(2)
            for a in range(0, len(sources), 128):
                found = [blocks_of(h.as_py() or "") for h in sources.slice(a, 128)]
                main = shared.value.main_of(found, known)
                texts = ["\n".join(b.text for b, keep in zip(page, labels, strict=True) if keep) for page, labels in zip(found, main, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, 128), batch.column(1).slice(a, 128), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
                )

    given = pages.select(F.col(ident).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    return given.mapInArrow(run, "page_id long, url string, text string, n_chars long")
