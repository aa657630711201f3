"""Scoring, extraction, classification, joins and packing, against brute force and held-out accuracy."""

import math
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tokenizers

from spandrel.llm import embedding_join, html_blocks, html_labeller, html_pages, lm_scoring, lm_trie, ngram_join, packing, quality_mil, textops
from spandrel.llm.components import components

DOCS = "doc_id long, text string, source string, size string"
ODD = ["", None, " \n\t", "one", "two words", "a b c", "A  B\tC", " x y z", "é" * 40, "x " * 5000]


def docs(spark, texts):
    return spark.createDataFrame([(k, t, "s", "x") for k, t in enumerate(texts)], DOCS)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))


def test_words_and_hashes():
    texts = ["a b", "", "  c\nd ", "é x", "a"]
    off, raw = textops.string_parts(pa.array(texts))
    w = textops.Words(off, raw)
    got = [w.raw[a:b].tobytes().decode() for a, b in zip(w.start, w.end, strict=True)]
    assert got == ["a", "b", "c", "d", "é", "x", "a"] and w.doc.tolist() == [0, 0, 2, 2, 3, 3, 4]
    h = w.hashes()
    assert h[0] == h[6] and len(set(h.tolist())) == 6


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 440)]
    parent = list(range(500))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, ["a", "b"])).collect()}
    assert all(got.get(k, k) == find(k) for k in range(500))


def test_ngram_join_equals_brute_force(spark):
    r = random.Random(2)
    texts = list(ODD)
    for _ in range(12):
        base = [r.choice(string.ascii_lowercase) * r.randint(1, 3) + str(r.randint(0, 40)) for _ in range(r.choice([9, 30, 120]))]
        for _ in range(r.randint(1, 14)):
            copy = list(base)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = "new" + str(r.randint(0, 9))
            texts.append(" ".join(copy))
    sets = [frozenset(zip(w, w[1:], w[2:])) if len(w) > 2 else frozenset([tuple(w)] if w else []) for w in map(words, texts)]
    label = list(range(len(texts)))
    for _ in range(len(texts)):
        for a in range(len(texts)):
            for b in range(a):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]) and label[a] != label[b]:
                    low, high = sorted((label[a], label[b]))
                    label = [low if x == high else x for x in label]
        break
    got = {x.doc_id: x for x in ngram_join.jaccard_join(docs(spark, texts)).collect()}
    assert [got[k].n_shingles for k in range(len(texts))] == [len(s) for s in sets]
    assert [got[k].component_id for k in range(len(texts))] == label
    assert ngram_join.jaccard_join(docs(spark, [])).count() == 0


def test_clusters_of_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 8)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for k in range(40):
        copy = list(base)
        for j in range(k % 20):
            copy[(k * 7 + j * 11) % 200] = f"n{k}_{j}"
        texts.append(" ".join(copy))
    sets = [frozenset(zip(w, w[1:], w[2:])) for w in map(words, texts)]
    label = list(range(40))
    for a in range(40):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    got = {x.doc_id: x.component_id for x in ngram_join.jaccard_join(docs(spark, texts)).collect()}
    assert [got[k] for k in range(40)] == label and len(set(label)) > 1


def linked_groups(texts, n, threshold):
    """Brute force: for every text the smallest index of its component."""
    num, den = threshold
    sets = [frozenset(zip(*(w[k:] for k in range(n)))) if len(w) >= n else frozenset([tuple(w)] if w else []) for w in map(words, texts)]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    return label


@pytest.mark.parametrize(("n", "threshold"), [(3, (90, 100)), (5, (80, 100)), (2, (50, 100))])
def test_ngram_join_chains_passages_and_thresholds(spark, monkeypatch, n, threshold):
    # many tiles, chunks and fragments; a passage that most texts share; chains of copies of copies
    monkeypatch.setattr(ngram_join, "TILE", 12)
    monkeypatch.setattr(ngram_join, "CHUNK", 9)
    monkeypatch.setattr(ngram_join, "FRAGMENT_GRAMS", 500)
    monkeypatch.setattr(ngram_join, "PIVOTS", 2)
    r = random.Random(11)
    passage = [f"p{k}" for k in range(40)]
    texts = []
    for g in range(6):
        now = [f"g{g}w{r.randint(0, 60)}" for _ in range(r.choice([8, 25, 90]))]
        for _ in range(r.choice([1, 5, 40])):
            now = list(now)
            for _ in range(r.randint(0, 3)):
                now[r.randrange(len(now))] = "new" + str(r.randint(0, 50))
            texts.append(" ".join(now[: len(now) // 2] + passage + now[len(now) // 2 :]) if r.random() < 0.7 else " ".join(now))
    got = {x.doc_id: x for x in ngram_join.jaccard_join(docs(spark, texts), n_words=n, threshold=threshold).collect()}
    want = linked_groups(texts, n, threshold)
    assert [got[k].component_id for k in range(len(texts))] == want
    assert {k for k in got if got[k].kept} == set(want)


@pytest.mark.parametrize("threshold", [(90, 100), (80, 100)])
def test_clusters_that_hang_together_by_chance_are_sieved(spark, monkeypatch, threshold):
    # each text shares a rare n-gram with the next one, of about the same size or of another; some have near copies
    monkeypatch.setattr(ngram_join, "SIEVED", 1000, raising=False)
    monkeypatch.setattr(ngram_join, "SKETCHES", 7, raising=False)
    monkeypatch.setattr(ngram_join, "SKETCH_PAIRS", 50, raising=False)
    r = random.Random(3)
    texts = []
    for g in range(30):
        own = [f"link{g} is here"] + [f"g{g}w{k}" for k in range(r.choice([20, 60, 70, 400]))] + [f"link{g + 1} is here"]
        for c in range(r.choice([1, 2, 9])):
            copy = list(own)
            for _ in range(r.randint(0, 6)):
                copy[r.randrange(1, len(copy) - 1)] = f"new{g}x{c}"
            texts.append(" ".join(copy))
    # every gram of the texts is shared, so those of the links lead
    texts += [" ".join(f"g{g}w{k}" for k in range(400)) for g in range(30)]
    met = []
    monkeypatch.setattr(ngram_join, "_links", lambda sets, clusters, threshold, links=ngram_join._links: met.extend(clusters.collect()) or links(sets, clusters, threshold))
    got = {x.doc_id: x for x in ngram_join.jaccard_join(docs(spark, texts), threshold=threshold).collect()}
    want = linked_groups(texts, 3, threshold)
    assert [got[k].component_id for k in range(len(texts))] == want
    assert {k for k in got if got[k].kept} == set(want)
    # what is compared in full are about the groups themselves
    sizes = Counter(x.cluster for x in met)
    assert max(sizes.values()) <= 10, sizes.most_common(3)


def test_ngram_join_of_rows_without_own_ids(spark):
    base = [f"w{k}" for k in range(60)]
    near = " ".join([*base[:-1], "end"])
    rows = [(None, " ".join(base)), (7, near), (7, "quite another text of seven words"), (3, near), (3, near), (None, None), (None, "only here"), (9, "")]
    given = spark.createDataFrame([(k, t, "s", 5) for k, t in rows], "doc_id long, text string, kept string, n_shingles long")
    out = ngram_join.jaccard_join(given, carry=["doc_id", "text", "kept"])
    assert out.columns == ["doc_id", "text", "n_shingles", "component_id", "kept"]
    got = sorted(((x.doc_id, x.text, x.component_id, x.kept) for x in out.collect()), key=str)
    assert sorted(str(x) for x in got if x[3]) == sorted(str(x) for x in [(3, near, 3, True), (7, rows[2][1], 7, True), (None, None, None, True), (None, "only here", None, True), (9, "", 9, True)])
    assert [x[2] for x in got if x[1] in (near, rows[0][1])] == [3] * 4


def test_embedding_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_join, "TILE", 16)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 8))
    rows = [(k, (base[k % 12] + rng.normal(0, 0.12, 8)).tolist(), k % 3 if k % 17 else None) for k in range(90)]
    rows += [(90, None, 1), (91, [0.0] * 8, 1), (92, [float("nan")] * 8, 1), (93, rows[0][1], rows[1][2]), (94, rows[1][1], rows[1][2]), (95, [], 1), (96, [1.0, None] * 4, 1), (97, [2 * x for x in rows[1][1]], rows[1][2])]
    good = {i: (np.array(v), lab) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    link = {i: {j for j in good if j != i and good[i][1] == good[j][1] and good[i][0] @ good[j][0] / np.sqrt((good[i][0] @ good[i][0]) * (good[j][0] @ good[j][0])) >= 0.93} for i in good}
    comp = {i: i for i, *_ in rows}
    for _ in range(50):
        comp = {i: min([comp[i], *(comp[j] for j in link.get(i, ()))]) for i in comp}
    out = {x.vec_id: x for x in embedding_join.embedding_join(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    for i in comp:
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (len(link.get(i, ())), comp[i], comp[i] == i), i


def test_embedding_join_of_missing_and_repeated_ids(spark):
    schema = "vec_id long, embedding array<double>, label int"
    rows = [(None, [1.0, 0.0], 1), (None, [0.0, 1.0], 2), (3, [1.0, 0.01], 1), (4, [0.01, 1.0], 2), (None, [1.0, -1.0], 2), (7, [1.0, 1.0], 1), (7, [-1.0, 1.0], 1), (2, [-1.0, 1.01], 1)]
    got = [tuple(x) for x in embedding_join.embedding_join(spark.createDataFrame(rows, schema)).collect()]
    want = [(None, 1, 3, False), (None, 1, 4, False), (3, 1, 3, True), (4, 1, 4, True), (None, 0, None, False), (7, 0, 7, True), (7, 1, 2, False), (2, 1, 2, True)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_quantised_bound_is_never_passed():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(200, 16))
    a /= np.sqrt((a * a).sum(1))[:, None]
    b = a + rng.normal(0, 0.1, a.shape)
    b /= np.sqrt((b * b).sum(1))[:, None]
    i, j = embedding_join.possible_pairs(a, b, 0.93)
    assert set(zip(*np.nonzero(a @ b.T >= 0.93), strict=True)) <= set(zip(i, j, strict=True)) and len(i) < 4000


def test_elias_fano_and_trie():
    rng = np.random.default_rng(6)
    for values in ([], [0], [5, 5, 9], np.sort(rng.integers(0, 1 << 40, 3000)), np.arange(100)):
        block = lm_trie.Block()
        ef = lm_trie.EliasFano(np.array(values, np.int64), block)
        block.seal()
        assert ef.access(np.arange(len(values))).tolist() == list(values)
        if len(set(values)) == len(values):
            want = np.concatenate([np.array(values, np.int64), rng.integers(0, 1 << 40, 500)])
            found = ef.find(want.astype(np.uint64), np.zeros(len(want), np.int64), np.full(len(want), len(values)))
            assert found.tolist() == [{int(v): i for i, v in enumerate(values)}.get(int(x), -1) for x in want]
    # a chain of words with few successors; every context's probabilities sum to about one, seen or not, whatever the order found
    seq = rng.integers(2, 9, 3000)
    w1, w2, w3 = np.concatenate([[0, 0], seq[:-2]]), np.concatenate([[0], seq[:-1]]), seq
    size = 9
    pairs, c2 = np.unique(w2 * size + w3, return_counts=True)
    one, n1 = np.unique(w2, return_counts=True)
    contexts, n2 = np.unique(w2 * size + w1, return_counts=True)
    triples, c3 = np.unique(np.searchsorted(contexts, w2 * size + w1) * size + w3, return_counts=True)
    pair = np.searchsorted(pairs, contexts[triples // size] // size * size + triples % size)
    counts = lm_trie.Counts(size, one, n1, pairs, c2, contexts % size, contexts // size, n2, triples // size, triples % size, pair, c3)
    trie = lm_trie.Trie(counts, np.full(9, 1 / 9))
    every = np.arange(9)
    for a in range(9):
        for b in range(9):
            assert (10 ** trie.log10(np.full(9, a), np.full(9, b), every)).sum() == pytest.approx(1, abs=0.04)


def test_quantised_values_are_close():
    x = -np.linspace(0, 12, 5000)
    assert (np.abs(lm_trie.VALUES[lm_trie.quantise(x)] - x) <= 0.001 + 0.03 * np.sqrt(-x)).all() and lm_trie.quantise(np.array([0.0, -99.0])).tolist() == [0, 255]


def test_lm_scores(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SHARD", 900)
    monkeypatch.setattr(lm_scoring, "CHUNK", 13)
    r = random.Random(7)
    vocabulary = [f"w{k}" for k in range(200)]
    chain = {w: r.sample(vocabulary, 3) for w in vocabulary}
    texts = list(ODD)
    for _ in range(150):
        w = [r.choice(vocabulary[:20])]
        for _ in range(r.randint(5, 60)):
            w.append(r.choice(chain[w[-1]]))
        texts.append(" ".join(w))
    out = {x.doc_id: x for x in lm_scoring.lm_scores(docs(spark, texts)).collect()}
    c, token = Counter(), {k: [*words(t), None] for k, t in enumerate(texts)}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in token}
    for k, w in token.items():
        if not held[k]:
            c.update(w)
    n, v = sum(c.values()), len(c)
    for k, w in token.items():
        x = out[k]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held[k], len(w), sum(c[t] > 0 for t in w), n)
        assert x.base_score == pytest.approx(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in w))
    test = [k for k in token if held[k] and k >= len(ODD)]
    assert sum(out[k].score for k in test) > sum(out[k].base_score for k in test)
    assert lm_scoring.lm_scores(docs(spark, [])).count() == 0


def test_lm_scores_stand_hashes_that_meet(spark, monkeypatch):
    """With far too few bits, n-grams take one another's counts: scores are then worse, but no probability is above 1, and words keep their own counts."""
    monkeypatch.setattr(lm_scoring, "BITS", -100)
    monkeypatch.setattr(lm_scoring, "LEAST_BITS", 33)
    original = textops.mix64
    monkeypatch.setattr(lm_scoring, "mix64", lambda x: original(x) & np.uint64(0x00000FFF80000000 | 0xFF << 56))
    r = random.Random(23)
    texts = [" ".join(r.choices([f"w{k}" for k in range(400)], k=r.randint(0, 60))) for _ in range(150)]
    out = lm_scoring.lm_scores(docs(spark, texts)).collect()
    assert len(out) == 150 and all(x.score <= 0 and math.isfinite(x.score) for x in out)
    token = {k: [*words(t), None] for k, t in enumerate(texts)}
    c = Counter(t for k, w in token.items() if zlib.crc32(str(k).encode()) % 7 != 2 for t in w)
    n, v = sum(c.values()), len(c)
    for x in out:
        assert x.n_known == sum(c[t] > 0 for t in token[x.doc_id]) and x.base_score == pytest.approx(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in token[x.doc_id]), abs=1e-9)


@pytest.mark.parametrize(("shard", "chunk"), [(300, 7), (10**6, 4096)])
def test_lm_scores_equal_an_interpolated_trigram_model(spark, monkeypatch, shard, chunk):
    """All n-grams of the corpus by brute force, hot and rare ones, copies in training and held out; equal texts score equal."""
    monkeypatch.setattr(lm_scoring, "SHARD", shard)
    monkeypatch.setattr(lm_scoring, "CHUNK", chunk)
    r = random.Random(13)
    texts = [" ".join(r.choices(["a", "b", "c", "d", f"rare{k}", f"own{k} x"], [9, 5, 3, 2, 1, 1], k=r.randint(0, 20))) for k in range(200)]
    texts += texts[:40]
    out = {x.doc_id: x.score for x in lm_scoring.lm_scores(docs(spark, texts)).collect()}
    events = {k: list(zip(["<s>", "<s>", *t.split()], ["<s>", *t.split()], [*t.split(), None])) for k, t in enumerate(texts)}  # noqa: B905
    train = [e for k, es in events.items() if zlib.crc32(str(k).encode()) % 7 != 2 for e in es]
    c1, c2, c3 = (Counter(e[k:] for e in train) for k in (2, 1, 0))
    n1, n2 = Counter(e[1] for e in train), Counter(e[:2] for e in train)
    s1, s2 = lm_trie.STRENGTH

    def p(w1, w2, w3):
        p = (c1[(w3,)] + 1) / (len(train) + len(c1) + 1)
        p = (c2[w2, w3] + s1 * p) / (n1[w2] + s1)
        return (c3[w1, w2, w3] + s2 * p) / (n2[w1, w2] + s2)

    for k, es in events.items():
        assert out[k] == pytest.approx(sum(math.log10(p(*e)) for e in es), abs=0.03 * len(es)), k
    assert all(out[k] == out[200 + k] for k in range(40))
    longest = sorted(range(200), key=lambda k: -len(events[k]))[:100]
    assert abs(sum(out[k] - sum(math.log10(p(*e)) for e in events[k]) for k in longest)) < 0.004 * sum(len(events[k]) for k in longest)


def test_encoder_equals_the_tokenizer():
    path = public_tokenizers.path("byte_bpe_50k.json")
    r = random.Random(8)
    bits = ["a", "the", " ", "  ", "\n", "\t", "é", "123", ".", "!!", "'s", "don't", "　", "中文", "\x1c", "\x85", "\r\n", "😀", " "]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(500)] + ODD
    texts += ["x <|endoftext|> y", "a b" + " " * 100_000, "<|endoftext|>" * 3, "a<|endoftext|", "word " * 20_000]
    plain = tokenizers.Tokenizer.from_file(path)
    e = packing.Encoder(path)
    off, raw = textops.string_parts(pa.array(texts))
    got = [x for a, b in textops.blocks(off, 2000) for x in e.block(off[a : b + 1] - off[a], raw[off[a] : off[b]])]
    assert [x.tolist() for x in got] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_packing_is_gapless_and_round_trips(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    r = random.Random(9)
    texts = [*ODD, *(" ".join(r.choice(["alpha", "beta", "g"]) for _ in range(r.randint(1, 900))) for _ in range(60)), ODD[-1]]
    out = packing.pack(docs(spark, texts), path, with_ids=True).collect()
    tokenizer = tokenizers.Tokenizer.from_file(path)
    seqs = {}
    for x in out:
        assert zlib.crc32(bytes(x.ids)) == x.ids_crc32 and len(x.ids) == 4 * x.length
        seqs.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    for k, t in enumerate(texts):
        ps = sorted((x.piece, x.start, bytes(x.ids)) for x in out if x.doc_id == k)
        ids = np.frombuffer(b"".join(p[2] for p in ps), "<u4").tolist()
        assert ids == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] and all(len(p[2]) == 8192 for p in ps[1:])
    total = sum(x.length for x in out)
    assert len(seqs) <= math.ceil(total / 2048) + 1
    assert packing.pack(docs(spark, []), path).count() == 0


def test_local_search_never_loses_and_helps():
    rng = np.random.default_rng(10)
    lengths = rng.integers(400, 1200, 600)
    first = packing.best_fit(lengths)
    after = packing.local_search([list(b) for b in first], lengths)
    assert sorted(i for b in after for i in b) == list(range(600)) and all(lengths[b].sum() <= 2048 for b in after)
    assert len(after) <= len(first) and sum(int(lengths[b].sum()) ** 2 for b in after) >= sum(int(lengths[b].sum()) ** 2 for b in first)


def test_bounds_of_the_search_cost_no_bins(monkeypatch):
    rng = np.random.default_rng(20)
    lengths = rng.integers(300, 1400, 1500)
    first = packing.best_fit(lengths)
    after = packing.local_search([list(b) for b in first], lengths)
    monkeypatch.setattr(packing, "BENCH", 10_000)
    assert len(after) <= len(packing.local_search([list(b) for b in first], lengths)) + 1 and len(after) <= len(first)
    many = np.concatenate([np.full(900, 7), np.full(60, 1900)])  # far more than 64 documents to a bin
    bins = packing.local_search(packing.best_fit(many), many)
    assert sorted(i for b in bins for i in b) == list(range(960)) and len(bins) <= 60


def test_mil_learns_and_scores_every_document(spark):
    r = random.Random(11)
    texts, labels = list(ODD), []
    for k in range(len(ODD), 300):
        good = r.random() < 0.6
        t = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(r.randint(20, 200)))
        texts.append(t if good else t.replace(" ", "### "))
        labels.append((k, int(good), 0))
    lab = spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    d = docs(spark, texts)
    out = {x.doc_id: x for x in quality_mil.quality_scores(d, quality_mil.fit(d, lab)).collect()}
    assert len(out) == len(texts) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in out.values())
    held = [(out[k].predicted, q) for k, q, _ in labels if out[k].held_out]
    assert np.mean([p == q for p, q in held]) > 0.95
    same = quality_mil.quality_scores(d, quality_mil.fit(d, lab.limit(0))).select("score").distinct().count()
    assert same == 1


def test_mil_learns_from_long_texts(spark):
    """Texts of any length are learnt from, by passages drawn from all over them; what the driver gets is bounded."""
    assert quality_mil.drawn(5, 8).tolist() == [5, 6, 7]
    k = quality_mil.drawn(10, 10 + 40 * quality_mil.DRAWN)
    assert len(k) == quality_mil.DRAWN and k[0] == 10 and k[-1] > 10 + 39 * quality_mil.DRAWN and (np.diff(k) == 40).all()
    r = random.Random(31)
    good, bad = ((lambda n, w=w: " ".join(r.choices(w, k=n))) for w in (["the", "of", "prose", "and."], ["#", "|x|", "9$", "%%"]))
    texts = [(good if k % 2 else bad)(60_000 if k < 2 else 150_000 if k < 4 else 90) for k in range(60)]
    d = docs(spark, texts)
    lab = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    out = {x.doc_id: x.predicted for x in quality_mil.quality_scores(d, quality_mil.fit(d, lab)).collect()}
    assert all(out[k] == k % 2 for k in range(60))
    only_long = lab.filter("doc_id < 4")
    out = {x.doc_id: x.predicted for x in quality_mil.quality_scores(d, quality_mil.fit(d, only_long)).collect()}
    learnt = {k % 2 for k in range(4) if zlib.crc32(str(k).encode()) % 3 != 1}
    assert learnt != {0, 1} or all(out[k] == k % 2 for k in range(60))


def test_mil_gradients_are_right():
    rng = np.random.default_rng(12)
    bags = [rng.normal(size=(n, quality_mil.STATS + quality_mil.HASHED)) for n in (1, 3, 2)]
    y, first = np.array([1.0, 0.0, 1.0]), np.array([0, 1, 4, 6])
    model = quality_mil.train(bags, y, epochs=1)
    x = np.concatenate(bags)
    loss = lambda: -np.mean(y * np.log(s := model.score(x, first)) + (1 - y) * np.log(1 - s))
    g = model.gradients(model.forward(x, first), first, y)
    for name, at in (("w", (3, 2)), ("v", (1, 4)), ("u", (2, 2)), ("a", (5,)), ("o", (7,))):
        keep = model.p[name][at]
        model.p[name][at] = keep + 1e-5
        up = loss()
        model.p[name][at] = keep - 1e-5
        assert g[name][at] == pytest.approx((up - loss()) / 2e-5, rel=1e-3, abs=1e-7)
        model.p[name][at] = keep


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About</a></li></ul></nav>
<div class="ad">Buy this now.</div><article><h1>A  title &amp; more</h1><p><b>First   paragraph with
a break<br>in it and enough words to be one.<p>Second one, also long enough to be read as prose by a person.</p></article>
<div class="comments"><h3>Comments</h3><p>I do not agree with this.</p></div><aside class="sidebar"><a href="/c">Related</a></aside><form><label>Mail</label></form><footer>&copy; us</footer></body></html>"""


def test_extraction(spark):
    rows = [(1, "u", PAGE), (2, "v", None), (3, "w", ""), (4, "x", "<<<>&&amp;"), (5, "y", PAGE.replace("article", 'div class="post-content"', 1).replace("</article>", "</div>"))]
    out = {x.page_id: x for x in html_labeller.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = "A title & more\nFirst paragraph with a break in it and enough words to be one.\nSecond one, also long enough to be read as prose by a person."
    assert out[1].text == want and out[1].n_chars == len(want) and out[1].url == "u"
    assert out[2].text == "" and out[3].text == "" and out[4].n_chars == len(out[4].text)
    assert out[5].text == want


def test_labeller_on_pages_it_has_not_seen():
    pages = html_labeller.made_pages(120, 77)
    got = html_labeller.trained().label([x for x, _ in pages])
    right = sum(int((g == (y > 0)).sum()) for g, (_, y) in zip(got, pages, strict=True))
    assert right / sum(len(y) for _, y in pages) > 0.98


def test_head_may_end_without_a_tag_and_embedded_text_stays():
    path = lambda html: [b.text for b in html_blocks.blocks_of(html)]
    assert path("<head><title>t</title><p>text") == ["text"]
    assert path('<html><title>t</title><meta charset="x"><h1>Head</h1><p>a</p>') == ["Head", "a"]
    assert path("<html><head><style>p{}</style>bare text") == ["bare text"]
    assert path("<head><title>t</title></head><body><p>x <math><mi>a</mi><mo>+</mo><mi>b</mi></math> y <svg><text>label</text></svg></p>") == ["x a+b y label"]
    assert path("<p>a<object>fallback</object></p><script>no()</script><noscript>no</noscript>") == ["afallback"]


def test_long_pages_are_labelled_alike(monkeypatch):
    model = html_labeller.trained(60, 2)
    maker = html_pages.Maker(3)
    page = [b for _ in range(12) for b in html_blocks.blocks_of(maker.page())]
    whole = model.main_of([page], {})[0]
    monkeypatch.setattr(html_labeller, "LONG", 37)
    assert (model.main_of([page], {})[0] == whole).all() and whole.any() and not whole.all()


def test_empty_tables_and_clashing_names(spark):
    names = "doc_id long, text string, held_out string, score string, n_tokens string, predicted string, piece string, offset string, length string"
    empty = spark.createDataFrame([], names)
    some = spark.createDataFrame([(1, "one two three", *["x"] * 7), (1, "one two three", *["x"] * 7), (None, None, *[None] * 7)], names)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    path = public_tokenizers.path("byte_bpe_50k.json")
    for run in (lm_scoring.lm_scores, lambda d: quality_mil.quality_scores(d, quality_mil.fit(d, labels)), lambda d: packing.pack(d, path)):
        assert run(empty).count() == 0 and run(some).count() == 3
    pages = "page_id long, url string, html string, text string, n_chars string"
    model = html_labeller.trained(60, 2)
    assert html_labeller.extract(spark.createDataFrame([], pages), model=model).count() == 0
    got = html_labeller.extract(spark.createDataFrame([(None, None, None, "x", "y"), (1, "u", "<p>" * 3000 + "deep", "x", "y")], pages), model=model).collect()
    assert sorted(got, key=str)[1][1:] == (None, "", 0) or sorted(got, key=str)[0][2] in ("", "deep")
    vectors = "vec_id long, embedding array<float>, label int, kept string, n_links string, key string, usable string"
    assert embedding_join.embedding_join(spark.createDataFrame([], vectors)).count() == 0
    same = [(k, [1.0, 0.5], 1, "x", "x", "x", "x") for k in range(3)]
    assert sorted(embedding_join.embedding_join(spark.createDataFrame(same, vectors)).collect()) == [(0, 2, 0, True), (1, 2, 0, False), (2, 2, 0, False)]


def test_many_dimensions_keep_the_bound():
    rng = np.random.default_rng(21)
    a = rng.normal(size=(40, 3000))
    b = a + rng.normal(0, 0.4, a.shape)
    i, j = embedding_join.linked_pairs(a, b, 0.93)
    cosine = (a @ b.T) / np.sqrt((a * a).sum(1)[:, None] * (b * b).sum(1)[None])
    assert set(zip(i, j, strict=True)) == set(zip(*np.nonzero(cosine >= 0.93), strict=True))
