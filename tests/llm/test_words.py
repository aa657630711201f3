"""Collocations, byte-level BPE and spelling variants, against brute force and the tokenizer's own library."""

import base64
import random
import re
import string
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import tiktoken
from pyspark.sql import functions as F

from spandrel.llm import byte_bpe, exchange, phrases, spelling

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


# collocations


def test_followed_bitmaps_equal_positions():
    r = np.random.default_rng(1)
    code = r.integers(0, 6, 500)
    at = np.sort(r.choice(2000, 500, replace=False))
    b = phrases.Bitmaps.of(code, at >> 3, np.left_shift(1, at & 7).astype(np.uint8), np.arange(6) * 10, np.arange(6))
    b = phrases.Bitmaps.unpacked(*b.packed())
    where = dict(zip(at.tolist(), code.tolist(), strict=True))
    want = Counter((c * 10, where[p + 1] * 10) for p, c in where.items() if p + 1 in where)
    left, q, n = b.counted()
    assert dict(zip(zip(b.ids[left].tolist(), q.tolist(), strict=True), n.tolist(), strict=True)) == want
    some = [(p, q) for p, q in want if p != 20]
    grown = b.grown(np.array([p for p, _ in some]), np.array([q for _, q in some]), np.arange(len(some)) + 7, np.arange(len(some)))
    size = [int(np.bitwise_count(grown.byte[x:y]).sum()) for x, y in zip(grown.first[:-1], grown.first[1:], strict=True)]
    assert dict(zip(grown.ids.tolist(), size, strict=True)) == {k + 7: want[x] for k, x in enumerate(some)}


def test_small_numbers_come_back():
    v = np.array([0, 1, 127, 128, 300, 2**33, 2**62, 5])
    data, at = exchange.packed_small(v)
    got, end = exchange.unpacked_small(data)
    assert got.tolist() == v.tolist() and end.tolist() == at[1:].tolist()


def brute_phrases(rows, least, longest=5):
    n, f = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    f = {p: c for p, c in f.items() if c >= least}
    out = []
    for (lang, p), a in f.items():
        if len(p) < 2 or any(lg == lang and c >= a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for (lg, q), c in f.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(x[0], k, *x[1:]) for k, x in enumerate(own, 1)]
    return sorted(ranked)


def test_collocations_equal_brute_force(spark, monkeypatch):
    r = random.Random(4)
    rows = [(" ".join(r.choice(["a", "b", "C", "d\x1ce", "é", "f.", "g\n", "h\t", ",", "of the b a"]) for _ in range(r.randint(0, 60))), r.choice(["en", "und", None, "fr"])) for _ in range(60)]
    rows += [(None, "en"), ("", None), (". , ;", "xx"), ("x " * 3000, "yy"), ("\x00 y " * 30, "en")] + rows[:5]
    monkeypatch.setattr(phrases, "SHARD_BYTES", 500)
    monkeypatch.setattr(phrases, "STEP_BYTES", 200)
    monkeypatch.setattr(phrases, "DEAL", 64)
    docs = spark.createDataFrame([(t, lang, "p", 1) for t, lang in rows], "text string, lang string, phrase string, a long").repartition(3)
    got = sorted(tuple(x) for x in phrases.collocations(docs, least=5).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == brute_phrases(rows, 5)


def test_collocations_of_nothing_and_of_large_numbers(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("a b", "en")], "text string, lang string")).count() == 0
    rows = [(10**13, [10**13 + 1], [10**13 + 7], 10**15), (3, [7], [9], 10**15), (5, [5, 6], [5, 8], 100)]
    out = spark.createDataFrame(rows, "a long, heads array<long>, tails array<long>, n long").withColumn("cut", phrases._worst_cut(F.col("n"))).select("a", "cut.*").collect()
    got = {x.a: (x.score, x.cut, x.l, x.r) for x in out}
    assert got[10**13][0] == 1000 * 10**13 * 10**15 // ((10**13 + 1) * (10**13 + 7)) and got[3][0] == 1000 * 3 * 10**15 // 63
    assert got[5] == (min(1000 * 5 * 100 // (5 * 8), 1000 * 5 * 100 // (6 * 5)), 1, 5, 8)


def test_shards_are_told_in_few_rows(monkeypatch):
    """Answers of 300 frequent words, or pairs, for 8 shards are a row for each shard at a time."""
    monkeypatch.setattr(phrases, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 1)))
    words = pa.table({"lang": ["en"] * 2401, "word": [f"w{k:03}" for k in range(300) for _ in range(8)] + ["z"], "chunk": [*range(8)] * 300 + [0], "p": [k for k in range(300) for _ in range(8)] + [300], "n": [2] * 2401})
    shard = phrases.Bitmaps.of(np.arange(301), np.arange(301) >> 3, np.left_shift(1, np.arange(301) & 7).astype(np.uint8), np.arange(301) * 3, np.full(301, 9))
    bucket, lefts, followers = phrases._followers(shard, 4)
    pairs = pa.concat_tables(pa.table({"bucket": bucket, "chunk": np.full(len(bucket), c), "lefts": lefts, "followers": followers}) for c in range(8)).sort_by("bucket")
    for names, make, rows in ((1, phrases._frequent_words, words), (2, phrases._frequent_pairs, pairs)):
        for most, n_rows in ((1 << 20, 8), (1, None)):
            monkeypatch.setattr(phrases, "ANSWERS", most)
            out = pa.Table.from_batches(b for b in make(8, iter(rows.to_batches(max_chunksize=50))))
            heads, told = out.filter(pc.is_null(out["chunk"])), out.filter(pc.is_valid(out["chunk"]))
            assert heads.num_rows == len(set(heads["id"].to_pylist())) == 300 and set(heads["a"].to_pylist()) == {16 if names == 1 else 8}
            assert told.num_rows == n_rows or most == 1 and told.num_rows > 8
            by = dict(zip(heads["id"].to_pylist(), zip(*(heads[c].to_pylist() for c in (["word"] if names == 1 else ["p", "q"])), strict=True), strict=True))
            for c in range(8):
                ids, a, *columns = phrases._told(told.filter(pc.equal(told["chunk"], c)), names)
                assert len(ids) == 300 and dict(zip(ids.tolist(), a.tolist(), strict=True)) == dict(zip(heads["id"].to_pylist(), heads["a"].to_pylist(), strict=True))
                for x, *p in zip(ids.tolist(), *(x.tolist() for x in columns), strict=True):
                    assert by[x] == ((f"w{p[0]:03}",) if names == 1 else tuple(p))


# byte-level BPE

NASTY = [
    None, "", " ", "a", "hello world", "don't we'll 'tis ''s I'M they've", "  two  spaces\n\n\tand tabs \r\n ", "é́ñ ß", "数字漢字テスト" * 30, "🎉👩‍👩‍👧🎉 x", "1234567 ４５ ½",
    "a" * 4000, "x1y2" * 200, "   wide　", "\x00\x1c\x1f|\x85", "abcdefghij" * 40, "<|endoftext|>", "Āā", "end \n",
]


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.mark.parametrize("frequent", [0, byte_bpe.FREQUENT])
def test_bpe_equals_the_library_and_decodes(spark, ranks, monkeypatch, frequent):
    monkeypatch.setattr(byte_bpe, "FREQUENT", frequent)
    monkeypatch.setattr(byte_bpe, "LOOKED_UP", 300)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    table = byte_bpe.Ranks(ranks)
    docs = spark.createDataFrame([(k, t, "w", "p") for k, t in enumerate(NASTY + NASTY[4:6])], "doc_id long, text string, words string, parts string")
    out = byte_bpe.encode(docs, table, public_tokenizers.PATTERN, carry=["doc_id", "words"])
    got = {x.doc_id: (x.ids, bytes(x.said)) for x in out.withColumn("said", table.decoded(F.col("ids"))).collect()}
    assert out.columns == ["doc_id", "words", "ids"]
    for k, t in enumerate(NASTY + NASTY[4:6]):
        assert got[k] == (library.encode_ordinary(t or ""), (t or "").encode()), t


def test_every_token_has_two_parts(ranks):
    """What merging by rank order rests on: with the ranks below its own, a token is two pieces."""
    for name in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"):
        known = byte_bpe.read_ranks(public_tokenizers.path(name))
        for token, rank in random.Random(5).sample(sorted(known.items()), 3000):
            parts = [token[k : k + 1] for k in range(len(token))]
            while len(parts) > 2:
                at = min(range(len(parts) - 1), key=lambda k: known.get(parts[k] + parts[k + 1], 1 << 60))
                assert known.get(parts[at] + parts[at + 1], 1 << 60) < rank, token
                parts[at : at + 2] = [parts[at] + parts[at + 1]]


def test_bpe_of_nothing_and_of_ids_outside(spark, ranks):
    table = byte_bpe.Ranks(ranks)
    assert byte_bpe.encode(spark.createDataFrame([], "text string"), table, public_tokenizers.PATTERN).count() == 0
    ids = spark.createDataFrame([(None,), ([],), ([ranks[b"a"], None, 10**6, ranks[b"b"]],)], "ids array<int>")
    assert [bytes(x[0]) for x in ids.select(table.decoded(F.col("ids"))).collect()] == [b"", b"", b"ab"]


def test_bpe_plans_hold_no_ranks(spark, ranks):
    table = byte_bpe.Ranks(ranks)
    docs = spark.createDataFrame([("some words, never sent to the driver",)], "text string")
    out = byte_bpe.encode(docs, table, public_tokenizers.PATTERN).withColumn("said", table.decoded(F.col("ids")))
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 1_000_000


def test_bpe_spans_by_brute_force_and_long_words(spark, ranks):
    r = random.Random(8)
    words = ["", "a", "ü", "never seen before", *("".join(r.choices("abeinst", k=r.choice([3, 20, 61, 62, 63, 200]))) for _ in range(60)), "a" * 62, "a" * 63, "漢字" * 40]
    offsets, raw = byte_bpe.string_parts(pa.array(words))
    got = [x.tolist() for x in byte_bpe.Spans(ranks).found(offsets, raw)]
    want = []
    for k, w in enumerate(x.encode() for x in words):
        want += sorted((k, ranks[w[i:j]], i, j - i) for i in range(len(w)) for j in range(i + 1, len(w) + 1) if w[i:j] in ranks)
    assert list(zip(got[0], got[3], got[1], got[2], strict=True)) == want
    table = byte_bpe.Ranks(ranks)
    spans = table.spans.of(pa.array([*words[1:], None]))
    rows = [(w, s and (s["size"], s["bits"], [(p["at"], p["size"], p["id"]) for p in s["places"]])) for w, s in zip([*words[1:], None], spans.to_pylist(), strict=True)]
    out = spark.createDataFrame(rows, f"word string, spans {table.SPANS}").select("word", F.when(F.col("word").isNotNull(), table.with_ids(lambda ids: ids(F.col("spans")))).alias("ids")).collect()
    library = tiktoken.Encoding("own", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})
    for x in out:
        assert x.ids == (None if x.word is None else library.encode_ordinary(x.word)), x.word


def test_ranks_file(tmp_path):
    (tmp_path / "r").write_bytes(base64.b64encode(b"a") + b" 0\n" + base64.b64encode(b"\xff b") + b" 1\n")
    assert byte_bpe.read_ranks(str(tmp_path / "r")) == {b"a": 0, b"\xff b": 1}


def test_frequent_ids_pass_the_driver_in_small_parts(spark, ranks):
    table, r = byte_bpe.Ranks(ranks), random.Random(6)
    words = ["".join(r.choices("abcdefghij", k=r.randint(3, 9))) for _ in range(6000)]
    docs = spark.createDataFrame([(" ".join(words[k : k + 100]),) for k in range(0, 6000, 100)], "text string")
    sent = [x.value for x in byte_bpe.frequent(docs, table, "text", public_tokenizers.PATTERN)]
    kinds = len({w for k in range(0, 6000, 100) for w in re.findall(r" ?\w+", " ".join(words[k : k + 100]))})
    sizes = [len(heads) + len(ids) for _, _, heads, ids in sent]
    assert len(sent) == byte_bpe.PARTS and max(sizes) < 3 * sum(sizes) / len(sizes) and sum(sizes) < 35 * kinds
    known = byte_bpe.Known(sent)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    some = [" " + w for w in words[1:100]] + [" never"]
    offsets, raw = byte_bpe.string_parts(pa.array(some))
    at = known.find(offsets, raw, np.arange(100), byte_bpe._hashes(offsets, raw))
    assert len(known.key) == kinds and at[-1] == -1
    for w, k in zip(some[:-1], at, strict=False):
        assert known.ids[known.first[k] : known.first[k] + known.size[k]].tolist() == library.encode_ordinary(w)


# spelling variants


def brute_spelling(rows, shortest=5, least=3):
    n = Counter()
    for ident, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(LOW)):
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= shortest and c >= least}

    def near(a, b):
        a, b = sorted((a, b), key=len)
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    out, form = {}, {}
    for w in n:
        others = [v for v in n if v != w and near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = len(others)

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n[w], out[w], n.get(form[w])) for w in n)


def test_spelling_equals_brute_force(spark):
    r = random.Random(6)
    base = ["".join(r.choice("abcé") for _ in range(r.randint(4, 9))) for _ in range(25)]

    def varied(w):
        k = r.randrange(len(w))
        return r.choice([w, w, w[:k] + w[k + 1 :], w[:k] + r.choice("abÿ") + w[k:], w[:k] + r.choice("abc") + w[k + 1 :]])

    rows = [(k, " ".join(varied(r.choice(base)) + r.choice(["", ".", "1"]) for _ in range(60)).title()) for k in range(60)]
    rows += [(None, "aaaaa aaaaaa aaaaaaa " * 5), (1, None), (2, ""), (7, "1 2 3"), (8, "z" * 3000 + " " + "z" * 3001), (8, "z" * 3000 + " " + "z" * 3001), (9, "z" * 3000 + " " + "z" * 3001)] + rows[:3]
    docs = spark.createDataFrame([(k, t, "w", 1) for k, t in rows], "doc_id long, text string, word string, n long").repartition(3)
    got = sorted(tuple(x) for x in spelling.spelling_groups(docs).select("word", "form", "root", "n", "n_near", "form_n").collect())
    want = brute_spelling(rows)
    assert got == want and sum(x[1] is not None for x in want) > 20 and any(x[2] != (x[1] or x[0]) for x in want)


def test_spelling_of_nothing(spark):
    assert spelling.spelling_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.spelling_groups(spark.createDataFrame([(1, None), (2, "ab cd")], "doc_id long, text string")).count() == 0


def test_one_edit():
    assert spelling.one_edit("abcde", "abxde") and spelling.one_edit("abcde", "abcdef") and spelling.one_edit("abcde", "aabcde") and spelling.one_edit("aaaa", "aaaaa")
    assert not spelling.one_edit("abcde", "abcde") and not spelling.one_edit("abcde", "baxde") and not spelling.one_edit("abcde", "abxdef")


