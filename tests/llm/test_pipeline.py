"""The pipeline on a small table, stage by stage."""

import random

import corpus_pipeline
from spandrel.llm.common import stored

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghilmnorst") for _ in range(r.randint(3, 8)))
    prose = [" ".join(word() for _ in range(r.randint(80, 200))) + "." for _ in range(40)]
    rows = [(k, t, "en", r.choice("ab"), len(t)) for k, t in enumerate(prose)]
    rows += [(100, prose[3], "en", "a", 1), (101, prose[4] + " extra", "en", "b", 1), (102, "### " * 90, "en", "a", 1), (103, None, "en", None, None), (104, prose[5] + " 4041894974608795", "en", "a", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)), name)
        kept.append({x.doc_id for x in docs.select("doc_id").collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == corpus_pipeline.COLUMNS
    assert set(range(40)) <= kept[0] and not {102, 103} & kept[0]
    assert kept[1] == set(range(40)) and kept[2] == kept[1]
    assert kept[4] == kept[3] <= kept[2]
    assert docs.agg({"length": "sum"}).first()[0] > 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_run_equals_brute_force(spark, tmp_path):
    """Every stage of run() by plain Python: what is kept, what is replaced, how often it is drawn, and that each piece is packed once without gaps."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghilmnorst") for _ in range(r.randint(3, 8)))
    prose = [" ".join(word() for _ in range(r.choice([60, 120, 700, 3000]))) + "." for _ in range(30)]
    rows = [(k, t, "en", r.choice(["a", "b", None]), len(t)) for k, t in enumerate(prose)]
    rows += [(50 + k, t + " more", "en", "a", 1) for k, t in enumerate(prose[:9])] + [(70, "too short", "en", "a", 9), (71, "", "en", "a", 0), (72, None, None, None, None), (73, prose[12] + " mail bob@example.org", "en", "c", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    words = lambda t: (t or "").split()
    good = [x for x in rows if len(words(x[1])) >= 50]  # no other rule speaks against any of them
    shingles = [frozenset(zip(*(words(x[1].lower())[k:] for k in range(5)))) for x in good]
    label = list(range(len(good)))
    for a in range(len(good)):
        for b in range(a):
            if 100 * len(shingles[a] & shingles[b]) >= 80 * len(shingles[a] | shingles[b]):
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    heads = [good[k] for k in range(len(good)) if label[k] == k]
    assert {x.doc_id for x in packed} <= {x[0] for x in heads}
    # mixing: targets by water-filling, each source's words near its own
    size = {}
    for x in heads:
        size[x[3]] = size.get(x[3], 0) + len(words(x[1]))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    target, open_, left = {}, set(size), 1.5 * sum(size.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 2 * size[s]}
        if not full:
            target |= share
            break
        target |= {s: 2 * size[s] for s in full}
        left -= sum(target[s] for s in full)
        open_ -= full
    of = {x[0]: x for x in heads}
    drawn = {}
    for x in packed:
        if x.start == 0:
            drawn[x.doc_id] = drawn.get(x.doc_id, 0) + 1
    for s in size:
        own = [x for x in heads if x[3] == s]
        taken = sum(drawn.get(x[0], 0) * len(words(x[1])) for x in own)
        assert abs(taken - target[s]) <= 2 * max(len(words(x[1])) for x in own)
        rate = target[s] / size[s]
        assert all(int(rate) <= drawn.get(x[0], 0) <= int(rate) + 1 for x in own)
    # packing: every copy whole, every sequence gapless
    tokens, bins = {}, {}
    for x in packed:
        tokens[x.doc_id] = tokens.get(x.doc_id, 0) + x.length
        bins.setdefault(x.sequence_id, []).append((x.offset, x.length))
    import public_tokenizers
    import tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert all(tokens[d] == drawn[d] * (len(t.encode(of[d][1], add_special_tokens=False).ids) + 1) for d in tokens)
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in zip(b, b[1:])) and b[-1][0] + b[-1][1] <= 2048
