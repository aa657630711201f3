import random

import pytest
from pyspark.sql import functions as F

from spandrel.functions.motifs import Tolerance
from spandrel.operators import disease, intervals, repeats, report, rollup, screen, search, serve, similar, sweep


def test_overlap_join_equals_brute_force(spark):
    r = random.Random(1)
    a = [(k, f"chr{r.randint(1, 2)}", s := r.randint(-30, 300), s + r.randint(0, 90)) for k in range(80)]
    b = [(k, f"chr{r.randint(1, 3)}", s := r.randint(-30, 300), s + r.randint(0, 90)) for k in range(80)]
    left, right = spark.createDataFrame(a, ["i", "c", "s", "e"]), spark.createDataFrame(b, ["ri", "rc", "rs", "re"])
    want = {(x[0], y[0]) for x in a for y in b if x[1] == y[1] and y[2] < x[3] and y[3] > x[2]}
    rows = intervals.overlap_join(left, right, "c", "s", "e", "rc", "rs", "re", bin_size=32).select("i", "ri").collect()
    assert len(rows) == len(want) and {tuple(x) for x in rows} == want
    semi = {x.i for x in intervals.overlap_join(left, right, "c", "s", "e", "rc", "rs", "re", "left_semi", 32).collect()}
    anti = {x.i for x in intervals.overlap_join(left, right, "c", "s", "e", "rc", "rs", "re", "left_anti", 32).collect()}
    assert semi == {i for i, _ in want} and semi | anti == set(range(80)) and not semi & anti


def test_overlap_join_of_all_lengths(spark):
    """Whole contigs next to a few bases, on both sides; bins of 4, so many levels are met."""
    r = random.Random(7)

    def some(n):
        size = [r.choice([0, 1, 3, 4, 5, 32, 33, 300, 5000, 100_000]) for _ in range(n)]
        return [(k, r.choice(["a", "a", "b", None]), s := r.randint(-50, 2000), None if k == 7 else s + x) for k, x in enumerate(size)]

    a, b = some(150), some(150)
    schema = "{0}i int, {0}c string, {0}s long, {0}e long"
    left, right = spark.createDataFrame(a, schema.format("")), spark.createDataFrame(b, schema.format("r"))
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] is not None and x[1] == y[1] and None not in (x[3], y[3]) and y[2] < x[3] and y[3] > x[2])
    joined = intervals.overlap_join(left, right, "c", "s", "e", "rc", "rs", "re", bin_size=4)
    assert sorted(tuple(x) for x in joined.select("i", "ri").collect()) == want and joined.columns == ["i", "c", "s", "e", "ri", "rc", "rs", "re"]


def test_long_intervals_are_not_cut_into_bins(spark):
    from spandrel.operators.intervals import _placed

    long = spark.createDataFrame([("a", 0, 250_000_000)], "c string, s long, e long")
    short = spark.createDataFrame([("a", 10 * k, 10 * k + 5) for k in range(100)], "rc string, rs long, re long")
    assert _placed(long, short, "s", "e", "rs", "re", intervals.BIN, True).count() <= 2
    assert _placed(short, long, "rs", "re", "s", "e", intervals.BIN, False).count() <= 200


def test_union_length_equals_covered_bases(spark):
    r = random.Random(8)
    spans = [(k % 12, s := r.randint(0, 60), s + r.randint(1, 25)) for k in range(70)]
    out = intervals.union_length(spark.createDataFrame(spans, "k int, s int, e int"), ["k"], "s", "e", "u").collect()
    assert len(out) == len(spans) and all(x.u == len({p for k, s, e in spans if k == x.k for p in range(s, e)}) for x in out)


def test_nearest_equals_brute_force(spark):
    r = random.Random(2)
    a, b = [(k, r.randint(0, 2), r.randint(0, 60)) for k in range(50)], [(k, r.randint(0, 1), r.randint(0, 60)) for k in range(20)]
    out = intervals.nearest(spark.createDataFrame(a, ["i", "g", "v"]), spark.createDataFrame(b, ["j", "g", "w"]), ["g"], "v", "w", "j").collect()
    for x in out:
        c = sorted((abs(x.v - w), w, j) for j, g, w in b if g == x.g)
        assert (x.nearest_distance, x.nearest_j) == ((c[0][0], c[0][2]) if c else (None, None))


def test_nearest_keeps_rows_without_key_or_value(spark):
    r = random.Random(3)
    a = [(k, r.choice([None, 0, 1]), r.choice([None, *range(20)])) for k in range(60)]
    b = [(k, r.choice([None, 0, 2]), r.choice([None, *range(20)])) for k in range(30)]
    out = intervals.nearest(spark.createDataFrame(a, "i int, g int, v int"), spark.createDataFrame(b, "j int, g int, w int"), ["g"], "v", "w", "j").collect()
    assert sorted(x.i for x in out) == list(range(60))
    for x in out:
        c = sorted((abs(x.v - w), w, j) for j, g, w in b if x.v is not None and w is not None and g is not None and g == x.g)
        assert (x.nearest_distance, x.nearest_j) == ((c[0][0], c[0][2]) if c else (None, None))


def test_quantiles_equal_brute_force(spark, monkeypatch):
    import numpy as np

    from spandrel.operators import quantiles as q

    monkeypatch.setattr(q, "ROWS", 40)
    monkeypatch.setattr(q, "PARTS", 4)
    r = random.Random(9)
    rows = [("one", r.gauss(0, 1e6)) for _ in range(1500)] + [("same", 5.0)] * 500 + [("two", float(k % 2)) for k in range(300)] + [("steep", 10.0 ** r.randint(-300, 300)) for _ in range(200)]
    rows += [(None, float(k)) for k in range(50)] + [("none", None), ("few", 1.0), ("few", 4.0), ("few", None)]
    wanted = {"low": ("v", 0.0), "q1": ("v", 0.25), "mid": ("v", 0.5), "odd": ("v", 0.937), "top": ("v", 1.0), "mid_w": ("w", 0.5)}
    df = spark.createDataFrame([(k, v, None if v is None else -v) for k, v in rows], "k string, v double, w double").repartition(5)
    out = {x.k: x for x in q.quantiles(df, ["k"], wanted).collect()}
    assert set(out) == {k for k, _ in rows} and out["none"].mid is None
    for key in set(out) - {"none"}:
        values = np.array([v for k, v in rows if k == key and v is not None])
        for name, (c, p) in wanted.items():
            assert out[key][name] == pytest.approx(np.quantile(values if c == "v" else -values, p), rel=1e-12)
    assert q.quantiles(df.filter("false"), ["k"], wanted).count() == 0
    assert q.quantiles(df.filter("k = 'few'"), [], {"m": ("v", 0.5)}).collect()[0].m == 2.5


CALLS = [("chr1", 100, "CAG"), ("chr1", 100, "TTA"), ("1", 500, "CAG"), ("chrUn", 5, "CAG"), ("chr1", 211, "CAG"), ("chr1", 100, None)]
CATALOGUE = [("chr1", 90, 100, "AGC", 5.0), ("chr1", 95, 99, "TTTA", 9.0), ("chr1", 200, 201, "A", 1.0), ("chr1", 150, 400, "GCA", 1.0)]


def test_screen_verdicts_and_best_hit(spark):
    calls = spark.createDataFrame([(k, *c) for k, c in enumerate(CALLS)], "i int, chrom string, point long, motif string")
    cat = spark.createDataFrame(CATALOGUE, "chrom string, start long, end long, motif string, copy_num double")
    out = {r.i: r for r in screen.screen(calls, cat, "u_").collect()}
    assert [out[k].u_novelty for k in range(6)] == ["known", "novel_motif", "novel_locus", "unscreened", "known", "novel_motif"]
    assert (out[0].u_start, out[0].u_distance, out[0].u_match, out[0].u_n_nearby) == (90, 1, "exact", 2)
    assert out[4].u_start == 150 and out[2].u_n_nearby == 0 and out[2].u_start is None
    loose = {r.i: r for r in screen.screen(calls, cat, tolerance=Tolerance(max_edits=1)).collect()}
    assert (loose[1].novelty, loose[1].match) == ("known", "fuzzy")
    strict = {r.i: r.novelty for r in screen.screen(calls, cat, repeat_filter=screen.RepeatFilter(min_copy_num=100.0, min_identity=5)).collect()}
    assert strict[0] == "novel_locus" and strict[3] == "unscreened"


def test_annotate_combines_conservatively(spark):
    calls = spark.createDataFrame([("chr1", 101, "s1", "a", "[100]", 0, 50, "CAG", 0.9), ("chr2", 7, "s2", "a", "40", 0, 10, "CAG", 0.5)], "chrom string, ins_coord long, SVID string, sample string, insert_size string, rep_start int, rep_end int, motif string, purity double")
    one = spark.createDataFrame(CATALOGUE, "chrom string, start long, end long, motif string, copy_num double")
    two = spark.createDataFrame([("chr2", 0, 3, "T")], "chrom string, start long, end long, motif string")
    out = {r.SVID: r for r in screen.annotate(calls, {"u": one, "t": two}, [("purity", F.col("purity"), 0.8)]).collect()}
    assert (out["s1"].novelty, out["s1"].insertion_purity, out["s1"].filter) == ("known", 0.5, "PASS")
    assert (out["s2"].u_novelty, out["s2"].t_novelty, out["s2"].novelty, out["s2"].filter) == ("unscreened", "novel_motif", "novel_motif", "purity")


def test_disease_screen(spark):
    loci = spark.createDataFrame(
        [("L1", "HTT", "chr4", 100, 160, 20.0, [("pathogenic", "CAG"), ("reference", "CAA")], 40.0, None, 36.0, 39.0, None, 35.0)],
        "id string, gene string, chrom string, start long, end long, ref_copies double, motifs array<struct<class:string,motif:string>>, pathogenic_min double, pathogenic_max double, intermediate_min double, intermediate_max double, benign_min double, benign_max double",
    )
    calls = [(0, "chr4", 120, "CTG", 25.0, "htt"), (1, "chr4", 120, "CAG", 5.0, ""), (2, "chr4", 120, "AAC", 1.0, "x"), (3, "chr4", 120, "TTTT", None, None), (4, "chr4", 900, "CAG", 1.0, "HTT")]
    out = {r.i: r for r in disease.disease_screen(spark.createDataFrame(calls, "i int, chrom string, point long, motif string, rep_units double, gene string"), loci).collect()}
    assert [out[k].status for k in range(5)] == ["pathogenic_expansion", "pathogenic_motif", "locus_known_motif", "locus_novel_motif", "no_locus_match"]
    assert [out[k].gene_agrees for k in range(5)] == [True, None, False, None, None]
    assert (out[0].est_copies, out[0].allele_class, out[3].allele_class) == (45.0, "pathogenic", "unknown")
    text = disease.as_text(spark.createDataFrame([(1.5, True)], "est_copies double, gene_agrees boolean"), "c").first()
    assert tuple(text) == ("1.5", "true", "c")


def test_rollups(spark):
    rows = [("chr1", 5, "a", s, 30, 3, 20, "CAG", 0.9, 5.0, v) for s, v in (("x", "known"), ("y", "novel_locus"))] + [("chr1", 5, "b", "x", 50, 0, 50, "CA", 0.7, 9.0, "novel_motif")]
    calls = spark.createDataFrame(rows + rows[:1], "chrom string, ins_coord long, SVID string, sample string, insert_size long, rep_start int, rep_end int, canonical_motif string, purity double, rep_units double, novelty string").withColumn("motif_length", F.length("canonical_motif"))
    locus = rollup.build_loci(calls, ()).first()
    assert (locus.n_carrier_alleles, locus.n_samples, locus.n_alleles, locus.novelty, locus.representative_svid, locus.motif) == (3, 2, 2, "known", "a", "CAG")
    segs = rollup.build_segments(calls).orderBy("sample", "allele", "seg_index").collect()
    assert [(s.sample, s.allele, s.seg_index, s.seg_type, s.start, s.end) for s in segs[:4]] == [("x", 1, 0, "repeat", 0, 50), ("x", 2, 0, "flank", 0, 3), ("x", 2, 1, "repeat", 3, 20), ("x", 2, 2, "flank", 20, 30)]
    arch = rollup.architecture(rollup.build_segments(calls), ["locus_id", "sample", "allele"])
    assert {r.architecture for r in arch.collect()} == {"CA×9", "CAG×5"}
    assert rollup.dedupe_report(calls).first().n_duplicates == 1
    with pytest.raises(ValueError):
        rollup.checked_left_join(calls, calls, ["SVID"])


def test_majority_ties_go_to_the_more_conservative(spark):
    df = spark.createDataFrame([("a", "novel_locus"), ("a", "known"), ("b", "novel_motif"), ("b", "novel_motif"), ("b", "known")], ["k", "v"])
    assert {r.k: r.verdict for r in screen.majority(df, ["k"], "v").collect()} == {"a": "known", "b": "novel_motif"}


def test_filters_report_what_they_ignore(spark):
    df = spark.createDataFrame([("chr1", 5, True), ("chr2", 9, False)], ["chrom", "pos", "novel"])
    out, ignored = serve.filtered(df, novel_only=True, region="chr1:1-10", min_purity=0.5, gene=None)
    assert out.count() == 1 and ignored == ["min_purity"]
    page = serve.list_loci(df, sort="arrays")
    assert page["sort"] == "position" and page["total"] == 2


def test_guarded_sql(spark):
    reg = serve.Registry(spark)
    reg.register("numbers", spark.range(10).toDF("n"))
    out = reg.query("with x as (select n from numbers where n > 2) select count(*) as c from x")
    assert out["rows"] == [{"c": 7}] and not out["truncated"]
    assert reg.query("select n from numbers", max_rows=3)["truncated"]
    for bad in ("drop table numbers", "select 1; select 2", "select * from parquet.`/etc`", "insert into numbers values (1)"):
        with pytest.raises(Exception):  # noqa: B017
            reg.query(bad)
    with pytest.raises(ValueError):
        reg.query("select * from numbers", off={"numbers"})
    with pytest.raises(ValueError):
        reg.register("bad", spark.range(1), role="loci")
    assert reg.table_for("loci") is None


def test_reports(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 50.0)], ["r", "c", "v"])
    t = {r.r: (r.x, r.y, r.z) for r in report.crosstab(df, "r", "c", ["x", "y", "z"]).collect()}
    assert t == {"a": (1, 1, 0), "b": (1, 0, 0)}
    assert sorted(tuple(r) for r in report.edge_bins(df, "v", [1, 2, 4]).collect()) == [(0, 1), (1, 1), (2, 1)]
    assert [r.n for r in report.ladder(df, "v", [1, 10, 100]).orderBy("within").collect()] == [1, 2, 3]
    assert [r.n for r in serve.funnel(df, {"all": F.lit(True), "a": F.col("r") == "a", "x": F.col("c") == "x"}).orderBy("place").collect()] == [3, 2, 1]
    assert screen.parse_axis("0:1:0.5") == [0.0, 0.5, 1.0] and screen.parse_axis("none") == [None]
    best = search.best_strategy(spark.createDataFrame([("n", 3, 0, None), ("m", 2, 9, 0.9), ("w", 1, 99, 1.0)], "strategy string, specificity int, hits long, coverage double")).first()
    assert best.strategy == "m"


def test_numbered_and_running_sum_over_ranges(spark):
    df = spark.createDataFrame([(k * 7 % 101, k) for k in range(101)], ["v", "w"])
    got = {x.v: x.at for x in report.numbered(df, [F.col("v").desc()], "at").collect()}
    assert got == {v: 100 - v for v in range(101)}
    upto = {x.v: x.s for x in report.running_sum(df, "v", "w", "s").collect()}
    by = {k * 7 % 101: k for k in range(101)}
    assert upto == {v: sum(by[u] for u in range(v + 1)) for v in range(101)}
    both = report.side_by_side(df.select("v"), df.select("w").limit(3), [F.col("v")], [F.col("w")]).collect()
    assert len(both) == 101 and sum(x.w is not None for x in both) == 3


def test_nearest_over_many_ranges(spark):
    r = random.Random(12)
    a, b = [(k, 0, r.randint(0, 4000)) for k in range(300)], [(k, 0, r.randint(0, 4000)) for k in range(12)]
    out = intervals.nearest(spark.createDataFrame(a, ["i", "g", "v"]), spark.createDataFrame(b, ["j", "g", "w"]), ["g"], "v", "w", "j").collect()
    assert len(out) == 300
    for x in out:
        assert (x.nearest_distance, x.nearest_j) == min((abs(x.v - w), w, j) for j, _, w in b)[::2]


def test_values_are_trimmed_and_sources_keep_classes(spark, tmp_path):
    from spandrel.functions import text
    from spandrel.sources import tables

    got = spark.sql("select ' a ; 0b0;; c1 ' as t").select(text.values(F.col("t")).alias("v")).first().v
    assert got == ["a", "0b0", "c1"]
    (tmp_path / "d.json").write_text('[{"id": "L", "gene": "G", "chrom": "4", "start_hg38": 1, "stop_hg38": 9, "pathogenic_motif_reference_orientation": ["CAG"], "benign_motif_reference_orientation": ["CAA"]}]')
    d = tables.disease_catalogue(spark, str(tmp_path / "d.json")).first()
    assert [(m["class"], m["motif"]) for m in d.motifs] == [("pathogenic", "CAG"), ("benign", "CAA")]


def test_sweep_equals_single_screens(spark):
    from spandrel.operators import sweep

    r = random.Random(14)
    word = lambda n: "".join(r.choice("AC") for _ in range(n))
    calls = spark.createDataFrame([(f"chr{r.randint(1, 3)}", r.randint(1, 60), word(r.randint(1, 3)), r.random()) for _ in range(120)], "chrom string, ins_coord long, motif string, purity double")
    cats = {n: spark.createDataFrame([(f"chr{r.randint(1, 2)}", s := r.randint(0, 60), s + r.randint(1, 9), word(r.randint(1, 7))) for _ in range(15)], "chrom string, start long, end long, motif string") for n in ("a", "b")}
    axes = {"window": [0, 4], "max_motif_edits": [0, 1], "min_subrepeat_motif": [None, 1], "min_reference_length": [None, 5], "min_purity": [None, 0.4]}
    rows = sweep.sweep(calls, cats, sweep.settings_of(axes)).collect()
    assert len(rows) == 32
    for x in (rows[0], rows[13], rows[22], rows[31]):
        tol = Tolerance(int(x.max_motif_edits), None, None if x.min_subrepeat_motif is None else int(x.min_subrepeat_motif))
        df = calls.withColumn("point", F.col("ins_coord") - 1)
        for n, c in cats.items():
            df = screen.screen(df, c, f"{n}_", window=int(x.window), tolerance=tol, repeat_filter=screen.RepeatFilter(min_length=None if x.min_reference_length is None else int(x.min_reference_length)))
        df = df.withColumn("novelty", screen.combined(F.col("a_novelty"), F.col("b_novelty"))).filter(F.lit(True) if x.min_purity is None else F.col("purity") >= x.min_purity)
        n = {v.novelty: v["count"] for v in df.groupBy("novelty").count().collect()}
        assert (x.rows_known, x.rows_novel_motif, x.rows_novel_locus, x.rows_unscreened) == tuple(n.get(v, 0) for v in screen.VERDICTS)
        loci = {(v.status): v.n for v in sweep.two_scopes(df, ["chrom", "ins_coord"]).filter("scope = 'locus'").collect()}
        assert (x.loci_known, x.loci_novel_motif, x.loci_novel_locus, x.loci_unscreened) == tuple(loci.get(v, 0) for v in screen.VERDICTS)


def test_tandem_repeats_and_compression_against_plain_code(spark):
    import zlib

    from spandrel.functions import motifs, text

    seqs = ["ACGT" * 9 + "TTG", "CAGCAGCAGCAGTTT", "A" * 30, "ACGGT", "", None, "GATTACA" * 4 + "C" + "GATTACA" * 3]
    got = spark.createDataFrame([(k, s) for k, s in enumerate(seqs)], "i int, s string")
    found = {}
    for x in motifs.repeats(got, "s").collect():
        found.setdefault(x.i, []).append((x.rep_start, x.rep_end, x.motif))
        unit = seqs[x.i][x.rep_start : x.rep_end]
        agree = max(sum(u == v for u, v in zip(unit, (x.motif[k:] + x.motif[:k]) * 40)) for k in range(len(x.motif))) / len(unit)
        assert agree >= 0.7 and abs(agree - x.purity) <= 0.2
    assert found[0][0][0] == 0 and found[0][0][1] >= 36 and found[0][0][2] == "ACGT" and found[2] == [(0, 30, "A")] and 3 not in found and 4 not in found and 5 not in found
    ratio = {x.i: x.r for x in got.select("i", text.ratio_of_deflate(F.col("s")).alias("r")).collect()}
    assert all(ratio[k] == (len(s) / len(zlib.compress(s.encode())) if s else None) for k, s in enumerate(seqs))


def test_parzen_finds_the_best_in_fewer_trials_than_the_grid():
    axes = {"window": list(range(12)), "max_motif_edits": list(range(8)), "min_purity": [None, 0.2, 0.4, 0.6, 0.8], "min_rep_units": [None, 1.0, 2.0, 3.0]}
    best = {"window": 7, "max_motif_edits": 2, "min_purity": 0.6, "min_rep_units": 1.0}

    def score(s):
        return None if s["window"] == 0 else -sum(abs(v.index(s[a]) - v.index(best[a])) * w for (a, v), w in zip(axes.items(), (1, 2, 3, 1.5), strict=True))

    found = []
    for seed in range(8):
        tried = sweep.study(axes, lambda made: [score(m) for m in made], trials=300, batch=6, seed=seed)
        assert len({tuple(t.values()) for t, _ in tried}) == 300
        found.append(next((k for k, (_, s) in enumerate(tried) if s == 0), 1920))
        assert tried == sweep.study(axes, lambda made: [score(m) for m in made], trials=300, batch=6, seed=seed)
    assert sorted(found)[4] < 200 and max(found) < 1920 // 2
    low = sweep.study(axes, lambda made: [None if score(m) is None else -score(m) for m in made], trials=300, seed=1, maximize=False)
    assert min(s for _, s in low if s is not None) == 0
    small = {"window": [1, 2], "min_purity": [None, 0.5]}
    assert len(sweep.study(small, lambda made: [0.0] * len(made), trials=50)) == 4
    with pytest.raises(ValueError):
        sweep.study({"nothing": [1]}, lambda made: made)


def test_similar_pairs_equal_brute_force(spark):
    def edits(a, b):
        row = list(range(len(b) + 1))
        for x in a:
            row = [new := row[0] + 1, *(new := min(row[j + 1] + 1, new + 1, row[j] + (x != y)) for j, y in enumerate(b))]
        return row[-1]

    r = random.Random(12)
    texts = list({"".join(r.choice("ab" if k % 2 else "abcdef") for _ in range(r.randint(0, 9))) for k in range(150)}) + ["", "é", "éa"]
    df = spark.createDataFrame([(t,) for t in [*texts, *texts[:5], None]], "t string")
    for k in (0, 1, 3):
        want = {(*sorted((a, b)), edits(a, b)) for a in texts for b in texts if a < b and edits(a, b) <= k}
        rows = similar.similar_pairs(df, "t", k).collect()
        assert {(x.a, x.b, x.edits) for x in rows} == want and len(rows) == len(want)
    motifs = ["".join(r.choice("ACGT") for _ in range(r.randint(1, 7))) for _ in range(60)]
    one, two = (spark.createDataFrame([(m,) for m in ms], f"{n} string") for ms, n in ((motifs[:40], "m"), (motifs[20:], "o")))
    unit = lambda m: next(m[:k] for k in range(1, len(m) + 1) if len(m) % k == 0 and m[:k] * (len(m) // k) == m)
    turns = lambda m: [m[k:] + m[:k] for k in range(len(m))]
    want = {(m, o, d) for m in motifs[:40] for o in motifs[20:] if (d := min(edits(t, min(turns(unit(o)))) for t in turns(unit(m)))) <= 1}
    assert {tuple(x) for x in similar.similar_motifs(one, two, "m", "o", 1).collect()} == want


def test_ancestors_of_chains_diamonds_and_circles(spark):
    edges = [(k, k + 1) for k in range(20)] + [(100, 101), (100, 102), (101, 103), (102, 103), (103, 104), (100, 104), (200, 201), (201, 200), (7, None), (100, 101)]
    got = {(x.term, x.ancestor): x.depth for x in search.ancestors(spark.createDataFrame(edges, "child int, parent int")).collect()}
    want = {(a, b): b - a for a in range(20) for b in range(a + 1, 21)} | {(100, 101): 1, (100, 102): 1, (100, 103): 2, (100, 104): 1, (101, 103): 1, (102, 103): 1, (101, 104): 2, (102, 104): 2, (103, 104): 1}
    want |= {(200, 201): 1, (201, 200): 1, (200, 200): 2, (201, 201): 2}
    assert got == want
    some = search.ancestors(spark.createDataFrame(edges, "child int, parent int"), spark.createDataFrame([(18,), (999,)], "term int"))
    assert sorted(tuple(x) for x in some.collect()) == [(18, 19, 1), (18, 20, 2)]


def test_levels_in_one_pass(spark):
    rows = [("c1", 1, "s1", 0.5), ("c1", 1, "s2", None), ("c1", 2, "s1", 1.0), ("c2", 1, "s3", 0.25), (None, 1, "s3", 1.0)]
    out = {(x.level, x.chrom, x.pos): (x.n_calls, x.n_samples, x.purity, x.n_purity) for x in rollup.rolled_up(spark.createDataFrame(rows, "chrom string, pos int, sample string, purity double"), [["chrom", "pos"], ["chrom"], []], "sample", "purity").collect()}
    assert out["", None, None] == (5, 3, 2.75, 4) and out["chrom", "c1", None] == (3, 2, 1.5, 2) and out["chrom,pos", "c1", 1] == (2, 2, 0.5, 1)
    assert out["chrom", None, None] == (1, 1, 1.0, 1) and len(out) == 4 + 3 + 1


def test_kmers(spark):
    df = spark.createDataFrame([("abc\ndé🎉x",), ("ab",), (None,)], "t string")
    got = [r[0] for r in df.select(report.kmers(F.col("t"), 3)).collect()]
    assert got == [["abc", "bc\n", "c\nd", "\ndé", "dé🎉", "é🎉x"], [], None]


def plain_best(seq, motif):
    """The best local score of a sequence against its motif laid end to end, cell by cell."""
    m, best = len(motif), 0
    row = [0] * m
    for x in seq:
        now = [max(0, row[j - 1] + (repeats.MATCH if motif[j] == x else -repeats.MISMATCH), row[j] - repeats.GAP) for j in range(m)]
        for _ in range(2):
            for j in range(m):
                now[j] = max(now[j], now[j - 1] - repeats.GAP)
        row, best = now, max(best, *now)
    return best


def test_wraparound_alignment_equals_plain_code():
    import numpy as np

    r = random.Random(14)
    code = lambda t: np.frombuffer(t.encode(), np.uint8)
    for m in (1, 2, 3, 5, 8):
        seqs, units = [], []
        for _ in range(40):
            unit = "".join(r.choice("ACGT") for _ in range(m))
            core = list(unit * r.randint(2, 9))
            for _ in range(r.randint(0, 4)):
                k = r.randrange(len(core))
                core[k : k + 1] = r.choice([[], [r.choice("ACGT")], [core[k], r.choice("ACGT")]])
            seqs.append("".join(r.choice("ACGT") for _ in range(r.randint(0, 12))) + "".join(core) + "".join(r.choice("ACGT") for _ in range(r.randint(0, 12))))
            units.append(unit)
        hits = repeats.align([code(s) for s in seqs], [code(u) for u in units])
        for s, u, h in zip(seqs, units, hits, strict=True):
            assert h.score == plain_best(s, u) == plain_best(s[h.start : h.end], u), (s, u)
            gaps = h.columns - h.agree
            assert h.agree * repeats.MATCH - h.score == gaps * repeats.GAP and h.end - h.start <= h.columns


def test_planted_repeats_with_indels_are_found(spark):
    r = random.Random(15)
    rows = []
    for k in range(40):
        p = r.randint(2, 9)
        unit = "".join(r.choice("ACGT") for _ in range(p))
        while any(unit == unit[:d] * (p // d) for d in range(1, p) if p % d == 0):
            unit = "".join(r.choice("ACGT") for _ in range(p))
        copies = [unit] * 12
        copies[4] = unit[1:]
        copies[8] = unit + r.choice("ACGT")
        left, right = ("".join(r.choice("ACGT") for _ in range(20)) for _ in range(2))
        core = "".join(copies)
        rows.append((k, left + core + right, unit, 20, 20 + len(core)))
    rows += [(100, None, "", 0, 0), (101, "", "", 0, 0), (102, "ACGT", "", 0, 0)]
    df = spark.createDataFrame(rows + rows[:2], "k int, s string, unit string, a int, b int")
    out = repeats.indel_repeats(df, "s", max_motif=12).collect()
    for k, s, unit, a, b in rows[:40]:
        hit = [x for x in out if x.k == k and x.rep_start < b and x.rep_end > a]
        best = max(hit, key=lambda x: x.score)
        assert len({(x.rep_start, x.rep_end) for x in hit if x.rep_length > (b - a) / 2}) == 1 and best.rep_start <= a + 12 and best.rep_end >= b - 12, (s, unit, best)
        assert best.motif in {unit[j:] + unit[:j] for j in range(len(unit))} and 0.85 < best.purity <= 1
    assert not any(x.k >= 100 for x in out) and sum(x.k == 0 for x in out) % 2 == 0
