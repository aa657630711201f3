"""What the largest step makes of many copies: its rows must not be the product of the copies on either side."""

import pytest
from pyspark.sql import functions as F

from spandrel.functions import motifs
from spandrel.functions.motifs import Tolerance
from spandrel.operators import disease, intervals, rollup, screen, search, similar
from spandrel.sources import vcf


def widest(spark, make):
    """make's rows, and the most rows that any step of its jobs put out."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsList().size()
    rows = make().collect()
    runs, most = store.executionsList(), 0
    for k in range(before, runs.size()):
        run = runs.apply(k).executionId()
        shown, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for i in range(nodes.size()):
            metrics = nodes.apply(i).metrics()
            for j in range(metrics.size()):
                m = metrics.apply(j)
                if m.name() == "number of output rows" and shown.contains(m.accumulatorId()):
                    most = max(most, int(shown.apply(m.accumulatorId()).replace(",", "")))
    return rows, most


def fullest(spark, make):
    """make's rows, the most rows that a task read from a shuffle, and how many rows were shuffled."""
    store = spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext.setJobGroup(f"fullest-{id(make)}", "")
    rows = make().collect()
    tracker, seen, most, sent = spark.sparkContext.statusTracker(), set(), 0, 0
    jobs = tracker.getJobIdsForGroup(f"fullest-{id(make)}")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for job in jobs:
        for stage in tracker.getJobInfo(job).stageIds:
            if stage in seen or not tracker.getStageInfo(stage) or not tracker.getStageInfo(stage).numCompletedTasks:
                continue
            seen.add(stage)
            sent += store.lastStageAttempt(stage).shuffleWriteRecords()
            tasks = store.taskList(stage, 0, 10000)
            most = max([most, *[m.get().shuffleReadMetrics().recordsRead() for k in range(tasks.size()) if (m := tasks.apply(k).taskMetrics()).isDefined()]])
    return rows, most, sent


def calls(spark, n):
    return spark.range(n).select(F.col("id").alias("k"), F.lit("chr1").alias("chrom"), F.lit(100).cast("long").alias("point"), F.element_at(F.array(*map(F.lit, ["CA", "AC", "GGT", "T"])), (F.col("id") % 4 + 1).cast("int")).alias("motif"))


def catalogue(spark, n):
    return spark.range(n).select(F.col("id").alias("r"), F.lit("chr1").alias("chrom"), F.lit(90).cast("long").alias("start"), F.lit(200).cast("long").alias("end"), F.when(F.col("id") % 2 == 0, "AC").otherwise("GGTT").alias("motif"))


def test_copies_in_disease_screen(spark):
    n = lambda x: F.lit(x).cast("double")
    loci = catalogue(spark, 300).select(
        F.format_string("L%03d", "r").alias("id"), F.lit("G").alias("gene"), "chrom", "start", "end", n(10).alias("ref_copies"), F.array(F.struct(F.lit("pathogenic").alias("class"), F.col("motif").alias("motif"))).alias("motifs"),
        n(40).alias("pathogenic_min"), n(None).alias("pathogenic_max"), n(None).alias("intermediate_min"), n(None).alias("intermediate_max"), n(1).alias("benign_min"), n(39).alias("benign_max"),
    )
    for edits, want in ((0, {0: ("L000", "AC"), 1: ("L000", "AC"), 2: ("L000", None), 3: ("L000", None)}), (1, {0: ("L000", "AC"), 1: ("L000", "AC"), 2: ("L001", "GGTT"), 3: ("L000", None)})):
        rows, most = widest(spark, lambda e=edits: disease.disease_screen(calls(spark, 300).withColumn("rep_units", n(1)), loci, max_edits=e, stranded=True))
        assert len(rows) == 300 and {r["n_nearby"] for r in rows} == {300}
        assert {r["k"] % 4: (r["locus"], r["matched_motif"]) for r in rows} == want
        assert most < 5000, most


def test_copies_in_first_in_window(spark):
    p, c = calls(spark, 300).drop("motif"), catalogue(spark, 300).selectExpr("r", "chrom as rc", "start as rs", "end as re")
    rows, most = widest(spark, lambda: intervals.first_in_window(p, c, "chrom", "point", "rc", "rs", "re", "r"))
    assert {(r["r"], r["distance"], r["n_nearby"]) for r in rows} == {(0, 0, 300)} and len(rows) == 300
    assert most < 5000, most


def test_copies_in_screen(spark):
    # copies of a call ask once; different motifs at a point and in an interval meet by their forms
    asked = calls(spark, 300).withColumn("motif", F.translate(F.lpad(F.conv(F.col("k").cast("string"), 10, 4), 6, "0"), "0123", "ACGT"))
    rows, most = widest(spark, lambda: screen.screen(asked, catalogue(spark, 300).withColumn("motif", F.translate(F.lpad(F.conv(F.col("r").cast("string"), 10, 4), 7, "0"), "0123", "ACGT")).drop("r"), "x_", window=10))
    assert len(rows) == 300 and {r["x_n_nearby"] for r in rows} == {300}
    assert {r["x_motif"] for r in rows if r["motif"] in ("AAAAAA", "ACGTAC")} == {"AAAAAAA"}
    assert {r["x_match"] for r in rows if r["motif"] == "AAAAAA"} == {"exact"} and {r["x_match"] for r in rows if r["motif"] == "AAAACC"} == {""}
    assert most < 5000, most


def test_copies_in_tolerant_screen(spark):
    how = Tolerance(max_edits=1, min_subrepeat_motif=1)
    rows, most = widest(spark, lambda: screen.screen(calls(spark, 300), catalogue(spark, 300).drop("r"), "x_", window=10, tolerance=how))
    assert {(r["motif"], r["x_motif"], r["x_match"], r["x_motif_edits"], r["x_n_nearby"]) for r in rows} == {("CA", "AC", "exact", 0, 300), ("AC", "AC", "exact", 0, 300), ("GGT", "GGTT", "fuzzy", 1, 300), ("T", "AC", "", 2, 300)}
    assert most < 5000, most


def test_no_segments_or_ancestors_broadcast(spark, monkeypatch):
    # a size estimated from the input takes what is made of it for small
    words = spark.range(50).select(F.translate(F.lpad(F.conv(F.col("id").cast("string"), 10, 4), 6, "0"), "0123", "ACGT").alias("m"))
    for out in (similar.similar_motifs(words, words.withColumnRenamed("m", "o"), "m", "o", 1), similar.similar_pairs(words, "m", 1)):
        text = out._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in text.splitlines() if "BroadcastHashJoin" in x and "_part" in x], text
    plans, keep = [], search.written

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, name)

    monkeypatch.setattr(search, "written", seen)
    edges = spark.range(1, 20).selectExpr("id as child", "id div 2 as parent").unionByName(spark.createDataFrame([(0, 7)], "child long, parent long"))
    found = {(r["term"], r["ancestor"]): r["depth"] for r in search.ancestors(edges).collect()}
    assert found[19, 9] == 1 and found[19, 0] == 5 and found[0, 0] == 4 and found[7, 7] == 4
    assert len(plans) > 4 and not [p for p in plans if "Broadcast" in p]


def test_longest_runs_of_many():
    import random
    import time

    draw = random.Random(3)
    seqs = ["", "A", "AA", "AB", "é漢é漢", "ACACACA"] + ["".join(draw.choice("ACGT"[: draw.randint(1, 4)]) for _ in range(draw.randint(0, 40))) for _ in range(5000)]
    start = time.perf_counter()
    each = [motifs.longest_run(x) for x in seqs]
    middle = time.perf_counter()
    assert list(zip(*motifs.longest_runs(seqs), strict=True)) == each
    # a sequence costs some numpy calls no longer
    assert 5 * (time.perf_counter() - middle) < middle - start


def test_levels_in_parts(spark, monkeypatch):
    monkeypatch.setattr(rollup, "ROWS", 1000, raising=False)
    df = spark.range(20000).selectExpr("'c' || id % 3 as c", "id % 2500 as p", "if(id % 50 = 0, null, id % 4000) as s", "id % 8 / 8 as v")
    levels = [["c", "p"], ["c"], []]
    rows, most, _ = fullest(spark, lambda: rollup.rolled_up(df, levels, "s", "v"))
    want = {(",".join(level), *(r[c] if c in level else None for c in "cp")): (r.n, r.s, r.v) for level in levels for r in df.groupBy(*level).agg(F.count("*").alias("n"), F.countDistinct("s").alias("s"), F.sum("v").alias("v")).collect()}
    assert {(r["level"], r["c"], r["p"]): (r["n_calls"], r["n_samples"], r["purity"]) for r in rows} == want
    assert most < 2000, most


def test_dominant_in_parts(spark, monkeypatch):
    monkeypatch.setattr(rollup, "ROWS", 1000, raising=False)
    df = spark.range(20000).selectExpr("id % 2000 as k", "id % 7 as m", "id div 3 as b", "id % 11 as q").unionByName(spark.createDataFrame([(None, None, 1, 2), (None, None, None, 3)], "k long, m long, b long, q long"))
    rows, most, _ = fullest(spark, lambda: rollup.dominant(df, ["k"], "m", "b", [F.max("q")]))
    n = df.groupBy("k", "m").agg(F.countDistinct("b").alias("n"), F.max("q").alias("q")).collect()
    best = {}
    for r in n:
        best[r.k] = max(best.get(r.k, (-1,)), (r.n, r.q, -(r.m or 0)))
    assert {r["k"]: (r["n_carriers"], -(r["m"] or 0)) for r in rows} == {k: (b[0], b[2]) for k, b in best.items()} and len(rows) == 2001
    assert most < 2000, most


def test_sites_are_exchanged_once(spark, monkeypatch):
    monkeypatch.setattr(rollup, "ROWS", 1000, raising=False)
    # a contig that is a constant: what is known of its value must not undo the partitioning
    df = spark.range(5000).selectExpr("'c1' as chrom", "if(id = 7, null, id % 400) as ins_coord", "cast(id % 3 as string) as SVID", "id as sample", "id % 9 as insert_size", "if(id % 2 = 0, 'CA', 'GGT') as canonical_motif", "2 as motif_length", "'known' as novelty", "1.0D as purity", "id % 5 as depth")
    rows, most, sent = fullest(spark, lambda: rollup.build_loci(df.unionByName(df), ()))
    got = {r["pos"]: (r["n_samples"], r["n_carrier_alleles"], r["n_alleles"], r["n_motifs"], r["mean_purity"], r["chrom"]) for r in rows}
    assert got[0] == (13, 13, 3, 1, 1.0, "c1") and got[7] == (12, 12, 3, 1, 1.0, "c1") and len(rows) == 400
    # copies included, for each of the three ways they are counted
    assert sent <= 3 * 10000 and most < 6000, (sent, most)


def test_readings_in_parts(spark, monkeypatch):
    monkeypatch.setattr(vcf, "ROWS", 1000, raising=False)
    long = spark.range(20000).selectExpr("concat('c', id div 20000) as CHROM", "id div 2 as POS", "concat('r', id div 20000) as ID", "if(id < 0, 'C', 'A') as REF", "if(id < 0, 'C', 'AC') as ALT", "cast(id % 2 as string) as sample", "map('GT', '0/1', 'SEQ', if(id % 2 = 0, 'AC', 'AG')) as fields")
    rows, most, _ = fullest(spark, lambda: vcf.readings(long, {"genotype": "GT", "sequence": "SEQ"}, 2))
    got = {r["kind"]: (r["alt"], r["n_records"], r["n_samples"], [(x["POS"], len(x["samples"])) for x in r["examples"]]) for r in rows}
    assert got == {k: ("literal", 10000, 20000, [(0, 2), (1, 2)]) for k in ("compared", "several_alleles")}
    assert most < 2000, most


@pytest.mark.parametrize("edits", [0, 1])
def test_crowded_points_in_screen(spark, edits):
    # points lie in many different intervals and are asked for with many motifs: what is near is told apart by motif before that
    asked = spark.range(2000).selectExpr("id as k", "'chr1' as chrom", "1000 + id % 40 as point", "substring(translate(md5(cast(id div 40 as string)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 12) as motif")
    known = spark.range(200).selectExpr("'chr1' as chrom", "900 - id as start", "1100 + id as end", "if(id % 2 = 0, 'AC', 'GGTT') as motif", "id % 3 as copy_num")
    same = asked.filter("k < 40").selectExpr("k + 5000 as k", "chrom", "point", "if(point % 2 = 0, 'CA', 'TTGG') as motif")
    rows, most = widest(spark, lambda: screen.screen(asked.unionByName(same), known, tolerance=Tolerance(max_edits=edits)))
    assert {r["n_nearby"] for r in rows} == {200} and len(rows) == 2040
    # most copies, then the first start
    assert {(r["novelty"], r["start"], r["motif"], r["distance"]) for r in rows} == {("novel_motif", 703, "GGTT", 0), ("known", 706, "AC", 0), ("known", 703, "GGTT", 0)}
    assert most < 20000, most
