"""Every operator of the library over the driver's tables, one query each. SQL with the same results is in oracles.py."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import coords, motifs, text
from ..operators import disease, intervals, repeats, report, rollup, screen, search, serve, similar

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- stand-ins: the driver's tables read as calls, catalogues, loci and alleles -----------------------------------

def _dna(key, n: int = 6):
    """A made-up motif of up to n bases from a number."""
    return F.substring(F.translate(F.md5(key.cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT"), F.lit(1), (F.pmod(key, F.lit(n)) + 1).cast("int"))


def _points(spark, sf_dir) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    return c.select("c_custkey", F.concat(F.lit("chr"), "c_nationkey").alias("chrom"), F.floor("c_acctbal").cast("long").alias("point"), _dna(F.col("c_custkey"), 3).alias("motif"))


def _catalogue(spark, sf_dir) -> DataFrame:
    s = _t(spark, sf_dir, "supplier")
    start = F.floor("s_acctbal").cast("long")
    return s.select("s_suppkey", F.concat(F.lit("chr"), "s_nationkey").alias("chrom"), start.alias("start"), (start + 500).alias("end"), _dna(F.col("s_suppkey"), 3).alias("motif"))


def _named(cat: DataFrame) -> DataFrame:
    return cat.select(F.col("s_suppkey").alias("r_id"), F.col("chrom").alias("r_chrom"), F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("motif").alias("r_motif"))


def _loci(spark, sf_dir) -> DataFrame:
    """Orders as loci."""
    o = _t(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.concat_ws(":", F.concat(F.lit("chr"), F.pmod(k, F.lit(24)) + 1), k).alias("locus_id"), F.concat(F.lit("chr"), F.pmod(k, F.lit(24)) + 1).alias("chrom"), k.alias("pos"),
        (F.pmod(F.col("o_custkey"), F.lit(9)) + 1).cast("int").alias("motif_len"), F.pmod(F.col("o_custkey"), F.lit(50)).cast("int").alias("n_samples"), F.col("o_totalprice").alias("median_len"),
        F.round(F.pmod(k, F.lit(101)) / 100, 2).alias("mean_purity"), (F.col("o_orderstatus") == "O").alias("novel"), F.col("o_orderpriority").alias("gene"),
    )


# --- B, D, F: serving -------------------------------------------------------------------------------------------------


@query
def funnel_counts(spark, sf_dir):
    stages = {"all": F.lit(True), "quantity": F.col("l_quantity") >= 10, "discount": F.col("l_discount") >= 0.03, "returned": F.col("l_returnflag") == "R", "late": F.col("l_tax") > 0.04}
    return serve.funnel(_t(spark, sf_dir, "lineitem"), stages)


@query
def filtered_page(spark, sf_dir):
    df, _ = serve.filtered(_loci(spark, sf_dir), novel_only=True, min_motif_len=3, min_purity=0.5, exonic_only=True)
    return serve.page(df, serve.order_by("size"), 50, 20).select("locus_id", "chrom", "pos", "motif_len", "median_len")


@query
def filtered_sort_position(spark, sf_dir):
    df, _ = serve.filtered(_loci(spark, sf_dir), region="chr3:1,000-400000", gene_query="urgent")
    return serve.page(df, serve.order_by("position", "desc"), 100).select("locus_id", "pos", "gene")


@query
def constrained_only(spark, sf_dir):
    """Loci of genes that stand little loss, and the page that a sort without its table falls back to."""
    loci = _loci(spark, sf_dir).withColumn("pli", F.col("mean_purity") * 1.0)
    got = serve.list_loci(loci, sort="arrays", direction="desc", limit=50, constrained_only=True, min_samples=10)
    return got["rows"].select("locus_id", "pli", F.lit(got["sort"]).alias("sort"), F.lit(got["total"]).cast("long").alias("total"))


@query
def calls_in_scope(spark, sf_dir):
    """Calls on the main chromosomes only: of numbered and lettered contigs, and of others."""
    from ..operators import cohort

    k = F.col("l_suppkey") % 30
    name = F.when(k < 25, k.cast("string")).when(k == 25, "X").when(k == 26, "Y").when(k == 27, "M").otherwise(F.concat(F.lit("Un_"), k))
    calls = _t(spark, sf_dir, "lineitem").select(F.concat(F.lit("chr"), name).alias("chrom"))
    return cohort.in_scope(calls).groupBy("chrom").agg(F.count("*").alias("n"))


@query
def first_listed(spark, sf_dir):
    """The first of values listed with semicolons, and the first of different ones."""
    v = F.concat_ws(";", F.col("p_brand"), F.col("p_brand"), F.col("p_type"))
    return _t(spark, sf_dir, "part").select("p_partkey", text.first_of(v, ";").alias("first"), text.first_distinct(v, ";").alias("only"), text.first_of(F.col("p_name"), ";").alias("alone"))


@query
def filter_gene_list(spark, sf_dir):
    df, _ = serve.filtered(_loci(spark, sf_dir), genes=["1-urgent", "5-LOW"], chrom="chr7")
    return df.select("locus_id", "gene")


@query
def class_breakdown(spark, sf_dir):
    p = _t(spark, sf_dir, "part").withColumn("motif_class", motifs.size_class(F.col("p_size")))
    return p.groupBy("motif_class").agg(F.count("*").alias("n"), F.count_if(F.col("p_retailprice") > 1000).alias("n_dear"))


@query
def priority_sort(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    rank = serve.priority("o_orderpriority", {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2})
    return o.orderBy(rank, F.col("o_totalprice").desc(), "o_orderkey").limit(200).select("o_orderkey", "o_orderpriority", rank.alias("rank"))


@query
def like_search(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    return p.filter(F.lower("p_name").like("%ed%") | serve.contains_ci(F.col("p_brand"), "#1")).select("p_partkey", "p_name", "p_brand")


@query
def agreement_modes(spark, sf_dir):
    """How many calls of each sample every mode of the agreement filter leaves."""
    calls, parts = _calls(spark, sf_dir), []
    for mode in (*screen.AGREEMENT, None):
        df, ignored = serve.filtered(calls, platform_agreement=mode)
        parts.append(df.groupBy((F.col("sample") % 10).alias("sample")).agg(F.count("*").alias("n")).withColumn("mode", F.lit(mode or "any")).withColumn("n_ignored", F.lit(len(ignored))))
    return reduce(DataFrame.unionByName, parts)


@query
def sample_filter(spark, sf_dir):
    """One sample's calls that only the first catalogue calls new; a filter its table has no column for is named."""
    df, ignored = serve.filtered(_calls(spark, sf_dir), sample=1, platform_agreement="ucsc_only", min_samples=2)
    return df.select("sample", "ins_coord", "SVID", "depth", F.lit(",".join(ignored)).alias("ignored"))


@query
def tag_filter(spark, sf_dir):
    checks = [("quantity", F.col("l_quantity"), 5.0), ("discount", F.col("l_discount"), 0.02), ("tax", F.nullif(F.col("l_tax"), F.lit(0.0)), 0.03), ("off", F.col("l_tax"), None)]
    return _t(spark, sf_dir, "lineitem").withColumn("filter", screen.filter_tags(checks)).groupBy("filter").agg(F.count("*").alias("n"))


@query
def filter_chain_funnel(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").withColumn("coverage", F.when(F.col("l_quantity") > 0, F.col("l_tax") * 100 / F.col("l_quantity")).otherwise(0.0))
    checks = {"keep": F.col("l_returnflag").isin("A", "N"), "coverage": F.col("coverage") >= 0.1, "size": F.col("l_quantity") <= 30, "depth": F.col("l_extendedprice") >= 5000}
    return report.filter_chain(li, checks)[1]


@query
def copy_number_class(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    n = lambda x: F.lit(x).cast("double")
    low_high = {"pathogenic": (n(40), n(None)), "intermediate": (n(30), n(39)), "benign": (n(None), n(20))}
    size = F.col("p_size").cast("double")
    return p.groupBy(disease.allele_class(size, low_high).alias("allele_class"), disease.copies_class(size, low_high).alias("copies_class")).agg(F.count("*").alias("n"))


# --- D, E, J16, J17: rollups --------------------------------------------------------------------------------------


@query
def representative_member(spark, sf_dir):
    return rollup.median_member(_t(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query
def dominant_record(spark, sf_dir):
    return rollup.dominant(_t(spark, sf_dir, "lineitem"), ["l_partkey"], "l_suppkey", "l_orderkey", [F.max("l_quantity")])


def _verdicts(spark, sf_dir):
    flag = F.element_at(F.create_map(*[F.lit(x) for x in ("A", "known", "N", "novel_motif", "R", "novel_locus")]), F.col("l_returnflag"))
    return _t(spark, sf_dir, "lineitem").withColumn("verdict", flag)


@query
def verdict_rollup_min(spark, sf_dir):
    return _verdicts(spark, sf_dir).groupBy("l_orderkey").agg(screen.rollup("verdict").alias("verdict"))


@query
def verdict_rollup_majority(spark, sf_dir):
    return screen.majority(_verdicts(spark, sf_dir), ["l_orderkey"], "verdict")


@query
def verdict_combined(spark, sf_dir):
    v = _verdicts(spark, sf_dir).withColumn("other", F.when(F.col("l_linestatus") == "O", "novel_motif").otherwise("unscreened"))
    return v.groupBy(screen.combined(F.col("verdict"), F.col("other")).alias("verdict")).agg(F.count("*").alias("n"))


def _spans(spark, sf_dir):
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", day.alias("rep_start"), (day + F.col("l_quantity").cast("long")).alias("rep_end"))


@query
def interval_union(spark, sf_dir):
    u = intervals.union_length(_spans(spark, sf_dir), ["l_orderkey"], "rep_start", "rep_end")
    return u.groupBy("l_orderkey").agg(F.max("union_length").alias("covered"), F.count("*").alias("n"))


@query
def insertion_purity(spark, sf_dir):
    s = _spans(spark, sf_dir).withColumn("insert_size", F.when(F.col("l_orderkey") % 7 != 0, F.lit(120).cast("long")))
    u = intervals.insertion_purity(s, ["l_orderkey"])
    return u.groupBy("l_orderkey").agg(F.max("insertion_purity").alias("insertion_purity"))


def _alleles(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    start = (F.col("l_discount") * 100).cast("int") - 2
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.greatest(start, F.lit(0)).alias("rep_start"), (F.greatest(start, F.lit(0)) + F.col("l_quantity").cast("int")).alias("rep_end"),
        (F.greatest(start, F.lit(0)) + F.col("l_quantity").cast("int") + (F.col("l_tax") * 100).cast("int") % 3).alias("insert_size"), _dna(F.col("l_partkey"), 4).alias("motif"), F.col("l_tax").alias("purity"), F.col("l_quantity").alias("rep_units"),
    )


@query
def segments_build(spark, sf_dir):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    s = intervals.segments(_alleles(spark, sf_dir), keys)
    return s.groupBy("seg_type", "seg_index").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("bases"), F.countDistinct("motif").alias("n_motifs"))


@query
def segment_architecture(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    segs = c.select("conv_id", F.col("turn").cast("int").alias("seg_index"), F.when(F.col("role") == "system", "flank").otherwise("repeat").alias("seg_type"), F.col("role").alias("motif"), F.lit(1.0).alias("units"), (F.col("turn") + 1).alias("end"))
    a = rollup.architecture(segs, ["conv_id"]).withColumn("locus", F.lit(1))
    return rollup.group_structures(a, "locus", "conv_id").drop("locus")


@query
def nested_segments(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seg_index"), "role", (F.col("turn") + 1).alias("end"))
    n = rollup.nest_segments(c, ["conv_id"], ["role", "end"])
    return n.select("conv_id", F.size("segments").alias("n"), "allele_len", F.array_join(F.transform("segments", lambda s: s["role"]), ",").alias("roles"))


def _calls(spark, sf_dir):
    """Line items as calls: a site is a part, a record its supplier, a sample its order."""
    li = _t(spark, sf_dir, "lineitem")
    verdict = lambda c: F.when(c % 4 == 0, "known").when(c % 4 == 1, "novel_motif").when(c % 4 == 2, "novel_locus").otherwise("unscreened")
    return li.select(
        F.lit("chr1").alias("chrom"), F.col("l_partkey").alias("ins_coord"), F.col("l_suppkey").cast("string").alias("SVID"), F.col("l_orderkey").alias("sample"), F.col("l_suppkey").alias("insert_size"), _dna(F.col("l_suppkey"), 4).alias("canonical_motif"),
        (F.pmod(F.col("l_suppkey"), F.lit(4)) + 1).cast("int").alias("motif_length"), (F.col("l_extendedprice") / 7e5).alias("purity"), (F.col("l_extendedprice") / 9e5).alias("insertion_purity"), F.col("l_discount").alias("repeat_coverage"), F.col("l_quantity").alias("rep_units"),
        F.col("l_linenumber").alias("depth"), verdict(F.col("l_suppkey")).alias("novelty"), verdict(F.col("l_suppkey") + 1).alias("ucsc_novelty"), verdict(F.col("l_suppkey") + 2).alias("trexplorer_novelty"), F.pmod(F.col("l_suppkey"), F.lit(7)).alias("ucsc_n_nearby"),
    )


@query
def loci_build(spark, sf_dir):
    out = rollup.build_loci(_calls(spark, sf_dir))
    return out.select("locus_id", "pos", "motif", "motif_len", "motif_class", "n_samples", "n_carrier_alleles", "n_alleles", "n_motifs", "n_novel_alleles", "min_len", "max_len", "median_len", "median_units", "median_depth", "mean_purity", "insertion_purity", "novelty", "ucsc_novelty", "novel", "catalogs", "representative_svid", "ucsc_n_nearby")


@query
def invariance_report(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    return rollup.invariance_violations(li, ["l_orderkey"], ["l_returnflag", "l_linestatus"])


@query
def dedupe_report(spark, sf_dir):
    return rollup.dedupe_report(_t(spark, sf_dir, "documents").select("text", "lang", "source"))


@query
def any_value_block(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier").join(_t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.groupBy("s_nationkey").agg(F.any_value("n_name", ignoreNulls=True).alias("n_name"), F.count("*").alias("n"))


@query
def array_count_sort(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    segs = li.select(F.col("l_partkey").alias("locus_id"), F.col("l_orderkey").alias("sample"), F.when(F.col("l_returnflag") == "N", "repeat").otherwise("flank").alias("seg_type"), F.col("l_quantity").cast("int").alias("end"))
    return rollup.array_counts(segs).orderBy(F.col("n_arrays").desc(), "locus_id").limit(100)


@query
def disease_locus_join(spark, sf_dir):
    points = _points(spark, sf_dir).select(F.col("c_custkey").alias("locus_id"), "chrom", F.col("point").alias("pos"))
    curated = _catalogue(spark, sf_dir).select(F.col("s_suppkey").alias("id"), "chrom", "start", "end")
    return rollup.with_disease_loci(points, curated, 10)


# --- C: joins --------------------------------------------------------------------------------------------------------


@query
def range_join_best_hit(spark, sf_dir):
    p, c = _points(spark, sf_dir), _named(_catalogue(spark, sf_dir))
    out = intervals.first_in_window(p, c, "chrom", "point", "r_chrom", "r_start", "r_end", "r_id", 10)
    return out.select("c_custkey", "r_id", "distance", "n_nearby")


@query
def range_join_pairs(spark, sf_dir):
    a = _named(_catalogue(spark, sf_dir))
    b = a.select(*[F.col(c).alias("o" + c) for c in a.columns])
    j = intervals.overlap_join(a, b, "r_chrom", "r_start", "r_end", "or_chrom", "or_start", "or_end").filter("r_id < or_id")
    return j.select("r_id", "or_id", (F.least("r_end", "or_end") - F.greatest("r_start", "or_start")).alias("shared"))


def _short_catalogue(spark, sf_dir):
    """The same starts, but intervals short enough to leave points outside."""
    return _named(_catalogue(spark, sf_dir).withColumn("end", F.col("start") + 60))


def _intervals_of_points(spark, sf_dir):
    return _points(spark, sf_dir).withColumn("stop", F.col("point") + 1)


@query
def range_semi(spark, sf_dir):
    return intervals.overlap_join(_intervals_of_points(spark, sf_dir), _short_catalogue(spark, sf_dir), "chrom", "point", "stop", "r_chrom", "r_start", "r_end", "left_semi").select("c_custkey", "chrom", "point")


@query
def range_anti(spark, sf_dir):
    return intervals.overlap_join(_intervals_of_points(spark, sf_dir), _short_catalogue(spark, sf_dir), "chrom", "point", "stop", "r_chrom", "r_start", "r_end", "left_anti").select("c_custkey", "chrom", "point")


@query
def range_overlap_fraction(spark, sf_dir):
    a, b = _named(_catalogue(spark, sf_dir)), _short_catalogue(spark, sf_dir)
    b = b.select(*[F.col(c).alias("o" + c) for c in b.columns])
    j = intervals.overlap_join(a, b, "r_chrom", "r_start", "r_end", "or_chrom", "or_start", "or_end")
    return j.filter(intervals.overlap_fraction_at_least("r_start", "r_end", "or_start", "or_end", 0.5)).select("r_id", "or_id")


@query
def coverage_unscreened(spark, sf_dir):
    # every other contig of the points, and those past the suppliers' nations, have no interval at all
    points = _points(spark, sf_dir).withColumn("chrom", F.concat(F.lit("chr"), 2 * F.substring("chrom", 4, 9).cast("int")))
    out = screen.screen(points, _catalogue(spark, sf_dir).drop("s_suppkey"), window=10)
    return out.select("c_custkey", "novelty", F.col("n_nearby").cast("long").alias("n_nearby"))


@query
def novelty_screen(spark, sf_dir):
    out = screen.screen(_points(spark, sf_dir).withColumnRenamed("motif", "q_motif"), _catalogue(spark, sf_dir), prefix="ucsc_", motif="q_motif", window=25)
    return out.select("c_custkey", "ucsc_novelty", F.col("ucsc_n_nearby").cast("long").alias("ucsc_n_nearby"), "ucsc_start", "ucsc_distance", "ucsc_motif", "ucsc_match")


@query
def novelty_screen_tolerant(spark, sf_dir):
    out = screen.screen(_points(spark, sf_dir).withColumnRenamed("motif", "q_motif"), _catalogue(spark, sf_dir), motif="q_motif", window=25, tolerance=motifs.Tolerance(max_edits=1, min_subrepeat_motif=1))
    return out.groupBy("novelty", "match").agg(F.count("*").alias("n"), F.sum("motif_edits").alias("edits"))


@query
def disease_screen(spark, sf_dir):
    s = _catalogue(spark, sf_dir)
    n = lambda x: F.lit(x).cast("double")
    loci = s.select(
        F.concat(F.lit("L"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("id"), F.lit("G").alias("gene"), "chrom", "start", "end", F.lit(10.0).alias("ref_copies"),
        F.array(F.struct(F.lit("pathogenic").alias("class"), F.col("motif").alias("motif")), F.struct(F.lit("reference").alias("class"), F.lit("ACG").alias("motif"))).alias("motifs"),
        n(40).alias("pathogenic_min"), n(None).alias("pathogenic_max"), n(None).alias("intermediate_min"), n(None).alias("intermediate_max"), n(1).alias("benign_min"), n(39).alias("benign_max"),
    )
    calls = _points(spark, sf_dir).withColumn("rep_units", F.pmod(F.col("c_custkey"), F.lit(60)).cast("double")).withColumn("gene", F.lit("g"))
    out = disease.disease_screen(calls, loci, window=50)
    return out.groupBy("status", "motif_class", "allele_class", "gene_agrees").agg(F.count("*").alias("n"), F.sum("n_nearby").alias("nearby"))


@query
def nearest_locus(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("k"), F.floor(F.col("c_acctbal") * 100).cast("long").alias("at"))
    s = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.floor(F.col("s_acctbal") * 100).cast("long").alias("s_at"), "s_suppkey")
    return intervals.nearest(c, s, ["k"], "at", "s_at", "s_suppkey").select("c_custkey", "nearest_s_suppkey", "nearest_distance")


@query
def annotation_join_checked(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size")
    j = rollup.checked_left_join(_t(spark, sf_dir, "lineitem"), p, ["l_partkey"])
    return j.groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("p_size").alias("total_size"), F.count_if(F.col("p_size").isNull()).alias("unmatched"))


@query
def completeness_check(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").filter("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return report.unmatched(_t(spark, sf_dir, "customer"), o, ["c_custkey"])


@query
def gene_join(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select(F.col("p_name").alias("gene_symbol"), F.col("p_brand").alias("hpo_id"))
    terms = _t(spark, sf_dir, "part").filter("p_size = 50").select(F.col("p_brand").alias("hpo_id"))
    return search.genes_for_terms(p, terms, placeholder="-")


@query
def related_terms(spark, sf_dir):
    edges = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("child"), F.col("n_regionkey").cast("long").alias("parent"))
    return search.related_terms(edges.select(F.col("parent").alias("term")).distinct(), edges)


# --- G, H: functions ---------------------------------------------------------------------------------------------


def _motif_rows(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", _dna(F.col("p_partkey"), 12).alias("motif"))


@query
def canonical_motif(spark, sf_dir):
    m = motifs.with_canonical(_motif_rows(spark, sf_dir), "motif", "canonical")
    return m.select("p_partkey", "motif", "canonical")


@query
def canonical_motif_both_strands(spark, sf_dir):
    m = _motif_rows(spark, sf_dir)
    return m.select("p_partkey", motifs.canonical_motif(F.col("motif"), motifs.Equivalence(reverse_complement=True)).alias("canonical"), motifs.reverse_complement(F.col("motif")).alias("rc"), F.round(motifs.gc_content(F.col("motif")), 6).alias("gc"))


@query
def edit_distance_pairs(spark, sf_dir):
    return similar.similar_pairs(_t(spark, sf_dir, "part"), "p_name", 3)


@query
def similar_motif_pairs(spark, sf_dir):
    """Motifs of parts within one edit of a supplier's, in any rotation."""
    s = _t(spark, sf_dir, "supplier").select(_dna(F.col("s_suppkey") + 7, 9).alias("other"))
    return similar.similar_motifs(_motif_rows(spark, sf_dir), s, "motif", "other", 1)


@query
def term_ancestors(spark, sf_dir):
    """All ancestors in a graph where most terms have two parents (so ways up part and meet again), with the fewest steps."""
    c, k = _t(spark, sf_dir, "customer"), F.col("c_custkey")
    up = lambda d: c.select(k.alias("child"), F.floor(k / d).cast("long").alias("parent")).filter("child <> parent")
    return search.ancestors(up(2).unionByName(up(3)))


@query
def rolled_up(spark, sf_dir):
    """Calls by site and verdict, by site, by contig and verdict, and all together, in one pass."""
    calls = _calls(spark, sf_dir).withColumn("chrom", F.concat(F.lit("chr"), F.col("ins_coord") % 5))
    return rollup.rolled_up(calls, [["chrom", "ins_coord", "novelty"], ["chrom", "ins_coord"], ["chrom", "novelty"], ["chrom"], []], "sample", "repeat_coverage")


@query
def stream_new_files(spark, sf_dir):
    """Events that arrive as two lots of files, the second with late repeats of the first: a bounded stream takes each lot when it is there, and
    its state drops what it has seen."""
    from ..sources.shared import scratch
    from ..streaming.files import append_distinct

    e = _t(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    src, out, state = (scratch(spark, f"events-{n}") for n in ("in", "out", "state"))
    lots = [e.filter("event_id % 3 <> 0"), e.filter("event_id % 3 = 0 or event_id % 5 = 0")]
    for lot in lots:
        lot.write.mode("append").parquet(src)
        append_distinct(spark, src, out, state, e.schema, ["event_id"], "ts", "100000 days")
    return spark.read.schema(e.schema).parquet(out).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("n_events"), F.round(F.sum("value"), 2).alias("total"))


@query
def rotation_distance(spark, sf_dir):
    m = _motif_rows(spark, sf_dir)
    d = motifs.rotation_distance(F.col("motif"), F.lit("ACGTT"), 2)
    return m.groupBy(d.alias("edits")).agg(F.count("*").alias("n"))


@query
def interval_distances(spark, sf_dir):
    c = _named(_catalogue(spark, sf_dir))
    d = coords.interval_distance(F.col("r_start"), F.col("r_end"), F.lit(3000), F.lit(3600))
    return c.select("r_id", d.alias("distance"), coords.point_distance(F.lit(3000), F.col("r_start"), F.col("r_end")).alias("point_distance"))


@query
def chrom_sort(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") == 23, "chrX").when(F.col("n_nationkey") == 24, "chrUn").otherwise(F.concat(F.lit("chr"), F.col("n_nationkey"))).alias("chrom"))
    return n.select("chrom", coords.chrom_order(F.col("chrom")).alias("place"))


@query
def multi_value_explode(spark, sf_dir):
    w = text.explode_values(_t(spark, sf_dir, "part"), "p_name", "word", " ")
    return w.groupBy("word").agg(F.count("*").alias("n"))


@query
def collapse_repeats(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_repeat("p_brand", F.pmod(F.col("p_size"), F.lit(4)) + 1), ", ").alias("v"))
    return p.select("p_partkey", text.collapse(F.col("v")).alias("collapsed"), text.first_of(F.col("v")).alias("first"), text.first_distinct(F.col("v")).alias("only"))


@query
def parse_fields(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    return c.select("c_custkey", text.first_integer(F.concat(F.lit("[-"), F.col("c_custkey"), F.lit("]"))).alias("size"), text.sum_list(F.concat_ws(",", "c_custkey", "c_nationkey")).alias("depth"), text.blank(F.when(F.col("c_custkey") % 2 == 0, " , ,").otherwise(F.col("c_mktsegment"))).alias("kept"))


@query
def props_map(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("k", F.from_json("props", "map<string,int>")["k"])
    return e.groupBy("event_type").agg(F.sum("k").alias("total_k"), F.count_if(F.col("k") > 50).alias("n_large"))


@query
def info_fields(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    info = text.info_map(F.concat(F.lit("SVTYPE="), F.col("l_returnflag"), F.lit(";PRECISE;SVLEN="), F.col("l_linenumber")))
    return li.select(info.alias("i")).groupBy(F.col("i")["SVTYPE"].alias("svtype"), F.col("i")["PRECISE"].alias("precise")).agg(F.sum(F.col("i")["SVLEN"].cast("long")).alias("svlen"))


@query
def mention_coverage(spark, sf_dir):
    return search.coverage(_t(spark, sf_dir, "documents"), "text", ["the", "and"], ["license"])


@query
def query_ladder(spark, sf_dir):
    s = {"narrow": ["the", "and", "license"], "middle": ["the", "license"], "wide": ["license"], "none": ["zzzz"]}
    return search.ladder(_t(spark, sf_dir, "documents"), "text", s, ["public"])


@query
def best_query(spark, sf_dir):
    """The strategy chosen from the ladder: the most specific that finds anything and whose finds mention enough; also under a stricter demand."""
    s = {"narrow": ["the", "and", "license"], "middle": ["the", "license"], "wide": ["license"], "other": ["and"], "none": ["zzzz"]}
    scored = search.ladder(_t(spark, sf_dir, "documents"), "text", s, ["public"])
    found = [search.best_strategy(scored, least).select(F.lit(least).alias("least"), "strategy", "specificity", "hits") for least in (0.5, 0.0, 1.0)]
    return reduce(DataFrame.unionByName, found)


@query
def compression_ratio(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.round(text.ratio_of_deflate(F.col("text")), 6).alias("ratio"))


@query
def longest_pure_segments(spark, sf_dir):
    d = _t(spark, sf_dir, "part").select("p_partkey", F.concat(F.repeat(_dna(F.col("p_partkey"), 5), F.pmod(F.col("p_size"), F.lit(9)) + 1), _dna(F.col("p_partkey") + 7, 9)).alias("seq"))
    return d.select("p_partkey", motifs.longest_pure_segment(F.col("seq")).alias("r")).select("p_partkey", "r.motif", "r.copies")


@query
def tandem_repeats(spark, sf_dir):
    d = _t(spark, sf_dir, "part").select("p_partkey", F.concat(_dna(F.col("p_partkey") + 3, 9), F.repeat(_dna(F.col("p_partkey"), 5), F.lit(8)), _dna(F.col("p_partkey") + 7, 9)).alias("seq"))
    return motifs.repeats(d, "seq").drop("seq")


@query
def indel_repeats(spark, sf_dir):
    """Repeats of eight copies from which a base is missing in one place and that have one too many in another."""
    unit = _dna(F.col("p_partkey"), 6)
    d = _t(spark, sf_dir, "part").select("p_partkey", F.concat(_dna(F.col("p_partkey") + 3, 9), F.repeat(unit, F.lit(3)), F.substring(unit, F.lit(2), F.lit(9)), F.repeat(unit, F.lit(2)), F.lit("T"), F.repeat(unit, F.lit(2)), _dna(F.col("p_partkey") + 7, 9)).alias("seq"))
    return repeats.indel_repeats(d, "seq", max_motif=12).drop("seq")


# --- D, J29 ff.: reports --------------------------------------------------------------------------------------------


@query
def pivot_zero_fill(spark, sf_dir):
    values = ["O", "F", "X"]
    return report.row_percent(report.crosstab(_t(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", values), values)


@query
def sfs_bins(spark, sf_dir):
    n = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("carriers"))
    return report.edge_bins(n, "carriers", report.doubling_edges(67))


@query
def equal_width_histogram(spark, sf_dir):
    return report.equal_bins(_t(spark, sf_dir, "lineitem"), "l_quantity", 10, 1, 50)


@query
def log_histogram(spark, sf_dir):
    return report.log_bins(_t(spark, sf_dir, "events"), "value", 2)


@query
def overflow_pool(spark, sf_dir):
    return report.pooled(_t(spark, sf_dir, "lineitem"), "l_quantity", 40.0)


@query
def ecdf(spark, sf_dir):
    return report.ecdf(_t(spark, sf_dir, "part"), "p_size")


@query
def threshold_ladder(spark, sf_dir):
    return report.ladder(_t(spark, sf_dir, "orders"), "o_totalprice", [1000, 50000, 100000, 200000, 400000])


@query
def class_summary(spark, sf_dir):
    return report.summary(_t(spark, sf_dir, "part"), ["p_brand"], ["p_size", "p_retailprice"])


@query
def box_outliers(spark, sf_dir):
    return report.outliers(_t(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")


@query
def top_values(spark, sf_dir):
    return report.top(_t(spark, sf_dir, "lineitem"), "l_partkey", 25)


@query
def top_with_other(spark, sf_dir):
    return report.with_other(_t(spark, sf_dir, "part").withColumn("p_size", F.col("p_size").cast("long")), "p_brand", "p_size", 3)


@query
def share_of_total(spark, sf_dir):
    return report.share_of_total(_t(spark, sf_dir, "documents"), "lang")


@query
def distinct_per_group(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag").agg(F.countDistinct("l_partkey", "l_suppkey").alias("n_pairs"), F.countDistinct(F.when(F.col("l_linestatus") == "O", F.col("l_suppkey"))).alias("n_open_suppliers"), F.max_by("l_orderkey", F.struct("l_extendedprice", "l_orderkey")).alias("dearest"))


@query
def kmer_spectrum(spark, sf_dir):
    return report.kmer_spectrum(_t(spark, sf_dir, "documents"), "text", 4)


@query
def kmer_spectrum_dna(spark, sf_dir):
    """Both strands as one, and nothing that holds N."""
    p = _t(spark, sf_dir, "part").select(F.concat(_dna(F.col("p_partkey"), 12), F.when(F.col("p_size") % 5 == 0, "N").otherwise(""), F.lower(_dna(F.col("p_partkey") + 1, 12))).alias("seq"))
    return report.kmer_spectrum(p, "seq", 3, strands=True)


@query
def jaccard_agreement(spark, sf_dir):
    n = _t(spark, sf_dir, "labels").select(F.when(F.col("quality") == 1, "known").otherwise("novel_locus").alias("a"), F.when(F.col("toxic") == 0, "known").otherwise("novel_motif").alias("b"))
    return screen.agreement(n, ["a", "b"]).select(F.round("agreement", 6).alias("agreement"))


@query
def balanced_accuracy(spark, sf_dir):
    n = _t(spark, sf_dir, "labels")
    return n.agg(F.round(screen.balanced_accuracy(F.col("quality") == 1, F.col("toxic") == 0), 6).alias("balanced_accuracy"))


@query
def grid_sweep(spark, sf_dir):
    grid = {"quantity": [10, 20, 30, 40], "discount": [0.02, 0.05, 0.08]}
    rule = lambda s: (F.col("l_quantity") >= s["quantity"]) & (F.col("l_discount") >= s["discount"])
    return screen.sweep_filters(_t(spark, sf_dir, "lineitem"), grid, rule, "l_orderkey").withColumnRenamed("n_units", "n_orders")


@query
def set_operations(spark, sf_dir):
    c, s = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), _t(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    kinds = {"both": c.intersect(s), "either": c.union(s).distinct(), "only_first": c.subtract(s)}
    out = None
    for name, df in kinds.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query
def unpivot_metrics(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.round(F.avg("o_totalprice"), 2).alias("mean"), F.round(F.max("o_totalprice"), 2).alias("max"))
    return o.unpivot("o_orderstatus", ["mean", "max"], "metric", "value")


# --- L5: vectors; windows over events (an extension) ---------------------------------------------------------------


@query
def knn_cosine(spark, sf_dir):
    v = _t(spark, sf_dir, "embeddings")
    q = v.filter("vec_id = 0").select("embedding").first()["embedding"]
    out = search.nearest_vectors(v, q, 10, 0.5, "vec_id", "embedding")
    return out.select("vec_id", F.round("score", 4).alias("score"), "accepted")


@query
def event_windows(spark, sf_dir):
    from ..streaming.files import windowed_counts

    return windowed_counts(_t(spark, sf_dir, "events"), "ts", "event_type", "value", "1 day")


@query
def event_sessions(spark, sf_dir):
    from ..streaming.files import sessions

    return sessions(_t(spark, sf_dir, "events"), "ts", "user_id", "6 hours")


# --- J29 ff.: cohorts, validation, display ---------------------------------------------------------------------------


def _samples(spark, sf_dir, known: str = "true"):
    return _t(spark, sf_dir, "customer").filter(known).select(F.col("c_custkey").alias("sample"), F.col("c_mktsegment").alias("superpop"))


@query
def ancestry_burden(spark, sf_dir):
    from ..operators import cohort

    calls = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sample"), F.col("o_orderstatus").alias("verdict"), "o_orderdate", "o_orderpriority")
    df, _ = cohort.with_ancestry(calls, _samples(spark, sf_dir, "c_acctbal > 0"))
    return cohort.burden(df.filter("superpop is not null"), "superpop", "verdict", ["F", "O", "P", "X"], ["o_orderdate", "o_orderpriority"])


@query
def population_summary(spark, sf_dir):
    from ..operators import cohort

    n = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("sample")).agg(F.count("*").alias("n_orders"))
    return cohort.population_summary(_samples(spark, sf_dir).join(n, "sample"), "superpop", "n_orders", ["BUILDING", "MACHINERY"])


@query
def per_sample_table(spark, sf_dir):
    from ..operators import cohort

    raw = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("sample")).agg(F.count("*").alias("n_insertions_raw"))
    calls = _t(spark, sf_dir, "orders").filter("o_totalprice > 50000").select(F.col("o_custkey").alias("sample"), F.col("o_orderpriority").alias("SVID"))
    return cohort.per_sample(raw, calls, _samples(spark, sf_dir))


@query
def carrier_frequency(spark, sf_dir):
    from ..operators import cohort

    return cohort.carrier_frequency(_verdicts(spark, sf_dir), ["l_partkey"], "l_orderkey", "verdict", 67)


@query
def motif_length_summary(spark, sf_dir):
    from ..operators import cohort

    li = _t(spark, sf_dir, "lineitem")
    return cohort.by_motif_length(li, "l_linenumber", ["l_partkey", "l_suppkey"], "l_orderkey", ["l_quantity"])


@query
def category_comparison(spark, sf_dir):
    from ..operators import cohort

    return cohort.comparison(_t(spark, sf_dir, "lineitem"), "l_returnflag", ["A", "N", "R"], ["l_quantity", "l_linenumber"])


@query
def motif_ranks(spark, sf_dir):
    from ..operators import cohort

    return cohort.motif_ranks(_t(spark, sf_dir, "part"), "p_name")


@query
def site_landscape(spark, sf_dir):
    from ..operators import cohort

    return cohort.site_landscape(_t(spark, sf_dir, "lineitem"), ["l_partkey"], "l_orderkey", "l_suppkey", "l_orderkey")


@query
def validation_sensitivity(spark, sf_dir):
    from ..operators import cohort

    return cohort.sensitivity(_intervals_of_points(spark, sf_dir), _named(_catalogue(spark, sf_dir)), "chrom", "point", "stop", "r_chrom", "r_start", "r_end")


@query
def agreement_rate(spark, sf_dir):
    from ..operators import cohort

    return cohort.agreement_rate(_t(spark, sf_dir, "labels"), F.col("quality") == 1, F.col("toxic") == 0)


@query
def percentile_rows(spark, sf_dir):
    from ..operators import cohort

    return cohort.percentile_rows(_t(spark, sf_dir, "part").select("p_size", "p_partkey"), "p_size", "p_partkey", [0.0, 0.25, 0.5, 0.9, 1.0])


@query
def stacked_histogram(spark, sf_dir):
    from ..operators import display

    return display.stacked_histogram(_t(spark, sf_dir, "part"), "p_size", "p_type", display.nice_step(49, 12))


@query
def display_scales(spark, sf_dir):
    from ..operators import display

    p = _t(spark, sf_dir, "part")
    top = p.agg(display.axis_max(F.col("p_retailprice")).alias("top"))
    return p.join(F.broadcast(top)).select("p_partkey", F.round(display.log_percent(F.col("p_size"), F.col("top")), 6).alias("place"), F.round(display.row_width(F.col("p_size"), F.lit(50)), 6).alias("width"))


@query
def exon_ladder(spark, sf_dir):
    from ..operators import display

    p = _t(spark, sf_dir, "part")
    return p.select("p_partkey", F.array_join(display.exon_ladder(F.col("p_size").cast("int"), F.lit(50)), ",").alias("ladder"))


@query
def dominant_motifs(spark, sf_dir):
    from ..operators import display

    segs = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.lit("repeat").alias("seg_type"), F.col("l_returnflag").alias("motif"), F.lit(0).alias("start"), F.col("l_quantity").cast("long").alias("end"), F.col("l_linenumber").cast("long").alias("units"))
    return display.dominant_motifs(segs, ["l_orderkey"])


from . import product_queries, source_queries  # noqa: E402, F401  they register themselves
