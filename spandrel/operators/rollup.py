"""Call tables to locus and segment tables, and the checks that guard them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.coords import point_distance
from ..functions.motifs import size_class
from ..functions.text import catalogues
from ..sources.shared import written
from .intervals import best_hit, overlap_join, segments
from .screen import verdict_of, verdict_rank

SITE = ["chrom", "ins_coord"]

#: Rows that a task groups at once. Spark joins small partitions by their packed bytes and splits files so too, which says little about what a row takes in memory.
ROWS = 250_000
#: Shares of the largest group for each partition, so that no share fills one.
SHARES = 8


def partitions(df: DataFrame) -> int:
    """So many partitions that each has ROWS rows of df or fewer on average; the session's number at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS))


def dominant(df: DataFrame, keys: list[str], member: str, by: str, order: list[Column] = ()) -> DataFrame:
    """Per key the member with most different values of by; further order, then the member itself, break ties. order: maxima.

    A member's rows are counted in shares of by, and a key's members ranked in shares of their own, so neither meets whole; no task gets more rows than its part of all.
    """
    n = partitions(df)
    share = lambda c: F.pmod(F.xxhash64(c), F.lit(SHARES * n))
    tops = [f"_o{k}" for k in range(len(order))]
    apart = df.withColumn("_s", share(by)).repartition(n, *keys, member, "_s").groupBy(*keys, member, "_s").agg(F.countDistinct(by).alias("n_carriers"), *[c.alias(o) for o, c in zip(tops, order, strict=True)])
    counted = apart.withColumn("_m", share(member)).repartition(n, *keys, "_m").groupBy(*keys, "_m", member).agg(F.sum("n_carriers").alias("n_carriers"), *[F.max(o).alias(o) for o in tops])
    best = [F.col("n_carriers").desc(), *[F.col(o).desc() for o in tops], F.col(member)]
    return best_hit(best_hit(counted, [*keys, "_m"], best).repartition(n, *keys), keys, best).select(*keys, member, "n_carriers")


def median_member(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Per key the row in the middle of a total order; the lower one of an even number.

    Rows are sorted range by range, so a frequent key lies in many; places are counted in each range after the rows of the key in the ranges before.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = written(df.repartitionByRange(n, *keys, *order).withColumn("_r", F.spark_partition_id()), "median")
    sizes = part.groupBy(*keys, "_r").agg(F.count("*").alias("_n"))  # a row for each key and range
    own = Window.partitionBy(*keys)
    upto = F.sum("_n").over(own.orderBy("_r"))
    middle = F.expr("(_t + 1) div 2") - F.col("_b")
    held = sizes.withColumn("_b", upto - F.col("_n")).withColumn("_t", F.sum("_n").over(own)).select(*[F.col(c).alias(f"_k_{c}") for c in keys], F.col("_r").alias("_k_r"), "_n", middle.alias("_at")).filter("_at between 1 and _n")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys])
    placed = part.join(held, same & (F.col("_r") == F.col("_k_r"))).withColumn("_rn", F.row_number().over(Window.partitionBy("_r", *keys).orderBy(*order)))
    return placed.filter("_rn = _at").select(*df.columns)


def build_loci(calls: DataFrame, platforms: tuple[str, ...] = ("ucsc", "trexplorer"), invariant: list[str] = ()) -> DataFrame:
    """One row per (chrom, ins_coord): counts, medians, rounded means, conservative verdicts, and the dominant record's screen result.

    invariant: columns that are the same on every call of a site; a value that isn't null is taken.
    """
    # one exchange: what follows groups by the site and more, which its partitioning already serves. The site is one column, as a contig that is a constant would leave the keys but not the partitioning
    calls = calls.dropna(subset=SITE)
    calls = calls.withColumn("_site", F.struct(*SITE)).drop(*SITE).repartition(partitions(calls), "_site").distinct()
    held = [c for c in calls.columns if any(c.startswith(f"{p}_") for p in platforms) and not c.endswith("_novelty")]
    own = ["canonical_motif", "motif_length", *held]
    verdicts = [c for c in ("novelty", *(f"{p}_novelty" for p in platforms)) if c in calls.columns]
    mean = {c: a for c, a in {"purity": "mean_purity", "insertion_purity": "insertion_purity", "repeat_coverage": "repeat_coverage"}.items() if c in calls.columns}
    median = {c: a for c, a in {"insert_size": "median_len", "rep_units": "median_units", "depth": "median_depth"}.items() if c in calls.columns}
    # a null sorts after values within a record, as in a sort with nulls last
    first = F.min(F.struct(*[x for k, c in enumerate(own) for x in (F.col(c).isNull().alias(f"n{k}"), F.col(c).alias(c))])).alias("own")
    records = calls.groupBy("_site", "SVID").agg(
        F.countDistinct("sample").alias("carriers"),
        F.count("*").alias("n"),
        F.max((F.col("novelty") != "known").cast("int")).alias("is_novel"),
        F.min("insert_size").alias("low"),
        F.max("insert_size").alias("high"),
        *[x for c in mean for x in (F.sum(c).alias(f"s_{c}"), F.count(c).alias(f"c_{c}"))],
        *[F.min(verdict_rank(F.col(c))).alias(f"v_{c}") for c in verdicts],
        first,
    )
    top = F.min(F.struct((-F.col("carriers")).alias("a"), F.col("high").isNull().alias("n"), (-F.col("high")).alias("b"), F.col("SVID"), F.col("own"))).alias("top")
    sites = records.groupBy("_site").agg(
        F.sum("n").alias("n_carrier_alleles"),
        F.count("*").alias("n_alleles"),
        F.sum(F.coalesce("is_novel", F.lit(0))).alias("n_novel_alleles"),
        F.min("low").alias("min_len"),
        F.max("high").alias("max_len"),
        *[F.round(F.sum(f"s_{c}") / F.nullif(F.sum(f"c_{c}"), F.lit(0)), 6).alias(a) for c, a in mean.items()],
        *[verdict_of(F.min(f"v_{c}")).alias(c) for c in verdicts],
        top,
    )
    # different samples are counted apart: with them, medians would be kept for every sample
    samples = calls.groupBy("_site").agg(F.countDistinct("sample").alias("n_samples"))
    rest = calls.groupBy("_site").agg(F.size(F.collect_set("canonical_motif")).cast("long").alias("n_motifs"), *[F.median(c).alias(a) for c, a in median.items()], *[F.any_value(c, ignoreNulls=True).alias(c) for c in invariant])
    order = ["n_samples", "n_carrier_alleles", "n_alleles", "n_motifs", "n_novel_alleles", "min_len", "max_len", *median.values(), *mean.values(), *verdicts, *invariant]
    out = sites.join(samples, "_site").join(rest, "_site").select(*[F.col("_site")[c].alias(c) for c in SITE], *order, F.col("top.SVID").alias("SVID"), *[F.col(f"top.own.{c}").alias(c) for c in own])
    known = {p: F.col(f"{p}_novelty") == "known" for p in platforms if f"{p}_novelty" in verdicts}
    return out.select(
        F.concat_ws(":", "chrom", "ins_coord").alias("locus_id"),
        "chrom",
        F.col("ins_coord").alias("pos"),
        F.col("canonical_motif").alias("motif"),
        F.col("motif_length").cast("int").alias("motif_len"),
        size_class(F.col("motif_length")).alias("motif_class"),
        *order,
        (F.col("novelty") != "known").alias("novel"),
        (catalogues(**known) if known else F.lit(None).cast("string")).alias("catalogs"),
        F.col("SVID").alias("representative_svid"),
        *held,
    )


def build_segments(calls: DataFrame) -> DataFrame:
    """Structural blocks of every carrier's alleles; alleles of a sample are numbered by falling length."""
    a = calls.select(F.concat_ws(":", "chrom", "ins_coord").alias("locus_id"), "sample", "SVID", "insert_size", "rep_start", "rep_end", "canonical_motif", "purity", "rep_units").distinct()
    w = Window.partitionBy("locus_id", "sample").orderBy(F.col("insert_size").desc(), "SVID", "rep_start", "rep_end", "canonical_motif", "purity", "rep_units")
    return segments(a.withColumn("allele", F.row_number().over(w)), ["locus_id", "sample", "allele"], motif="canonical_motif")


def with_disease_loci(loci: DataFrame, curated: DataFrame, window: int = 10) -> DataFrame:
    """loci with the nearest curated locus within window; ties go to the smaller id."""
    s = curated.select(*[F.col(c).alias(f"s_{c}") for c in curated.columns]).withColumns({"_from": F.col("s_start") - window, "_to": F.col("s_end") + window + 1})
    asked = loci.select("locus_id", "chrom", "pos").withColumn("_next", F.col("pos") + 1)
    hit = overlap_join(asked, s, "chrom", "pos", "_next", "s_chrom", "_from", "_to").withColumn("disease_distance_bp", point_distance(F.col("pos"), F.col("s_start"), F.col("s_end")))
    first = best_hit(hit, ["locus_id"], [F.col("disease_distance_bp"), F.col("s_id")]).select("locus_id", "disease_distance_bp", *[F.col(f"s_{c}").alias(f"disease_{c}") for c in curated.columns if c not in ("chrom", "start", "end")])
    return loci.join(first, "locus_id", "left").withColumn("disease_locus", F.col("disease_id").isNotNull())


def invariance_violations(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys where a column that should be the same on every row is not, with the counts of different values."""
    n = df.groupBy(*keys).agg(*[F.countDistinct(c).alias(c) for c in columns])
    bad = F.lit(False)
    for c in columns:
        bad = bad | (F.col(c) > 1)
    return n.filter(bad)


def dedupe_report(df: DataFrame) -> DataFrame:
    n = df.groupBy(*df.columns).count()
    return n.agg(F.sum("count").alias("n_rows"), F.count("*").alias("n_distinct"), F.sum(F.col("count") - 1).alias("n_duplicates"))


def checked_left_join(left: DataFrame, right: DataFrame, on: list[str], suffix: str = "_right") -> DataFrame:
    """A left join that first makes sure that right has at most one row for each key; clashing names get the suffix."""
    twice = right.groupBy(*on).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"the right side repeats the key {tuple(twice[0])[:-1]}")
    clash = {c: c + suffix for c in right.columns if c in left.columns and c not in on}
    return left.join(right.withColumnsRenamed(clash), on, "left")


def architecture(segs: DataFrame, keys: list[str]) -> DataFrame:
    """Per allele: its structure as text, such as CAG×12-AT×3 with inner flanks as -, and its length."""
    token = F.when(F.col("seg_type") == "repeat", F.concat(F.col("motif"), F.lit("×"), F.round("units").cast("int").cast("string"))).otherwise("-")
    parts = F.array_sort(F.collect_list(F.struct("seg_index", token.alias("t"))))
    text = F.array_join(F.transform(parts, lambda p: p["t"]), "|")
    trimmed = F.regexp_replace(text, r"^(?:-\|)+|(?:\|-)+$", "")
    return segs.groupBy(*keys).agg(trimmed.alias("architecture"), F.max("end").alias("allele_len"))


def group_structures(arch: DataFrame, locus: str, sample: str) -> DataFrame:
    """Per locus and structure: carriers, shortest and longest allele."""
    return arch.groupBy(locus, "architecture").agg(F.countDistinct(sample).alias("carriers"), F.min("allele_len").alias("min_len"), F.max("allele_len").alias("max_len"))


def nest_segments(segs: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return segs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seg_index", *columns))).alias("segments"), F.max("end").alias("allele_len"))


def array_counts(segs: DataFrame) -> DataFrame:
    """How many repeat blocks the median-length allele of each locus has."""
    keys = ["locus_id", "sample", *(["allele"] if "allele" in segs.columns else [])]
    a = segs.groupBy(*keys).agg(F.max("end").alias("allele_len"), F.count_if(F.col("seg_type") == "repeat").alias("n_arrays"))
    order = [F.col("allele_len"), F.col("sample"), *([F.col("allele")] if "allele" in keys else [])]
    return median_member(a, ["locus_id"], order).select("locus_id", "n_arrays")


def rolled_up(calls: DataFrame, levels: list[list[str]], sample: str, purity: str) -> DataFrame:
    """One table of several levels: level (the names of its columns), the columns (null where a level hasn't got them), calls, different samples, the sum of purity and how many have one.

    Calls are brought together once by all columns and the sample; each of these rows, which are fewer than calls, gives one to every level. A level's group is counted in shares of
    its samples, so none meets whole; no task gets more calls, or rows of levels, than its part of all.
    """
    columns = list(dict.fromkeys(c for level in levels for c in level))
    n = partitions(calls)
    fine = calls.repartition(n, *columns, sample).groupBy(*columns, sample).agg(F.count("*").alias("_n"), F.sum(purity).alias("_p"), F.count(purity).alias("_np"))
    kept = lambda c: F.when(F.array_contains(F.lit([k for k, level in enumerate(levels) if c in level]), F.col("_l")), F.col(c)).alias(c)
    sums = [F.sum(c).alias(c) for c in ("_n", "_p", "_np")]
    each = fine.withColumn("_l", F.explode(F.lit(list(range(len(levels)))))).select("_l", *[kept(c) for c in columns], sample, F.pmod(F.xxhash64(sample), F.lit(SHARES * n)).alias("_s"), "_n", "_p", "_np")
    of_sample = each.repartition(n * len(levels), "_l", *columns, "_s").groupBy("_l", *columns, "_s", sample).agg(*sums)
    shares = of_sample.groupBy("_l", *columns, "_s").agg(*sums, F.count(sample).alias("_k")).repartition(n, "_l", *columns)
    out = shares.groupBy("_l", *columns).agg(F.sum("_n").alias("n_calls"), F.sum("_k").alias("n_samples"), F.round(F.sum("_p"), 4).alias("purity"), F.sum("_np").alias("n_purity"))
    level = F.get(F.lit([",".join(c for c in columns if c in level) for level in levels]), F.col("_l"))
    return out.select(level.alias("level"), *columns, "n_calls", "n_samples", "purity", "n_purity")
