"""What the pages ask for: one locus with its alleles, the cohort's summary, and the disease catalogue with the calls screened against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coords import chrom_order
from ..functions.text import explode_values
from .disease import STATUSES
from .serve import contains_ci, funnel, priority

#: Loci count as confident repeats from this purity on.
CONFIDENT = 0.8


def locus_detail(loci: DataFrame, segs: DataFrame | None, locus_id: str) -> tuple[DataFrame, DataFrame | None]:
    """The locus's row, and its alleles, longest first, each with its segments in order."""
    row = loci.filter(F.col("locus_id") == locus_id)
    if segs is None:
        return row, None
    own = segs.filter(F.col("locus_id") == locus_id)
    own = own if "allele" in own.columns else own.withColumn("allele", F.lit(1))
    parts = F.array_sort(F.collect_list(F.struct("seg_index", *[c for c in own.columns if c not in ("locus_id", "sample", "allele", "seg_index")])))
    alleles = own.groupBy("sample", "allele").agg(parts.alias("segments"), F.max("end").alias("allele_len"))
    return row, alleles.orderBy(F.col("allele_len").desc(), "sample", "allele")


def structures(arch: DataFrame) -> DataFrame:
    """Grouped structures in the order they are shown: longest first, then most carriers, then by text."""
    return arch.orderBy(F.col("max_len").desc(), F.col("carriers").desc(), "architecture")


def cohort_size(loci: DataFrame, segs: DataFrame | None) -> DataFrame:
    """How many samples there are; without a segment table, the busiest locus is the best lower bound."""
    return segs.agg(F.countDistinct("sample").cast("long").alias("cohort_size")) if segs is not None else loci.agg(F.max("n_samples").cast("long").alias("cohort_size"))


def cohort_funnel(loci: DataFrame) -> DataFrame:
    """stage, place, n. The stages in genes are there only where the table has gene columns."""
    stages = {"loci": F.lit(True), "not a homopolymer": F.col("motif_class") != "homopolymer", "confident": F.col("mean_purity") >= CONFIDENT, "novel": F.col("novel")}
    if "genic" in loci.columns:
        stages["in a gene"] = F.col("genic")
        if "disease_gene" in loci.columns:
            return funnel(loci, {**stages, "in a disease gene": F.col("disease_gene")})
    return funnel(loci, stages)


def breakdown(loci: DataFrame, column: str) -> DataFrame:
    """value, n, n_novel: most frequent first, contigs in genomic order."""
    n = loci.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"), F.count_if("novel").alias("n_novel"))
    return n.orderBy(chrom_order(F.col("value")).asc_nulls_last(), "value") if column == "chrom" else n.orderBy(F.col("n").desc(), "value")


def disease_totals(curated: DataFrame) -> DataFrame:
    return curated.agg(
        F.count("*").alias("n_loci"), F.count_if("novel_in_reference").alias("n_novel_in_reference"), F.count("pathogenic_min").alias("n_with_range"), F.count_if(F.col("ref_copies").isNull()).alias("n_without_ref_copies"),
    )


def by_inheritance(curated: DataFrame) -> DataFrame:
    """Inheritance holds several values."""
    return explode_values(curated, "inheritance", "value").groupBy("value").agg(F.count("*").alias("n"))


def screened_totals(calls: DataFrame) -> DataFrame:
    """status, n_rows, n_loci, and the nearest distance of a hit."""
    hit = F.coalesce(F.col("locus"), F.lit("")) != ""
    return calls.groupBy("status").agg(F.count("*").alias("n_rows"), F.countDistinct("chrom", "ins_coord").alias("n_loci"), F.min(F.when(hit, F.col("distance_bp").try_cast("long"))).alias("nearest_hit_bp"))


def disease_list(curated: DataFrame, novel_only: bool = False, evidence: str | None = None, inheritance: str | None = None, gene: str | None = None, text: str | None = None, limit: int = 200) -> tuple[DataFrame, DataFrame]:
    """The loci, novel in the reference first, and how many there are without the limit."""
    keep: list[Column] = [F.col("novel_in_reference")] if novel_only else []
    keep += [F.col("evidence") == evidence] if evidence else []
    keep += [F.contains(F.col("inheritance"), F.lit(inheritance))] if inheritance else []
    keep += [F.upper("gene") == gene.upper()] if gene else []
    keep += [contains_ci(F.col("gene"), text) | contains_ci(F.col("disease"), text) | contains_ci(F.col("id"), text)] if text else []
    for k in keep:
        curated = curated.filter(k)
    return curated.orderBy(F.col("novel_in_reference").desc(), "gene", "id").limit(limit), curated.agg(F.count("*").alias("total"))


def disease_matches(calls: DataFrame, status: str | None = None, limit: int = 200) -> DataFrame:
    """Calls at a disease locus: by status, then the nearest first."""
    hit = calls.filter((F.coalesce(F.col("locus"), F.lit("")) != "") & (F.lit(True) if status is None else F.col("status") == status))
    rank = priority("status", {s: k for k, s in enumerate(STATUSES)})
    return hit.orderBy(rank, F.col("distance_bp").try_cast("long").asc_nulls_last(), "chrom", "ins_coord", "sample").limit(limit)


def with_missing(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with the columns it lacks, as nulls of their types: what a table built without a catalogue still has to offer."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def newest_first(files: DataFrame, time: str, name: str) -> DataFrame:
    return files.orderBy(F.col(time).desc(), name)
