"""The disease-locus screen: locus, then motif class, then allele class, then status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coords import normalize_chrom
from ..functions.motifs import Equivalence, rotation_distance, with_canonical
from ..sources.shared import written
from .intervals import window_join

CLASSES = ("pathogenic", "reference", "benign", "unknown", "interruption")
STATUSES = ("pathogenic_expansion", "pathogenic_motif", "locus_novel_motif", "locus_known_motif", "no_locus_match")


def allele_class(copies: Column, low_high: dict[str, tuple[Column, Column]]) -> Column:
    """The first class in the given order whose range, open where null, holds copies; unknown without copies or a range."""
    out = F.lit("unknown")
    for name, (lo, hi) in reversed(low_high.items()):
        some = lo.isNotNull() | hi.isNotNull()
        out = F.when(some & (lo.isNull() | (copies >= lo)) & (hi.isNull() | (copies <= hi)), name).otherwise(out)
    return F.when(copies.isNull(), "unknown").otherwise(out)


def copies_class(copies: Column, low_high: dict[str, tuple[Column, Column]]) -> Column:
    """The display's reading: a class needs a lower bound, and copies above the pathogenic range are pathogenic."""
    out = F.lit("unknown")
    for name, (lo, hi) in reversed(low_high.items()):
        inside = copies >= lo if name == "pathogenic" else (copies >= lo) & (hi.isNull() | (copies <= hi))
        out = F.when(lo.isNotNull() & inside, name).otherwise(out)
    return F.when(copies.isNull(), "unknown").otherwise(out)


def ranges() -> dict[str, tuple[Column, Column]]:
    return {k: (F.col(f"{k}_min"), F.col(f"{k}_max")) for k in ("pathogenic", "intermediate", "benign")}


def disease_screen(calls: DataFrame, loci: DataFrame, window: int = 0, max_edits: int = 0, stranded: bool = False, chrom: str = "chrom", point: str = "point", motif: str = "motif", units: str = "rep_units", gene: str = "gene") -> DataFrame:
    """calls with status, id, distance_bp, n_nearby, motif_class, motif_edits, matched_motif, est_copies, allele_class, gene_agrees.

    loci: id, gene, chrom, start, end, ref_copies, motifs (array of struct class, motif) and the ranges. Pairs are found by bins of a contig.
    """
    how = Equivalence(reverse_complement=not stranded)
    own = [c for c in calls.columns]
    # different queries are screened once, and rows follow by what they ask
    key = ["_chrom", "_point", "_motif"]
    q = calls.withColumns({"_chrom": normalize_chrom(F.col(chrom)), "_point": F.col(point).cast("long"), "_motif": F.coalesce(F.col(motif), F.lit(""))})
    asked = written(q.select(*key).distinct(), "asked")
    named = loci.select(*[F.col(c).alias(f"l_{c}") for c in loci.columns])
    # different points are looked up once among different intervals; what lies in an interval follows by its motif
    at, spot = ["_chrom", "_point"], ["l_chrom", "l_start", "l_end"]
    carried = ["l_gene", "l_ref_copies", *[f"l_{k}_{e}" for k in ranges() for e in ("min", "max")]]
    spots = named.groupBy(*spot).agg(F.count("*").alias("_n"), F.min(F.struct("l_id", *carried)).alias("_locus"))
    near = written(window_join(asked.select(*at).distinct(), spots, "_chrom", "_point", *spot, window).withColumnRenamed("distance", "distance_bp"), "near")
    other = near.groupBy(*at).agg(F.sum("_n").alias("n_nearby"), F.min(F.struct("distance_bp", "_locus")).alias("_other"))
    # canonical forms are computed once per different motif
    listed = named.select(*spot, "l_id", *carried, F.explode("l_motifs").alias("_x")).withColumn("_listed", F.col("_x.motif"))
    listed = with_canonical(listed.filter("_listed is not null"), "_listed", "_tc", how)
    rank = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("_x.class")).cast("int"), F.lit(len(CLASSES) + 1))
    listed = listed.select(*spot, "_tc", "l_id", *carried, rank.alias("rank"), F.col("_listed").alias("motif"))
    forms = with_canonical(asked, "_motif", "_qc", how).filter("_qc <> ''")
    # within a locus a later class wins with strictly fewer edits only, and an exact one ends the search
    if max_edits <= 0:
        first = F.min(F.struct("rank", "l_id", "motif", *carried)).alias("_t")
        met = forms.select(*at, F.col("_qc").alias("_mine"), F.col("_qc").alias("_tc")).distinct().join(near.select(*at, *spot, "distance_bp"), at)
        met = met.join(listed.groupBy(*spot, "_tc").agg(first), [*spot, "_tc"]).select(*at, "_mine", "distance_bp", F.lit(0).alias("edits"), "_t.*")
        mine = "_qc"
    else:
        met = forms.select(*at, "_motif").join(near.select(*at, *spot, "distance_bp"), at).join(listed, spot)
        # different pairs of motifs are compared once
        edits = rotation_distance(F.col("_p_motif"), F.col("_p_listed"), max_edits, how)
        pairs = met.select(F.col("_motif").alias("_p_motif"), F.col("motif").alias("_p_listed")).distinct().withColumn("edits", edits).filter(F.col("edits") <= max_edits)
        met = met.join(pairs, (F.col("_motif") == F.col("_p_motif")) & (F.col("motif") == F.col("_p_listed")))
        met = met.groupBy(*at, F.col("_motif").alias("_mine"), "l_id").agg(F.min(F.struct("edits", "rank", "motif", "distance_bp", *carried)).alias("_t")).select(*at, "_mine", "l_id", "_t.*")
        mine = "_motif"
    best = met.groupBy(*at, "_mine").agg(F.min(F.struct("rank", "edits", "distance_bp", "l_id", "motif", *carried)).alias("_best"))
    per = forms.withColumn("_mine", F.col(mine)).join(best, [*at, "_mine"]).select(*key, "_best")
    matched = F.col("_best").isNotNull()
    shown = [F.when(matched, F.col(f"_best.{c}")).otherwise(F.col(f"_other._locus.{c}")).alias(c) for c in ("l_id", *carried)]
    shown += [F.coalesce("_best.distance_bp", "_other.distance_bp").alias("distance_bp"), F.when(matched, F.struct("_best.edits", "_best.rank", "_best.motif")).alias("_b")]
    out = q.join(asked.join(other, at).join(per, key, "left").select(*key, "n_nearby", *shown), key, "left")
    kind = F.when(F.col("_b").isNull(), "none").otherwise(F.element_at(F.array(*[F.lit(c) for c in CLASSES]), F.col("_b.rank")))
    copies = F.col("l_ref_copies") + F.col(units)
    ranged = allele_class(copies, {k: (F.col(f"l_{k}_min"), F.col(f"l_{k}_max")) for k in ("pathogenic", "intermediate", "benign")})
    status = F.when(F.col("l_id").isNull(), "no_locus_match").when(F.col("_kind") == "none", "locus_novel_motif").when(
        F.col("_kind") == "pathogenic", F.when(F.col("_ranged") == "pathogenic", "pathogenic_expansion").otherwise("pathogenic_motif")
    ).otherwise("locus_known_motif")
    agrees = F.when((F.coalesce(F.col(gene), F.lit("")) != "") & F.col("l_id").isNotNull(), F.upper(F.trim(F.col(gene))) == F.upper(F.trim(F.col("l_gene")))) if gene in own else F.lit(None).cast("boolean")
    out = out.withColumn("_kind", kind).withColumn("_ranged", ranged)
    named_out = {
        "status": status, "locus": F.col("l_id"), "distance_bp": F.col("distance_bp"), "n_nearby": F.coalesce("n_nearby", F.lit(0)), "motif_class": F.col("_kind"), "motif_edits": F.col("_b.edits"),
        "matched_motif": F.col("_b.motif"), "est_copies": copies, "allele_class": F.col("_ranged"), "gene_agrees": agrees,
    }
    return out.select(*[c for c in own if c not in named_out], *[v.alias(k) for k, v in named_out.items()])


def as_text(screened: DataFrame, stamp: str) -> DataFrame:
    """The screen's columns as strings, blank where null, %g for copies."""
    shown = {c: F.coalesce(F.lower(F.col(c).cast("string")) if t == "boolean" else F.col(c).cast("string"), F.lit("")) for c, t in screened.dtypes}
    shown["est_copies"] = F.when(F.col("est_copies").isNull(), "").otherwise(F.regexp_replace(F.format_string("%.5f", F.col("est_copies")), r"\.?0+$", ""))
    return screened.select(*[v.alias(k) for k, v in shown.items()], F.lit(stamp).alias("catalog"))
