"""Cohort reports: samples and ancestry, carrier frequencies, motif landscapes, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.coords import MAIN_CHROMS
from .intervals import overlap_join
from .report import crosstab, doubling_edges, edge_bins, numbered, running_sum
from .quantiles import with_quantiles
from .screen import majority


def in_scope(df: DataFrame, chrom: str = "chrom") -> DataFrame:
    """Calls on chromosomes 1-22, X and Y."""
    return df.filter(F.col(chrom).isin(MAIN_CHROMS))


def with_ancestry(calls: DataFrame, ancestry: DataFrame, sample: str = "sample") -> tuple[DataFrame, DataFrame]:
    """calls with their sample's ancestry, and how many calls had none."""
    out = calls.join(ancestry, sample, "left")
    return out, out.agg(F.count_if(F.col("superpop").isNull()).alias("n_unmatched"))


def burden(calls: DataFrame, by: str, verdict: str, order: list[str], site: list[str]) -> DataFrame:
    """Per group and verdict: calls, and different sites; every verdict of order appears, with 0 where there is none."""
    n = calls.groupBy(by, verdict).agg(F.count("*").alias("n_calls"), F.countDistinct(*site).alias("n_sites"))
    every = calls.select(by).distinct().withColumn(verdict, F.explode(F.array(*[F.lit(v) for v in order])))
    return every.join(n, [by, verdict], "left").na.fill(0, ["n_calls", "n_sites"])


def per_sample(raw: DataFrame, calls: DataFrame, ancestry: DataFrame) -> DataFrame:
    """sample, ancestry, raw insertions and those with a repeat, for the samples that all three know."""
    tr = calls.groupBy("sample").agg(F.countDistinct("SVID").alias("n_insertions_tr"))
    return ancestry.join(raw, "sample").join(tr, "sample")


def ancestry_qc(raw: DataFrame, calls: DataFrame, ancestry: DataFrame) -> DataFrame:
    """Per group: samples known, called and with a repeat, and both insertion counts; a row of group null for called samples without ancestry."""
    tr = calls.groupBy("sample").agg(F.countDistinct("SVID").alias("n_insertions_tr"))
    known = ancestry.join(raw, "sample", "left").join(tr, "sample", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    by = known.groupBy("superpop").agg(F.count("*").alias("n_known"), F.count("n_insertions_raw").alias("n_called"), F.count("n_insertions_tr").alias("n_with_repeat"), total("n_insertions_raw").alias("raw"), total("n_insertions_tr").alias("with_repeat"))
    none = F.lit(0).cast("long")
    unknown = raw.join(ancestry.select("sample"), "sample", "left_anti").agg(F.lit(None).cast("string").alias("superpop"), none.alias("n_known"), F.count("*").alias("n_called"), none.alias("n_with_repeat"), F.sum("n_insertions_raw").cast("long").alias("raw"), none.alias("with_repeat"))
    return by.unionByName(unknown)


def population_summary(samples: DataFrame, by: str, value: str, order: list[str]) -> DataFrame:
    """count, mean and median per group, rounded half to even, in the given order."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(by))
    means = samples.groupBy(by).agg(F.count("*").alias("n"), F.bround(F.avg(value)).cast("long").alias("mean"))
    out = with_quantiles(means, samples, [by], {"median": (value, 0.5)}).withColumn("median", F.bround("median").cast("long"))
    return out.orderBy(F.when(place == 0, len(order) + 1).otherwise(place), by)


def carrier_frequency(calls: DataFrame, site: list[str], sample: str, verdict: str, n_genomes: int) -> DataFrame:
    """Sites per carrier-count bin (1, 2, 4, ...) and majority verdict."""
    one = calls.select(*site, sample, verdict).distinct()
    loci = one.groupBy(*site).agg(F.countDistinct(sample).alias("carriers")).join(majority(one, site, verdict), site)
    edges = doubling_edges(n_genomes)
    k = F.lit(None).cast("int")
    for i, e in enumerate(edges):
        k = F.when(F.col("carriers") >= e, i).otherwise(k)
    return loci.groupBy(k.alias("bin"), "verdict").agg(F.count("*").alias("n_sites"))


def by_motif_length(calls: DataFrame, length: str, insertion: list[str], sample: str, metrics: list[str]) -> DataFrame:
    """Hits, different insertions and samples, mean and median of the metrics (half to even) per motif length."""
    means = calls.groupBy(length).agg(F.count("*").alias("hits"), F.countDistinct(*insertion).alias("n_insertions"), F.countDistinct(sample).alias("n_samples"), *[F.bround(F.avg(m), 3).alias(f"mean_{m}") for m in metrics])
    out = with_quantiles(means, calls, [length], {f"median_{m}": (m, 0.5) for m in metrics})
    return out.select(length, "hits", "n_insertions", "n_samples", *[x for m in metrics for x in (f"mean_{m}", F.bround(f"median_{m}", 3).alias(f"median_{m}"))])


def comparison(df: DataFrame, by: str, categories: list[str], metrics: list[str]) -> DataFrame:
    """metric, then a column per category: count, share, mean and median of each metric."""
    total = df.agg(F.count("*").alias("_total"))
    agg = df.groupBy(by).agg(F.count("*").cast("double").alias("n"), *[F.round(F.avg(m), 4).alias(f"mean_{m}") for m in metrics])
    agg = with_quantiles(agg, df, [by], {f"median_{m}": (m, 0.5) for m in metrics}).withColumns({f"median_{m}": F.round(f"median_{m}", 4) for m in metrics})
    agg = agg.join(F.broadcast(total)).withColumn("pct", F.round(100 * F.col("n") / F.col("_total"), 4)).drop("_total")  # one row
    long = agg.unpivot(by, [c for c in agg.columns if c != by], "metric", "value")
    return long.groupBy("metric").pivot(by, categories).agg(F.first("value"))


def motif_ranks(calls: DataFrame, motif: str) -> DataFrame:
    """motif, n, and its rank by frequency; equal counts by motif."""
    n = calls.groupBy(motif).agg(F.count("*").alias("n"))
    return numbered(n, [F.col("n").desc(), F.col(motif)], "rank").withColumn("rank", (F.col("rank") + 1).cast("int"))


def site_landscape(calls: DataFrame, site: list[str], sample: str, motif: str, first_by: str) -> DataFrame:
    """Per site: calls, samples, motifs, and the motif of its first call."""
    return calls.groupBy(*site).agg(F.count("*").alias("n_calls"), F.countDistinct(sample).alias("n_samples"), F.countDistinct(motif).alias("n_motifs"), F.min_by(motif, F.struct(first_by, motif)).alias("first_motif"))


def sensitivity(truth: DataFrame, found: DataFrame, chrom: str, start: str, end: str, f_chrom: str, f_start: str, f_end: str) -> DataFrame:
    """total, true_positives, missed and sensitivity (4 decimals, 0 without truth) of intervals that any found one overlaps."""
    t = truth.select(chrom, start, end).distinct()
    hit = overlap_join(t, found, chrom, start, end, f_chrom, f_start, f_end, "left_semi").withColumn("_hit", F.lit(1))
    one = t.join(hit, [chrom, start, end], "left").agg(F.count("*").alias("total"), F.count("_hit").alias("true_positives"))
    return one.select("total", "true_positives", (F.col("total") - F.col("true_positives")).alias("missed"), F.round(F.coalesce(F.col("true_positives") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0)), 4).alias("sensitivity"))


def agreement_rate(df: DataFrame, a: Column, b: Column) -> DataFrame:
    return df.agg(F.round(F.avg((a == b).cast("double")), 6).alias("agreement"))


def percentile_rows(df: DataFrame, value: str, tie: str, shares: list[float]) -> DataFrame:
    """The rows at index int(p (n - 1)) of the sorted table. Indices come from the count; ranks from a running sum over values."""
    counts = running_sum(df.groupBy(value).agg(F.count("*").alias("_n")), value, "_n", "_end")
    known = counts.join(F.broadcast(counts.agg(F.sum("_n").alias("_total"))))  # one row
    wanted = known.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).withColumn("_at", F.floor(F.col("share") * (F.col("_total") - 1)))
    hit = wanted.filter((F.col("_at") < F.col("_end")) & (F.col("_at") >= F.col("_end") - F.col("_n"))).select(value, "share", (F.col("_at") - F.col("_end") + F.col("_n") + 1).alias("_rn"))
    rows = df.join(hit.select(value).distinct(), value).withColumn("_rn", F.row_number().over(Window.partitionBy(value).orderBy(tie)))
    return rows.join(hit, [value, "_rn"]).drop("_rn")


__all__ = ["agreement_rate", "burden", "by_motif_length", "carrier_frequency", "comparison", "crosstab", "edge_bins", "in_scope", "motif_ranks", "per_sample", "percentile_rows", "population_summary", "sensitivity", "site_landscape", "with_ancestry"]
