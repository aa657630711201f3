"""What a display derives from results: scales, bins, labels and records."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import quantiles


def nice_step(span: float, bins: int) -> float:
    """A bin width of 1, 2 or 5 times a power of ten that gives at most so many bins."""
    if span <= 0:
        return 1.0
    raw = span / bins
    power = 10 ** math.floor(math.log10(raw))
    return next(k * power for k in (1, 2, 5, 10) if k * power >= raw - 1e-12)


def stacked_histogram(df: DataFrame, value: str, series: str, step: float, medians: bool = False) -> DataFrame:
    """from (of each bin), series, n; with medians also each series' median."""
    n = df.groupBy((F.floor(F.col(value) / step) * step).cast("double").alias("from"), series).agg(F.count("*").alias("n"))
    return n.join(quantiles(df, [series], {"median": (value, 0.5)}), series) if medians else n


def axis_max(values: Column) -> Column:
    """Aggregate: the next power of ten at or above the largest value, 10 at least."""
    return F.greatest(F.lit(10.0), F.pow(F.lit(10.0), F.ceil(F.log10(F.max(values)))))


def log_percent(value: Column, top: Column) -> Column:
    """Place on a log1p scale from 0 to top, in percent, held within it."""
    return F.least(F.greatest(100 * F.log1p(value) / F.log1p(top), F.lit(0.0)), F.lit(100.0))


def row_width(length: Column, longest: Column, least: float = 4.0) -> Column:
    """Width in percent that grows as the square root of a length."""
    return F.greatest(F.lit(least), 100 * F.sqrt(length / longest))


def clean_prose(text: Column) -> Column:
    """Text without citation marks such as [1], [@x; @y] or (PMID: 1), and without the spaces they leave."""
    out = F.regexp_replace(text, r"\[(?:@[^\]]*|\d+(?:[,-]\s*\d+)*)\]|\(PMIDs?:[^)]*\)", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\s+([.,;])", "$1"), r"\s{2,}", " "))


def short_authors(authors: Column, most: int = 3) -> Column:
    """The first authors, and how many more there are."""
    a = F.filter(F.transform(F.split(authors, ","), lambda x: F.trim(x)), lambda x: x != "")
    more = F.size(a) - most
    first = F.array_join(F.slice(a, 1, most), ", ")
    return F.when(more > 0, F.concat(first, F.lit(" +"), more.cast("string"))).otherwise(first)


def snippet(text: Column, most: int = 300) -> Column:
    """The start of a text up to the last sentence end within most characters."""
    head = F.substring(text, 1, most)
    upto = F.regexp_extract(head, r"(?s)^(.*[.!?])(?:\s|$)", 1)
    return F.when(F.length(text) <= most, text).when(upto != "", upto).otherwise(F.concat(head, F.lit("...")))


def paper(record: DataFrame) -> DataFrame:
    """id, title, authors, journal (from the nested record, else the flat one), year, cited, snippet."""
    return record.select(
        F.coalesce("pmid", "id").alias("id"), F.regexp_replace("title", r"\.$", "").alias("title"), short_authors(F.col("authorString")).alias("authors"), F.coalesce("journalInfo.journal.title", "journalTitle").alias("journal"),
        F.col("pubYear").try_cast("int").alias("year"), F.coalesce(F.col("citedByCount").cast("int"), F.lit(0)).alias("cited"), snippet(F.col("abstractText")).alias("snippet"),
    )


def exon_ladder(index: Column, total: Column, around: int = 1) -> Column:
    """Exons to draw: the first, the last and those around index; -1 stands for a gap that is left out."""
    shown = F.array_sort(F.array_distinct(F.filter(F.concat(F.array(F.lit(1), total), F.sequence(index - around, index + around)), lambda x: (x >= 1) & (x <= total))))
    return F.transform(F.array(shown), lambda s: F.flatten(F.transform(s, lambda x, i: F.when((i > 0) & (x - F.get(s, i - 1) > 1), F.array(F.lit(-1), x)).otherwise(F.array(x)))))[0]


def reference_hits(df: DataFrame, platforms: list[str]) -> DataFrame:
    """df with hits: an array of the catalogues' best intervals that exist, with their span."""
    each = [F.when(F.col(f"{p}_start").isNotNull(), F.struct(F.lit(p).alias("platform"), F.col(f"{p}_start").alias("start"), F.col(f"{p}_end").alias("end"), (F.col(f"{p}_end") - F.col(f"{p}_start")).alias("span"))) for p in platforms]
    return df.withColumn("hits", F.filter(F.array(*each), lambda x: x.isNotNull()))


def dominant_motifs(segs: DataFrame, keys: list[str]) -> DataFrame:
    """Per allele: the motif with most bases, its copies and bases."""
    s = segs.filter("seg_type = 'repeat'").groupBy(*keys, "motif").agg(F.sum(F.col("end") - F.col("start")).alias("bases"), F.sum("units").alias("copies"))
    return s.groupBy(*keys).agg(F.max_by(F.struct("motif", "bases", "copies"), F.struct("bases", "motif")).alias("d")).select(*keys, "d.*")
