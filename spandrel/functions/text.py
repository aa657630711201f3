"""Text and multi-value fields as Columns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_integer(text: Column) -> Column:
    """The size in "415", "[415]" or "[-415]": its absolute value; null if there is none."""
    return F.abs(F.nullif(F.regexp_extract(text, r"(-?[0-9]+)", 1), F.lit("")).try_cast("long"))


def blank(text: Column) -> Column:
    """null where a text holds only commas and spaces."""
    return F.nullif(F.regexp_replace(text, r"^[\s,]*$", ""), F.lit(""))


def sum_list(text: Column) -> Column:
    """The sum of "12,30"; null if a part is no number."""
    return F.aggregate(F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def first_of(text: Column, sep: str = ", ") -> Column:
    return F.get(F.split(text, re.escape(sep)), F.lit(0))


def first_distinct(text: Column, sep: str = ", ") -> Column:
    return F.get(F.array_distinct(F.split(text, re.escape(sep))), F.lit(0))


def collapse(text: Column, sep: str = ", ") -> Column:
    """A list that is some shorter list repeated, written once: "a, b, a, b" is "a, b"."""
    s = re.escape(sep)
    return F.regexp_replace(text, rf"^(.+?)(?:{s}\1)+$", "$1")


def values(text: Column, sep: str = ";") -> Column:
    """The trimmed, non-empty values of a list written as text."""
    return F.filter(F.transform(F.split(text, re.escape(sep)), lambda x: F.trim(x)), lambda x: x != "")


def explode_values(df: DataFrame, column: str, out: str, sep: str = ";") -> DataFrame:
    return df.withColumn(out, F.explode(values(F.col(column), sep)))


def catalogues(**flags: Column) -> Column:
    """The names whose flag holds, joined by ;, or null."""
    return F.nullif(F.concat_ws(";", *[F.when(f, name.replace("_", " ")) for name, f in flags.items()]), F.lit(""))


def info_map(info: Column) -> Column:
    """k=v;flag to a map, bare flags being "true"."""
    return F.transform_values(F.str_to_map(info, F.lit(";"), F.lit("=")), lambda _, v: F.coalesce(v, F.lit("true")))


def format_map(fmt: Column, cell: Column) -> Column:
    """Keys of FORMAT with a sample's values; trailing values may be missing."""
    k, v = F.split(fmt, ":"), F.split(cell, ":")
    n = F.least(F.size(k), F.size(v))
    return F.map_from_arrays(F.slice(k, F.lit(1), n), F.slice(v, F.lit(1), n))


MISSING = ("", ".", "na", "nan", "none", "null", "./.", ".|.")


def first_live(text: Column) -> Column:
    return F.get(F.filter(F.split(text, ","), lambda x: ~F.lower(F.trim(x)).isin(*MISSING)), F.lit(0))


def positions(text: Column) -> Column:
    """Starts in "chr1_10-chr1_20" lists: the first number after a contig, a range counting once."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.nullif(F.regexp_extract(x, r"^[^_]*_([0-9]+)", 1), F.lit("")).try_cast("long")), lambda x: x.isNotNull())


def mentions(text: Column, term: str) -> Column:
    """Whether text has the term as whole words, whatever the case."""
    return text.rlike(rf"(?i)(?<!\w)\Q{term}\E(?!\w)")


def preview(seq: Column, head: int = 12, tail: int = 6) -> Column:
    return F.when(F.length(seq) <= head + tail, seq).otherwise(F.concat(F.substring(seq, 1, head), F.lit("..."), F.right(seq, F.lit(tail))))


def slug(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_") or "dataset"


def format_bp(bp: Column) -> Column:
    return F.when(bp >= 1_000_000, F.format_string("%.2f Mb", bp / 1_000_000)).when(bp >= 1000, F.format_string("%.1f kb", bp / 1000)).otherwise(F.format_string("%d bp", bp.cast("long")))


def ratio_of_deflate(text: Column) -> Column:
    """Bytes of a text over bytes of its zlib form."""

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        import zlib

        return pd.Series([None if x is None or not x else len(b := x.encode()) / len(zlib.compress(b)) for x in s], dtype="float64")

    return run(text)


def gene_text(text: Column, n_genes: Column) -> Column:
    """The collapsed value of a site in one gene; at a site in several genes it can't be told whose it is."""
    return F.when(n_genes == 1, collapse(text))


def located(text: Column) -> Column:
    """struct<feature, index> of "intron12-intron12": where both halves name the same part; else nulls."""
    feature, index = F.regexp_extract(text, r"^([a-z]+)(\d+)-\1\2$", 1), F.regexp_extract(text, r"^([a-z]+)(\d+)-\1\2$", 2)
    return F.struct(F.nullif(feature, F.lit("")).alias("feature"), F.nullif(index, F.lit("")).try_cast("int").alias("index"))


def is_intronic(genic: Column, exonic: Column) -> Column:
    return F.coalesce(genic, F.lit(False)) & ~F.coalesce(exonic, F.lit(False))


def band_label(chrom: Column, band: Column) -> Column:
    return F.concat(F.replace(chrom, F.lit("chr"), F.lit("")), band)


def support(vector: Column) -> Column:
    """struct<callers, agreeing> of a support vector such as 101."""
    return F.struct(F.length(vector).alias("callers"), F.regexp_count(vector, F.lit("1")).alias("agreeing"))


def query_value(text: Column) -> Column:
    """A value for a quoted search: quotes and backslashes go, white space becomes one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\"\\]", " "), r"\s+", " "))
