"""Reference catalogues to one schema: chrom, start, end, motif and what annotations there are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coords import normalize_chrom
from .compressed import lines
from .tables import read_tsv

# The columns of the simpleRepeat table dump.
SIMPLE_REPEAT = "bin chrom chromStart chromEnd name period copyNum consensusSize perMatch perIndel score A C G T entropy sequence".split()
RENAMED = {"chromStart": "start", "chromEnd": "end", "sequence": "motif", "copyNum": "copy_num", "consensusSize": "consensus_size", "perMatch": "per_match", "perIndel": "per_indel"}
ANNOTATIONS = {"period": "int", "copy_num": "double", "consensus_size": "int", "per_match": "int", "per_indel": "int"}


def sniff(spark: SparkSession, path: str) -> str:
    """simplerepeat, trgt or bed, by the first lines."""
    for row in lines(spark, path).filter(F.trim("value") != "").limit(50).collect():
        text = row["value"]
        if text.startswith("#"):
            if "chromStart" in text:
                return "simplerepeat"
            continue
        cells = text.split("\t")
        if len(cells) == len(SIMPLE_REPEAT) and cells[2].isdigit():
            return "simplerepeat"
        return "trgt" if len(cells) > 3 and "MOTIFS=" in cells[3] else "bed"
    return "bed"


def finalize(df: DataFrame) -> DataFrame:
    """Contigs normalised, numbers coerced, motifs upper case; rows that can't be used are dropped."""
    extra = {c: t for c, t in ANNOTATIONS.items() if c in df.columns}
    out = df.select(normalize_chrom(F.col("chrom")).alias("chrom"), F.col("start").try_cast("long").alias("start"), F.col("end").try_cast("long").alias("end"), F.upper(F.trim("motif")).alias("motif"), *[F.col(c).try_cast(t).alias(c) for c, t in extra.items()])
    out = out.filter("start is not null and end is not null and motif is not null and motif <> ''")
    return out.withColumn("copy_num", F.round("copy_num", 2)) if "copy_num" in extra else out


def _cells(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).filter(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.split("value", "\t").alias("c"))


def read_simplerepeat(spark: SparkSession, path: str) -> DataFrame:
    first = lines(spark, path).filter(F.col("value").startswith("#")).first()
    names = first["value"].lstrip("#").split("\t") if first else SIMPLE_REPEAT
    wanted = [n for n in names if n in {"chrom", "period", *RENAMED}]
    return finalize(_cells(spark, path).select(*[F.get("c", F.lit(names.index(n))).alias(RENAMED.get(n, n)) for n in wanted]))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return finalize(_cells(spark, path).select(*[F.get("c", F.lit(k)).alias(n) for k, n in enumerate(("chrom", "start", "end", "motif"))]))


def read_trgt(spark: SparkSession, path: str) -> DataFrame:
    motifs = F.split(F.regexp_extract(F.get("c", F.lit(3)), r"(?:^|;)MOTIFS=([^;]*)", 1), ",")
    return finalize(_cells(spark, path).select(*[F.get("c", F.lit(k)).alias(n) for k, n in enumerate(("chrom", "start", "end"))], F.explode(motifs).alias("motif")))


READERS = {"simplerepeat": read_simplerepeat, "bed": read_bed, "trgt": read_trgt}


def read_catalog(spark: SparkSession, path: str, fmt: str = "auto") -> DataFrame:
    return READERS[sniff(spark, path) if fmt == "auto" else fmt](spark, path)


__all__ = ["finalize", "lines", "read_bed", "read_catalog", "read_simplerepeat", "read_trgt", "read_tsv", "sniff"]
