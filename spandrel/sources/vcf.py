"""VCF text as DataFrames: header, records, samples in long form, allele resolution, and a profile of what a callset holds."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.motifs import longest_pure_segment
from ..functions.text import format_map, info_map
from .compressed import lines
from .shared import written

FIXED = ["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"]
#: Samples' rows that a task brings together at once.
ROWS = 250_000
# Length of chromosome 1 in human assemblies.
CHR1 = {248956422: "GRCh38", 249250621: "GRCh37", 248387328: "T2T-CHM13"}


@dataclass
class Header:
    meta: list[tuple[str, str]] = field(default_factory=list)
    info: dict[str, dict] = field(default_factory=dict)
    format: dict[str, dict] = field(default_factory=dict)
    contigs: dict[str, int | None] = field(default_factory=dict)
    samples: list[str] = field(default_factory=list)


def fields_of(body: str) -> dict[str, str]:
    """ID=X,Description="a, b" to a dict; commas in quotes don't split."""
    import re

    return {k: (v[1:-1] if v.startswith('"') else v) for k, v in re.findall(r'(\w+)=("[^"]*"|[^,]*)', body)}


def read_header(spark: SparkSession, path: str) -> Header:
    h = Header()
    for row in lines(spark, path).filter(F.col("value").startswith("#")).collect():
        text = row["value"]
        if not text.startswith("##"):
            h.samples = text.split("\t")[9:]
            continue
        key, _, value = text[2:].partition("=")
        if value.startswith("<"):
            f = fields_of(value[1:-1])
            if key == "INFO":
                h.info[f.get("ID", "")] = f
            elif key == "FORMAT":
                h.format[f.get("ID", "")] = f
            elif key == "contig":
                n = f.get("length", "")
                h.contigs[f.get("ID", "")] = int(n) if n.isdigit() else None
        else:
            h.meta.append((key, value))
    return h


def assembly(h: Header) -> str | None:
    return next((CHR1[n] for c, n in h.contigs.items() if c in ("1", "chr1") and n in CHR1), None)


def records(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """The eight fixed columns, FORMAT and the samples' cells as an array. Lines of fewer columns are dropped."""
    t = lines(spark, path).filter(~F.col("value").startswith("#"))
    t = t.limit(first) if first else t
    c = t.select(F.split("value", "\t").alias("c")).filter(F.size("c") >= 8)
    return c.select(*[F.get("c", F.lit(k)).alias(n) for k, n in enumerate(FIXED)], F.get("c", F.lit(8)).alias("FORMAT"), F.slice("c", 10, 1 << 20).alias("cells")).withColumn("POS", F.col("POS").try_cast("long"))


def long_form(df: DataFrame, samples: list[str]) -> DataFrame:
    """A row per record and sample, with a map of its fields."""
    names = F.array(*[F.lit(s) for s in samples])
    out = df.withColumn("_s", F.explode(F.arrays_zip(names.alias("sample"), F.col("cells").alias("cell"))))
    return out.select(*FIXED, "FORMAT", F.col("_s.sample").alias("sample"), format_map(F.col("FORMAT"), F.col("_s.cell")).alias("fields"))


def alt_kind(alt: Column) -> Column:
    return (
        F.when(alt.isin("", "."), "missing").when(alt.rlike(r"[\[\]]"), "breakend").when(alt.rlike(r"^<[^>]*>$"), "symbolic").when(alt.rlike(r"(?i)^[ACGTUNRYSWKMBDHV,*]+$"), "literal").otherwise("other")
    )


def is_called(gt: Column) -> Column:
    return F.exists(F.split(gt, r"[/|]"), lambda a: ~a.isin("0", ".", ""))


def inserted(ref: Column, alt: Column) -> Column:
    """ALT without REF where REF begins it."""
    return F.when(F.upper(alt).startswith(F.upper(ref)), F.substring(alt, F.length(ref) + 1, F.length(alt))).otherwise(alt)


def insertions(df: DataFrame, min_len: int = 1, max_len: int = 1 << 30) -> DataFrame:
    seq = inserted(F.col("REF"), F.col("ALT"))
    return df.withColumn("info", info_map(F.col("INFO"))).filter(F.col("info")["SVTYPE"] == "INS").withColumn("sequence", seq).filter(F.length("sequence").between(min_len, max_len))


def haplotypes(gt: Column) -> Column:
    return F.split(gt, r"[/|]")


def resolved_allele(index: Column, ref: Column, site_alts: Column, own_alt: Column | None = None) -> Column:
    """The sequence of one haplotype: REF for 0, the sample's own ALT if it has one, else the site's ALT of that number."""
    alt = F.get(F.split(site_alts, ","), index.try_cast("int") - 1)
    if own_alt is not None:
        alt = F.coalesce(F.when(~own_alt.isin(".", "", "NA"), own_alt), alt)
    return F.when(index.isin(".", ""), F.lit(None).cast("string")).when(index == "0", ref).otherwise(alt)


def longest_pure_segments(df: DataFrame, alleles: tuple[str, str]) -> DataFrame:
    """The longest pure repeat of either allele; the first wins a tie."""
    a, b = alleles
    d = df.withColumn("_a", longest_pure_segment(F.col(a))).withColumn("_b", longest_pure_segment(F.col(b)))
    la, lb = (F.length(f"{x}.motif") * F.col(f"{x}.copies") for x in ("_a", "_b"))
    return d.withColumn("lps_allele1", la).withColumn("lps_allele2", lb).withColumn("lps", F.greatest(la, lb)).withColumn("lps_motif", F.when(la >= lb, F.col("_a.motif")).otherwise(F.col("_b.motif"))).drop("_a", "_b")


def raw_insertions_per_sample(df: DataFrame, samples: list[str]) -> DataFrame:
    return long_form(df, samples).groupBy("sample").agg(F.count_if(is_called(F.col("fields")["GT"])).alias("n_insertions_raw"))


def svtype_as_dup(df: DataFrame) -> DataFrame:
    """INS as DUP, with the original type kept in INFO and <INS> written <DUP>."""
    ins = F.col("INFO").rlike(r"(?:^|;)SVTYPE=INS(?:;|$)")
    info = F.regexp_replace("INFO", r"(^|;)SVTYPE=INS(?=;|$)", "$1SVTYPE=DUP;ORIG_SVTYPE=INS")
    return df.withColumn("ALT", F.when(ins & (F.col("ALT") == "<INS>"), "<DUP>").otherwise(F.col("ALT"))).withColumn("INFO", F.when(ins, info).otherwise(F.col("INFO")))


def with_info(df: DataFrame, key: str, value: Column) -> DataFrame:
    return df.withColumn("INFO", F.concat_ws(";", F.when(F.col("INFO") != ".", F.col("INFO")), F.concat(F.lit(f"{key}="), value.cast("string"))))


def as_lines(df: DataFrame) -> DataFrame:
    rest = F.when(F.size("cells") > 0, F.concat(F.lit("\t"), F.array_join(F.concat(F.array("FORMAT"), F.col("cells")), "\t"))).otherwise("") if "cells" in df.columns else F.lit("")
    return df.select(F.concat(F.concat_ws("\t", *[F.col(c).cast("string") for c in FIXED]), rest).alias("value"))


def counters(df: DataFrame) -> DataFrame:
    """kind, value, n: how often each type, filter, ALT form and INFO key occurs. One pass over the records, which are counted by all of these before each counts."""
    info = df.select(info_map(F.col("INFO")).alias("_info"), F.col("FILTER").alias("_filter"), alt_kind(F.col("ALT")).alias("_alt"))
    alike = info.groupBy(F.coalesce(F.col("_info")["SVTYPE"], F.lit(".")).alias("_type"), "_filter", "_alt", F.map_keys("_info").alias("_keys")).agg(F.count("*").alias("_n"))
    pair = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    some = F.array(pair("svtype", F.col("_type")), pair("filter", F.col("_filter")), pair("alt", F.col("_alt")))
    return alike.select(F.explode(F.concat(some, F.transform("_keys", lambda k: pair("info", k)))).alias("p"), "_n").groupBy("p.kind", "p.value").agg(F.sum("_n").alias("n"))


def field_profile(long: DataFrame) -> DataFrame:
    """Per FORMAT key: how many values, missing, nucleotide, numeric, coordinate-like, multi-valued, and their lengths."""
    v = long.select(F.explode("fields").alias("field", "value"))
    live = ~F.lower("value").isin("", ".", "na", "nan", "none", "./.", ".|.")
    x = F.when(live, F.col("value"))
    return v.groupBy("field").agg(
        F.count("*").alias("seen"), F.count_if(~live).alias("missing"), F.count_if(x.rlike("(?i)^[ACGTN]{2,}$")).alias("nucleotide"), F.count_if(x.rlike(r"^-?[0-9.]+(?:[eE]-?[0-9]+)?$")).alias("numeric"),
        F.count_if(x.rlike(r"^[^_,]+_[0-9]+")).alias("coordinate"), F.count_if(x.contains(",")).alias("multi"), F.median(F.length(x)).alias("median_length"), F.max(F.length(x)).alias("max_length"),
    )


def roles(profile: DataFrame) -> dict[str, str]:
    """Which FORMAT key holds sequences and which coordinates, by the profile (a row per key)."""
    rows = profile.collect()
    out = {}
    for role, column in (("sequence", "nucleotide"), ("coordinate", "coordinate")):
        best = max(rows, key=lambda r: (r[column], r["field"]), default=None)
        if best is not None and best[column] * 2 > best["seen"] - best["missing"] > 0:
            out[role] = best["field"]
    if any(r["field"] == "GT" for r in rows):
        out["genotype"] = "GT"
    return out


def disagreements(long: DataFrame, sequence: str, coordinate: str | None = None) -> DataFrame:
    """Where samples differ from their merged record: different alleles, samples whose allele isn't the record's, whose anchor base
    differs, and how far breakpoints lie apart. sequence and coordinate name the FORMAT keys that hold them."""
    from ..functions.text import first_live, positions

    own = first_live(F.col("fields")[sequence])
    at = F.get(positions(F.col("fields")[coordinate]), F.lit(0)) if coordinate else F.lit(None).cast("long")
    s = long.withColumn("_own", own).withColumn("_off", F.abs(at - F.col("POS"))).filter(F.col("_own").isNotNull())
    return s.groupBy("CHROM", "POS", "ID").agg(
        F.countDistinct(F.upper("_own")).alias("n_alleles"), F.count_if(F.upper("_own") != F.upper("ALT")).alias("n_alt_differs"), F.count_if(F.upper(F.substring("_own", 1, 1)) != F.upper(F.substring("REF", 1, 1))).alias("n_anchor_differs"),
        F.median("_off").alias("median_offset"), F.max("_off").alias("max_offset"),
    )


def readings(long: DataFrame, found: dict[str, str], examples: int = 5, rows: int | None = None) -> DataFrame:
    """How records and their samples differ: kind, alt (the form of the record's ALT), n_records, n_samples, and the first examples, read both ways.

    found: the roles of FORMAT keys (roles). Only called samples count. Kinds: several_alleles (samples with different ones), no_sample_has_alt,
    anchor_differs (a sample's allele doesn't begin with REF's first base), shifted (a sample's breakpoint isn't at POS; of several, the nearest counts), and compared (any
    record with a sample's own allele). A record's samples are brought together once and written; of a kind, each task keeps no more examples than asked for, which are looked for without samples.
    rows: how many long has, if that is known; tasks get ROWS of them on average.
    """
    from ..functions.text import first_live, positions

    keys = ["CHROM", "POS", "ID", "REF", "ALT"]
    get = lambda role: F.col("fields")[found[role]] if role in found else F.lit(None).cast("string")
    called = is_called(get("genotype")) if "genotype" in found else F.lit(True)
    offset = F.array_min(F.transform(positions(get("coordinate")), lambda p: F.abs(p - F.col("POS"))))
    s = long.filter(F.coalesce(called, F.lit(False))).select("CHROM", "POS", "ID", "REF", "ALT", "sample", F.upper(first_live(get("sequence"))).alias("allele"), offset.alias("offset"))
    n = max(int(long.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(long.count() if rows is None else rows) // ROWS))
    record = s.repartition(n, *keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("sample", "allele", "offset"))).alias("samples"))
    some = F.filter("samples", lambda x: x["allele"].isNotNull())
    alleles = F.array_distinct(F.transform(some, lambda x: x["allele"]))
    checks = {
        "compared": F.size(some) > 0,
        "several_alleles": F.size(alleles) > 1,
        "no_sample_has_alt": (F.size(some) > 0) & ~F.array_contains(alleles, F.upper("ALT")),
        "anchor_differs": F.exists(some, lambda x: F.substring(x["allele"], 1, 1) != F.upper(F.substring("REF", 1, 1))),
        "shifted": F.exists("samples", lambda x: F.coalesce(x["offset"] > 0, F.lit(False))),
    }
    kinds = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), k) for k, c in checks.items()]), lambda k: k.isNotNull())
    record = written(record.select(*keys, "samples", kinds.alias("kinds"), alt_kind(F.col("ALT")).alias("form")).filter(F.size("kinds") > 0), "readings")
    counts = record.select(F.explode("kinds").alias("kind"), F.col("form").alias("alt"), F.size("samples").alias("_k")).groupBy("kind", "alt").agg(F.count("*").alias("n_records"), F.sum("_k").alias("n_samples"))
    each = record.select(*keys, "kinds", "form").repartition(n, *keys).select(F.explode("kinds").alias("kind"), "form", *[F.col(c).alias(f"_k_{c}") for c in keys])
    first = each.withColumn("_n", F.row_number().over(Window.partitionBy("kind", "form").orderBy(*[f"_k_{c}" for c in keys]))).filter(F.col("_n") <= examples)
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys])
    # at most the examples asked for of each kind and form
    whole = record.select(F.struct(*keys, "samples").alias("record"), *keys).join(F.broadcast(first), same)
    shown = whole.groupBy("kind", F.col("form").alias("alt")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "record"))), lambda x: x["record"]).alias("examples"))
    return counts.join(shown, ["kind", "alt"])


def scan(spark: SparkSession, path: str, most: int | None = None, learn: int | None = None) -> dict:
    """A profile of all records (or of the first ones, if asked for so many): header facts, counters, FORMAT roles, and how records and samples differ by those roles."""
    h = read_header(spark, path)
    rec = records(spark, path, most)
    out = {"samples": len(h.samples), "assembly": assembly(h), "info": sorted(h.info), "format": sorted(h.format), "counters": [r.asDict() for r in counters(rec).collect()]}
    if h.samples:
        out["roles"] = roles(field_profile(long_form(records(spark, path, learn) if learn else rec, h.samples)))
        if "sequence" in out["roles"]:
            long = long_form(rec, h.samples)
            d = disagreements(long, out["roles"]["sequence"], out["roles"].get("coordinate"))
            out["disagreements"] = d.agg(F.count("*").alias("records"), F.count_if(F.col("n_alleles") > 1).alias("several_alleles"), F.sum("n_alt_differs").alias("alt_differs"), F.max("max_offset").alias("max_offset")).first().asDict()
            out["readings"] = [r.asDict(True) for r in readings(long, out["roles"], rows=len(h.samples) * sum(r["n"] for r in out["counters"] if r["kind"] == "filter")).collect()]
    return out
