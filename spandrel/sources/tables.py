"""Delimited tables: required columns, typed reading with counted bad rows, Parquet conversion, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOTHING = ("NA", ".", "")

CALL_TYPES = {
    "chrom": "string", "ins_coord": "long", "SVID": "string", "depth": "string", "insert_size": "string", "sample": "string", "allele": "int", "rep_start": "int", "rep_end": "int",
    "motif": "string", "purity": "double", "motif_length": "int", "rep_length": "int", "rep_units": "double",
}


def read_tsv(spark: SparkSession, path: str, header: bool = True, names: list[str] | None = None, sep: str = "\t") -> DataFrame:
    """Every column as string, nothing inferred. A file without header takes the given names."""
    df = spark.read.option("sep", sep).option("header", header).option("quote", "").option("comment", "" if header else "#").csv(path)
    return df.toDF(*names) if names else df


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def typed(df: DataFrame, types: dict[str, str]) -> tuple[DataFrame, Column]:
    """df with columns cast where possible, and a predicate of rows where a given value had no such type."""
    bad = F.lit(False)
    for c, t in types.items():
        if c in df.columns and t != "string":
            bad = bad | (F.col(c).isNotNull() & ~F.col(c).isin(*NOTHING) & F.col(c).try_cast(t).isNull())
    return df.withColumn("_bad", bad).withColumns({c: F.col(c).try_cast(t) for c, t in types.items() if c in df.columns}), F.col("_bad")


def read_calls(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Well-formed TR calls, and the number of rows dropped as malformed (a one-row DataFrame)."""
    raw = require(read_tsv(spark, path), ["chrom", "ins_coord", "SVID", "sample", "motif", "rep_start", "rep_end"])
    df, bad = typed(raw, CALL_TYPES)
    return df.filter(~bad).drop("_bad"), df.agg(F.count_if(bad).alias("n_bad"))


def nulled(df: DataFrame, nothing: tuple[str, ...] = NOTHING) -> DataFrame:
    """Text that stands for nothing becomes null."""
    return df.select(*[F.when(~F.col(c).isin(*nothing), F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def _newest(spark: SparkSession, path: str):
    """The time of the newest file under a path, null when there is none."""
    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).agg(F.max("modificationTime")).first()[0]
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def tsv_to_parquet(spark: SparkSession, src: str, dst: str, always: bool = False) -> DataFrame:
    """The Parquet form of a table, types inferred from all of it. One that is newer than its source is left as it is, unless always."""
    made = None if always else _newest(spark, dst)
    if made is None or made < _newest(spark, src):
        df = nulled(read_tsv(spark, src))
        inferred = spark.read.option("sep", "\t").option("header", True).option("inferSchema", True).option("nullValue", "NA").csv(src).schema
        out = df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in inferred.fields])
        out.write.mode("overwrite").option("compression", "zstd").parquet(dst)
    return spark.read.parquet(dst)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("nullValue", "NA").option("emptyValue", "").csv(path)


def append_metrics(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Rows added to a Parquet dataset; columns may differ from run to run."""
    rows.write.mode("append").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def bed_first_wins(df: DataFrame, ident: str, chrom: str, pos: str, order: str) -> DataFrame:
    """start = pos, end = pos + 1, the first row of each id."""
    from ..operators.intervals import best_hit

    return best_hit(df, [ident], [F.col(order)]).select(F.col(chrom).alias("chrom"), F.col(pos).alias("start"), (F.col(pos) + 1).alias("end"), F.col(ident).alias("name"))


def bed_of_sites(df: DataFrame, chrom: str, pos: str) -> DataFrame:
    """start = pos - 1, end = pos, different sites in order. pos is 1-based."""
    return df.select(F.col(chrom).alias("chrom"), (F.col(pos) - 1).alias("start"), F.col(pos).alias("end")).distinct().orderBy("chrom", "start")


def fasta(df: DataFrame, name: Column, seq: Column) -> DataFrame:
    return df.select(F.concat(F.lit(">"), name, F.lit("\n"), seq).alias("value"))


def _of_class(name: str):
    return lambda m: F.struct(F.lit(name).alias("class"), m.alias("motif"))


def disease_catalogue(spark: SparkSession, path: str, build: str = "hg38") -> DataFrame:
    """A JSON array of curated loci for one genome build: the columns that disease_screen needs."""
    from ..functions.coords import normalize_chrom
    from ..operators.disease import CLASSES

    raw = spark.read.option("multiLine", True).json(path)
    have = set(raw.columns)
    col = lambda c, t: F.col(c).cast(t) if c in have else F.lit(None).cast(t)
    field = lambda c: "interruption_reference_orientation" if c == "interruption" else f"{c}_motif_reference_orientation"
    lists = [F.transform(F.filter(F.coalesce(col(field(c), "array<string>"), F.array().cast("array<string>")), lambda m: m != ""), _of_class(c)) for c in CLASSES]
    ends = [col(f"{k}_{e}", "double").alias(f"{k}_{e}") for k in ("pathogenic", "intermediate", "benign") for e in ("min", "max")]
    return raw.filter(F.col(f"start_{build}").isNotNull() & F.col(f"stop_{build}").isNotNull()).select(
        "id", "gene", normalize_chrom(F.col("chrom")).alias("chrom"), F.col(f"start_{build}").cast("long").alias("start"), F.col(f"stop_{build}").cast("long").alias("end"),
        col("disease", "string").alias("disease"), col("ref_copies", "double").alias("ref_copies"), F.concat(*lists).alias("motifs"), *ends,
        *[F.array_join(col(c, "array<string>"), ";").alias(c) for c in ("inheritance", "evidence")],
    )


def gene_phenotypes(spark: SparkSession, path: str, version: str) -> DataFrame:
    df = read_tsv(spark, path)
    names = {"ncbi_gene_id": "gene_id"}
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns}).withColumn("gene_id", F.col("gene_id").try_cast("long")).withColumn("release_version", F.lit(version))


def stats_sections(sections: dict[str, DataFrame]) -> DataFrame:
    """The lines of a stats file, in order (place): a ## line for each section, its header, its rows. Sections are small tables."""
    out = None
    for k, (title, df) in enumerate(sections.items()):
        cells = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in df.columns])
        head = df.sparkSession.createDataFrame([(k, 0, f"## {title}"), (k, 1, "\t".join(df.columns))], "section int, line int, value string")
        body = df.select(F.lit(k).alias("section"), F.lit(2).alias("line"), cells.alias("value"))
        out = head.unionByName(body) if out is None else out.unionByName(head).unionByName(body)
    return out


def markdown(df: DataFrame, order: list[Column], most: int = 1000) -> list[str]:
    """A small table as lines of Markdown; more than most rows are refused rather than cut."""
    rows = df.orderBy(*order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report table has at most {most} rows")
    shown = lambda v: "" if v is None else f"{v:g}" if isinstance(v, float) else str(v)
    return ["| " + " | ".join(x) + " |" for x in (df.columns, ["---"] * len(df.columns), *([shown(v) for v in r] for r in rows))]


def digests(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """name, length and sha256 of every file under a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select(F.substring_index("path", "/", -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def unit_vectors(df: DataFrame, ident: str, vector: str) -> DataFrame:
    """id, vector scaled to length 1 (left out where it is zero or null): the form in which an index is kept."""
    v = F.col(vector).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return df.filter(norm > 0).select(F.col(ident).alias("id"), F.transform(v, lambda x: x / norm).cast("array<float>").alias("vector"))
