"""Made-up data by seed: values drawn from digests of the row number, so that they are the same on every run, cluster and engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Quantiles of insertion length and of copies, between which lengths are drawn evenly.
LENGTHS = ((0.0, 20), (0.5, 80), (0.9, 400), (1.0, 3000))
MOTIFS = ("A", "AT", "CAG", "AAAG", "TTAGGG")


def uniform(key: Column, seed: int, what: str) -> Column:
    """A number in [0, 1) for each key and purpose."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{what}:"), key.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def quantile(u: Column, points: tuple[tuple[float, float], ...]) -> Column:
    """A value by piecewise linear interpolation between quantiles."""
    out = F.lit(None).cast("double")
    for (p, a), (q, b) in zip(points, points[1:], strict=False):
        out = F.when(u < q, F.coalesce(out, a + (u - p) / (q - p) * (b - a))).otherwise(out)
    return out


def calls(spark: SparkSession, n: int, seed: int = 0, sites: int = 300, samples: int = 20) -> DataFrame:
    """n calls of some samples at some sites: motif, length and purity."""
    k = F.col("id")
    u = lambda what: uniform(k, seed, what)
    site = F.floor(u("site") * sites)
    return spark.range(n).select(
        F.concat(F.lit("chr"), site % 22 + 1).alias("chrom"), (site * 1000 + 1).alias("ins_coord"), F.concat(F.lit("s"), F.floor(u("sample") * samples)).alias("sample"),
        F.element_at(F.array(*[F.lit(m) for m in MOTIFS]), (F.floor(u("motif") * len(MOTIFS)) + 1).cast("int")).alias("motif"), F.floor(quantile(u("length"), LENGTHS)).alias("insert_size"), F.round(1 - u("purity") * u("purity") * 0.4, 3).alias("purity"),
    )


def calls_sql(n: int, seed: int, sites: int = 300, samples: int = 20) -> str:
    """The same rows in DuckDB SQL."""
    u = {w: f"(('0x' || substr(md5('{seed}:{w}:' || id), 1, 8))::bigint / 4294967296.0::double)" for w in ("site", "sample", "motif", "length", "purity")}
    parts = " ".join(f"when {u['length']} < {q} then {a} + ({u['length']} - {p}) / {q - p}::double * {b - a}" for (p, a), (q, b) in zip(LENGTHS, LENGTHS[1:], strict=False))
    return f"""select 'chr' || (site % 22 + 1) as chrom, site * 1000 + 1 as ins_coord, 's' || floor({u['sample']} * {samples})::bigint as sample, ({list(MOTIFS)})[(floor({u['motif']} * {len(MOTIFS)}) + 1)::int] as motif, floor(case {parts} end)::bigint as insert_size, round(1 - {u['purity']} * {u['purity']} * 0.4, 3) as purity
      from (select id, floor({u['site']} * {sites})::bigint as site from (select unnest(range(0, {n})) as id))"""
