"""Report tables: cross-tabs, histograms, frequency bins, distribution functions, rates and funnels of filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.motifs import reverse_complement
from ..sources.shared import written
from .quantiles import quantiles, with_quantiles


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts by row and each listed value, 0 where there are none."""
    return df.groupBy(row).pivot(column, values).count().na.fill(0)


def row_percent(counts: DataFrame, values: list[str], digits: int = 1) -> DataFrame:
    total = reduce(lambda a, b: a + b, [F.col(v) for v in values])
    return counts.select(*[c for c in counts.columns if c not in values], *[F.round(100.0 * F.col(v) / F.nullif(total, F.lit(0)), digits).alias(v) for v in values])


def equal_bins(df: DataFrame, value: str, bins: int, low: float, high: float) -> DataFrame:
    """bin (0-based), n. The last bin is closed; values outside are left out."""
    k = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return df.filter(F.col(value).between(low, high)).groupBy(k.alias("bin")).agg(F.count("*").alias("n"))


def log_bins(df: DataFrame, value: str, per_decade: int = 4) -> DataFrame:
    return df.filter(F.col(value) > 0).groupBy(F.floor(F.log10(value) * per_decade).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def edge_bins(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """Left-closed bins between edges; the last is open upwards."""
    k = reduce(lambda e, i: F.when(F.col(value) >= edges[i], i).otherwise(e), range(len(edges)), F.lit(None).cast("int"))
    return df.withColumn("bin", k).filter("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))


def doubling_edges(n: int) -> list[int]:
    """1, 2, 4, ... up to n: the edges of a site-frequency spectrum."""
    out = [1]
    while out[-1] * 2 <= n:
        out.append(out[-1] * 2)
    return out


def pooled(df: DataFrame, value: str, cap: float) -> DataFrame:
    """Counts by value, those at or above cap pooled there."""
    return df.groupBy(F.least(F.col(value), F.lit(cap)).alias("value")).agg(F.count("*").alias("n"))


def ecdf(df: DataFrame, value: str) -> DataFrame:
    """value, cumulative share. Counted per value first; values are summed range by range, after the totals of the ranges before."""
    n = df.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    upto = running_sum(n, "value", "n", "upto")
    total = n.agg(F.sum("n").alias("total"))
    return upto.join(F.broadcast(total)).select("value", "n", F.round(F.col("upto") / F.col("total"), 6).alias("share"))


def running_sum(df: DataFrame, order: str, weight: str, out: str) -> DataFrame:
    """df with the sum of weight up to each row in the order of a column of different values, without one window over all rows."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = written(df.repartitionByRange(n, order).withColumn("_r", F.spark_partition_id()), "running")
    sizes = part.groupBy("_r").agg(F.sum(weight).alias("_n"))
    before = sizes.select("_r", (F.sum("_n").over(Window.orderBy("_r")) - F.col("_n")).alias("_b"))  # a row for each range
    own = F.sum(weight).over(Window.partitionBy("_r").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return part.join(F.broadcast(before), "_r").withColumn(out, F.col("_b") + own).drop("_r", "_b")


def density(df: DataFrame, value: str, low: float, high: float, points: int = 50, width: float | None = None) -> DataFrame:
    """Gaussian kernel density at evenly spaced points. Counted per value first; the points are a table of fixed size."""
    n = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    about = n.agg(F.sum("n").alias("total"), F.sum(F.col("v") * F.col("n")).alias("s1"), F.sum(F.col("v") * F.col("v") * F.col("n")).alias("s2"))
    deviation = F.sqrt((F.col("s2") - F.col("s1") * F.col("s1") / F.col("total")) / F.nullif(F.col("total") - 1, F.lit(0)))
    # the usual rule for the width: a fifth root of the number of values
    h = F.lit(float(width)) if width else deviation * F.pow(F.col("total").cast("double"), F.lit(-0.2))
    at = F.sequence(F.lit(0), F.lit(points - 1))
    spread = n.join(F.broadcast(about.select("total", h.alias("h")))).withColumn("k", F.explode(at))
    x = F.lit(float(low)) + F.col("k") * F.lit((high - low) / (points - 1))
    z = (x - F.col("v")) / F.col("h")
    mass = F.sum(F.col("n") * F.exp(-0.5 * z * z) / (F.col("total") * F.col("h") * F.lit((2 * 3.141592653589793) ** 0.5)))
    return spread.groupBy("k").agg(F.round(mass, 9).alias("density"))


def side_by_side(left: DataFrame, right: DataFrame, left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """Two tables joined by position in their orders; the shorter one is filled with nulls. Positions are counted range by range."""
    a, b = numbered(left, left_order, "_at"), numbered(right, right_order, "_at")
    return a.join(b, "_at", "full_outer").drop("_at")


def numbered(df: DataFrame, order: list[Column], out: str, ranges: int | None = None) -> DataFrame:
    """df with each row's place (from 0) in a total order. The order is cut into ranges, each numbered by itself after the sizes of those before."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = written(df.repartitionByRange(n, *order).withColumn("_r", F.spark_partition_id()), "numbered")
    sizes = part.groupBy("_r").agg(F.count("*").alias("_n"))
    before = sizes.select("_r", (F.sum("_n").over(Window.orderBy("_r")) - F.col("_n")).alias("_b"))  # a row for each range
    own = F.row_number().over(Window.partitionBy("_r").orderBy(*order))
    return part.join(F.broadcast(before), "_r").withColumn(out, F.col("_b") + own - 1).drop("_r", "_b")


def ladder(df: DataFrame, value: str, limits: list[float]) -> DataFrame:
    one = df.agg(*[F.count_if(F.col(value) <= x).alias(f"n{k}") for k, x in enumerate(limits)])
    return one.selectExpr(f"stack({len(limits)}, " + ", ".join(f"{float(x)}D, n{k}" for k, x in enumerate(limits)) + ") as (within, n)")


def summary(df: DataFrame, keys: list[str], metrics: list[str], digits: int = 3) -> DataFrame:
    means = df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.round(F.avg(m), digits).alias(f"mean_{m}") for m in metrics])
    out = with_quantiles(means, df, keys, {f"median_{m}": (m, 0.5) for m in metrics})
    return out.select(*keys, "n", *[x for m in metrics for x in (f"mean_{m}", F.round(f"median_{m}", digits).alias(f"median_{m}"))])


def outliers(df: DataFrame, key: str, value: str) -> DataFrame:
    """Per key: quartiles, and how many values lie beyond 1.5 interquartile ranges."""
    q = quantiles(df, [key], {"q1": (value, 0.25), "q3": (value, 0.75)})
    j = df.select(key, value).join(q, key)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return j.groupBy(key).agg(F.round(F.first("q1"), 4).alias("q1"), F.round(F.first("q3"), 4).alias("q3"), F.count_if((F.col(value) < F.col("q1") - reach) | (F.col(value) > F.col("q3") + reach)).alias("n_outliers"))


def top(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), column).limit(n)


def with_other(df: DataFrame, column: str, weight: str, keep: int) -> DataFrame:
    """Totals of the keep heaviest values, and of Other, which is what they leave of the sum."""
    t = df.groupBy(column).agg(F.sum(weight).alias("total"))
    first = t.orderBy(F.col("total").desc(), column).limit(keep)
    rest = t.join(first.select(column), column, "left_anti").agg(F.lit("Other").alias(column), F.sum("total").alias("total")).filter("total is not null")
    return first.unionByName(rest)


def filter_chain(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass every check, and the funnel of how many were left after each."""
    from .serve import funnel

    return df.filter(reduce(lambda a, b: a & b, checks.values())), funnel(df, {"input": F.lit(True), **checks})


def unmatched(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.select(*on).distinct().join(right, on, "left_anti")


def share_of_total(df: DataFrame, key: str) -> DataFrame:
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    return n.select(key, "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


def kmers(text: Column, k: int) -> Column:
    """Every run of k characters, by one pass of the text: at each character a look ahead takes what follows."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{k}}}))."), F.lit(1))


def kmer_spectrum(df: DataFrame, text: str, k: int, cap: int = 255, strands: bool = False) -> DataFrame:
    """occurrences (capped), n_kmers. strands: for DNA, a k-mer and its reverse complement are one, and those with other letters than ACGT are left out."""
    read = F.upper(text) if strands else F.col(text)
    counts = df.select(F.explode(kmers(read, k)).alias("kmer")).groupBy("kmer").count()
    if strands:  # different ones only
        both = counts.filter(~F.col("kmer").rlike("[^ACGT]")).select(F.least("kmer", reverse_complement(F.col("kmer"))).alias("kmer"), "count")
        counts = both.groupBy("kmer").agg(F.sum("count").alias("count"))
    return counts.groupBy(F.least("count", F.lit(cap)).alias("occurrences")).agg(F.count("*").alias("n_kmers"))
