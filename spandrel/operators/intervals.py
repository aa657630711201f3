"""Interval joins, union length and segments.

Spark has no range join. Intervals are put in bins of a contig; the join is then an equality on (contig, level, bin) with the overlap as a residual,
and a pair that shares several bins is kept in the first of them only, so nothing needs deduplicating. Bins grow from level to level: an
interval lies in the level of its own length, where it touches two bins at most, and is looked up from above by the longer ones of the other side.
So a row gives two rows for each level that the other side has, however long it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.coords import interval_distance
from ..sources.shared import written

#: The size of a bin of level 0, and how many times larger it is in the next level.
BIN, STEP = 4096, 8
#: Levels up to bins of 2^63 bases.
LEVELS = 17


def _level(start: Column, end: Column, size: int) -> Column:
    """The first level whose bins are as long as the interval."""
    k = F.lit(LEVELS)
    for level in reversed(range(LEVELS)):
        if size * STEP**level < 1 << 63:
            k = F.when(end - start <= size * STEP**level, level).otherwise(k)
    return F.when(end.isNotNull() & start.isNotNull(), k)


def _bin(at: Column, level: Column, size: int) -> Column:
    return F.floor(at / (size * F.pow(F.lit(float(STEP)), level)))


def _placed(df: DataFrame, other: DataFrame, start: str, end: str, o_start: str, o_end: str, size: int, left: bool, level: int | None = None) -> DataFrame:
    """df with a row for each bin of its own level (_own), and of the higher ones that the other side's intervals have.

    _turn says which side's level it is: on 0 left rows are in their own and right rows in that or a lower one, on 1 right rows are in their own
    and left rows in a lower one. level: that of all intervals of the other side, where it is known without looking.
    """
    mine, theirs = (0, 1) if left else (1, 0)
    at = lambda k, turn: F.struct(k.alias("level"), F.lit(turn).alias("turn"))
    above = F.filter(F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: k > F.col("_own") if left else k >= F.col("_own"))
    own = df.withColumn("_own", _level(F.col(start), F.col(end), size)).filter(F.col("_own").isNotNull())
    out = own.withColumn("_p", F.explode(F.concat(F.array(at(F.col("_own"), mine)), F.transform(above, lambda k: at(k, theirs)))))
    out = out.withColumn("_level", F.col("_p.level")).withColumn("_turn", F.col("_p.turn")).drop("_p")
    if not left:
        # on their own turn right rows meet longer left rows' levels never, only shorter ones'
        out = out.filter((F.col("_turn") == theirs) | (F.col("_own") > 0))
    if level is None:
        there = other.select(_level(F.col(o_start), F.col(o_end), size).alias("_level"), F.lit(True).alias("_there")).distinct()  # at most LEVELS + 1 rows
        out = out.join(F.broadcast(there), "_level", "left").filter((F.col("_turn") == mine) | F.col("_there")).drop("_there")
    else:
        out = out.filter((F.col("_turn") == mine) | (F.col("_level") == level))
    first, last = _bin(F.col(start), F.col("_level"), size), _bin(F.greatest(F.col(start), F.col(end) - 1), F.col("_level"), size)
    return out.withColumn("_first", first).withColumn("_bin", F.explode(F.sequence(first, last)))


def overlap_join(left: DataFrame, right: DataFrame, chrom: str, start: str, end: str, r_chrom: str, r_start: str, r_end: str, how: str = "inner", bin_size: int = BIN, longest: int | None = None) -> DataFrame:
    """Rows of left and right whose half-open intervals overlap on a contig. how: inner, left_semi or left_anti.

    longest: the length of all left intervals, where they have one and it is known. Column names of the two sides must differ. Rows with a null among contig, start or end overlap nothing. Skewed bins are split by adaptive execution, as
    nothing above the join needs its partitioning.
    """
    if how != "inner":
        # different intervals are looked up once, and rows follow by their interval
        keys = [chrom, start, end]
        hit = overlap_join(left.select(*keys).distinct(), right.select(r_chrom, r_start, r_end), chrom, start, end, r_chrom, r_start, r_end, "inner", bin_size).select(*keys).distinct()
        return left.join(hit, keys, how).select(*left.columns)
    ll = _placed(left, right, start, end, r_start, r_end, bin_size, True)
    level = None if longest is None else next(k for k in range(LEVELS) if longest <= bin_size * STEP**k)
    rr = _placed(right, left, r_start, r_end, start, end, bin_size, False, level)
    rr = rr.select(*right.columns, *[F.col(c).alias(f"_r{c}") for c in ("_level", "_turn", "_first", "_bin")])
    on = (F.col(chrom) == F.col(r_chrom)) & (F.col("_level") == F.col("_r_level")) & (F.col("_turn") == F.col("_r_turn")) & (F.col("_bin") == F.col("_r_bin"))
    residual = (F.col(r_start) < F.col(end)) & (F.col(r_end) > F.col(start)) & (F.col("_bin") == F.greatest("_first", "_r_first"))
    return ll.join(rr, on & residual).select(*left.columns, *right.columns)


def window_join(points: DataFrame, intervals: DataFrame, chrom: str, point: str, r_chrom: str, r_start: str, r_end: str, window: int = 10, bin_size: int = BIN) -> DataFrame:
    """Pairs of a 0-based point and an interval that comes within window bases of it, with distance."""
    p = points.withColumns({"_from": F.col(point) - window, "_to": F.col(point) + window + 1})
    out = overlap_join(p, intervals, chrom, "_from", "_to", r_chrom, r_start, r_end, "inner", bin_size, 2 * window + 1).drop("_from", "_to")
    return out.withColumn("distance", interval_distance(F.col(point), F.col(point) + 1, F.col(r_start), F.col(r_end)))


def first_in_window(points: DataFrame, intervals: DataFrame, chrom: str, point: str, r_chrom: str, r_start: str, r_end: str, ident: str, window: int = 10) -> DataFrame:
    """points with ident (the nearest interval's; the smaller one of equally near ones), distance and n_nearby (intervals within window; 0 for none).

    Different points are looked up once among different intervals, so copies on either side make no pairs.
    """
    spots = intervals.groupBy(r_chrom, r_start, r_end).agg(F.count("*").alias("_n"), F.min(ident).alias(ident))
    pairs = window_join(points.select(chrom, point).distinct(), spots, chrom, point, r_chrom, r_start, r_end, window)
    least = F.min(F.struct("distance", ident)).alias("_best")
    first = pairs.groupBy(chrom, point).agg(F.sum("_n").alias("n_nearby"), least).select(chrom, point, "n_nearby", "_best.*")
    return points.join(first, [chrom, point], "left").select(*points.columns, ident, "distance", F.coalesce("n_nearby", F.lit(0)).alias("n_nearby"))


def best_hit(pairs: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first pair of each key; order must be total."""
    return pairs.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_rn = 1").drop("_rn")


def overlap_fraction_at_least(start: str, end: str, r_start: str, r_end: str, fraction: float) -> Column:
    """Whether the overlap covers this fraction of the right interval."""
    shared = F.least(end, r_end) - F.greatest(start, r_start)
    return shared / F.nullif(F.col(r_end) - F.col(r_start), F.lit(0)) >= fraction


def union_length(df: DataFrame, keys: list[str], start: str, end: str, out: str = "union_length") -> DataFrame:
    """df with the number of bases that the intervals of each key cover together, on every row.

    Intervals are sorted range by range, so a frequent key lies in many; each range hands on how far it has reached. Rows of a null key are a key's.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # equal intervals cover nothing more
    spans = df.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e")).distinct()
    part = written(spans.repartitionByRange(n, *keys, "_s", "_e").withColumn("_r", F.spark_partition_id()), "union")
    ends = part.groupBy(*keys, "_r").agg(F.max("_e").alias("_m"))  # a row for each key and range
    handed = F.max("_m").over(Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    before = ends.select(*[F.col(c).alias(f"_k_{c}") for c in keys], F.col("_r").alias("_k_r"), handed.alias("_h"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys])
    own = F.max("_e").over(Window.partitionBy("_r", *keys).orderBy("_s", "_e").rowsBetween(Window.unboundedPreceding, -1))
    reached = F.greatest(F.col("_s"), F.col("_o"), F.col("_h"))
    total = part.withColumn("_o", own).join(before, same & (F.col("_r") == F.col("_k_r"))).groupBy(*keys).agg(F.sum(F.greatest(F.col("_e") - reached, F.lit(0))).alias(out))
    return df.join(total.select(*[F.col(c).alias(f"_k_{c}") for c in keys], out), same, "left").select(*df.columns, out)


def insertion_purity(df: DataFrame, keys: list[str], start: str = "rep_start", end: str = "rep_end", size: str = "insert_size", out: str = "insertion_purity") -> DataFrame:
    u = union_length(df, keys, start, end, "_u")
    return u.withColumn(out, F.when(F.col(size) > 0, F.round(F.least(F.col("_u") / F.col(size), F.lit(1.0)), 3))).drop("_u")


def nearest(left: DataFrame, right: DataFrame, on: list[str], value: str, r_value: str, tie: str) -> DataFrame:
    """Every left row with the right row of the same keys whose value is nearest. Ties go to the smaller value, then the smaller tie column.

    Left rows with a null among keys and value stay, with nothing nearest; right ones with a null there are near nothing.

    Both sides are sorted together, range by range, so a key's rows may lie in many ranges; the neighbours on either side are the only
    candidates, found by running windows within a range, and past its ends by those that the ranges before and after hand on.
    """
    spark = left.sparkSession
    known = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in [*on, value]])
    none = left.filter(~known).select(*left.columns, F.lit(None).cast("long").alias(f"nearest_{tie}"), F.lit(None).cast(left.schema[value].dataType).alias("nearest_distance"))
    left, right = left.filter(known), right.filter(reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in [*on, r_value]]))
    hit = F.struct(F.col("_v").alias("v"), F.col("_t").alias("t"))
    a = left.select(*on, F.col(value).alias("_v"), F.lit(0).alias("_side"), F.lit(None).cast("long").alias("_t"), F.struct(*left.columns).alias("_row"))
    best = right.groupBy(*on, F.col(r_value).alias("_v")).agg(F.min(tie).cast("long").alias("_t"))
    b = best.select(*on, "_v", F.lit(1).alias("_side"), "_t", F.lit(None).cast(a.schema["_row"].dataType).alias("_row"))
    cut = a.unionByName(b).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *on, "_v")
    both = written(cut.withColumn("_r", F.spark_partition_id()), "nearest")
    own = ["_r", *on]
    low = Window.partitionBy(*own).orderBy("_v", F.col("_side").desc(), "_t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    high = Window.partitionBy(*own).orderBy(F.col("_v").desc(), F.col("_side").desc(), F.col("_t").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a row for each key and range
    ends = both.filter("_side = 1").groupBy(*own).agg(F.max(hit).alias("_last"), F.min(hit).alias("_first"))
    every = both.select(*own).distinct().join(ends, own, "left")
    before = Window.partitionBy(*on).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*on).orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, -1)
    handed = every.select(*own, F.last("_last", ignorenulls=True).over(before).alias("_lower"), F.last("_first", ignorenulls=True).over(after).alias("_upper"))
    both = both.withColumn("_low", F.last(F.when(F.col("_side") == 1, hit), ignorenulls=True).over(low))
    both = both.withColumn("_high", F.last(F.when(F.col("_side") == 1, hit), ignorenulls=True).over(high)).filter("_side = 0").join(handed, own)
    both = both.withColumn("_low", F.coalesce("_low", "_lower")).withColumn("_high", F.coalesce("_high", "_upper"))
    nearer = F.when(F.col("_low").isNull(), F.col("_high")).when(F.col("_high").isNull(), F.col("_low"))
    nearer = nearer.when(F.col("_v") - F.col("_low")["v"] <= F.col("_high")["v"] - F.col("_v"), F.col("_low")).otherwise(F.col("_high"))
    out = both.withColumn("_n", nearer)
    return out.select("_row.*", F.col("_n")["t"].alias(f"nearest_{tie}"), F.abs(F.col("_v") - F.col("_n")["v"]).alias("nearest_distance")).unionByName(none)


def segments(alleles: DataFrame, keys: list[str], size: str = "insert_size", start: str = "rep_start", end: str = "rep_end", motif: str = "motif", purity: str = "purity", units: str = "rep_units") -> DataFrame:
    """flank, repeat, flank of every allele in one pass, numbered from 0; empty flanks are left out."""
    none_s, none_d = F.lit(None).cast("string"), F.lit(None).cast("double")

    def part(kind, a, b, m, p, u):
        return F.struct(F.lit(kind).alias("seg_type"), a.cast("int").alias("start"), b.cast("int").alias("end"), m.alias("motif"), p.cast("double").alias("purity"), u.cast("double").alias("units"))

    parts = F.array(
        part("flank", F.lit(0), F.col(start), none_s, none_d, none_d),
        part("repeat", F.col(start), F.col(end), F.col(motif), F.col(purity), F.col(units)),
        part("flank", F.col(end), F.col(size), none_s, none_d, none_d),
    )
    kept = F.filter(parts, lambda p: (p["seg_type"] == "repeat") | (p["end"] > p["start"]))
    return alleles.select(*keys, F.posexplode(kept).alias("seg_index", "_p")).select(*keys, "seg_index", "_p.*")
