"""Similarity joins on edit distance.

If two strings are at most k edits apart and one is cut into k + 1 segments, k edits can't touch them all: one segment stands in the other string as it
is, at most k places from its own. So segments are the keys of an equality join, with the length and the segment's number: the shorter string gives its
own, the longer one whatever stands where a segment of such a length could be. Pairs that meet are compared once. What is looked up has some hundred rows
for each string, of which a size estimated from the input knows nothing: it is sorted and merged, never broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.motifs import Equivalence, edit_distance, primitive_unit, reverse_complement, rotations, with_canonical


def _segment(length: Column, k: int, i: Column) -> tuple[Column, Column]:
    """Where the i-th of k + 1 segments of a string begins (from 1), and its length; the first ones are the short ones."""
    base = F.floor(length / (k + 1)).cast("int")
    short = F.lit(k + 1) - (length - base * (k + 1))
    return i * base + F.greatest(F.lit(0), i - short) + 1, base + F.when(i >= short, 1).otherwise(0)


def _cut(df: DataFrame, text: str, k: int) -> DataFrame:
    """df with a row for each of its own segments: _n (length), _i, _part."""
    n = F.length(text)
    rows = df.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(k))))
    start, size = _segment(F.col("_n"), k, F.col("_i"))
    return rows.withColumn("_part", F.substring(F.col(text), start, size))


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys in as many partitions as shuffles have: adaptive execution would take few strings together, and all their rows with them."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *(keys or df.columns))


def _probed(df: DataFrame, text: str, k: int, least: Column, most: Column) -> DataFrame:
    """df with a row for each different segment that a string of least to most letters could have in it."""
    m = F.length(text)
    rows = df.withColumn("_n", F.explode(F.sequence(F.greatest(F.lit(0), m + least), m + most))).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(k))))
    start, size = _segment(F.col("_n"), k, F.col("_i"))
    rows = rows.withColumn("_at", start).withColumn("_size", size).withColumn("_at", F.explode(F.sequence(F.col("_at") - k, F.col("_at") + k)))
    rows = rows.filter((F.col("_at") >= 1) & (F.col("_at") + F.col("_size") - 1 <= m)).withColumn("_part", F.substring(F.col(text), F.col("_at"), F.col("_size")))
    return _spread(rows.drop("_at", "_size"), "_n", "_i", "_part").distinct()


def similar_pairs(df: DataFrame, text: str, k: int) -> DataFrame:
    """a, b (a first in order) and edits of all pairs of different strings at most k edits apart. Null is near nothing."""
    t = _spread(df.select(F.col(text).alias("b")).filter("b is not null").distinct())
    cut = _cut(t, "b", k)
    # lengths differ by k at most; the shorter one gives the segments
    long = _probed(t.withColumnRenamed("b", "a"), "a", k, F.lit(-k), F.lit(0))
    met = long.hint("merge").join(cut, ["_n", "_i", "_part"]).filter((F.length("a") > F.length("b")) | (F.col("a") < F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return met.withColumn("edits", edit_distance(F.col("a"), F.col("b"), k)).filter(F.col("edits") <= k)


def similar_motifs(left: DataFrame, right: DataFrame, motif: str, other: str, k: int, how: Equivalence = Equivalence()) -> DataFrame:
    """motif, other, edits of all pairs of different motifs of two tables where some admitted form (rotation, strand) of motif is at most k edits from other's canonical form."""
    a = _spread(left.select(F.upper(F.trim(motif)).alias("motif")).filter("motif <> ''").distinct())
    b = with_canonical(right.select(F.upper(F.trim(other)).alias("other")).filter("other <> ''").distinct(), "other", "_form", how)
    unit = primitive_unit(F.col("motif"))
    turns = lambda u: rotations(u) if how.circular else F.array(u)
    forms = F.array_distinct(F.concat(turns(unit), turns(reverse_complement(unit))) if how.reverse_complement else turns(unit))
    if how.reverse_complement and how.reverse_complement_bp is not None:
        forms = F.when(F.length(unit) >= how.reverse_complement_bp, forms).otherwise(F.array_distinct(turns(unit)))
    probe = _probed(a.withColumn("_turn", F.explode(forms)), "_turn", k, F.lit(-k), F.lit(k))
    # different forms are cut once, and motifs follow by their form
    cut = _cut(b.select("_form").distinct(), "_form", k)
    near = probe.hint("merge").join(cut, ["_n", "_i", "_part"]).select("motif", "_turn", "_form").distinct().withColumn("edits", edit_distance(F.col("_turn"), F.col("_form"), k)).filter(F.col("edits") <= k)
    return near.groupBy("motif", "_form").agg(F.min("edits").alias("edits")).join(b, "_form").select("motif", "other", "edits")
