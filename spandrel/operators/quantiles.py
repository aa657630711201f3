"""Exact quantiles of groups of any size, by selection.

No task holds a group's values. A quantile is one or two places in a group's order; the range of values that holds these places is narrowed
pass by pass. A pass cuts each range that still holds many rows at about evenly spread values, taken from a sketch of bounded size, and
counts exactly, with partial aggregation, how many rows lie at and between the cuts; the counts alone decide where the places are, so the
sketch may err. What is left at last, few rows or a single value, is counted by value and read off.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written

#: A range of more rows is narrowed further; a pass cuts it into so many parts.
ROWS, PARTS = 1_000_000, 32
#: Accuracy of the sketch that proposes cuts.
ACCURACY = 1000


def _same(names: list[str], other: str = "k_") -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(other + c)) for c in names])


def _inside(lines: DataFrame, spans: DataFrame, by: list[str]) -> DataFrame:
    """The values of each open range, with its number. Keys may be null."""
    keys = spans.select(*[F.col(c).alias(f"k_{c}") for c in by], "span", "low", "high")
    return lines.join(keys, _same(by) & F.col("value").between(F.col("low"), F.col("high"))).select("span", "value")


def _narrowed(lines: DataFrame, spans: DataFrame, by: list[str]) -> DataFrame:
    """Each range's part that holds its places: a value alone, what lies between two cuts, or a few of these side by side."""
    inside = _inside(lines, spans, by)
    cuts = inside.groupBy("span").agg(F.array_distinct(F.percentile_approx("value", [k / PARTS for k in range(PARTS + 1)], ACCURACY)).alias("cuts"))
    # places 0, 2, 4, ... are the cuts themselves, 1, 3, ... what lies between them
    below = F.size(F.filter("cuts", lambda c: c < F.col("value")))
    part = 2 * below - F.when(F.array_contains("cuts", F.col("value")), 0).otherwise(1)
    n = inside.join(cuts, "span").groupBy("span", part.alias("part")).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    upto = F.sum("n").over(Window.partitionBy("span").orderBy("part"))  # at most twice as many parts as cuts
    parts = n.select("span", "low", "high", (upto - F.col("n")).alias("start"), upto.alias("stop"))
    kept = spans.select("span", "first", "last", "before").join(parts, "span").filter((F.col("before") + F.col("stop") > F.col("first")) & (F.col("before") + F.col("start") <= F.col("last")))
    new = kept.groupBy("span").agg(F.min("low").alias("low"), F.max("high").alias("high"), (F.min("start") + F.first("before")).alias("before"), F.sum(F.col("stop") - F.col("start")).alias("inside"))
    # a range that stays as it is has two values, one at each place
    old = spans.withColumnRenamed("inside", "_inside").drop("low", "high", "before", "open")
    return old.join(new, "span").withColumn("open", F.col("inside") < F.col("_inside")).select(*spans.columns)


def quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """keys, and for each name of wanted the quantile (share from 0 to 1) of a numeric column in the group, as double; between two values it lies in proportion.

    Null values don't count; a group without values has null; NaN is above all numbers; null keys are a group. An empty table gives an empty result.
    """
    by = [*keys, "column"]
    columns = sorted({c for c, _ in wanted.values()})
    lines = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("_x")).select(*keys, "_x.*")
    lines = lines.filter(F.col("value").isNotNull())
    shares = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(c).alias("of"), F.lit(float(p)).alias("share")) for name, (c, p) in wanted.items()])
    groups = lines.groupBy(*by).agg(F.count("*").alias("inside"), F.min("value").alias("low"), F.max("value").alias("high"))
    place = F.col("share") * (F.col("inside") - 1)
    spans = groups.withColumn("_s", F.explode(shares)).filter(F.col("_s.of") == F.col("column")).select(*by, "_s.name", "_s.share", "low", "high", "inside")
    spans = spans.select(
        *by, "name", place.alias("place"), F.floor(place).alias("first"), F.ceil(place).alias("last"), F.lit(0).cast("long").alias("before"), "low", "high", "inside",
        F.lit(True).alias("open"), F.monotonically_increasing_id().alias("span"),
    )
    spans = written(spans, "quantiles")
    while True:
        wide = F.col("open") & (F.col("inside") > ROWS) & (F.col("low") < F.col("high"))
        if not spans.filter(wide).limit(1).count():
            break
        spans = written(spans.filter(~wide).unionByName(_narrowed(lines, spans.filter(wide), by)), "quantiles")
    n = _inside(lines, spans, by).groupBy("span", "value").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("span").orderBy("value"))  # at most ROWS values
    run = n.select("span", "value", (upto - F.col("n")).alias("start"), upto.alias("stop"))
    at = run.join(spans.select("span", "name", "place", "first", "last", "before", *by), "span")
    holds = lambda p: (F.col("before") + F.col("start") <= F.col(p)) & (F.col("before") + F.col("stop") > F.col(p))
    found = at.filter(holds("first") | holds("last")).groupBy("span").agg(
        F.max(F.when(holds("first"), F.col("value"))).alias("a"), F.max(F.when(holds("last"), F.col("value"))).alias("b"), *[F.first(c).alias(c) for c in [*keys, "name", "place", "first", "last"]]
    )
    between = (F.col("last") - F.col("place")) * F.col("a") + (F.col("place") - F.col("first")) * F.col("b")
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(between)
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, value)).alias(name) for name in wanted])
    every = df.select(*keys).distinct()
    renamed = wide.select(*[F.col(c).alias(f"k_{c}") for c in keys], *wanted)
    return every.join(renamed, _same(keys), "left").select(*keys, *wanted) if keys else wide


def with_quantiles(groups: DataFrame, df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """groups (a row for each group of df) with its quantiles."""
    found = quantiles(df, keys, wanted)
    return groups.join(found.select(*[F.col(c).alias(f"k_{c}") for c in keys], *wanted), _same(keys), "left").drop(*[f"k_{c}" for c in keys])
