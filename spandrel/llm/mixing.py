"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies r = target / size of the source. Laid end to end
they reach r, 2r, 3r, ...; one random offset per source is added, and a document is emitted once for every whole
number its stretch crosses. A document's copies thus come from its rank within its source alone. Documents are ranked
by size class, within it by a cell of a hash, and by size within the cell, which keeps the words taken near the target.

Ranks are found without bringing a source together: a source is cut into cells by size class and by a hash of doc_id (more cells for
more rows, so a table of another size is drawn from otherwise; any draw is a valid mix), cells are
counted with partial aggregation, a running sum over the cells gives each cell's first rank, and rows are numbered
within their cell. A hot source is spread over its cells.

Targets: sources in order of code point, null last, weigh 3, 1, 2, 3, 1, 2, ...; they share budget times all sizes,
and stop at cap times their own size, the excess going to the others by weight until none is above. As a source that
fills up sooner (cap times size over weight) is full whenever a later one is, one running sum over the sources finds
the full ones.

Defined cases: a null text has size 0; rows of a null source form a source; repeated rows are separate documents; an
empty table gives an empty result; a source without words gets target 0 and no copies; columns of the input whose names clash with the
results are replaced, any other name is allowed. Equal inputs give equal results: the offset depends on seed and source only, and ties of size
and doc_id fall by a hash of the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, stored

WEIGHTS = (3, 1, 2)
BUDGET, CAP = 1.5, 2
#: Into at least so many parts a size class of a source is cut by doc_id; more where that leaves more than about CELL_ROWS rows to each.
CELLS, CELL_ROWS = 64, 1 << 20
SEED = "mix"


def n_words(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    edge = F.when(t.rlike(rf"^(?:{SPACE}|\z)"), 1).otherwise(0) + F.when(t.rlike(rf"{SPACE}\z"), 1).otherwise(0)
    return (F.size(F.split(t, SPACE + "+")) - edge).cast("long")


def size_class(size: Column) -> Column:
    """Four classes for every doubling of the size."""
    bits = F.length(F.bin(size))
    return bits * 4 + F.pmod(F.call_function("shiftright", size, F.greatest(bits - 3, F.lit(0))).cast("int"), F.lit(4))


def targets(sizes: DataFrame, budget: float = BUDGET, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """key, source, source_size (a row per source) with its target and its offset. The windows without a partition
    hold one row per source."""
    place = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), place + 1).cast("long")
    limit = (F.col("source_size") * cap).cast("long")
    ranked = sizes.withColumn("w", w).withColumn("limit", limit).withColumn("fills", F.col("limit").cast("double") / F.col("w"))
    everything = Window.orderBy("fills", "key").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("fills", "key").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything) * F.lit(float(budget))
    left = total - F.coalesce(F.sum("limit").over(before), F.lit(0))
    heavy = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))
    full = ranked.withColumn("full", F.col("limit").cast("double") * heavy <= F.col("w") * left).withColumn("total", total)
    free = F.col("total") - F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0)).over(everything)
    share = F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(everything)
    target = F.when(F.col("full"), F.col("limit").cast("double")).otherwise(F.col("w") * free / share)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(SEED + ":"), F.col("key"))), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    return full.withColumn("target", target).select("key", "source_size", "target", offset.alias("offset"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", ident: str = "doc_id", carry: list[str] | None = None, **how) -> DataFrame:
    """Every document once, with size, source_size, target, copies and taken (copies times size)."""
    ours = {"size", "source_size", "target", "copies", "taken"}
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ours]
    held = [f"in_{c}" for c in carry]
    key = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))
    given = [F.col(c).alias(f"in_{c}") for c in carry]
    sized = docs.select(*given, key.alias("key"), F.col(source).alias("source"), F.col(ident).alias("id"), n_words(F.col(text)).alias("size"))
    sized = stored(sized.withColumn("class", size_class(F.col("size"))), "mix")
    # a window holds the rows of one cell; their number follows the table's
    n_cells = max(CELLS, -(-sized.count() // CELL_ROWS))
    cell = F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long"), F.lit(n_cells))
    sized = sized.withColumn("cell", cell)
    at = ["key", "class", "cell"]
    cells = sized.groupBy(*at).agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.first("source").alias("source"))
    cells = stored(cells, "mix-cells")
    sources = cells.groupBy("key").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    upto = Window.partitionBy("key").orderBy("class", "cell").rowsBetween(Window.unboundedPreceding, -1)
    first = cells.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).drop("n", "words", "source")
    first = first.join(targets(sources, **how), "key")
    within = Window.partitionBy(*at).orderBy("size", "id", F.xxhash64(*held))
    out = sized.join(first, at).withColumn("rank", F.col("before") + F.row_number().over(within))
    r = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor(F.col("rank") * r + F.col("offset")) - F.floor((F.col("rank") - 1) * r + F.col("offset"))
    back = [F.col(h).alias(c) for h, c in zip(held, carry, strict=True)]
    return out.select(*back, "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source", ident: str = "doc_id", **how) -> DataFrame:
    """The mixture itself: docs' rows, each as many times as it was drawn."""
    drawn = mix(docs.select(*[F.col(c).alias(f"in_{c}") for c in docs.columns]), f"in_{text}", f"in_{source}", f"in_{ident}", **how).filter("copies > 0")
    again = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return again.select(*[F.col(f"in_{c}").alias(c) for c in docs.columns])
