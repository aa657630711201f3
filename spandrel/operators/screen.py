"""The novelty screen: calls against reference catalogues, per-catalogue verdicts and their combination."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.coords import normalize_chrom, to_internal
from ..functions.motifs import EXACT, NONE, Equivalence, Tolerance, compare, with_canonical
from ..sources.shared import written
from .intervals import best_hit, insertion_purity, window_join

#: Verdicts from the most conservative on.
VERDICTS = ("known", "novel_motif", "novel_locus", "unscreened")


def verdict_rank(verdict: Column) -> Column:
    rank = F.lit(None).cast("int")
    for k, v in enumerate(VERDICTS):
        rank = F.when(verdict == v, k).otherwise(rank)
    return rank


def verdict_of(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in VERDICTS]), rank + 1)


def combined(*verdicts: Column) -> Column:
    """The most conservative of several catalogues' verdicts."""
    ranks = [verdict_rank(v) for v in verdicts]
    return verdict_of(F.least(*ranks) if len(ranks) > 1 else ranks[0])


def rollup(verdict: str) -> Column:
    """Aggregate: the most conservative verdict of a group."""
    return verdict_of(F.min(verdict_rank(F.col(verdict))))


def majority(df: DataFrame, keys: list[str], verdict: str, out: str = "verdict") -> DataFrame:
    """The commonest verdict of each key; the more conservative wins a tie."""
    n = df.groupBy(*keys, verdict).count()
    return best_hit(n, keys, [F.col("count").desc(), verdict_rank(F.col(verdict)), F.col(verdict)]).select(*keys, F.col(verdict).alias(out))


@dataclass(frozen=True)
class RepeatFilter:
    """Which catalogue rows count. A threshold whose column the catalogue lacks is not applied."""

    min_identity: float | None = None
    min_copy_num: float | None = None
    min_length: int | None = None

    def apply(self, catalogue: DataFrame) -> tuple[DataFrame, list[str]]:
        """The rows that pass, and the thresholds that could not be applied."""
        left_out = []
        for value, column in ((self.min_identity, "per_match"), (self.min_copy_num, "copy_num")):
            if value is None:
                continue
            if column in catalogue.columns:
                catalogue = catalogue.filter(F.col(column) >= value)
            else:
                left_out.append(column)
        if self.min_length is not None:
            catalogue = catalogue.filter(F.col("end") - F.col("start") >= self.min_length)
        return catalogue, left_out


def screen(calls: DataFrame, catalogue: DataFrame, prefix: str = "", chrom: str = "chrom", point: str = "point", motif: str = "motif", window: int = 10, how: Equivalence = Equivalence(), tolerance: Tolerance = Tolerance(), repeat_filter: RepeatFilter = RepeatFilter()) -> DataFrame:
    """calls with prefix + novelty, n_nearby, start, end, distance, motif, canonical, motif_edits, match and the catalogue's annotations.

    Every row stays. A contig without any catalogue row is unscreened. Candidates are ranked by whether the motif matches, edits,
    distance, copies (more first) and their place in (chrom, start, end, motif) order. A column canonical of the catalogue is taken as its motifs' canonical
    form under the same equivalence.
    """
    # different queries are screened once, and rows follow by what they ask
    key = ["_chrom", "_point", "_motif"]
    q = calls.withColumns({"_chrom": normalize_chrom(F.col(chrom)), "_point": F.col(point).cast("long"), "_motif": F.upper(F.trim(F.coalesce(F.col(motif), F.lit(""))))})
    # read many times below, and one screen may follow another
    asked = written(with_canonical(q.select(*key).distinct(), "_motif", "_qc", how), "asked")
    extra = [c for c in catalogue.columns if c not in ("chrom", "start", "end", "motif", "canonical")]
    rows, _ = repeat_filter.apply(catalogue)
    # a catalogue that was kept with its canonical motifs (sources.platforms.cached, under the same equivalence) has them ready
    rows = rows.withColumnRenamed("canonical", "_tc") if "canonical" in catalogue.columns else with_canonical(rows, "motif", "_tc", how)
    rows = rows.select(F.col("chrom").alias("_rc"), F.col("start").alias("_rs"), F.col("end").alias("_re"), F.col("motif").alias("_rm"), "_tc", *[F.col(c).alias(f"_x_{c}") for c in extra])
    # different points are looked up once among different intervals and forms of motifs
    copies = F.coalesce(F.col("_x_copy_num").cast("double"), F.lit(0.0)) if "copy_num" in extra else F.lit(0.0)
    spot, at = ["_rc", "_rs", "_re"], ["_chrom", "_point"]
    held = ["_rm", "_tc", *[f"_x_{c}" for c in extra]]
    kinds = rows.groupBy(*spot, "_tc").agg(F.count("*").alias("_n"), F.min(F.struct((-copies).alias("c"), *held)).alias("_top"))
    # candidates of one distance have one order, so a number stands for each, and what is best of a point's many is a least number
    kinds = written(kinds.orderBy("_top.c", "_rs", "_re", "_top").withColumn("_id", F.monotonically_increasing_id()), "kinds")
    count = max(1, kinds.count())
    ranges = kinds.groupBy(F.shiftright("_id", 33).alias("_range")).agg(F.count("*").alias("_rows"))  # a row for each range of the sort
    ranges = ranges.select("_range", (F.sum("_rows").over(Window.orderBy("_range")) - F.col("_rows")).alias("_before"))
    kinds = kinds.withColumn("_range", F.shiftright("_id", 33)).join(F.broadcast(ranges), "_range").withColumn("_k", F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1))
    near = window_join(asked.select(*at).distinct(), kinds.select(*spot, "_tc", "_n", "_k"), "_chrom", "_point", *spot, window)
    near = written(near.groupBy(*at, "_tc").agg(F.min(F.col("distance") * count + F.col("_k")).alias("_at"), F.sum("_n").alias("_n")), "near")
    # under equal budgets of edits one that doesn't match is as good as any other
    level = (tolerance.max_edits if tolerance.max_edits > 0 else 0) + 1
    nothing = F.struct(F.lit(NONE).alias("kind"), F.lit(level).alias("edits"))
    other = near.groupBy(*at).agg(F.sum("_n").alias("n_nearby"), F.min("_at").alias("_other"))
    # motifs are compared by their canonical form, which has the same rotations; a complement's complement may read T for U
    mine = "_motif" if how.reverse_complement else "_qc"
    # (point, motif) may be asked for in several forms
    forms = asked.select(*at, mine, F.col("_qc").alias("_q")).distinct().withColumnRenamed(mine, "_mine")
    if tolerance.exact_only:
        met = forms.join(near.withColumnRenamed("_tc", "_q"), [*at, "_q"]).withColumn("_m", F.struct(F.lit(EXACT).alias("kind"), F.lit(0).alias("edits")))
    else:
        met = forms.join(near, at)
        # different motifs are compared once
        pairs = met.select("_mine", "_q", "_tc").distinct().withColumn("_m", compare(F.col("_mine"), F.col("_q"), F.col("_tc"), how, tolerance))
        pairs = pairs.select(F.col("_mine").alias("_p_mine"), F.col("_tc").alias("_p_tc"), "_m")
        pairs = written(pairs if tolerance.max_edit_fraction else pairs.filter(F.col("_m.kind") != NONE), "pairs")
        same = (F.col("_mine") == F.col("_p_mine")) & F.col("_tc").eqNullSafe(F.col("_p_tc"))
        met = met.join(pairs, same)
    # matches come first, then fewer edits
    span = count * (window + 2)
    order = F.when(F.col("_m.kind") != NONE, 0).otherwise(1 << 16) + F.least("_m.edits", F.lit((1 << 16) - 1))
    best = met.groupBy(*at, "_mine").agg(F.min(order.cast("long") * span + F.col("_at")).alias("_best"))
    found = asked.withColumn("_mine", F.col(mine)).join(other, at, "left").join(best, [*at, "_mine"], "left").withColumn("_at", F.coalesce(F.col("_best") % span, "_other"))
    found = found.withColumn("_k", F.col("_at") % count).withColumn("distance", F.expr(f"_at div {count}L"))
    found = found.join(kinds.select("_k", "_rs", "_re", *[F.col(f"_top.{c}").alias(c) for c in held]), "_k", "left")
    if tolerance.exact_only:
        told = F.struct(F.lit(EXACT).alias("kind"), F.lit(0).alias("edits"))
    else:
        found, told = found.join(pairs, same, "left"), F.col("_m")
    found = found.withColumn("_m", F.when(F.col("_best").isNotNull(), told).when(F.col("n_nearby").isNotNull(), nothing))
    found = found.select(*key, "n_nearby", "distance", "_rs", "_re", "_m", *held)
    covered = catalogue.select(F.col("chrom").alias("_chrom")).distinct().withColumn("_covered", F.lit(True))
    out = q.join(found, key, "left").join(covered, "_chrom", "left")
    novelty = F.when(F.col("_covered").isNull(), "unscreened").when(F.col("n_nearby").isNull(), "novel_locus").when(F.col("_m.kind") != "", "known").otherwise("novel_motif")
    block = {
        "novelty": novelty, "n_nearby": F.coalesce("n_nearby", F.lit(0)), "start": F.col("_rs"), "end": F.col("_re"), "distance": F.col("distance"), "motif": F.col("_rm"),
        "canonical": F.col("_tc"), "motif_edits": F.col("_m.edits"), "match": F.col("_m.kind"), **{c: F.col(f"_x_{c}") for c in extra},
    }
    kept = [c for c in calls.columns if c not in {prefix + c for c in block}]
    return out.select(*kept, *[v.alias(prefix + k) for k, v in block.items()])


def annotate(calls: DataFrame, catalogues: dict[str, DataFrame], checks: list[tuple[str, Column, float | None]] = (), annotation_only: tuple[str, ...] = (), coord_base: int = 1, **how) -> DataFrame:
    """The whole screen in one plan: insertion purity, a block per catalogue, the combined verdict and the filter tag."""
    from ..functions.text import first_integer

    df = calls.withColumn("insert_size", first_integer(F.col("insert_size").cast("string")))
    keys = [c for c in ("chrom", "ins_coord", "SVID", "sample", "allele") if c in df.columns]
    df = insertion_purity(df, keys).withColumn("point", to_internal(F.col("ins_coord"), coord_base))
    for name, catalogue in catalogues.items():
        df = screen(df, catalogue, f"{name}_", **how)
    votes = [F.col(f"{n}_novelty") for n in catalogues if n not in annotation_only]
    return df.withColumn("novelty", combined(*votes)).withColumn("filter", filter_tags(list(checks))).drop("point")


def filter_tags(checks: list[tuple[str, Column, float | None]]) -> Column:
    """PASS, or the tags of the checks whose value is below its minimum, joined by commas. Null passes, equality too; a
    minimum of None is no check."""
    failed = [F.when(value < least, tag) for tag, value, least in checks if least is not None]
    return F.coalesce(F.nullif(F.concat_ws(",", *failed), F.lit("")), F.lit("PASS")) if failed else F.lit("PASS")


def agreement(df: DataFrame, verdicts: list[str]) -> DataFrame:
    """Jaccard similarity of the rows that each catalogue calls novel (anything but known); 0 when none is."""
    novel = [F.col(v) != "known" for v in verdicts]
    every, some = novel[0], novel[0]
    for n in novel[1:]:
        every, some = every & n, some | n
    ratio = F.count_if(every) / F.nullif(F.count_if(some), F.lit(0))
    return df.agg(F.coalesce(ratio, F.lit(0.0)).alias("agreement"))


def balanced_accuracy(truth: Column, predicted: Column) -> Column:
    """Mean recall of the classes that occur; null when there is none."""
    yes = F.avg(F.when(truth, predicted.cast("double")))
    no = F.avg(F.when(~truth, (~predicted).cast("double")))
    return F.when(yes.isNull(), no).when(no.isNull(), yes).otherwise((yes + no) / 2)


def is_novel_label(label: Column) -> Column:
    return ~F.lower(F.trim(label)).isin("known", "false", "0", "no")


#: For each way two catalogues may stand to each other: whether the first and the second call a row new.
AGREEMENT = {"both": (True, True), "ucsc_only": (True, False), "trexplorer_only": (False, True), "neither": (False, False)}


def agreement_as(mode: str, first: Column, second: Column) -> Column:
    """Rows that both catalogues, only one of them or neither call new; any verdict but known is new. Rows without a verdict match no mode."""
    one, two = AGREEMENT[mode]
    return ((first != "known") == one) & ((second != "known") == two)


def sweep_filters(df: DataFrame, grid: dict[str, list], rule, unit: str) -> DataFrame:
    """A row for each setting of the grid: its values, n (rows that rule admits) and n_units (different units among them). One pass: a unit's rows are
    counted under every setting at once, then the units. operators.sweep does the same for the screen's own knobs."""
    from itertools import product

    settings = [dict(zip(grid, map(float, x), strict=True)) for x in product(*grid.values())]
    per = df.groupBy(unit).agg(*[F.count_if(rule({k: F.lit(v) for k, v in s.items()})).alias(f"n{t}") for t, s in enumerate(settings)])
    one = per.agg(*[c for t in range(len(settings)) for c in (F.coalesce(F.sum(f"n{t}"), F.lit(0)).alias(f"n{t}"), F.count_if(F.col(f"n{t}") > 0).alias(f"u{t}"))])
    rows = [F.struct(*[F.lit(v).alias(f"s_{k}") for k, v in s.items()], F.col(f"n{t}").alias("n"), F.col(f"u{t}").alias("n_units")) for t, s in enumerate(settings)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def parse_axis(text: str) -> list[float | None]:
    """A sweep axis: a,b,c or lo:hi:step or none."""
    if text.strip().lower() in ("none", "off", ""):
        return [None]
    if ":" in text:
        parts = [float(x) for x in text.split(":")]
        if len(parts) != 3:
            raise ValueError(f"a range needs a step to be a grid: {text!r}")
        lo, hi, step = parts
        return [lo + k * step for k in range(int((hi - lo) / step + 1e-9) + 1)]
    return [None if x.strip().lower() == "none" else float(x) for x in text.split(",")]
