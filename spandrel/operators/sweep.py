"""The parameter sweep: every setting of the screen and of the row filters over one set of candidate pairs.

Hits are found once, at the widest window. A setting of the screen is two conditions on a pair (in reach, and matching), so all
settings are conditional aggregates of one pass over the pairs; a setting of the row filters is one condition on a call, so all
combinations are conditional aggregates of one pass over the calls and one over the loci. Nothing is multiplied by the number of settings but columns,
and these go STEP settings at a time.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import reduce
from itertools import product
from math import ceil, exp, prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coords import normalize_chrom, to_internal
from ..functions.motifs import MAX_FUZZY, Equivalence, Tolerance, compare, with_canonical
from ..sources.shared import written
from .intervals import window_join
from .screen import VERDICTS, combined, verdict_rank

# The knobs of the screen and of the row filters, and their defaults.
SCREEN_KNOBS = {
    "window": 10, "max_motif_edits": 0, "max_motif_edit_fraction": None, "min_subrepeat_motif": None, "max_fuzzy_motif": MAX_FUZZY,
    "min_reference_identity": None, "min_reference_copy_num": None, "min_reference_length": None,
}
FILTER_KNOBS = {"min_purity": None, "min_insertion_purity": None, "min_motif_length": None, "max_motif_length": None, "min_rep_length": None, "min_rep_units": None}
KNOBS = {**SCREEN_KNOBS, **FILTER_KNOBS}
#: Row filters: the column and which bound it is.
FILTERED = {
    "min_purity": ("purity", "least"), "min_insertion_purity": ("insertion_purity", "least"), "min_motif_length": ("motif_length", "least"), "max_motif_length": ("motif_length", "most"),
    "min_rep_length": ("rep_length", "least"), "min_rep_units": ("rep_units", "least"),
}
STEP = 24


def settings_of(axes: dict[str, list], sampler: str = "grid", trials: int | None = None, seed: int = 0) -> list[dict]:
    """Settings of all knobs, in order: the whole grid of the axes (its first trials, if given), or as many random draws from them."""
    unknown = [k for k in axes if k not in KNOBS]
    if unknown:
        raise ValueError(f"unknown knobs: {', '.join(unknown)}")
    if sampler == "grid":
        made = [dict(zip(axes, x, strict=True)) for x in product(*axes.values())]
        made = made[:trials] if trials else made
    elif sampler == "random":
        r = random.Random(seed)
        made = [{k: r.choice(v) for k, v in axes.items()} for _ in range(trials or 50)]
    else:
        raise ValueError("a sampler is grid or random")
    return [{**KNOBS, **m} for m in made]


class Parzen:
    """Proposes settings by what earlier ones scored: values that are denser among the best trials than among the others.

    For each axis, the trials' values are spread over the axis's values by a kernel on their distance in its order, above a flat share that keeps
    every value possible; the best trials (a share of BEST) give one density, the rest the other. Of CANDIDATES draws from the first, those with the
    largest ratio are proposed that haven't been tried. Axes are taken one by one. The first trials are drawn at random.
    """

    BEST, CANDIDATES, START, WIDTH = 0.25, 48, 6, 1.0

    def __init__(self, axes: dict[str, list], seed: int = 0):
        self.axes, self.random = axes, random.Random(seed)
        self.size = prod(map(len, axes.values()))

    def _density(self, axis: str, trials: list[dict]) -> list[float]:
        values = self.axes[axis]
        at = [values.index(t[axis]) for t in trials]
        spread = [1 / len(values) + sum(exp(-((k - i) ** 2) / (2 * self.WIDTH**2)) for i in at) for k in range(len(values))]
        return [x / sum(spread) for x in spread]

    def propose(self, tried: list[dict], scores: list[float | None], n: int) -> list[dict]:
        """n settings of the axes that differ from those tried and from each other (fewer if the grid has no more); higher scores are better, None is worst."""
        seen = {tuple(t[a] for a in self.axes) for t in tried}
        n = min(n, self.size - len(seen))
        order = sorted(range(len(tried)), key=lambda k: (scores[k] is None, -(scores[k] or 0), k))
        cut = max(1, ceil(self.BEST * len(order)))
        good, bad = ({a: self._density(a, [tried[k] for k in part]) for a in self.axes} for part in (order[:cut], order[cut:]))
        out: list[dict] = []
        while len(out) < n:
            draws = {}
            for _ in range(self.CANDIDATES if len(tried) >= self.START else n):
                k = {a: self.random.choices(range(len(v)), good[a] if len(tried) >= self.START else None)[0] for a, v in self.axes.items()}
                draws[tuple(v[k[a]] for a, v in self.axes.items())] = prod(good[a][i] / bad[a][i] for a, i in k.items())
            fresh = [x for x in sorted(draws, key=lambda x: -draws[x]) if x not in seen]
            if not fresh:  # all drawn were known: the rest of the grid, in order
                fresh = [x for x in product(*self.axes.values()) if x not in seen]
            for x in fresh[: n - len(out)]:
                seen.add(x)
                out.append(dict(zip(self.axes, x, strict=True)))
        return out


def study(axes: dict[str, list], evaluate: Callable[[list[dict]], list[float | None]], trials: int = 50, batch: int = 6, seed: int = 0, maximize: bool = True) -> list[tuple[dict, float | None]]:
    """Settings and their scores, in the order tried: evaluate gets a batch of settings at a time, which sweep() answers in one pass."""
    unknown = [k for k in axes if k not in KNOBS]
    if unknown:
        raise ValueError(f"unknown knobs: {', '.join(unknown)}")
    sampler, tried, scores = Parzen(axes, seed), [], []
    while len(tried) < trials:
        signed = scores if maximize else [None if s is None else -s for s in scores]
        made = sampler.propose(tried, signed, min(batch, trials - len(tried)))
        if not made:
            break
        scores += evaluate([{**KNOBS, **m} for m in made])
        tried += made
    return list(zip(tried, scores, strict=True))


def _key(setting: dict, knobs) -> tuple:
    return tuple(setting[k] for k in knobs)


def statuses(calls: DataFrame, catalogues: dict[str, DataFrame], screens: list[tuple], key: list[str], how: Equivalence) -> DataFrame:
    """A row for each different query (key: contig, point, motif) with a verdict rank for each catalogue and setting, named p{k}_{n}."""
    asked = with_canonical(calls.select(*key).distinct(), key[2], "_qc", how)
    names, out = list(SCREEN_KNOBS), asked.select(*key)
    widest = max(s[names.index("window")] for s in screens)
    for p, catalogue in enumerate(catalogues.values()):
        held = [c for c in ("per_match", "copy_num") if c in catalogue.columns]
        rows = with_canonical(catalogue.select("chrom", "start", "end", "motif", *held), "motif", "_tc", how)
        rows = rows.select(F.col("chrom").alias("_rc"), F.col("start").alias("_rs"), F.col("end").alias("_re"), "_tc", *[F.col(c).alias(f"_x_{c}") for c in held])
        pairs = window_join(asked, rows, key[0], key[1], "_rc", "_rs", "_re", widest)
        tolerances = list(dict.fromkeys(s[1:5] for s in screens))
        for t, (edits, fraction, sub, fuzzy) in enumerate(tolerances):
            kind = compare(F.col(key[2]), F.col("_qc"), F.col("_tc"), how, Tolerance(edits, fraction, sub, fuzzy))["kind"]
            pairs = pairs.withColumn(f"_m{t}", kind != "")
        parts = []
        for n, (window, *tolerance, identity, copies, length) in enumerate(screens):
            reach = F.col("distance") <= window
            for least, column in ((identity, "per_match"), (copies, "copy_num")):
                if least is not None and column in held:  # a catalogue without the column is not held to it
                    reach = reach & (F.col(f"_x_{column}") >= least)
            if length is not None:
                reach = reach & (F.col("_re") - F.col("_rs") >= length)
            parts += [F.max(reach & F.col(f"_m{tolerances.index(tuple(tolerance))}")).alias(f"_known{n}"), F.max(reach).alias(f"_near{n}")]
        found = pairs.groupBy(*key).agg(*parts)
        covered = catalogue.select(F.col("chrom").alias(key[0])).distinct().withColumn("_covered", F.lit(True))
        named = lambda n: F.when(F.col("_covered").isNull(), 3).when(F.col(f"_known{n}"), 0).when(F.col(f"_near{n}"), 1).otherwise(2).alias(f"p{p}_{n}")  # noqa: B023, E731
        out = out.join(asked.select(*key).join(found, key, "left").join(covered, key[0], "left").select(*key, *[named(n) for n in range(len(screens))]), key)
    return out


def passes(setting: tuple) -> Column:
    """Whether a call passes the row filters; a missing value passes."""
    tests = []
    for (column, bound), value in zip(FILTERED.values(), setting, strict=True):
        if value is not None:
            c = F.col(column)
            tests.append(F.coalesce(c >= value if bound == "least" else c <= value, F.lit(True)))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def sweep(calls: DataFrame, catalogues: dict[str, DataFrame], settings: list[dict], truth: DataFrame | None = None, how: Equivalence = Equivalence(), locus: tuple[str, str] = ("chrom", "ins_coord"), motif: str = "motif", coord_base: int = 1, annotation_only: tuple[str, ...] = ()) -> DataFrame:
    """A row for each setting: trial, the knobs, n_rows, n_rows_pass, rows and loci by verdict, frac_loci_novel, loci by each catalogue's verdict, agreement
    (of the catalogues' novel loci), and with truth (locus columns and a boolean novel) its balanced accuracy over the labelled loci."""
    voting = {n: c for n, c in catalogues.items() if n not in annotation_only}
    key = ["_contig", "_point", "_asked"]
    q = calls.withColumns({"_contig": normalize_chrom(F.col(locus[0])), "_point": to_internal(F.col(locus[1]), coord_base).cast("long"), "_asked": F.upper(F.trim(F.coalesce(F.col(motif), F.lit(""))))})
    screens = list(dict.fromkeys(_key(s, SCREEN_KNOBS) for s in settings))
    known = written(statuses(q, voting, screens, key, how), "sweep")
    rows = q.join(known, key)
    out = []
    for at in range(0, len(settings), STEP):
        out.append(_metrics(rows, list(enumerate(settings))[at : at + STEP], screens, list(voting), truth, locus))
    return reduce(DataFrame.unionByName, out)


def _metrics(rows: DataFrame, settings: list[tuple[int, dict]], screens: list[tuple], names: list[str], truth: DataFrame | None, locus: tuple[str, str]) -> DataFrame:
    n_of = {t: screens.index(_key(s, SCREEN_KNOBS)) for t, s in settings}
    ok = {t: passes(_key(s, FILTER_KNOBS)) for t, s in settings}
    rank = {t: F.least(*[F.col(f"p{p}_{n_of[t]}") for p in range(len(names))]) if len(names) > 1 else F.col(f"p0_{n_of[t]}") for t, _ in settings}
    per_row, per_locus = [F.count("*").alias("n_rows")], []
    for t, _ in settings:
        per_row.append(F.count_if(ok[t]).alias(f"pass_{t}"))
        per_row += [F.count_if(ok[t] & (rank[t] == v)).alias(f"rows_{v}_{t}") for v in range(4)]
        per_locus.append(F.min(F.when(ok[t], rank[t])).alias(f"all_{t}"))
        per_locus += [F.min(F.when(ok[t], F.col(f"p{p}_{n_of[t]}"))).alias(f"of{p}_{t}") for p in range(len(names))]
    loci = rows.groupBy(*locus).agg(*per_locus)
    if truth is not None:
        loci = loci.join(truth.select(*locus, F.col("novel").alias("_truth")), list(locus), "left")
    counts = []
    for t, _ in settings:
        c = F.col(f"all_{t}")
        counts += [F.count(c).alias(f"n_{t}"), *[F.count_if(c == v).alias(f"loci_{v}_{t}") for v in range(4)]]
        counts += [F.count_if(F.col(f"of{p}_{t}") == v).alias(f"of{p}_{v}_{t}") for p in range(len(names)) for v in range(4)]
        novel = [F.col(f"of{p}_{t}") > 0 for p in range(len(names))]
        counts += [F.count_if(reduce(lambda a, b: a & b, novel)).alias(f"every_{t}"), F.count_if(reduce(lambda a, b: a | b, novel)).alias(f"some_{t}")]
        if truth is not None:
            for side, label in (("yes", F.col("_truth")), ("no", ~F.col("_truth"))):
                counts.append(F.avg(F.when(label & c.isNotNull(), ((c > 0) == (side == "yes")).cast("double"))).alias(f"{side}_{t}"))
    one = rows.agg(*per_row).crossJoin(loci.agg(*counts))  # a row by a row

    def record(t: int, s: dict) -> Column:
        n = F.col(f"n_{t}")
        shown = {"trial": F.lit(t), **{k: F.lit(v).cast("double") for k, v in s.items()}, "n_rows": F.col("n_rows"), "n_rows_pass": F.col(f"pass_{t}")}
        shown |= {f"rows_{v}": F.col(f"rows_{k}_{t}") for k, v in enumerate(VERDICTS)} | {"n_loci": n} | {f"loci_{v}": F.col(f"loci_{k}_{t}") for k, v in enumerate(VERDICTS)}
        shown["frac_loci_novel"] = F.round(1 - F.col(f"loci_0_{t}") / F.nullif(n, F.lit(0)), 4)
        shown |= {f"{name}_loci_{v}": F.col(f"of{p}_{k}_{t}") for p, name in enumerate(names) for k, v in enumerate(VERDICTS)}
        shown["agreement"] = F.round(F.coalesce(F.col(f"every_{t}") / F.nullif(F.col(f"some_{t}"), F.lit(0)), F.lit(0.0)), 6)
        if truth is not None:
            yes, no = F.col(f"yes_{t}"), F.col(f"no_{t}")
            shown["balanced_accuracy"] = F.round(F.when(yes.isNull(), no).when(no.isNull(), yes).otherwise((yes + no) / 2), 6)
        return F.struct(*[v.alias(k) for k, v in shown.items()])

    return one.select(F.explode(F.array(*[record(t, s) for t, s in settings])).alias("r")).select("r.*")


def best_trial(metrics: DataFrame, score: str, maximize: bool = True) -> DataFrame:
    """The trial with the best score; the earlier one wins a tie."""
    return metrics.filter(F.col(score).isNotNull()).orderBy(F.col(score).desc() if maximize else F.col(score), "trial").limit(1)


def with_truth(loci: DataFrame, truth: DataFrame, locus: list[str]) -> DataFrame:
    """Loci that have a label, with novel (predicted) and truth."""
    return loci.join(truth.select(*locus, F.col("novel").alias("truth")), locus).withColumn("novel", F.col("novelty") != "known")


def two_scopes(df: DataFrame, locus: list[str], verdict: str = "novelty") -> DataFrame:
    """scope (row or locus), status, n, pct: how often each verdict occurs among rows and, the most conservative of each, among loci."""
    loci = df.groupBy(*locus).agg(F.min(verdict_rank(F.col(verdict))).alias("r"))
    both = df.select(F.lit("row").alias("scope"), verdict_rank(F.col(verdict)).alias("r")).unionByName(loci.select(F.lit("locus").alias("scope"), "r"))
    counts = both.groupBy("scope").agg(F.count("r").alias("total"), *[F.count_if(F.col("r") == k).alias(f"n{k}") for k in range(4)])
    stack = ", ".join(f"'{v}', n{k}" for k, v in enumerate(VERDICTS))
    out = counts.select("scope", "total", F.expr(f"stack(4, {stack}) as (status, n)"))
    return out.select("scope", "status", "n", F.round(100 * F.col("n") / F.nullif(F.col("total"), F.lit(0)), 1).alias("pct"))


__all__ = ["FILTERED", "KNOBS", "best_trial", "combined", "Parzen", "settings_of", "statuses", "study", "sweep", "two_scopes", "with_truth"]
