"""The library's products end to end: annotate and its reports, the parameter sweep, the pages' endpoints, phenotype search, and fields derived on the way."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import coords, text
from ..operators import cohort, disease, display, endpoints, report, rollup, screen, search, serve, sweep
from ..sources import synthetic
from ..sources.shared import written
from .oracles import _BOTH, _CALLS, _CAT, _DISEASE, _LOCI, _ORDER, _POINTS, _UNION, _canonical, _distance
from .oracles import _dna as _sql_dna
from .queries import _calls, _catalogue, _dna, _loci, _points, _t, query

ORACLES: dict[str, str] = {}
V = screen.VERDICTS

# --- annotate, query, sweep: customers as calls, suppliers as two catalogues -----------------------------------------


def _screened(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    return _points(spark, sf_dir).select(
        "chrom", (F.col("point") + 1).alias("ins_coord"), F.concat(F.lit("sv"), k).alias("SVID"), F.concat(F.lit("s"), k % 7).alias("sample"), F.concat(F.lit("["), k % 9 + 20, F.lit("]")).alias("insert_size"), F.lit(0).alias("rep_start"),
        (k % 25).cast("int").alias("rep_end"), "motif", (k % 10 / 10).alias("purity"), F.length("motif").alias("motif_length"), (k % 25).cast("int").alias("rep_length"), (k % 6).cast("double").alias("rep_units"),
    )


def _reference(spark, sf_dir) -> dict[str, DataFrame]:
    a = _catalogue(spark, sf_dir)
    one = a.select("chrom", "start", "end", "motif", (F.col("s_suppkey") % 10).cast("double").alias("copy_num"))
    two = a.select("chrom", (F.col("start") + 250).alias("start"), (F.col("end") + 50).alias("end"), _dna(F.col("s_suppkey") + 1, 3).alias("motif"))
    return {"ucsc": one, "trexplorer": two}


_CALL = "(select *, point + 1 as ins_coord, c_custkey % 10 / 10 as purity, (c_custkey % 6)::double as rep_units, c_custkey % 25 as rep_end, c_custkey % 9 + 20 as size from " + _POINTS + ")"
_CATS = {"ucsc": f"(select chrom, start, stop, motif, (s_suppkey % 10)::double as copies from {_CAT})", "trexplorer": f"(select chrom, start + 250 as start, stop + 50 as stop, {_sql_dna('s_suppkey + 1', 3)} as motif, null::double as copies from {_CAT})"}


def _rank(name: str, window: int, copies: float | None = None, edits: int = 0) -> str:
    """(c_custkey, rank) of every call under one setting of the screen."""
    near = f"c.start < p.point + {window} + 1 and c.stop > p.point - {window}" + (f" and (c.copies is null or c.copies >= {copies})" if copies is not None else "")
    match = f"{_canonical('p.motif')} = {_canonical('c.motif')}"
    return f"(select p.c_custkey, case when p.chrom not in (select chrom from {_CATS[name]}) then 3 when max(case when {match} then 1 else 0 end) filter (where {near}) = 1 then 0 when count(*) filter (where {near}) > 0 then 1 else 2 end as rank from {_POINTS} p left join {_CATS[name]} c on p.chrom = c.chrom group by p.c_custkey, p.chrom)"


def _status(rank: str) -> str:
    return "case " + rank + " " + " ".join(f"when {k} then '{v}'" for k, v in enumerate(V)) + " end"


def _annotated(spark, sf_dir) -> DataFrame:
    refs = _reference(spark, sf_dir)
    few = refs["ucsc"].filter("copy_num = 3").drop("copy_num")
    return screen.annotate(_screened(spark, sf_dir), {**refs, "pathogenic": few}, [("purity", F.col("purity"), 0.3), ("units", F.col("rep_units"), 2.0)], annotation_only=("pathogenic",), window=25)


_MARKED = f"""(select p.*, least(a.rank, b.rank) as rank, a.rank as ra, b.rank as rb, least(round(rep_end / size, 3), 1.0) as insertion_purity, coalesce(nullif(concat_ws(',', case when purity < 0.3 then 'purity' end, case when rep_units < 2 then 'units' end), ''), 'PASS') as filter
  from {_CALL} p join {_rank('ucsc', 25)} a on a.c_custkey = p.c_custkey join {_rank('trexplorer', 25)} b on b.c_custkey = p.c_custkey)"""


@query
def annotate_calls(spark, sf_dir):
    return _annotated(spark, sf_dir).select("SVID", "novelty", "ucsc_novelty", "trexplorer_novelty", "insertion_purity", "filter")


@query
def annotate_report(spark, sf_dir):
    """Among rows and among loci, of what passes every filter."""
    return sweep.two_scopes(_annotated(spark, sf_dir).filter("filter = 'PASS'"), ["chrom", "ins_coord"])


@query
def annotate_dropped(spark, sf_dir):
    return _annotated(spark, sf_dir).groupBy("filter").agg(F.count("*").alias("n"), F.count_if(F.col("filter") == "PASS").alias("n_kept"))


@query
def query_locus(spark, sf_dir):
    """One locus asked of every catalogue, and the combined verdict."""
    call = spark.createDataFrame([("chr5", 4000, "CA")], "chrom string, point long, motif string")
    parts = [screen.screen(call, c, window=1500).select(F.lit(n).alias("platform"), "novelty", F.col("n_nearby").cast("long").alias("n_nearby"), F.col("start").alias("first"), "distance") for n, c in _reference(spark, sf_dir).items()]
    both = reduce(DataFrame.unionByName, parts)
    total = both.agg(F.lit("combined").alias("platform"), screen.rollup("novelty").alias("novelty"), F.sum("n_nearby").alias("n_nearby"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("distance"))
    return both.unionByName(total)


GRID = {"window": [0, 25], "min_reference_copy_num": [None, 5.0], "min_purity": [None, 0.5], "min_rep_units": [None, 3.0]}


def _truth(spark, sf_dir) -> DataFrame:
    c = _t(spark, sf_dir, "customer").filter("c_acctbal > 0")
    at = c.select(F.concat(F.lit("chr"), "c_nationkey").alias("chrom"), (F.floor("c_acctbal").cast("long") + 1).alias("ins_coord"), screen.is_novel_label(F.when(F.col("c_mktsegment") == "BUILDING", " Known").otherwise("novel")).alias("novel"))
    return at.groupBy("chrom", "ins_coord").agg(F.min("novel").alias("novel"))


def _swept(spark, sf_dir) -> DataFrame:
    return sweep.sweep(_screened(spark, sf_dir), _reference(spark, sf_dir), sweep.settings_of(GRID), _truth(spark, sf_dir))


@query
def parameter_sweep(spark, sf_dir):
    return _swept(spark, sf_dir).drop(*[k for k in sweep.KNOBS if k not in GRID])


@query
def best_trial(spark, sf_dir):
    return sweep.best_trial(_swept(spark, sf_dir), "balanced_accuracy").select("trial", "balanced_accuracy", "agreement")


AXES = {"window": [0, 10, 25, 50], "min_reference_copy_num": [None, 2.0, 5.0], "min_purity": [None, 0.5], "min_rep_units": [None, 3.0]}


@query
def model_trials(spark, sf_dir):
    """A model-based search of 48 settings, 12 to a pass, that tries half of them: how many it tried, and the best score among all that it found."""
    calls, reference, truth = _screened(spark, sf_dir), _reference(spark, sf_dir), _truth(spark, sf_dir)
    passes = []

    def scores(settings: list[dict]) -> list[float | None]:
        passes.append(written(sweep.sweep(calls, reference, settings, truth).select("trial", "balanced_accuracy"), "trials"))
        return [r.balanced_accuracy for r in passes[-1].orderBy("trial").collect()]

    tried = sweep.study(AXES, scores, trials=24, batch=12, seed=1)
    return reduce(DataFrame.unionByName, passes).agg(F.count("*").alias("n_trials"), F.max("balanced_accuracy").alias("balanced_accuracy"), F.lit(len({tuple(t.values()) for t, _ in tried})).cast("long").alias("n_different"))


@query
def random_trials(spark, sf_dir):
    """Drawn settings: the same seed, the same draws; each is one of the axes' values."""
    made = sweep.settings_of({"window": [0, 5, 25], "min_purity": [None, 0.5]}, "random", 8, seed=3)
    again = sweep.settings_of({"window": [0, 5, 25], "min_purity": [None, 0.5]}, "random", 8, seed=3)
    return spark.createDataFrame([(len(made), made == again, all(m["window"] in (0, 5, 25) and m["min_purity"] in (None, 0.5) for m in made))], "n long, repeatable boolean, within boolean")


def _sweep_sql(grid: dict[str, list] = GRID) -> str:
    parts, k = [], 0
    for w in grid["window"]:
        for c in grid["min_reference_copy_num"]:
            for pu in grid["min_purity"]:
                for u in grid["min_rep_units"]:
                    keep = " and ".join(["true", *([f"purity >= {pu}"] if pu is not None else []), *([f"rep_units >= {u}"] if u is not None else [])])
                    show = lambda x: "null::double" if x is None else f"{float(x)}::double"
                    name = f"s{w}_{0 if c is None else int(c)}"
                    n = ", ".join(f"count(*) filter (where ok and rank = {v}) as rows_{x}" for v, x in enumerate(V))
                    of = lambda col, p: ", ".join(f"count(*) filter (where {col} = {v}) as {p}loci_{x}" for v, x in enumerate(V))
                    recall = lambda t: f"avg(case when {'truth' if t else 'not truth'} and l is not null then ((l > 0) = {str(t).lower()})::int end)"
                    parts.append(f"""select * from (select {k}::int as trial, {show(w)} as "window", {show(c)} as min_reference_copy_num, {show(pu)} as min_purity, {show(u)} as min_rep_units, count(*) as n_rows, count(*) filter (where ok) as n_rows_pass, {n} from (select *, {keep} as ok from {name})),
      (select count(l) as n_loci, {of('l', '')}, round(1 - count(*) filter (where l = 0) / nullif(count(l), 0), 4) as frac_loci_novel, {of('a', 'ucsc_')}, {of('b', 'trexplorer_')}, round(coalesce(count(*) filter (where a > 0 and b > 0) / nullif(count(*) filter (where a > 0 or b > 0), 0), 0), 6) as agreement,
        round(case when {recall(True)} is null then {recall(False)} when {recall(False)} is null then {recall(True)} else ({recall(True)} + {recall(False)}) / 2 end, 6) as balanced_accuracy
        from (select chrom, ins_coord, min(rank) filter (where ok) as l, min(ra) filter (where ok) as a, min(rb) filter (where ok) as b from (select *, {keep} as ok from {name}) group by 1, 2) left join truth using (chrom, ins_coord))""")
                    k += 1
    ctes = ", ".join(f"s{w}_{0 if c is None else int(c)} as (select p.*, a.rank as ra, b.rank as rb, least(a.rank, b.rank) as rank from {_CALL} p join {_rank('ucsc', w, c)} a on a.c_custkey = p.c_custkey join {_rank('trexplorer', w, c)} b on b.c_custkey = p.c_custkey)" for w in grid["window"] for c in grid["min_reference_copy_num"])
    truth = "truth as (select 'chr' || c_nationkey as chrom, floor(c_acctbal)::bigint + 1 as ins_coord, bool_and(c_mktsegment <> 'BUILDING') as truth from customer where c_acctbal > 0 group by 1, 2)"
    return f"with {ctes}, {truth} " + " union all ".join(parts)


ORACLES["annotate_calls"] = f"select 'sv' || c_custkey as SVID, {_status('rank')} as novelty, {_status('ra')} as ucsc_novelty, {_status('rb')} as trexplorer_novelty, insertion_purity, filter from {_MARKED}"
ORACLES["annotate_report"] = f"""with m as (select * from {_MARKED} where filter = 'PASS'), l as (select min(rank) as rank from m group by chrom, ins_coord), b as (select 'row' as scope, rank from m union all select 'locus', rank from l)
  select scope, status, count(*) filter (where {_status('rank')} = status) as n, round(100 * count(*) filter (where {_status('rank')} = status) / count(*), 1) as pct from b, (select unnest({list(V)}) as status) group by 1, 2"""
ORACLES["annotate_dropped"] = f"select filter, count(*) as n, count(*) filter (where filter = 'PASS') as n_kept from {_MARKED} group by 1"
ORACLES["parameter_sweep"] = _sweep_sql()
ORACLES["best_trial"] = f"select trial, balanced_accuracy, agreement from ({_sweep_sql()}) where balanced_accuracy is not null order by balanced_accuracy desc, trial limit 1"
ORACLES["model_trials"] = f"select 24::bigint as n_trials, max(balanced_accuracy) as balanced_accuracy, 24::bigint as n_different from ({_sweep_sql(AXES)})"
ORACLES["random_trials"] = "select 8::bigint as n, true as repeatable, true as within"
_ONE = "select '{n}' as platform, count(*) as n, max(case when {c} = 'AC' then 1 else 0 end) as hit, arg_min(start, (case when {c} = 'AC' then 0 else 1 end, {d}, -coalesce(copies, 0), start, stop, motif)) as first, arg_min({d}, (case when {c} = 'AC' then 0 else 1 end, {d}, -coalesce(copies, 0), start, stop, motif)) as distance from {t} where chrom = 'chr5' and start < 5501 and stop > 2500"
_ONES = " union all ".join(_ONE.format(n=n, t=t, c=_canonical("motif"), d=_distance("4000", "start", "stop")) for n, t in _CATS.items())
_COVER = " union all ".join(f"select '{n}' as platform, count(*) filter (where chrom = 'chr5') > 0 as covered from {t}" for n, t in _CATS.items())
ORACLES["query_locus"] = f"""with r as (select platform, case when not covered then 3 when n = 0 then 2 when hit = 1 then 0 else 1 end as rank, n, first, distance from ({_ONES}) join ({_COVER}) using (platform))
  select platform, {_status('rank')} as novelty, n as n_nearby, first, distance from r union all select 'combined', {_status('min(rank)')}, sum(n)::bigint, null, null from r"""


@query
def axis_grid(spark, sf_dir):
    rows = []
    for t in ("0,1,10", "0:50:25", "none", "none,0.5", "0:1", "0:10:3"):
        try:
            rows.append((t, ";".join("none" if x is None else f"{x:g}" for x in screen.parse_axis(t))))
        except ValueError:
            rows.append((t, "not griddable"))
    return spark.createDataFrame(rows, "axis string, grid string")


ORACLES["axis_grid"] = "select * from (values ('0,1,10', '0;1;10'), ('0:50:25', '0;25;50'), ('none', 'none'), ('none,0.5', 'none;0.5'), ('0:1', 'not griddable'), ('0:10:3', '0;3;6;9')) t(axis, grid)"

# --- pages: orders as loci, line items as their segments -----------------------------------------------------------------


def _segments(spark, sf_dir) -> DataFrame:
    k, at = F.col("l_orderkey"), F.col("l_linenumber")
    return _t(spark, sf_dir, "lineitem").select(
        F.concat_ws(":", F.concat(F.lit("chr"), F.pmod(k, F.lit(24)) + 1), k).alias("locus_id"), F.concat(F.lit("s"), F.col("l_suppkey") % 3).alias("sample"), (F.col("l_partkey") % 2 + 1).cast("int").alias("allele"), at.alias("seg_index"),
        F.when(at % 2 == 0, "repeat").otherwise("flank").alias("seg_type"), F.col("l_quantity").cast("int").alias("end"),
    )


_SEGS = "(select 'chr' || (l_orderkey % 24 + 1) || ':' || l_orderkey as locus_id, 's' || (l_suppkey % 3) as sample, (l_partkey % 2 + 1)::int as allele, l_linenumber as seg_index, case when l_linenumber % 2 = 0 then 'repeat' else 'flank' end as seg_type, l_quantity::int as stop from lineitem)"


@query
def locus_detail(spark, sf_dir):
    row, alleles = endpoints.locus_detail(_loci(spark, sf_dir), _segments(spark, sf_dir), "chr2:1")
    return alleles.crossJoin(F.broadcast(row.select("gene"))).select("gene", "sample", "allele", "allele_len", F.array_join(F.transform("segments", lambda s: F.concat_ws(":", s["seg_index"], s["seg_type"], s["end"])), ",").alias("segments"))


@query
def cohort_summary(spark, sf_dir):
    loci = _loci(spark, sf_dir).withColumn("motif_class", F.when(F.col("motif_len") == 1, "homopolymer").otherwise("STR"))
    segs = _segments(spark, sf_dir)
    flat = lambda df, kind, name, *n: df.select(F.lit(kind).alias("kind"), name.cast("string").alias("name"), *n)
    none = F.lit(None).cast("long").alias("n_novel")
    parts = [
        flat(endpoints.cohort_size(loci, segs), "size", F.lit("segments"), F.col("cohort_size").alias("n"), none), flat(endpoints.cohort_size(loci, None), "size", F.lit("loci"), F.col("cohort_size").alias("n"), none),
        flat(endpoints.cohort_funnel(loci.withColumn("genic", F.col("gene") != "1-URGENT")), "funnel", F.col("stage"), "n", none), *[flat(endpoints.breakdown(loci, c), c, F.col("value"), "n", "n_novel") for c in ("motif_class", "chrom")],
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def sorted_loci(spark, sf_dir):
    """The first rows of each of the seven sorts."""
    loci = _loci(spark, sf_dir)
    parts = []
    for k, (name, way) in enumerate([("position", None), ("novel", None), ("size", "asc"), ("support", None), ("motif_len", "asc"), ("purity", None), ("arrays", None)]):
        r = serve.list_loci(loci, _segments(spark, sf_dir), name, way, limit=9, min_motif_len=2)
        parts.append(r["rows"].select(F.lit(r["sort"]).alias("sort"), F.lit(r["total"]).cast("long").alias("total"), "locus_id"))
    return reduce(DataFrame.unionByName, parts)


@query
def top_loci(spark, sf_dir):
    return _loci(spark, sf_dir).orderBy(F.col("n_samples").desc(), "locus_id").limit(25).select("locus_id", "n_samples")


def _curated(spark, sf_dir) -> DataFrame:
    k = F.col("s_suppkey")
    return _t(spark, sf_dir, "supplier").select(
        F.concat(F.lit("L"), k).alias("id"), F.concat(F.lit("G"), F.col("s_nationkey")).alias("gene"), F.concat(F.lit("disease "), k % 5).alias("disease"), (k % 3 == 0).alias("novel_in_reference"), F.when(k % 4 != 0, "strong").otherwise("weak").alias("evidence"),
        F.when(k % 2 == 0, "AD; AR").otherwise("XL").alias("inheritance"), F.when(k % 5 != 0, 40).alias("pathogenic_min"), F.when(k % 7 != 0, 3.0).alias("ref_copies"),
    )


_CURATED = "(select s_suppkey as k, 'L' || s_suppkey as id, 'G' || s_nationkey as gene, 'disease ' || (s_suppkey % 5) as disease, s_suppkey % 3 = 0 as novel_in_reference, case when s_suppkey % 4 <> 0 then 'strong' else 'weak' end as evidence, case when s_suppkey % 2 = 0 then 'AD; AR' else 'XL' end as inheritance from supplier)"


@query
def disease_summary(spark, sf_dir):
    c = _curated(spark, sf_dir)
    t = endpoints.disease_totals(c)
    long = t.unpivot([], t.columns, "name", "n").select(F.lit("total").alias("kind"), "name", "n")
    evidence = c.groupBy(F.col("evidence").alias("name")).agg(F.count("*").alias("n")).select(F.lit("evidence").alias("kind"), "name", "n")
    return long.unionByName(evidence).unionByName(endpoints.by_inheritance(c).select(F.lit("inheritance").alias("kind"), F.col("value").alias("name"), "n"))


@query
def disease_list(spark, sf_dir):
    rows, total = endpoints.disease_list(_curated(spark, sf_dir), evidence="strong", inheritance="AR", text="SEASE 2", limit=30)
    return rows.crossJoin(F.broadcast(total)).select("id", "gene", "novel_in_reference", "total")


def _disease_calls(spark, sf_dir) -> DataFrame:
    n = lambda x: F.lit(x).cast("double")
    loci = _catalogue(spark, sf_dir).select(
        F.concat(F.lit("L"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("id"), F.lit("G").alias("gene"), "chrom", "start", "end", F.lit(10.0).alias("ref_copies"),
        F.array(F.struct(F.lit("pathogenic").alias("class"), F.col("motif").alias("motif")), F.struct(F.lit("reference").alias("class"), F.lit("ACG").alias("motif"))).alias("motifs"),
        n(40).alias("pathogenic_min"), n(None).alias("pathogenic_max"), n(None).alias("intermediate_min"), n(None).alias("intermediate_max"), n(1).alias("benign_min"), n(39).alias("benign_max"),
    )
    calls = _points(spark, sf_dir).withColumns({"ins_coord": F.col("point") + 1, "sample": F.col("c_custkey"), "rep_units": F.pmod(F.col("c_custkey"), F.lit(60)).cast("double"), "gene": F.lit("g")})
    return disease.disease_screen(calls, loci, window=50)


_DIS_ROWS = _DISEASE[: _DISEASE.rindex("  select case when id is null")].replace("then 6 end as rank,", "then 2 else 6 end as rank,") if False else _DISEASE[: _DISEASE.rindex("select case when id is null")]
_DIS_STATUS = "case when id is null then 'no_locus_match' when rank = 6 then 'locus_novel_motif' when rank = 1 and allele_class = 'pathogenic' then 'pathogenic_expansion' when rank = 1 then 'pathogenic_motif' else 'locus_known_motif' end"


@query
def disease_matches(spark, sf_dir):
    return endpoints.disease_matches(_disease_calls(spark, sf_dir), limit=200).select("c_custkey", "status", "locus")


@query
def disease_screen_totals(spark, sf_dir):
    return endpoints.screened_totals(_disease_calls(spark, sf_dir))


@query
def disease_rows_as_text(spark, sf_dir):
    """The screen's rows as strings, blank where there is nothing."""
    out = disease.as_text(_disease_calls(spark, sf_dir).select("c_custkey", "status", "locus", "motif_class", "est_copies", "allele_class", "gene_agrees"), "v1")
    return out.select(F.col("c_custkey").cast("long").alias("c_custkey"), "status", "locus", "motif_class", "est_copies", "allele_class", "gene_agrees", "catalog")


_IN_DETAIL = f"(select 'chr' || (l_orderkey % 24 + 1) || ':' || l_orderkey as locus_id, * from (select 1))"
ORACLES["locus_detail"] = f"select o_orderpriority as gene, sample, allele, max(stop) as allele_len, string_agg(seg_index || ':' || seg_type || ':' || stop, ',' order by seg_index, seg_type, stop) as segments from {_SEGS}, orders where locus_id = 'chr2:1' and o_orderkey = 1 group by 1, 2, 3"
_CLASSED = f"(select *, case when motif_len = 1 then 'homopolymer' else 'STR' end as motif_class from {_LOCI})"
_KEPT = "motif_class <> 'homopolymer'"
ORACLES["cohort_summary"] = f"""select 'size' as kind, 'segments' as name, count(distinct sample) as n, null::bigint as n_novel from {_SEGS} union all select 'size', 'loci', max(n_samples), null from {_LOCI}
  union all select 'funnel', unnest(['loci', 'not a homopolymer', 'confident', 'novel', 'in a gene']), unnest([count(*), count(*) filter (where {_KEPT}), count(*) filter (where {_KEPT} and mean_purity >= 0.8), count(*) filter (where {_KEPT} and mean_purity >= 0.8 and novel), count(*) filter (where {_KEPT} and mean_purity >= 0.8 and novel and gene <> '1-URGENT')]), null from {_CLASSED}
  union all select 'motif_class', motif_class, count(*), count(*) filter (where novel) from {_CLASSED} group by 2 union all select 'chrom', chrom, count(*), count(*) filter (where novel) from {_LOCI} group by 2"""
_ARRAYS = f"(select locus_id, n_arrays from (select *, row_number() over (partition by locus_id order by len, sample, allele) as rn, count(*) over (partition by locus_id) as n from (select locus_id, sample, allele, max(stop) as len, count(*) filter (where seg_type = 'repeat') as n_arrays from {_SEGS} group by 1, 2, 3)) where rn = (n + 1) // 2)"
_BY = {"position": "", "novel": "novel desc nulls last, motif_len desc nulls last,", "size": "median_len asc nulls last,", "support": "n_samples desc nulls last,", "motif_len": "motif_len asc nulls last,", "purity": "mean_purity desc nulls last,", "arrays": "n_arrays desc nulls last,"}
ORACLES["sorted_loci"] = " union all ".join(f"(select '{n}' as sort, count(*) over () as total, locus_id from {_LOCI} l left join {_ARRAYS} a using (locus_id) where motif_len >= 2 order by {by} {_ORDER} asc nulls last, pos asc nulls last limit 9)" for n, by in _BY.items())
ORACLES["top_loci"] = f"select locus_id, n_samples from {_LOCI} order by n_samples desc, locus_id limit 25"
ORACLES["disease_summary"] = f"""select 'total' as kind, unnest(['n_loci', 'n_novel_in_reference', 'n_with_range', 'n_without_ref_copies']) as name, unnest([count(*), count(*) filter (where novel_in_reference), count(*) filter (where k % 5 <> 0), count(*) filter (where k % 7 = 0)]) as n from {_CURATED}
  union all select 'evidence', evidence, count(*) from {_CURATED} group by 2 union all select 'inheritance', trim(v), count(*) from (select unnest(string_split(inheritance, ';')) as v from {_CURATED}) group by 2"""
ORACLES["disease_list"] = f"select id, gene, novel_in_reference, count(*) over () as total from {_CURATED} where evidence = 'strong' and contains(inheritance, 'AR') and (contains(upper(gene), 'SEASE 2') or contains(upper(disease), 'SEASE 2') or contains(upper(id), 'SEASE 2')) order by novel_in_reference desc, gene, id limit 30"
_DIS_J = _DIS_ROWS.replace("select p.*, id, rank, n,", "select p.*, id, rank, n, distance,")
ORACLES["disease_matches"] = f"{_DIS_J} select c_custkey, {_DIS_STATUS} as status, id as locus from k where id is not null order by case {_DIS_STATUS} " + " ".join(f"when '{s}' then {n}" for n, s in enumerate(disease.STATUSES)) + " end, distance, chrom, point, c_custkey limit 200"
ORACLES["disease_screen_totals"] = f"{_DIS_J} select {_DIS_STATUS} as status, count(*) as n_rows, count(distinct (chrom, point)) as n_loci, min(distance) as nearest_hit_bp from k group by 1"
ORACLES["disease_rows_as_text"] = f"{_DIS_J} select c_custkey, {_DIS_STATUS} as status, coalesce(id, '') as locus, case when rank = 1 then 'pathogenic' when rank = 2 then 'reference' else 'none' end as motif_class, coalesce(copies::bigint::varchar, '') as est_copies, allele_class, case when id is not null then 'true' else '' end as gene_agrees, 'v1' as catalog from k"


@query
def loci_without_catalogues(spark, sf_dir):
    """The build where a catalogue is missing: its columns are there, as nulls."""
    calls = _calls(spark, sf_dir).drop("ucsc_novelty", "trexplorer_novelty", "ucsc_n_nearby")
    built = endpoints.with_missing(rollup.build_loci(calls, ()), {"ucsc_novelty": "string", "ucsc_n_nearby": "int", "strchive_id": "string"})
    return built.select("locus_id", "novelty", "catalogs", "ucsc_novelty", "ucsc_n_nearby", "strchive_id", "n_alleles")


@query
def segments_numbered(spark, sf_dir):
    """Alleles of a sample numbered by falling length, each with its parts."""
    calls = _calls(spark, sf_dir).withColumns({"rep_start": (F.col("depth") % 3).cast("int"), "rep_end": (F.col("depth") % 3 + 4).cast("int"), "insert_size": F.lit(6) + F.col("insert_size") % 2})
    s = rollup.build_segments(calls)
    return s.groupBy("allele", "seg_index", "seg_type").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).cast("long").alias("bases"))


@query
def structures_sorted(spark, sf_dir):
    segs = _segments(spark, sf_dir).withColumns({"motif": F.lit("AC"), "units": F.lit(2.0)})
    a = rollup.architecture(segs, ["locus_id", "sample", "allele"]).withColumn("all", F.lit(1))
    return endpoints.structures(rollup.group_structures(a, "all", "sample")).limit(40).select("architecture", "carriers", "min_len", "max_len")


ORACLES["loci_without_catalogues"] = f"select 'chr1:' || ins_coord as locus_id, {_status('min(case novelty ' + ' '.join(f'when {chr(39)}{v}{chr(39)} then {k}' for k, v in enumerate(V)) + ' end)')} as novelty, null::varchar as catalogs, null::varchar as ucsc_novelty, null::int as ucsc_n_nearby, null::varchar as strchive_id, count(distinct svid) as n_alleles from {_CALLS} group by ins_coord"
ORACLES["segments_numbered"] = f"""with c as (select distinct l_partkey as site, l_orderkey as sample, l_suppkey::varchar as svid, 6 + l_suppkey % 2 as size, l_linenumber % 3 as s, l_linenumber % 3 + 4 as e, {_sql_dna('l_suppkey', 4)} as motif, l_extendedprice / 7e5 as purity, l_quantity as units from lineitem),
  a as (select *, row_number() over (partition by site, sample order by size desc, svid, s, e, motif, purity, units)::int as allele from c),
  p as (select allele, 0 as i, 'flank' as seg_type, s as bases from a where s > 0 union all select allele, (s > 0)::int, 'repeat', 4 from a union all select allele, (s > 0)::int + 1, 'flank', size - e from a where size > e)
  select allele, i::int as seg_index, seg_type, count(*) as n, sum(bases)::bigint as bases from p group by 1, 2, 3"""
ORACLES["structures_sorted"] = f"""with t as (select locus_id, sample, allele, regexp_replace(string_agg(case when seg_type = 'repeat' then 'AC×2' else '-' end, '|' order by seg_index, seg_type = 'repeat'), '^(?:-\\|)+|(?:\\|-)+$', '', 'g') as architecture, max(stop) as len from {_SEGS} group by 1, 2, 3)
  select architecture, count(distinct sample) as carriers, min(len) as min_len, max(len) as max_len from t group by 1 order by 4 desc, 2 desc, 1 limit 40"""

# --- search --------------------------------------------------------------------------------------------------------------


@query
def phenotype_genes(spark, sf_dir):
    """Text's vector to terms to genes: ids that are misshapen, unknown or obsolete are left out, neighbours are added."""
    v = _t(spark, sf_dir, "embeddings")
    shape = F.when(F.col("vec_id") % 11 == 0, F.concat(F.lit("X"), "vec_id")).otherwise(F.concat(F.lit("HP:"), F.lpad(F.col("vec_id").cast("string"), 7, "0")))
    index = v.select(shape.alias("id"), F.col("embedding").alias("vector"))
    first = v.groupBy().agg(F.min_by("embedding", "vec_id").alias("q"))
    number = F.substring("id", 4, 7).cast("int")
    terms = index.filter("startswith(id, 'HP:')").select("id", (number % 7 == 0).alias("obsolete")).filter(number % 5 != 0)
    edges = terms.select(F.col("id").alias("child"), F.concat(F.lit("HP:"), F.lpad((number + 1).cast("string"), 7, "0")).alias("parent"))
    genes = terms.select(F.col("id").alias("hpo_id"), F.when(number % 3 == 0, "-").otherwise(F.concat(F.lit("G"), number % 40)).alias("gene_symbol"))
    return search.phenotype_genes(index, first, terms, edges, genes, k=60, threshold=0.1)


_HP = "'HP:' || lpad(({0})::varchar, 7, '0')"
ORACLES["phenotype_genes"] = f"""with q as (select embedding as e from embeddings order by vec_id limit 1), s as (select vec_id, case when vec_id % 11 = 0 then 'X' || vec_id else {_HP.format('vec_id')} end as id, list_sum(list_transform(list_zip(embedding, (select e from q)), lambda x: x[1]::double * x[2]::double)) as s from embeddings),
  k as (select * from s order by s desc, id limit 60), term as (select vec_id, {_HP.format('vec_id')} as id, vec_id % 7 = 0 as obsolete from embeddings where vec_id % 11 <> 0 and vec_id % 5 <> 0),
  ok as (select t.* from k join term t on t.id = k.id where s >= 0.1 and not obsolete),
  near as (select id from ok union select {_HP.format('vec_id + 1')} from ok union select t.id from term t join ok on t.vec_id + 1 = ok.vec_id)
  select distinct 'G' || (vec_id % 40) as gene_symbol from term where vec_id % 3 <> 0 and id in (select id from near)"""


@query
def citations_cleaned(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(" [1, 2] was seen (PMID: 7) ; and  more [@x2; @y] .")).alias("t"))
    return p.select("p_partkey", display.clean_prose(F.col("t")).alias("prose"), display.snippet(F.concat(F.col("p_partkey"), F.lit(". One sentence. "), F.repeat(F.lit("long "), 80))).alias("snippet"))


@query
def papers(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    k = F.col("p_partkey")
    rec = p.select(
        F.when(k % 2 == 0, k.cast("string")).alias("pmid"), F.concat(F.lit("PPR"), k).alias("id"), F.concat("p_name", F.lit(".")).alias("title"), F.array_join(F.transform(F.sequence(F.lit(1), (k % 5 + 1).cast("int")), lambda i: F.concat(F.lit("A"), i)), ", ").alias("authorString"),
        F.struct(F.struct(F.when(k % 3 == 0, "J").alias("title")).alias("journal")).alias("journalInfo"), F.lit("Flat").alias("journalTitle"), F.when(k % 4 == 0, "x").otherwise("2020").alias("pubYear"), F.when(k % 3 == 1, k).alias("citedByCount"), F.lit("Short.").alias("abstractText"),
    )
    return display.paper(rec)


@query
def reference_hits(spark, sf_dir):
    p = _points(spark, sf_dir)
    for n, c in _reference(spark, sf_dir).items():
        p = screen.screen(p, c, f"{n}_", window=25)
    return display.reference_hits(p, ["ucsc", "trexplorer"]).select("c_custkey", F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h["platform"], h["span"])), ",").alias("hits"))


ORACLES["citations_cleaned"] = "select p_partkey, p_name || ' was seen; and more.' as prose, p_partkey || '. One sentence.' as snippet from part"
ORACLES["papers"] = """select case when p_partkey % 2 = 0 then p_partkey::varchar else 'PPR' || p_partkey end as id, p_name as title, array_to_string(list_transform(range(1, least(p_partkey % 5 + 1, 3) + 1), lambda i: 'A' || i), ', ') || case when p_partkey % 5 + 1 > 3 then ' +' || (p_partkey % 5 - 2) else '' end as authors,
  case when p_partkey % 3 = 0 then 'J' else 'Flat' end as journal, case when p_partkey % 4 <> 0 then 2020 end::int as year, case when p_partkey % 3 = 1 then p_partkey else 0 end::int as cited, 'Short.' as snippet from part"""
ORACLES["reference_hits"] = f"select p.c_custkey, array_to_string(list_filter([case when a.rank in (0, 1) then 'ucsc:500' end, case when b.rank in (0, 1) then 'trexplorer:300' end], lambda x: x is not null), ',') as hits from {_POINTS} p join {_rank('ucsc', 25)} a on a.c_custkey = p.c_custkey join {_rank('trexplorer', 25)} b on b.c_custkey = p.c_custkey"

# --- fields and reports ----------------------------------------------------------------------------------------------------


@query
def annotated_fields(spark, sf_dir):
    p, k = _t(spark, sf_dir, "part"), F.col("p_partkey")
    site = F.when(k % 4 == 0, F.concat(F.lit("intron"), k % 30, F.lit("-intron"), k % 30)).when(k % 4 == 1, F.concat(F.lit("exon"), k % 9, F.lit("-exon"), k % 9 + 1)).when(k % 4 == 2, F.concat(F.lit("exon"), k % 9, F.lit("-exon"), k % 9)).otherwise("txStart-txEnd")
    genic = F.when(k % 5 != 0, k % 2 == 0)
    return p.select(
        "p_partkey", text.located(site)["feature"].alias("feature"), text.located(site)["index"].alias("place"), text.is_intronic(genic, k % 6 == 0).alias("intronic"), text.band_label(F.concat(F.lit("chr"), k % 22), F.concat(F.lit("p"), k % 30)).alias("band"),
        text.gene_text(F.array_join(F.array_repeat("p_brand", 3), ", "), k % 3 + 1).alias("gene"), text.support(F.bin(k))["callers"].alias("callers"), text.support(F.bin(k))["agreeing"].alias("agreeing"), text.query_value(F.concat(F.lit('"a\\ '), "p_brand", F.lit('  "'))).alias("asked"),
    )


@query
def formatted_fields(spark, sf_dir):
    p, k = _t(spark, sf_dir, "part"), F.col("p_partkey")
    lo, hi = coords.window_around(k, 500)
    return p.select("p_partkey", text.format_bp(k * 613).alias("span"), text.preview(F.concat(F.repeat(F.lit("AC"), 12), k)).alias("preview"), lo.alias("low"), hi.alias("high"), F.concat_ws(",", *[F.lit(text.slug(x)) for x in ("My Data (v2).tsv", "!!")]).alias("slugs"))


@query
def side_by_side(spark, sf_dir):
    """Rows joined by their place in two orders."""
    a, b = _t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), _t(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    return report.side_by_side(a, b, [F.col("c_acctbal").desc(), F.col("c_custkey")], [F.col("s_acctbal"), F.col("s_suppkey")]).select("c_custkey", "s_suppkey")


@query
def newest_first(spark, sf_dir):
    return endpoints.newest_first(_t(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey").limit(50)


@query
def kernel_density(spark, sf_dir):
    return report.density(_t(spark, sf_dir, "part"), "p_size", 0, 60, 31, width=3.0).select(F.col("k").cast("int").alias("k"), F.round("density", 6).alias("density"))


@query
def explicit_edges(spark, sf_dir):
    return report.edge_bins(_t(spark, sf_dir, "lineitem").withColumn("len", F.col("l_quantity") * 9), "len", [7, 10, 15, 20, 30, 50, 100, 200, 400])


@query
def stacked_medians(spark, sf_dir):
    return display.stacked_histogram(_t(spark, sf_dir, "part"), "p_size", "p_type", display.nice_step(49, 12), medians=True)


@query
def ancestry_qc(spark, sf_dir):
    """How many samples are known, called, and both; and per group how raw insertions compare with those that hold a repeat."""
    s = _t(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("sample"), F.col("c_mktsegment").alias("superpop"))
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sample"), "o_orderpriority", "o_totalprice")
    return cohort.ancestry_qc(o.groupBy("sample").agg(F.count("*").alias("n_insertions_raw")), o.filter("o_totalprice > 50000").select("sample", F.col("o_orderpriority").alias("SVID")), s)


@query
def synthetic_calls(spark, sf_dir):
    """Made-up calls, by seed: the same on every run and every cluster."""
    return synthetic.calls(spark, 2000, seed=7)


@query
def value_lookup(spark, sf_dir):
    """A value looked up in an aggregate of another table."""
    n = _t(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.max("l_quantity").alias("largest"))
    return _t(spark, sf_dir, "part").join(n, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.coalesce("largest", F.lit(0.0)).alias("largest"))


ORACLES["annotated_fields"] = """select p_partkey, case p_partkey % 4 when 0 then 'intron' when 2 then 'exon' end as feature, case p_partkey % 4 when 0 then p_partkey % 30 when 2 then p_partkey % 9 end::int as place, coalesce(p_partkey % 5 <> 0 and p_partkey % 2 = 0, false) and p_partkey % 6 <> 0 as intronic,
  (p_partkey % 22) || 'p' || (p_partkey % 30) as band, case when p_partkey % 3 = 0 then p_brand end as gene, length(bin(p_partkey))::int as callers, (length(bin(p_partkey)) - length(replace(bin(p_partkey), '1', '')))::int as agreeing, 'a ' || p_brand as asked from part"""
ORACLES["formatted_fields"] = """select p_partkey, case when n >= 1000000 then ((n + 5000) // 1000000) || '.' || lpad(((n + 5000) // 10000 % 100)::varchar, 2, '0') || ' Mb' when n >= 1000 then ((n + 50) // 1000) || '.' || ((n + 50) // 100 % 10) || ' kb' else n || ' bp' end as span,
  substr(s, 1, 12) || '...' || right(s, 6) as preview, greatest(1, p_partkey - 500) as low, p_partkey + 500 as high, 'my_data_v2_tsv,dataset' as slugs from (select p_partkey, p_partkey * 613 as n, repeat('AC', 12) || p_partkey as s from part)"""
ORACLES["side_by_side"] = "with a as (select c_custkey, row_number() over (order by c_acctbal desc, c_custkey) as i from customer), b as (select s_suppkey, row_number() over (order by s_acctbal, s_suppkey) as i from supplier) select c_custkey, s_suppkey from a full join b on a.i = b.i"
ORACLES["newest_first"] = "select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey limit 50"
ORACLES["kernel_density"] = "select k::int as k, round(sum(exp(-0.5 * ((2.0 * k - p_size) / 3.0) * ((2.0 * k - p_size) / 3.0))) / (count(*) * 3.0 * sqrt(2 * pi())), 6) as density from part, (select unnest(range(0, 31)) as k) group by 1"
ORACLES["explicit_edges"] = "select case when x >= 400 then 8 when x >= 200 then 7 when x >= 100 then 6 when x >= 50 then 5 when x >= 30 then 4 when x >= 20 then 3 when x >= 15 then 2 when x >= 10 then 1 else 0 end::int as bin, count(*) as n from (select l_quantity * 9 as x from lineitem) where x >= 7 group by 1"
ORACLES["stacked_medians"] = 'select (floor(p_size / 5.0) * 5.0)::double as "from", p.p_type, count(*) as n, any_value(m) as median from part p join (select p_type, median(p_size)::double as m from part group by 1) q on p.p_type = q.p_type group by 1, 2'
ORACLES["ancestry_qc"] = """with s as (select c_custkey as s, c_mktsegment as g from customer where c_acctbal > 0), r as (select o_custkey as s, count(*) as n from orders group by 1), t as (select o_custkey as s, count(distinct o_orderpriority) as n from orders where o_totalprice > 50000 group by 1)
  select g as superpop, count(*) as n_known, count(r.n) as n_called, count(t.n) as n_with_repeat, coalesce(sum(r.n), 0)::bigint as raw, coalesce(sum(t.n), 0)::bigint as with_repeat from s left join r on r.s = s.s left join t on t.s = s.s group by 1
  union all select null, 0, count(*), 0, sum(n)::bigint, 0 from r where s not in (select s from s)"""
ORACLES["value_lookup"] = "select p_partkey, coalesce(q, 0.0) as largest from part left join (select l_partkey, max(l_quantity) as q from lineitem group by 1) on l_partkey = p_partkey"
ORACLES["synthetic_calls"] = synthetic.calls_sql(2000, 7)
_ = (_BOTH, _UNION, _IN_DETAIL)
