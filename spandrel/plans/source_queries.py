"""Readers and sinks over files written from the driver's tables: what comes back must be what SQL says of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.motifs import longest_pure_segment
from ..functions.text import first_live, positions
from ..operators import search, serve
from ..sources import catalogs, manifests, platforms, tables, vcf
from ..sources.shared import scratch
from .oracles import _RC, _dna as _sql_dna
from .queries import _dna, _t, query

ORACLES: dict[str, str] = {}


def _text(df: DataFrame, name: str, **options) -> str:
    path = scratch(df.sparkSession, name)
    df.select("value").write.options(**options).text(path)
    return path


def _row(*cells):
    return F.concat_ws("\t", *cells).alias("value")


def _const(df: DataFrame, *values: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(v,) for v in values], "value string")


def _values(names: str, rows: list[tuple]) -> str:
    shown = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"
    return f"select * from (values {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) t({names})"


# --- catalogues: suppliers as reference repeats --------------------------------------------------------------------

class _Key:
    """A column that is made when it is used, as columns need a session."""

    def __init__(self, name: str):
        self.name = name

    def __call__(self):
        return F.col(self.name)

    def __mod__(self, other):
        return self() % other

    def __add__(self, other):
        return self() + other


K, O, L = _Key("s_suppkey"), _Key("o_orderkey"), _Key("l_orderkey")  # noqa: E741


def _repeats(spark, sf_dir, names: list[str] | None = None) -> DataFrame:
    """Lines of a simpleRepeat dump in the given order of columns; every 13th has no usable start, and contigs come with and without chr."""
    start = F.floor("s_acctbal").cast("long") + 2000
    cell = {
        "bin": F.lit(585), "chrom": F.when(K % 2 == 0, F.concat(F.lit("chr"), "s_nationkey")).otherwise(F.col("s_nationkey").cast("string")), "chromStart": F.when(K % 13 == 5, "x").otherwise(start.cast("string")),
        "chromEnd": start + 20 + K % 30, "name": F.lit("trf"), "period": K % 6 + 1, "copyNum": F.format_string("%.1f", (K % 50) / 10 + 2), "consensusSize": K % 6 + 1, "perMatch": 80 + K % 20, "perIndel": K % 5,
        "score": F.lit(50), "A": F.lit(25), "C": F.lit(25), "G": F.lit(25), "T": F.lit(25), "entropy": F.lit("1.5"), "sequence": F.lower(_dna(K())),
    }
    return _t(spark, sf_dir, "supplier").select(_row(*[cell[n] for n in names or catalogs.SIMPLE_REPEAT]))


_START = "floor(s_acctbal)::bigint + 2000"
_REPEATS = f"""select 'chr' || s_nationkey as chrom, {_START} as start, {_START} + 20 + s_suppkey % 30 as "end", {_sql_dna('s_suppkey')} as motif"""
_MEASURES = "(s_suppkey % 6 + 1)::int as period, round(s_suppkey % 50 / 10 + 2, 2) as copy_num, (s_suppkey % 6 + 1)::int as consensus_size, (80 + s_suppkey % 20)::int as per_match, (s_suppkey % 5)::int as per_indel"
_READ = f"{_REPEATS}, {_MEASURES} from supplier where s_suppkey % 13 <> 5"


@query
def src_simplerepeat(spark, sf_dir):
    return catalogs.read_catalog(spark, _text(_repeats(spark, sf_dir), "simplerepeat"))


@query
def src_simplerepeat_gzip(spark, sf_dir):
    """With a header that orders the columns anew, and packed."""
    names = [*reversed(catalogs.SIMPLE_REPEAT)]
    body = _repeats(spark, sf_dir, names)
    path = _text(body.unionByName(_const(body, "#" + "\t".join(names))), "simplerepeat-gz", compression="gzip")
    return catalogs.read_catalog(spark, path).select("chrom", "start", "end", "motif", "period", "copy_num", "consensus_size", "per_match", "per_indel")


ORACLES |= {"src_simplerepeat": _READ, "src_simplerepeat_gzip": _READ}


def _bed(spark, sf_dir) -> DataFrame:
    start = F.floor("s_acctbal").cast("long") + 2000
    body = _t(spark, sf_dir, "supplier").select(_row(F.concat(F.lit(" chr"), "s_nationkey"), start, start + 20 + K % 30, F.lower(_dna(K())), F.lit("more"), K()))
    return body.unionByName(_const(body, "# a comment", ""))


@query
def src_bed(spark, sf_dir):
    return catalogs.read_catalog(spark, _text(_bed(spark, sf_dir), "bed"))


def _trgt(spark, sf_dir) -> DataFrame:
    start = F.floor("s_acctbal").cast("long") + 2000
    about = F.concat(F.lit("ID=L"), K(), F.lit(";MOTIFS="), _dna(K()), F.when(K % 3 == 0, F.concat(F.lit(","), _dna(K + 1))).otherwise(""), F.lit(";STRUC=(x)n"))
    return _t(spark, sf_dir, "supplier").select(_row(F.concat(F.lit("chr"), "s_nationkey"), start, start + 20 + K % 30, about))


@query
def src_trgt(spark, sf_dir):
    return catalogs.read_catalog(spark, _text(_trgt(spark, sf_dir), "trgt"))


ORACLES["src_bed"] = f"{_REPEATS} from supplier"
ORACLES["src_trgt"] = f"{_REPEATS} from supplier union all {_REPEATS.replace(_sql_dna('s_suppkey'), _sql_dna('s_suppkey + 1'))} from supplier where s_suppkey % 3 = 0"


@query
def src_sniff(spark, sf_dir):
    made = {"dump": _repeats(spark, sf_dir), "bed": _bed(spark, sf_dir), "trgt": _trgt(spark, sf_dir)}
    return spark.createDataFrame([(n, catalogs.sniff(spark, _text(df, "sniff"))) for n, df in made.items()], "file string, format string")


@query
def src_platforms(spark, sf_dir):
    return platforms.listing(spark)


@query
def src_catalogue_cache(spark, sf_dir):
    """Read twice: the second time the canonical form is found ready."""
    path = _text(_bed(spark, sf_dir), "cached")
    first, was = platforms.cached(spark, "bed", path)
    again, now = platforms.cached(spark, "bed", path)
    return again.groupBy("chrom").agg(F.count("*").alias("n"), F.countDistinct("canonical").alias("n_canonical"), F.lit(was).alias("first_ready"), F.lit(now).alias("then_ready"))


ORACLES["src_sniff"] = _values("file, format", [("dump", "simplerepeat"), ("bed", "bed"), ("trgt", "trgt")])
ORACLES["src_platforms"] = _values("name, format, assemblies, role", [("ucsc", "simplerepeat", "any", "screening"), ("trexplorer", "bed", "hg38", "screening"), ("pathogenic", "trgt", "hg38", "annotation only"), ("bed", "bed", "any", "screening")])

# --- VCF text: orders as records of three samples --------------------------------------------------------------------

SAMPLES = ["s1", "s2", "s3"]
HEADER = [
    "##fileformat=VCFv4.2", '##INFO=<ID=SVTYPE,Number=1,Type=String,Description="Type, of variant">', '##INFO=<ID=SVLEN,Number=1,Type=Integer,Description="Length">', '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
    '##FORMAT=<ID=ID,Number=1,Type=String,Description="Alleles">', "##contig=<ID=chr1,length=248956422>", "##contig=<ID=chr2>", "#" + "\t".join([*vcf.FIXED, "FORMAT", *SAMPLES]),
]


def _gt(k: int):
    return F.element_at(F.array(*[F.lit(g) for g in ("0/0", "0/1", "1|1", "./.")]), (F.pmod(O + k, F.lit(4)) + 1).cast("int"))


def _callset(spark, sf_dir) -> str:
    """Insertions and a few deletions; each sample has a genotype, its own allele and where it was placed. Every 17th line is cut short."""
    ref, alt = F.lit("A"), F.when(O % 5 == 0, "<DEL>").otherwise(F.concat(F.lit("A"), F.repeat(_dna(O(), 4), (O % 7 + 1).cast("int"))))
    kind = F.when(O % 5 == 0, "DEL").otherwise("INS")
    info = F.concat(F.lit("SVTYPE="), kind, F.lit(";SVLEN="), F.length(alt) - 1, F.when(O % 2 == 0, ";PRECISE").otherwise(""))
    cell = lambda k: F.concat_ws(":", _gt(k), F.when(O % 3 == k, alt).otherwise(F.concat(alt, F.lit("C"))), F.concat(F.lit("chr1_"), O + k, F.lit("-chr1_"), O + k + 9))
    full = _row(F.concat(F.lit("chr"), O % 2 + 1), O(), F.concat(F.lit("sv"), O()), ref, alt, F.lit("."), F.when(O % 4 == 0, "LOW").otherwise("PASS"), info, F.lit("GT:ALLELE:CO"), cell(0), cell(1), cell(2))
    body = _t(spark, sf_dir, "orders").select(F.when(O % 17 == 0, _row(F.lit("chr1"), O())).otherwise(full).alias("value"))
    return _text(body.unionByName(_const(body, *HEADER)), "vcf")


_ALT = f"case when o_orderkey % 5 = 0 then '<DEL>' else 'A' || repeat({_sql_dna('o_orderkey', 4)}, (o_orderkey % 7 + 1)::int) end"
_REC = f"(select o_orderkey as pos, 'chr' || (o_orderkey % 2 + 1) as chrom, {_ALT} as alt, case when o_orderkey % 5 = 0 then 'DEL' else 'INS' end as kind, o_orderkey % 2 = 0 as precise, case when o_orderkey % 4 = 0 then 'LOW' else 'PASS' end as filter from orders where o_orderkey % 17 <> 0)"
_GT = "(array['0/0', '0/1', '1|1', './.'])[((pos + k) % 4 + 1)::int]"
_SAMPLE = f"(select *, 's' || (k + 1) as sample, {_GT} as gt, case when pos % 3 = k then alt else alt || 'C' end as own from {_REC}, (select unnest([0, 1, 2]) as k))"


@query
def src_vcf_header(spark, sf_dir):
    h = vcf.read_header(spark, _callset(spark, sf_dir))
    rows = [("assembly", vcf.assembly(h) or "", ""), *[("info", k, v["Description"]) for k, v in h.info.items()], *[("format", k, v["Description"]) for k, v in h.format.items()]]
    rows += [("contig", k, str(v or "")) for k, v in h.contigs.items()] + [("sample", s, "") for s in h.samples] + [("meta", k, v) for k, v in h.meta]
    return spark.createDataFrame(rows, "kind string, name string, detail string")


ORACLES["src_vcf_header"] = _values("kind, name, detail", [
    ("assembly", "GRCh38", ""), ("info", "SVTYPE", "Type, of variant"), ("info", "SVLEN", "Length"), ("format", "GT", "Genotype"), ("format", "ID", "Alleles"), ("contig", "chr1", "248956422"), ("contig", "chr2", ""),
    ("sample", "s1", ""), ("sample", "s2", ""), ("sample", "s3", ""), ("meta", "fileformat", "VCFv4.2"),
])


@query
def src_vcf_records(spark, sf_dir):
    return vcf.records(spark, _callset(spark, sf_dir)).select(F.col("CHROM").alias("chrom"), F.col("POS").alias("pos"), F.col("ALT").alias("alt"), F.col("FILTER").alias("filter"), F.size("cells").alias("n_cells"))


@query
def src_vcf_samples(spark, sf_dir):
    long = vcf.long_form(vcf.records(spark, _callset(spark, sf_dir)), SAMPLES)
    return long.select(F.col("POS").alias("pos"), "sample", F.col("fields")["GT"].alias("gt"), F.col("fields")["ALLELE"].alias("allele"), vcf.is_called(F.col("fields")["GT"]).alias("called"), F.element_at(positions(F.col("fields")["CO"]), 1).alias("placed"))


@query
def src_vcf_insertions(spark, sf_dir):
    return vcf.insertions(vcf.records(spark, _callset(spark, sf_dir)), 3, 12).select(F.col("POS").alias("pos"), "sequence", F.col("info")["SVLEN"].cast("long").alias("svlen"))


@query
def src_vcf_raw_counts(spark, sf_dir):
    return vcf.raw_insertions_per_sample(vcf.records(spark, _callset(spark, sf_dir)), SAMPLES)


@query
def src_vcf_rewritten(spark, sf_dir):
    """INS as DUP, a field added, written and read again."""
    df = vcf.with_info(vcf.svtype_as_dup(vcf.records(spark, _callset(spark, sf_dir))), "RATIO", F.col("POS") % 3)
    back = vcf.records(spark, _text(vcf.as_lines(df), "rewritten"))
    return back.select(F.col("POS").alias("pos"), F.col("ALT").alias("alt"), F.col("INFO").alias("info"), F.size("cells").alias("n_cells"))


@query
def src_vcf_counters(spark, sf_dir):
    return vcf.counters(vcf.records(spark, _callset(spark, sf_dir)))


@query
def src_vcf_fields(spark, sf_dir):
    long = vcf.long_form(vcf.records(spark, _callset(spark, sf_dir)), SAMPLES)
    return vcf.field_profile(long).select("field", "seen", "missing", "nucleotide", "numeric", "coordinate", "multi", "max_length")


@query
def src_vcf_disagreements(spark, sf_dir):
    long = vcf.long_form(vcf.records(spark, _callset(spark, sf_dir)), SAMPLES)
    return vcf.disagreements(long, "ALLELE", "CO").select(F.col("POS").alias("pos"), "n_alleles", "n_alt_differs", "n_anchor_differs", F.col("max_offset").cast("long").alias("max_offset"))


@query
def src_vcf_profile(spark, sf_dir):
    """The dialect profile: roles learnt from the first records, then what the callset says under them."""
    p = vcf.scan(spark, _callset(spark, sf_dir))
    rows = [("samples", str(p["samples"])), ("assembly", p["assembly"]), *[(f"role {k}", v) for k, v in p["roles"].items()], *[(f"sites {k}", str(v)) for k, v in p["disagreements"].items()]]
    return spark.createDataFrame(rows, "fact string, value string")


@query
def src_vcf_readings(spark, sf_dir):
    """Records and samples read side by side, under the roles that the callset's own values tell; the first two examples of each kind."""
    long = vcf.long_form(vcf.records(spark, _callset(spark, sf_dir)), SAMPLES)
    out = vcf.readings(long, vcf.roles(vcf.field_profile(long)), examples=2)
    shown = F.transform("examples", lambda r: F.concat_ws(" ", r["ID"], F.concat_ws(",", F.transform(r["samples"], lambda x: F.concat_ws(":", x["sample"], x["allele"], x["offset"].cast("string"))))))
    return out.select("kind", "alt", "n_records", F.col("n_samples").cast("long").alias("n_samples"), F.array_join(shown, ";").alias("examples"))


@query
def src_vcf_longest_segments(spark, sf_dir):
    """Samples in long form, their two alleles, the longest pure segment of either, written as a table and read again."""
    rec = vcf.records(spark, _callset(spark, sf_dir)).filter("ALT <> '<DEL>'")
    long = vcf.long_form(rec, SAMPLES).withColumn("gt", vcf.haplotypes(F.col("fields")["GT"]))
    own = first_live(F.col("fields")["ALLELE"])
    both = long.withColumns({f"a{k}": vcf.resolved_allele(F.get("gt", F.lit(k)), F.col("REF"), F.col("ALT"), own) for k in (0, 1)})
    out = vcf.longest_pure_segments(both, ("a0", "a1")).select(F.col("POS").alias("pos"), "sample", "lps_allele1", "lps_allele2", "lps", "lps_motif")
    path = scratch(spark, "lps")
    tables.write_tsv(out, path)
    back = tables.nulled(tables.read_tsv(spark, path))
    return back.select(F.col("pos").cast("long").alias("pos"), "sample", F.col("lps").cast("int").alias("lps"), "lps_motif")


def _runs(seq: str, most: int = 12) -> str:
    """The pure repeat of a sequence that covers most bases: shortest period, then earliest."""
    return f"""(select struct_pack(motif := substr(q, i::int, p::int), copies := c::int) from (select q, p, i, list_max(list_filter(range(1, length(q) // p + 1), lambda c: substr(q, i::int, (p * c)::int) = repeat(substr(q, i::int, p::int), c::int))) as c
      from (select {seq} as q), (select unnest(range(1, {most + 1})) as p), (select unnest(range(1, 200)) as i) where p < length(q) and i <= length(q)) where c > 1 order by p * c desc, p, i limit 1)"""


_SVLEN = "length(alt) - 1"
ORACLES["src_vcf_records"] = f"select chrom, pos, alt, filter, 3::int as n_cells from {_REC}"
ORACLES["src_vcf_samples"] = f"select pos, sample, gt, own as allele, gt in ('0/1', '1|1') as called, pos + k as placed from {_SAMPLE}"
ORACLES["src_vcf_insertions"] = f"select pos, substr(alt, 2) as sequence, {_SVLEN} as svlen from {_REC} where kind = 'INS' and {_SVLEN} between 3 and 12"
ORACLES["src_vcf_raw_counts"] = f"select sample, count(*) filter (where gt in ('0/1', '1|1')) as n_insertions_raw from {_SAMPLE} group by 1"
ORACLES["src_vcf_rewritten"] = f"select pos, alt, 'SVTYPE=' || case when kind = 'INS' then 'DUP;ORIG_SVTYPE=INS' else kind end || ';SVLEN=' || ({_SVLEN}) || case when precise then ';PRECISE' else '' end || ';RATIO=' || (pos % 3) as info, 3::int as n_cells from {_REC}"
ORACLES["src_vcf_counters"] = f"""select 'svtype' as kind, kind as value, count(*) as n from {_REC} group by 2 union all select 'filter', filter, count(*) from {_REC} group by 2
  union all select 'alt', case when alt = '<DEL>' then 'symbolic' else 'literal' end, count(*) from {_REC} group by 2 union all select 'info', v, count(*) from (select unnest(case when precise then ['SVTYPE', 'SVLEN', 'PRECISE'] else ['SVTYPE', 'SVLEN'] end) as v from {_REC}) group by 2"""
_DNA = "regexp_full_match(own, '(?i)[ACGTN]{2,}')"
ORACLES["src_vcf_fields"] = f"""with s as (select gt, own, 'chr1_' || (pos + k) || '-chr1_' || (pos + k + 9) as co from {_SAMPLE})
  select 'GT' as field, count(*) as seen, count(*) filter (where gt = './.') as missing, 0::bigint as nucleotide, 0::bigint as numeric, 0::bigint as coordinate, 0::bigint as multi, max(length(gt)) filter (where gt <> './.')::int as max_length from s
  union all select 'ALLELE', count(*), 0, count(*) filter (where {_DNA}), 0, 0, 0, max(length(own))::int from s union all select 'CO', count(*), 0, 0, 0, count(*), 0, max(length(co))::int from s"""
_DIS = f"select pos, count(distinct upper(own)) as n_alleles, count(*) filter (where upper(own) <> upper(alt)) as n_alt_differs, count(*) filter (where upper(own[1]) <> 'A') as n_anchor_differs, max(k)::bigint as max_offset from {_SAMPLE} group by 1"
ORACLES["src_vcf_disagreements"] = _DIS
ORACLES["src_vcf_profile"] = f"""with d as ({_DIS}) select * from (values ('samples', '3'), ('assembly', 'GRCh38'), ('role sequence', 'ALLELE'), ('role coordinate', 'CO'), ('role genotype', 'GT')) t(fact, value)
  union all select 'sites records', count(*)::varchar from d union all select 'sites several_alleles', count(*) filter (where n_alleles > 1)::varchar from d union all select 'sites alt_differs', sum(n_alt_differs)::bigint::varchar from d union all select 'sites max_offset', max(max_offset)::varchar from d"""
_CALLED = f"(select * from {_SAMPLE} where gt in ('0/1', '1|1'))"
ORACLES["src_vcf_readings"] = f"""with r as (select pos, ref, alt, list({{'s': sample, 'a': upper(own), 'o': k}} order by sample) as s from (select c.*, 'A' as ref from {_CALLED} c) group by 1, 2, 3),
  k as (select *, unnest(list_filter(['compared', case when len(list_distinct(list_transform(s, lambda x: x.a))) > 1 then 'several_alleles' end, case when not list_contains(list_transform(s, lambda x: x.a), upper(alt)) then 'no_sample_has_alt' end,
    case when len(list_filter(s, lambda x: x.a[1] <> ref)) > 0 then 'anchor_differs' end, case when len(list_filter(s, lambda x: x.o > 0)) > 0 then 'shifted' end], lambda x: x is not null)) as kind, case when alt = '<DEL>' then 'symbolic' else 'literal' end as form from r),
  n as (select *, row_number() over (partition by kind, form order by 'chr' || (pos % 2 + 1), pos) as rn from k)
  select kind, form as alt, count(*) as n_records, sum(len(s))::bigint as n_samples, string_agg('sv' || pos || ' ' || array_to_string(list_transform(s, lambda x: x.s || ':' || x.a || ':' || x.o), ','), ';' order by rn) filter (where rn <= 2) as examples from n group by 1, 2"""
_LPS = f"""with s as (select pos, sample, case substr(gt, 1, 1) when '.' then null when '0' then 'A' else own end as a, case substr(gt, 3, 1) when '.' then null when '0' then 'A' else own end as b from {_SAMPLE} where alt <> '<DEL>'),
  r as (select distinct x, {_runs('x')} as r from (select a as x from s union select b from s) where x is not null),
  j as (select pos, sample, coalesce(length(ra.r.motif) * ra.r.copies, 0) as la, coalesce(length(rb.r.motif) * rb.r.copies, 0) as lb, coalesce(ra.r.motif, '') as ma, coalesce(rb.r.motif, '') as mb from s left join r ra on ra.x = a left join r rb on rb.x = b)"""
ORACLES["src_vcf_longest_segments"] = f"{_LPS} select pos, sample, greatest(la, lb)::int as lps, nullif(case when la >= lb then ma else mb end, '') as lps_motif from j"

# --- tables: line items as calls ---------------------------------------------------------------------------------------


def _call_lines(spark, sf_dir) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem")
    purity = F.when(L % 6 == 0, "NA").otherwise(F.col("l_discount").cast("string"))
    return li.select(
        F.lit("chr1").alias("chrom"), F.when(L % 11 == 0, "x1").otherwise(L().cast("string")).alias("ins_coord"), F.concat(F.lit("sv"), "l_suppkey").alias("SVID"), F.concat(F.lit("["), F.col("l_linenumber"), F.lit("]")).alias("insert_size"),
        F.concat(F.lit("s"), F.col("l_partkey") % 3).alias("sample"), F.col("l_linenumber").cast("string").alias("rep_start"), (F.col("l_linenumber") + 5).cast("string").alias("rep_end"), _dna(F.col("l_partkey"), 4).alias("motif"), purity.alias("purity"),
    )


@query
def src_calls(spark, sf_dir):
    path = scratch(spark, "calls")
    _call_lines(spark, sf_dir).write.option("sep", "\t").option("header", True).csv(path)
    good, bad = tables.read_calls(spark, path)
    totals = good.groupBy("sample").agg(F.count("*").alias("n"), F.sum("ins_coord").alias("coords"), F.sum("rep_end").cast("long").alias("ends"), F.count("purity").alias("n_purity"))
    return totals.unionByName(bad.select(F.lit("malformed").alias("sample"), F.col("n_bad").alias("n"), *[F.lit(None).cast("long").alias(c) for c in ("coords", "ends", "n_purity")]))


@query
def src_headerless(spark, sf_dir):
    body = _t(spark, sf_dir, "customer").select(_row(F.concat(F.lit("S"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")), F.when(F.col("c_custkey") % 2 == 0, "male").otherwise("female"), F.col("c_mktsegment")))
    return tables.read_tsv(spark, _text(body, "ancestry"), header=False, names=["sample", "sex", "superpop"])


@query
def sink_parquet(spark, sf_dir):
    """A delimited table to Parquet: NA, . and nothing become null, types are inferred, and a second run leaves the result alone."""
    src, dst = scratch(spark, "plots"), scratch(spark, "plots-parquet")
    li = _t(spark, sf_dir, "lineitem")
    gone = F.when(F.col("l_linenumber") == 1, "NA").when(F.col("l_linenumber") == 2, ".").when(F.col("l_linenumber") == 3, "").otherwise(F.col("l_tax").cast("string"))
    li.select(L().alias("k"), F.col("l_returnflag").alias("flag"), F.when(F.col("l_linenumber") == 4, "NA").otherwise(F.col("l_shipmode") if "l_shipmode" in li.columns else F.col("l_linestatus")).alias("mode"), gone.alias("tax")).write.option("sep", "\t").option("header", True).option("emptyValue", "").csv(src)
    tables.tsv_to_parquet(spark, src, dst)
    before = tables._newest(spark, dst)
    back = tables.tsv_to_parquet(spark, src, dst)
    return back.groupBy("flag").agg(F.count("*").alias("n"), F.sum("k").alias("k"), F.count("mode").alias("n_mode"), F.round(F.sum(F.col("tax").cast("double")), 4).alias("tax"), F.count("tax").alias("n_tax"), F.lit(tables._newest(spark, dst) == before).alias("left_alone"))


@query
def sink_tsv(spark, sf_dir):
    path = scratch(spark, "tsv")
    tables.write_tsv(_t(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_size")).alias("p_size"), "p_brand"), path)
    return tables.read_tsv(spark, path).groupBy("p_size").agg(F.count("*").alias("n"), F.max("p_brand").alias("brand"))


@query
def sink_metrics(spark, sf_dir):
    """Two runs with different columns, accumulated."""
    path = scratch(spark, "metrics")
    li = _t(spark, sf_dir, "lineitem")
    tables.append_metrics(spark, path, li.agg(F.lit("first").alias("run"), F.count("*").alias("n_rows")))
    tables.append_metrics(spark, path, li.agg(F.lit("second").alias("run"), F.count_if(F.col("l_tax") > 0.04).alias("n_rows"), F.countDistinct("l_orderkey").alias("n_loci")))
    return tables.read_metrics(spark, path)


@query
def src_registry(spark, sf_dir):
    """One table in three formats, registered and queried under guard; then one is taken out."""
    n = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    paths = {f: scratch(spark, f"nation-{f}") for f in ("parquet", "csv", "tsv")}
    n.write.parquet(paths["parquet"])
    n.write.option("header", True).csv(paths["csv"])
    n.write.option("header", True).option("sep", "\t").csv(paths["tsv"])
    r = serve.Registry(spark)
    for f, p in paths.items():
        r.register(f"nation_{f}", p, f)
    rows = [(f, x["n_nationkey"], x["n_name"]) for f in paths for x in r.query(f"select n_nationkey, n_name from nation_{f} order by 1 desc", max_rows=5)["rows"]]
    refused = 0
    for sql in ("drop view nation_csv", "select 1; select 2", "select * from parquet.`/x`", "select * from nation_csv"):
        try:
            r.query(sql, off={"nation_csv"})
        except Exception:
            refused += 1
    for f in paths:
        r.unregister(f"nation_{f}")
    return spark.createDataFrame([(f, int(k), v) for f, k, v in rows] + [("refused", refused, f"{len(r.datasets)} left")], "format string, n_nationkey long, n_name string")


@query
def src_disease_catalogue(spark, sf_dir):
    """A JSON array of curated loci; one build is chosen, lists become text, records without a place in it are left out."""
    s = _t(spark, sf_dir, "supplier")
    start = F.floor("s_acctbal").cast("long") + 2000
    rec = s.select(
        F.concat(F.lit("L"), K()).alias("id"), F.concat(F.lit("G"), F.col("s_nationkey")).alias("gene"), F.col("s_nationkey").cast("string").alias("chrom"), F.when(K % 9 != 0, start).alias("start_hg38"), F.when(K % 9 != 0, start + 30).alias("stop_hg38"), (start + 7).alias("start_hg19"), (start + 37).alias("stop_hg19"),
        F.array(_dna(K()), F.lit("")).alias("pathogenic_motif_reference_orientation"), F.array(F.lit("ACG")).alias("reference_motif_reference_orientation"), F.when(K % 4 == 0, F.array(F.lit("AD"), F.lit("AR"))).otherwise(F.array(F.lit("AD"))).alias("inheritance"),
        F.when(K % 3 == 0, 40).alias("pathogenic_min"), F.when(K % 5 != 0, (K % 7).cast("double")).alias("ref_copies"), F.lit("d").alias("disease"),
    )
    path = scratch(spark, "loci-json")
    rec.coalesce(1).agg(F.to_json(F.collect_list(F.struct(*rec.columns))).alias("value")).write.text(path)
    d = tables.disease_catalogue(spark, path)
    return d.select("id", "gene", "chrom", "start", "end", "ref_copies", "pathogenic_min", "inheritance", F.array_join(F.transform("motifs", lambda m: F.concat_ws(":", m["class"], m["motif"])), ",").alias("motifs"))


@query
def src_gene_phenotypes(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 8 == 0, "-").otherwise(F.col("p_partkey").cast("string")).alias("ncbi_gene_id"), F.col("p_name").alias("gene_symbol"), F.concat(F.lit("HP:"), F.lpad(F.col("p_size").cast("string"), 7, "0")).alias("hpo_id"))
    path = scratch(spark, "genes")
    p.write.option("sep", "\t").option("header", True).csv(path)
    return tables.gene_phenotypes(spark, path, "v1")


@query
def sink_bed_first(spark, sf_dir):
    return tables.bed_first_wins(_t(spark, sf_dir, "lineitem").select("l_suppkey", F.lit("chr1").alias("c"), "l_orderkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place")), "l_suppkey", "c", "l_orderkey", "place")


@query
def sink_bed_sites(spark, sf_dir):
    return tables.bed_of_sites(_t(spark, sf_dir, "lineitem").select(F.concat(F.lit("chr"), F.col("l_partkey") % 5).alias("c"), F.col("l_suppkey").alias("p")), "c", "p")


@query
def sink_fasta(spark, sf_dir):
    """Records of which ALT is longer than REF, written and read back in pairs of lines."""
    rec = vcf.records(spark, _callset(spark, sf_dir)).filter("length(ALT) > length(REF) and not startswith(ALT, '<')")
    path = _text(tables.fasta(rec, F.col("ID"), F.col("ALT")), "fasta", lineSep="\n\n")
    back = spark.read.option("lineSep", "\n\n").text(path).select(F.split("value", "\n").alias("v"))
    return back.select(F.substring(F.get("v", F.lit(0)), 2, 99).alias("name"), F.get("v", F.lit(1)).alias("sequence"))


@query
def sink_stats(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    steps = serve.funnel(li, {"input": F.lit(True), "size": F.col("l_quantity") <= 30, "tax": F.col("l_tax") > 0.02}).orderBy("place").select("stage", "n")
    parts = {"funnel": steps, "by flag": li.groupBy("l_returnflag").agg(F.count("*").alias("n")), "totals": li.agg(F.count("*").alias("rows"), F.countDistinct("l_orderkey").alias("loci"))}
    return tables.stats_sections(parts)


@query
def sink_report_table(spark, sf_dir):
    n = _t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(F.col("l_tax") > 0.04).alias("n_taxed"))
    return spark.createDataFrame(list(enumerate(tables.markdown(n, [F.col("l_returnflag")]))), "line long, value string")


@query
def src_upload(spark, sf_dir):
    """What an upload's inspection tells, and that an unreadable one is reported."""
    path = scratch(spark, "upload")
    _t(spark, sf_dir, "nation").select("n_nationkey", "n_name").write.parquet(path)
    ok, broken = serve.inspect(spark.read.parquet(path)), serve.inspect(spark.read.schema("a long").parquet(_text(_t(spark, sf_dir, "nation").select(F.col("n_name").alias("value")), "broken")))
    rows = [(c, t) for c, t in ok["columns"].items()] + [("n_rows", str(ok["n_rows"])), ("preview", str(len(ok["preview"]))), ("broken", str("error" in broken).lower())]
    return spark.createDataFrame(rows, "fact string, value string")


@query
def src_digests(spark, sf_dir):
    """One file for each nation, told apart by its sha256."""
    path = scratch(spark, "files")
    _t(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("value")).repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    return tables.digests(spark, path, "*.txt").select("length", "sha256")


@query
def src_embedding_index(spark, sf_dir):
    """An index of unit vectors, kept as Parquet; every vector against the one of smallest id."""
    path = scratch(spark, "index")
    tables.unit_vectors(_t(spark, sf_dir, "embeddings"), "vec_id", "embedding").write.parquet(path)
    index = spark.read.parquet(path)
    q = index.groupBy().agg(F.min_by("vector", "id").alias("q"))
    return index.crossJoin(F.broadcast(q)).select("id", F.round(search.dot(F.col("vector"), F.col("q")), 4).alias("score"))


@query
def src_manifests(spark, sf_dir):
    """Manifests in two forms: good, unusable, and one whose name is taken."""
    folder = scratch(spark, "manifests")
    texts = {
        "a.yaml": f"# nations\nname: nations\npath: {sf_dir}/nation.parquet\nformat: parquet\n", "b.json": '{"name": "regions", "path": "%s/region.parquet", "default_off": true}' % sf_dir, "c.yaml": "name: nations\npath: elsewhere\n",
        "d.yaml": "title: nothing\n", "e.yaml": "name: x\npath: y\nformat: xlsx\n", "f.json": '{"name": ', "g.yaml": f"name: loci\npath: {sf_dir}/nation.parquet\nrole: loci\n",
    }
    files = spark.createDataFrame(list(texts.items()), "name string, value string")
    for name in texts:  # a few files of configuration
        files.filter(F.col("name") == name).select("value").coalesce(1).write.option("lineSep", "\n").text(f"{folder}/tmp-{name}")
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = lambda p: hadoop.Path(p)
    fs = at(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for name in texts:
        part = next(s.getPath() for s in fs.listStatus(at(f"{folder}/tmp-{name}")) if s.getPath().getName().startswith("part-"))
        fs.rename(part, at(f"{folder}/{name}"))
    registry = serve.Registry(spark)
    found = manifests.load(registry, folder)
    out = manifests.as_frame(spark, found).select("file", "name", "role", F.substring_index("error", ":", 1).alias("error"))
    for name in list(registry.datasets):
        registry.unregister(name)
    return out


_LINES = f"(select case when l_orderkey % 11 = 0 then null else l_orderkey end as coord, l_linenumber + 5 as e, 's' || (l_partkey % 3) as sample, case when l_orderkey % 6 = 0 then null else l_discount end as purity from lineitem)"
ORACLES["src_calls"] = f"select sample, count(*) as n, sum(coord)::bigint as coords, sum(e)::bigint as ends, count(purity) as n_purity from {_LINES} where coord is not null group by 1 union all select 'malformed', count(*) filter (where coord is null), null, null, null from {_LINES}"
ORACLES["src_headerless"] = "select 'S' || lpad(c_custkey::varchar, 6, '0') as sample, case when c_custkey % 2 = 0 then 'male' else 'female' end as sex, c_mktsegment as superpop from customer"
ORACLES["sink_parquet"] = "select l_returnflag as flag, count(*) as n, sum(l_orderkey)::bigint as k, count(*) filter (where l_linenumber <> 4) as n_mode, round(sum(l_tax) filter (where l_linenumber > 3), 4) as tax, count(*) filter (where l_linenumber > 3) as n_tax, true as left_alone from lineitem group by 1"
ORACLES["sink_tsv"] = "select case when p_size > 25 then p_size::varchar else 'NA' end as p_size, count(*) as n, max(p_brand) as brand from part group by 1"
ORACLES["sink_metrics"] = "select 'first' as run, count(*) as n_rows, null::bigint as n_loci from lineitem union all select 'second', count(*) filter (where l_tax > 0.04), count(distinct l_orderkey) from lineitem"
ORACLES["src_registry"] = "select f as format, n_nationkey::bigint as n_nationkey, n_name from (select *, row_number() over (partition by f order by n_nationkey desc) as rn from nation, (select unnest(['parquet', 'csv', 'tsv']) as f)) where rn <= 5 union all select 'refused', 4, '0 left'"
ORACLES["src_disease_catalogue"] = f"""select 'L' || s_suppkey as id, 'G' || s_nationkey as gene, 'chr' || s_nationkey as chrom, {_START} as start, {_START} + 30 as "end", case when s_suppkey % 5 <> 0 then (s_suppkey % 7)::double end as ref_copies, case when s_suppkey % 3 = 0 then 40::double end as pathogenic_min,
  case when s_suppkey % 4 = 0 then 'AD;AR' else 'AD' end as inheritance, 'pathogenic:' || {_sql_dna('s_suppkey')} || ',reference:ACG' as motifs from supplier where s_suppkey % 9 <> 0"""
ORACLES["src_gene_phenotypes"] = "select case when p_partkey % 8 <> 0 then p_partkey end as gene_id, p_name as gene_symbol, 'HP:' || lpad(p_size::varchar, 7, '0') as hpo_id, 'v1' as release_version from part"
ORACLES["sink_bed_first"] = """select 'chr1' as chrom, l_orderkey as start, l_orderkey + 1 as "end", l_suppkey as name from (select *, row_number() over (partition by l_suppkey order by l_orderkey * 10 + l_linenumber) as rn from lineitem) where rn = 1"""
ORACLES["sink_bed_sites"] = """select distinct 'chr' || (l_partkey % 5) as chrom, l_suppkey - 1 as start, l_suppkey as "end" from lineitem"""
ORACLES["sink_fasta"] = f"select 'sv' || pos as name, alt as sequence from {_REC} where alt <> '<DEL>'"
_F = "count(*) filter (where {0})"
ORACLES["sink_stats"] = f"""with s as (select count(*) as a, {_F.format('l_quantity <= 30')} as b, {_F.format('l_quantity <= 30 and l_tax > 0.02')} as c, count(distinct l_orderkey) as d from lineitem), f as (select l_returnflag, count(*) as n from lineitem group by 1)
  select 0::int as section, 0::int as line, '## funnel' as value union all select 0, 1, 'stage' || chr(9) || 'n' union all select 0, 2, unnest(['input' || chr(9) || a, 'size' || chr(9) || b, 'tax' || chr(9) || c]) from s
  union all select 1, 0, '## by flag' union all select 1, 1, 'l_returnflag' || chr(9) || 'n' union all select 1, 2, l_returnflag || chr(9) || n from f union all select 2, 0, '## totals' union all select 2, 1, 'rows' || chr(9) || 'loci' union all select 2, 2, a || chr(9) || d from s"""
ORACLES["sink_report_table"] = """with n as (select l_returnflag, count(*) as n, count(*) filter (where l_tax > 0.04) as t, row_number() over (order by l_returnflag) as rn from lineitem group by 1)
  select 0::bigint as line, '| l_returnflag | n | n_taxed |' as value union all select 1, '| --- | --- | --- |' union all select rn + 1, '| ' || l_returnflag || ' | ' || n || ' | ' || t || ' |' from n"""
ORACLES["src_upload"] = "select unnest(['n_nationkey', 'n_name', 'n_rows', 'preview', 'broken']) as fact, unnest(['int', 'string', (select count(*) from nation)::varchar, '5', 'true']) as value"
ORACLES["src_digests"] = "select length(n_name) + 1 as length, sha256(n_name || chr(10)) as sha256 from nation"
ORACLES["src_embedding_index"] = """with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings), u as (select vec_id, list_transform(e, lambda x: (x / sqrt(list_sum(list_transform(e, lambda y: y * y))))::float::double) as e from v where list_sum(list_transform(e, lambda y: y * y)) > 0)
  select a.vec_id as id, round(list_sum(list_transform(list_zip(a.e, b.e), lambda x: x[1] * x[2])), 4) as score from u a, (select e from u order by vec_id limit 1) b"""
ORACLES["src_manifests"] = _values("file, name, role, error", [
    ("a.yaml", "nations", "", None), ("b.json", "regions", "", None), ("c.yaml", "nations", "", "name is taken"), ("d.yaml", None, "", "missing name, path"), ("e.yaml", "x", "", "unknown format xlsx"), ("f.json", None, "", "unreadable"),
    ("g.yaml", "loci", "loci", "a loci table needs locus_id, chrom, pos, motif, motif_len, motif_class, n_samples, median_len, mean_purity, novel"),
])
_CANON = f"(select list_min(list_transform(range(0, length(u)), lambda i: substr(u, i::int + 1) || substr(u, 1, i::int))) from (select coalesce(substr(m, 1, list_filter(range(1, length(m)), lambda k: length(m) % k = 0 and repeat(substr(m, 1, k::int), (length(m) // k)::int) = m)[1]::int), m) as u))"
ORACLES["src_catalogue_cache"] = f"select 'chr' || s_nationkey as chrom, count(*) as n, count(distinct {_CANON}) as n_canonical, false as first_ready, true as then_ready from (select s_nationkey, {_sql_dna('s_suppkey')} as m from supplier) group by 1"
