"""DuckDB SQL with the same results as the queries of the same names."""

from __future__ import annotations


def _dna(key: str, n: int = 6) -> str:
    return f"substr(translate(md5(({key})::varchar), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, (({key}) % {n} + 1)::int)"


_LOCI = """(select 'chr' || (o_orderkey % 24 + 1) || ':' || o_orderkey as locus_id, 'chr' || (o_orderkey % 24 + 1) as chrom, o_orderkey as pos,
  (o_custkey % 9 + 1)::int as motif_len, (o_custkey % 50)::int as n_samples, o_totalprice as median_len, round((o_orderkey % 101) / 100, 2) as mean_purity,
  o_orderstatus = 'O' as novel, o_orderpriority as gene from orders)"""
_ORDER = "case when chrom = 'chrX' then 23 when chrom = 'chrY' then 24 else try_cast(replace(chrom, 'chr', '') as int) end"
_POINTS = f"(select c_custkey, 'chr' || c_nationkey as chrom, floor(c_acctbal)::bigint as point, {_dna('c_custkey', 3)} as motif from customer)"
_CAT = f"(select s_suppkey, 'chr' || s_nationkey as chrom, floor(s_acctbal)::bigint as start, floor(s_acctbal)::bigint + 500 as stop, {_dna('s_suppkey', 3)} as motif from supplier)"


_SHORT = _CAT.replace("+ 500 as stop", "+ 60 as stop")


def _distance(p: str, s: str, e: str) -> str:
    return f"case when {p} + 1 > {s} and {p} < {e} then 0 when {p} >= {e} then {p} - {e} + 1 else {s} - {p} end"


def _canonical(m: str) -> str:
    unit = f"coalesce(substr({m}, 1, list_filter(range(1, length({m})), lambda k: length({m}) % k = 0 and repeat(substr({m}, 1, k::int), (length({m}) // k)::int) = {m})[1]::int), {m})"
    return f"(select list_min(list_transform(range(0, length(u)), lambda i: substr(u, i::int + 1) || substr(u, 1, i::int))) from (select {unit} as u))"


_VERDICT = "case l_returnflag when 'A' then 'known' when 'N' then 'novel_motif' else 'novel_locus' end"
_RANK = "case {0} when 'known' then 0 when 'novel_motif' then 1 when 'novel_locus' then 2 else 3 end"
_BACK = "case {0} when 0 then 'known' when 1 then 'novel_motif' when 2 then 'novel_locus' when 3 then 'unscreened' end"
_SPANS = "(select l_orderkey, date_diff('day', date '1992-01-01', l_shipdate::date)::bigint as s, date_diff('day', date '1992-01-01', l_shipdate::date)::bigint + l_quantity::bigint as e from lineitem)"
_UNION = f"""(select l_orderkey, greatest(e - greatest(s, coalesce(max(e) over (partition by l_orderkey order by s, e rows between unbounded preceding and 1 preceding), s)), 0) as fresh from {_SPANS})"""


def _v4(x: str) -> str:
    return f"case ({x}) % 4 when 0 then 'known' when 1 then 'novel_motif' when 2 then 'novel_locus' else 'unscreened' end"


_CALLS = f"""(select distinct 'chr1' as chrom, l_partkey as ins_coord, l_suppkey::varchar as svid, l_orderkey as sample, l_suppkey as insert_size, {_dna('l_suppkey', 4)} as canonical_motif, (l_suppkey % 4 + 1)::int as motif_length,
  l_extendedprice / 7e5 as purity, l_extendedprice / 9e5 as insertion_purity, l_quantity as rep_units, l_linenumber as depth, {_v4('l_suppkey')} as novelty, {_v4('l_suppkey + 1')} as ucsc_novelty, {_v4('l_suppkey + 2')} as trexplorer_novelty, l_suppkey % 7 as ucsc_n_nearby from lineitem)"""
_SCREEN = """with p as (select * from {points}), c as (select * from {cat} {where}), hit as (
  select p.c_custkey, c.start, c.stop, c.motif as cm, {canon_p} as pc, {canon_c} as cc, {d} as distance from p join c on p.chrom = c.chrom and c.start < p.point + {w} + 1 and c.stop > p.point - {w}),
  r as (select *, row_number() over (partition by c_custkey order by case when pc = cc then 0 else 1 end, distance, start, stop, cm) as rn, count(*) over (partition by c_custkey) as n from hit)"""


def _screen(window: int, where: str = "") -> str:
    return _SCREEN.format(points=_POINTS, cat=_CAT, where=where, canon_p=_canonical("p.motif"), canon_c=_canonical("c.motif"), d=_distance("p.point", "c.start", "c.stop"), w=window)


_STATUS = "case when p.chrom not in (select chrom from c) then 'unscreened' when r.n is null then 'novel_locus' when r.pc = r.cc then 'known' else 'novel_motif' end"
_MOTIFS = f"(select p_partkey, {_dna('p_partkey', 12)} as motif from part)"
_RC = "reverse(translate(motif, 'ACGT', 'TGCA'))"


def _funnel(source: str, stages: list[tuple[str, str]]) -> str:
    upto, parts = [], []
    for k, (name, condition) in enumerate(stages):
        upto.append(f"({condition})")
        parts.append(f"select {k}::int as place, '{name}' as stage, count(*) filter (where {' and '.join(upto)}) as n from {source}")
    return " union all ".join(parts)


ORACLES: dict[str, str] = {
    "funnel_counts": _funnel("lineitem", [("all", "true"), ("quantity", "l_quantity >= 10"), ("discount", "l_discount >= 0.03"), ("returned", "l_returnflag = 'R'"), ("late", "l_tax > 0.04")]),
    "filtered_page": f"select locus_id, chrom, pos, motif_len, median_len from {_LOCI} where novel and motif_len >= 3 and mean_purity >= 0.5 order by median_len desc nulls last, {_ORDER}, pos limit 50 offset 20",
    "filtered_sort_position": f"select locus_id, pos, gene from {_LOCI} where chrom = 'chr3' and pos between 1000 and 400000 and contains(upper(gene), 'URGENT') order by {_ORDER} desc nulls last, pos desc limit 100",
    "filter_gene_list": f"select locus_id, gene from {_LOCI} where chrom = 'chr7' and upper(gene) in ('1-URGENT', '5-LOW')",
    "class_breakdown": "select case when p_size = 1 then 'homopolymer' when p_size <= 6 then 'STR' else 'VNTR' end as motif_class, count(*) as n, count(*) filter (where p_retailprice > 1000) as n_dear from part group by 1",
    "priority_sort": "select o_orderkey, o_orderpriority, case o_orderpriority when '1-URGENT' then 0 when '2-HIGH' then 1 when '3-MEDIUM' then 2 else 99 end::int as rank from orders order by 3, o_totalprice desc, o_orderkey limit 200",
    "like_search": "select p_partkey, p_name, p_brand from part where lower(p_name) like '%ed%' or contains(upper(p_brand), '#1')",
    "agreement_modes": "with c as (select l_orderkey % 10 as sample, (l_suppkey + 1) % 4 <> 0 as u, (l_suppkey + 2) % 4 <> 0 as t from lineitem), m as (select sample, unnest(['any', case when u and t then 'both' when u then 'ucsc_only' when t then 'trexplorer_only' else 'neither' end]) as mode from c) select sample, count(*) as n, mode, 0 as n_ignored from m group by 1, 3",
    "sample_filter": "select l_orderkey as sample, l_partkey as ins_coord, l_suppkey::varchar as SVID, l_linenumber as depth, 'min_samples' as ignored from lineitem where l_orderkey = 1 and (l_suppkey + 1) % 4 <> 0 and (l_suppkey + 2) % 4 = 0",
    "tag_filter": "select coalesce(nullif(concat_ws(',', case when l_quantity < 5 then 'quantity' end, case when l_discount < 0.02 then 'discount' end, case when nullif(l_tax, 0) < 0.03 then 'tax' end), ''), 'PASS') as filter, count(*) as n from lineitem group by 1",
    "filter_chain_funnel": _funnel("(select *, case when l_quantity > 0 then l_tax * 100 / l_quantity else 0 end as coverage from lineitem)", [("input", "true"), ("keep", "l_returnflag in ('A', 'N')"), ("coverage", "coverage >= 0.1"), ("size", "l_quantity <= 30"), ("depth", "l_extendedprice >= 5000")]),
    "copy_number_class": "select case when p_size >= 40 then 'pathogenic' when p_size between 30 and 39 then 'intermediate' when p_size <= 20 then 'benign' else 'unknown' end as allele_class, case when p_size >= 40 then 'pathogenic' when p_size between 30 and 39 then 'intermediate' else 'unknown' end as copies_class, count(*) as n from part group by 1, 2",
    "representative_member": "select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_totalprice, o_orderkey) as rn, count(*) over (partition by o_custkey) as n from orders) where rn = (n + 1) // 2",
    "dominant_record": "select l_partkey, l_suppkey, n_carriers from (select *, row_number() over (partition by l_partkey order by n_carriers desc, q desc, l_suppkey) as rn from (select l_partkey, l_suppkey, count(distinct l_orderkey) as n_carriers, max(l_quantity) as q from lineitem group by 1, 2)) where rn = 1",
    "verdict_rollup_min": f"select l_orderkey, {_BACK.format(f'min({_RANK.format(_VERDICT)})')} as verdict from lineitem group by 1",
    "verdict_rollup_majority": f"select l_orderkey, v as verdict from (select *, row_number() over (partition by l_orderkey order by n desc, {_RANK.format('v')}) as rn from (select l_orderkey, {_VERDICT} as v, count(*) as n from lineitem group by 1, 2)) where rn = 1",
    "verdict_combined": f"select {_BACK.format('r')} as verdict, count(*) as n from (select least({_RANK.format(_VERDICT)}, case when l_linestatus = 'O' then 1 else 3 end) as r from lineitem) group by 1",
    "interval_union": f"select l_orderkey, sum(fresh)::bigint as covered, count(*) as n from {_UNION} group by 1",
    "insertion_purity": f"select l_orderkey, case when l_orderkey % 7 <> 0 then round(least(sum(fresh) / 120, 1.0), 3) end as insertion_purity from {_UNION} group by 1",
    "segments_build": f"""with a as (select greatest((l_discount * 100)::int - 2, 0) as s, l_quantity::int as q, (l_tax * 100)::int % 3 as t, {_dna('l_partkey', 4)} as motif from lineitem_int),
      parts as (select 'flank' as seg_type, 0 as i, s as bases, null as motif from a where s > 0 union all select 'repeat', (s > 0)::int, q, motif from a union all select 'flank', (s > 0)::int + 1, t, null from a where t > 0)
      select seg_type, i::int as seg_index, count(*) as n, sum(bases)::bigint as bases, count(distinct motif) as n_motifs from parts group by 1, 2""".replace("lineitem_int", "lineitem").replace("(l_discount * 100)::int", "trunc(l_discount * 100)::int").replace("(l_tax * 100)::int", "trunc(l_tax * 100)::int"),
    "segment_architecture": """with a as (select conv_id, regexp_replace(string_agg(case when role = 'system' then '-' else role || '×1' end, '|' order by turn), '^(?:-\\|)+|(?:\\|-)+$', '', 'g') as architecture, max(turn + 1) as len from conversations group by 1)
      select architecture, count(distinct conv_id) as carriers, min(len) as min_len, max(len) as max_len from a group by 1""",
    "nested_segments": "select conv_id, count(*)::int as n, max(turn + 1) as allele_len, string_agg(role, ',' order by turn, role) as roles from conversations group by 1",
    "loci_build": f"""with c as {_CALLS}, sup as (select ins_coord, svid, count(distinct sample) as n, max(insert_size) as size from c group by 1, 2),
      rep as (select * from (select *, row_number() over (partition by ins_coord order by n desc, size desc, svid) as rn from sup) where rn = 1),
      row1 as (select distinct c.ins_coord, c.svid, canonical_motif, motif_length, ucsc_n_nearby from c join rep on c.ins_coord = rep.ins_coord and c.svid = rep.svid),
      agg as (select ins_coord, count(distinct sample) as n_samples, count(*) as n_carrier_alleles, count(distinct svid) as n_alleles, count(distinct canonical_motif) as n_motifs, count(distinct svid) filter (where novelty <> 'known') as n_novel_alleles,
        min(insert_size) as min_len, max(insert_size) as max_len, median(insert_size)::double as median_len, median(rep_units)::double as median_units, median(depth)::double as median_depth, round(avg(purity), 6) as mean_purity, round(avg(insertion_purity), 6) as insertion_purity,
        {_BACK.format(f"min({_RANK.format('novelty')})")} as novelty, {_BACK.format(f"min({_RANK.format('ucsc_novelty')})")} as ucsc_novelty, {_BACK.format(f"min({_RANK.format('trexplorer_novelty')})")} as tr from c group by 1)
      select 'chr1:' || a.ins_coord as locus_id, a.ins_coord as pos, canonical_motif as motif, motif_length as motif_len, case when motif_length = 1 then 'homopolymer' when motif_length <= 6 then 'STR' else 'VNTR' end as motif_class, n_samples, n_carrier_alleles, n_alleles, n_motifs, n_novel_alleles,
        min_len, max_len, median_len, median_units, median_depth, mean_purity, insertion_purity, novelty, ucsc_novelty, novelty <> 'known' as novel, nullif(concat_ws(';', case when ucsc_novelty = 'known' then 'ucsc' end, case when tr = 'known' then 'trexplorer' end), '') as catalogs, svid as representative_svid, ucsc_n_nearby
      from agg a join row1 r on a.ins_coord = r.ins_coord""",
    "invariance_report": "select l_orderkey, count(distinct l_returnflag) as l_returnflag, count(distinct l_linestatus) as l_linestatus from lineitem group by 1 having count(distinct l_returnflag) > 1 or count(distinct l_linestatus) > 1",
    "dedupe_report": "select sum(n)::bigint as n_rows, count(*) as n_distinct, sum(n - 1)::bigint as n_duplicates from (select text, lang, source, count(*) as n from documents group by 1, 2, 3)",
    "any_value_block": "select s_nationkey, any_value(n_name) as n_name, count(*) as n from supplier join nation on s_nationkey = n_nationkey group by 1",
    "array_count_sort": """with a as (select l_partkey as locus_id, l_orderkey as sample, max(l_quantity::int) as len, count(*) filter (where l_returnflag = 'N') as n_arrays from lineitem group by 1, 2),
      r as (select *, row_number() over (partition by locus_id order by len, sample) as rn, count(*) over (partition by locus_id) as n from a) select locus_id, n_arrays from r where rn = (n + 1) // 2 order by n_arrays desc, locus_id limit 100""",
    "disease_locus_join": f"""with p as (select c_custkey as locus_id, chrom, point as pos from {_POINTS}), s as (select * from {_CAT}),
      hit as (select locus_id, s_suppkey, greatest(0, start - pos, pos - stop) as d, row_number() over (partition by locus_id order by greatest(0, start - pos, pos - stop), s_suppkey) as rn from p join s on s.chrom = p.chrom and pos between start - 10 and stop + 10)
      select p.*, d as disease_distance_bp, s_suppkey as disease_id, s_suppkey is not null as disease_locus from p left join (select * from hit where rn = 1) h on p.locus_id = h.locus_id""",
    "range_join_best_hit": f"""with hit as (select c_custkey, s_suppkey, {_distance('point', 'start', 'stop')} as distance from {_POINTS} p join {_CAT} c on p.chrom = c.chrom and start < point + 11 and stop > point - 10),
      r as (select *, row_number() over (partition by c_custkey order by distance, s_suppkey) as rn, count(*) over (partition by c_custkey) as n from hit)
      select p.c_custkey, s_suppkey as r_id, distance, coalesce(n, 0) as n_nearby from {_POINTS} p left join (select * from r where rn = 1) r on p.c_custkey = r.c_custkey""",
    "range_join_pairs": f"select a.s_suppkey as r_id, b.s_suppkey as or_id, least(a.stop, b.stop) - greatest(a.start, b.start) as shared from {_CAT} a join {_CAT} b on a.chrom = b.chrom and b.start < a.stop and b.stop > a.start and a.s_suppkey < b.s_suppkey",
    "range_semi": f"select c_custkey, chrom, point from {_POINTS} p where exists (select 1 from {_SHORT} c where c.chrom = p.chrom and c.start < p.point + 1 and c.stop > p.point)",
    "range_anti": f"select c_custkey, chrom, point from {_POINTS} p where not exists (select 1 from {_SHORT} c where c.chrom = p.chrom and c.start < p.point + 1 and c.stop > p.point)",
    "range_overlap_fraction": f"select a.s_suppkey as r_id, b.s_suppkey as or_id from {_CAT} a join {_SHORT} b on a.chrom = b.chrom and b.start < a.stop and b.stop > a.start where (least(a.stop, b.stop) - greatest(a.start, b.start)) / (b.stop - b.start) >= 0.5",
    "coverage_unscreened": _screen(10).replace("'chr' || c_nationkey", "'chr' || 2 * c_nationkey") + f" select p.c_custkey, {_STATUS} as novelty, coalesce(r.n, 0) as n_nearby from p left join (select * from r where rn = 1) r on p.c_custkey = r.c_custkey",
    "novelty_screen": _screen(25) + f" select p.c_custkey, {_STATUS} as ucsc_novelty, coalesce(r.n, 0) as ucsc_n_nearby, r.start as ucsc_start, r.distance as ucsc_distance, r.cm as ucsc_motif, case when r.pc = r.cc then 'exact' when r.n is not null then '' end as ucsc_match from p left join (select * from r where rn = 1) r on p.c_custkey = r.c_custkey",
    "nearest_locus": """with c as (select c_custkey, c_nationkey as k, floor(c_acctbal * 100)::bigint as at from customer), s as (select s_nationkey as k, floor(s_acctbal * 100)::bigint as at, s_suppkey from supplier),
      r as (select c.c_custkey, s_suppkey, abs(c.at - s.at) as d, row_number() over (partition by c.c_custkey order by abs(c.at - s.at), s.at, s_suppkey) as rn from c join s on c.k = s.k)
      select c.c_custkey, s_suppkey as nearest_s_suppkey, d as nearest_distance from c left join (select * from r where rn = 1) r on c.c_custkey = r.c_custkey""",
    "annotation_join_checked": "select p_brand, count(*) as n, sum(p_size)::bigint as total_size, count(*) filter (where p_size is null) as unmatched from lineitem left join part on l_partkey = p_partkey group by 1",
    "completeness_check": "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 100000)",
    "gene_join": "select distinct p_name as gene_symbol from part where p_brand in (select p_brand from part where p_size = 50) and p_name <> '-'",
    "related_terms": "with e as (select n_nationkey::bigint as child, n_regionkey::bigint as parent from nation), t as (select distinct parent as term from e) select distinct term, 'parent' as relation, parent as related from t join e on term = child union select distinct term, 'child', child from t join e on term = parent",
    "canonical_motif": f"select p_partkey, motif, {_canonical('motif')} as canonical from {_MOTIFS}",
    "canonical_motif_both_strands": f"select p_partkey, least({_canonical('motif')}, {_canonical('rc')}) as canonical, rc, round((length(motif) - length(translate(motif, 'GC', ''))) / length(motif), 6) as gc from (select *, {_RC} as rc from {_MOTIFS})",
    "edit_distance_pairs": "with n as (select distinct p_name from part) select a.p_name as a, b.p_name as b, levenshtein(a.p_name, b.p_name)::int as edits from n a join n b on a.p_name < b.p_name where levenshtein(a.p_name, b.p_name) <= 3",
    "interval_distances": f"select s_suppkey as r_id, case when stop > 3000 and start < 3600 then 0 when start >= 3600 then start - 3600 + 1 else 3000 - stop + 1 end as distance, greatest(0, start - 3000, 3000 - stop) as point_distance from {_CAT}",
    "chrom_sort": "select chrom, case when chrom = 'chrX' then 23 when chrom = 'chrY' then 24 else try_cast(replace(chrom, 'chr', '') as int) end as place from (select case n_nationkey when 23 then 'chrX' when 24 then 'chrUn' else 'chr' || n_nationkey end as chrom from nation)",
    "multi_value_explode": "select word, count(*) as n from (select trim(unnest(string_split(p_name, ' '))) as word from part) where word <> '' group by 1",
    "collapse_repeats": "select p_partkey, p_brand as collapsed, p_brand as first, p_brand as only from part",
    "parse_fields": "select c_custkey, c_custkey as size, c_custkey + c_nationkey as depth, case when c_custkey % 2 = 1 then c_mktsegment end as kept from customer",
    "props_map": "select event_type, sum((props->>'k')::int)::bigint as total_k, count(*) filter (where (props->>'k')::int > 50) as n_large from events group by 1",
    "info_fields": "select l_returnflag as svtype, 'true' as precise, sum(l_linenumber)::bigint as svlen from lineitem group by 1",
    "mention_coverage": r"select count(*) as n, round(avg((regexp_matches(text, '(?i)(?:^|[^0-9A-Za-z_])the(?:[^0-9A-Za-z_]|$)') and regexp_matches(text, '(?i)(?:^|[^0-9A-Za-z_])and(?:[^0-9A-Za-z_]|$)') and not regexp_matches(text, '(?i)(?:^|[^0-9A-Za-z_])license(?:[^0-9A-Za-z_]|$)'))::int), 6) as coverage from documents",
    "pivot_zero_fill": "select l_returnflag, round(100.0 * o / n, 1) as \"O\", round(100.0 * f / n, 1) as \"F\", 0.0::double as \"X\" from (select l_returnflag, count(*) filter (where l_linestatus = 'O') as o, count(*) filter (where l_linestatus = 'F') as f, count(*) filter (where l_linestatus in ('O', 'F')) as n from lineitem group by 1)",
    "sfs_bins": "select floor(log2(c))::int as bin, count(*) as n from (select count(*) as c from orders group by o_custkey) where c < 128 group by 1",
    "equal_width_histogram": "select least(floor((l_quantity - 1) / 4.9), 9)::int as bin, count(*) as n from lineitem where l_quantity between 1 and 50 group by 1",
    "log_histogram": "select floor(log10(value) * 2)::int as bin, count(*) as n from events where value > 0 group by 1",
    "overflow_pool": "select least(l_quantity, 40.0)::double as value, count(*) as n from lineitem group by 1",
    "ecdf": "select p_size as value, count(*) as n, round(sum(count(*)) over (order by p_size) / sum(count(*)) over (), 6) as share from part group by p_size",
    "threshold_ladder": " union all ".join(f"select {float(x)}::double as within, count(*) filter (where o_totalprice <= {x}) as n from orders" for x in (1000, 50000, 100000, 200000, 400000)),
    "class_summary": "select p_brand, count(*) as n, round(avg(p_size), 3) as mean_p_size, round(median(p_size)::double, 3) as median_p_size, round(avg(p_retailprice), 3) as mean_p_retailprice, round(median(p_retailprice), 3) as median_p_retailprice from part group by 1",
    "box_outliers": "with q as (select o_orderpriority as p, quantile_cont(o_totalprice, 0.25) as q1, quantile_cont(o_totalprice, 0.75) as q3 from orders group by 1) select o_orderpriority, round(any_value(q1), 4) as q1, round(any_value(q3), 4) as q3, count(*) filter (where o_totalprice < q1 - 1.5 * (q3 - q1) or o_totalprice > q3 + 1.5 * (q3 - q1)) as n_outliers from orders join q on o_orderpriority = p group by 1",
    "top_values": "select l_partkey, count(*) as n from lineitem group by 1 order by 2 desc, 1 limit 25",
    "top_with_other": "with t as (select p_brand, sum(p_size)::bigint as total from part group by 1), r as (select *, row_number() over (order by total desc, p_brand) as r from t) select case when r <= 3 then p_brand else 'Other' end as p_brand, sum(total)::bigint as total from r group by 1",
    "share_of_total": "select lang, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from documents group by 1",
    "distinct_per_group": "select l_returnflag, count(distinct (l_partkey, l_suppkey)) as n_pairs, count(distinct l_suppkey) filter (where l_linestatus = 'O') as n_open_suppliers, arg_max(l_orderkey, (l_extendedprice, l_orderkey)) as dearest from lineitem group by 1",
    "kmer_spectrum_dna": f"""with s as (select upper({_dna('p_partkey', 12)} || case when p_size % 5 = 0 then 'N' else '' end || {_dna('p_partkey + 1', 12)}) as q from part), k as (select substr(q, unnest(range(1, length(q) - 1))::int, 3) as kmer from s where length(q) >= 3),
      c as (select least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) as kmer, count(*) as n from k where not contains(kmer, 'N') group by 1) select least(n, 255) as occurrences, count(*) as n_kmers from c group by 1""",
    "kmer_spectrum": "with k as (select substr(text, unnest(range(1, length(text) - 2))::int, 4) as kmer from documents where length(text) >= 4), c as (select kmer, count(*) as n from k group by 1) select least(n, 255) as occurrences, count(*) as n_kmers from c group by 1",
    "jaccard_agreement": "select round(coalesce(count(*) filter (where a and b) / nullif(count(*) filter (where a or b), 0), 0.0), 6) as agreement from (select quality <> 1 as a, toxic <> 0 as b from labels)",
    "balanced_accuracy": "select round((avg(case when quality = 1 then (toxic = 0)::int end) + avg(case when quality <> 1 then (toxic <> 0)::int end)) / 2, 6) as balanced_accuracy from labels",
    "grid_sweep": "with g as (select q::double as s_quantity, d::double as s_discount from (select unnest([10, 20, 30, 40]) as q), (select unnest([0.02, 0.05, 0.08]) as d)) select s_quantity, s_discount, count(*) filter (where k) as n, count(distinct l_orderkey) filter (where k) as n_orders from (select g.*, l_orderkey, l_quantity >= s_quantity and l_discount >= s_discount as k from lineitem, g) group by 1, 2",
    "set_operations": "with c as (select c_nationkey as k from customer), s as (select s_nationkey as k from supplier where s_acctbal > 5000) select 'both' as kind, count(*) as n from (select k from c intersect select k from s) union all select 'either', count(*) from (select k from c union select k from s) union all select 'only_first', count(*) from (select k from c except select k from s)",
    "unpivot_metrics": "select o_orderstatus, 'mean' as metric, round(avg(o_totalprice), 2) as value from orders group by 1 union all select o_orderstatus, 'max', round(max(o_totalprice), 2) from orders group by 1",
    "knn_cosine": "with q as (select embedding as e from embeddings where vec_id = 0), s as (select vec_id, list_sum(list_transform(list_zip(embedding, (select e from q)), lambda x: x[1]::double * x[2]::double)) as s from embeddings) select vec_id, round(s, 4) as score, s >= 0.5 as accepted from s order by s desc, vec_id limit 10",
    "event_windows": "select time_bucket(interval 1 day, ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "ancestry_burden": """with c as (select c_custkey as s, c_mktsegment as superpop from customer where c_acctbal > 0), o as (select superpop, o_orderstatus as verdict, o_orderdate, o_orderpriority from orders join c on o_custkey = s),
      e as (select distinct superpop, v as verdict from o, (select unnest(['F', 'O', 'P', 'X']) as v)), n as (select superpop, verdict, count(*) as n_calls, count(distinct (o_orderdate, o_orderpriority)) as n_sites from o group by 1, 2)
      select e.superpop, e.verdict, coalesce(n_calls, 0) as n_calls, coalesce(n_sites, 0) as n_sites from e left join n on e.superpop = n.superpop and e.verdict = n.verdict""",
    "population_summary": "with n as (select o_custkey as s, count(*) as n from orders group by 1) select c_mktsegment as superpop, count(*) as n, round_even(avg(n), 0)::bigint as mean, round_even(median(n), 0)::bigint as median from customer join n on c_custkey = s group by 1",
    "per_sample_table": "with r as (select o_custkey as s, count(*) as n from orders group by 1), t as (select o_custkey as s, count(distinct o_orderpriority) as n from orders where o_totalprice > 50000 group by 1) select c_custkey as sample, c_mktsegment as superpop, r.n as n_insertions_raw, t.n as n_insertions_tr from customer join r on r.s = c_custkey join t on t.s = c_custkey",
    "carrier_frequency": f"""with o as (select distinct l_partkey as p, l_orderkey as s, {_VERDICT} as v from lineitem), c as (select p, count(distinct s) as n from o group by 1),
      m as (select p, v, row_number() over (partition by p order by count(*) desc, {_RANK.format('v')}) as rn from o group by p, v) select least(floor(log2(n)), 6)::int as bin, v as verdict, count(*) as n_sites from c join m on c.p = m.p and rn = 1 group by 1, 2""",
    "motif_length_summary": "select l_linenumber, count(*) as hits, count(distinct (l_partkey, l_suppkey)) as n_insertions, count(distinct l_orderkey) as n_samples, round_even(avg(l_quantity), 3) as mean_l_quantity, round_even(median(l_quantity), 3) as median_l_quantity from lineitem group by 1",
    "category_comparison": """with g as (select l_returnflag as f, count(*)::double as n, round(avg(l_quantity), 4) as mq, round(median(l_quantity)::double, 4) as dq, round(avg(l_linenumber), 4) as ml, round(median(l_linenumber)::double, 4) as dl, round(100.0 * count(*) / sum(count(*)) over (), 4) as pct from lineitem group by 1),
      u as (select f, unnest(['n', 'mean_l_quantity', 'median_l_quantity', 'mean_l_linenumber', 'median_l_linenumber', 'pct']) as metric, unnest([n, mq, dq, ml, dl, pct]) as value from g)
      select metric, max(value) filter (where f = 'A') as "A", max(value) filter (where f = 'N') as "N", max(value) filter (where f = 'R') as "R" from u group by 1""",
    "motif_ranks": "select p_name, n, (row_number() over (order by n desc, p_name))::int as rank from (select p_name, count(*) as n from part group by 1)",
    "site_landscape": "select l_partkey, count(*) as n_calls, count(distinct l_orderkey) as n_samples, count(distinct l_suppkey) as n_motifs, arg_min(l_suppkey, (l_orderkey, l_suppkey)) as first_motif from lineitem group by 1",
    "validation_sensitivity": f"with t as (select distinct chrom, point from {_POINTS}), h as (select *, exists (select 1 from {_CAT} c where c.chrom = t.chrom and c.start < t.point + 1 and c.stop > t.point) as hit from t) select count(*) as total, count(*) filter (where hit) as true_positives, count(*) filter (where not hit) as missed, round(count(*) filter (where hit) / count(*), 4) as sensitivity from h",
    "agreement_rate": "select round(avg(((quality = 1) = (toxic = 0))::int), 6) as agreement from labels",
    "percentile_rows": "with r as (select p_size, p_partkey, row_number() over (order by p_size, p_partkey) - 1 as i, count(*) over () as n from part) select p_size, p_partkey, share::double as share from r, (select unnest([0.0, 0.25, 0.5, 0.9, 1.0]) as share) where i = floor(share * (n - 1))",
    "stacked_histogram": "select (floor(p_size / 5.0) * 5.0)::double as \"from\", p_type, count(*) as n from part group by 1, 2",
    "display_scales": "with t as (select greatest(10.0, pow(10.0, ceil(log10(max(p_retailprice))))) as top from part) select p_partkey, round(least(greatest(100 * ln(1 + p_size) / ln(1 + top), 0.0), 100.0), 6) as place, round(greatest(4.0, 100 * sqrt(p_size / 50)), 6) as width from part, t",
    "dominant_motifs": "with s as (select l_orderkey, l_returnflag as motif, sum(l_quantity::bigint)::bigint as bases, sum(l_linenumber)::bigint as copies from lineitem group by 1, 2) select l_orderkey, motif, bases, copies from (select *, row_number() over (partition by l_orderkey order by bases desc, motif desc) as rn from s) where rn = 1",
}

# --- tolerant comparison, disease screen and others in plain SQL -------------------------------------------------------


def _unit(m: str) -> str:
    return f"coalesce(substr({m}, 1, list_filter(range(1, length({m})), lambda k: length({m}) % k = 0 and repeat(substr({m}, 1, k::int), (length({m}) // k)::int) = {m})[1]::int), {m})"


def _turns(u: str) -> str:
    return f"list_transform(range(0, length({u})), lambda i: substr({u}, i::int + 1) || substr({u}, 1, i::int))"


def _mention(term: str) -> str:
    return f"regexp_matches(text, '(?i)(?:^|[^0-9A-Za-z_]){term}(?:[^0-9A-Za-z_]|$)')"


def _ladder(strategies: dict[str, list[str]], must: str) -> str:
    parts = []
    for name, terms in strategies.items():
        hit = " and ".join(_mention(t) for t in terms)
        parts.append(f"select '{name}' as strategy, {len(terms)}::int as specificity, count(*) filter (where {hit}) as hits, count(*) filter (where {hit} and {_mention(must)}) as mentioning from documents")
    return f"select *, round(mentioning / nullif(hits, 0), 6) as coverage from ({' union all '.join(parts)})"


_LAID = "list_min(list_transform({turns}, lambda t: list_sum(list_transform(range(1, length({whole}) + 1), lambda j: (substr(repeat(t, length({whole})::int), j::int, 1) <> substr({whole}, j::int, 1))::int))))"
_TOLERANT = f"""with p as (select *, {_canonical('motif')} as pc, {_unit('motif')} as u from {_POINTS}), c as (select *, {_canonical('motif')} as cc from {_CAT}),
  pair as (select p.c_custkey, pc, u, cc, c.start, c.stop, c.motif as cm, {_distance('p.point', 'c.start', 'c.stop')} as distance from p join c on p.chrom = c.chrom and c.start < p.point + 26 and c.stop > p.point - 25),
  kinds as (select distinct pc, u, cc, case when length(pc) <= length(cc) then pc else cc end as a, case when length(pc) <= length(cc) then cc else pc end as b from pair),
  told as (select pc, u, cc, case when pc = cc then 0 when abs(length(pc) - length(cc)) <= 1 then list_min(list_transform({_turns('u')}, lambda f: levenshtein(f, cc))) end as near,
    case when 2 * length(a) <= length(b) then {_LAID.format(turns=_turns('a'), whole='b')} end as laid from kinds),
  judged as (select pc, u, cc, case when pc = cc then 'exact' when near <= 1 then 'fuzzy' when laid <= 1 then 'subrepeat' else '' end as kind, case when pc = cc then 0 when near <= 1 then near when laid <= 1 then laid else 2 end as edits from told),
  r as (select pair.c_custkey, kind, edits, row_number() over (partition by c_custkey order by case when kind <> '' then 0 else 1 end, edits, distance, start, stop, cm) as rn from pair join judged using (pc, u, cc))
  select case when p.chrom not in (select chrom from c) then 'unscreened' when kind is null then 'novel_locus' when kind <> '' then 'known' else 'novel_motif' end as novelty, kind as match, count(*) as n, sum(edits)::bigint as edits
  from p left join (select * from r where rn = 1) r on p.c_custkey = r.c_custkey group by 1, 2"""
_BOTH = f"least({_canonical('m')}, {_canonical('rc')})"
_FOLD = f"(select {_BOTH} from (select m, reverse(translate(m, 'ACGT', 'TGCA')) as rc))"
_DISEASE = f"""with forms as (select m, {_BOTH} as f from (select m, reverse(translate(m, 'ACGT', 'TGCA')) as rc from (select motif as m from {_POINTS} union select motif from {_CAT} union select 'ACG'))),
  p as (select p.*, f, c_custkey % 60 as units from {_POINTS} p join forms on m = motif), c as (select c.*, 'L' || lpad(s_suppkey::varchar, 6, '0') as id, f, (select f from forms where m = 'ACG') as ref from {_CAT} c join forms on m = motif),
  hit as (select c_custkey, id, case when p.f = c.f then 1 when p.f = ref then 2 else 6 end as rank, {_distance('p.point', 'c.start', 'c.stop')} as distance from p join c on p.chrom = c.chrom and c.start < p.point + 51 and c.stop > p.point - 50),
  r as (select *, row_number() over (partition by c_custkey order by rank, distance, id) as rn, count(*) over (partition by c_custkey) as n from hit),
  j as (select p.*, id, rank, n, case when id is not null then 10.0 + units end as copies from p left join (select * from r where rn = 1) r on p.c_custkey = r.c_custkey),
  k as (select *, case when id is null or copies is null then 'unknown' when copies >= 40 then 'pathogenic' when copies between 1 and 39 then 'benign' else 'unknown' end as allele_class from j)
  select case when id is null then 'no_locus_match' when rank = 6 then 'locus_novel_motif' when rank = 1 and allele_class = 'pathogenic' then 'pathogenic_expansion' when rank = 1 then 'pathogenic_motif' else 'locus_known_motif' end as status,
    case when rank = 1 then 'pathogenic' when rank = 2 then 'reference' else 'none' end as motif_class, allele_class, case when id is not null then true end as gene_agrees, count(*) as n, sum(coalesce(n, 0))::bigint as nearby from k group by 1, 2, 3, 4"""
_PURE = f"({_dna('p_partkey', 5)})"
ORACLES |= {
    "novelty_screen_tolerant": _TOLERANT,
    "disease_screen": _DISEASE,
    "rotation_distance": f"""with m as (select distinct {_dna('p_partkey', 12)} as motif from part), d as (select motif, {_canonical('motif')} as qc, {_unit('motif')} as u, (select {_canonical("x")} from (select 'ACGTT' as x)) as tc from m),
      e as (select motif, case when qc = tc then 0 when abs(length(qc) - length(tc)) > 2 then 3 else least(3, list_min(list_transform({_turns('u')}, lambda f: levenshtein(f, tc)))) end as edits from d)
      select edits::int as edits, count(*) as n from part join e on motif = {_dna('p_partkey', 12)} group by 1""",
    "query_ladder": _ladder({"narrow": ["the", "and", "license"], "middle": ["the", "license"], "wide": ["license"], "none": ["zzzz"]}, "public"),
    "longest_pure_segments": f"""with s as (select p_partkey, repeat({_dna('p_partkey', 5)}, (p_size % 9 + 1)::int) || {_dna('p_partkey + 7', 9)} as q from part),
      c as (select p_partkey, q, p, i, list_max(list_filter(range(1, length(q) // p + 1), lambda c: substr(q, i::int, (p * c)::int) = repeat(substr(q, i::int, p::int), c::int))) as c from s, (select unnest(range(1, 13)) as p), (select unnest(range(1, 60)) as i) where p < length(q) and i <= length(q)),
      r as (select *, row_number() over (partition by p_partkey order by p * c desc, p, i) as rn from c where c > 1)
      select s.p_partkey, coalesce(substr(r.q, i::int, p::int), '') as motif, coalesce(c, 0)::int as copies from s left join r on r.p_partkey = s.p_partkey and rn = 1""",
    "event_sessions": """with e as (select user_id, ts, case when ts > lag(ts) over (partition by user_id order by ts) + interval 6 hours then 1 else 0 end as new from events where ts is not null and user_id is not null),
      s as (select *, sum(new) over (partition by user_id order by ts rows between unbounded preceding and current row) as k from e)
      select user_id, min(ts) as session_start, max(ts) + interval 6 hours as session_end, count(*) as n from s group by user_id, k""",
    "exon_ladder": """with s as (select p_partkey, list_sort(list_distinct(list_filter([1, 50, p_size - 1, p_size, p_size + 1], lambda x: x between 1 and 50))) as l from part)
      select p_partkey, array_to_string(flatten(list_transform(l, lambda x, i: case when i > 1 and x - l[i - 1] > 1 then [-1, x] else [x] end)), ',') as ladder from s""",
}

_MOTIFS = f"select distinct {_dna('p_partkey', 12)} as motif from part"
ORACLES["similar_motif_pairs"] = f"""with a as ({_MOTIFS}), b as (select distinct {_dna('(s_suppkey + 7)', 9)} as other from supplier), u as (select motif, {_unit('motif')} as u from a), t as (select motif, unnest(list_distinct(list_transform(range(0, length(u)), lambda i: substr(u, i::int + 1) || substr(u, 1, i::int)))) as turn from u),
  c as (select other, {_canonical('other')} as form from b), f as (select distinct form from c),
  d as (select motif, form, min(levenshtein(turn, form))::int as edits from t join f on abs(length(turn) - length(form)) <= 1 where levenshtein(turn, form) <= 1 group by 1, 2) select motif, other, edits from d join c using (form)"""
ORACLES["term_ancestors"] = """with recursive e as (select c_custkey as child, c_custkey // 2 as parent from customer where c_custkey <> c_custkey // 2 union select c_custkey, c_custkey // 3 from customer where c_custkey <> c_custkey // 3),
  up as (select child as term, parent as ancestor, 1 as depth from e union select term, parent, depth + 1 from up join e on ancestor = child) select term, ancestor, min(depth) as depth from up group by 1, 2"""
ORACLES["rolled_up"] = """with c as (select 'chr' || (l_partkey % 5) as chrom, l_partkey as ins_coord, case l_suppkey % 4 when 0 then 'known' when 1 then 'novel_motif' when 2 then 'novel_locus' else 'unscreened' end as novelty, l_orderkey as sample, l_discount as purity from lineitem)
  select concat_ws(',', case when grouping(chrom) = 0 then 'chrom' end, case when grouping(ins_coord) = 0 then 'ins_coord' end, case when grouping(novelty) = 0 then 'novelty' end) as level, chrom, ins_coord, novelty, count(*) as n_calls, count(distinct sample) as n_samples, round(sum(purity), 4) as purity, count(purity) as n_purity
  from c group by grouping sets ((chrom, ins_coord, novelty), (chrom, ins_coord), (chrom, novelty), (chrom), ())"""
ORACLES["stream_new_files"] = "select event_type, count(*) as n, count(*) as n_events, round(sum(value), 2) as total from events group by 1"

_SCORED = _ladder({"narrow": ["the", "and", "license"], "middle": ["the", "license"], "wide": ["license"], "other": ["and"], "none": ["zzzz"]}, "public")
ORACLES["best_query"] = " union all ".join(f"select * from (select {least}::double as least, strategy, specificity, hits from ({_SCORED}) where hits > 0 and coverage >= {least} order by specificity desc, hits, strategy limit 1)" for least in ("0.5", "0.0", "1.0"))

ORACLES["constrained_only"] = f"with l as (select * from {_LOCI} where mean_purity >= 0.9 and n_samples >= 10) select locus_id, mean_purity as pli, 'position' as sort, (select count(*) from l) as total from l order by substr(chrom, 4)::int, pos limit 50"
ORACLES["calls_in_scope"] = "select chrom, count(*) as n from (select 'chr' || case when k < 25 then k::varchar when k = 25 then 'X' when k = 26 then 'Y' when k = 27 then 'M' else 'Un_' || k end as chrom from (select l_suppkey % 30 as k from lineitem)) where chrom in (select 'chr' || unnest(range(1, 23)) union all select unnest(['chrX', 'chrY'])) group by 1"
ORACLES["first_listed"] = "select p_partkey, p_brand as first, p_brand as only, p_name as alone from part"
