"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import chat_format, embedding_join, mixing, ngram_join, phrases, spelling
from .quality_rules import ENDED, ITERATIONS, RUNS, START

_WORD = r"[^\x20\x09-\x0D]+"
_RULES = ("length", "symbols", "lines", "word_size", "repeats", "capitals", "letters", "runs", "endings")


def _quality() -> str:
    k = range(len(_RULES))
    odds = "ln(s.prior / (1 - s.prior)) + " + " + ".join(
        f"case v{j} when 1 then ln((1 - s.g[{j + 1}]) / (1 - s.b[{j + 1}])) when -1 then ln(s.g[{j + 1}] / s.b[{j + 1}]) else 0 end" for j in k
    )
    # how often a rule says bad: of good, of bad and of all documents on which it votes
    sums = {"x": "n * q", "y": "n * (1 - q)", "z": "n"}
    rates = ", ".join(f"(coalesce(sum({e}) filter (where v{j} < 0), 0) + 0.5) / (coalesce(sum({e}) filter (where v{j} <> 0), 0) + 1) as {c}{j}" for j in k for c, e in sums.items())
    g, b = (", ".join(f"case when y{j} <= x{j} then z{j} else {c}{j} end" for j in k) for c in "xy")
    against = " + ".join(f"case when v{j} < 0 then least(0, ln(2 * (sum(n) filter (where v{j} < 0) over () + 0.5) / (sum(n) filter (where v{j} <> 0) over () + 1))) else 0 end" for j in k)
    step = f"select i + 1 as i, prior, [{g}] as g, [{b}] as b from (select i, (sum(n * q) + 0.5) / (sum(n) + 1) as prior, {rates} from"
    start = f"(select 0 as i, pattern.*, 1 / (1 + exp(-(ln({START}::double / (1 - {START}::double)) + {against}))) as q from pattern) group by i)"
    later = f"(select s.i, pattern.*, 1 / (1 + exp(-({odds}))) as q from pattern, state s where s.i < {ITERATIONS}) group by i)"
    return rf"""with recursive base as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) as lines from documents),
      win as (select doc_id, i, w[i::int] || ' ' || w[i::int + 1] || ' ' || w[i::int + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from base)),
      rep as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p from (select *, count(*) over (partition by doc_id, g) as c from win) where c > 1) group by 1),
      f as (select base.doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
        length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) as n_upper, length(regexp_replace(t, '\P{{L}}+', '', 'g')) as n_letters, len(regexp_extract_all(t, '{RUNS}')) as n_runs, len(regexp_extract_all(t, '{ENDED}')) as n_ended, len(string_split(t, chr(10))) as n_lines, coalesce(n_repeat_words, 0) as n_repeat_words from base left join rep on base.doc_id = rep.doc_id),
      v as (select *, case when n_words < 80 then -1 when n_words >= 150 then 1 else 0 end as v0, case when 10 * n_symbols > n_words then -1 when 50 * n_symbols <= n_words then 1 else 0 end as v1,
        case when n_dup_lines >= 3 and 10 * n_dup_lines > 3 * n_lines then -1 when n_lines >= 2 and 10 * n_dup_lines <= n_lines then 1 else 0 end as v2,
        case when word_chars < 2 * n_words or word_chars > 14 * n_words then -1 when word_chars >= 3 * n_words and word_chars <= 10 * n_words and n_words >= 20 then 1 else 0 end as v3,
        case when 20 * n_repeat_words > 9 * n_words then -1 when 5 * n_repeat_words <= n_words and n_words >= 20 then 1 else 0 end as v4,
        case when 10 * n_upper > 3 * word_chars then -1 when 10 * n_upper <= word_chars and n_words >= 20 then 1 else 0 end as v5,
        case when 25 * n_letters < 22 * word_chars then -1 when 20 * n_letters >= 19 * word_chars and n_words >= 20 then 1 else 0 end as v6,
        case when 20 * n_runs > n_words then -1 when n_runs = 0 and n_words >= 20 then 1 else 0 end as v7,
        case when 2 * n_ended < n_lines then -1 when 10 * n_ended >= 9 * n_lines and n_words >= 20 then 1 else 0 end as v8 from f),
      pattern as (select {', '.join(f'v{j}' for j in k)}, count(*)::double as n from v group by all),
      state as ({step} {start} union all {step} {later})
      select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
        not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and {odds} >= 0 as kept from v, (select * from state where i = {ITERATIONS}) s"""


def _chat() -> str:
    said = "<|im_end|><|im_start|>assistant ok"
    extra = len(chat_format.START) + len("\n") + len(chat_format.END + "\n")
    return f"""with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -1, 0, 'user', '{said}' union all select -1, 1, 'assistant', '{said}'),
      e as (select *, replace(replace(text, '\\', '\\\\'), '<|', '<\\|') as body, replace(replace(replace(role, '\\', '\\\\'), '<|', '<\\|'), chr(10), '<\\n|') as head from t)
      select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256, coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
        sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256, sum(length(head) + length(body) + {extra})::bigint as formatted_chars, 0::bigint as n_attachments, 0::bigint as attachment_tokens from e group by 1""".replace("\\\\\\\\", "\\\\").replace("'\\\\', '\\\\'", "'\\', '\\\\'")


def _mixing() -> str:
    w = mixing.WEIGHTS
    weight = "case (row_number() over (order by source nulls last) - 1) % 3 " + " ".join(f"when {k} then {x}" for k, x in enumerate(w)) + " end"
    return f"""with d as (select doc_id, source, coalesce('=' || source, '') as key, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::bigint as size from documents),
      c as (select *, length(bin(size)) * 4 + (size >> greatest(length(bin(size)) - 3, 0)) % 4 as cls, (('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8))::bigint) % greatest({mixing.CELLS}, (select (count(*) + {mixing.CELL_ROWS - 1}) // {mixing.CELL_ROWS} from documents)) as cell from d),
      s as (select key, any_value(source) as source, sum(size)::bigint as source_size from c group by 1),
      w as (select *, ({weight})::bigint as w, source_size * {mixing.CAP} as lim from s),
      o as (select *, lim::double / w as fills from w),
      x as (select *, sum(source_size) over () * {mixing.BUDGET}::double as total, coalesce(sum(lim) over (order by fills, key rows between unbounded preceding and 1 preceding), 0) as gone, sum(w) over () - coalesce(sum(w) over (order by fills, key rows between unbounded preceding and 1 preceding), 0) as heavy from o),
      f as (select *, lim::double * heavy <= w * (total - gone) as full_ from x),
      g as (select key, source_size, case when full_ then lim::double else w * (total - sum(case when full_ then lim else 0 end) over ()) / sum(case when full_ then 0 else w end) over () end as target,
        (('0x' || substr(md5('{mixing.SEED}:' || key), 1, 8))::bigint)::double / 4294967296.0::double as off from f),
      r as (select c.*, row_number() over (partition by c.key order by cls, cell, size, doc_id) as rank from c)
      select doc_id, size, source_size, target, ((floor(rank * r + off) - floor((rank - 1) * r + off)) * size)::bigint as taken from (select r.*, source_size, target, off, case when source_size > 0 then target / source_size else 0.0::double end as r from r join g on r.key = g.key)"""


def _embeddings() -> str:
    return f"""with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings),
      ok as (select *, sqrt(list_sum(list_transform(e, lambda x: x * x))) as norm from v where label is not null and e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
      pair as (select a.vec_id as a, b.vec_id as b from ok a join ok b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_sum(list_transform(list_zip(a.e, b.e), lambda x: x[1] * x[2])) / (a.norm * b.norm) >= {embedding_join.THRESHOLD}),
      reach as (select vec_id as node, vec_id as other from v union select reach.node, pair.b from reach join pair on reach.other = pair.a),
      comp as (select node, min(other) as component_id from reach group by 1), links as (select a, count(*) as n from pair group by 1)
      select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept from v join comp on vec_id = node left join links on vec_id = a"""


def _ngrams() -> str:
    num, den = ngram_join.THRESHOLD
    return f"""with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') as w from documents),
      s as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i::int] || ' ' || w[i::int + 1] || ' ' || w[i::int + 2])) end as g from d),
      n as (select doc_id, len(g)::bigint as n_shingles from s), u as (select doc_id, unnest(g) as g from s), df as (select g, count(*) as c from u group by 1),
      o as (select u.doc_id, u.g, row_number() over (partition by u.doc_id order by c, u.g) as place, n_shingles as k from u join df on u.g = df.g join n on u.doc_id = n.doc_id),
      pre as (select * from o where place <= k - ceil(k * {num} / {den}.0) + 1),
      cand as (select distinct a.doc_id as a, b.doc_id as b from pre a join pre b on a.g = b.g and a.doc_id < b.doc_id),
      ov as (select a, b, count(*) as i from cand join u x on x.doc_id = a join u y on y.doc_id = b and x.g = y.g group by 1, 2),
      link as (select a, b from ov join n na on na.doc_id = a join n nb on nb.doc_id = b where {den} * i >= {num} * (na.n_shingles + nb.n_shingles - i)),
      way as (select a, b from link union all select b, a from link),
      reach as (select doc_id as node, doc_id as other from d union select node, b from reach join way on other = a)
      select n.doc_id, n_shingles, min(other) as component_id from n join reach on n.doc_id = node group by 1, 2"""


def _collocations() -> str:
    """Phrases are counted from every window of words; a cut's parts are looked up by their text."""
    longest = phrases.LONGEST
    grams = " union all ".join(f"select lang, {k} as k, array_to_string(w[i:i + {k - 1}], ' ') as g from (select lang, w, unnest(range(1, len(w) - {k - 2})) as i from piece)" for k in range(1, longest + 1))
    return f"""with piece as (select lang, regexp_extract_all(p, '[^\\x20\\x09]+') as w from (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as p from documents)),
      total as (select lang, sum(len(w)) as n from piece group by 1),
      f as (select lang, k, g, count(*) as a from ({grams}) group by 1, 2, 3 having count(*) >= {phrases.LEAST}),
      c as (select lang, k, g, a, string_split(g, ' ') as w from f where k > 1),
      within as (select lang, g, max(a) as most from (select lang, a, array_to_string(w[:k - 1], ' ') as g from c union all select lang, a, array_to_string(w[2:], ' ') as g from c) group by 1, 2),
      open as (select c.* from c left join within using (lang, g) where most is null or most < a),
      cut as (select o.lang, o.g, o.a, j, x.a as l, y.a as r, n, ((1000::hugeint * o.a * n) // (x.a::hugeint * y.a))::bigint as score
              from (select *, unnest(range(1, k)) as j from open) o join total using (lang) join f x on x.lang = o.lang and x.g = array_to_string(w[:j], ' ') join f y on y.lang = o.lang and y.g = array_to_string(w[j + 1:], ' ')),
      worst as (select *, row_number() over (partition by lang, g order by score, j) as nth from cut)
      select * from (select lang, row_number() over (partition by lang order by score desc, a desc, g) as rank, g as phrase, a, l, r, n::bigint as n, score from worst where nth = 1) where rank <= {phrases.TOP}"""


def _spelling() -> str:
    """Near words meet where a letter less makes them equal, at the same place or as a whole word; crc32 is taken by its table of 256."""
    low, full, poly = 0xFF, 0xFFFFFFFF, 0xEDB88320
    letters = spelling.LETTERS.replace(r"\u00C0", "\u00c0").replace(r"\u00FF", "\u00ff")
    return f"""with recursive bits as (select i, i::bigint as c, 0 as k from range(256) r(i) union all select i, case when c & 1 = 1 then xor(c >> 1, {poly}) else c >> 1 end, k + 1 from bits where k < 8),
      tab as (select list(c order by i) as t from bits where k = 8),
      run as (select coalesce(doc_id::varchar, '') as d, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{letters}')) as r from documents),
      once as (select d, r, count(*) as m from run group by 1, 2),
      byte as (select d, r, m, flatten(list_transform(string_split(d || ':' || r, ''), lambda x: case when unicode(x) < 128 then [unicode(x)::bigint] else [192 + unicode(x)::bigint // 64, 128 + unicode(x)::bigint % 64] end)) as b from once),
      crc as (select d, r, m, xor(list_reduce(list_prepend({full}::bigint, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & {low}) + 1])), {full}) as h from byte, tab),
      said as (select m, case when h % {spelling.PLANTED} = 0 then r[:h % length(r)] || r[h % length(r) + 2:] else r end as w from crc),
      w as (select w, sum(m)::bigint as n from said where length(w) >= {spelling.SHORTEST} group by 1 having sum(m) >= {spelling.LEAST}),
      less as (select w, n, i, w[:i - 1] || w[i + 1:] as s from (select w, n, unnest(range(1, length(w) + 1)) as i from w)),
      pair as (select distinct a.w as a, b.w as b, b.n from less a join less b on a.s = b.s and a.i = b.i and a.w <> b.w union select distinct a.w, b.w, b.n from less a join w b on a.s = b.w union select distinct b.w, a.w, a.n from less a join w b on a.s = b.w),
      near as (select a, count(*) as n_near, max(n) as most from pair group by 1),
      form as (select w.w, w.n, coalesce(n_near, 0) as n_near, case when most >= {spelling.TIMES} * w.n then (select min(b) from pair where pair.a = w.w and pair.n = most) end as form, case when most >= {spelling.TIMES} * w.n then most end as form_n from w left join near on a = w.w),
      way as (select w, w as tip from form union all select way.w, form.form from way join form on form.w = tip where form.form is not null),
      root as (select way.w, tip as root from way join form on form.w = tip where form.form is null)
      select form.w as word, form, root, n, n_near, form_n from form join root using (w)"""


ORACLES = {"op1_quality_rules": _quality(), "op2_chat_format": _chat(), "op4_mixing": _mixing(), "op7_embedding_join": _embeddings(), "op9_ngram_join": _ngrams(), "op11_collocations": _collocations(), "op13_spelling": _spelling()}
