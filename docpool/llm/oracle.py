"""SQL of the queries that SQL can express.

In the test tables NFKC changes full-width ASCII characters only, which WIDE and ASCII translate.
"""

from __future__ import annotations

ASCII = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))


def _plain(column: str) -> str:
    return f"lower(translate({column}, '{WIDE}', '{ASCII}'))"


def _reduced(column: str) -> str:
    return f"regexp_replace({_plain(column)}, '[^\\p{{L}}\\p{{N}}]', '', 'g')"


#: Residue by family, of text whose code is masked; what must not stand beside a mark is matched with it, as there is no look-around.
_WORD = r"\p{L}\p{N}_"
_FAMILIES = {
    "html": r"(?i)</?(?:a|abbr|b|blockquote|br|code|dd|div|dl|dt|em|h[1-6]|hr|i|img|kbd|li|ol|p|pre|s|small|span|strong|sub|sup|table|tbody|td|th|thead|tr|u|ul)(?:\s[^<>]*)?/?>|<!--|&(?:[a-z]{2,8}|#[0-9]+|#x[0-9a-f]+);",
    "wiki": r"(?m)\[\[[^\n]+?\]\]|\{\{[^\n]+?\}\}|''[^\n]+?''|^={2,6}[^=\n](?:[^\n]*[^=\n])?={2,6}[ \t]*$|^\{\|",
    "latex": rf"(?m)\\[A-Za-z]+\*?\{{|\\[(\[]|\$\$(?:[^$]|\$[^$])+\$\$|(?:^|[^{_WORD}$])\$(?:[\\^_]|[\\^_][^$\n]*[^\s$]|[^\s$][^$\n]*[\\^_](?:[^$\n]*[^\s$])?)\$(?:$|[^{_WORD}$])",
    "markdown": rf"(?m)(?:^|[^{_WORD}])(?:\*\*[^\n]+?\*\*|__[^\n]+?__)(?:$|[^{_WORD}])|(?:^|[^{_WORD}*])\*(?:[^\s*]|[^\s*][^*\n]*[^\s*])\*(?:$|[^{_WORD}*])|~~[^\n]+?~~|\[[^\n]+?\]\([^\n]+?\)|^\|[^\n]*\|[ \t]*$|^> ",
}
_FENCED = r"(?m)^(?:```[^\n]*(?:\n[^\n]*)*?(?:\n```[^\n]*|\z)|~~~[^\n]*(?:\n[^\n]*)*?(?:\n~~~[^\n]*|\z))"
_FIELDS = "select id as chunk_id, 'text' as field, text as t from chunks where text is not null union all select id, 'embed_text', embed_text from chunks where embed_text is not null"
_BARE = rf"regexp_replace(regexp_replace(regexp_replace(t, '\r\n?', chr(10), 'g'), '{_FENCED}', chr(1), 'g'), '``[^\n]+?``|`[^`\n]+`', chr(1), 'g')"


def _residue() -> str:
    parts = [f"select chunk_id, field, '{f}' as family from m where regexp_matches(t, '{p.replace(chr(39), chr(39) * 2)}')" for f, p in _FAMILIES.items()]
    return f"with f as ({_FIELDS}), m as (select chunk_id, field, {_BARE} as t from f) " + " union all ".join(parts)


#: Chunks over the limit of their key, with LF line ends; a block is a run of fences and lines that are not blank.
_LIMITED = r"""
with l as (select key, max_chunk_size as n from (select *, row_number() over (partition by key order by updated_at desc nulls last, max_chunk_size desc nulls last, overlap_size desc nulls last) as place from chunker_config where key is not null) where place = 1),
c as (select id, heading_path, text, case when l.key is null then 1500 when l.n > 0 then l.n else 8192 end as n from chunks left join l using (key)),
o as (select id, heading_path, n, regexp_replace(text, '\r\n?', chr(10), 'g') as t from c where length(text) > n)
"""
_UNIT = r"(?:```[^\n]*(?:\n[^\n]*)*?(?:\n```[^\n]*|\z)|~~~[^\n]*(?:\n[^\n]*)*?(?:\n~~~[^\n]*|\z)|[^\n]*[^\s\x{85}\x{a0}\x{3000}][^\n]*)"

#: Documents with their tokens; the lookahead of the pre-tokeniser's pattern is made up for by counting again what it parts.
_SIZED = r"""
with limits as (select lower(trim(source)) as s, min(capacity_tokens) as c from pack_limits group by 1),
d as (select doc_id, lower(trim(source)) as s, coalesce(n_tokens,
      len(regexp_extract_all(text, '''s|''t|''re|''ve|''m|''ll|''d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+')) + len(regexp_extract_all(text, '\s[\t\n\r\f]\S')), 0) as n from documents)
"""

ORACLE = {
    "p5_ranking": """
with raw as (select query_id, chunk_id, unnest(['emb', 'lex', 'grep', 'rerank']) as signal,
       unnest([score_breakdown.emb, score_breakdown.lex, score_breakdown.grep, nullif(score_breakdown.rerank, -1)]) as v from search_results where chunk_id is not null),
s as (select query_id, chunk_id, signal, max(case when isnan(v) then null else v end) as v from raw group by all),
r as (select *, rank() over (partition by query_id, signal order by v desc nulls last) as rk from s),
m as (select query_id, chunk_id, list_sort(list(rk))[2] as median_rank, avg(rk) as mean_rank from r group by all)
select query_id, chunk_id, row_number() over (partition by query_id order by median_rank, mean_rank, chunk_id) as place, median_rank, mean_rank from m
""",
    "p6_nearest": """
with v as (select id, vector::double[64] as v from chunks where len(vector) = 64 and list_sum(list_transform(vector, lambda x: abs(x))) > 0),
p as (select a.id as id, b.id as neighbour, array_cosine_similarity(a.v, b.v) as c from v a join v b on a.id <> b.id where a.id % 100 = 0),
k as (select *, row_number() over (partition by id order by round(c, 6) desc, neighbour) as place from p)
select id, neighbour, place from k where place <= 5
""",
    "p7_found": _LIMITED + rf"""
select id as chunk_id, case when coalesce(list_max(list_transform(regexp_extract_all(t, '(?m)^{_UNIT}(?:\n{_UNIT})*'), lambda x: length(x))), 0) <= n then 'block'
       when list_max(list_transform(string_split(t, chr(10)), lambda x: length(x))) <= n then 'line' else 'char' end as boundary from o
""",
    "p7_whole": _LIMITED + "select id as chunk_id, heading_path, length(t) as chars, true as within from o",
    "p3_found": _residue(),
    "p1_found": f"""
with rows as (select 'chunk' as kind, id as row_id, text from chunks union all select 'hit', hit_id, text from search_results where text is not null),
used as (select kind, row_id, unnest(regexp_extract_all({_plain("text")}, '[A-Za-z]+-[0-9]+|[A-Za-z0-9_]+|[^\\x00-\\x7F]+')) as term from rows),
n as (select kind, row_id, term, count(*) as uses from used where length(term) >= 3 and regexp_matches(term, '[a-z]') group by all),
r as (select kind, term from n group by all having count(*) between 2 and 6)
select kind, row_id, term from n join r using (kind, term) where uses >= 3
""",
    "p1_top": f"""
with rows as (select 'chunk' as kind, id as row_id, text from chunks union all select 'hit', hit_id, text from search_results where text is not null),
used as (select kind, row_id, unnest(regexp_extract_all({_plain("text")}, '[A-Za-z]+-[0-9]+|[A-Za-z0-9_]+|[^\\x00-\\x7F]+')) as term from rows),
n as (select kind, row_id, term, count(*)::double as k from used where length(term) >= 3 and regexp_matches(term, '[a-z]') group by all),
c as (select *, sum(k) over (partition by kind, row_id) as r, sum(k) over (partition by kind, term) as c, count(*) over (partition by kind, term) as n_rows, sum(k) over (partition by kind) as t from n),
g as (select kind, row_id, term, 2 * (k * ln(k * t / (r * c)) + case when c - k > 0 then (c - k) * ln((c - k) * t / ((t - r) * c)) else 0 end
      + case when r - k > 0 then (r - k) * ln((r - k) * t / (r * (t - c))) else 0 end + case when t - r - c + k > 0 then (t - r - c + k) * ln((t - r - c + k) * t / ((t - r) * (t - c))) else 0 end) as score from c where n_rows >= 2 and k * t > r * c),
p as (select *, row_number() over (partition by kind, row_id order by round(score, 6) desc, term) as place from g)
select kind, row_id, term, place, round(score, 4) as score from p where place <= 5
""",
    "p5_found": """
with raw as (select query_id, chunk_id, unnest(['emb', 'lex', 'grep', 'rerank']) as signal,
       unnest([score_breakdown.emb, score_breakdown.lex, score_breakdown.grep, nullif(score_breakdown.rerank, -1)]) as v from search_results where chunk_id is not null),
s as (select query_id, chunk_id, signal, max(case when isnan(v) then null else v end) as v from raw group by all),
r as (select *, count(v) over w as have, max(v) over w as best from s window w as (partition by query_id, signal)),
f as (select *, count(*) filter (v = best) over (partition by query_id, signal) as firsts from r),
c as (select query_id, chunk_id, count(*) filter (v = best and firsts = 1) as sole, sum(coalesce(v, 0)) as total from f group by all),
g as (select *, max(total) over (partition by query_id) as greatest from c)
select query_id, chunk_id from g where sole >= 3 and greatest > total
""",
    "p6_found": """
with v as (select id, vector::double[64] as v from chunks where len(vector) = 64 and list_sum(list_transform(vector, lambda x: abs(x))) > 0),
p as (select a.id as a, b.id as b, array_cosine_similarity(a.v, b.v) as c from v a join v b on a.id <> b.id),
k as (select *, row_number() over (partition by a order by round(c, 6) desc, b) as n from p where c >= 0.95)
select x.a as id_a, x.b as id_b from k x join k y on x.a = y.b and x.b = y.a where x.n <= 5 and y.n <= 5 and x.a < x.b
""",
    "p8_found": _SIZED + "select doc_id from d left join limits on d.s = limits.s and d.s <> 'default' where n > coalesce(c, (select c from limits where s = 'default'))",
    "p8_full": _SIZED + "select case when c is not null then d.s else 'default' end as source, sum(n)::bigint as tokens, true as within, true as numbered from d left join limits on d.s = limits.s and d.s <> 'default' group by 1",
    "p9_found": f"""
with d as (select doc_id, {_reduced("text")} as t from documents), i as (select item_id, {_reduced("text")} as t from eval_items),
w as (select item_id, substr(t, n, 40) as run from (select item_id, t, unnest(range(1, length(t) - 38)) as n from i)),
x as (select doc_id, substr(t, n, 40) as run from (select doc_id, t, unnest(range(1, length(t) - 38)) as n from d))
select distinct doc_id, item_id from x join w using (run)
""",
    "p9_passages": f"""
with d as (select doc_id, {_reduced("text")} as t, list_filter(range(1, length(text) + 1), lambda k: regexp_matches({_plain("text[k]")}, '[\\p{{L}}\\p{{N}}]')) as place from documents),
i as (select item_id, {_reduced("text")} as t from eval_items),
w as (select item_id, n, substr(t, n, 40) as run from (select item_id, t, unnest(range(1, length(t) - 38)) as n from i)),
x as (select doc_id, n, substr(t, n, 40) as run from (select doc_id, t, unnest(range(1, length(t) - 38)) as n from d)),
m as (select doc_id, item_id, x.n as a, x.n - w.n as diagonal from x join w using (run)),
g as (select *, a - row_number() over (partition by doc_id, item_id, diagonal order by a) as island from m),
r as (select doc_id, item_id, min(a) as a, count(*) + 39 as run from g group by doc_id, item_id, diagonal, island),
b as (select *, row_number() over (partition by doc_id, item_id order by run desc, a) as n from r)
select doc_id, item_id, run, place[a] - 1 as doc_start, place[a + run - 1] as doc_end, round(run / length(i.t), 6) as item_share from b join d using (doc_id) join i using (item_id) where n = 1
""",
    "p10_found": f"""
with d as (select doc_id, {_reduced("text")} as t from documents),
w as (select doc_id, substr(t, n, 20) as run from (select doc_id, t, unnest(range(1, length(t) - 18)) as n from d where length(t) >= 100))
select doc_id from w group by doc_id having (count(*) - count(distinct run)) / count(*) >= 0.3
""",
    "p10_shares": f"""
with d as (select doc_id, {_reduced("text")} as t from documents),
w as (select doc_id, substr(t, n, 20) as run from (select doc_id, t, unnest(range(1, length(t) - 18)) as n from d where length(t) >= 100)),
s as (select doc_id, (count(*) - count(distinct run)) / count(*) as windows from w group by doc_id)
select doc_id, coalesce(length(t), 0) as chars, round(coalesce(windows, 0.0), 9) as windows from d left join s using (doc_id)
""",
    "p2_classes": r"""
with f as (select id, trim(regexp_replace(lower(text), '[\s\x{3000}\x{a0}]+', ' ', 'g')) as t from chunks),
m as (select id, t, min(id) over (partition by t) as rep from f where length(t) >= 200),
g as (select distinct id, substr(t, n, 5) as s from (select id, t, unnest(range(1, length(t) - 3)) as n from m where id = rep)),
c as (select id, count(*) as n from g group by id),
p as (select a.id as a, b.id as b, count(*) as common from g a join g b on a.s = b.s and a.id < b.id group by all),
l as (select a, b from p join c x on x.id = a join c y on y.id = b where common >= 0.7 * (x.n + y.n - common)),
e as (select rep, count(*) as links from (select a as rep from l union all select b from l) group by rep)
select id, rep as class_id, coalesce(links, 0) as links from m left join e using (rep)
""",
    "p2_found": r"""
with f as (select id, trim(regexp_replace(lower(text), '[\s\x{3000}\x{a0}]+', ' ', 'g')) as t from chunks),
g as (select distinct id, substr(t, n, 5) as s from (select id, t, unnest(range(1, length(t) - 3)) as n from f where length(t) >= 200)),
c as (select id, count(*) as n from g group by id),
p as (select a.id as a, b.id as b, count(*) as common from g a join g b on a.s = b.s and a.id < b.id group by all),
q as (select distinct id, key, path, substr(lower(path), n, 3) as s from (select id, key, path, unnest(range(1, length(path) - 1)) as n from records)),
e as (select id, count(*) as n from q group by id),
r as (select a.id as a, b.id as b, count(*) as common from q a join q b on a.key = b.key and a.s = b.s and a.id < b.id and a.path <> b.path group by all)
select 'chunk' as kind, a as id_a, b as id_b from p join c x on x.id = a join c y on y.id = b where common >= 0.7 * (x.n + y.n - common)
union all select 'path', a, b from r join e x on x.id = a join e y on y.id = b where common >= 0.8 * (x.n + y.n - common)
""",
}
