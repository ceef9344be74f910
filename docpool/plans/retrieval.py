"""Queries of the retrieval operators over the test tables, with their SQL.

A chunk's key and path are its record's. In the test tables NFKC changes full-width ASCII characters only, which
the SQL translates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docpool.functions.storage import materialize
from docpool.functions.text import norm_text, normalise_content, content_hash, substring_count, tokens
from docpool.operators.batches import hybrid_of_batch
from docpool.operators.chunker import chunk_documents, oversized_line, prose
from docpool.operators.fusion import SIGNAL_CAP, hits, hybrid, merge_order, merge_signals, reciprocal_ranks, signal_list, top
from docpool.operators.rerank import blend, candidate_count
from docpool.operators.retrieval import scan, search, search_batch
from docpool.operators.signals import score, score_batch
from docpool.sources.tables import table

#: The query, with a repeated token and an identifier; the one of hybrid_fallback finds next to nothing by words.
QUERY = "release index DES-044 release"
PHRASE = "The team behind"
RARE = "zzqx nothing"
TOP = 10
#: The chunk whose vector is the query's.
LIKE = 1

ASCII = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))


def _norm(column: str) -> str:
    return f"lower(translate({column}, '{WIDE}', '{ASCII}'))"


def _vector(spark: SparkSession, folder: str) -> list[float]:
    return list(table(spark, folder, "chunks").where(F.col("id") == LIKE).select("vector").first()[0])


def _scored(spark: SparkSession, folder: str, query: str = QUERY, signals: tuple[str, ...] = ("emb", "lex", "grep")) -> DataFrame:
    return score(table(spark, folder, "chunks"), query, _vector(spark, folder) if "emb" in signals else None, signals)


def ingest_normalize_hash(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's content hash, with a byte order mark put in front."""
    content = normalise_content(F.concat(F.lit("﻿"), "text"))
    return table(spark, folder, "documents").select("doc_id", content_hash(content).alias("hash"), F.length(content).cast("long").alias("n"))


def _chunked(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", normalise_content(F.col("text")).alias("content"))
    return chunk_documents(docs.where(~oversized_line(F.col("content"))), "content")


def chunk_size_split(spark: SparkSession, folder: str) -> DataFrame:
    """All chunks of all documents."""
    return _chunked(spark, folder).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "heading_path", "text")


def chunk_sections(spark: SparkSession, folder: str) -> DataFrame:
    """The number of chunks and of their characters by document."""
    return _chunked(spark, folder).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).cast("long").alias("n"))


def chunk_heading_path(spark: SparkSession, folder: str) -> DataFrame:
    """The number of chunks by heading path."""
    return _chunked(spark, folder).groupBy("heading_path").agg(F.count(F.lit(1)).alias("chunks"))


def embed_text(spark: SparkSession, folder: str) -> DataFrame:
    """The text to embed of every chunk of every document."""
    return _chunked(spark, folder).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "embed_text")


def prose_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """The length of every chunk's prose."""
    return table(spark, folder, "chunks").select("id", F.length(prose(normalise_content(F.col("text")))).cast("long").alias("n"))


def tokenize_tf(spark: SparkSession, folder: str) -> DataFrame:
    """How often the query's tokens occur in every chunk, and how many tokens it has itself."""
    read = table(spark, folder, "chunks").select("id", norm_text("text").alias("norm"))
    return read.select("id", F.size(tokens(F.col("norm"))).cast("long").alias("n_tokens"), *[substring_count(F.col("norm"), F.lit(t)).alias(n) for n, t in (("tf_release", "release"), ("tf_index", "index"), ("tf_id", "des-044"))])


def scan_key(spark: SparkSession, folder: str) -> DataFrame:
    """All chunks with path and series of their record; a hash stands for the text."""
    found = scan(table(spark, folder, "chunks"), table(spark, folder, "records"), table(spark, folder, "series_keys"))
    return found.select("id", "key", "path", F.array_join("series_keys", ",").alias("series"), F.sha2("text", 256).alias("hash"), F.coalesce(F.size("vector"), F.lit(0)).cast("long").alias("dim"))


def scan_key_series(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks of series main."""
    return scan(table(spark, folder, "chunks"), table(spark, folder, "records"), table(spark, folder, "series_keys"), series="main").select("id", "key", "path")


def scan_one_key(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks of the first key, and those of its series main."""
    key = table(spark, folder, "doc_keys").agg(F.min("key")).first()[0]
    tables = [table(spark, folder, t) for t in ("chunks", "records", "series_keys")]
    main = scan(*tables, key=key, series="main").select(F.lit("main").alias("series"), "id", "path")
    return scan(*tables, key=key).select(F.lit("").alias("series"), "id", "path").unionByName(main)


def search_modes(spark: SparkSession, folder: str) -> DataFrame:
    """The best chunks by each mode that needs no judge, with the score that is shown."""
    chunks, vector, out = table(spark, folder, "chunks"), _vector(spark, folder), None
    for mode in ("emb", "lex", "grep", "hybrid", "all"):
        hits_ = search(chunks, PHRASE if mode == "grep" else QUERY, vector, mode, TOP).hits
        part = hits_.select(F.lit(mode).alias("mode"), F.col("place").cast("long").alias("place"), "chunk_id", F.round("score", 6).alias("score"), F.array_join("origin_signals", ",").alias("origin_signals"))
        out = part if out is None else out.unionByName(part)
    return out


def emb_topk(spark: SparkSession, folder: str) -> DataFrame:
    return top(_scored(spark, folder, signals=("emb",)), [], "emb", TOP).select("place", "chunk_id", F.round("emb", 6).alias("emb"))


def emb_all_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder, signals=("emb",)).select("chunk_id", F.round("emb", 6).alias("emb"))


def lex_topk(spark: SparkSession, folder: str) -> DataFrame:
    return top(_scored(spark, folder, signals=("lex",)).where(F.col("lex") > 0), [], "lex", TOP).select("place", "chunk_id", F.round("lex", 6).alias("lex"))


def lex_id_bonus(spark: SparkSession, folder: str) -> DataFrame:
    """All scores for an identifier that is asked twice."""
    return _scored(spark, folder, "DES-044 or des-044", ("lex",)).where(F.col("lex") > 0).select("chunk_id", F.round("lex", 6).alias("lex"))


def lex_phrase_bonus(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder, PHRASE, ("lex",)).where(F.col("lex") > 0).select("chunk_id", F.round("lex", 6).alias("lex"))


def grep_topk(spark: SparkSession, folder: str) -> DataFrame:
    return top(_scored(spark, folder, " release ", ("grep",)).where(F.col("grep") > 0), [], "grep", TOP).select("place", "chunk_id", "grep")


def hybrid_rrf(spark: SparkSession, folder: str) -> DataFrame:
    """Reciprocal ranks of all chunks, before the guarantee."""
    return reciprocal_ranks(_scored(spark, folder, signals=("emb", "lex")), []).select("chunk_id", F.round("rrf", 8).alias("rrf"))


def _hybrid(spark: SparkSession, folder: str, query: str) -> DataFrame:
    found = hybrid(materialize(_scored(spark, folder, query, ("emb", "lex")), "scores"), [], TOP)
    signals = F.array_join(signal_list(F.col("emb") > 0, F.col("lex") > 0, F.lit(False)), ",")
    return found.select("place", "chunk_id", F.round("rrf", 6).alias("rrf"), signals.alias("origin_signals"))


def hybrid_topk_guarantee(spark: SparkSession, folder: str) -> DataFrame:
    return _hybrid(spark, folder, QUERY)


def hybrid_emb_fallback(spark: SparkSession, folder: str) -> DataFrame:
    return _hybrid(spark, folder, RARE)


def merge_all(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: the best chunks over all three signals, with score and origin."""
    found = search(table(spark, folder, "chunks"), QUERY, _vector(spark, folder), "all", TOP).hits
    return found.select("place", "chunk_id", "path", F.round("score", 6).alias("score"), F.array_join("origin_signals", ",").alias("origin_signals"))


def stage_stats(spark: SparkSession, folder: str) -> DataFrame:
    return hits(_scored(spark, folder), [])


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    """Every logged query with its key; its vector is that of its first chunk."""
    asked = table(spark, folder, "search_results").groupBy("query_id").agg(F.min("key").alias("key"), F.min("query_text").alias("query"), F.min("chunk_id").alias("chunk_id"))
    vectors = table(spark, folder, "chunks").select(F.col("id").alias("chunk_id"), "vector")
    return asked.join(vectors, "chunk_id", "left")


def _batch(spark: SparkSession, folder: str, cap: int | None = None) -> DataFrame:
    """Every logged query against all chunks of its key."""
    return score_batch(table(spark, folder, "chunks"), _asked(spark, folder), cap)


def merge_all_batch(spark: SparkSession, folder: str) -> DataFrame:
    return search_batch(_batch(spark, folder, max(TOP, SIGNAL_CAP)), "all", TOP).select("query_id", "place", "chunk_id", F.array_join("origin_signals", ",").alias("origin_signals"))


def hybrid_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Every logged query against all chunks of its key."""
    return hybrid_of_batch(table(spark, folder, "chunks"), _asked(spark, folder), TOP).select("query_id", "place", "chunk_id", F.round("rrf", 6).alias("rrf"))


def rerank_blend(spark: SparkSession, folder: str) -> DataFrame:
    """The merge reordered by made-up scores, of which some are missing."""
    merged = merge_signals(_scored(spark, folder), [], TOP)
    ordered = merge_order(merged, [], 30)
    fake = F.when(F.col("chunk_id") % 7 == 0, -1.0).otherwise((F.col("chunk_id") * 37 % 101) / 100)
    judged = ordered.withColumn("rerank", F.when(F.col("place") <= candidate_count(30, TOP), fake))
    return blend(judged, [], TOP).select("place", "chunk_id", F.round("rerank", 6).alias("rerank"))


def rerank_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Without a judge the merge order stands, with a score of 0."""
    found = search(table(spark, folder, "chunks"), QUERY, _vector(spark, folder), "rerank", TOP).hits
    return found.select("place", "chunk_id", "score")


_CHUNKS = r"""
with md as (select doc_id, regexp_replace(regexp_replace(text, '^\x{FEFF}', ''), '\r\n?', chr(10), 'g') as c from documents where text is not null),
ls as (select doc_id, c, string_split(c, chr(10)) as l from md),
ln as (select doc_id, unnest(l) as line, generate_subscripts(l, 1) as n from ls),
lv as (select *, case when regexp_matches(line, '^#{1,6}([ \t]|$)') then length(regexp_extract(line, '^#+')) end as lvl,
              regexp_replace(regexp_replace(line, '^#+', ''), '^\s+|\s+$', '', 'g') as title from ln),
ps as (select *, max(n) filter (lvl = 1) over w as p1, max(n) filter (lvl = 2) over w as p2, max(n) filter (lvl = 3) over w as p3,
              max(n) filter (lvl = 4) over w as p4, max(n) filter (lvl = 5) over w as p5, max(n) filter (lvl = 6) over w as p6,
              sum(case when lvl is not null then 1 else 0 end) over w as sid from lv window w as (partition by doc_id order by n rows unbounded preceding)),
hd as (select doc_id, sid, list_filter([case when lvl >= 1 then p1 end, case when lvl >= 2 and p2 > coalesce(p1, 0) then p2 end,
              case when lvl >= 3 and p3 > greatest(coalesce(p1, 0), coalesce(p2, 0)) then p3 end,
              case when lvl >= 4 and p4 > greatest(coalesce(p1, 0), coalesce(p2, 0), coalesce(p3, 0)) then p4 end,
              case when lvl >= 5 and p5 > greatest(coalesce(p1, 0), coalesce(p2, 0), coalesce(p3, 0), coalesce(p4, 0)) then p5 end,
              case when lvl >= 6 and p6 > greatest(coalesce(p1, 0), coalesce(p2, 0), coalesce(p3, 0), coalesce(p4, 0), coalesce(p5, 0)) then p6 end], lambda x: x is not null) as open_at from ps where lvl is not null),
un as (select doc_id, sid, unnest(open_at) as n from hd),
hp as (select un.doc_id, un.sid, string_agg(title, ' > ' order by un.n) as heading_path from un join lv on lv.doc_id = un.doc_id and lv.n = un.n group by all),
sec as (select doc_id, sid, rtrim(string_agg(line, chr(10) order by n), chr(10)) as text from ps group by all),
every as (select doc_id, sid, coalesce(heading_path, '') as heading_path, text from sec left join hp using (doc_id, sid) where text <> ''
         union all select doc_id, 0, '', c from md where doc_id not in (select doc_id from sec where text <> '')),
sz as (select *, length(text) as n, case when length(text) > 1500 then ceil(length(text)::double / ceil(length(text) / 1500.0))::int else greatest(length(text), 1) end as psz from every),
ch as (select doc_id, sid, heading_path, unnest(range(0, greatest(n, 1), psz)) as st, psz, text from sz),
ck as (select doc_id, row_number() over (partition by doc_id order by sid, st) - 1 as chunk_index, heading_path, substr(text, (st + 1)::bigint, psz) as text from ch),
tr as (select *, regexp_replace(coalesce(list_aggregate(list_filter(string_split(text, chr(10)), lambda x: not starts_with(x, '#')), 'string_agg', chr(10)), ''), '^[\s\x{85}\x{A0}\x{3000}]+|[\s\x{85}\x{A0}\x{3000}]+$', '', 'g') as prose from ck),
em as (select *, case when length(prose) >= 50 then prose else coalesce(last_value(case when length(prose) >= 50 then prose end ignore nulls)
              over (partition by doc_id order by chunk_index rows between unbounded preceding and 1 preceding), prose) end as body from tr)
"""


def _signals(query: str) -> str:
    return f"""
with q as (select '{query}' as query, {_norm(f"'{query}'")} as nq, (select vector::double[] from chunks where id = {LIKE}) as qv),
tok as (select t, count(*) as mult from (select unnest(regexp_extract_all(nq, '[A-Za-z]+-[0-9]+|[A-Za-z0-9_]+|[^\\x00-\\x7F]+')) as t from q) group by t),
c as (select id as chunk_id, path, coalesce({_norm("text")}, '') as body, vector::double[] as v from chunks),
st as (select count(*) as n, avg(length(body)) as avgdl from c),
tf as (select chunk_id, t, mult, length(body) as dl, (length(body) - length(replace(body, t, ''))) / length(t) as tf from c cross join tok),
df as (select t, count(*) as df from tf where tf > 0 group by t),
bm as (select chunk_id, sum(mult * ln((n - df + 0.5::double) / (df + 0.5::double) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as s from tf join df using (t) cross join st where tf > 0 group by 1),
sig as (select c.chunk_id, path,
  round(case when len(v) = len(qv) and list_sum(list_transform(v, lambda x: x * x)) > 0 then list_cosine_similarity(v, qv) else 0 end, 9) as emb,
  round(coalesce(bm.s, 0) + case when exists(from tok) and contains(body, nq) then 2 else 0 end
   + case when exists(from tok) then coalesce(list_sum(list_transform(regexp_extract_all(nq, '[a-z]+-[0-9]+'), lambda m: case when contains(body, m) then 10.0::double else 0.0::double end)), 0) else 0 end, 9) as lex,
  case when trim(query) = '' then 0 else ((length(body) - length(replace(body, trim(nq), ''))) / length(trim(nq)))::bigint end as grep
  from c left join bm using (chunk_id) cross join q),
rk as (select *, row_number() over (order by emb desc, chunk_id) as re, row_number() over (order by lex desc, chunk_id) as rl, count(*) filter (emb > 0) over () as eh, count(*) filter (lex > 0) over () as lh from sig),
rr as (select *, (eh > 0 and lh / eh < 0.05) as fb, case when eh > 0 and lh / eh < 0.05 then emb else 1.0::double / (60 + re) + case when lex > 0 then 1.0::double / (60 + rl) else 0 end end as rrf0 from rk),
fu as (select *, row_number() over (order by rrf0 desc, chunk_id) as rf from rr),
pr as (select *, max(case when rf <= 5 and re > 5 then rrf0 end) over () as thr from fu),
hy as (select *, case when not fb and re <= 5 and rf > 5 and thr is not null then thr + (6 - re) * 1e-9 else rrf0 end as rrf from pr),
mg as (select *, case when emb > 0 and re <= 30 then 1 else 0 end as fe, case when lex > 0 and rl <= 30 then 1 else 0 end as fl, case when grep > 0 then 1 else 0 end as fg from hy),
mo as (select *, row_number() over (order by fe + fl + fg desc, emb desc, chunk_id) as place from mg where fe + fl + fg > 0)
"""


_HYBRID = """select row_number() over (order by rrf desc, chunk_id) as place, chunk_id, round(rrf, 6) as rrf,
  concat_ws(',', case when emb > 0 then 'emb' end, case when lex > 0 then 'lex' end) as origin_signals from hy order by rrf desc, chunk_id limit 10"""

_BATCH = f"""
with q0 as (select query_id, min(key) as key, min(query_text) as query, min(chunk_id) as chunk_id from search_results group by 1),
q as (select query_id, q0.key, {_norm("query")} as nq, c.vector::double[] as qv from q0 left join chunks c on c.id = q0.chunk_id),
c as (select id as chunk_id, key, coalesce({_norm("text")}, '') as body, vector::double[] as v from chunks),
p as (select query_id, c.chunk_id, nq, qv, body, v from q join c using (key)),
st as (select query_id, count(*) as n, avg(length(body)) as avgdl from p group by 1),
tok as (select query_id, t, count(*) as mult from (select query_id, unnest(regexp_extract_all(nq, '[A-Za-z]+-[0-9]+|[A-Za-z0-9_]+|[^\\x00-\\x7F]+')) as t from q) group by 1, 2),
tf as (select query_id, chunk_id, t, mult, length(body) as dl, (length(body) - length(replace(body, t, ''))) / length(t) as tf from p join tok using (query_id)),
df as (select query_id, t, count(*) as df from tf where tf > 0 group by 1, 2),
bm as (select query_id, chunk_id, sum(mult * ln((n - df + 0.5::double) / (df + 0.5::double) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as s from tf join df using (query_id, t) join st using (query_id) where tf > 0 group by 1, 2),
sig as (select query_id, chunk_id, round(case when len(v) = len(qv) and list_sum(list_transform(v, lambda x: x * x)) > 0 and list_sum(list_transform(qv, lambda x: x * x)) > 0 then list_cosine_similarity(v, qv) else 0 end, 9) as emb,
  round(coalesce(bm.s, 0) + case when contains(body, nq) then 2 else 0 end + coalesce(list_sum(list_transform(regexp_extract_all(nq, '[a-z]+-[0-9]+'), lambda m: case when contains(body, m) then 10.0::double else 0.0::double end)), 0), 9) as lex,
  ((length(body) - length(replace(body, trim(nq), ''))) / length(trim(nq)))::bigint as grep from p left join bm using (query_id, chunk_id)),
rk as (select *, row_number() over (partition by query_id order by emb desc, chunk_id) as re, row_number() over (partition by query_id order by lex desc, chunk_id) as rl, count(*) filter (emb > 0) over (partition by query_id) as eh, count(*) filter (lex > 0) over (partition by query_id) as lh from sig),
rr as (select *, (eh > 0 and lh / eh < 0.05) as fb, case when eh > 0 and lh / eh < 0.05 then emb else 1.0::double / (60 + re) + case when lex > 0 then 1.0::double / (60 + rl) else 0 end end as rrf0 from rk),
fu as (select *, row_number() over (partition by query_id order by rrf0 desc, chunk_id) as rf from rr),
pr as (select *, max(case when rf <= 5 and re > 5 then rrf0 end) over (partition by query_id) as thr from fu),
hy as (select *, case when not fb and re <= 5 and rf > 5 and thr is not null then thr + (6 - re) * 1e-9 else rrf0 end as rrf from pr),
mg as (select *, case when emb > 0 and re <= 30 then 1 else 0 end as fe, case when lex > 0 and rl <= 30 then 1 else 0 end as fl, case when grep > 0 then 1 else 0 end as fg from hy),
mo as (select *, row_number() over (partition by query_id order by fe + fl + fg desc, emb desc, chunk_id) as place from mg where fe + fl + fg > 0),
ho as (select *, row_number() over (partition by query_id order by rrf desc, chunk_id) as place from hy)
"""
_FLAGS = "concat_ws(',', case when fe = 1 then 'emb' end, case when fl = 1 then 'lex' end, case when fg = 1 then 'grep' end) as origin_signals"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q
    for q in (
        ingest_normalize_hash, chunk_sections, chunk_heading_path, chunk_size_split, embed_text, prose_lengths, tokenize_tf, scan_key, scan_key_series, scan_one_key, search_modes,
        emb_topk, emb_all_scores, lex_topk, lex_id_bonus, lex_phrase_bonus, grep_topk, hybrid_rrf, hybrid_emb_fallback, hybrid_topk_guarantee,
        merge_all, merge_all_batch, hybrid_batch, rerank_blend, rerank_fallback, stage_stats,
    )
}

ORACLE = {
    "ingest_normalize_hash": r"select doc_id, sha256(c) as hash, length(c) as n from (select doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') as c from documents)",
    "chunk_size_split": _CHUNKS + "select doc_id, chunk_index, heading_path, text from ck",
    "chunk_sections": _CHUNKS + "select doc_id, count(*) as chunks, sum(length(text))::bigint as n from ck group by 1",
    "chunk_heading_path": _CHUNKS + "select heading_path, count(*) as chunks from ck group by 1",
    "embed_text": _CHUNKS + "select doc_id, chunk_index, case when heading_path <> '' and body <> '' then heading_path || chr(10) || chr(10) || body when heading_path <> '' then heading_path when body <> '' then body else text end as embed_text from em",
    "prose_lengths": r"""select id, length(regexp_replace(coalesce(list_aggregate(list_filter(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), lambda x: not starts_with(x, '#')), 'string_agg', chr(10)), ''),
        '^[\s\x{85}\x{A0}\x{3000}]+|[\s\x{85}\x{A0}\x{3000}]+$', '', 'g')) as n from chunks""",
    "tokenize_tf": f"""with c as (select id, {_norm("text")} as b from chunks) select id, len(regexp_extract_all(b, '[A-Za-z]+-[0-9]+|[A-Za-z0-9_]+|[^\\x00-\\x7F]+')) as n_tokens,
        ((length(b) - length(replace(b, 'release', ''))) / 7)::bigint as tf_release, ((length(b) - length(replace(b, 'index', ''))) / 5)::bigint as tf_index, ((length(b) - length(replace(b, 'des-044', ''))) / 7)::bigint as tf_id from c""",
    "scan_key": "select c.id, r.key, r.path, s.series, sha256(c.text) as hash, coalesce(len(c.vector), 0) as dim from chunks c join records r on r.id = c.record_id left join (select record_id, string_agg(distinct series, ',' order by series) as series from series_keys group by 1) s on s.record_id = r.id",
    "scan_key_series": "select c.id, r.key, r.path from chunks c join records r on r.id = c.record_id where r.id in (select record_id from series_keys where series = 'main')",
    "scan_one_key": """with c as (select c.id, r.path, r.id as rid from chunks c join records r on r.id = c.record_id where r.key = (select min(key) from doc_keys))
        select '' as series, id, path from c union all select 'main', id, path from c where rid in (select record_id from series_keys where series = 'main')""",
    "search_modes": _signals(QUERY) + f"""
        select 'emb' as mode, re as place, chunk_id, round(emb, 6) as score, 'emb' as origin_signals from rk where re <= 10
        union all select 'lex', rl, chunk_id, round(lex, 6), 'lex' from rk where rl <= 10 and lex > 0
        union all select 'grep', place, chunk_id, grep, 'grep' from ({_signals(PHRASE)} select row_number() over (order by grep desc, chunk_id) as place, chunk_id, grep::double as grep from sig where grep > 0) where place <= 10
        union all select 'hybrid', place, chunk_id, round(rrf, 6), s from (select *, row_number() over (order by rrf desc, chunk_id) as place, concat_ws(',', case when emb > 0 then 'emb' end, case when lex > 0 then 'lex' end) as s from hy) where place <= 10
        union all select 'all', place, chunk_id, round(greatest(emb, lex, grep), 6), {_FLAGS.removesuffix(' as origin_signals')} from mo where place <= 10""",
    "emb_topk": _signals(QUERY) + "select re as place, chunk_id, round(emb, 6) as emb from rk where re <= 10",
    "emb_all_scores": _signals(QUERY) + "select chunk_id, round(emb, 6) as emb from sig",
    "lex_topk": _signals(QUERY) + "select rl as place, chunk_id, round(lex, 6) as lex from rk where rl <= 10 and lex > 0",
    "lex_id_bonus": _signals("DES-044 or des-044") + "select chunk_id, round(lex, 6) as lex from sig where lex > 0",
    "lex_phrase_bonus": _signals(PHRASE) + "select chunk_id, round(lex, 6) as lex from sig where lex > 0",
    "grep_topk": _signals(" release ") + "select row_number() over (order by grep desc, chunk_id) as place, chunk_id, grep from sig where grep > 0 order by grep desc, chunk_id limit 10",
    "hybrid_rrf": _signals(QUERY) + "select chunk_id, round(rrf0, 8) as rrf from rr",
    "hybrid_topk_guarantee": _signals(QUERY) + _HYBRID,
    "hybrid_emb_fallback": _signals(RARE) + _HYBRID,
    "merge_all": _signals(QUERY) + f"select place, chunk_id, path, round(greatest(emb, lex, grep), 6) as score, {_FLAGS} from mo where place <= 10",
    "merge_all_batch": _BATCH + f"select query_id, place, chunk_id, {_FLAGS} from mo where place <= 10",
    "hybrid_batch": _BATCH + "select query_id, place, chunk_id, round(rrf, 6) as rrf from ho where place <= 10",
    "rerank_blend": _signals(QUERY) + """, f as (select *, case when chunk_id % 7 = 0 then -1.0::double else (chunk_id * 37 % 101) / 100.0::double end as rerank from mo where place <= 30)
        select row_number() over (order by rerank desc, emb desc, chunk_id) as place, chunk_id, round(rerank, 6) as rerank from f order by rerank desc, emb desc, chunk_id limit 10""",
    "rerank_fallback": _signals(QUERY) + "select place, chunk_id, 0.0::double as score from mo where place <= 10",
    "stage_stats": _signals(QUERY) + "select count(*) filter (emb > 0) as emb_candidates, count(*) filter (lex > 0) as lex_candidates, count(*) filter (grep > 0) as grep_candidates from sig",
}
