"""Queries of the state transitions over the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docpool.operators import transitions as tr
from docpool.operators.snapshots import clean_hash, clean_path
from docpool.plans.snapshots import _CHANGES, p4_found
from docpool.schema import CHUNKS, EMBEDDINGS, PENDING
from docpool.sources.content import sources_given
from docpool.sources.embedding import HashEmbedder
from docpool.sources.tables import table

NOW = datetime(2025, 12, 1)
CUTOFF = datetime(2025, 9, 1)
RETENTION = 400 * 86400


def _state(spark: SparkSession, folder: str) -> tr.State:
    """The test tables as a state; its reservations are the paths that done jobs no longer delivered."""
    keys, records = table(spark, folder, "doc_keys"), table(spark, folder, "records")
    chunks = table(spark, folder, "chunks")
    vectors = chunks.where(F.size("vector") > 0).select(F.col("id").alias("chunk_id"), "vector", F.size("vector").alias("dim"))
    return tr.State(keys, records, table(spark, folder, "series_keys"), chunks.select(*[f.split()[0] for f in CHUNKS.split(", ")]), vectors, _pending(spark, folder))


def _pending(spark: SparkSession, folder: str) -> DataFrame:
    jobs = table(spark, folder, "sync_jobs").select("job_id", "key", "series", "started_at").dropDuplicates(["job_id"])
    removed = p4_found(spark, folder).where(F.col("change") == "removed").join(jobs, "job_id")
    return removed.groupBy("key", "series", "path").agg(F.max("started_at").alias("marked_at"))


def list_indexes(spark: SparkSession, folder: str) -> DataFrame:
    listed = tr.list_keys(table(spark, folder, "doc_keys"), table(spark, folder, "records"), table(spark, folder, "series_keys"), table(spark, folder, "chunks"))
    return listed.select("key", "doc_count", "chunk_count", F.array_join("series", ",").alias("series"))


def list_trashed(spark: SparkSession, folder: str) -> DataFrame:
    return tr.list_trashed(table(spark, folder, "doc_keys"), RETENTION, NOW).select("key", "doc_count", "remaining_seconds")


def document_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Every key's number of distinct paths, counted anew."""
    keys = table(spark, folder, "doc_keys")
    return tr.document_counts(keys, table(spark, folder, "records"), keys).select("key", "doc_count")


def list_paths(spark: SparkSession, folder: str) -> DataFrame:
    return tr.list_paths(_state(spark, folder))


def orphan_records(spark: SparkSession, folder: str) -> DataFrame:
    return tr.orphans(table(spark, folder, "records"), table(spark, folder, "series_keys")).select("id", "key", "path")


def link_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tr.link_counts(table(spark, folder, "records"), table(spark, folder, "series_keys")).select("id", F.col("links").cast("long").alias("links"))


def source_validity(spark: SparkSession, folder: str) -> DataFrame:
    """How many sent documents give how many sources."""
    sent = table(spark, folder, "upsert_documents").select(sources_given(F.lit(None).cast("string"), F.col("url"), F.col("local_path")).cast("long").alias("sources"))
    return sent.groupBy("sources").agg(F.count(F.lit(1)).alias("documents"))


def dedup_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Sent contents that are stored already, by the key of their job."""
    jobs = table(spark, folder, "sync_jobs").select("job_id", "key").dropDuplicates(["job_id"])
    sent = table(spark, folder, "upsert_documents").select("job_id", clean_path("path").alias("path"), clean_hash("hash").alias("content_hash")).join(jobs, "job_id")
    found = tr.find_records(table(spark, folder, "records"), sent)
    return found.groupBy("job_id").agg(F.count(F.lit(1)).alias("documents"), F.count("record_id").alias("known"))


def upsert_outcome(spark: SparkSession, folder: str) -> DataFrame:
    """All documents stored in an empty collection, one after the other by doc_id: counts by key."""
    _, outcomes = tr.upsert(_empty(spark, folder), _documents(spark, folder).drop("lang"), NOW, HashEmbedder(8))
    return tr.outcome_counts(outcomes).select("key", "processed", "skipped", "failed")


def _targets(spark: SparkSession, folder: str) -> DataFrame:
    """All paths under docs/ in series main."""
    paths = table(spark, folder, "records").where(F.col("path").startswith("docs/")).select("key", "path").distinct()
    return paths.select("key", F.lit("main").alias("series"), "path")


def delete_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Records left by key after all paths under docs/ left series main."""
    state, _ = tr.delete_documents(_state(spark, folder), _targets(spark, folder))
    return state.records.groupBy("key").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("path").alias("paths"))


def delete_series(spark: SparkSession, folder: str) -> DataFrame:
    """Records that go and stay when every key's series main is deleted."""
    _, result = tr.delete_series(_state(spark, folder), table(spark, folder, "doc_keys").select("key", F.lit("main").alias("series")))
    return result


def chunks_after_delete(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks left by key after series main is deleted everywhere: they go with their records."""
    state, _ = tr.delete_series(_state(spark, folder), table(spark, folder, "doc_keys").select("key", F.lit("main").alias("series")))
    live = tr.live(state)
    return live.chunks.join(live.records.select(F.col("id").alias("record_id"), "key"), "record_id").groupBy("key").agg(F.count(F.lit(1)).alias("chunks"))


def sync_orphans(spark: SparkSession, folder: str) -> DataFrame:
    """Paths under docs/ detached from series main, with whether no series holds them then."""
    _, detached = tr.detach(_state(spark, folder), _targets(spark, folder))
    return detached


def sync_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Paths a series holds that its last done job did not deliver."""
    jobs = table(spark, folder, "sync_jobs").where(F.col("status") == "done").groupBy("key", "series").agg(F.max(F.struct("started_at", "job_id"))["job_id"].alias("job_id"))
    sent = table(spark, folder, "upsert_documents").select("job_id", clean_path("path").alias("path")).join(jobs, "job_id").select("key", "series", "path")
    held = tr.list_paths(_state(spark, folder)).join(jobs.select("key", "series"), ["key", "series"], "left_semi")
    return held.join(sent, ["key", "series", "path"], "left_anti").select("key", "series", "path")


def sync_self_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Reservations whose path a later done job of the series delivered again."""
    jobs = table(spark, folder, "sync_jobs").where(F.col("status") == "done").select("job_id", "key", "series", "started_at").dropDuplicates(["job_id"])
    sent = table(spark, folder, "upsert_documents").select("job_id", clean_path("path").alias("path")).join(jobs, "job_id")
    last = sent.groupBy("key", "series", "path").agg(F.max("started_at").alias("sent_at"))
    return _pending(spark, folder).join(last, ["key", "series", "path"]).where(F.col("sent_at") > F.col("marked_at")).select("key", "series", "path")


def mark_pending(spark: SparkSession, folder: str) -> DataFrame:
    """Reserving all paths under docs/ of series main: which ones were reserved before."""
    _, result = tr.mark_pending(_state(spark, folder), _targets(spark, folder), NOW)
    return result


def sweep_pending(spark: SparkSession, folder: str) -> DataFrame:
    """Reservations that are due, those of keys in the trash excepted."""
    return tr.pending_older_than(_pending(spark, folder), table(spark, folder, "doc_keys"), CUTOFF).select("key", "series", "path")


def sweep_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records left by key after the reservations that are due were carried out."""
    return tr.sweep_pending(_state(spark, folder), CUTOFF).records.groupBy("key").agg(F.count(F.lit(1)).alias("records"))


def sweep_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys and records left after the trash was emptied of what is older than the cutoff."""
    state = tr.sweep_keys(_state(spark, folder), CUTOFF)
    return state.keys.select("key").join(state.records.groupBy("key").agg(F.count(F.lit(1)).alias("records")), "key", "left")


def chunk_total(spark: SparkSession, folder: str) -> DataFrame:
    return tr.chunk_total(_state(spark, folder).chunks)


def trash_restore(spark: SparkSession, folder: str) -> DataFrame:
    """All keys go to the trash and those with an even number of documents come back: what is listed as trashed then."""
    state = _state(spark, folder)
    gone = tr.set_trashed(state, state.keys, NOW)
    back = tr.set_trashed(gone, gone.keys.where(F.col("doc_count") % 2 == 0), None)
    return tr.list_trashed(back.keys, RETENTION, NOW).select("key", "doc_count", "remaining_seconds")


def reserve_series(spark: SparkSession, folder: str) -> DataFrame:
    """Records left by key after series main was reserved for deletion everywhere and a sweep carried out what is due."""
    state = _state(spark, folder)
    state, _ = tr.mark_pending(state, state.keys.select("key", F.lit("main").alias("series"), F.lit(tr.WHOLE_SERIES).alias("path")), CUTOFF - timedelta(days=1))
    return tr.sweep_pending(state, CUTOFF).records.groupBy("key").agg(F.count(F.lit(1)).alias("records"))


def _empty(spark: SparkSession, folder: str) -> tr.State:
    none = lambda df: df.where(F.lit(False))
    like = _state(spark, folder)
    return tr.State(none(like.keys), none(like.records), none(like.series_keys), spark.createDataFrame([], CHUNKS), spark.createDataFrame([], EMBEDDINGS), spark.createDataFrame([], PENDING))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("key", F.lit("main").alias("series"), F.col("doc_id").alias("pos"), "path", F.col("text").alias("content"), F.lit(None).cast("string").alias("error"), "lang")


def sync_documents(spark: SparkSession, folder: str) -> DataFrame:
    """All documents stored, then every key synced with those marked as English: counts of the sync, and of paths marked for deletion."""
    docs = _documents(spark, folder)
    state, _ = tr.upsert(_empty(spark, folder), docs.drop("lang"), NOW, HashEmbedder(8))
    english = docs.where(F.lower(F.trim("lang")) == "en").drop("lang")
    _, outcomes, marked = tr.sync(state, english, docs.select("key", "series").distinct(), NOW, HashEmbedder(8))
    counts = tr.outcome_counts(outcomes).select("key", "processed", "skipped", "failed")
    return counts.join(marked.groupBy("key").agg(F.count(F.lit(1)).alias("marked")), "key", "full").na.fill(0)


def sync_changes(spark: SparkSession, folder: str) -> DataFrame:
    """All documents stored, then all synced again after those of the last key, a hundredth or so, were edited: what is done by key."""
    docs = _documents(spark, folder).drop("lang")
    state, _ = tr.upsert(_empty(spark, folder), docs, NOW, HashEmbedder(8))
    last = table(spark, folder, "doc_keys").agg(F.max("key")).first()[0]
    edited = docs.withColumn("content", F.when(F.col("key") == last, F.concat("content", F.lit(" edited"))).otherwise(F.col("content")))
    _, outcomes, _ = tr.sync(state, edited, docs.select("key", "series").distinct(), NOW, HashEmbedder(8))
    return tr.outcome_counts(outcomes).select("key", "processed", "skipped", "failed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q
    for q in (
        list_indexes, list_trashed, document_counts, list_paths, orphan_records, link_counts, source_validity, dedup_plan, upsert_outcome, delete_documents,
        delete_series, chunks_after_delete, sync_orphans, sync_diff, sync_self_repair, mark_pending, sweep_pending, sweep_records, sweep_keys,
        chunk_total, trash_restore, reserve_series, sync_documents, sync_changes,
    )
}

_PENDING = _CHANGES + ", pending as (select j.key, j.series, d.path, max(j.started_at) as marked_at from diff d join jobs j using (job_id) where d.change = 'removed' group by all)"
_TARGETS = "targets as (select distinct key, 'main' as series, path from records where starts_with(path, 'docs/'))"
_LEFT = "links as (select distinct s.record_id, s.series from series_keys s join records r on r.id = s.record_id where not (s.series = 'main' and starts_with(r.path, 'docs/')))"
_DUE = _PENDING + ", due as (select * from pending where marked_at < timestamptz '2025-09-01 00:00:00+00' and key not in (select key from doc_keys where trashed_at is not null))"
_SENT_PATH = "case when starts_with(p, '/') then '/' else '' end || array_to_string(list_filter(string_split(p, '/'), lambda s: s not in ('', '.')), '/')"
_TRIM = r"regexp_replace(path, '^\s+|\s+$', '', 'g') as p"

#: Stored documents as (key, path, doc_id, h), what a sync delivers then as `sent`, and by key what becomes of it.
_STORED = r"""with d as (select key, path, doc_id, lower(trim(lang)) as lang, regexp_replace(regexp_replace(text, '^\x{FEFF}', ''), '\r\n?', chr(10), 'g') as c from documents),
        held as (select key, path, arg_max(c, doc_id) as c from d where coalesce(path, '') <> '' and c is not null group by all),
        """
_SYNCED = """,
        e as (select key, path, -1 as doc_id, c from held union all select key, path, doc_id, c from sent where coalesce(path, '') <> '' and c is not null),
        o as (select key, doc_id, case when c = lag(c) over (partition by key, path order by doc_id) then 'skipped' else 'processed' end as o from e
              union all select key, doc_id, 'failed' from sent where coalesce(path, '') = '' or c is null),
        n as (select key, count(*) filter (o = 'processed') as processed, count(*) filter (o = 'skipped') as skipped, count(*) filter (o = 'failed') as failed from o where doc_id >= 0 group by 1)
        """

ORACLE = {
    "chunk_total": "select count(*) as chunks from chunks",
    "trash_restore": "select key, doc_count, (400 * 86400)::bigint as remaining_seconds from doc_keys where doc_count % 2 <> 0",
    "reserve_series": _DUE + """, l as (select distinct s.record_id, s.series, r.key, r.path from series_keys s join records r on r.id = s.record_id),
        active as (select key from doc_keys where trashed_at is null),
        left_ as (select * from l where not (series = 'main' and key in (select key from active)))
        select key, count(*) as records from records r where exists (select 1 from left_ where record_id = r.id)
          or (not exists (select 1 from l where record_id = r.id) and not exists (select 1 from due d where d.key = r.key and d.path = r.path)) group by 1""",
    "sync_documents": _STORED + "sent as (select * from d where lang = 'en')" + _SYNCED + """,
        m as (select key, count(*) as marked from (select key, path from held except select key, path from sent) group by 1)
        select key, coalesce(processed, 0) as processed, coalesce(skipped, 0) as skipped, coalesce(failed, 0) as failed, coalesce(marked, 0) as marked from n full join m using (key)""",
    "sync_changes": _STORED + "sent as (select key, path, doc_id, c || case when key = (select max(key) from doc_keys) then ' edited' else '' end as c from d)" + _SYNCED + "select * from n",
    "list_indexes": """select k.key, k.doc_count, coalesce(c.n, 0) as chunk_count, s.series from doc_keys k
        left join (select r.key, count(c.id) as n from records r left join chunks c on c.record_id = r.id group by 1) c using (key)
        left join (select r.key, string_agg(distinct s.series, ',' order by s.series) as series from records r join series_keys s on s.record_id = r.id group by 1) s using (key) where k.trashed_at is null""",
    "list_trashed": "select key, doc_count, greatest(0, epoch(date_trunc('second', trashed_at))::bigint + 400 * 86400 - epoch(timestamptz '2025-12-01 00:00:00+00')::bigint) as remaining_seconds from doc_keys where trashed_at is not null",
    "document_counts": "select k.key, count(distinct r.path) as doc_count from doc_keys k left join records r using (key) group by 1",
    "list_paths": "select distinct r.key, s.series, r.path from records r join series_keys s on s.record_id = r.id",
    "orphan_records": "select id, key, path from records where not exists (select 1 from series_keys s where s.record_id = records.id)",
    "link_counts": "select id, count(distinct series) as links from records left join series_keys on record_id = id group by 1",
    "source_validity": "select (coalesce(url, '') <> '')::bigint + (coalesce(local_path, '') <> '')::bigint as sources, count(*) as documents from upsert_documents group by 1",
    "dedup_plan": f"""with u as (select u.job_id, j.key, {_TRIM}, nullif(regexp_replace(lower(trim(hash)), '^sha256:', ''), '') as h from upsert_documents u join (select distinct job_id, key from sync_jobs) j using (job_id)),
        d as (select job_id, key, {_SENT_PATH} as path, h from u), r as (select key, path, content_hash, min(id) as id from records group by all)
        select d.job_id, count(*) as documents, count(r.id) as known from d left join r on r.key = d.key and r.path = d.path and r.content_hash = d.h group by 1""",
    "upsert_outcome": r"""with d as (select key, path, doc_id, sha256(regexp_replace(regexp_replace(text, '^\x{FEFF}', ''), '\r\n?', chr(10), 'g')) as h, coalesce(path, '') = '' or text is null as bad from documents),
        o as (select key, case when h = lag(h) over (partition by key, path order by doc_id) then 'skipped' else 'processed' end as o from d where not bad union all select key, 'failed' from d where bad)
        select key, count(*) filter (o = 'processed') as processed, count(*) filter (o = 'skipped') as skipped, count(*) filter (o = 'failed') as failed from o group by 1""",
    "delete_documents": f"with {_LEFT} select key, count(*) as records, count(distinct path) as paths from records r where not starts_with(path, 'docs/') or exists (select 1 from links where record_id = r.id) group by 1",
    "delete_series": """with m as (select distinct r.id, r.key, exists (select 1 from series_keys o where o.record_id = r.id and o.series <> 'main') as stays from records r join series_keys s on s.record_id = r.id where s.series = 'main')
        select k.key, 'main' as series, count(m.id) filter (not stays) as removed_records, count(m.id) filter (stays) as updated_records from doc_keys k left join m using (key) group by 1""",
    "chunks_after_delete": """select r.key, count(*) as chunks from chunks c join records r on r.id = c.record_id
        where not exists (select 1 from series_keys s where s.record_id = r.id and s.series = 'main') or exists (select 1 from series_keys s where s.record_id = r.id and s.series <> 'main') group by 1""",
    "sync_orphans": f"with {_TARGETS}, {_LEFT} select t.key, t.series, t.path, bool_or(not exists (select 1 from links l where l.record_id = r.id)) as orphaned from targets t join records r using (key, path) group by all",
    "sync_diff": f"""with j as (select key, series, arg_max(job_id, (started_at, job_id)) as job_id from sync_jobs where status = 'done' group by all),
        u as (select j.key, j.series, {_TRIM} from upsert_documents u join j using (job_id)), d as (select distinct key, series, {_SENT_PATH} as path from u),
        h as (select distinct r.key, s.series, r.path from records r join series_keys s on s.record_id = r.id join j on j.key = r.key and j.series = s.series)
        select * from h except select * from d""",
    "sync_self_repair": _PENDING + "select p.key, p.series, p.path from pending p where exists (select 1 from named n join jobs j using (job_id) where j.key = p.key and j.series = p.series and n.path = p.path and j.started_at > p.marked_at)",
    "mark_pending": _PENDING + f", {_TARGETS} select t.*, exists (select 1 from pending p where p.key = t.key and p.series = t.series and p.path = t.path) as already_scheduled from targets t",
    "sweep_pending": _DUE + "select key, series, path from due",
    "sweep_records": _DUE + "select key, count(*) as records from records r where exists (select 1 from series_keys s where s.record_id = r.id) or not exists (select 1 from due d where d.key = r.key and d.path = r.path) group by 1",
    "sweep_keys": "select k.key, count(r.id) as records from doc_keys k join records r using (key) where k.trashed_at is null or k.trashed_at >= timestamptz '2025-09-01 00:00:00+00' group by 1",
}
