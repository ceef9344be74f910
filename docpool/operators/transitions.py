"""Changes of a collection's state, as pure functions from tables to tables.

All take sets of targets and `now`; nothing is written here. Chunks and vectors of records that are gone are
left where they are and drop out in `live`: a change rewrites the small tables only.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docpool.functions.ranks import salted_row_number
from docpool.functions.storage import materialize
from docpool.functions.text import content_hash, normalise_content
from docpool.operators.chunker import DEFAULT_SIZE, chunk_documents, oversized_line
from docpool.sources.embedding import Embedder, with_vectors

#: The path of a reservation that holds for a whole series.
WHOLE_SERIES = ""


@dataclass(frozen=True)
class State:
    """The tables of schema.TABLES; new_chunks and new_embeddings are rows that this change adds."""

    keys: DataFrame
    records: DataFrame
    series_keys: DataFrame
    chunks: DataFrame
    embeddings: DataFrame
    pending: DataFrame
    new_chunks: DataFrame | None = None
    new_embeddings: DataFrame | None = None


def _plus(a: DataFrame, b: DataFrame | None) -> DataFrame:
    return a if b is None else a.unionByName(b)


def live(state: State) -> State:
    """Chunks and vectors of existing records only, added rows included."""
    ids = state.records.select("id")
    chunks = _plus(state.chunks, state.new_chunks)
    chunks = chunks.join(ids.withColumnRenamed("id", "record_id"), "record_id", "left_semi").select(chunks.columns)
    vectors = _plus(state.embeddings, state.new_embeddings)
    vectors = vectors.join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi").select(vectors.columns)
    return replace(state, chunks=chunks, embeddings=vectors, new_chunks=None, new_embeddings=None)


def settled(state: State) -> State:
    """The small tables written, so that what follows does not carry the plans of all rounds before."""
    return replace(state, **{t: materialize(getattr(state, t), t) for t in ("records", "series_keys", "keys")})


def at(now: datetime) -> Column:
    """A time in whole seconds."""
    return F.date_trunc("second", F.lit(now))


def find_records(records: DataFrame, docs: DataFrame) -> DataFrame:
    """docs (key, path, content_hash, ..) with record_id, null where the content is new."""
    known = records.groupBy("key", "path", "content_hash").agg(F.min("id").alias("record_id"))
    return docs.join(known, ["key", "path", "content_hash"], "left")


def document_counts(keys: DataFrame, records: DataFrame, touched: DataFrame) -> DataFrame:
    """keys with doc_count, the number of distinct paths, counted anew for the touched keys."""
    paths = records.join(touched.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.countDistinct("path").alias("paths"))
    marked = keys.join(touched.select("key").distinct().withColumn("_touched", F.lit(True)), "key", "left").join(paths, "key", "left")
    return marked.withColumn("doc_count", F.when(F.col("_touched"), F.coalesce("paths", F.lit(0))).otherwise(F.col("doc_count"))).select(keys.columns)


def link_counts(records: DataFrame, series_keys: DataFrame) -> DataFrame:
    """records with `links`, the number of series that hold them."""
    n = series_keys.distinct().groupBy("record_id").agg(F.count(F.lit(1)).alias("links"))
    return records.join(n.withColumnRenamed("record_id", "id"), "id", "left").withColumn("links", F.coalesce("links", F.lit(0)))


def orphans(records: DataFrame, series_keys: DataFrame) -> DataFrame:
    """Records that no series holds."""
    return records.join(series_keys.select(F.col("record_id").alias("id")), "id", "left_anti")


def _without(state: State, gone: DataFrame) -> State:
    """Without the records `gone` (id) and their links."""
    records = state.records.join(gone.select("id"), "id", "left_anti").select(state.records.columns)
    links = state.series_keys.join(gone.select(F.col("id").alias("record_id")), "record_id", "left_anti")
    return replace(state, records=records, series_keys=links.select(state.series_keys.columns))


def append_series(state: State, links: DataFrame) -> State:
    """Adds links (record_id, series); existing ones stay single."""
    return replace(state, series_keys=state.series_keys.unionByName(links.select("record_id", "series")).distinct())


def unlink(state: State, targets: DataFrame) -> State:
    """Takes series off all records of paths; targets (key, series, path)."""
    hit = state.records.join(targets, ["key", "path"]).select(F.col("id").alias("record_id"), "series").distinct()
    return replace(state, series_keys=state.series_keys.join(hit, ["record_id", "series"], "left_anti").select(state.series_keys.columns))


def clean_other_series(state: State, kept: DataFrame) -> State:
    """Takes a series off the other records of a path and deletes those no series holds; kept (key, path, series, record_id)."""
    others = state.records.join(kept, ["key", "path"]).where(F.col("id") != F.col("record_id"))
    hit = others.select(F.col("id").alias("record_id"), "series").distinct()
    links = state.series_keys.join(hit, ["record_id", "series"], "left_anti").select(state.series_keys.columns)
    gone = orphans(others.select("id").distinct(), links)
    return _without(replace(state, series_keys=links), gone)


def _events(state: State, docs: DataFrame) -> DataFrame:
    """docs (key, series, path, pos, content_hash, record_id) with round, last and known: what each finds when its turn comes.

    The documents of a series' path have rounds 1, 2.. in order of pos; a round takes effect on all series at once. Before
    it, a path has the contents that its series hold: that of the round before, of a series with fewer rounds its last, of
    one without documents here what it held from the start. All other records of the path are gone by then, but
    in the first round, which finds every record of the path.
    """
    turn = Window.partitionBy("key", "series", "path")
    events = docs.select("key", "series", "path", "pos", "content_hash", "record_id", F.row_number().over(turn.orderBy("pos")).alias("round"), F.count(F.lit(1)).over(turn).alias("_n"))
    events = materialize(events.withColumn("last", F.col("round") == F.col("_n")).drop("_n"), "events")
    content = ["key", "path", "content_hash"]
    before = events.select(*content, (F.col("round") + 1).alias("round"), F.lit(True).alias("_before")).distinct()
    ended = events.where("last").groupBy(*content).agg(F.min("round").alias("_ended"))
    taking_part = events.select("key", "path", "series").distinct()
    held = state.series_keys.join(state.records.select(F.col("id").alias("record_id"), *content), "record_id").join(taking_part.select("key", "path").distinct(), ["key", "path"], "left_semi")
    idle = held.join(taking_part, ["key", "path", "series"], "left_anti").select(*content, F.lit(True).alias("_idle")).distinct()
    seen = events.join(before, [*content, "round"], "left").join(ended, content, "left").join(idle, content, "left")
    known = (F.col("round") == 1) & F.col("record_id").isNotNull() | F.col("_before").isNotNull() | F.coalesce(F.col("_ended") < F.col("round"), F.lit(False)) | F.col("_idle").isNotNull()
    return materialize(seen.withColumn("known", known).drop("_before", "_ended", "_idle"), "seen")


def upsert(state: State, docs: DataFrame, now: datetime, embedder: Embedder, max_size: int = DEFAULT_SIZE) -> tuple[State, DataFrame]:
    """Stores documents; docs (key, series, pos, path, content, error). Gives the outcomes (key, series, pos, path, outcome, error, skipped_chunks).

    A content that is known for its key and path is only linked (`skipped`): no chunking, no embedding. New content
    is chunked and embedded (`processed`), its record replaces the path's others in the series. What can't be
    stored is `failed`. Documents of one path take effect one after the other, in order of pos; how each finds the path
    follows from joins (_events), so the number of jobs does not depend on the number of a path's documents.
    """
    read = docs.withColumn("content", normalise_content(F.col("content")))
    problem = F.coalesce(F.col("error"), F.when(F.coalesce(F.col("path"), F.lit("")) == "", "a path is required"), F.when(F.col("content").isNull(), "no content"))
    read = read.withColumn("content_hash", content_hash(F.col("content"))).withColumn("error", problem)
    read = materialize(read.withColumn("oversized", F.coalesce(oversized_line(F.col("content")), F.lit(False))), "documents")
    content = ["key", "path", "content_hash"]
    good = find_records(state.records, read.where(F.col("error").isNull()).select("key", "series", "pos", "path", "content_hash", "oversized"))
    refused = F.col("record_id").isNull() & F.col("oversized")
    events = _events(state, good.where(~refused))
    said = lambda df, outcome, error: df.select("key", "series", "pos", "path", F.lit(outcome).alias("outcome"), error.cast("string").alias("error"), F.lit(0).cast("long").alias("skipped_chunks"))
    outcomes = said(read.where(F.col("error").isNotNull()), "failed", F.col("error")).unionByName(said(good.where(refused), "failed", F.lit("a line is too long")))
    outcomes = outcomes.unionByName(said(events.where("known"), "skipped", F.lit(None)))

    fresh = events.where(~F.col("known"))
    last = state.records.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    made = salted_row_number(fresh.select(*content, "round").distinct(), [], [*content, "round"], "n")
    made = materialize(made.withColumn("record_id", F.col("n") + last + 1).drop("n"), "records")
    texts = read.where(F.col("error").isNull()).select(*content, "content").join(made.select(*content).distinct(), content, "left_semi").dropDuplicates(content)
    chunks = chunk_documents(made.join(texts, content).select("record_id", "content"), "content", max_size)
    last_chunk = _plus(state.chunks, state.new_chunks).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    chunks = salted_row_number(chunks, [], ["record_id", "chunk_index"], "n").withColumn("id", F.col("n") + last_chunk + 1).drop("n")
    vectors = materialize(with_vectors(chunks, embedder), "vectors")
    lost = vectors.where(F.col("embed_error").isNotNull()).groupBy("record_id").agg(F.count(F.lit(1)).alias("skipped_chunks"), F.first("embed_error").alias("embed_error"))
    done = fresh.drop("record_id").join(made, [*content, "round"]).join(lost, "record_id", "left")
    outcomes = outcomes.unionByName(done.select("key", "series", "pos", "path", F.lit("processed").alias("outcome"), F.col("embed_error").alias("error"), F.coalesce("skipped_chunks", F.lit(0)).alias("skipped_chunks")))

    # in the end a series holds its last document: the record that the batch made last of this content, else the one it found
    newest = made.groupBy(*content).agg(F.max_by("record_id", "round").alias("_made"))
    kept = events.where("last").join(newest, content, "left").select("key", "path", "series", F.coalesce("_made", "record_id").alias("record_id"))
    kept = materialize(kept, "kept")
    here = state.records.select(F.col("id").alias("record_id"), "key", "path").join(kept.select("key", "path").distinct(), ["key", "path"], "left_semi")
    ended = here.join(kept.select("key", "path", "series"), ["key", "path"]).select("record_id", "series").distinct()
    links = state.series_keys.join(ended, ["record_id", "series"], "left_anti").select("record_id", "series").unionByName(kept.select("record_id", "series")).distinct()
    links = materialize(links.select(state.series_keys.columns), "links")
    gone = here.join(links.select("record_id").distinct(), "record_id", "left_anti").select(F.col("record_id").alias("id"))
    stored = made.join(kept.select("record_id").distinct(), "record_id", "left_semi")
    records = state.records.join(gone, "id", "left_anti").select(state.records.columns)
    records = records.unionByName(stored.select(F.col("record_id").alias("id"), "key", "path", "content_hash", at(now).alias("created_at"), at(now).alias("updated_at")))
    vectors = vectors.join(stored.select("record_id"), "record_id", "left_semi")
    state = replace(
        state,
        records=records,
        series_keys=links,
        new_chunks=_plus(vectors.select(*state.chunks.columns), state.new_chunks),
        new_embeddings=_plus(vectors.where(F.size("vector") > 0).select(F.col("id").alias("chunk_id"), "vector", F.size("vector").alias("dim")), state.new_embeddings),
    )
    touched = made.select("key").distinct()
    rows = touched.join(state.keys, "key", "left_anti").select("key", F.lit(0).cast("long").alias("doc_count"), at(now).alias("last_accessed_at"), at(now).alias("last_updated_at"), F.lit(None).cast("timestamp").alias("trashed_at"))
    keys = state.keys.join(touched.withColumn("_new", F.lit(True)), "key", "left").withColumn("last_updated_at", F.when(F.col("_new"), at(now)).otherwise(F.col("last_updated_at"))).select(state.keys.columns)
    return settled(replace(state, keys=document_counts(keys.unionByName(rows), state.records, touched))), outcomes


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """(key, series, processed, skipped, failed)."""
    return outcomes.groupBy("key", "series").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("processed", "skipped", "failed")])


def delete_documents(state: State, targets: DataFrame) -> tuple[State, DataFrame]:
    """Takes paths out of a series; targets (key, series, path). Gives them with `found`: whether the path has any record.

    Records of these paths that no series holds are deleted, those that were orphans before too.
    """
    targets = targets.distinct()
    paths = state.records.select("key", "path").distinct().withColumn("_has", F.lit(True))
    result = targets.join(paths, ["key", "path"], "left").select("key", "series", "path", F.col("_has").isNotNull().alias("found"))
    state = unlink(state, targets)
    gone = orphans(state.records.join(targets.select("key", "path").distinct(), ["key", "path"], "left_semi"), state.series_keys)
    state = _without(state, gone)
    return replace(state, keys=document_counts(state.keys, state.records, result.where("found"))), result


def delete_series(state: State, targets: DataFrame) -> tuple[State, DataFrame]:
    """Takes whole series off their keys; targets (key, series). Gives (key, series, removed_records, updated_records).

    Of the series' reservations only the one for the whole series goes.
    """
    targets = targets.distinct()
    hit = state.series_keys.distinct().join(state.records.select(F.col("id").alias("record_id"), "key"), "record_id").join(targets, ["key", "series"], "left_semi")
    links = state.series_keys.join(hit.select("record_id", "series"), ["record_id", "series"], "left_anti").select(state.series_keys.columns)
    left = hit.join(links.select("record_id").distinct().withColumn("_left", F.lit(True)), "record_id", "left").withColumn("_left", F.col("_left").isNotNull())
    counts = left.groupBy("key", "series").agg(F.count_if(~F.col("_left")).alias("removed_records"), F.count_if("_left").alias("updated_records"))
    result = targets.join(counts, ["key", "series"], "left").na.fill(0, ["removed_records", "updated_records"])
    state = _without(replace(state, series_keys=links), left.where(~F.col("_left")).select(F.col("record_id").alias("id")).distinct())
    state = replace(state, keys=document_counts(state.keys, state.records, targets))
    return clear_pending(state, targets.withColumn("path", F.lit(WHOLE_SERIES))), result


def delete_keys(state: State, targets: DataFrame) -> State:
    """Deletes keys with everything they hold, reservations too; targets (key)."""
    keep = lambda df: df.join(targets.select("key").distinct(), "key", "left_anti").select(df.columns)
    gone = state.records.join(targets.select("key").distinct(), "key", "left_semi")
    return replace(_without(state, gone), keys=keep(state.keys), pending=keep(state.pending))


def detach(state: State, targets: DataFrame) -> tuple[State, DataFrame]:
    """Takes paths out of a series and keeps their records; targets (key, series, path). Gives them with `orphaned`."""
    state = unlink(state, targets)
    bare = orphans(state.records.join(targets.select("key", "path").distinct(), ["key", "path"], "left_semi"), state.series_keys).select("key", "path").distinct()
    return state, targets.join(bare.withColumn("_o", F.lit(True)), ["key", "path"], "left").select("key", "series", "path", F.col("_o").isNotNull().alias("orphaned"))


def list_paths(state: State) -> DataFrame:
    """(key, series, path): the paths that series hold."""
    return state.series_keys.join(state.records.select(F.col("id").alias("record_id"), "key", "path"), "record_id").select("key", "series", "path").distinct()


def mark_pending(state: State, targets: DataFrame, now: datetime) -> tuple[State, DataFrame]:
    """Reserves deletions, or renews them; targets (key, series, path). Gives them with already_scheduled."""
    targets = targets.select("key", "series", "path").distinct()
    had = targets.join(state.pending.select("key", "series", "path").distinct().withColumn("_had", F.lit(True)), ["key", "series", "path"], "left")
    kept = state.pending.join(targets, ["key", "series", "path"], "left_anti").select(state.pending.columns)
    return replace(state, pending=kept.unionByName(targets.withColumn("marked_at", at(now)))), had.select("key", "series", "path", F.col("_had").isNotNull().alias("already_scheduled"))


def clear_pending(state: State, targets: DataFrame) -> State:
    """Drops reservations, if there are any; targets (key, series, path)."""
    return replace(state, pending=state.pending.join(targets.select("key", "series", "path"), ["key", "series", "path"], "left_anti").select(state.pending.columns))


def delete_orphans(state: State, targets: DataFrame) -> State:
    """Deletes the records of paths that no series holds; targets (key, path)."""
    paths = targets.select("key", "path").distinct()
    gone = orphans(state.records.join(paths, ["key", "path"], "left_semi"), state.series_keys)
    touched = gone.select("key").distinct()
    state = _without(state, gone)
    return replace(state, keys=document_counts(state.keys, state.records, touched))


def pending_older_than(pending: DataFrame, keys: DataFrame, cutoff: datetime) -> DataFrame:
    """Reservations from before the cutoff, but for those of keys in the trash."""
    trashed = keys.where(F.col("trashed_at").isNotNull()).select("key")
    return pending.where(F.date_trunc("second", "marked_at") < at(cutoff)).join(trashed, "key", "left_anti").select(pending.columns)


def trashed_before(keys: DataFrame, cutoff: datetime) -> DataFrame:
    return keys.where(F.date_trunc("second", "trashed_at") < at(cutoff))


def sweep_pending(state: State, cutoff: datetime) -> State:
    """Carries out the reservations from before the cutoff: of whole series, and of paths that are orphans."""
    due = materialize(pending_older_than(state.pending, state.keys, cutoff).select("key", "series", "path"), "due")
    state, _ = delete_series(state, due.where(F.col("path") == WHOLE_SERIES).select("key", "series"))
    return clear_pending(delete_orphans(state, due.where(F.col("path") != WHOLE_SERIES)), due)


def sweep_keys(state: State, cutoff: datetime) -> State:
    """Deletes keys that went to the trash before the cutoff."""
    return delete_keys(state, trashed_before(state.keys, cutoff))


def set_trashed(state: State, targets: DataFrame, now: datetime | None) -> State:
    """Puts keys in the trash at `now`, or takes them out for None; targets (key)."""
    hit = state.keys.join(targets.select("key").distinct().withColumn("_hit", F.lit(True)), "key", "left")
    time = F.lit(None).cast("timestamp") if now is None else at(now)
    return replace(state, keys=hit.withColumn("trashed_at", F.when(F.col("_hit"), time).otherwise(F.col("trashed_at"))).select(state.keys.columns))


def touch(state: State, targets: DataFrame, now: datetime) -> State:
    """Sets the time of the last query; targets (key)."""
    hit = state.keys.join(targets.select("key").distinct().withColumn("_hit", F.lit(True)), "key", "left")
    return replace(state, keys=hit.withColumn("last_accessed_at", F.when(F.col("_hit"), at(now)).otherwise(F.col("last_accessed_at"))).select(state.keys.columns))


def list_keys(keys: DataFrame, records: DataFrame, series_keys: DataFrame, chunks: DataFrame) -> DataFrame:
    """Keys that are not in the trash, with doc_count, chunk_count and series (null if none), by key."""
    per_record = chunks.groupBy(F.col("record_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    counts = records.join(per_record, "id", "left").groupBy("key").agg(F.sum("n").alias("chunk_count"))
    series = records.select(F.col("id").alias("record_id"), "key").join(series_keys, "record_id").groupBy("key").agg(F.array_sort(F.collect_set("series")).alias("series"))
    active = keys.where(F.col("trashed_at").isNull()).select("key", "doc_count", "last_accessed_at", "last_updated_at")
    return active.join(counts, "key", "left").join(series, "key", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0))).orderBy("key")


def chunk_total(chunks: DataFrame) -> DataFrame:
    """(chunks): how many there are over all keys."""
    return chunks.agg(F.count(F.lit(1)).alias("chunks"))


def list_trashed(keys: DataFrame, retention_seconds: int, now: datetime) -> DataFrame:
    """(key, doc_count, trashed_at, remaining_seconds): keys in the trash, oldest first."""
    left = F.unix_timestamp("trashed_at") + F.lit(retention_seconds).cast("long") - F.unix_timestamp(at(now))
    return keys.where(F.col("trashed_at").isNotNull()).select("key", "doc_count", "trashed_at", F.greatest(left, F.lit(0).cast("long")).alias("remaining_seconds")).orderBy("trashed_at", "key")


def sync(state: State, docs: DataFrame, targets: DataFrame, now: datetime, embedder: Embedder, max_size: int = DEFAULT_SIZE) -> tuple[State, DataFrame, DataFrame]:
    """Makes series hold the given documents and nothing else; targets (key, series), docs as for upsert.

    Gives the outcomes and the paths marked for deletion. Paths that are not among the documents, failed ones
    included, are detached; those no series holds any more are reserved for deletion. Reservations of paths
    that were stored are undone, and so are those of the series.
    """
    reserved = materialize(state.pending.join(targets.distinct(), ["key", "series"], "left_semi").select("key", "series", "path"), "reserved")
    state, outcomes = upsert(state, docs, now, embedder, max_size)
    outcomes = materialize(outcomes, "outcomes")
    extra = list_paths(state).join(targets.distinct(), ["key", "series"], "left_semi").join(docs.select("key", "series", "path"), ["key", "series", "path"], "left_anti")
    extra = materialize(extra.select("key", "series", "path"), "extra")
    state, detached = detach(state, extra)
    marked = materialize(detached.where("orphaned").select("key", "series", "path"), "marked")
    state, _ = mark_pending(state, marked, now)
    stored = outcomes.where(F.col("outcome") != "failed").select("key", "series", "path").distinct()
    healed = reserved.join(stored, ["key", "series", "path"], "left_semi")
    state = clear_pending(delete_orphans(state, healed), healed)
    return clear_pending(state, reserved.where(F.col("path") == WHOLE_SERIES)), outcomes, marked
