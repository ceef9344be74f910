"""The eleven calls of the service, over a snapshot store."""

from __future__ import annotations

import logging
import secrets
import threading
import time
from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docpool.errors import KeyNotFound, KeyTrashed
from docpool.functions.storage import scratch
from docpool.operators import transitions as tr
from docpool.operators.chunker import DEFAULT_SIZE
from docpool.operators.rerank import Reranker
from docpool.operators.retrieval import Found, scan, search
from docpool.operators.signals import B, K1
from docpool.sources.content import Fetcher, HttpFetcher, resolve
from docpool.sources.embedding import Embedder, embed_all
from docpool.sources.store import SnapshotStore

log = logging.getLogger("docpool")
FINISHED_KEPT = 100
DOCUMENT = "pos long, path string, content string, url string, local_path string"


@dataclass
class SyncStatus:
    status: str = "running"
    processed: int = 0
    skipped: int = 0
    failed: int = 0
    deleted_paths_marked: int = 0
    errors: list[str] = field(default_factory=list)


class SyncJobs:
    """Status of sync jobs in memory; of finished ones the latest FINISHED_KEPT."""

    def __init__(self, kept: int = FINISHED_KEPT):
        self._guard, self._jobs, self._kept = threading.Lock(), OrderedDict(), kept

    def start(self) -> str:
        job = secrets.token_hex(16)
        with self._guard:
            done = [j for j, s in self._jobs.items() if s.status != "running"]
            for j in done[: max(0, len(done) - self._kept + 1)]:
                del self._jobs[j]
            self._jobs[job] = SyncStatus()
        return job

    def update(self, job: str, **values: Any) -> None:
        with self._guard:
            if job in self._jobs:
                for name, value in values.items():
                    setattr(self._jobs[job], name, value)

    def get(self, job: str) -> SyncStatus:
        with self._guard:
            if job not in self._jobs:
                raise LookupError(f"no job {job!r}: never given, no longer kept, or from before a restart; syncing again is safe")
            s = self._jobs[job]
            return SyncStatus(s.status, s.processed, s.skipped, s.failed, s.deleted_paths_marked, list(s.errors))


def _need(**values: Any) -> None:
    missing = [n for n, v in values.items() if not v]
    if missing:
        raise ValueError(f"required: {', '.join(missing)}")


class Service:
    """upsert, delete, query, sync and trash of document collections; keys are independent of each other."""

    def __init__(self, store: SnapshotStore, embedder: Embedder, *, reranker: Reranker | None = None, fetcher: Fetcher | None = None, max_chunk_size: int = DEFAULT_SIZE, retention: timedelta = timedelta(days=3), k1: float = K1, b: float = B, now: Callable[[], datetime] = lambda: datetime.now(UTC)):
        self.store, self.embedder, self.reranker, self.now = store, embedder, reranker, now
        self.fetcher = fetcher or HttpFetcher()
        self.max_chunk_size, self.retention, self.k1, self.b = max_chunk_size, retention, k1, b
        self.jobs, self._threads, self._closing = SyncJobs(), [], threading.Event()
        self.spark = store.spark

    def _time(self) -> datetime:
        return self.now().astimezone(UTC).replace(microsecond=0, tzinfo=None)

    def _key_row(self, key: str):  # noqa: ANN202
        return self.store.state(key).keys.first() if self.store.exists(key) else None

    def _not_trashed(self, key: str) -> None:
        row = self._key_row(key)
        if row is not None and row.trashed_at is not None:
            raise KeyTrashed(key)

    @contextmanager
    def _changing(self, call: str, key: str) -> Iterator[None]:
        """Holds the key's lock; a key in the trash is refused before and after waiting for it."""
        start = time.monotonic()
        try:
            self._not_trashed(key)
            with self.store.locks.hold(key, self._closing.is_set), scratch():
                self._not_trashed(key)
                yield
        finally:
            log.info("%s done key=%s seconds=%.3f", call, key, time.monotonic() - start)

    def _rows(self, key: str, series: str, paths: Sequence[str] | None = None) -> DataFrame:
        if paths is None:
            return self.spark.createDataFrame([(key, series)], "key string, series string")
        return self.spark.createDataFrame([(key, series, p) for p in paths], "key string, series string, path string")

    def _documents(self, key: str, series: str, documents: Sequence[dict]) -> DataFrame:
        rows = [(i, d.get("path") or "", d.get("content") or "", d.get("url") or "", d.get("local_path") or "") for i, d in enumerate(documents)]
        read = resolve(self.spark.createDataFrame(rows, DOCUMENT), self.fetcher)
        return read.select(F.lit(key).alias("key"), F.lit(series).alias("series"), "pos", "path", "content", "error")

    def upsert_documents(self, key: str, series: str, documents: Sequence[dict]) -> dict:
        """Stores documents {path, content | url | local_path}: counts and the errors of single documents."""
        _need(key=key, series=series, documents=documents)
        with self._changing("upsert_documents", key):
            state, outcomes = tr.upsert(self.store.state(key), self._documents(key, series, documents), self._time(), self.embedder, self.max_chunk_size)
            rows = outcomes.orderBy("pos").collect()
            self.store.commit(key, state)
        return self._told(rows)

    @staticmethod
    def _told(rows: list) -> dict:
        count = lambda o: sum(r.outcome == o for r in rows)
        errors = [{"path": r.path, "error": r.error, **({"skipped_chunks": r.skipped_chunks} if r.skipped_chunks else {})} for r in rows if r.error]
        return {"processed": count("processed"), "skipped": count("skipped"), "failed": count("failed"), "errors": errors}

    def delete_documents(self, key: str, series: str, paths: Sequence[str]) -> dict:
        """Takes paths out of a series: the number of paths that exist, a warning for each other."""
        _need(key=key, series=series, paths=paths)
        with self._changing("delete_documents", key):
            state, result = tr.delete_documents(self.store.state(key), self._rows(key, series, paths))
            found = {r.path: r.found for r in result.collect()}
            if any(found.values()):
                self.store.commit(key, state)
        return {"deleted": sum(found.values()), "warnings": [f"there is no path {p!r}" for p in sorted(found) if not found[p]]}

    def delete_series(self, key: str, series: str) -> dict:
        _need(key=key, series=series)
        with self._changing("delete_series", key):
            if not self.store.exists(key):
                return {"removed_records": 0, "updated_records": 0}
            state, result = tr.delete_series(self.store.state(key), self._rows(key, series))
            row = result.first()
            self.store.commit(key, state)
        return {"removed_records": row.removed_records, "updated_records": row.updated_records}

    def query(self, key: str, query: str, *, series: str | None = None, mode: str = "all", top_n: int = 10) -> Found:
        """The best chunks of a key, or of one series; the embedder is only asked if the mode needs it and there are chunks."""
        _need(key=key, query=query)
        if not self.store.exists(key):
            raise KeyNotFound(key)
        self._not_trashed(key)
        warnings = []
        try:
            row = self._key_row(key)
            if row is not None and row.last_accessed_at != self._time():  # once a second is enough for a time in seconds
                with self.store.locks.hold(key, self._closing.is_set):
                    state = self.store.state(key)
                    self.store.save_keys(key, tr.touch(state, self.spark.createDataFrame([(key,)], "key string"), self._time()).keys)
        except Exception as e:  # noqa: BLE001 - a query does not fail for it
            warnings.append(f"time of access not kept: {e}")
        state = self.store.state(key)
        vectors = state.embeddings.select(F.col("chunk_id").alias("id"), "vector")
        chunks = scan(state.chunks.join(vectors, "id", "left"), state.records, state.series_keys, key, series or None)
        mode = mode or "all"
        vector = None
        if mode not in ("lex", "grep") and not chunks.isEmpty():
            asked = embed_all(self.embedder, [query])
            if asked.skipped:
                raise RuntimeError(f"the query can't be embedded: {asked.error}")
            vector = asked.vectors[0]
        found = search(chunks, query, vector, mode, top_n, self.reranker, self.k1, self.b)
        found.warnings[:0] = warnings
        return found

    def list_indexes(self) -> list[dict]:
        read = self.store.whole
        listed = tr.list_keys(read("keys"), read("records", ("id",)), read("series_keys", ("record_id",)), read("chunks", ("id", "record_id")))
        return [r.asDict() for r in listed.collect()]

    def _trash(self, key: str, now: datetime | None) -> None:
        _need(key=key)
        with self.store.locks.hold(key, self._closing.is_set):
            row = self._key_row(key)
            if row is None:
                raise KeyNotFound(key)
            if now is not None and row.trashed_at is not None:
                raise KeyTrashed(key)
            if now is None and row.trashed_at is None:
                raise ValueError(f"key {key!r} is not in the trash")
            state = self.store.state(key)
            self.store.save_keys(key, tr.set_trashed(state, self.spark.createDataFrame([(key,)], "key string"), now).keys)

    def trash_index(self, key: str) -> dict:
        self._trash(key, self._time())
        return {"key": key, "trashed": True}

    def restore_index(self, key: str) -> dict:
        self._trash(key, None)
        return {"key": key, "restored": True}

    def list_trashed_indexes(self) -> list[dict]:
        return [r.asDict() for r in tr.list_trashed(self.store.whole("keys"), int(self.retention.total_seconds()), self._time()).collect()]

    def sync_documents(self, key: str, series: str, documents: Sequence[dict]) -> str:
        """Starts making a series hold just these documents; gives the job's id. An empty list detaches everything."""
        _need(key=key, series=series)
        self._not_trashed(key)
        job = self.jobs.start()
        thread = threading.Thread(target=self._sync, args=(job, key, series, list(documents)), daemon=True)
        self._threads = [t for t in self._threads if t.is_alive()] + [thread]
        thread.start()
        return job

    def _sync(self, job: str, key: str, series: str, documents: list[dict]) -> None:
        try:
            with self._changing("sync_documents", key):
                docs = self._documents(key, series, documents)
                state, outcomes, marked = tr.sync(self.store.state(key), docs, self._rows(key, series), self._time(), self.embedder, self.max_chunk_size)
                told = self._told(outcomes.orderBy("pos").collect())
                n = marked.count()
                self.store.commit(key, state)
            errors = [f"path {e['path']!r}: {e['error']}" for e in told.pop("errors")]
            self.jobs.update(job, **told, deleted_paths_marked=n, errors=errors, status="done")
        except Exception as e:  # noqa: BLE001 - the job's status is where errors go
            log.exception("sync_documents failed")
            self.jobs.update(job, status="failed", errors=[str(e)])

    def get_sync_status(self, job_id: str) -> SyncStatus:
        _need(job_id=job_id)
        return self.jobs.get(job_id)

    def schedule_delete_series(self, key: str, series: str) -> dict:
        """Reserves a series for deletion by a later sweep; a sync of the series undoes it."""
        _need(key=key, series=series)
        if not self.store.exists(key):
            raise KeyNotFound(key)
        with self._changing("schedule_delete_series", key):
            state, result = tr.mark_pending(self.store.state(key), self._rows(key, series, [tr.WHOLE_SERIES]), self._time())
            had = result.first().already_scheduled
            self.store.commit(key, state)
        return {"scheduled": True, "already_scheduled": had}

    def close(self) -> None:
        """Ends waiting for locks, and waits for running jobs."""
        self._closing.set()
        for t in self._threads:
            t.join()


@dataclass
class SweepStats:
    runs: int = 0
    keys_deleted: int = 0
    reservations_done: int = 0
    errors: list[str] = field(default_factory=list)
    last_run: datetime | None = None


class Sweeper:
    """Carries out deletions that are due: trashed keys first, then reservations. An error of one key leaves the others."""

    def __init__(self, service: Service, interval_seconds: float = 3600, retention: timedelta = timedelta(days=3)):
        self.service, self.interval, self.retention = service, interval_seconds if interval_seconds > 0 else 3600, retention
        self.stats, self._stop, self._thread = SweepStats(), threading.Event(), None

    def _due(self, cutoff: datetime) -> list[str]:
        """Keys that have something to carry out, found in one query; all, if that fails for one of them."""
        store = self.service.store
        try:
            keys = store.whole("keys")
            due = tr.trashed_before(keys, cutoff).select("key").unionByName(tr.pending_older_than(store.whole("pending"), keys, cutoff).select("key"))
            found = {r.key for r in due.distinct().collect()}
        except Exception:  # noqa: BLE001
            log.exception("the keys that are due can't be read at once")
            return store.keys()
        return [key for key in store.keys() if key in found]

    def sweep(self) -> SweepStats:
        service, store = self.service, self.service.store
        cutoff = service._time() - self.retention
        for key in self._due(cutoff):
            try:
                with store.locks.hold(key, self._stop.is_set), scratch():
                    state = store.state(key)
                    if not tr.trashed_before(state.keys, cutoff).isEmpty():
                        store.commit(key, tr.sweep_keys(state, cutoff))
                        self.stats.keys_deleted += 1
                        continue
                    due = tr.pending_older_than(state.pending, state.keys, cutoff).count()
                    if due:
                        store.commit(key, tr.sweep_pending(state, cutoff))
                        store.compact(key)
                        self.stats.reservations_done += due
            except Exception as e:  # noqa: BLE001
                log.exception("sweep of %s failed", key)
                self.stats.errors.append(f"{key}: {e}")
        for key in store.keys():
            try:
                with store.locks.hold(key, self._stop.is_set):
                    store.clean(key)
            except Exception as e:  # noqa: BLE001
                log.exception("cleaning of %s failed", key)
                self.stats.errors.append(f"{key}: {e}")
        self.stats.runs += 1
        self.stats.last_run = service._time()
        return self.stats

    def start(self) -> None:
        def run() -> None:
            while not self._stop.wait(self.interval):
                self.sweep()

        self._thread = threading.Thread(target=run, daemon=True)
        self._thread.start()

    def stop(self) -> None:
        self._stop.set()
        if self._thread:
            self._thread.join()
