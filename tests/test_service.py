import json
import time
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docpool.errors import KeyNotFound, KeyTrashed
from docpool.service import Service, Sweeper, SyncJobs
from docpool.sources.embedding import HashEmbedder
from docpool.sources.store import SnapshotStore
from docpool.streaming.ingest import ingest, manifests


class Clock:
    def __init__(self):
        self.now = datetime(2025, 6, 1, tzinfo=UTC)

    def __call__(self):
        return self.now


@pytest.fixture
def service(spark, tmp_path):
    return Service(SnapshotStore(spark, f"file://{tmp_path}/store"), HashEmbedder(16), now=Clock())


def paths(found):
    return [r.path for r in found.hits.collect()]


def done(service, job):
    for _ in range(900):
        if service.get_sync_status(job).status != "running":
            return service.get_sync_status(job)
        time.sleep(0.2)
    raise AssertionError("the job does not end")


def test_life_of_a_key(service):
    told = service.upsert_documents("K", "main", [{"path": "a.md", "content": "# A\nalpha foundation"}, {"path": "b.md", "content": "# B\nbeta runtime"}, {"path": "d.md", "content": ""}])
    assert (told["processed"], told["skipped"], told["failed"]) == (2, 0, 1)
    assert [e["path"] for e in told["errors"]] == ["d.md"]
    assert service.upsert_documents("K", "fx", [{"path": "a.md", "content": "# A\r\nalpha foundation"}])["skipped"] == 1
    assert paths(service.query("K", "alpha", mode="lex")) == ["a.md"]
    assert service.query("K", "alpha").hits.first().series_keys == ["fx", "main"]
    assert paths(service.query("K", "alpha", series="none")) == []
    assert [(r["key"], r["doc_count"], r["series"]) for r in service.list_indexes()] == [("K", 2, ["fx", "main"])]
    told = service.delete_documents("K", "main", ["b.md", "zz"])
    assert told["deleted"] == 1 and len(told["warnings"]) == 1
    assert service.delete_series("K", "fx") == {"removed_records": 0, "updated_records": 1}
    service.delete_series("K", "main")
    assert [(r["key"], r["chunk_count"], r["series"]) for r in service.list_indexes()] == [("K", 0, None)]
    with pytest.raises(KeyNotFound):
        service.query("none", "x")
    with pytest.raises(ValueError):
        service.query("K", "")


def test_keys_are_listed_apart(service):
    service.upsert_documents("K ä/1", "main", [{"path": "a.md", "content": "# A\none\n# B\ntwo"}, {"path": "b.md", "content": "three"}])
    service.upsert_documents("L", "fx", [{"path": "a.md", "content": "four"}])
    assert [(r["key"], r["doc_count"], r["chunk_count"], r["series"]) for r in service.list_indexes()] == [("K ä/1", 2, 3, ["main"]), ("L", 1, 1, ["fx"])]
    service.trash_index("K ä/1")
    assert [r["key"] for r in service.list_indexes()] == ["L"] and [r["key"] for r in service.list_trashed_indexes()] == ["K ä/1"]


def test_trash_and_sweep(service):
    service.upsert_documents("K", "main", [{"path": "a.md", "content": "text"}])
    assert service.schedule_delete_series("K", "main") == {"scheduled": True, "already_scheduled": False}
    assert service.schedule_delete_series("K", "main")["already_scheduled"]
    service.trash_index("K")
    for call in (lambda: service.query("K", "x"), lambda: service.upsert_documents("K", "m", [{"path": "a", "content": "b"}]), lambda: service.trash_index("K"), lambda: service.sync_documents("K", "m", [])):
        with pytest.raises(KeyTrashed):
            call()
    assert service.list_trashed_indexes()[0]["remaining_seconds"] == 3 * 86400
    assert service.list_indexes() == []
    service.restore_index("K")
    with pytest.raises(ValueError):
        service.restore_index("K")
    service.now.now += timedelta(days=4)
    sweeper = Sweeper(service)
    assert sweeper.sweep().reservations_done == 1
    assert service.list_indexes()[0]["chunk_count"] == 0
    service.trash_index("K")
    service.now.now += timedelta(days=4)
    assert sweeper.sweep().keys_deleted == 1
    assert service.store.keys() == []
    assert sweeper.stats.errors == []


def test_sync_jobs(service):
    status = done(service, service.sync_documents("K", "main", [{"path": "a.md", "content": "x"}, {"path": "b.md", "content": "y"}]))
    assert (status.status, status.processed) == ("done", 2)
    status = done(service, service.sync_documents("K", "main", []))
    assert status.deleted_paths_marked == 2
    assert paths(service.query("K", "y", series="main", mode="grep")) == []
    assert paths(service.query("K", "y", mode="grep")) == ["b.md"]
    with pytest.raises(LookupError):
        service.get_sync_status("none")
    service.close()


def test_finished_jobs_are_let_go():
    jobs = SyncJobs(kept=2)
    names = []
    for _ in range(4):
        names.append(jobs.start())
        jobs.update(names[-1], status="done")
    with pytest.raises(LookupError):
        jobs.get(names[0])
    assert jobs.get(names[-1]).status == "done"


def test_compaction_and_dimension(spark, service, tmp_path):
    service.upsert_documents("K/ä", "main", [{"path": "a.md", "content": "one"}, {"path": "a.md", "content": "two"}])
    before = service.store.state("K/ä").chunks.select("text").collect()
    opened = service.store.state("K/ä").chunks
    service.store.compact("K/ä")
    service.store.clean("K/ä")
    assert opened.count() >= 0  # the snapshot that was opened before can still be read
    service.store.clock = lambda: time.time() + 7200
    service.store.clean("K/ä")
    assert [r.text for r in before] == [r.text for r in service.store.state("K/ä").chunks.collect()] == ["two"]
    with pytest.raises(ValueError):
        SnapshotStore(spark, service.store.base, dim=3)
    SnapshotStore(spark, service.store.base, dim=16)


def test_stream(spark, service, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [{"key": "K", "series": "main", "pos": i, "path": f"{i}.md", "content": f"text {i}"} for i in range(3)]
    (folder / "1.json").write_text("\n".join(map(json.dumps, rows)))
    ingest(service, manifests(spark, str(folder)), str(tmp_path / "checkpoint")).awaitTermination()
    assert service.store.state("K").records.count() == 3
    state = service.store.state("K")
    assert (state.records.count(), state.chunks.count()) == (3, 3)
    assert state.keys.where(F.col("doc_count") == 3).count() == 1
