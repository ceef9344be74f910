import hashlib
import random
import sys
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from docpool.operators import transitions as tr
from docpool.schema import TABLES
from docpool.sources.embedding import HashEmbedder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NOW = datetime(2025, 6, 1, 12, 0, 0)
DOCS = "key string, series string, pos long, path string, content string, error string"


@pytest.fixture
def state(spark):
    """K: record 1 (a) in main and fx, 2 (b) in fx, 3 (c) in main, 4 (b, older) in none."""
    tables = {
        "keys": [("K", 9, NOW, NOW, None), ("T", 0, NOW, NOW, NOW - timedelta(days=5))],
        "records": [(i, "K", p, h, NOW, NOW) for i, p, h in ((1, "a", "ha"), (2, "b", "hb"), (3, "c", "hc"), (4, "b", "hb0"))],
        "series_keys": [(1, "main"), (1, "fx"), (2, "fx"), (3, "main"), (3, "main")],
        "chunks": [(i, i, 0, "H", f"text {i}", f"text {i}") for i in (1, 2, 3, 4)],
        "embeddings": [(i, [1.0, 0.0], 2) for i in (1, 2, 3)],
        "pending": [("K", "fx", "", NOW - timedelta(days=9)), ("K", "fx", "b", NOW - timedelta(days=9)), ("T", "main", "x", NOW - timedelta(days=9))],
    }
    return tr.State(**{t: spark.createDataFrame(tables[t], TABLES[t]) for t in TABLES})


def ids(state):
    return sorted(r.id for r in state.records.collect())


def links(state):
    return sorted((r.record_id, r.series) for r in state.series_keys.distinct().collect())


def pending(state):
    return sorted((r.key, r.series, r.path) for r in state.pending.collect())


def count(state, key="K"):
    return state.keys.where(F.col("key") == key).first().doc_count


def frame(spark, *rows, columns="key string, series string, path string"):
    return spark.createDataFrame(list(rows), columns)


def test_delete_documents(spark, state):
    state, result = tr.delete_documents(state, frame(spark, ("K", "fx", "b"), ("K", "fx", "nope"), ("K", "fx", "a")))
    assert {r.path: r.found for r in result.collect()} == {"a": True, "b": True, "nope": False}
    assert ids(state) == [1, 3]
    assert links(state) == [(1, "main"), (3, "main")]
    assert count(state) == 2
    assert sorted(r.id for r in tr.live(state).chunks.collect()) == [1, 3]
    assert sorted(r.chunk_id for r in tr.live(state).embeddings.collect()) == [1, 3]


def test_delete_series(spark, state):
    state, result = tr.delete_series(state, frame(spark, ("K", "fx"), ("K", "none"), columns="key string, series string"))
    assert {r.series: (r.removed_records, r.updated_records) for r in result.collect()} == {"fx": (1, 1), "none": (0, 0)}
    assert ids(state) == [1, 3, 4]
    assert pending(state) == [("K", "fx", "b"), ("T", "main", "x")]


def test_delete_keys(spark, state):
    state = tr.delete_keys(state, spark.createDataFrame([("K",)], "key string"))
    assert ids(state) == [] and links(state) == []
    assert pending(state) == [("T", "main", "x")]
    assert [r.key for r in state.keys.collect()] == ["T"]


def test_detach_and_orphans(spark, state):
    state, result = tr.detach(state, frame(spark, ("K", "fx", "b"), ("K", "fx", "a")))
    assert {r.path: r.orphaned for r in result.collect()} == {"a": False, "b": True}
    assert ids(state) == [1, 2, 3, 4]
    state = tr.delete_orphans(state, spark.createDataFrame([("K", "b"), ("K", "a")], "key string, path string"))
    assert ids(state) == [1, 3]
    assert count(state) == 2


def test_reservations(spark, state):
    state, result = tr.mark_pending(state, frame(spark, ("K", "fx", "b"), ("K", "main", "a")), NOW)
    assert {r.path: r.already_scheduled for r in result.collect()} == {"a": False, "b": True}
    assert len(pending(state)) == 4
    assert state.pending.where((F.col("path") == "b")).first().marked_at == NOW
    state = tr.clear_pending(state, frame(spark, ("K", "fx", "b"), ("K", "zz", "b")))
    assert ("K", "fx", "b") not in pending(state)


def test_cutoff_is_strict(spark, state):
    rows = [("K", "s", p, NOW + timedelta(seconds=d)) for p, d in (("before", -1), ("at", 0), ("after", 1))]
    due = tr.pending_older_than(spark.createDataFrame(rows, TABLES["pending"]), state.keys, NOW)
    assert [r.path for r in due.collect()] == ["before"]


def test_sweeps(spark, state):
    swept = tr.sweep_pending(state, NOW - timedelta(days=3))
    assert pending(swept) == [("T", "main", "x")]
    assert ids(swept) == [1, 3]
    stale = replace(state, pending=spark.createDataFrame([("K", "main", "a", NOW - timedelta(days=9))], TABLES["pending"]))
    assert ids(tr.sweep_pending(stale, NOW)) == [1, 2, 3, 4]
    assert [r.key for r in tr.sweep_keys(state, NOW - timedelta(days=3)).keys.collect()] == ["K"]


def test_lists(spark, state):
    listed = tr.list_keys(state.keys, state.records, state.series_keys, state.chunks).collect()
    assert [(r.key, r.chunk_count, r.series) for r in listed] == [("K", 4, ["fx", "main"])]
    bare = replace(state, series_keys=state.series_keys.limit(0), records=state.records.limit(0))
    assert [(r.chunk_count, r.series) for r in tr.list_keys(bare.keys, bare.records, bare.series_keys, bare.chunks).collect()] == [(0, None)]
    trashed = tr.list_trashed(state.keys, 6 * 86400, NOW).collect()
    assert [(r.key, r.remaining_seconds) for r in trashed] == [("T", 86400)]
    assert tr.list_trashed(state.keys, 86400, NOW).first().remaining_seconds == 0
    again = tr.set_trashed(state, spark.createDataFrame([("T",)], "key string"), None)
    assert tr.list_trashed(again.keys, 1, NOW).isEmpty()
    assert tr.touch(state, spark.createDataFrame([("K",)], "key string"), NOW + timedelta(days=1)).keys.where(F.col("key") == "K").first().last_accessed_at == NOW + timedelta(days=1)


def docs(spark, *rows):
    return spark.createDataFrame([(k, s, i, p, c, None) for i, (k, s, p, c) in enumerate(rows)], DOCS)


def outcome(rows):
    return {(r.pos): r.outcome for r in rows.collect()}


def test_upsert_in_order(spark, state):
    empty = tr.State(**{t: spark.createDataFrame([], TABLES[t]) for t in TABLES})
    given = docs(spark, ("K", "main", "a", "v1"), ("K", "main", "a", "v2"), ("K", "main", "b", "# T\ntext"), ("K", "main", "", "x"), ("K", "main", "l", "y" * 70000))
    found, outcomes = tr.upsert(empty, given, NOW, HashEmbedder(4))
    assert outcome(outcomes) == {0: "processed", 1: "processed", 2: "processed", 3: "failed", 4: "failed"}
    assert tr.outcome_counts(outcomes).first()[2:] == (3, 0, 2)
    live = tr.live(found)
    assert sorted((r.path, r.text) for r in live.chunks.join(live.records.select(F.col("id").alias("record_id"), "path"), "record_id").collect()) == [("a", "v2"), ("b", "# T\ntext")]
    assert live.embeddings.count() == 2
    assert count(found) == 2
    # the same content for another series is linked only
    later = NOW + timedelta(hours=1)
    second, outcomes = tr.upsert(found, docs(spark, ("K", "fx", "a", "v2")), later, HashEmbedder(4))
    assert outcome(outcomes) == {0: "skipped"}
    assert [r.series for r in second.series_keys.orderBy("series").collect()] == ["fx", "main", "main"]
    assert second.keys.first().last_updated_at == NOW


def one_by_one(records, links, given):
    """What upserting in rounds does, in plain Python: outcomes, and (path, content, series) held in the end."""
    known = {i: (p, h) for i, p, h in records}
    held = set(links)
    turns, result = {}, {}
    for pos, (series, path, text) in enumerate(given):
        turns.setdefault((series, path), []).append((pos, series, path, text))
    for n in range(max(map(len, turns.values()), default=0)):
        now = [t[n] for t in turns.values() if len(t) > n]
        at_start = {v: i for i, v in sorted(known.items(), reverse=True)}
        kept, before = [], set(at_start)
        for pos, series, path, text in now:
            result[pos] = "skipped" if (path, text) in before else "processed"
            i = at_start.setdefault((path, text), max([0, *known, *at_start.values()]) + 1)
            known[i] = (path, text)
            kept.append((i, path, series))
        held |= {(i, s) for i, _, s in kept}
        for i, path, series in kept:
            held -= {(j, series) for j in known if known[j][0] == path and j != i}
        paths = {path for _, path, _ in kept}
        known = {i: v for i, v in known.items() if v[0] not in paths or any(j == i for j, _ in held)}
    return result, {(*known[i], s) for i, s in held if i in known}, {v for v in known.values()}


@pytest.mark.parametrize("seed", range(3))
def test_upsert_equals_one_after_the_other(spark, seed):
    rng = random.Random(seed)
    texts = ["one", "two", "three"]
    hashed = {hashlib.sha256(t.encode()).hexdigest(): t for t in texts}
    names = {t: h for h, t in hashed.items()}
    records = [(i, rng.choice("ab"), rng.choice(texts)) for i in range(1, 6)]
    records = list({(p, t): (i, p, t) for i, p, t in records}.values())
    links = {(i, rng.choice(["main", "fx", "old"])) for i, _, _ in records if rng.random() < 0.8}
    given = [(rng.choice(["main", "fx"]), rng.choice("abc"), rng.choice(texts)) for _ in range(25)]
    empty = tr.State(**{t: spark.createDataFrame([], TABLES[t]) for t in TABLES})
    state = replace(empty, records=spark.createDataFrame([(i, "K", p, names[t], NOW, NOW) for i, p, t in records], TABLES["records"]), series_keys=spark.createDataFrame(sorted(links) or [], TABLES["series_keys"]))
    found, outcomes = tr.upsert(state, docs(spark, *[("K", s, p, t) for s, p, t in given]), NOW, HashEmbedder(4))
    wanted, held, left = one_by_one(records, links, given)
    assert outcome(outcomes) == wanted
    rows = {r.id: (r.path, hashed[r.content_hash]) for r in found.records.collect()}
    assert len(set(rows.values())) == len(rows) and set(rows.values()) == left
    assert {(*rows[i], s) for i, s in links_of(found)} == held
    chunks = tr.live(found).chunks.collect()
    assert {rows[c.record_id][1] for c in chunks} == {c.text for c in chunks} and len({c.id for c in chunks}) == len(chunks)


def links_of(state):
    return {(r.record_id, r.series) for r in state.series_keys.collect()}


class Failing:
    def embed(self, texts):
        raise RuntimeError("no vectors today")


def test_text_stays_when_embedding_fails(spark):
    empty = tr.State(**{t: spark.createDataFrame([], TABLES[t]) for t in TABLES})
    found, outcomes = tr.upsert(empty, docs(spark, ("K", "main", "a", "text")), NOW, Failing())
    row = outcomes.first()
    assert (row.outcome, row.skipped_chunks) == ("processed", 1)
    assert "no vectors" in row.error
    assert tr.live(found).chunks.count() == 1
    assert tr.live(found).embeddings.count() == 0


def test_sync(spark, state):
    target = spark.createDataFrame([("K", "main")], "key string, series string")
    state = replace(state, pending=spark.createDataFrame([("K", "main", p, NOW) for p in ("", "b", "old")] + [("K", "fx", "", NOW)], TABLES["pending"]))
    found, outcomes, marked = tr.sync(state, docs(spark, ("K", "main", "a", "new a"), ("K", "main", "b", "new b"), ("K", "main", "", "bad")), target, NOW, HashEmbedder(4))
    assert outcome(outcomes) == {0: "processed", 1: "processed", 2: "failed"}
    assert [r.path for r in marked.collect()] == ["c"]
    assert pending(found) == [("K", "fx", ""), ("K", "main", "c"), ("K", "main", "old")]
    assert ids(found) == [1, 2, 3, 5, 6]  # 4, an orphan of b, is gone with the reservation; 3 waits for its own


def test_sync_again_skips_what_is_there_and_undoes_reservations(spark, state):
    target = spark.createDataFrame([("K", "main")], "key string, series string")
    found, outcomes, marked = tr.sync(state, docs(spark, ("K", "main", "a", "new a"), ("K", "main", "", "bad")), target, NOW, HashEmbedder(4))
    assert outcome(outcomes) == {0: "processed", 1: "failed"}
    assert [r.path for r in marked.collect()] == ["c"]
    assert ("K", "main", "c") in pending(found) and 3 in ids(found)
    back, outcomes, _ = tr.sync(found, docs(spark, ("K", "main", "a", "new a"), ("K", "main", "c", "c again")), target, NOW, HashEmbedder(4))
    assert outcome(outcomes) == {0: "skipped", 1: "processed"}
    assert ("K", "main", "c") not in pending(back) and 3 not in ids(back)
