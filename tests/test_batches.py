import random

import numpy as np
import pytest
from pyspark.sql.readwriter import DataFrameWriter

from docpool.operators.batches import _by_key, _held, hybrid_of_batch
from docpool.operators.retrieval import search_batch
from docpool.operators.signals import score_batch
from docpool.plans.retrieval import hybrid_batch

CHUNKS = "id long, key string, text string, vector array<float>"
ASKED = "query_id long, key string, query string, vector array<float>"


def corpus(seed: int, n: int):
    """Many equal texts and vectors, none at all, and vectors of another length."""
    rng = random.Random(seed)
    vectors = [[rng.uniform(-1, 1) for _ in range(3)] for _ in range(12)] + [None, [0.0, 0.0, 0.0], [1.0, 2.0], [float("nan"), 1.0, 1.0]]
    text = lambda: " ".join(rng.choices(["alpha", "alphabet", "Beta", "DES-1", "ＤＥＳ-12", "gamma", "見出し", "x_des-1"], k=rng.randrange(0, 9)))
    rows = [(i * 7 % 1009, f"K{min(rng.randrange(4), 2)}" if rng.random() < 0.95 else None, text() if rng.random() < 0.95 else None, rng.choice(vectors)) for i in range(n)]
    asked = [(q, f"K{q % 4}" if q % 9 else None, rng.choice([text(), text().upper(), None, "??", "zzz", "beta  alpha", "des-1", "a_des-1 des-1"]), rng.choice(vectors)) for q in range(60)]
    return rows, asked


@pytest.mark.parametrize(("n", "most", "options"), [(700, 10, {}), (700, 3, {"hot_chunks": 60}), (40, 10, {"held_bytes": 1500, "hot_chunks": 9})])
def test_hybrid_of_batch_is_hybrid_of_all_pairs(spark, n, most, options):
    rows, asked = corpus(n + most, n)
    chunks, queries = spark.createDataFrame(rows, CHUNKS), spark.createDataFrame(asked, ASKED)
    columns = ["query_id", "place", "chunk_id", "emb", "lex", "fallback", "rrf"]
    wanted = search_batch(score_batch(chunks, queries), "hybrid", most).select(*columns).orderBy("query_id", "place").collect()
    found = hybrid_of_batch(chunks, queries, most, **options)
    assert dict(found.select(*columns).dtypes)["place"] == "int"
    found = found.select(*columns).orderBy("query_id", "place").collect()
    assert len(found) > 100 and len({r.fallback for r in found}) == 2
    assert [tuple(r) for r in found] == [pytest.approx(tuple(r), abs=1e-12) for r in wanted]


def test_nothing_asked_or_nothing_there(spark):
    rows, asked = corpus(1, 5)
    assert hybrid_of_batch(spark.createDataFrame(rows, CHUNKS), spark.createDataFrame([], ASKED)).count() == 0
    assert hybrid_of_batch(spark.createDataFrame([], CHUNKS), spark.createDataFrame(asked, ASKED)).count() == 0


def test_what_tasks_hold_needs_no_copy_of_the_package(spark):
    queries, strings, longer = _by_key(spark.createDataFrame(corpus(2, 1)[1], ASKED).toArrow())
    assert {*strings} == {*longer} == {"K0", "K1", "K2", "K3"}
    assert all(b"docpool" not in _held(own, np.zeros(3), 1.0) for own in queries.values())


def test_hybrid_batch_writes_no_row_for_each_pair(spark, tmp_path, monkeypatch):
    rows, asked = corpus(5, 400)
    spark.createDataFrame([r for r in rows if r[1]], CHUNKS).write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([(q, k, t or "", rows[q][0]) for q, k, t, _ in asked if k], "query_id long, key string, query_text string, chunk_id long").write.parquet(f"{tmp_path}/search_results.parquet")
    written, write = [], DataFrameWriter.parquet

    def counted(self, path, *a, **k):
        write(self, path, *a, **k)
        written.append(spark.read.parquet(path).count())

    monkeypatch.setattr(DataFrameWriter, "parquet", counted)
    found = hybrid_batch(spark, str(tmp_path)).count()
    pairs = sum(r[1] == k for r in rows if r[1] for _, k, _, _ in asked)
    assert found > 300 and sum(written) < len(rows) + len(asked) + 2 * found < pairs / 3
