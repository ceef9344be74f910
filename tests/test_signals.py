import math
import random

import pytest
from pyspark.sql import functions as F

from docpool.operators import fusion as fu
from docpool.operators import signals as sg

CHUNK = "id long, key string, path string, heading_path string, text string, vector array<float>"


def chunks(spark, texts, vectors=None):
    vectors = vectors or [None] * len(texts)
    return spark.createDataFrame([(i, "K", f"p{i}", "H", t, v) for i, (t, v) in enumerate(zip(texts, vectors, strict=True))], CHUNK)


def scored(spark, emb, lex, grep):
    return spark.createDataFrame(list(zip(range(len(emb)), map(float, emb), map(float, lex), grep, strict=True)), "chunk_id long, emb double, lex double, grep long")


@pytest.mark.parametrize(("a", "b", "wanted"), [([1.0, 2.0], [1.0, 2.0], 1), ([1.0, 0.0], [0.0, 1.0], 0), ([1.0, 0.0], [-1.0, 0.0], -1), ([], [1.0], 0), ([1.0], [1.0, 2.0], 0), ([0.0, 0.0], [1.0, 2.0], 0), (None, [1.0], 0)])
def test_cosine(spark, a, b, wanted):
    row = spark.createDataFrame([(a, b)], "a array<float>, b array<float>").select(sg.cosine_to(F.col("a"), b).alias("x"), sg.cosine("a", "b").alias("y")).first()
    assert row.x == pytest.approx(wanted)
    assert row.y == pytest.approx(wanted)


def lex(spark, query, texts):
    return [r.lex for r in sg.score(chunks(spark, texts), query, signals=("lex",)).orderBy("chunk_id").collect()]


def test_bm25_formula(spark):
    texts = ["apple pie", "apple apple apple", "plum", ""]
    n, df, avgdl = 4, 2, sum(map(len, texts)) / 4
    weight = math.log((n - df + 0.5) / (df + 0.5) + 1)
    for found, text in zip(lex(spark, "apple apple", texts), texts, strict=True):
        tf = text.count("apple")
        wanted = 2 * weight * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(text) / avgdl)) if tf else 0
        assert found == pytest.approx(wanted + 2 * ("apple apple" in text), abs=1e-8)


def test_bonuses(spark):
    hit, miss = lex(spark, "QX-77", ["see qx-77", "nothing"])
    assert hit >= 12 and miss == 0
    assert lex(spark, "qx-77 and qx-77", ["qx-77", "x"])[0] >= 20
    assert lex(spark, "!!!", ["!!!", "x"]) == [0, 0]


def test_grep(spark):
    found = sg.score(chunks(spark, ["QX-77 and ＱＸ-77", "qx-77", "x", None]), " QX-77 ", signals=("grep",)).orderBy("chunk_id").collect()
    assert [r.grep for r in found] == [2, 1, 0, 0]
    assert [r.grep for r in sg.score(chunks(spark, ["a"]), "  ", signals=("grep",)).collect()] == [0]


def test_batch_equals_single(spark):
    texts = ["alpha beta", "beta gamma beta", "delta DES-1", "", "alpha"]
    vectors = [[1.0, 0.0], [0.5, 0.5], None, [0.0, 0.0], [0.0, 1.0, 1.0]]
    rows = chunks(spark, texts, vectors)
    asked = [(1, "K", "beta alpha beta", [1.0, 1.0]), (2, "K", "des-1", None), (3, "other", "beta", [1.0, 0.0]), (4, "K", "??", [1.0, 0.0])]
    batch = sg.score_batch(rows, spark.createDataFrame(asked, "query_id long, key string, query string, vector array<float>"))
    found = {(r.query_id, r.chunk_id): (r.emb, r.lex, r.grep) for r in batch.collect()}
    assert len(found) == 15
    for i, _, query, vector in asked:
        if i != 3:
            for r in sg.score(rows, query, vector).collect():
                assert found[i, r.chunk_id] == pytest.approx((r.emb, r.lex, r.grep), abs=1e-8)


def test_batch_in_a_join_and_with_a_cap(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choices(["alpha", "beta", "des-1", "gamma"], k=rng.randrange(0, 9))) for _ in range(40)]
    rows = chunks(spark, texts, [[rng.uniform(-1, 1), rng.uniform(-1, 1)] if rng.random() < 0.9 else None for _ in texts])
    asked = spark.createDataFrame([(1, "K", "beta alpha beta", [1.0, 1.0]), (2, "K", "des-1 gamma", None), (3, "K", None, [0.0, 0.0])], "query_id long, key string, query string, vector array<float>")
    of = lambda df: {(r.query_id, r.chunk_id): (r.emb, r.lex, r.grep) for r in df.collect()}
    held = of(sg.score_batch(rows, asked))
    assert len(held) == 120 and of(sg.score_batch(rows, asked, held_bytes=0)) == {k: pytest.approx(v, abs=1e-8) for k, v in held.items()}
    capped = of(sg.score_batch(rows, asked, cap=5))
    assert capped.items() <= held.items() and len(capped) < len(held)
    best = [{(r.query_id, r.chunk_id, tuple(r.origin_signals)) for r in fu.merge_order(fu.merge_signals(sg.score_batch(rows, asked, cap=c), ["query_id"], 5), ["query_id"], 5).collect()} for c in (None, 30)]
    assert best[0] == best[1]


def test_reciprocal_ranks(spark):
    rows = {r.chunk_id: r.rrf for r in fu.reciprocal_ranks(scored(spark, [3, 2, 1], [1, 2, 3], [0, 0, 0]), []).collect()}
    assert rows[0] == rows[2] == pytest.approx(1 / 61 + 1 / 63)
    assert rows[1] == pytest.approx(2 / 62)


def test_fallback_to_vectors(spark):
    found = fu.hybrid(scored(spark, [0.1, 0.9, 0.5], [0, 0, 0], [0, 0, 0]), [], 3).orderBy("place").collect()
    assert [(r.chunk_id, r.rrf, r.fallback) for r in found] == [(1, 0.9, True), (2, 0.5, True), (0, 0.1, True)]


def plain_hybrid(emb, lex, n, k=5):
    ids = range(len(emb))
    by_emb, by_lex = sorted(ids, key=lambda i: (-emb[i], i)), [i for i in sorted(ids, key=lambda i: (-lex[i], i)) if lex[i] > 0]
    hits = sum(e > 0 for e in emb), len(by_lex)
    if hits[0] and hits[1] / hits[0] < 0.05:
        return by_emb[:n]
    rrf = dict.fromkeys(ids, 0.0)
    for ranking in (by_emb, by_lex):
        for r, i in enumerate(ranking, 1):
            rrf[i] += 1 / (60 + r)
    fused = sorted(ids, key=lambda i: (-rrf[i], i))
    intruders = [rrf[i] for i in fused[:k] if i not in by_emb[:k]]
    for r, i in enumerate(by_emb[:k]):
        if intruders and i not in fused[:k]:
            rrf[i] = max(intruders) + (k - r) * 1e-9
    return sorted(ids, key=lambda i: (-rrf[i], i))[:n]


@pytest.mark.parametrize("n", [3, 12])
def test_hybrid_against_a_plain_model(spark, n):
    emb = [((i * 37) % 101) / 50 - 1 for i in range(60)]
    lex = [((i * 53) % 97) / 10 if i % 3 else 0.0 for i in range(60)]
    both = scored(spark, emb, lex, [0] * 60).withColumn("query_id", F.lit(1)).unionByName(scored(spark, lex, emb, [0] * 60).withColumn("query_id", F.lit(2)))
    assert [r.chunk_id for r in fu.hybrid(scored(spark, emb, lex, [0] * 60), [], n).orderBy("place").collect()] == plain_hybrid(emb, lex, n)
    found = fu.hybrid(both, ["query_id"], n).orderBy("query_id", "place").collect()
    assert [r.chunk_id for r in found if r.query_id == 1] == plain_hybrid(emb, lex, n)
    assert [r.chunk_id for r in found if r.query_id == 2] == plain_hybrid(lex, emb, n)


def test_merge(spark):
    merged = fu.merge_order(fu.merge_signals(scored(spark, [0.9, 0.5, 0], [0.7, 0, 0], [0, 0, 3]), [], 10), [], 10).orderBy("place").collect()
    assert [(r.chunk_id, r.origin_signals) for r in merged] == [(0, ["emb", "lex"]), (1, ["emb"]), (2, ["grep"])]


def test_merge_caps_vectors_and_words_but_not_grep(spark):
    n = 50
    merged = fu.merge_signals(scored(spark, [i + 1 for i in range(n)], [0] * n, [1] * n), [], 10).collect()
    assert len(merged) == n
    assert sum("emb" in r.origin_signals for r in merged) == 30
