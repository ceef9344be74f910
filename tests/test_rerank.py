import json

import pytest
from pyspark.sql import functions as F

from docpool.operators import rerank as rr
from docpool.operators.retrieval import search

CHUNK = "id long, path string, heading_path string, text string, vector array<float>"


@pytest.mark.parametrize(("found", "n", "wanted"), [(0, 10, 0), (5, 1, 5), (6, 1, 6), (40, 10, 30), (40, 35, 35), (40, 60, 40)])
def test_candidate_count(found, n, wanted):
    assert rr.candidate_count(found, n) == wanted


@pytest.mark.parametrize(
    ("ranking", "scores", "dropped"),
    [
        ([{"id": "0", "score": 0.9}, {"id": "99", "score": 0.5}, {"id": "2", "score": 0.3}], [0.9, -1, 0.3], ["99"]),
        ([{"id": 1, "score": 0.7}], [-1, 0.7, -1], []),
        ([{"id": "1", "score": 0.3}, {"id": "1", "score": 0.8}], [-1, 0.8, -1], []),
        ([{"id": "x", "score": 1}, {"id": None}], [-1, -1, -1], ["x", "None"]),
    ],
)
def test_parse_scores(ranking, scores, dropped):
    assert rr.parse_scores(json.dumps({"ranking": ranking}), 3) == (scores, dropped)


def test_what_is_no_ranking():
    with pytest.raises(ValueError):
        rr.parse_scores("not json", 1)


def test_request_and_preview(spark):
    asked = json.loads(rr.request("q", [rr.Candidate(7, "a"), rr.Candidate(9, "b")]))
    assert asked == {"query": "q", "candidates": [{"id": "0", "preview": "a"}, {"id": "1", "preview": "b"}]}
    row = spark.createDataFrame([("H", "w " * 300)], "h string, t string").select(rr.preview(F.col("h"), F.col("t")).alias("p")).first()
    assert row.p == "H " + " ".join(["w"] * 199)


class Judge:
    def __init__(self, answer):
        self.answer, self.seen = answer, None

    def scores(self, query, candidates):
        self.seen = candidates
        if isinstance(self.answer, Exception):
            raise self.answer
        return self.answer


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(1, "a.md", "H", "# H\nalpha foundation", [1.0, 0.0, 0.0]), (2, "b.md", "H", "# H\nbeta runtime", [0.5, 1.0, 0.0]), (3, "c.md", "H", "# H\ngamma alpha alpha", [0.2, 0.0, 1.0]), (4, "d.md", "H", "x", None)]
    return spark.createDataFrame(rows, CHUNK)


def paths(found):
    return [r.path for r in found.hits.collect()]


def test_modes(corpus):
    vector = [1.0, 0.0, 0.0]
    assert paths(search(corpus, "alpha", vector, "emb")) == ["a.md", "b.md", "c.md", "d.md"]
    assert paths(search(corpus, "alpha", vector, "lex")) == ["c.md", "a.md"]
    grep = search(corpus, "alpha", vector, "grep")
    assert paths(grep) == ["c.md", "a.md"]
    assert [r.score for r in grep.hits.collect()] == [2.0, 1.0]
    hybrid = search(corpus, "alpha", vector, "hybrid")
    assert len(paths(hybrid)) == 4
    assert [r.origin_signals for r in hybrid.hits.collect() if r.path == "d.md"] == [[]]
    found = search(corpus, "alpha", vector)
    assert paths(found) == ["a.md", "c.md", "b.md"]
    assert found.stats["merged_candidates"] == 3
    assert found.stats["emb_candidates"] == 3
    first = found.hits.first()
    assert first.origin_signals == ["emb", "lex", "grep"]
    assert first.score == pytest.approx(max(first.score_breakdown.emb, first.score_breakdown.lex, first.score_breakdown.grep))
    assert paths(search(corpus, "alpha", vector, n=1)) == ["a.md"]
    with pytest.raises(ValueError):
        search(corpus, "alpha", vector, "nonsense")


def test_nothing_to_search(corpus):
    assert paths(search(corpus.limit(0), "alpha", None, "nonsense")) == []


def test_rerank_reverses(corpus):
    judge = Judge([0.1, 0.9, -1.0])
    found = search(corpus, "alpha", [1.0, 0.0, 0.0], "rerank", reranker=judge)
    assert [c.chunk_id for c in judge.seen] == [1, 3, 2]
    assert judge.seen[0].preview == "H\n# H\nalpha foundation"
    assert paths(found) == ["c.md", "a.md", "b.md"]
    assert [r.score for r in found.hits.collect()] == [0.9, 0.1, 0.0]
    assert found.stats["rerank_candidates"] == 3


@pytest.mark.parametrize("answer", [RuntimeError("down"), [0.5]])
def test_rerank_falls_back(corpus, answer):
    found = search(corpus, "alpha", [1.0, 0.0, 0.0], "rerank", reranker=Judge(answer))
    assert paths(found) == ["a.md", "c.md", "b.md"]
    assert found.stats["rerank_candidates"] == 0
    assert len(found.warnings) == 1
    assert [r.score for r in found.hits.collect()] == [0, 0, 0]
    assert search(corpus, "alpha", [1.0, 0.0, 0.0], "rerank").warnings == []
