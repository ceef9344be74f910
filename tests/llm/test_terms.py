import math
from collections import Counter

import pytest

from docpool.llm.terms import distinctive_terms, row_terms

ROW = "id long, text string, kind string, term string, score double"


def frame(spark, *texts):
    return spark.createDataFrame([(i, t, "clash", "clash", 1.0) for i, t in enumerate(texts)], ROW)


def found(df):
    return {(r.row_id, r.term): r for r in df.collect()}


def test_row_terms():
    assert row_terms("FNC-001 ＡＢＣ abc 日本語x1y ab 123 für a_b") == Counter({"fnc-001": 1, "abc": 2, "x1y": 1, "a_b": 1})
    assert row_terms("") == Counter()


def test_score_against_the_formula(spark):
    texts = ["zeta zeta zeta common", "common common word", "zeta word common", "", None]
    got = found(distinctive_terms(frame(spark, *texts), "doc", "id", "text"))
    counts = [row_terms(t) for t in texts if t]
    n = sum(map(sum, (c.values() for c in counts)))
    for i, c in enumerate(counts):
        for term, k in c.items():
            col, row = sum(x[term] for x in counts), sum(c.values())
            cells = [(k, row * col), (col - k, (n - row) * col), (row - k, row * (n - col)), (n - row - col + k, (n - row) * (n - col))]
            wanted = 2 * sum(a * math.log(a * n / e) for a, e in cells if a)
            assert got[i, term].score == pytest.approx(wanted, abs=1e-9)
            assert got[i, term].rows == sum(term in x for x in counts)
            assert got[i, term].over == (k * n > row * col)
    assert len(got) == sum(map(len, counts))


def test_limits_of_rows_and_uses(spark):
    texts = ["aaa aaa aaa bbb"] * 3 + ["aaa ccc ccc ccc", "ccc", "ddd ddd ddd"]
    got = found(distinctive_terms(frame(spark, *texts), "doc", "id", "text", min_uses=3, min_rows=2, max_rows=3))
    assert set(got) == {(3, "ccc")}
    assert set(found(distinctive_terms(frame(spark, *texts), "doc", "id", "text", min_uses=3, min_rows=2, max_rows=4))) == {(0, "aaa"), (1, "aaa"), (2, "aaa"), (3, "ccc")}


def test_hot_terms_give_the_same(spark):
    texts = [f"common word{i % 7} word{i % 7} name{i}" for i in range(40)]
    plain = found(distinctive_terms(frame(spark, *texts), "doc", "id", "text"))
    hot = found(distinctive_terms(frame(spark, *texts), "doc", "id", "text", hot_rows=5))
    assert {k: r.score for k, r in plain.items()} == pytest.approx({k: r.score for k, r in hot.items()})


def test_any_number_of_hot_terms(spark, monkeypatch):
    texts = [f"common word{i % 7} word{i % 7} name{i} all of them" for i in range(40)]
    plain = found(distinctive_terms(frame(spark, *texts), "doc", "id", "text", min_rows=2))
    for terms in (1, 3, 1000):
        monkeypatch.setattr("docpool.llm.terms.HOT_TERMS", terms)
        assert {k: (r.rows, r.score) for k, r in found(distinctive_terms(frame(spark, *texts), "doc", "id", "text", min_rows=2, hot_rows=2)).items()} == {k: (r.rows, pytest.approx(r.score)) for k, r in plain.items()}
        assert set(found(distinctive_terms(frame(spark, *texts), "doc", "id", "text", min_rows=2, max_rows=6, hot_rows=2))) == {k for k, r in plain.items() if r.rows <= 6}


def test_equal_rows_have_a_score_of_zero_and_are_kept(spark):
    df = frame(spark, "abc abc abc", "abc abc abc")
    assert {k: r.score for k, r in found(distinctive_terms(df, "doc", "id", "text", min_uses=3, min_rows=2, max_rows=6)).items()} == {(0, "abc"): 0.0, (1, "abc"): 0.0}


def test_top_and_repeated_rows(spark):
    df = frame(spark, "aaa aaa bbb ccc", "ddd")
    top = distinctive_terms(df, "doc", "id", "text", top=2).collect()
    assert sorted((r.row_id, r.term, r.place) for r in top) == [(0, "aaa", 1), (0, "bbb", 2), (1, "ddd", 1)]
    assert {r.rows for r in distinctive_terms(df.unionByName(df), "doc", "id", "text").collect()} == {2}


def test_nothing(spark):
    assert distinctive_terms(frame(spark, "x").limit(0), "doc", "id", "text").collect() == []
    long = "word " * 300_000
    assert found(distinctive_terms(frame(spark, long, None, ""), "doc", "id", "text"))[0, "word"].uses == 300_000
