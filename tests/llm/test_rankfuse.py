import random
import statistics

from pyspark.sql import functions as F

from docpool.llm.rankfuse import median_ranking

ROW = "q long, c long, a double, b double, d double, place int, median_rank string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], ROW)


def ranked(df, **options):
    out = {}
    for r in median_ranking(df, "q", "c", {n: F.col(n) for n in ("a", "b", "d")}, **options).collect():
        out.setdefault(r.group, []).append((r.place, r.item, r.median_rank, r.sole_firsts, round(r.total, 9)))
    return {g: sorted(v) for g, v in out.items()}


def test_against_a_plain_model(spark):
    rng = random.Random(4)
    rows = [(q, c, *[rng.choice([None, float("nan"), 1.0, 2.0, rng.random() * 10 ** k]) for k in (0, 2, -3)]) for q in (1, 2, None) for c in range(30)]
    got = ranked(frame(spark, rows))
    for q in (1, 2, None):
        own = [r for r in rows if r[0] == q]
        score = lambda r, i: r[i] if r[i] is not None and r[i] == r[i] else float("-inf")
        ranks = {r[1]: [1 + sum(score(o, i) > score(r, i) for o in own) for i in (2, 3, 4)] for r in own}
        order = sorted(ranks, key=lambda c: (statistics.median_low(ranks[c]), sum(ranks[c]) / 3, c))
        assert [x[1] for x in got[q]] == order
        assert [x[0] for x in got[q]] == list(range(1, 31))
        for _, c, median, sole, total in got[q]:
            r = next(o for o in own if o[1] == c)
            assert median == statistics.median_low(ranks[c])
            assert sole == sum(score(r, i) > float("-inf") and all(score(o, i) < score(r, i) for o in own if o is not r) for i in (2, 3, 4))
            assert abs(total - sum(v for v in (score(r, i) for i in (2, 3, 4)) if v > float("-inf"))) < 1e-6


def test_the_largest_range_does_not_rule(spark):
    got = ranked(frame(spark, [(1, 1, 0.9, 0.8, 1.0), (1, 2, 0.1, 0.2, 900.0)]))
    assert [x[1] for x in got[1]] == [1, 2]
    heavy = ranked(frame(spark, [(1, 1, 0.9, 0.8, 1.0), (1, 2, 0.1, 0.2, 900.0)]), weights={"d": 5.0})
    assert [x[1] for x in heavy[1]] == [2, 1]


def test_repeats_ties_nulls_none(spark):
    got = ranked(frame(spark, [(1, 5, 1.0, 1.0, 1.0), (1, 5, 2.0, None, 1.0), (1, 3, 2.0, 1.0, 1.0), (1, None, 9.0, 9.0, 9.0), (2, 1, None, None, None)]))
    assert [x[:4] for x in got[1]] == [(1, 3, 1, 0), (2, 5, 1, 0)]
    assert got[2] == [(1, 1, 1, 0, 0.0)]
    assert ranked(frame(spark, [])) == {}
