import random

import pytest

from docpool.llm import leaks as lk
from docpool.llm._text import reduced

DOC, ITEM = "doc_id long, text string, item_id string, run string", "item_id long, text string, lang string"


def longest(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(b)]
        best = max(best, *row)
    return best


def found(spark, docs, items, **options):
    df = lk.leaks(spark.createDataFrame([(*d, "clash", "clash") for d in docs], DOC), "doc_id", "text", spark.createDataFrame([(*i, "en") for i in items], ITEM), "item_id", "text", **options)
    return {(r.doc_id, r.item_id): r for r in df.collect()}


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé文") for _ in range(rng.randrange(1, 7))) for _ in range(n))


@pytest.mark.parametrize("run", [11, 40, 41])
def test_against_brute_force(spark, run):
    rng = random.Random(run)
    items = [(i, words(rng, 30)) for i in range(6)] + [(6, "short")]
    items += [(7, items[0][1][:80])]
    docs = []
    for d in range(30):
        source = rng.choice(items)[1]
        start = rng.randrange(len(source))
        piece = source[start : start + rng.randrange(20, 120)].upper().replace(" ", rng.choice([" ", "\r\n> ", "-"]))
        docs.append((d, f"{words(rng, 20)} {piece}! {words(rng, 20)}"))
    got = found(spark, docs, items, min_run=run)
    for d, text in docs:
        for i, item in items:
            n = longest(reduced(text), reduced(item))
            assert ((d, i) in got) == (n >= run)
            if n >= run:
                r = got[d, i]
                assert r.run == n and r.item_share == pytest.approx(n / len(reduced(item)))
                assert reduced(text[r.doc_start : r.doc_end]) in reduced(item)
                assert len(reduced(text[r.doc_start : r.doc_end])) == n
    assert set(found(spark, docs, items, min_run=run, pass_chars=100)) == set(got)


def test_other_dress_and_offsets(spark):
    item = "What does the ﬁrst monitor print, once 12 packets of ＦＮＣ-００１ are lost for ever?"
    doc = "Intro ﬁ. **what DOES the first monitor print**, once ⑫ packets of fnc 001 ARE lost — for ever??? end"
    r = found(spark, [(1, doc)], [(9, item)])[1, 9]
    assert doc[r.doc_start : r.doc_end].startswith("what") and doc[r.doc_start : r.doc_end].endswith("ever")
    assert r.item_share == 1


def test_nulls_repeats_none(spark):
    long = "abcdefghij" * 5
    got = found(spark, [(1, long), (1, long), (2, None), (3, ""), (4, long * 20_000)], [(1, long), (1, long), (1, "other " * 20), (2, None), (3, "")])
    assert set(got) == {(1, 1), (4, 1)} and got[1, 1].run == 50
    assert found(spark, [], [(1, long)]) == {} and found(spark, [(1, long)], []) == {}
