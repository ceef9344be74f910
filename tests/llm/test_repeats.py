import random

import pytest
from pyspark.sql import functions as F

from docpool.llm import repeats as rp
from docpool.llm._text import reduced, sampled

ROW = "doc_id long, text string, chars string, rule int"


def found(spark, texts, **options):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], ROW)
    return {r.doc_id: r for r in rp.repetition(df, "doc_id", "text", **options).collect()}


def share(text, size=20):
    small, seen, again = reduced(text), set(), 0
    windows = [small[i : i + size] for i in range(len(small) - size + 1)]
    for w in windows:
        again += w in seen
        seen.add(w)
    return len(small), again / len(windows) if windows else 0.0


@pytest.mark.parametrize("size", [1, 2, 3, 7, 20, 32])
def test_window_share(size):
    rng = random.Random(size)
    for n in (0, 1, size - 1, size, size + 1, 50, 400):
        text = "".join(rng.choice("abé文 ,1") for _ in range(n)) * rng.choice([1, 2])
        small = reduced(text)
        assert rp.window_shares([small, "", small], size) == pytest.approx([share(text, size)[1], 0, share(text, size)[1]])
        hashes, _ = rp.hashed(["", small], size)
        assert len(set(hashes.tolist())) == len({small[i : i + size] for i in range(len(small) - size + 1)})


def test_documents(spark):
    rng = random.Random(1)
    plain = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(60))
    texts = [plain, plain + " " + plain, "Buy now! " * 40, "short " * 5, "", None, plain + "\n\n" + plain[:100], "ＡＢＣ " * 50, "x" * 500_000]
    for sample in (0, 400):
        got = found(spark, texts, sample_rows=sample, always=("windows",))
        short = found(spark, texts, sample_rows=sample)
        assert len(got) == len(short) == len(texts)
        for i, t in enumerate(texts[:-1]):
            n, s = share(t or "")
            assert got[i].chars == short[i].chars == n
            assert got[i].windows == pytest.approx(s if n >= 100 else 0)
            assert (got[i].rule is not None) == any(rule.measure([t or ""])[0] >= rp.LIMITS[name] for name, rule in rp.RULES.items())
            assert short[i].rule == got[i].rule
            assert all(short[i][name] is not None for name in rp.RULES) or short[i].rule
        assert got[8].windows > 0.99


def large(spark, texts, **options):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], ROW)
    return {r.doc_id: (r.chars, r.share) for r in rp.repeated_documents(df, "doc_id", "text", **options).collect()}


def test_repeated_documents(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    texts = [None, "", "x" * 99, "x" * 100, "ＡＢＣ " * 50, "y" * 300_000]
    for _ in range(150):
        parts = [" ".join(word() for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(2, 12))]
        texts.append("\n".join(parts + rng.choices(parts, k=rng.randrange(0, 10))))
    wanted = {i: share(t) for i, t in enumerate(texts) if t}
    for limit in (0.1, 0.3, 0.7):
        for sample in (0, 60):
            got = large(spark, texts, limit=limit, sample_rows=sample)
            assert set(got) == {i for i, (n, s) in wanted.items() if n >= 100 and s >= limit}
            assert all(got[i] == (wanted[i][0], pytest.approx(wanted[i][1])) for i in got)
    df = spark.createDataFrame([(1, "x" * 200, "c", 1), (1, "x" * 200, "c", 1)], ROW)
    assert rp.repeated_documents(df, "doc_id", "text").count() == 2
    assert large(spark, []) == {}


def test_cheap_bounds_spare_the_exact_test():
    rng = random.Random(3)
    plain = ["".join(rng.choice("abcdefghijklmnop") for _ in range(400)) for _ in range(50)]
    order = rp.ordered(rp.CLEARING, plain, lambda name, values: values < (1 if name == "length" else 0.3))
    assert order.index("bytes") < order.index("windows")
    rows = [*plain, "x" * 500, *("".join(rng.choice(k) for _ in range(n)) for k in ("ab", "é文a", "文") for n in (19, 20, 21, 300))]
    bound, exact = rp.most_repeated(rows), rp.window_shares(rows)
    assert (bound >= exact).all() and (bound[:50] < 0.3).all()
    assert bound[50] == exact[50] > 0.9


def test_cascade_order_follows_the_sample():
    spam = ["same line\n" * 30] * 5
    order = rp.rule_order(spam)
    assert sorted(order) == sorted(rp.RULES) and order[0] == "lines" and order == rp.rule_order(spam)
    assert rp.rule_order(["word " * 50] * 3)[0] == "top_word"
    assert rp.rule_order([]) == list(rp.RULES)


def test_shares_of_lines_paragraphs_words():
    assert rp.lines_share("a\nb\na\na\n") == pytest.approx(0.5)
    assert rp.paragraphs_share("aa\r\n\r\nbb\r\n\r\naa") == pytest.approx(1 / 3)
    assert rp.top_word_share("spam " * 9 + "ham") == pytest.approx(36 / 39)
    assert rp.top_word_share("one two") == 0.0


def test_repeats_and_none(spark):
    df = spark.createDataFrame([(1, "x", "c", 1), (1, "x", "c", 1)], ROW)
    assert rp.repetition(df, "doc_id", "text").count() == 2
    assert found(spark, []) == {}


def test_samples_are_the_smallest_hashes(spark):
    rows = spark.range(3000).select(F.col("id"), F.lit("x").alias("t"))
    wanted = [r.id for r in rows.orderBy(F.xxhash64("id"), "id").limit(50).collect()]
    assert [r.id for r in sampled(rows, "id", 50)] == wanted
    assert len(sampled(rows, "id", 5000)) == 3000 and sampled(rows, "id", 0) == []
    same = rows.select(F.lit(7).alias("id"), "t").unionByName(rows.select(F.lit(None).cast("int").alias("id"), "t"))
    assert len(sampled(same, "id", 50)) == 50
