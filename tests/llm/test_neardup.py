import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from docpool.llm import neardup as nd

ROW = "id long, text string, grp string, rep long, similarity double"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, 9, 9.0) for i, t, g in rows], ROW)


def pairs(spark, rows, **options):
    expand = options.pop("expand", {})
    found = nd.expanded(*nd.near_duplicates(frame(spark, rows), "id", "text", **options), **expand)
    return {(r.id_a, r.id_b) for r in found.collect()}


def text(rng, n=120):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(n))


def edited(rng, t, edits):
    words = t.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = text(rng, 1)
    return " ".join(words)


def test_signature_estimates_similarity():
    rng = random.Random(1)
    errors = []
    for _ in range(60):
        a = text(rng, 60)
        b = edited(rng, a, rng.randrange(1, 25))
        s = nd.prob_min_hash(*nd.shingles([a, b], 5))
        errors.append((s[0] == s[1]).mean() - nd.jaccard(a, b, 5))
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.05


def test_weighted_signature_estimates_probability_jaccard():
    rng = np.random.default_rng(3)
    elements = nd.mix(np.arange(40, dtype=np.uint64) + np.uint64(7))
    w = rng.uniform(0.2, 3, (2, 40))
    s = nd.prob_min_hash(np.tile(elements, 2), np.array([40, 40]), 4096, w.ravel())
    p = w / w.sum(1, keepdims=True)
    wanted = sum(1 / np.maximum(p[0] / p[0][i], p[1] / p[1][i]).sum() for i in range(40))
    assert abs((s[0] == s[1]).mean() - wanted) < 0.03
    assert (nd.prob_min_hash(elements, np.array([40]), 4096, w[0] * 9) == s[0]).all()
    assert nd.prob_min_hash(elements[:0], np.array([0])).tolist() == [[0] * nd.REGISTERS]


def by_definition(a, b, size, weights):
    count = lambda t: Counter(t[i : i + size] for i in range(len(t) - size + 1))
    x, y = count(a), count(b)
    if not weights:
        return len(x.keys() & y.keys()) / max(1, len(x.keys() | y.keys()))
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())


def test_similarity_by_definition():
    rng = random.Random(4)
    for _ in range(60):
        a, b = ("".join(rng.choice("ab ") for _ in range(rng.randrange(2, 40))) for _ in "ab")
        for weights in (False, True):
            got = nd.similarity(*(nd.weighed(nd.shingles([t], 3)[0]) for t in (a, b)), weights)
            assert abs(got - by_definition(a, b, 3, weights)) < 1e-9


def test_weighted_pairs_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(30):
        words = [text(rng, 1) for _ in range(12)]
        base = rng.choices(words, weights=[1, 1, 1, 1, 2, 2, 9, 9, 9, 9, 9, 9], k=90)
        rare = {w: text(rng, 1) for w in words[: i % 6]}
        rows += [(10 * i, " ".join(base), None), (10 * i + 1, " ".join(rare.get(w, w) for w in base), None), (10 * i + 2, " ".join(rng.choices(words, k=70)), None)]
    folded = {i: nd.folded(t) for i, t, _ in rows}
    wanted, plain = ({(a, b) for a in folded for b in folded if a < b and b - a < 10 and by_definition(folded[a], folded[b], 5, w) >= 0.7} for w in (True, False))
    got = pairs(spark, rows, weights=True, threshold=0.7)
    assert got <= wanted != plain and len(got) >= 0.9 * len(wanted) > 20


def test_pairs_against_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for i in range(40):
        base = text(rng)
        rows += [(10 * i, base, None), (10 * i + 1, edited(rng, base, 3), None), (10 * i + 2, edited(rng, base, 40), None)]
        if i % 5 == 0:
            rows += [(10 * i + 3, base.upper().replace(" ", "  \n"), None)]
    rng.shuffle(rows)
    folded = {i: nd.folded(t) for i, t, _ in rows}
    wanted = {(a, b) for a in folded for b in folded if a < b and nd.jaccard(folded[a], folded[b], 5) >= 0.7}
    got = pairs(spark, rows)
    assert got <= wanted
    assert len(got) >= 0.98 * len(wanted) > 40
    assert pairs(spark, rows, tile=2) == got


def test_copies(spark):
    rows = [(i, "The same long text of copies. " * 10, None) for i in range(12)] + [(20, "the same LONG text of copies. " * 10 + "!", None)]
    assert len(pairs(spark, rows)) == 13 * 12 // 2
    star = pairs(spark, rows, expand={"limit": 10})
    assert star == {(0, i) for i in range(1, 12)} | {(0, 20)}
    classes, links = nd.near_duplicates(frame(spark, rows), "id", "text")
    assert {r.rep for r in classes.collect()} == {0, 20}
    assert links.count() == 1


def test_groups_and_exact_classes(spark):
    rows = [(1, "docs/specs/a_long_name.md", "K"), (2, "docs/specs/a_long_name.md", "K"), (3, "docs/specs/A_long_name.md", "K"), (4, "docs/specs/a_long_name.md", "L"), (5, "docs/specs/b_long_name.md", None), (6, "docs/specs/c_long_name.md", None), (7, None, "K"), (8, "", "K"), (9, "ab", "K")]
    options = {"group": "grp", "fold": str.lower, "exact": True, "size": 3, "threshold": 0.7, "min_chars": 0}
    assert pairs(spark, rows, **options, expand={"copies": False}) == {(1, 3), (2, 3), (5, 6)}


def test_short_null_and_none(spark):
    assert pairs(spark, [(1, "short", None), (2, "short", None), (3, None, None), (4, "", None)]) == set()
    assert pairs(spark, []) == set()
    long = "very long text without end " * 20_000
    assert pairs(spark, [(1, long, None), (1, long, None), (2, long + "x", None)]) == {(1, 2)}


def test_a_hot_bucket_is_cut(spark):
    members = spark.range(50).select(F.lit(1).alias("bucket"), "id", F.lit(0).cast("long").alias("s1"), F.lit(0).cast("long").alias("s2"))
    assert nd.bucket_pairs(members, 8).count() == 50 * 49 // 2
    assert nd.bucket_pairs(members.limit(0), 8).count() == 0


def test_links_of_large_classes_without_copies(spark):
    a, b, c = ("docs/specs/a_long_name_of_a_file.md", "docs/specs/A_long_name_of_a_file.md", "docs/specs/a_long_name_of_a_file.mdx")
    options = {"group": "grp", "fold": str.lower, "exact": True, "size": 3, "threshold": 0.8, "min_chars": 0}
    rows = [(i, a if i % 2 else b, "K") for i in range(1, 130)] + [(200, c, "K"), (201, c, "L"), (202, a, "L")]
    of = {i: t for i, t, g in rows if g == "K"}
    wanted = {(i, j) for i in of for j in of if i < j and of[i] != of[j]} | {(201, 202)}
    assert sum(of[i] == a for i in of) * sum(of[i] == b for i in of) > nd.EXPAND
    assert pairs(spark, rows, **options, expand={"copies": False}) == wanted
    assert pairs(spark, rows[-40:], **options, expand={"copies": False, "limit": 10}) == {(i, j) for i, j in wanted if i >= rows[-40][0]}
