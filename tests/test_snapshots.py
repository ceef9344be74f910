import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docpool.functions.ranks import counted_before, salted_row_number
from docpool.operators.snapshots import clean_hash, clean_path, snapshot_changes

START = datetime(2025, 1, 1)
JOB, ROW = "job string, k string, s string, at timestamp", "job string, path string, hash string, size long, got timestamp, key string"


def changes(spark, jobs, rows, fields=("hash",), **options):
    found = snapshot_changes(spark.createDataFrame(jobs, JOB), spark.createDataFrame(rows, ROW), group=["k", "s"], snapshot="job", order="at", key="path", fields=list(fields), version="got", **options)
    return {(r.snapshot, r.key): (r.change, r.fields) for r in found.collect()}


def job(name, day, k="K", s="main"):
    return name, k, s, START + timedelta(days=day)


def row(name, path, value, size=1, got=0):
    return name, path, value, size, START + timedelta(seconds=got), "clash"


def test_added_removed_changed(spark):
    jobs = [job("a", 0), job("b", 1), job("c", 2), job("x", 0, "K2"), job("y", 1, None), job("z", 2, None)]
    rows = [row("a", "p", "1"), row("a", "q", "1"), row("b", "p", "2"), row("b", "r", None), row("x", "p", "9"), row("y", "n", "1"), row("z", "m", "1"), row("lost", "p", "1"), row("b", None, "1")]
    assert changes(spark, jobs, rows) == {
        ("b", "p"): ("changed", ["hash"]), ("b", "q"): ("removed", []), ("b", "r"): ("added", []),
        ("c", "p"): ("removed", []), ("c", "r"): ("removed", []), ("z", "n"): ("removed", []), ("z", "m"): ("added", []),
    }


def test_hot_snapshots_give_the_same(spark):
    jobs = [job(n, i) for i, n in enumerate("abc")]
    rows = [row(n, f"p{i}", str(i // (k + 2))) for k, n in enumerate("abc") for i in range(k, 12 - k)]
    assert changes(spark, jobs, rows, hot_rows=2) == changes(spark, jobs, rows) != {}


def test_unknown_values_are_no_change(spark):
    jobs = [job("a", 0), job("b", 1), job("c", 2)]
    rows = [row("a", "p", None), row("b", "p", "1"), row("c", "p", None), row("a", "q", "1"), row("b", "q", "1"), row("c", "q", "1")]
    assert changes(spark, jobs, rows) == {}


def test_the_last_row_counts_and_repeats_do_not(spark):
    jobs = [job("a", 0), job("a", 0), job("b", 1)]
    rows = [row("a", "p", "old", got=1), row("a", "p", "new", got=2), row("b", "p", "new"), row("b", "p", "new"), row("a", "t", "1", got=3), row("a", "t", "2", got=3), row("b", "t", "2")]
    assert changes(spark, jobs, rows) == {}


def test_several_fields(spark):
    jobs = [job("a", 0), job("b", 1)]
    rows = [row("a", "p", "1", 1), row("b", "p", "2", 2), row("a", "q", "1", 1), row("b", "q", "1", 2)]
    assert changes(spark, jobs, rows, ("size", "hash")) == {("b", "p"): ("changed", ["hash", "size"]), ("b", "q"): ("changed", ["size"])}


def test_nothing(spark):
    assert changes(spark, [], []) == {}
    assert changes(spark, [job("a", 0)], []) == {}
    assert changes(spark, [], [row("a", "p", "1")]) == {}


def test_against_a_plain_model(spark):
    rng = random.Random(5)
    jobs = [job(f"j{i}", rng.randrange(6), f"K{i % 2}", f"s{i % 3 // 2}") for i in range(14)]
    rows = [row(rng.choice(jobs)[0], f"p{rng.randrange(8)}", rng.choice(["1", "2", None]), got=n) for n in range(150)]
    wanted = {}
    held = {j[0]: {r[1]: r[2] for r in sorted(rows, key=lambda r: r[4]) if r[0] == j[0]} for j in jobs}
    for group in {j[1:3] for j in jobs}:
        ordered = sorted((j for j in jobs if j[1:3] == group), key=lambda j: (j[3], j[0]))
        for a, b in zip(ordered, ordered[1:]):
            x, y = held[a[0]], held[b[0]]
            wanted |= {(b[0], p): ("added", []) for p in y.keys() - x.keys()} | {(b[0], p): ("removed", []) for p in x.keys() - y.keys()}
            wanted |= {(b[0], p): ("changed", ["hash"]) for p in x.keys() & y.keys() if x[p] and y[p] and x[p] != y[p]}
    assert changes(spark, jobs, rows) == wanted


@pytest.mark.parametrize(("given", "wanted"), [(" a//b/./c ", "a/b/c"), ("./a", "a"), ("/a", "/a"), ("a/.hidden", "a/.hidden"), (".", None), ("  ", None), (None, None), ("A", "A")])
def test_clean_path(spark, given, wanted):
    assert spark.range(1).select(clean_path(F.lit(given).cast("string")).alias("x")).first().x == wanted


def test_clean_hash(spark):
    rows = spark.createDataFrame([("SHA256:AB",), ("ab",), ("",), (None,)], "h string").select(clean_hash(F.col("h")).alias("h")).collect()
    assert [r.h for r in rows] == ["ab", "ab", None, None]


def test_row_numbers_of_a_hot_group(spark):
    rows = spark.range(2000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"))
    found = salted_row_number(rows, ["g"], ["id"], "n", 8).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.g, []).append(r.n)
    assert len(found) == 2000
    assert all(sorted(v) == list(range(len(v))) for v in groups.values())
    assert sorted(r.n for r in salted_row_number(rows, [], ["id"], "n").collect()) == list(range(2000))


def test_counts_before(spark):
    rows = spark.createDataFrame([("a", 3.0, 2), ("a", 1.0, 1), ("a", 2.0, 5), (None, 1.0, 4), (None, 0.0, 1)], "g string, v double, n int")
    found = {(r.g, r.v): r.before for r in counted_before(rows, ["g"], [("v", True)], F.col("n"), "before").collect()}
    assert found == {("a", 3.0): 0, ("a", 2.0): 2, ("a", 1.0): 7, (None, 1.0): 0, (None, 0.0): 4}
