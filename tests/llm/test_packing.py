import random
from collections import defaultdict

import numpy as np
import pytest
import regex

from docpool.llm import packing as pk

ROW = "id long, source string, text string, n int, pack string, capacity string"
LIMITS = "source string, capacity_tokens int"


def packed(spark, rows, limits):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], ROW)
    return pk.pack_documents(df, "id", "source", "text", spark.createDataFrame(limits, LIMITS), tokens="n").collect()


@pytest.mark.parametrize("seed", range(8))
def test_configurations_use_up_the_supply(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 200))
    lengths = rng.permutation(np.unique(rng.integers(1, capacity + 1, 60)))
    supply = rng.integers(1, 300, len(lengths))
    found = pk.configurations(lengths, supply, capacity)
    assert (sum(p * n for p, n in found) == supply).all()
    assert all((p * lengths).sum() <= capacity for p, _ in found)
    order = np.argsort(lengths)
    assert sum(n for _, n in found) <= pk.best_fit(lengths[order], supply[order], capacity)


@pytest.mark.parametrize("scarce", [0, 40, 150])
def test_packs_come_from_pricing_and_are_never_more_than_best_fit(scarce, monkeypatch):
    rng = np.random.default_rng(5)
    lengths, supply = np.arange(5, 200), rng.integers(1, 300, 195)
    supply[rng.permutation(195)[:scarce]] = 1
    priced = set()
    for name in ("price", "fullest"):
        monkeypatch.setattr(pk, name, lambda *a, f=getattr(pk, name): priced.add((p := f(*a)).tobytes()) or p)
    found = pk.configurations(lengths, supply, 300)
    assert (sum(p * n for p, n in found) == supply).all() and all((p * lengths).sum() <= 300 for p, _ in found)
    assert all(p.tobytes() in priced for p, _ in found)
    packs = sum(n for _, n in found)
    assert packs <= pk.best_fit(lengths, supply, 300)


def test_covering_program_nears_its_bound():
    rng = np.random.default_rng(7)
    lengths, supply = np.arange(10, 60), rng.integers(200, 400, 50)
    covered = {}
    for rounds in (20, 400):
        solution, weights = pk.covering(lengths, supply, 200, rounds)
        least = min((sum(p * x for p, x in solution) / supply))
        covered[rounds] = least
        dual = (weights @ supply) / (weights @ pk.price(lengths, weights, supply, 200))  # a lower bound of the packs
        assert dual <= sum(x for _, x in solution) * 1.001 / least
    assert covered[20] < covered[400] > 0.9


def test_capacities_beyond_the_grid(spark, monkeypatch):
    monkeypatch.setattr(pk, "GRID", 50)
    rng = random.Random(4)
    rows = [(i, "git", "text", rng.randrange(1, 1300)) for i in range(300)]
    load = defaultdict(int)
    for r in packed(spark, rows, [("default", 1001)]):
        load[r.pack] += r.tokens
    assert sum(load.values()) == sum(r[3] for r in rows) and max(load.values()) <= 1001
    assert len(load) <= 1.1 * sum(load.values()) / 1001 + 1


def test_pricing_finds_the_best():
    pattern = pk.price(np.array([3, 5, 7]), np.array([3.0, 5.5, 7.2]), np.array([9, 9, 9]), 15)
    assert pattern.tolist() == [0, 3, 0]
    rng = np.random.default_rng(2)
    for _ in range(30):  # against all choices
        lengths, values, supply = np.sort(rng.permutation(np.arange(2, 12))[:4]), rng.random(4), rng.integers(0, 4, 4)
        got = pk.price(lengths, values, supply, 20)
        choices = [np.array(c) for c in np.ndindex(*(supply + 1)) if np.array(c) @ lengths <= 20]
        assert (got <= supply).all() and got @ lengths <= 20 and got @ values == pytest.approx(max(c @ values for c in choices))
        if supply.any():
            longest = np.nonzero(supply)[0][-1]
            got = pk.fullest(lengths, supply, 20)
            assert (got <= supply).all() and got[longest] and got @ lengths == max(c @ lengths for c in choices if c[longest])


def test_packs(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["git", " GIT ", "wiki", None, "", "odd"]), "text", rng.choice([1, 5, 9, 20, 64, 65, 130, rng.randrange(1, 200)])) for i in range(600)]
    found = packed(spark, rows, [("Git", 64), ("git", 64), ("wiki", 30), ("default", 50), ("bad", 0), (None, 5)])
    caps = {"git": 64, "wiki": 30, "default": 50}
    load, whole = defaultdict(int), defaultdict(list)
    for r in found:
        assert r.capacity == caps[r.source]
        load[r.source, r.pack] += r.tokens
        whole[r.doc_id].append(r)
    assert all(n <= caps[s] for (s, _), n in load.items())
    for i, source, _, n in rows:
        parts = sorted(whole[i], key=lambda r: r.piece)
        assert sum(r.tokens for r in parts) == n
        assert (len(parts) > 1) == (n > parts[0].capacity)
        assert [r.first_token for r in parts] == [k * parts[0].capacity for k in range(len(parts))]
        assert parts[0].source == {"git": "git", "wiki": "wiki"}.get((source or "").strip().lower(), "default")
    for s, c in caps.items():
        packs = {p for x, p in load if x == s}
        assert packs == set(range(len(packs)))
        assert len(packs) <= 1.1 * sum(n for (x, _), n in load.items() if x == s) / c + 2


def test_counted_empty_repeated_none(spark):
    text = "It's  a test,\n\nnot 42 things.　日本 "
    n = len(regex.findall(pk.GPT2_PATTERN, text))
    found = packed(spark, [(1, "git", text, None), (2, "git", "", None), (3, "git", None, None), (4, "git", "x", 0), (5, "git", "t", 3), (5, "git", "t", 3)], [("git", 100), ("default", 10)])
    assert sorted((r.doc_id, r.tokens) for r in found) == [(1, n), (2, 0), (3, 0), (4, 0), (5, 3), (5, 3)]
    assert packed(spark, [], [("default", 10)]) == []
    long = packed(spark, [(1, "git", "a b" * 100_000, None)], [("default", 4096)])
    assert {r.tokens for r in long[:-1]} <= {4096, long[-1].tokens} | {r.tokens for r in long}
    with pytest.raises(Exception, match="no capacity"):
        packed(spark, [(1, "git", "x", 1)], [("wiki", 10)])
