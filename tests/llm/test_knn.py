import numpy as np
import pytest

from docpool.llm import knn

ROW = "id long, v array<float>, neighbour long, cosine string"


def frame(spark, vectors, ids=None):
    return spark.createDataFrame([(int(i), None if v is None else [float(x) for x in v], 1, "clash") for i, v in zip(ids if ids is not None else range(len(vectors)), vectors, strict=True)], ROW)


def clustered(n=300, dim=64, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim))
    near = base[: n // 2] + rng.standard_normal((n // 2, dim)) * 0.18 * rng.uniform(0.2, 1.3, (n // 2, 1))
    return np.concatenate([base, near, base[:20] * 7.5]).astype(np.float32)


def best(v, k, floor=-2.0, queries=None):
    u = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    c = u @ u.T
    np.fill_diagonal(c, -9)
    out = {}
    for i in range(len(v)) if queries is None else queries:
        order = sorted(range(len(v)), key=lambda j: (-round(c[i, j], 7), j))[:k]
        out[i] = [j for j in order if c[i, j] >= floor]
    return {i: x for i, x in out.items() if x}


def shown(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.id, r.place)):
        out.setdefault(r.id, []).append(r.neighbour)
    return out


def test_bounds_hold():
    v = clustered().astype(np.float64)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    product, error = knn.tile_bounds(*knn.quantised(u), *knn.quantised(u))
    assert (np.abs(product - u @ u.T) <= error).all()
    assert error.max() < 0.05


def test_neighbours_above_against_brute_force(spark):
    v = clustered()
    got, wanted = shown(knn.neighbours_above(frame(spark, v), "id", "v", dim=64)), best(v, 5, 0.95)
    pairs = lambda x: {(i, j) for i, js in x.items() for j in js}
    assert pairs(got) <= pairs(wanted)
    assert len(pairs(got)) >= 0.99 * len(pairs(wanted)) > 200
    assert pairs(shown(knn.neighbours_above(frame(spark, v), "id", "v", dim=64, tile=4, cell=400))) >= pairs(got)


def test_many_copies_of_a_vector(spark):
    v = np.ones((30, 64), np.float32) * np.linspace(1, 4, 30)[:, None]
    got = shown(knn.neighbours_above(frame(spark, v), "id", "v", dim=64))
    assert got[0] == [1, 2, 3, 4, 5] and got[29] == [0, 1, 2, 3, 4] and len(got) == 30


def test_nearest_is_exact(spark):
    v = clustered(120)
    df = frame(spark, v)
    got = shown(knn.nearest(df, "id", "v", df.where("id % 10 = 0"), dim=64, k=5, group_rows=40))
    assert got == best(v, 5, queries=range(0, len(v), 10))
    assert shown(knn.nearest(df, "id", "v", df.where("id % 10 = 0"), dim=64, k=5)) == got


def test_nearest_with_repeated_ids(spark):
    v = clustered(40)
    ids = [i for i in range(len(v)) for _ in range(9)]
    df = frame(spark, v[ids], ids).coalesce(1)
    got = shown(knn.nearest(df, "id", "v", df.where("id % 10 = 0"), dim=64, k=5))
    assert got == best(v, 5, queries=range(0, len(v), 10))


@pytest.mark.parametrize("call", [lambda df: knn.neighbours_above(df, "id", "v", dim=4), lambda df: knn.nearest(df, "id", "v", df, dim=4)])
def test_unusable_vectors(spark, call):
    rows = [None, [0, 0, 0, 0], [1, 2], [float("nan"), 1, 1, 1], [1, 0, 0, 0], [3e38, 0, 0, 0], []]
    assert shown(call(frame(spark, rows))) == {4: [5], 5: [4]}
    assert shown(call(frame(spark, [[1, 0, 0, 0]] * 2, [3, 3]))) == {}
    assert shown(call(frame(spark, []))) == {}
