import pytest
from pyspark.sql import functions as F

from docpool.functions.ranks import salted_row_number, spread_join


@pytest.mark.parametrize("hot_rows", [1, 3, 1000])
def test_spread_join_equals_a_join(spark, hot_rows):
    big = spark.createDataFrame([(k, i) for i, k in enumerate(["a"] * 20 + ["b"] * 2 + ["c", None])], "k string, i long")
    small = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("d", 4), (None, 5)], "k string, v int")
    got = spread_join(big, small, "k", "i", hot_rows=hot_rows)
    wanted = big.join(small, "k")
    assert got.columns == wanted.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))
    assert spread_join(big, small, "k", "i", counted=big.select("k"), hot_rows=hot_rows).count() == wanted.count()
    assert spread_join(big.limit(0), small, "k", "i", hot_rows=hot_rows).count() == 0


@pytest.mark.parametrize("salts", [None, 1, 7])
def test_row_numbers(spark, salts):
    df = spark.range(50).select(F.when(F.col("id") < 30, "x").when(F.col("id") < 45, "y").alias("g"), "id")
    rows = salted_row_number(df, ["g"], ["id"], "n", salts).collect()
    for g, n in (("x", 30), ("y", 15), (None, 5)):
        assert sorted(r.n for r in rows if r.g == g) == list(range(n))
