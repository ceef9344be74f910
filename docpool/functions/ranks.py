"""Row numbers and joins within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docpool.functions.storage import materialize


#: Rows of a key that meet their partners in one task; keys with more are split.
HOT_ROWS = 1_000_000


def salts_for(df: DataFrame) -> int:
    """Into how many parts a group is cut that may be any share of all rows: as many as a shuffle has, 64 at least."""
    return max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions") or 0))


def spread_join(big: DataFrame, small: DataFrame, key: str, spread: str, *, counted: DataFrame | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """big joined with small, which has few rows of a key, by their column `key`; keys with many rows of big are split.

    The rows of a key that has hot_rows or more are dealt out by a hash of big's column `spread` to parts of about
    hot_rows, and small's rows of that key go to all of them. The hot keys, at most a hot_rows-th of big's rows, are
    broadcast; they are counted in `counted` (big itself if not given). Null keys join nothing.
    """
    sizes = (big if counted is None else counted).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") >= hot_rows) & F.col(key).isNotNull())
    hot = F.broadcast(sizes.select(key, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_parts")))
    left = big.join(hot, key, "left").withColumn("_salt", F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(spread), F.col("_parts"))).otherwise(0).cast("int")).drop("_parts")
    right = small.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return left.join(right, [key, "_salt"]).drop("_salt")


def salted_row_number(df: DataFrame, group: list[str], identity: list[str], name: str, salts: int | None = None) -> DataFrame:
    """Adds `name`: 0-based numbers 0..n-1 within each group, in an arbitrary but repeatable order.

    A group is split by a hash of `identity` into `salts` parts (salts_for) that are numbered apart; the parts'
    sizes, at most `salts` rows a group, give each part its offset. So no task sorts a whole hot group.
    Rows must be distinct in `identity`; nulls in `group` form a group of their own.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*identity), F.lit(salts or salts_for(df))).cast("int"))
    sizes = salted.groupBy(*group, "_salt").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(c).alias(f"_g_{i}") for i, c in enumerate(group)],
        F.col("_salt").alias("_g_salt"),
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
    )
    part = Window.partitionBy(*group, "_salt").orderBy(*identity)
    same: Column = F.col("_salt") == F.col("_g_salt")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{i}"))
    numbered = salted.withColumn("_within", F.row_number().over(part) - 1)
    joined = numbered.join(offsets, same, "left")
    return joined.withColumn(name, (F.col("_within") + F.col("_offset")).cast("long")).drop(
        "_salt", "_within", "_offset", "_g_salt", *[f"_g_{i}" for i in range(len(group))]
    )


def counted_before(rows: DataFrame, group: list[str], order: list[tuple[str, bool]], count: Column, name: str) -> DataFrame:
    """Adds `name`: the sum of `count` over the rows of the same group that come earlier in `order` (column, descending).

    Rows must be distinct in group and order. They are written in ranges of that order; each range sums up its
    own rows, and the ranges' totals, a row for each range and group in it, give the rest. So a hot group
    spreads over as many tasks as it has ranges. Nulls in `group` form a group of their own.
    """
    keys = [*[F.col(c).asc() for c in group], *[F.col(c).desc() if down else F.col(c).asc() for c, down in order]]
    ranged = rows.withColumn("_count", count).repartitionByRange(*keys).withColumn("_range", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")
    totals = ranged.groupBy("_range", *group).agg(F.sum("_count").alias("_total"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("_range").alias("_g_range"), *[F.col(c).alias(f"_g_{i}") for i, c in enumerate(group)], F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_range", *group).orderBy(*keys[len(group) :]).rowsBetween(Window.unboundedPreceding, -1)
    same: Column = F.col("_range") == F.col("_g_range")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{i}"))
    joined = ranged.withColumn("_within", F.coalesce(F.sum("_count").over(within), F.lit(0))).join(offsets, same, "left")
    return joined.withColumn(name, (F.col("_within") + F.col("_offset")).cast("long")).drop("_count", "_range", "_within", "_offset", "_g_range", *[f"_g_{i}" for i in range(len(group))])
