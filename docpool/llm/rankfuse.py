"""One ranking from several scores: median rank aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docpool.functions.ranks import counted_before
from docpool.functions.storage import materialize


def median_ranking(rows: DataFrame, group: str, item: str, scores: dict[str, Column], *, weights: dict[str, float] | None = None) -> DataFrame:
    """(group, item, place, median_rank, mean_rank, sole_firsts, total): the items of each group in one order.

    An item's rank in a score is one more than the number of items with a greater score; items without the
    score (null or NaN) share the rank after all that have it. Items are ordered by the weighted median of
    their ranks (the least rank at which half the weight is reached), then by their mean rank, then by item.
    sole_firsts counts the scores in which the item alone is first; total sums the scores, missing ones as 0.

    Weights are 1 if not given. Repeated rows of a group and item count once, with the greatest value of each
    score. Rows with a null group form one group; rows with a null item are left out. Only the columns used
    are read. No rows give no rows.

    Ranks come from ranges of the sorted scores, so a group of any size spreads over tasks.
    """
    names = list(scores)
    weight = {n: float((weights or {}).get(n, 1.0)) for n in names}
    known = {n: F.when(~F.isnan(c.cast("double")), c.cast("double")) for n, c in scores.items()}
    items = rows.select(F.col(group).alias("group"), F.col(item).alias("item"), *[known[n].alias(f"s_{i}") for i, n in enumerate(names)])
    items = items.where(F.col("item").isNotNull()).groupBy("group", "item").agg(*[F.max(f"s_{i}").alias(f"s_{i}") for i in range(len(names))])
    items = materialize(items, "items")
    signals = F.explode(F.array(*[F.struct(F.lit(i).alias("signal"), (F.col(f"s_{i}") + 0.0).alias("value")) for i in range(len(names))]))
    long = items.select("group", "item", signals.alias("x")).select("group", "item", "x.signal", "x.value")
    values = long.where(F.col("value").isNotNull()).groupBy("group", "signal", "value").agg(F.count(F.lit(1)).alias("n"))
    ranks = counted_before(values, ["group", "signal"], [("value", True)], F.col("n"), "before")
    ends = values.groupBy("group", "signal").agg(F.sum("n").alias("have"))
    r = ranks.select(F.col("group").alias("g"), F.col("signal").alias("s"), F.col("value").alias("v"), "before", "n")
    e = ends.select(F.col("group").alias("eg"), F.col("signal").alias("es"), "have")
    ranked = long.join(r, F.col("group").eqNullSafe(F.col("g")) & (F.col("signal") == F.col("s")) & (F.col("value") == F.col("v")), "left")
    ranked = ranked.join(e, F.col("group").eqNullSafe(F.col("eg")) & (F.col("signal") == F.col("es")), "left")
    rank = F.when(F.col("value").isNotNull(), F.col("before")).otherwise(F.coalesce(F.col("have"), F.lit(0))) + 1
    heavy = F.element_at(F.array(*[F.lit(weight[n]) for n in names]), F.col("signal") + 1)
    ranked = ranked.select("group", "item", "value", rank.alias("rank"), heavy.alias("w"), ((F.col("before") == 0) & (F.col("n") == 1)).alias("sole"))
    per_item = ranked.groupBy("group", "item").agg(
        F.array_sort(F.collect_list(F.struct("rank", "w"))).alias("ranks"),  # one for each score
        (F.sum(F.col("rank") * F.col("w")) / F.sum("w")).alias("mean_rank"),
        F.count_if("sole").alias("sole_firsts"),
        F.sum(F.coalesce("value", F.lit(0.0))).alias("total"),
    )
    half = sum(weight.values()) / 2
    folded = F.aggregate(
        "ranks",
        F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("long").alias("median")),
        lambda a, x: F.struct((a["sum"] + x["w"]).alias("sum"), F.coalesce(a["median"], F.when(a["sum"] + x["w"] >= half, x["rank"])).alias("median")),
    )
    ordered = per_item.select("group", "item", folded["median"].alias("median_rank"), "mean_rank", "sole_firsts", "total")
    placed = counted_before(ordered, ["group"], [("median_rank", False), ("mean_rank", False), ("item", False)], F.lit(1), "place")
    return placed.select("group", "item", (F.col("place") + 1).alias("place"), "median_rank", "mean_rank", "sole_firsts", "total")
