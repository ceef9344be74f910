"""What changed between consecutive full snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docpool.functions.ranks import HOT_ROWS, counted_before, spread_join


def clean_path(path: Column) -> Column:
    """A path without outer white space, `.` segments and doubled slashes; null if nothing is left."""
    trimmed = F.regexp_replace(path, r"(?U)^\s+|\s+$", "")
    kept = F.array_join(F.filter(F.split(trimmed, "/"), lambda s: ~s.isin("", ".")), "/")
    full = F.concat(F.when(trimmed.startswith("/"), "/").otherwise(""), kept)
    return F.when(full != "", full)


def clean_hash(value: Column) -> Column:
    """A hash in lower case without the prefix `sha256:`; null if nothing is left."""
    bare = F.regexp_replace(F.lower(F.trim(value)), "^sha256:", "")
    return F.when(bare != "", bare)


def snapshot_pairs(snapshots: DataFrame, group: list[str], snapshot: str, order: str) -> DataFrame:
    """(previous, current): each snapshot with the one before it in its group, by `order`, then by `snapshot`."""
    placed = counted_before(snapshots.select(*group, order, snapshot).dropDuplicates([snapshot]), group, [(order, False), (snapshot, False)], F.lit(1), "place")
    later = placed.select(*[F.col(c).alias(f"_{c}") for c in group], (F.col("place") - 1).alias("_place"), F.col(snapshot).alias("current"))
    same: Column = F.col("place") == F.col("_place")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return placed.join(later, same).select(F.col(snapshot).alias("previous"), "current")


def snapshot_changes(snapshots: DataFrame, rows: DataFrame, *, group: list[str], snapshot: str, order: str, key: str, fields: list[str], version: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(snapshot, key, change, fields): what each snapshot changed against the one before it in its group.

    change is `added`, `removed` or `changed`; fields names the fields whose values are known in both
    snapshots and differ, sorted, and is empty for added and removed keys. snapshots has a row for each
    snapshot, one without rows being an empty snapshot; rows has the snapshots' rows, of which the one with
    the latest `version` counts for its key (ties: the greatest field values). The first snapshot of a group
    reports nothing.

    Rows with a null key, of no snapshot or of an unknown one count for nothing; repeated rows count once.
    Other columns are not read. Empty tables give no rows.

    Every row becomes signed cells, +1 for its own snapshot and -1 for the next: one that marks the key's
    presence, and one for each known field value. Cells that do not cancel out classify the key. All sums are
    combined before the shuffle, and no snapshot or group comes together in one task: one of hot_rows rows and more is split.
    """
    pairs = snapshot_pairs(snapshots, group, snapshot, order)
    values = F.struct(*[F.col(f).cast("string").alias(f) for f in fields])
    own = rows.select(F.col(snapshot).alias("snapshot"), F.col(key).alias("key"), F.struct(F.col(version), values.alias("values")).alias("row"))
    own = own.where(F.col("key").isNotNull() & F.col("snapshot").isNotNull()).groupBy("snapshot", "key").agg(F.max("row").alias("row"))
    cells = F.array(
        F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value")),
        *[F.struct(F.lit(f).alias("field"), F.col(f"row.values.{f}").alias("value")) for f in fields],
    )
    ends = pairs.select(F.col("current").alias("snapshot"), F.col("current").alias("at"), F.lit(1).alias("sign")).unionByName(pairs.select(F.col("previous").alias("snapshot"), F.col("current").alias("at"), F.lit(-1).alias("sign")))
    counted = rows.select(F.col(snapshot).alias("snapshot"))
    signed = spread_join(own, ends, "snapshot", "key", counted=counted, hot_rows=hot_rows).select("at", "key", "sign", F.explode(F.filter(cells, lambda c: c["field"].isNull() | c["value"].isNotNull())).alias("cell"))
    left = signed.groupBy("at", "key", "cell.field", "cell.value").agg(F.sum("sign").alias("sign")).where(F.col("sign") != 0)
    by_field = left.groupBy("at", "key", "field").agg(F.sum("sign").alias("sign"), F.count(F.lit(1)).alias("cells"))
    by_key = by_field.groupBy("at", "key").agg(
        F.max(F.when(F.col("field").isNull(), F.col("sign"))).alias("presence"),
        F.array_sort(F.collect_list(F.when(F.col("field").isNotNull() & (F.col("cells") == 2), F.col("field")))).alias("fields"),
    )
    change = F.when(F.col("presence") > 0, "added").when(F.col("presence") < 0, "removed").when(F.size("fields") > 0, "changed")
    none = F.array().cast("array<string>")
    shown = by_key.select(F.col("at").alias("snapshot"), "key", change.alias("change"), F.when(F.col("presence").isNull(), F.col("fields")).otherwise(none).alias("fields"))
    return shown.where(F.col("change").isNotNull())
