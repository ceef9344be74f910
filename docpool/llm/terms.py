"""How distinctive a term is for a row, by the log-likelihood ratio against all other rows."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docpool.functions.storage import materialize
from docpool.llm._text import compat_lower, slices

#: Terms with a letter a-z. Runs of non-ASCII characters are terms too, but hold no such letter and consume none.
_TERM = re.compile(r"[A-Za-z]+-[0-9]+|[A-Za-z0-9_]+")
_LETTER = re.compile(r"[a-z]")
#: The most terms that are broadcast as hot.
HOT_TERMS = 65_536
#: Decimal places of the scores by which terms are ordered.
DIGITS = 6
#: Terms that a task adds up before it passes them on.
_HELD_TERMS = 100_000


def row_terms(text: str) -> Counter:
    """Counts of the scored terms of a text: three characters or more, with a letter a-z."""
    counts = Counter(_TERM.findall(compat_lower(text)))
    return Counter({t: n for t, n in counts.items() if len(t) >= 3 and _LETTER.search(t)})


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: Counter = Counter()
    uses: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in rows], pa.string()), pa.array([t for _, t in rows], pa.string()),
             pa.array(list(rows.values()), pa.int64()), pa.array([uses[k] for k in rows], pa.int64())],
            names=["kind", "term", "rows", "uses"],
        )
        rows.clear()
        uses.clear()
        return out

    for batch in slices(batches, 2):
        for kind, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if text is not None:
                for term, n in row_terms(text).items():
                    rows[kind, term] += 1
                    uses[kind, term] += n
        if len(rows) > _HELD_TERMS:
            yield flush()
    if rows:
        yield flush()


def _pairs(min_uses: int, max_rows: int | None):
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            seen: Counter = Counter()
            out: list[tuple] = []
            for kind, row, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if text is not None:
                    counts = row_terms(text)
                    length = sum(counts.values())
                    if max_rows is not None:
                        seen.update((kind, t) for t in counts)
                    out.extend((kind, row, t, n, length) for t, n in counts.items() if n >= min_uses)
            if max_rows is not None:  # in too many rows of this slice, so in too many of all
                out = [x for x in out if seen[x[0], x[2]] <= max_rows]
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["kind", "row_id", "term", "uses", "length"])

    return pairs


def _g(seen: Column, expected: Column) -> Column:
    return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))


def distinctive_terms(
    rows: DataFrame,
    kind: Column | str,
    row_id: str,
    text: str,
    *,
    min_uses: int = 1,
    min_rows: int = 1,
    max_rows: int | None = None,
    top: int | None = None,
    hot_rows: int = 50_000,
) -> DataFrame:
    """(kind, row_id, term, uses, rows, score, over): how far each term marks its row among the rows of its kind.

    score is the log-likelihood ratio G2 of the two-by-two table of the term's and all other uses in the row
    and in the remaining collection; over tells whether the row uses the term more than the rest does. Terms
    used less than min_uses times in the row, or occurring in fewer than min_rows or more than max_rows rows,
    are left out; top keeps each row's `top` best terms with over, ties by term.

    A null text is no row; an empty one is a row without terms. Repeated ids are rows of their own in the
    counts. Other columns are not read. No rows give no rows.

    Statistics cover all rows: a task adds up its terms before the shuffle. With max_rows, common terms are
    dropped before the shuffle, as a slice of rows can prove them common. Terms of hot_rows rows and more, and of at least
    one in HOT_TERMS of all (row, term) pairs, so that there are never more than HOT_TERMS of them, are listed in a
    broadcast table; their rows are salted into parts of about that size, so no task gets a hot term whole. The
    order goes by scores rounded to DIGITS places, so that equal ones are ties.
    """
    read = rows.select((F.lit(kind) if isinstance(kind, str) else kind).cast("string").alias("kind"), F.col(row_id).cast("long").alias("row_id"), F.col(text).alias("text"))
    pairs = read.mapInArrow(_pairs(min_uses, max_rows), "kind string, row_id long, term string, uses long, length long")
    stats = read.mapInArrow(_statistics, "kind string, term string, rows long, uses long")
    stats = stats.groupBy("kind", "term").agg(F.sum("rows").alias("rows"), F.sum("uses").alias("all_uses"))
    stats = materialize(stats, "terms")
    totals = stats.groupBy("kind").agg(F.sum("all_uses").alias("total"))
    pairs_of_all = stats.agg(F.sum("rows")).first()[0] or 0
    most = max(hot_rows, pairs_of_all // HOT_TERMS + 1)
    is_wanted = (F.col("rows") >= min_rows) & (F.col("rows") <= (max_rows if max_rows is not None else F.col("rows")))
    parts = F.ceil(F.col("rows") / most).cast("int")
    hot = stats.where(F.col("rows") >= most).select("kind", "term", parts.alias("parts"), is_wanted.alias("wanted"))
    salted = pairs.join(F.broadcast(hot), ["kind", "term"], "left").where(F.coalesce("wanted", F.lit(True)))
    salted = salted.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("row_id", "length"), F.col("parts")), F.lit(0)).cast("int")).drop("parts", "wanted")
    spread = stats.where(is_wanted).withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("rows") >= most, parts).otherwise(1) - 1)))
    joined = salted.join(spread, ["kind", "term", "salt"]).join(totals, "kind")
    n = F.col("total").cast("double")
    k11, row, col = (F.col(c).cast("double") for c in ("uses", "length", "all_uses"))
    k12, k21 = col - k11, row - k11
    k22 = n - row - k12
    score = 2 * (_g(k11, row * col / n) + _g(k12, (n - row) * col / n) + _g(k21, row * (n - col) / n) + _g(k22, (n - row) * (n - col) / n))
    scored = joined.select("kind", "row_id", "term", "uses", "rows", F.greatest(score, F.lit(0.0)).alias("score"), (k11 * n > row * col).alias("over"))
    if top is not None:
        best = Window.partitionBy("kind", "row_id").orderBy(F.desc(F.round("score", DIGITS)), "term")
        scored = scored.where("over").withColumn("place", F.row_number().over(best)).where(F.col("place") <= top)
    return scored
