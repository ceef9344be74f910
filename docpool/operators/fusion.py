"""Fusing the signals: reciprocal ranks with a guarantee for the best vectors, and the merge that misses nothing.

Frames hold (chunk_id, emb, lex, grep) and the columns `by`: none for a single query, the query's id for a batch.
Chunks of equal score stand in order of chunk_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docpool.functions.ranks import counted_before

RRF_K = 60
FALLBACK_RATIO = 0.05
GUARANTEE = 5
SIGNAL_CAP = 30
DEFAULT_TOP = 10


def top(scored: DataFrame, by: list[str], score: str, n: int, name: str = "place") -> DataFrame:
    """The n best rows of each query with their 1-based place; no task gets more than n rows of another's."""
    order = [F.desc(score), F.asc("chunk_id")]
    if not by:
        return scored.orderBy(*order).limit(n).withColumn(name, F.row_number().over(Window.orderBy(*order)))
    return scored.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)


def hits(scored: DataFrame, by: list[str]) -> DataFrame:
    """Per query, the number of chunks each signal found."""
    counts = [F.count_if(F.col(s) > 0).alias(f"{s}_candidates") for s in ("emb", "lex", "grep")]
    return scored.groupBy(*by).agg(*counts) if by else scored.agg(*counts)


def _with(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """left with the columns of right, which has a row for each query; of a single query it is fetched."""
    if by:
        return left.join(right, by)
    row = right.first()
    return left.select("*", *[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in right.schema.fields])


def reciprocal_ranks(scored: DataFrame, by: list[str]) -> DataFrame:
    """scored with re, rrf and fallback: ranks are counted over all chunks of a query, those of lex over its finds.

    If lex finds less than a twentieth of what emb finds, the score is the emb score instead.
    """
    e = counted_before(scored, by, [("emb", True), ("chunk_id", False)], F.lit(1), "re").withColumn("re", F.col("re") + 1)
    found = scored.where(F.col("lex") > 0).select(*by, "chunk_id", "lex")
    r = counted_before(found, by, [("lex", True), ("chunk_id", False)], F.lit(1), "rl").select(*by, "chunk_id", (F.col("rl") + 1).alias("rl"))
    few = (F.col("emb_candidates") > 0) & (F.col("lex_candidates") / F.col("emb_candidates") < FALLBACK_RATIO)
    both = _with(e.join(r, [*by, "chunk_id"], "left"), hits(scored, by).select(*by, few.alias("fallback")), by)
    one = lambda rank: F.lit(1.0) / (F.lit(RRF_K) + F.col(rank))
    return both.withColumn("rrf", F.when(F.col("fallback"), F.col("emb")).otherwise(one("re") + F.when(F.col("rl").isNotNull(), one("rl")).otherwise(0.0))).drop("rl")


def _numbers_ahead(scored: DataFrame, wanted: dict[str, list[tuple[float, int]]]) -> dict[str, dict[int, int]]:
    """For each score and each (value, chunk_id) asked for, how many rows stand before it; one pass, with sums in the tasks.

    The few rows asked for cut the order into parts; a search by halves, as an expression, says in which part a row lies.
    """
    places = {}
    for s, rows in wanted.items():
        marks = sorted(rows, key=lambda r: (-r[0], r[1]))

        def part(lo: int, hi: int, s: str = s, marks: list = marks) -> Column:
            if lo == hi:
                return F.lit(lo)
            mid = (lo + hi) // 2
            value, chunk = marks[mid]
            ahead = (F.col(s) > value) | ((F.col(s) == value) & (F.col("chunk_id") < chunk))
            return F.when(ahead, part(lo, mid)).otherwise(part(mid + 1, hi))

        places[s] = (marks, part(0, len(marks)))
    names = list(wanted)
    counts = scored.select(*[places[s][1].alias(f"p_{s}") for s in names]).groupBy(*[f"p_{s}" for s in names]).agg(F.count(F.lit(1)).alias("n")).collect()
    out: dict[str, dict[int, int]] = {}
    for s in names:
        by_part = [0] * (len(places[s][0]) + 1)
        for r in counts:
            by_part[r[f"p_{s}"]] += r.n
        out[s] = {chunk: sum(by_part[: i + 1]) for i, (_, chunk) in enumerate(places[s][0])}
    return out


def _hybrid_of_one(scored: DataFrame, n: int, guarantee: int) -> DataFrame:
    """hybrid for a single query: the ranks of a few rows decide, so the rows are not sorted.

    A row that is neither among the first 60 + 2m by emb nor by lex has a score below 1 / (60 + m), which the first m by
    emb have at least. So only those rows, at most twice as many, come to the driver; their ranks in the other
    score are counted.
    """
    most = max(n, guarantee)
    found = hits(scored, []).first()
    fallback = found.emb_candidates > 0 and found.lex_candidates / found.emb_candidates < FALLBACK_RATIO
    reach = most if fallback else RRF_K + 2 * most + 1
    rows = {r.chunk_id: r.asDict() for r in top(scored, [], "emb", reach, "re").collect()}
    if not fallback:
        for r in top(scored.where(F.col("lex") > 0), [], "lex", reach, "rl").collect():
            rows.setdefault(r.chunk_id, r.asDict())["rl"] = r.rl
        wanted = {"emb": [(r["emb"], i) for i, r in rows.items() if "re" not in r], "lex": [(r["lex"], i) for i, r in rows.items() if "rl" not in r and r["lex"] > 0]}
        if any(wanted.values()):
            ahead = _numbers_ahead(scored, {s: w for s, w in wanted.items() if w})
            for s, rank in (("emb", "re"), ("lex", "rl")):
                for i, before in ahead.get(s, {}).items():
                    rows[i][rank] = before + 1
    for r in rows.values():
        r["fallback"] = fallback
        r["rrf"] = r["emb"] if fallback else 1.0 / (RRF_K + r["re"]) + (1.0 / (RRF_K + r["rl"]) if r.get("rl") else 0.0)
    fused = sorted(rows.values(), key=lambda r: (-r["rrf"], r["chunk_id"]))
    first = fused[:guarantee]
    threshold = max((r["rrf"] for r in first if r["re"] > guarantee), default=None)
    for r in fused[guarantee:]:
        if not fallback and r["re"] <= guarantee and threshold is not None:
            r["rrf"] = threshold + (guarantee + 1 - r["re"]) * 1e-9
    shown = sorted(fused, key=lambda r: (-r["rrf"], r["chunk_id"]))[:n]
    schema = scored.select("*", F.lit(True).alias("fallback"), F.lit(0.0).alias("rrf"), F.lit(0).alias("place")).schema
    return scored.sparkSession.createDataFrame([tuple((*(r[c] for c in scored.columns), fallback, r["rrf"], i + 1)) for i, r in enumerate(shown)], schema)


def hybrid(scored: DataFrame, by: list[str], n: int = DEFAULT_TOP, guarantee: int = GUARANTEE) -> DataFrame:
    """The n best chunks of each query by reciprocal ranks, with place; the best by emb come before what displaced them.

    Of a single query's rows, which are read four times, only the scores should be held.
    """
    n = n if n > 0 else DEFAULT_TOP
    if not by:
        return _hybrid_of_one(scored, n, guarantee)
    return first_of_ranked(reciprocal_ranks(scored, by), by, n, guarantee)


def first_of_ranked(ranked: DataFrame, by: list[str], n: int, guarantee: int) -> DataFrame:
    """The end of hybrid for a batch: of reciprocal_ranks, or of its rows that may be shown, the n first with the guarantee."""
    fused = top(ranked, by, "rrf", max(n, guarantee), "rf")
    best = ranked.where(F.col("re") <= guarantee).withColumn("rf", F.lit(None).cast("int"))
    columns = [c for c in ranked.columns if c not in (*by, "chunk_id")]
    few = fused.unionByName(best).groupBy(*by, "chunk_id").agg(*[F.first(c).alias(c) for c in columns], F.max("rf").alias("rf"))
    few = few.join(few.groupBy(*by).agg(F.max(F.when((F.col("rf") <= guarantee) & (F.col("re") > guarantee), F.col("rrf"))).alias("threshold")), by)
    outside = F.col("rf").isNull() | (F.col("rf") > guarantee)
    raised = ~F.col("fallback") & (F.col("re") <= guarantee) & outside & F.col("threshold").isNotNull()
    score = F.when(raised, F.col("threshold") + (guarantee + 1 - F.col("re")) * F.lit(1e-9)).otherwise(F.col("rrf"))
    return top(few.withColumn("rrf", score).drop("rf", "threshold", "re"), by, "rrf", n)


def signal_list(emb: Column, lex: Column, grep: Column) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(s)) for s, c in (("emb", emb), ("lex", lex), ("grep", grep))]))


def merge_signals(scored: DataFrame, by: list[str], n: int = DEFAULT_TOP) -> DataFrame:
    """All candidates of each query with origin_signals: the best by emb and by lex, and everything grep found."""
    cap = max(n if n > 0 else DEFAULT_TOP, SIGNAL_CAP)
    tagged = None
    for s in ("emb", "lex", "grep"):
        part = scored.where(F.col(s) > 0)
        part = (part if s == "grep" else top(part, by, s, cap).drop("place")).withColumn("s", F.lit(s))
        tagged = part if tagged is None else tagged.unionByName(part)
    columns = [c for c in scored.columns if c not in (*by, "chunk_id")]
    has = lambda s: F.max(F.col("s") == s)
    return tagged.groupBy(*by, "chunk_id").agg(*[F.first(c).alias(c) for c in columns], signal_list(has("emb"), has("lex"), has("grep")).alias("origin_signals"))


def merge_order(merged: DataFrame, by: list[str], n: int) -> DataFrame:
    """The first n merged candidates of each query with place: more signals first, then the greater emb."""
    order = [F.desc(F.size("origin_signals")), F.desc("emb"), F.asc("chunk_id")]
    if not by:
        return merged.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order)))
    return merged.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n)


def primary_score(mode: str) -> Column:
    """The score shown for a hit: the rerank score if there is one, else what the mode ranks by."""
    own = {"emb": F.col("emb"), "lex": F.col("lex"), "grep": F.col("grep").cast("double"), "all": F.greatest("emb", "lex", F.col("grep").cast("double")), "hybrid": F.col("rrf")}
    return F.when(F.col("rerank") > 0, F.col("rerank")).otherwise(own.get(mode, F.col("rrf")))
