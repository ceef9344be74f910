"""Filling packs of fixed capacity: configuration linear program over the histogram of lengths."""

from __future__ import annotations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from docpool.functions.ranks import salted_row_number
from docpool.functions.storage import materialize

#: Fixed value: the public GPT-2 pre-tokeniser pattern.
GPT2_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_TOKENS = regex.compile(GPT2_PATTERN)
#: Rounds of multiplicative weights, each of which prices one configuration: this many, and more with more lengths.
ROUNDS = 60
LENGTHS_A_ROUND = 4
#: Tasks that the sources' programs are spread over.
SOURCE_TASKS = 32
#: Powers of the length that are tried as prices.
POWERS = (1.1, 3.0)
#: Parts of the program's solution that are rounded down.
PARTS = (1, 0.5, 0)
#: Sizes that are told apart; of larger capacities sizes are rounded up to this part of the capacity.
GRID = 4096
#: How fast a length's weight falls as the program covers it.
RATE = 1.0


@F.pandas_udf(IntegerType())
def count_tokens(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else sum(1 for _ in _TOKENS.finditer(t))).astype("Int32")


def price(lengths: np.ndarray, values: np.ndarray, supply: np.ndarray, capacity: int) -> np.ndarray:
    """The knapsack of greatest value by dynamic programming, no length taken more often than supplied; of equal ones that with long items.

    A length that may be taken n times counts as items of 1, 2, 4.. times, so a pass over the capacities settles each.
    """
    best = np.zeros(capacity + 1)
    steps: list[tuple[int, int, np.ndarray]] = []
    for i in np.nonzero(supply)[0][::-1]:
        size, left, times = int(lengths[i]), min(int(supply[i]), capacity // int(lengths[i])), 1
        while left > 0:
            n = min(times, left)
            options = best[: capacity + 1 - n * size] + n * values[i]
            better = options > best[n * size :]
            steps.append((int(i), n, better))
            np.maximum(best[n * size :], options, out=best[n * size :])
            left, times = left - n, times * 2
    pattern = np.zeros(len(lengths), np.int64)
    c = capacity
    for i, n, better in reversed(steps):
        w = n * int(lengths[i])
        if c >= w and better[c - w]:
            pattern[i] += n
            c -= w
    return pattern


def best_fit(lengths: np.ndarray, supply: np.ndarray, capacity: int) -> int:
    """The number of packs that filling them one after the other takes, each with the longest item that still fits."""
    left, packs = supply.copy(), 0
    while left.any():
        pattern, room, i = np.zeros(len(lengths), np.int64), capacity, len(lengths) - 1
        while i >= 0 and room >= lengths[0]:
            i = min(i, int(np.searchsorted(lengths, room, "right")) - 1)
            while i >= 0 and not left[i]:
                i -= 1
            if i >= 0:
                pattern[i] = min(int(left[i]), int(room // lengths[i]))
                room -= int(pattern[i] * lengths[i])
                i -= 1
        times = int((left[pattern > 0] // pattern[pattern > 0]).min())
        packs, left = packs + times, left - pattern * times
    return packs


def covering(lengths: np.ndarray, supply: np.ndarray, capacity: int, rounds: int) -> tuple[list[tuple[np.ndarray, float]], np.ndarray]:
    """Configurations, how often each is used, and the lengths' weights: multiplicative weights for the covering program.

    The program is "each length at least its supply, with the least number of packs". A round prices the configuration of
    greatest weight and uses it; a length's weight is its size times exp(-RATE x what the mean solution, scaled to the
    total demand, covers of its supply), so each use lowers those it covers, in steps that shrink with the rounds.
    """
    used: dict[bytes, list] = {}
    packs = float(lengths @ supply) / capacity
    weights, total = lengths / capacity, np.zeros(len(lengths))
    for i in range(rounds):
        pattern = price(lengths, weights, supply, capacity)
        used.setdefault(pattern.tobytes(), [pattern, 0])[1] += 1
        total += pattern
        weights = lengths / capacity * np.exp(-RATE * np.minimum(total * packs / (i + 1) / supply - 1, 50))
    return [(pattern, n * packs / rounds) for pattern, n in used.values()], weights


def fullest(lengths: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """The configuration with the longest item left that fills a pack most: the knapsack whose values are the sizes.

    Sizes that can be reached are the bits of one number, so an item is settled by a shift; items come longest first, and
    the program ends when the pack is full, so that short items, which fill up best, are left.
    """
    pattern = np.zeros(len(lengths), np.int64)
    longest = int(np.nonzero(left)[0][-1])
    pattern[longest] = 1
    room = capacity - int(lengths[longest])
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for i in np.nonzero(left)[0][::-1].tolist():
        size, times = int(lengths[i]), 1
        rest = min(int(left[i]) - (i == longest), room // size)
        while rest > 0 and not reach >> room:
            n = min(times, rest)
            steps.append((i, n, reach))
            reach |= (reach << n * size) & mask
            rest, times = rest - n, times * 2
        if reach >> room:
            break
    c = reach.bit_length() - 1
    for i, n, before in reversed(steps):
        if not before >> c & 1:
            pattern[i] += n
            c -= n * int(lengths[i])
    return pattern


def _rest(lengths: np.ndarray, left: np.ndarray, capacity: int, power: float) -> list[tuple[np.ndarray, int]]:
    """Configurations priced one after the other that use up what is left: by sizes, or by a power of them."""
    out: list[tuple[np.ndarray, int]] = []
    while left.any():
        pattern = price(lengths, (lengths / capacity) ** power, left, capacity) if power else fullest(lengths, left, capacity)
        times = int((left[pattern > 0] // pattern[pattern > 0]).min())
        out.append((pattern, times))
        left = left - pattern * times
    return out


def configurations(lengths: np.ndarray, supply: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, int]]:
    """Configurations of a histogram of lengths, with the number of packs filled by each; they use up the supply.

    The solution of the covering program is rounded down, configuration by configuration, to what the supply still left
    fills whole. What rounding leaves is priced again, a configuration at a time, over the items left, by their sizes (the
    program's prices where packs are full), each used as often as its scarcest length allows. If more packs come out
    than the tokens need at least, smaller parts of the solution are tried, and if these are still more than best fit
    takes, prices that favour long items; the fewest packs count. So every pack is a configuration that pricing by
    dynamic programming found.
    """
    order = np.argsort(lengths)
    lengths, supply = lengths[order].astype(np.int64), supply[order].astype(np.int64)
    solution, _ = covering(lengths, supply, capacity, max(rounds, len(lengths) // LENGTHS_A_ROUND))
    enough = -(-int(lengths @ supply) // capacity)
    best: list[tuple[np.ndarray, int]] = []
    for part, power in (*((p, 0.0) for p in PARTS), *((p, w) for w in POWERS for p in PARTS)):
        if power == POWERS[0] and part == PARTS[0]:
            enough = best_fit(lengths, supply, capacity)
        if best and sum(n for _, n in best) <= enough:
            break
        out: list[tuple[np.ndarray, int]] = []
        left = supply.copy()
        for pattern, n in sorted(solution, key=lambda x: -x[1]):
            if times := min(int(n * part), int((left[pattern > 0] // pattern[pattern > 0]).min())):
                out.append((pattern, times))
                left = left - pattern * times
        out += _rest(lengths, left, capacity, power)
        if not best or sum(n for _, n in out) < sum(n for _, n in best):
            best = out
    back = np.argsort(order)
    return [(p[back], n) for p, n in best]


def _plan(rounds: int):
    def plan(histogram: pd.DataFrame) -> pd.DataFrame:
        cells, supply = histogram["cell"].to_numpy(), histogram["n"].to_numpy()
        rows, pack = [], 0
        first = np.zeros(len(cells), np.int64)
        for pattern, times in configurations(cells, supply, int(histogram["room"].iloc[0]), rounds):
            for i in np.nonzero(pattern)[0]:
                rows.append((histogram["source"].iloc[0], cells[i], first[i], first[i] + pattern[i] * times, pattern[i], pack))
                first[i] += pattern[i] * times
            pack += times
        return pd.DataFrame(rows, columns=["source", "cell", "first", "last", "each", "pack"])

    return plan


def capacities(limits: DataFrame, source: str, capacity: str) -> DataFrame:
    """(limit_source, capacity): the capacities of sources as they compare; of several, the smallest; others are no limits."""
    return limits.groupBy(F.lower(F.trim(source)).alias("limit_source")).agg(F.min(F.when(F.col(capacity) > 0, F.col(capacity))).cast("int").alias("capacity")).where(F.col("limit_source").isNotNull() & F.col("capacity").isNotNull())


def pack_documents(docs: DataFrame, doc_id: str, source: str, text: str, limits: DataFrame, *, tokens: Column | str | None = None, limit_source: str = "source", capacity: str = "capacity_tokens", default: str = "default", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, source, piece, pieces, first_token, tokens, capacity, pack): every document's place in the packs of its source.

    A pack holds at most `capacity` tokens; packs are numbered from 0 within each source. Only a document of
    more tokens than the capacity is cut: into pieces that fill packs, and a last one that is packed like other
    documents. Sources compare lower-cased and trimmed; documents without source, and those whose source
    has no limit, use the row `default`, under the source `default`.

    tokens is the number of tokens; where it is null they are counted in the text. Documents without tokens
    (an empty or null text) take a place of size 0 in pack 0. Repeated rows are documents of their own. Without a
    `default` row, documents that need it are an error. No documents give no rows.

    Only the histogram of lengths by source comes together, at most GRID rows of a source, so that the program's work has a
    bound: beyond a capacity of GRID tokens, sizes are rounded up to the next part of the capacity (and a pack's items
    may leave that much of it free each). Each row's number among those of its source and size, counted in salted
    parts, says which pack it goes to.
    """
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.lower(F.trim(source)).alias("limit_source"), F.col(text).alias("text"), (F.col(tokens) if isinstance(tokens, str) else tokens if tokens is not None else F.lit(None)).cast("int").alias("known"))
    known = read.where(F.col("known").isNotNull()).select("doc_id", "limit_source", F.col("known").alias("tokens"))
    counted = read.where(F.col("known").isNull()).select("doc_id", "limit_source", F.coalesce(count_tokens("text"), F.lit(0)).alias("tokens"))
    sized = known.unionByName(counted)
    caps = capacities(limits, limit_source, capacity)
    standard = caps.where(F.col("limit_source") == default).select("capacity").first()
    named = sized.join(caps.where(F.col("limit_source") != default), "limit_source", "left")
    cap = F.coalesce("capacity", F.lit(standard[0] if standard else None).cast("int"))
    named = named.select("doc_id", F.when(F.col("capacity").isNotNull(), F.col("limit_source")).otherwise(default).alias("source"), "tokens", F.when(cap.isNotNull(), cap).otherwise(F.raise_error(F.lit("no capacity for documents without source"))).alias("capacity"))
    count = F.greatest(F.ceil(F.col("tokens") / F.col("capacity")), F.lit(1)).cast("int")
    cut = named.withColumn("pieces", count).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    cut = cut.withColumn("first_token", (F.col("piece").cast("long") * F.col("capacity"))).withColumn("size", F.least(F.col("capacity"), F.col("tokens") - F.col("first_token")).cast("int"))
    cut = materialize(cut, "pieces")
    unit = F.ceil(F.col("capacity") / GRID)
    room = F.floor(F.col("capacity") / unit).cast("int")
    packed = cut.where(F.col("size") > 0).withColumn("room", room).withColumn("cell", F.least(F.ceil(F.col("size") / unit), room).cast("int"))
    histogram = packed.groupBy("source", "room", "cell").agg(F.count(F.lit(1)).alias("n")).repartition(SOURCE_TASKS, "source")
    plan = materialize(histogram.groupBy("source").applyInPandas(_plan(rounds), "source string, cell int, first long, last long, each long, pack long"), "plan")
    # many places of one size lie in few ranges, so the ranges of a size come as one list
    ranges = plan.groupBy(F.col("source").alias("s"), F.col("cell").alias("z")).agg(F.array_sort(F.collect_list(F.struct("first", "last", "each", "pack"))).alias("ranges"))
    numbered = salted_row_number(packed, ["source", "cell"], ["doc_id", "piece"], "number")
    placed = numbered.join(ranges, (F.col("source") == F.col("s")) & (F.col("cell") == F.col("z")))
    place = F.filter("ranges", lambda r: (r["first"] <= F.col("number")) & (F.col("number") < r["last"]))[0]
    placed = placed.withColumn("r", place).withColumn("pack", F.col("r.pack") + F.floor((F.col("number") - F.col("r.first")) / F.col("r.each")))
    columns = ["doc_id", "source", "piece", "pieces", "first_token", F.col("size").alias("tokens"), "capacity", F.col("pack").cast("long").alias("pack")]
    return placed.select(*columns).unionByName(cut.where(F.col("size") <= 0).withColumn("pack", F.lit(0).cast("long")).select(*columns))
