"""hybrid for a batch of queries, without a row for each query and chunk.

A query's best chunks by both scores decide, as in `fusion._hybrid_of_one`; only their ranks need all scores. So each
chunk is written once, with what its key's queries look for and how often it is in the text, and the chunks of a key
come together: there scores and ranks of a query are numbers in memory, of which its few rows that can be shown go on.
Keys of more than `hot_chunks` are cut into parts; the parts' best rows are counted in every part.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from docpool.functions.storage import materialize, scratch
from docpool.functions.text import id_tokens, normalised, tokenise
from docpool.operators.fusion import DEFAULT_TOP, FALLBACK_RATIO, GUARANTEE, RRF_K, first_of_ranked
from docpool.operators.signals import DIGITS, HELD_BYTES, HOT_CHUNKS, ID_BONUS, K1, B, PHRASE_BONUS, query_bytes

#: Scores that are held at once for each signal.
HELD_SCORES = 2_000_000

_RANKED = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("emb", pa.float64()), ("lex", pa.float64()), ("re", pa.int64()), ("rrf", pa.float64()), ("fallback", pa.bool_())])
_BEST = pa.schema([("key", pa.string()), ("query_id", pa.int64()), ("chunk_id", pa.int64()), ("emb", pa.float64()), ("lex", pa.float64())])
_COUNTED = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("emb", pa.float64()), ("lex", pa.float64()), ("re", pa.int64()), ("rl", pa.int64()), ("emb_candidates", pa.int64()), ("lex_candidates", pa.int64())])
_RANKED_SQL = "query_id long, chunk_id long, emb double, lex double, re long, rrf double, fallback boolean"
_BEST_SQL = "key string, query_id long, chunk_id long, emb double, lex double"
_COUNTED_SQL = "query_id long, chunk_id long, emb double, lex double, re long, rl long, emb_candidates long, lex_candidates long"


@dataclass
class _Asked:
    """A query; its tokens with their number, identifiers and the whole of it by their place among the strings of its key."""

    id: int
    vector: np.ndarray
    words: dict[int, int]
    ids: list[int]
    whole: int | None


def _by_key(asked: pa.Table) -> tuple[dict[str, list[_Asked]], dict[str, list[str]], dict[str, list[tuple[str, list[int]]]]]:
    """Per key its queries, the tokens and identifiers they look for, and the longer queries with the places of their tokens.

    The longer queries' own places come after those of tokens and identifiers.
    """
    rows: dict[str, list[tuple[int, str, np.ndarray]]] = {}
    for i, key, query, vector in zip(asked["query_id"].to_pylist(), asked["key"].to_pylist(), asked["query"].to_pylist(), asked["vector"], strict=True):
        if key is not None:
            rows.setdefault(key, []).append((i, normalised(query or ""), np.array([]) if vector.values is None else vector.values.to_numpy(zero_copy_only=False)))
    queries, strings, longer = {}, {}, {}
    for key, own in rows.items():
        tokens = {norm: tokenise(norm) for _, norm, _ in own}
        strings[key] = sorted({w for norm, ws in tokens.items() if ws for w in (*ws, *id_tokens(norm))})
        place = {w: i for i, w in enumerate(strings[key])}
        longer[key] = [(norm, [place[w] for w in {*ws}]) for norm, ws in sorted(tokens.items()) if ws and norm not in place]
        place |= {norm: len(place) + i for i, (norm, _) in enumerate(longer[key])}
        queries[key] = [
            _Asked(i, vector, {place[w]: n for w, n in Counter(tokens[norm]).items()}, [place[m] for m in id_tokens(norm)], place[norm]) if tokens[norm] else _Asked(i, vector, {}, [], None)
            for i, norm, vector in own
        ]
    return queries, strings, longer


def _held(queries: list[_Asked], weight: np.ndarray, avgdl: float) -> bytes:
    """What a task needs of a key, without classes of this package, which the executors may not have."""
    return pickle.dumps(([(q.id, q.vector, q.words, q.ids, q.whole) for q in queries], weight, avgdl))


def _found(chunks: DataFrame, strings: dict[str, list[str]], longer: dict[str, list[tuple[str, list[int]]]]) -> DataFrame:
    """(key, chunk_id, dl, vector, at, n): the chunks of the keys asked for; at are the places of the strings a text has, n how often."""
    text = "norm" if "norm" in chunks.columns else "text"
    read = chunks.select("key", F.col("id").cast("long").alias("chunk_id"), F.col(text).alias("text"), "vector").where(F.col("key").isin(list(strings)) if len(strings) <= 1000 else F.col("key").isNotNull())
    numbers = ArrayType(IntegerType())
    schema = StructType([StructField("key", StringType()), StructField("chunk_id", LongType()), StructField("dl", LongType()), StructField("vector", chunks.schema["vector"].dataType), StructField("at", numbers), StructField("n", numbers)])

    def look(texts: list[str], key: str) -> tuple[list[list[int]], list[list[int]]]:
        at, n = [[] for _ in texts], [[] for _ in texts]
        rows: dict[int, set[int]] = {}
        together = "\n".join(texts)
        for i, w in enumerate(strings[key]):
            if w in together:
                times = [t.count(w) for t in texts]
                rows[i] = {j for j, x in enumerate(times) if x}
                for j in rows[i]:
                    at[j].append(i)
                    n[j].append(times[j])
        for i, (whole, parts) in enumerate(longer[key], len(strings[key])):
            if all(p in rows for p in parts):
                for j in set.intersection(*[rows[p] for p in parts]):
                    if whole in texts[j]:
                        at[j].append(i)
                        n[j].append(1)
        return at, n

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places: dict[str, list[int]] = {}
            for i, key in enumerate(batch.column(0).to_pylist()):
                if key in strings:
                    places.setdefault(key, []).append(i)
            order, dl, at, n = [], [], [], []
            for key, own in places.items():
                texts = ["" if t is None else t if text == "norm" else normalised(t) for t in batch.column(2).take(pa.array(own)).to_pylist()]
                for out, more in zip((at, n), look(texts, key), strict=True):
                    out += more
                order += own
                dl += map(len, texts)
            if order:
                own = batch.take(pa.array(order))
                lists = [pa.array(x, pa.list_(pa.int32())) for x in (at, n)]
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(dl, pa.int64()), own.column(3), *lists], names=schema.names)

    return read.mapInArrow(find, schema)


class _Part:
    """Chunks of a key, in order of their ids, that meet the key's queries in memory."""

    def __init__(self, found: pa.Table, held: bytes, k1: float, b: float) -> None:
        queries, weight, avgdl = pickle.loads(held)
        self.queries = [_Asked(*q) for q in queries]
        ids = found["chunk_id"].to_numpy()
        found = found.take(pa.array(np.argsort(ids, kind="stable")))
        self.ids, self.n = np.sort(ids), len(ids)
        self.vectors = found["vector"].combine_chunks()
        at = found["at"].combine_chunks()
        rows = np.repeat(np.arange(self.n), pc.list_value_length(at).to_numpy(zero_copy_only=False))
        place, tf = at.flatten().to_numpy(), found["n"].combine_chunks().flatten().to_numpy().astype(np.float64)
        order = np.argsort(place, kind="stable")
        self.rows, place, tf = rows[order], place[order], tf[order]
        self.starts = np.searchsorted(place, np.arange(len(weight) + 1))
        damp = k1 * (1 - b + b * found["dl"].to_numpy().astype(np.float64) / avgdl)
        self.parts = weight[place] * tf * (k1 + 1) / (tf + damp[self.rows])

    def lex(self, q: _Asked) -> np.ndarray:
        out = np.zeros(self.n)
        for i, times in q.words.items():
            own = slice(self.starts[i], self.starts[i + 1])
            out[self.rows[own]] += times * self.parts[own]
        for i in q.ids:
            out[self.rows[self.starts[i] : self.starts[i + 1]]] += ID_BONUS
        if q.whole is not None:
            out[self.rows[self.starts[q.whole] : self.starts[q.whole + 1]]] += PHRASE_BONUS
        return np.round(out, DIGITS)

    def scores(self) -> Iterator[tuple[_Asked, np.ndarray, np.ndarray]]:
        """Every query with its emb and lex of all rows, by the rules of signals.cosine_to and lex_score."""
        lengths = pc.fill_null(pc.list_value_length(self.vectors), 0).to_numpy(zero_copy_only=False)
        step = max(1, HELD_SCORES // max(1, self.n))
        by_length: dict[int, list[_Asked]] = {}
        for q in self.queries:
            by_length.setdefault(len(q.vector), []).append(q)
        for length, queries in by_length.items():
            right = (lengths == length) & (length > 0)
            x = self.vectors.filter(pa.array(right)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, max(1, length))
            own = np.sqrt((x * x).sum(1))
            for lo in range(0, len(queries), step):
                some = queries[lo : lo + step]
                emb = np.zeros((len(some), self.n))
                if len(x):
                    y = np.array([q.vector for q in some], np.float64)
                    size = np.sqrt((y * y).sum(1))[:, None] * own
                    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
                        emb[:, right] = np.round(np.nan_to_num(np.where(size > 0, y @ x.T / size, 0.0)), DIGITS)
                for q, e in zip(some, emb, strict=True):
                    yield q, e, self.lex(q)


def _first(score: np.ndarray, n: int) -> np.ndarray:
    """Places of the n greatest, in order; of equal ones the earlier."""
    at = np.arange(len(score)) if len(score) <= n else np.flatnonzero(score >= np.partition(score, len(score) - n)[len(score) - n])
    return at[np.argsort(-score[at], kind="stable")][:n]


def _best_rows(emb: np.ndarray, lex: np.ndarray, reach: int) -> np.ndarray:
    """Places of the first `reach` rows by emb and of those by lex that it found."""
    with_words = np.flatnonzero(lex > 0)
    return np.union1d(_first(emb, reach), with_words[_first(lex[with_words], reach)])


def _ahead(score: np.ndarray, ids: np.ndarray, value: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How many rows (score, ids ascending) stand before each (value, of): a greater score, or the same and a smaller id."""
    if not len(score):
        return np.zeros(len(value), np.int64)
    ordered, place = np.sort(score), np.searchsorted(ids, of)
    right = np.searchsorted(ordered, value, "right")
    itself = ids[np.minimum(place, len(ids) - 1)] == of
    before = len(score) - right
    for i in np.flatnonzero(right - np.searchsorted(ordered, value, "left") > itself):
        before[i] += np.count_nonzero(score[: place[i]] == value[i])
    return before


def _ranked_part(part: _Part, most: int, guarantee: int, reach: int) -> pa.Table:
    """Of each query of a whole key the rows that may be shown: the `most` first by rrf and the `guarantee` first by emb."""
    out = []
    for q, emb, lex in part.scores():
        with_words = np.flatnonzero(lex > 0)
        hits = np.count_nonzero(emb > 0)
        fallback = bool(hits) and len(with_words) / hits < FALLBACK_RATIO
        at = _first(emb, max(most, guarantee)) if fallback else _best_rows(emb, lex, reach)
        re = _ahead(emb, part.ids, emb[at], part.ids[at]) + 1
        if fallback:
            rrf = emb[at]
        else:
            rl = _ahead(lex[with_words], part.ids[with_words], lex[at], part.ids[at]) + 1
            rrf = 1.0 / (RRF_K + re) + np.where(lex[at] > 0, 1.0 / (RRF_K + rl), 0.0)
        keep = re <= guarantee
        keep[_first(rrf, most)] = True
        at, re, rrf = at[keep], re[keep], rrf[keep]
        out.append((np.full(len(at), q.id), part.ids[at], emb[at], lex[at], re, rrf, np.full(len(at), fallback)))
    return _table(out, _RANKED)


def _table(out: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema) if out else schema.empty_table()


def _of_whole_keys(found: DataFrame, held: dict[str, bytes], most: int, guarantee: int, reach: int, k1: float, b: float) -> DataFrame:
    def ranked(table: pa.Table) -> pa.Table:
        return _ranked_part(_Part(table, held[table["key"][0].as_py()], k1, b), most, guarantee, reach)

    return found.groupBy("key").applyInArrow(ranked, _RANKED_SQL)


def _of_split_keys(found: DataFrame, held: dict[str, bytes], parts: dict[str, int], reach: int, k1: float, b: float) -> DataFrame:
    """The same of keys that are cut into `parts`: every part gives its best rows, and counts what stands before those of all."""

    def best(table: pa.Table) -> pa.Table:
        key, out = table["key"][0].as_py(), []
        part = _Part(table, held[key], k1, b)
        for q, emb, lex in part.scores():
            at = _best_rows(emb, lex, reach)
            out.append((np.full(len(at), key, object), np.full(len(at), q.id), part.ids[at], emb[at], lex[at]))
        return _table(out, _BEST)

    def count(table: pa.Table, marks: pa.Table) -> pa.Table:
        if not len(table) or not len(marks):
            return _COUNTED.empty_table()
        part, out = _Part(table, held[table["key"][0].as_py()], k1, b), []
        asked = marks["query_id"].to_numpy()
        order = np.argsort(asked, kind="stable")
        asked, ids, e, w = asked[order], *(marks[c].to_numpy()[order] for c in ("chunk_id", "emb", "lex"))
        for q, emb, lex in part.scores():
            own = slice(*np.searchsorted(asked, [q.id, q.id + 1]))
            n, with_words = own.stop - own.start, lex > 0
            rl = _ahead(lex[with_words], part.ids[with_words], w[own], ids[own])
            out.append((asked[own], ids[own], e[own], w[own], _ahead(emb, part.ids, e[own], ids[own]), rl, np.full(n, np.count_nonzero(emb > 0)), np.full(n, np.count_nonzero(with_words))))
        return _table(out, _COUNTED)

    spark = found.sparkSession
    sizes = F.broadcast(spark.createDataFrame(list(parts.items()), "key string, parts int"))
    dealt = materialize(found.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int")).drop("parts"), "parts")
    each = materialize(dealt.groupBy("key", "part").applyInArrow(best, _BEST_SQL), "best")
    place = lambda s: F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(s), F.asc("chunk_id")))
    marks = each.select("*", place("emb").alias("e"), place("lex").alias("w")).where((F.col("e") <= reach) | (F.col("w") <= reach) & (F.col("lex") > 0)).drop("e", "w")
    marks = marks.join(sizes, "key").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    counted = dealt.groupBy("key", "part").cogroup(marks.groupBy("key", "part")).applyInArrow(count, _COUNTED_SQL)
    total = counted.groupBy("query_id", "chunk_id").agg(F.first("emb").alias("emb"), F.first("lex").alias("lex"), *[(F.sum(c) + 1).alias(c) for c in ("re", "rl")], *[F.sum(c).alias(c) for c in ("emb_candidates", "lex_candidates")])
    few = (F.col("emb_candidates") > 0) & (F.col("lex_candidates") / F.col("emb_candidates") < FALLBACK_RATIO)
    one = lambda rank: F.lit(1.0) / (F.lit(RRF_K) + F.col(rank))
    rrf = F.when(F.col("fallback"), F.col("emb")).otherwise(one("re") + F.when(F.col("lex") > 0, one("rl")).otherwise(0.0))
    return total.withColumn("fallback", few).withColumn("rrf", rrf).select(*_RANKED.names)


def _ranked(chunks: DataFrame, asked: DataFrame, most: int, guarantee: int, k1: float, b: float, hot_chunks: int) -> DataFrame:
    """reciprocal_ranks of queries that the tasks can hold, as far as a row may be shown."""
    queries, strings, longer = _by_key(asked.toArrow())
    with scratch():
        found = materialize(_found(chunks, strings, longer), "found")
        sizes = {r.key: (r.n, max(r.chars / r.n, 1e-9)) for r in found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("chars")).collect()}
        weight = {key: np.zeros(len(strings[key]) + len(longer[key])) for key in sizes}
        for r in found.select("key", F.explode("at").alias("place")).groupBy("key", "place").agg(F.count(F.lit(1)).alias("df")).collect():
            weight[r.key][r.place] = math.log((sizes[r.key][0] - r.df + 0.5) / (r.df + 0.5) + 1.0)
        held = {key: _held(queries[key], weight[key], avgdl) for key, (_, avgdl) in sizes.items()}
        split = {key: -(-n // hot_chunks) for key, (n, _) in sizes.items() if n > hot_chunks}
        # A row that is among these neither by emb nor by lex has a score below 1 / (60 + most), which the first `most` by emb have at least.
        reach = RRF_K + 2 * most + 1
        whole = found.where(~F.col("key").isin(list(split))) if split else found
        ranked = _of_whole_keys(whole, held, most, guarantee, reach, k1, b)
        if split:
            ranked = ranked.unionByName(_of_split_keys(found, {key: held[key] for key in split}, split, reach, k1, b))
        return materialize(ranked, "ranked", outlives=True)


def hybrid_of_batch(chunks: DataFrame, queries: DataFrame, n: int = DEFAULT_TOP, guarantee: int = GUARANTEE, k1: float = K1, b: float = B, held_bytes: int = HELD_BYTES, hot_chunks: int = HOT_CHUNKS) -> DataFrame:
    """(query_id, chunk_id, emb, lex, fallback, rrf, place): what `hybrid` gives of score_batch(chunks, queries), for any number of pairs.

    The queries (query_id, key, query, vector) come in turns of about held_bytes, for each of which the chunks are read once.
    """
    n = n if n > 0 else DEFAULT_TOP
    asked = materialize(queries.select(F.col("query_id").cast("long").alias("query_id"), "key", "query", "vector"), "asked")
    turns = max(1, math.ceil(query_bytes(asked) / max(1, held_bytes)))
    turn = F.pmod(F.xxhash64("query_id"), F.lit(turns))
    ranked = [_ranked(chunks, asked.where(turn == i) if turns > 1 else asked, max(n, guarantee), guarantee, k1, b or B, hot_chunks) for i in range(turns)]
    return first_of_ranked(reduce(DataFrame.unionByName, ranked), ["query_id"], n, guarantee)
