"""The three signals a query scores chunks with: vector cosine, substring BM25 with bonuses, literal grep."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from docpool.functions.ranks import spread_join
from docpool.functions.storage import materialize
from docpool.functions.text import ID_PATTERN, id_tokens, norm_text, normalised, substring_count, tokenise, tokens

K1, B = 1.5, 0.75
ID_BONUS, PHRASE_BONUS = 10.0, 2.0
#: Decimal places to which signals are rounded, so that equal scores are ties whatever order they were summed in.
DIGITS = 9
#: Chunks of a key that meet its queries in one task.
HOT_CHUNKS = 20_000
#: Bytes of a batch of queries that are sent to every task.
HELD_BYTES = 32 * 1024 * 1024


def cosine_to(vector: Column, query: Sequence[float] | None) -> Column:
    """Cosine with one query vector; 0 without a vector, for another length, or for a norm of 0."""
    if query is None or not len(query):
        return F.lit(0.0)
    q = np.asarray(query, np.float32).astype(np.float64)
    norm = float(np.sqrt((q * q).sum()))

    @F.arrow_udf(DoubleType())
    def cosine(vectors: pa.Array) -> pa.Array:
        out = np.zeros(len(vectors))
        right = pc.fill_null(pc.equal(pc.list_value_length(vectors), len(q)), False).to_numpy(zero_copy_only=False)
        if right.any() and norm:
            x = vectors.filter(pa.array(right)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(q))
            size = np.sqrt((x * x).sum(1))
            with np.errstate(invalid="ignore", divide="ignore"):
                out[right] = np.nan_to_num(np.where(size > 0, x @ q / (size * norm), 0.0))
        return pa.array(out)

    return cosine(vector)


@F.arrow_udf(DoubleType())
def cosine(a: pa.Array, b: pa.Array) -> pa.Array:
    """Cosine of two vectors of a row, by the rules of cosine_to."""
    out = np.zeros(len(a))
    la, lb = (pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in (a, b))
    for n in np.unique(la[la == lb]):
        at = (la == n) & (lb == n)
        if n:
            x, y = (v.filter(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n) for v in (a, b))
            size = np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1))
            with np.errstate(invalid="ignore", divide="ignore"):
                out[at] = np.nan_to_num(np.where(size > 0, (x * y).sum(1) / size, 0.0))
    return pa.array(out)


def bm25(tf: Column, idf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    """One token's part of the score; b = 0 means the default."""
    b = b or B
    return idf * tf * (k1 + 1) / (tf + k1 * (F.lit(1.0 - b) + F.lit(b) * dl / avgdl))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))


def normal_form(chunks: DataFrame) -> DataFrame:
    """chunks with `norm`, the normalised text, unless they already have it."""
    return chunks if "norm" in chunks.columns else chunks.withColumn("norm", F.coalesce(norm_text("text"), F.lit("")))


def lex_score(chunks: DataFrame, query: str, k1: float = K1, b: float = B) -> Column:
    """BM25 over substrings for one query: one pass over chunks (with `norm`) for the statistics, then literals only."""
    words, ids, whole = Counter(tokenise(query)), id_tokens(query), normalised(query)
    if not words:
        return F.lit(0.0)
    norm = F.col("norm")
    counts = chunks.agg(F.count(F.lit(1)).alias("n"), F.avg(F.length(norm)).alias("avgdl"), *[F.count_if(norm.contains(F.lit(t))).alias(f"df_{i}") for i, t in enumerate(words)]).first()
    n, avgdl = counts["n"], counts["avgdl"] or 1.0
    score = F.lit(0.0)
    for i, (t, times) in enumerate(words.items()):
        df = counts[f"df_{i}"]
        weight = math.log((n - df + 0.5) / (df + 0.5) + 1.0)
        tf = substring_count(norm, F.lit(t)).cast("double")
        score = score + F.when(tf > 0, F.lit(float(times)) * bm25(tf, F.lit(weight), F.length(norm).cast("double"), F.lit(avgdl), k1, b)).otherwise(0.0)
    for m in ids:
        score = score + F.when(norm.contains(F.lit(m)), ID_BONUS).otherwise(0.0)
    return score + F.when(norm.contains(F.lit(whole)), PHRASE_BONUS).otherwise(0.0)


def grep_count(norm: Column, query: str) -> Column:
    """Occurrences of the whole query, trimmed; none for an empty one."""
    part = normalised(query).strip()
    return substring_count(norm, F.lit(part)) if part else F.lit(0).cast("long")


def score(chunks: DataFrame, query: str, vector: Sequence[float] | None = None, signals: Sequence[str] = ("emb", "lex", "grep"), keep: Sequence[str] = (), k1: float = K1, b: float = B) -> DataFrame:
    """(chunk_id, *keep, emb, lex, grep): every chunk (id, text, vector) scored by one query; signals not asked for are 0."""
    read = normal_form(chunks) if {"lex", "grep"} & {*signals} else chunks
    columns = {
        "emb": cosine_to(F.col("vector"), vector) if "emb" in signals else F.lit(0.0),
        "lex": lex_score(read, query, k1, b) if "lex" in signals else F.lit(0.0),
        "grep": grep_count(F.col("norm"), query) if "grep" in signals else F.lit(0).cast("long"),
    }
    return read.select(F.col("id").alias("chunk_id"), *keep, *[F.round(c, DIGITS).alias(n) if n != "grep" else c.alias(n) for n, c in columns.items()])


@dataclass
class _Query:
    id: int
    norm: str
    words: Counter
    ids: list[str]
    vector: np.ndarray


def _cosines(vectors: pa.Array, query: np.ndarray) -> np.ndarray:
    """Cosines of vectors with one query's, by the rules of cosine_to."""
    out = np.zeros(len(vectors))
    size = float(np.sqrt((query * query).sum()))
    right = pc.fill_null(pc.equal(pc.list_value_length(vectors), len(query)), False).to_numpy(zero_copy_only=False)
    if len(query) and size and right.any():
        x = vectors.filter(pa.array(right)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(query))
        own = np.sqrt((x * x).sum(1))
        with np.errstate(invalid="ignore", divide="ignore"):
            out[right] = np.nan_to_num(np.where(own > 0, x @ query / (own * size), 0.0))
    return out


def _best(score: np.ndarray, ids: np.ndarray, cap: int) -> np.ndarray:
    """Mask of the `cap` greatest scores, ties by id."""
    keep = np.zeros(len(score), bool)
    keep[np.lexsort((ids, -score))[:cap]] = True
    return keep


def _score_held(chunks: DataFrame, queries: DataFrame, cap: int | None, k1: float, b: float) -> DataFrame:
    asked: dict[str, list[_Query]] = {}
    for r in queries.collect():
        norm = normalised(r.query or "")
        vector = np.asarray(r.vector if r.vector is not None else [], np.float64)
        asked.setdefault(r.key, []).append(_Query(r.query_id, norm, Counter(tokenise(norm)), id_tokens(norm), vector))
    words = {key: sorted({w for q in qs for w in q.words}) for key, qs in asked.items()}
    b = b or B
    text = "norm" if "norm" in chunks.columns else "text"
    read = chunks.select("key", F.col("id").alias("chunk_id"), F.col(text).alias("text"), "vector").where(F.col("key").isin(list(asked)) if len(asked) <= 1000 else F.col("key").isNotNull())

    def parts(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch, list[str]]]:
        places: dict[str, list[int]] = {}
        for i, key in enumerate(batch.column(0).to_pylist()):
            if key in asked:
                places.setdefault(key, []).append(i)
        for key, at in places.items():
            own = batch.take(pa.array(at))
            yield key, own, [("" if t is None else t if text == "norm" else normalised(t)) for t in own.column(2).to_pylist()]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        chars: Counter = Counter()
        df: dict[str, np.ndarray] = {}
        for batch in batches:
            for key, _, texts in parts(batch):
                n[key] += len(texts)
                chars[key] += sum(map(len, texts))
                df[key] = df.get(key, 0) + np.array([sum(w in t for t in texts) for w in words[key]], np.int64)
        rows = [(k, None, n[k], chars[k]) for k in n] + [(k, w, int(d), 0) for k in n for w, d in zip(words[k], df[k], strict=True)]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "word", "n", "chars"])

    counted = read.mapInArrow(count, "key string, word string, n long, chars long").groupBy("key", "word").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars")).collect()
    size = {r.key: (r.n, max(r.chars / max(1, r.n), 1e-9)) for r in counted if r.word is None}
    weight = {(r.key, r.word): math.log((size[r.key][0] - r.n + 0.5) / (r.n + 0.5) + 1.0) for r in counted if r.word is not None}

    def score_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, own, texts in parts(batch):
                ids = own.column(1).to_numpy(zero_copy_only=False)
                damp = k1 * (1 - b + b * np.array([len(t) for t in texts], np.float64) / size[key][1])
                terms = {}
                for w in words[key]:
                    tf = np.array([t.count(w) for t in texts], np.float64)
                    terms[w] = weight[key, w] * tf * (k1 + 1) / (tf + damp) if tf.any() else None
                found: list[tuple] = []
                for q in asked[key]:
                    lex = np.zeros(len(texts))
                    for w, times in q.words.items():
                        if terms[w] is not None:
                            lex += times * terms[w]
                    if q.words:
                        for m in q.ids:
                            lex += np.array([ID_BONUS if m in t else 0.0 for t in texts])
                        lex += np.array([PHRASE_BONUS if q.norm in t else 0.0 for t in texts])
                    part = q.norm.strip()
                    grep = np.array([t.count(part) for t in texts], np.int64) if part else np.zeros(len(texts), np.int64)
                    emb, lex = np.round(_cosines(own.column(3), q.vector), DIGITS), np.round(lex, DIGITS)
                    keep = slice(None) if cap is None or len(ids) <= cap else _best(emb, ids, cap) | _best(lex, ids, cap) | (grep > 0)
                    found.append((np.full(len(ids), q.id)[keep], ids[keep], emb[keep], lex[keep], grep[keep]))
                    if sum(len(x[0]) for x in found) > 200_000:
                        yield joined(found)
                        found = []
                if found:
                    yield joined(found)

    def joined(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["query_id", "chunk_id", "emb", "lex", "grep"])

    return materialize(read.mapInArrow(score_all, "query_id long, chunk_id long, emb double, lex double, grep long"), "pairs")


def query_bytes(queries: DataFrame) -> int:
    """About how much memory queries take."""
    return queries.agg(F.sum(F.coalesce(F.octet_length("query"), F.lit(0)) + 8 * F.greatest(F.coalesce(F.size("vector"), F.lit(0)), F.lit(0)) + 64)).first()[0] or 0


def score_batch(chunks: DataFrame, queries: DataFrame, cap: int | None = None, k1: float = K1, b: float = B, held_bytes: int = HELD_BYTES) -> DataFrame:
    """(query_id, chunk_id, emb, lex, grep): every query (query_id, key, query, vector) with all chunks (id, key, text, vector) of its key.

    Queries of held_bytes or less go to the tasks, so no chunk moves: one pass counts the distinct words of each key's
    queries, whose statistics come with map-side sums, and one scores. With `cap`, of each batch of chunks only those are
    given that are among its `cap` best by emb or lex, or that grep finds, which is all that the merge of signals
    with that cap can show. More queries than that meet their chunks in a join.
    """
    asked = queries.select("query_id", "key", "query", "vector")
    return _score_held(chunks, asked, cap, k1, b) if query_bytes(asked) <= held_bytes else _score_joined(chunks, asked, k1, b)


def _score_joined(chunks: DataFrame, queries: DataFrame, k1: float, b: float) -> DataFrame:
    """score_batch for any number of queries.

    Chunks and queries meet by an equi-join on key; keys with many chunks are split. Texts are only read
    in that join: what goes on is a row of numbers for each pair, written once, from which the statistics
    of every query and token come with map-side sums.
    """
    q = queries.select("query_id", F.col("key").alias("q_key"), F.coalesce(norm_text("query"), F.lit("")).alias("q_norm"), F.col("vector").alias("q_vector"))
    q = q.withColumn("q_tokens", tokens(F.col("q_norm"))).withColumn("q_words", F.array_distinct("q_tokens")).withColumn("q_ids", F.regexp_extract_all("q_norm", F.lit(ID_PATTERN), F.lit(0)))
    q = q.withColumn("q_times", F.transform("q_words", lambda w: F.size(F.filter("q_tokens", lambda t: t == w))))
    c = normal_form(chunks).select(F.col("id").alias("chunk_id"), F.col("key").alias("c_key"), "norm", "vector")
    met = spread_join(c, q.withColumnRenamed("q_key", "c_key"), "c_key", "chunk_id", counted=chunks.select(F.col("key").alias("c_key")), hot_rows=HOT_CHUNKS)
    norm = F.col("norm")
    bonus = F.aggregate("q_ids", F.lit(0.0), lambda s, m: s + F.when(F.contains(norm, m), ID_BONUS).otherwise(0.0)) + F.when(F.contains(norm, F.col("q_norm")), PHRASE_BONUS).otherwise(0.0)
    pairs = met.select(
        "query_id", "chunk_id", F.length(norm).cast("double").alias("dl"), "q_times",
        cosine("vector", "q_vector").alias("emb"),
        F.transform("q_words", lambda w: substring_count(norm, w).cast("double")).alias("tf"),
        F.when(F.size("q_words") > 0, bonus).otherwise(0.0).alias("bonus"),
        substring_count(norm, F.trim("q_norm")).alias("grep"),
    )
    pairs = materialize(pairs, "pairs")
    stats = pairs.groupBy("query_id").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("dl").alias("avgdl"))
    found = pairs.select("query_id", F.posexplode("tf").alias("word", "tf")).groupBy("query_id", "word").agg(F.count_if(F.col("tf") > 0).cast("double").alias("df"))
    found = found.join(stats.select("query_id", "n"), "query_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("word", idf(F.col("n"), F.col("df")).alias("idf")))).alias("idfs"))
    scored = pairs.join(stats.join(found, "query_id", "left"), "query_id")
    part = lambda tf, k: F.when(tf > 0, F.get("q_times", k) * bm25(tf, F.get("idfs", k)["idf"], F.col("dl"), F.greatest("avgdl", F.lit(1e-9)), k1, b)).otherwise(0.0)
    lex = F.aggregate(F.transform("tf", part), F.lit(0.0), lambda s, x: s + x) + F.col("bonus")
    return scored.select("query_id", "chunk_id", F.round("emb", DIGITS).alias("emb"), F.round(F.coalesce(lex, F.lit(0.0)), DIGITS).alias("lex"), "grep")
