"""Queries over the chunks of a key: six modes, stage counts, warnings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docpool.functions.storage import materialize, scratch
from docpool.operators.fusion import DEFAULT_TOP, SIGNAL_CAP, FALLBACK_RATIO, hits, hybrid, merge_order, merge_signals, primary_score, reciprocal_ranks, signal_list, top
from docpool.operators.rerank import Candidate, Reranker, blend, candidate_count, preview
from docpool.operators.signals import B, K1, score

MODES = ("emb", "lex", "grep", "hybrid", "all", "rerank")
NEEDS = {"emb": ("emb",), "lex": ("lex",), "grep": ("grep",), "hybrid": ("emb", "lex")}


@dataclass
class Found:
    """hits: (place, chunk_id, path, heading_path, text, score, origin_signals, score_breakdown, series_keys), best first."""

    hits: DataFrame
    stats: dict[str, int]
    warnings: list[str] = field(default_factory=list)


def scan(chunks: DataFrame, records: DataFrame, series_keys: DataFrame, key: str | None = None, series: str | None = None) -> DataFrame:
    """Chunks of a key, and of a series if one is given, with path and the sorted series of their record.

    An unknown series gives no rows. Without a series, records of no series are there too.
    """
    wanted = records if key is None else records.where(F.col("key") == key)
    if series is not None:
        wanted = wanted.join(series_keys.where(F.col("series") == series), wanted.id == series_keys.record_id, "left_semi")
    lists = series_keys.groupBy("record_id").agg(F.array_sort(F.collect_set("series")).alias("series_keys"))
    named = wanted.select(F.col("id").alias("record_id"), F.col("key"), F.col("path"))
    own = [c for c in chunks.columns if c not in ("key", "path")]
    return chunks.select(*own).join(named, "record_id").join(lists, "record_id", "left")


def search(chunks: DataFrame, query: str, vector: Sequence[float] | None = None, mode: str = "all", n: int = DEFAULT_TOP, reranker: Reranker | None = None, k1: float = K1, b: float = B) -> Found:
    """The n best chunks (id, path, heading_path, text, vector[, norm, series_keys]) for one query.

    emb ranks all chunks, negative cosines too; lex and grep keep what they found; hybrid fuses emb and lex;
    all and rerank merge what any signal found. Without chunks every mode, even an unknown one, gives an empty
    success. Chunks are scored in one pass, and only (id, scores) is kept; texts are fetched for the hits. The
    hits, n at most, are rows at hand; what was written on the way is deleted.
    """
    with scratch():
        found = _search(chunks, query, vector, mode, n, reranker, k1, b)
        rows = found.hits.collect()
    return Found(chunks.sparkSession.createDataFrame(rows, found.hits.schema), found.stats, found.warnings)


def _search(chunks: DataFrame, query: str, vector: Sequence[float] | None, mode: str, n: int, reranker: Reranker | None, k1: float, b: float) -> Found:
    n = n if n > 0 else DEFAULT_TOP
    mode = mode or "all"
    stats = dict.fromkeys(("emb_candidates", "lex_candidates", "grep_candidates", "fused_candidates", "merged_candidates", "rerank_candidates"), 0)
    warnings: list[str] = []
    if mode not in MODES and not chunks.isEmpty():
        raise ValueError(f"unknown mode {mode!r}")
    scored = materialize(score(chunks, query, vector, NEEDS.get(mode, ("emb", "lex", "grep")), k1=k1, b=b), "scores")
    stats |= hits(scored, []).first().asDict()
    none = F.lit(None).cast("double")
    if mode == "emb":
        ranked = top(scored, [], "emb", n).withColumn("origin_signals", F.array(F.lit("emb")))
    elif mode in ("lex", "grep"):
        ranked = top(scored.where(F.col(mode) > 0), [], mode, n).withColumn("origin_signals", F.array(F.lit(mode)))
    elif mode == "hybrid":
        ranked = hybrid(scored, [], n).withColumn("origin_signals", signal_list(F.col("emb") > 0, F.col("lex") > 0, F.lit(False))).drop("fallback")
        stats["fused_candidates"] = scored.count()
        e, w = stats["emb_candidates"], stats["lex_candidates"]
        if e and w / e < FALLBACK_RATIO:
            warnings.append(f"emb fallback: lex found {w}, emb {e}")
    else:
        merged = materialize(merge_signals(scored, [], n), "merged")
        stats["merged_candidates"] = merged.count()
        ranked = merge_order(merged, [], max(n, SIGNAL_CAP))
        if mode == "rerank" and reranker is not None and stats["merged_candidates"]:
            ranked = materialize(ranked, "ordered")
            few = candidate_count(stats["merged_candidates"], n)
            texts = chunks.select(F.col("id").alias("chunk_id"), preview(F.col("heading_path"), F.col("text")).alias("preview"))
            rows = ranked.where(F.col("place") <= few).select("chunk_id", "place").join(texts, "chunk_id").orderBy("place").collect()
            try:
                given = reranker.scores(query, [Candidate(r.chunk_id, r.preview) for r in rows])
                if len(given) != len(rows):
                    raise ValueError(f"{len(given)} scores for {len(rows)} candidates")
            except Exception as e:  # noqa: BLE001 - the merge order stands whatever the judge raises
                warnings.append(f"rerank fallback: {e}")
            else:
                judged = chunks.sparkSession.createDataFrame([(r.chunk_id, float(s)) for r, s in zip(rows, given, strict=True)], "chunk_id long, rerank double")
                ranked = blend(ranked.join(judged, "chunk_id", "left"), [], n)
                stats["rerank_candidates"] = few
        ranked = ranked.where(F.col("place") <= n)
    for c in ("rrf", "rerank"):
        if c not in ranked.columns:
            ranked = ranked.withColumn(c, none)
    breakdown = F.struct(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("emb", "lex", "grep", "rrf", "rerank")])
    shown = ranked.select("place", "chunk_id", F.coalesce(primary_score(mode), F.lit(0.0)).alias("score"), "origin_signals", breakdown.alias("score_breakdown"))
    series = F.col("series_keys") if "series_keys" in chunks.columns else F.lit(None).cast("array<string>")
    named = chunks.select(F.col("id").alias("chunk_id"), "path", "heading_path", "text", series.alias("series_keys"))
    return Found(shown.join(named, "chunk_id").orderBy("place"), stats, warnings)


def search_batch(scored: DataFrame, mode: str = "all", n: int = DEFAULT_TOP) -> DataFrame:
    """The n best chunks of every query, with place, of what score_batch gave; mode is any but rerank."""
    by = ["query_id"]
    if mode in ("emb", "lex", "grep"):
        return top(scored if mode == "emb" else scored.where(F.col(mode) > 0), by, mode, n)
    if mode == "hybrid":
        return hybrid(scored, by, n)
    if mode == "all":
        return merge_order(merge_signals(scored, by, n), by, n)
    raise ValueError(f"unknown mode {mode!r}")


__all__ = ["Found", "MODES", "reciprocal_ranks", "scan", "search", "search_batch"]
