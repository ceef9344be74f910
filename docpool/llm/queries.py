"""Queries over the test tables, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docpool.llm.knn import nearest, neighbours_above
from docpool.llm.leaks import leaks
from docpool.llm.markup import markup_residue
from docpool.llm.neardup import expanded, near_duplicates
from docpool.llm.packing import pack_documents
from docpool.llm.rankfuse import median_ranking
from docpool.llm.repeats import repeated_documents, repetition
from docpool.llm.split import split_oversized
from docpool.llm.terms import distinctive_terms
from docpool.sources.tables import table


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "chunks").select(F.lit("chunk").alias("kind"), F.col("id").alias("row_id"), "text")
    return chunks.unionByName(table(spark, folder, "search_results").select(F.lit("hit").alias("kind"), F.col("hit_id").alias("row_id"), "text"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, row_id, term): terms used 3 times or more in a row, and in 2 to 6 rows of its table."""
    found = distinctive_terms(_texts(spark, folder), F.col("kind"), "row_id", "text", min_uses=3, min_rows=2, max_rows=6)
    return found.where(F.col("score") >= 0).select("kind", "row_id", "term").distinct()


def p1_top(spark: SparkSession, folder: str) -> DataFrame:
    """The five most distinctive terms of every row."""
    return distinctive_terms(_texts(spark, folder), F.col("kind"), "row_id", "text", min_rows=2, top=5).select("kind", "row_id", "term", "place", F.round("score", 4).alias("score"))


def _near_chunks(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return near_duplicates(table(spark, folder, "chunks"), "id", "text", size=5, threshold=0.7, min_chars=200)


def _near_paths(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return near_duplicates(table(spark, folder, "records"), "id", "path", group="key", fold=str.lower, exact=True, size=3, threshold=0.8, min_chars=0)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, id_a, id_b): near-duplicate chunks, and records of one key with near-duplicate paths."""
    chunks = expanded(*_near_chunks(spark, folder)).select(F.lit("chunk").alias("kind"), "id_a", "id_b")
    paths = expanded(*_near_paths(spark, folder), copies=False).select(F.lit("path").alias("kind"), "id_a", "id_b")
    return chunks.unionByName(paths)


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk of 200 folded characters or more, with its class of equal texts and the number of linked classes."""
    classes, links = _near_chunks(spark, folder)
    ends = links.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    return classes.join(ends, "rep", "left").select("id", F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """(chunk_id, field, family): fields with markup residue, by family."""
    found = markup_residue(table(spark, folder, "chunks"), "id", ["text", "embed_text"], cleaned=False)
    return found.select(F.col("row_id").alias("chunk_id"), "field", F.explode("families").alias("family")).distinct()


def p3_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk's text and embed_text without markup residue."""
    found = markup_residue(table(spark, folder, "chunks"), "id", ["text", "embed_text"])
    return found.select(F.col("row_id").alias("chunk_id"), "field", "clean")


def _ranked(spark: SparkSession, folder: str) -> DataFrame:
    b = F.col("score_breakdown")
    scores = {n: b[n] for n in ("emb", "lex", "grep")} | {"rerank": F.when(b["rerank"] != -1, b["rerank"])}
    return median_ranking(table(spark, folder, "search_results"), "query_id", "chunk_id", scores)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, chunk_id): chunks ranked first that are alone first in three scores, yet not by the sum of scores."""
    ranked = _ranked(spark, folder)
    greatest = ranked.groupBy("group").agg(F.max("total").alias("greatest")).withColumnRenamed("group", "g")
    first = ranked.where((F.col("place") == 1) & (F.col("sole_firsts") >= 3))
    return first.join(greatest, F.col("group").eqNullSafe(F.col("g"))).where(F.col("greatest") > F.col("total")).select(F.col("group").alias("query_id"), F.col("item").alias("chunk_id"))


def p5_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk of every query with its place."""
    return _ranked(spark, folder).select(F.col("group").alias("query_id"), F.col("item").alias("chunk_id"), "place", "median_rank", "mean_rank")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """(id_a, id_b): chunks with cosine 0.95 or more that are among each other's five most similar."""
    near = neighbours_above(table(spark, folder, "chunks"), "id", "vector", dim=64, k=5, floor=0.95)
    pairs = near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b"))
    return pairs.groupBy("id_a", "id_b").agg(F.count(F.lit(1)).alias("sides")).where(F.col("sides") == 2).select("id_a", "id_b")


def p6_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The five chunks most similar to every chunk whose id is divisible by 100."""
    chunks = table(spark, folder, "chunks")
    return nearest(chunks, "id", "vector", chunks.where(F.col("id") % 100 == 0), dim=64, k=5).select("id", "neighbour", "place")


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_oversized(table(spark, folder, "chunks"), "id", "key", "text", "heading_path", table(spark, folder, "chunker_config"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """(chunk_id, boundary): chunks over the limit of their key, with the finest boundary their pieces need."""
    return _pieces(spark, folder).where(F.col("piece") == 0).select(F.col("row_id").alias("chunk_id"), "boundary").distinct()


def p7_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of all chunks over the limit."""
    return _pieces(spark, folder).withColumnRenamed("row_id", "chunk_id")


def p7_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Of every chunk over the limit, the characters of its pieces without their overlaps, and whether each piece is within the limit."""
    own = (F.length("text") - F.col("overlap")).cast("long")
    return _pieces(spark, folder).groupBy(F.col("row_id").alias("chunk_id"), F.col("heading_path")).agg(F.sum(own).alias("chars"), F.bool_and(F.length("text") <= F.col("limit")).alias("within"))


def _packs(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"), "doc_id", "source", "text", table(spark, folder, "pack_limits"), tokens="n_tokens")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id): documents that packing cuts, being larger than a pack."""
    return _packs(spark, folder).where(F.col("pieces") > 1).select("doc_id").distinct()


def p8_packs(spark: SparkSession, folder: str) -> DataFrame:
    """Every pack with its documents' number and tokens."""
    return _packs(spark, folder).groupBy("source", "pack").agg(F.count(F.lit(1)).alias("items"), F.sum("tokens").alias("tokens"), F.max("capacity").alias("capacity"))


def p8_full(spark: SparkSession, folder: str) -> DataFrame:
    """Of every source the tokens in its packs, and whether no pack holds more than the capacity and packs are numbered from 0 without a gap."""
    packs = p8_packs(spark, folder).groupBy("source").agg(F.sum("tokens").alias("tokens"), F.bool_and(F.col("tokens") <= F.col("capacity")).alias("within"), (F.count(F.lit(1)) == F.max("pack") + 1).alias("numbered"))
    return packs


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "text", min_run=40)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, item_id): documents that share a run of 40 reduced characters or more with an evaluation item."""
    return _leaks(spark, folder).select("doc_id", "item_id")


def p9_passages(spark: SparkSession, folder: str) -> DataFrame:
    """The longest passage of each leaked item in each document, by its place in the original text."""
    return _leaks(spark, folder).select("doc_id", "item_id", "run", "doc_start", "doc_end", F.round("item_share", 6).alias("item_share"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id): documents of 100 reduced characters or more, 0.3 of whose windows repeat an earlier one."""
    return repeated_documents(table(spark, folder, "documents"), "doc_id", "text").select("doc_id").distinct()


def p10_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's share of windows that repeat an earlier one."""
    return repetition(table(spark, folder, "documents"), "doc_id", "text", always=("windows",)).select("doc_id", "chars", F.round("windows", 9).alias("windows"))


QUERIES = {
    q.__name__: q
    for q in (
        p1_found, p1_top, p2_found, p2_classes, p3_found, p3_clean, p5_found, p5_ranking, p6_found, p6_nearest,
        p7_found, p7_pieces, p7_whole, p8_found, p8_packs, p8_full, p9_found, p9_passages, p10_found, p10_shares,
    )
}
