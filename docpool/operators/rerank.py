"""Reordering the first candidates by a pluggable judge."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docpool.functions.text import first_tokens, trim_space

LEAST, MOST = 5, 30
PREVIEW_WORDS = 200
MISSING = -1.0
# The names query, candidates, id, preview, ranking and score in what is asked and answered are the wire format.


@dataclass
class Candidate:
    chunk_id: int
    preview: str


class Reranker(Protocol):
    def scores(self, query: str, candidates: Sequence[Candidate]) -> list[float]: ...


def candidate_count(found: int, n: int) -> int:
    """How many candidates are judged: all if there are few, else n or MOST, whichever is more."""
    return max(0, found) if found <= LEAST else min(found, max(n, MOST))


def preview(heading_path: Column, text: Column) -> Column:
    return first_tokens(trim_space(F.concat_ws("\n", F.coalesce(heading_path, F.lit("")), F.coalesce(text, F.lit("")))), PREVIEW_WORDS)


def request(query: str, candidates: Sequence[Candidate]) -> str:
    """What a language model is asked, with the candidates' places as ids."""
    return json.dumps({"query": query, "candidates": [{"id": str(i), "preview": c.preview} for i, c in enumerate(candidates)]}, ensure_ascii=False)


def parse_scores(answer: str, n: int) -> tuple[list[float], list[str]]:
    """Scores by candidate from {"ranking": [{"id", "score"}]}, and the ids that name no candidate.

    Ids may be strings or numbers; of repeated ones the last counts; a candidate without score has MISSING.
    What is not JSON of that form is an error.
    """
    try:
        rows = json.loads(answer)["ranking"] or []
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError(f"not a ranking: {e}") from e
    scores, dropped = [MISSING] * n, []
    for row in rows:
        given = row.get("id")
        try:
            place = int(given) if isinstance(given, str | int) and not isinstance(given, bool) else -1
        except ValueError:
            place = -1
        if 0 <= place < n:
            scores[place] = float(row.get("score", 0.0))
        else:
            dropped.append(str(given))
    return scores, dropped


def blend(ordered: DataFrame, by: list[str], n: int) -> DataFrame:
    """The first n rows of each query after judging, with place.

    ordered has place (the merge order) and rerank, null for rows that were not judged. Judged rows come first,
    by rerank, then emb, then chunk_id; the others follow in merge order.
    """
    judged = F.col("rerank").isNotNull()
    order = [F.desc(judged), F.desc("rerank"), F.desc(F.when(judged, F.col("emb"))), F.asc(F.when(judged, F.col("chunk_id"))), F.asc("place")]
    window = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
    source = ordered if by else ordered.orderBy(*order).limit(n)
    return source.withColumn("_place", F.row_number().over(window)).where(F.col("_place") <= n).drop("place").withColumnRenamed("_place", "place")
