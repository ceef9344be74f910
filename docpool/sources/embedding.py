"""Vectors for texts from a pluggable provider."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

BATCH, ATTEMPTS = 100, 3


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass
class HashEmbedder:
    """A deterministic provider without a network: signed hashes of words, of length 1."""

    dim: int = 64

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = hashlib.blake2b(word.encode(), digest_size=8).digest()
                row[int.from_bytes(h[:4], "little") % self.dim] += 1 if h[4] & 1 else -1
            norm = float(np.linalg.norm(row))
            if norm:
                row /= norm
        return out.tolist()


@dataclass
class Embedded:
    """Vectors in the order of the texts; those of failed batches are None and their places are in `skipped`."""

    vectors: list[list[float] | None]
    skipped: list[int] = field(default_factory=list)
    error: str | None = None


def by_index(answer: list[dict], n: int) -> list[list[float]]:
    """A provider's answer, rows of `index` and `embedding`, in the order of the texts; a missing one is an error."""
    found = {int(x["index"]): x["embedding"] for x in answer}
    if missing := [i for i in range(n) if i not in found]:
        raise ValueError(f"no vector for text {missing[0]}")
    return [found[i] for i in range(n)]


def embed_all(embedder: Embedder, texts: list[str], *, batch: int = BATCH, attempts: int = ATTEMPTS, wait: Callable[[float], None] = time.sleep) -> Embedded:
    """All texts in batches; each is tried `attempts` times, after 1, 2, 4.. seconds, and given up alone."""
    out = Embedded([None] * len(texts))
    for start in range(0, len(texts), batch):
        part = texts[start : start + batch]
        for attempt in range(attempts):
            if attempt:
                wait(2.0 ** (attempt - 1))
            try:
                vectors = embedder.embed(part)
                if len(vectors) != len(part):
                    raise ValueError(f"{len(vectors)} vectors for {len(part)} texts")
                out.vectors[start : start + len(part)] = vectors
                break
            except Exception as e:  # noqa: BLE001 - what a provider raises is up to it
                out.error = str(e)
        else:
            out.skipped += range(start, start + len(part))
    if not out.skipped:
        out.error = None
    return out


def with_vectors(chunks: DataFrame, embedder: Embedder, text: str = "embed_text") -> DataFrame:
    """chunks with `vector` and `embed_error`: embedded in the tasks, batch by batch."""
    names = chunks.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            got = embed_all(embedder, frame[text].tolist())
            failed = set(got.skipped)
            yield frame.assign(vector=pd.Series([None if v is None else [float(x) for x in v] for v in got.vectors], dtype=object), embed_error=pd.Series([got.error if i in failed else None for i in range(len(frame))], dtype=object))[[*names, "vector", "embed_error"]]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields)
    return chunks.mapInPandas(run, f"{fields}, vector array<float>, embed_error string")
