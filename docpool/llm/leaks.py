"""Passages of evaluation items inside documents: one Aho-Corasick automaton, one pass over each text."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docpool.functions.storage import materialize
from docpool.llm._text import reduced, slices

MIN_RUN = 40
#: Reduced characters of items in one automaton; more items take further passes over the documents.
PASS_CHARS = 8_000_000


def seeds(text: str, min_run: int) -> list[tuple[str, int]]:
    """Blocks of half a run, so spaced that any run of min_run characters of the text holds one whole."""
    size = (min_run + 1) // 2
    return [(text[i : i + size], i) for i in range(0, len(text) - size + 1, min_run - size + 1)]


def automaton(items: list[tuple[int, str]], min_run: int) -> tuple[ahocorasick.Automaton, dict[int, str]]:
    """The automaton over the seeds of all items, each with its (item, offset) places; and the items' texts."""
    places: dict[str, list[tuple[int, int]]] = {}
    for item, text in items:
        if len(text) >= min_run:
            for seed, at in seeds(text, min_run):
                places.setdefault(seed, []).append((item, at))
    machine = ahocorasick.Automaton()
    for seed, where in places.items():
        machine.add_word(seed, where)
    machine.make_automaton()
    return machine, dict(items)


def runs(doc: str, machine: ahocorasick.Automaton, texts: dict[int, str], min_run: int) -> dict[int, tuple[int, int, int]]:
    """By item, the longest run shared with the reduced document: (length, start in document, start in item).

    Of equally long runs the one that starts first in the document stands.
    """
    best: dict[int, tuple[int, int, int]] = {}
    if not len(machine) or len(doc) < min_run:
        return best
    size = (min_run + 1) // 2
    reached: dict[tuple[int, int], int] = {}
    for end, where in machine.iter(doc):
        start = end - size + 1
        for item, at in where:
            diagonal = (item, start - at)
            if reached.get(diagonal, -1) >= end:
                continue
            text = texts[item]
            left = 0
            while left < start and left < at and doc[start - left - 1] == text[at - left - 1]:
                left += 1
            i, j = end + 1, at + size
            while i < len(doc) and j < len(text) and doc[i] == text[j]:
                i, j = i + 1, j + 1
            reached[diagonal] = i - 1
            found = (i - start + left, start - left, at - left)
            if found[0] >= min_run and (item not in best or (-found[0], found[1]) < (-best[item][0], best[item][1])):
                best[item] = found
    return best


def original_offsets(text: str) -> list[int]:
    """For each character of the reduced text, the offset in `text` of the character it stems from."""
    if len(text.lower()) == len(text) and (text.isascii() or unicodedata.is_normalized("NFKC", text)):
        return [i for i, c in enumerate(text.lower()) if c.isalnum()]
    out: list[int] = []
    i = 0
    while i < len(text):
        j = i + 1  # combining marks and the like normalise together with what they follow
        while j < len(text) and (unicodedata.combining(text[j]) or not unicodedata.is_normalized("NFKC", text[i : j + 1]) and unicodedata.is_normalized("NFKC", text[j]) and unicodedata.normalize("NFKC", text[i : j + 1]) != unicodedata.normalize("NFKC", text[i:j]) + text[j]):
            j += 1
        out.extend([i] * len(reduced(text[i:j])))
        i = j
    return out


def leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, *, min_run: int = MIN_RUN, pass_chars: int = PASS_CHARS) -> DataFrame:
    """(doc_id, item_id, run, doc_start, doc_end, item_share): documents sharing a run of min_run characters or more with an item.

    Runs are taken in the reduced texts (NFKC, lower case, letters and digits only); run is the longest one's
    length, item_share its share of the item, doc_start and doc_end its place in the original text.

    Null and empty texts share nothing. Repeated rows give one row; rows of one id with different texts
    give their longest run. Extra columns are not read. No documents or no items give no rows.

    The items are a test set: they are brought to the driver in blocks of at most pass_chars reduced
    characters (or a single item), each block one automaton and one pass over the documents. If there are several, each
    pass is written before the next block is read, so the driver and the tasks hold one block at any number of items.
    Documents are scanned where they lie; only findings are shuffled.
    """
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.length("text") >= F.lit(1))

    def scan(block: list[tuple[int, str]]):
        numbered = sorted(set(block))  # rows of one id with different texts are apart here

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine, texts = automaton([(k, t) for k, (_, t) in enumerate(numbered)], min_run)
            for batch in slices(batches, 1):
                out: list[tuple] = []
                for doc, full in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    found = runs(reduced(full), machine, texts, min_run)
                    if found:
                        place = original_offsets(full)
                        for k, (n, start, _) in found.items():
                            inside = 0 <= start and start + n <= len(place)
                            out.append((doc, numbered[k][0], n, place[start] if inside else None, place[start + n - 1] + 1 if inside else None, n / len(texts[k])))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                columns = list(zip(*out, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "run", "doc_start", "doc_end", "item_share"])

        return read.mapInArrow(of, "doc_id long, item_id long, run long, doc_start long, doc_end long, item_share double")

    written: list[DataFrame] = []
    block: list[tuple[int, str]] = []
    held = 0
    for row in items.select(F.col(item_id).cast("long"), F.col(item_text)).where(F.col(item_text).isNotNull()).distinct().toLocalIterator():
        small = reduced(row[1])
        if len(small) < min_run:
            continue
        if block and held + len(small) > pass_chars:
            written.append(materialize(scan(block), "leaks"))
            block, held = [], 0
        block.append((row[0], small))
        held += len(small)
    found = scan(block)
    for part in written:
        found = found.unionByName(part)
    longest = F.max(F.struct("run", -F.col("doc_start"), -F.col("doc_end"), "item_share")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(longest).select("doc_id", "item_id", "b.run", (-F.col("b.col2")).alias("doc_start"), (-F.col("b.col3")).alias("doc_end"), "b.item_share")
