"""Repetition inside a single document, measured by short-circuit cascades of rules."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docpool.llm._text import reduced, sampled, slices

WINDOW = 20
MIN_CHARS = 100
#: Shares from which a document counts as mostly repetition, by rule.
LIMITS = {"windows": 0.3, "lines": 0.3, "paragraphs": 0.3, "top_word": 0.4}
#: Bytes of text that are measured at once.
_SLICE = 1_000_000

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def steps(size: int) -> int:
    """Passes over the characters that hashing their substrings of `size` takes."""
    return size.bit_length() - 1 + size.bit_count()


def hashed(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all substrings of `size` characters of each text, one after the other, and the texts' numbers of them."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = np.maximum(lengths - size + 1, 0)
    if not counts.sum():
        return np.zeros(0, _U), counts
    w = _mix(codes + _U(0x9E3779B97F4A7C15))
    base, done, whole, at = 0xD6E8FEB86659FD93, 1, None, 0
    bit, power, left = w, base, size
    while left:  # substrings of 1, 2, 4.. characters, joined as the bits of `size` say
        if left & 1:
            if whole is None:
                whole, at = bit, done
            else:
                m = len(w) - at - done + 1
                whole, at = whole[:m] * _U(power) + bit[at : at + m], at + done
        left >>= 1
        if left:
            m = len(bit) - done
            bit = bit[:m] * _U(power) + bit[done : done + m]
            done *= 2
            power = power * power % 2**64
    starts = np.cumsum(lengths) - lengths
    place = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    return _mix(whole[place]), counts


def window_shares(texts: list[str], size: int = WINDOW) -> np.ndarray:
    """Of each reduced text the share of its windows of `size` characters that equal an earlier one."""
    hashes, counts = hashed(texts, size)
    out, end = np.zeros(len(texts)), np.cumsum(counts)
    for i, n in enumerate(counts):
        if n:
            h = np.sort(hashes[end[i] - n : end[i]])
            out[i] = float((h[1:] == h[:-1]).sum()) / n
    return out


def most_repeated(texts: list[str]) -> np.ndarray:
    """Upper bounds of these shares: windows that differ in their first eight bytes, as UTF-8, are different.

    The bytes are read as numbers where they lie, so nothing is hashed.
    """
    out = np.zeros(len(texts))
    for i, text in enumerate(texts):
        n = len(text) - WINDOW + 1
        if n > 0:
            raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            words = np.lib.stride_tricks.as_strided(raw[: 8 * (len(raw) // 8)].view(_U), (len(raw) - 7,), (1,))
            starts = words[:n] if len(raw) == len(text) else words[np.nonzero((raw & 0xC0) != 0x80)[0][:n]]
            h = np.sort(starts)
            out[i] = float((h[1:] == h[:-1]).sum()) / n
    return out


@dataclass(frozen=True)
class Rule:
    """measure gives a value for each of some texts; cost is the number of steps for a text of n characters."""

    measure: Callable[[list[str]], np.ndarray]
    cost: Callable[[int], float]


#: Tests of a reduced text, each of which clears it if the value is below the limit: upper bounds of its share, and the share.
CLEARING = {
    "length": Rule(lambda ts: np.array([float(len(t) >= MIN_CHARS) for t in ts]), lambda n: 1),
    "bytes": Rule(most_repeated, lambda n: n * (2 + math.log2(n + 1) / 2)),
    "windows": Rule(window_shares, lambda n: n * (2 * steps(WINDOW) + 6 + math.log2(n + 1) / 2)),
}


def ordered(rules: dict[str, Rule], texts: list[str], rejects: Callable[[str, np.ndarray], np.ndarray]) -> list[str]:
    """The rules by texts of a sample rejected per step, best first, each measured on what those before it let pass."""
    left, out, rest = list(texts), [], dict(rules)
    while rest and left:
        rate, kept = {}, {}
        for name, rule in rest.items():
            out_of = rejects(name, rule.measure(left))
            kept[name] = [t for t, gone in zip(left, out_of, strict=True) if not gone]
            rate[name] = (len(left) - len(kept[name]) + 0.01) / sum(rule.cost(len(t)) for t in left)
        best = max(rest, key=lambda name: rate[name])
        out.append(best)
        left = kept[best]
        del rest[best]
    return out + list(rest)


def repeated_documents(docs: DataFrame, doc_id: str, text: str, *, limit: float = LIMITS["windows"], sample_rows: int = 400) -> DataFrame:
    """(doc_id, chars, share): documents of MIN_CHARS reduced characters or more whose share of repeated windows is `limit` or more.

    A cascade of tests (CLEARING), each of which clears documents for good: too short, or an upper bound of the share is
    below the limit, or at last the share itself is. The order comes from a sample of at most sample_rows texts (those
    with the smallest hash of the id): texts cleared per step of each test, greatest first. A document goes through the
    tests until one clears it, so the order changes the work, never the rows. If the exact test is not last, those after
    it are left out.

    Reduced texts are NFKC, in lower case, letters and digits only. Null and empty texts are no rows; repeated ids are
    rows of their own. Other columns are not read. Documents are measured where they lie, without a shuffle.
    """
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sample = [reduced(r.text) for r in sampled(read, "doc_id", sample_rows) if r.text]
    order = ordered(CLEARING, sample, lambda name, values: values < (1 if name == "length" else limit))
    order = [*(n for n in order[: order.index("windows")]), *(["length"] if "length" not in order[: order.index("windows")] else []), "windows"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, _SLICE):
            ids = batch.column(0).to_pylist()
            left = [(i, reduced(t)) for i, t in zip(ids, batch.column(1).to_pylist(), strict=True) if t]
            values = np.zeros(0)
            for name in order:
                values = CLEARING[name].measure([t for _, t in left])
                stay = values >= (1 if name == "length" else limit)
                left, values = [x for x, s in zip(left, stay, strict=True) if s], values[stay]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in left], pa.int64()), pa.array([len(t) for _, t in left], pa.int64()), pa.array(values, pa.float64())], names=["doc_id", "chars", "share"])

    return read.mapInArrow(measure, "doc_id long, chars long, share double")


def _repeated(parts: list[str]) -> float:
    total = sum(map(len, parts))
    return 1 - sum(map(len, set(parts))) / total if total else 0.0


def lines_share(text: str) -> float:
    """Share of characters in lines that repeat an earlier line."""
    return _repeated([x for x in map(str.strip, text.splitlines()) if x])


def paragraphs_share(text: str) -> float:
    """Share of characters in paragraphs that repeat an earlier paragraph."""
    return _repeated([x for x in map(str.strip, text.replace("\r\n", "\n").replace("\r", "\n").split("\n\n")) if x])


def top_word_share(text: str) -> float:
    """Share of the characters of all words that the most burdensome word takes."""
    words = text.lower().split()
    if len(words) < 8:
        return 0.0
    return max(len(w) * n for w, n in Counter(words).items()) / max(1, sum(map(len, words)))


def _windows(texts: list[str]) -> np.ndarray:
    small = [reduced(t) for t in texts]
    return window_shares([t if len(t) >= MIN_CHARS else "" for t in small])


def _each(share: Callable[[str], float]) -> Callable[[list[str]], np.ndarray]:
    return lambda texts: np.array([share(t) for t in texts], np.float64)


#: Shares of a whole text, each of which rejects it as mostly repetition from its limit on.
RULES = {
    "windows": Rule(_windows, lambda n: n * (2 * steps(WINDOW) + 16 + math.log2(n + 1) / 2)),
    "lines": Rule(_each(lines_share), lambda n: 2 * n),
    "paragraphs": Rule(_each(paragraphs_share), lambda n: 3 * n),
    "top_word": Rule(_each(top_word_share), lambda n: 4 * n),
}


def rule_order(texts: list[str]) -> list[str]:
    """The rules by documents of a sample rejected per step, best first; without a sample, as listed."""
    return ordered(RULES, texts, lambda name, values: values >= LIMITS[name])


def repetition(docs: DataFrame, doc_id: str, text: str, *, sample_rows: int = 400, always: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, chars, windows, lines, paragraphs, top_word, rule): each document's shares of repeated content.

    rule is the first rule of the cascade that rejects the document, null if none does. The cascade's order
    comes from a sample of at most sample_rows texts (those with the smallest hash of the id): rejections per
    step of each rule, greatest first; steps are counted, not timed, so the order is the same in every run. A
    rule is measured until one has rejected the document, and its share is null after that; the rules in `always` are
    measured for every document. So the order changes which shares are null, and `rule`, never a share or
    whether a document is rejected.

    chars: characters of the reduced text (NFKC, lower case, letters and digits only); windows: of one with 100
    characters or more, the share of windows of 20 characters that equal one starting earlier. An empty or null
    text repeats nothing; repeated ids are rows of their own. Documents are scored where they lie, without a shuffle.
    """
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = rule_order([r.text for r in sampled(read, "doc_id", sample_rows) if r.text])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, _SLICE):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            first: list[str | None] = [None] * len(texts)
            found: dict[str, list[float | None]] = {r: [None] * len(texts) for r in RULES}
            for rule in order:
                asked = [i for i, f in enumerate(first) if f is None or rule in always]
                for i, share in zip(asked, RULES[rule].measure([texts[i] for i in asked]).tolist(), strict=True):
                    found[rule][i] = share
                    if first[i] is None and share >= LIMITS[rule]:
                        first[i] = rule
            columns = [pa.array([len(reduced(t)) for t in texts], pa.int64()), *(pa.array(found[r], pa.float64()) for r in RULES), pa.array(first, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "chars", *RULES, "rule"])

    return read.mapInArrow(measure, "doc_id long, chars long, " + ", ".join(f"{r} double" for r in RULES) + ", rule string")
