"""Text forms shared by the operators of this package."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

_NO_LETTER_OR_DIGIT = re.compile(r"[\W_]+")
_OTHER_ASCII = bytes(c for c in range(128) if not chr(c).isalnum())


def compat_lower(text: str) -> str:
    """NFKC, then lower case."""
    return (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()


def reduced(text: str) -> str:
    """NFKC, lower case, and nothing but letters and digits."""
    if text.isascii():
        return text.lower().encode("ascii").translate(None, _OTHER_ASCII).decode("ascii")
    return _NO_LETTER_OR_DIGIT.sub("", compat_lower(text))


def folded(text: str) -> str:
    """Lower case, each run of white space one space, trimmed."""
    return " ".join(text.lower().split())


def slices(batches: Iterator[pa.RecordBatch], text: int, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the texts of a slice hold about `chars` bytes at most, or are a single row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > chars:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def sampled(rows: DataFrame, row_id: str, limit: int) -> list[Row]:
    """The `limit` rows of the ids with the smallest hashes.

    The number of rows says below which hash about a fifth more than `limit` rows lie; only these are sorted and may
    reach the driver. If they are too few, as few ids have most of the rows, all are sorted.
    """
    if limit <= 0:
        return []
    known, hashed = rows.where(F.col(row_id).isNotNull()), F.xxhash64(row_id)
    share = 1.2 * (limit + 100) / max(1, rows.count())
    if share < 1:
        found = known.where(hashed < F.lit(int(share * 2**64) - 2**63)).orderBy(hashed, row_id).limit(limit).collect()
        if len(found) == limit:
            return found
    return known.orderBy(hashed, row_id).limit(limit).collect()
