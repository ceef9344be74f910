"""Text functions: normalisation, tokens, and counting of substrings."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What counts as a token, and as an identifier in normalised text.
TOKEN_PATTERN = r"[A-Za-z]+-[0-9]+|[A-Za-z0-9_]+|[^\x00-\x7F]+"
ID_PATTERN = r"[a-z]+-[0-9]+"
#: All white space by Unicode, as a class for Spark's regular expressions.
SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def normalise_content(content: Column) -> Column:
    """Without one leading byte order mark, and with LF as the only line end."""
    return F.regexp_replace(F.regexp_replace(content, "^﻿", ""), "\r\n?", "\n")


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def normalised(text: str) -> str:
    """NFKC, then lower case by single characters: no final sigma, and a dotted capital I becomes i."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKC", text)
    return "".join("σ" if c == "Σ" else c.lower()[0] for c in text) if "Σ" in text or "İ" in text else text.lower()


@F.arrow_udf(StringType())
def norm_text(texts: pa.Array) -> pa.Array:
    """`normalised` by Arrow batches; null stays null."""
    return pa.array([None if t is None else normalised(t) for t in texts.to_pylist()], pa.string())


def tokenise(text: str) -> list[str]:
    """Tokens of a text after normalisation, repeated ones too."""
    return re.findall(TOKEN_PATTERN, normalised(text))


def tokens(norm: Column) -> Column:
    """Tokens of an already normalised text, repeated ones too."""
    return F.regexp_extract_all(norm, F.lit(TOKEN_PATTERN), F.lit(0))


def id_tokens(text: str) -> list[str]:
    """Identifiers of a text after normalisation, repeated ones too."""
    return re.findall(ID_PATTERN, normalised(text))


def substring_count(body: Column, part: Column) -> Column:
    """Occurrences of `part` in `body` that do not overlap; 0 if part is empty or either is null."""
    n = (F.length(body) - F.length(F.replace(body, part, F.lit("")))) / F.length(part)
    return F.coalesce(F.when(F.length(part) > 0, n.cast("long")), F.lit(0).cast("long"))


def trim_space(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def first_tokens(text: Column, limit: int = 200) -> Column:
    """The text as it is if it has no more than `limit` words, else its first words, one space between them."""
    words = F.regexp_extract_all(text, F.lit(rf"[^{SPACE[1:]}+"), F.lit(0))
    return F.when(F.size(words) > limit, F.array_join(F.slice(words, 1, limit), " ")).otherwise(text)
