"""Cutting Markdown documents at their headings, within the row: no shuffle and no Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docpool.functions.text import trim_space

DEFAULT_SIZE, FALLBACK_SIZE = 1500, 8192
#: Code points of prose below which a chunk's text for embedding takes over earlier prose.
SHORT_PROSE = 50
#: Bytes of a line from which a document is refused.
LINE_LIMIT = 65536
_HEADING = r"^#{1,6}([ \t]|$)"


def oversized_line(content: Column) -> Column:
    """Whether a document has a line that makes it fail."""
    return F.exists(F.split(content, "\n"), lambda line: F.octet_length(line) >= LINE_LIMIT)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once for a row however often and in whatever lambda it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _paths(heads: Column) -> Column:
    """The heading path at each heading, in one pass that carries the headings still open."""
    none = F.struct(F.filter(heads, lambda h: F.lit(False)).alias("open"), F.array().cast("array<string>").alias("paths"))

    def step(a: Column, h: Column) -> Column:
        after = lambda s: F.struct(s.alias("open"), F.concat(a["paths"], F.array(F.array_join(F.transform(s, lambda x: x["title"]), " > "))).alias("paths"))
        return let(F.concat(F.filter(a["open"], lambda x: x["level"] < h["level"]), F.array(h)), after)

    return F.aggregate(heads, none, step)["paths"]


def _sections(content: Column, lines: Column, paths: Column, marks: Column) -> Column:
    def section(head: Column, k: Column) -> Column:
        end = F.coalesce(F.get(marks, k + 1)["n"], F.size(lines))
        text = F.regexp_replace(F.array_join(F.slice(lines, head["n"] + 1, end - head["n"]), "\n"), r"\n+$", "")
        return F.struct(F.coalesce(F.get(paths, k - 1), F.lit("")).alias("heading_path"), text.alias("text"))

    whole = F.array(F.struct(F.lit("").alias("heading_path"), content.alias("text")))
    return let(F.filter(F.transform(marks, section), lambda s: s["text"] != ""), lambda found: F.when(F.size(found) > 0, found).otherwise(whole))


def sections(content: Column) -> Column:
    """array<struct<heading_path, text>>: the parts between headings that are not empty, with the titles above them."""
    level = lambda line: F.when(line.rlike(_HEADING), F.length(F.regexp_extract(line, "^#+", 0))).otherwise(0)
    head = lambda line, i: F.struct(i.alias("n"), level(line).alias("level"), F.when(line.startswith("#"), trim_space(F.regexp_replace(line, "^#+", ""))).otherwise("").alias("title"))
    start = F.array(F.struct(F.lit(0).alias("n"), F.lit(0).alias("level"), F.lit("").alias("title")))
    heads = lambda lines: F.filter(F.transform(lines, head), lambda h: h["level"] > 0)
    return let(F.split(content, "\n"), lambda lines: let(heads(lines), lambda found: let(_paths(found), lambda paths: let(F.concat(start, found), lambda marks: _sections(content, lines, paths, marks)))))


def chunks(content: Column, max_size: int) -> Column:
    """array<struct<heading_path, text>>: the sections, those over max_size code points in even parts."""
    size = max_size if max_size > 0 else FALLBACK_SIZE

    def parts(s: Column) -> Column:
        n = F.length(s["text"])
        step = F.when(n > size, F.ceil(n / F.ceil(n / size))).otherwise(F.greatest(n, F.lit(1))).cast("int")
        starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), step)
        return F.transform(starts, lambda at: F.struct(s["heading_path"].alias("heading_path"), F.substring(s["text"], at + 1, step).alias("text")))

    return F.flatten(F.transform(sections(content), parts))


def prose(text: Column) -> Column:
    """A chunk's text without the lines that start with #, trimmed."""
    return trim_space(F.array_join(F.filter(F.split(text, "\n"), lambda line: ~line.startswith("#")), "\n"))


def embedded(pieces: Column) -> Column:
    """pieces with embed_text: the heading path and the prose, if short that of the nearest chunk before with enough."""
    none = F.struct(F.lit(None).cast("string").alias("last"), F.array().cast("array<struct<heading_path:string,text:string,embed_text:string>>").alias("out"))

    def step(a: Column, c: Column) -> Column:
        path = c["heading_path"]

        def added(own: Column, body: Column) -> Column:
            text = F.when((path != "") & (body != ""), F.concat(path, F.lit("\n\n"), body)).when(path != "", path).when(body != "", body).otherwise(c["text"])
            piece = F.struct(path.alias("heading_path"), c["text"].alias("text"), text.alias("embed_text"))
            return F.struct(F.when(F.length(own) >= SHORT_PROSE, own).otherwise(a["last"]).alias("last"), F.concat(a["out"], F.array(piece)).alias("out"))

        return let(prose(c["text"]), lambda own: let(F.when(F.length(own) >= SHORT_PROSE, own).otherwise(F.coalesce(a["last"], own)), lambda body: added(own, body)))

    return F.aggregate(pieces, none, step)["out"]


def chunk_documents(docs: DataFrame, content: str, max_size: int = DEFAULT_SIZE) -> DataFrame:
    """docs' columns without `content`, and chunk_index, heading_path, text, embed_text: a row for each chunk.

    The content must be normalised. A null content gives no chunk, an empty one a single empty chunk. Documents
    with an oversized line are to be taken out before (oversized_line).
    """
    kept = [c for c in docs.columns if c != content]
    pieces = embedded(chunks(F.col(content), max_size))
    made = docs.where(F.col(content).isNotNull()).select(*kept, F.posexplode(pieces).alias("chunk_index", "_chunk"))
    return made.select(*kept, "chunk_index", "_chunk.heading_path", "_chunk.text", "_chunk.embed_text")
