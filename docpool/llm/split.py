"""Splitting oversized texts at natural boundaries: packing of the text's structure tree."""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docpool.llm._text import slices

DEFAULT_LIMIT, FALLBACK_LIMIT = 1500, 8192
_HEADING = re.compile(r"(#{1,6})(?:[ \t]|$)")
_SENTENCE_END = re.compile(r"[.!?][\"')\]]*\s+|[。！？]")
FENCES = ("```", "~~~")


@dataclass
class Node:
    """A span of the text: the document, a section (level 1-6), a block, a part of one, a line, or what is between two of them.

    Spans of siblings adjoin. A line end between lines or parts is a node of its own, of their kind, as are the blank lines
    between blocks ("blank"), so that no node is the longer for what follows it.
    """

    kind: str
    start: int
    end: int = 0
    level: int = 0
    children: list[Node] = field(default_factory=list)


def unix_lines(text: str) -> tuple[str, list[int]]:
    """The text with LF as its only line end, and the places in it of line ends that were two characters."""
    if "\r" not in text:
        return text, []
    pairs, at = [], text.find("\r\n")
    while at >= 0:
        pairs.append(at - len(pairs))
        at = text.find("\r\n", at + 2)
    return text.replace("\r\n", "\n").replace("\r", "\n"), pairs


def parse(text: str) -> Node:
    """The tree of a text with LF line ends: sections by heading level, their blocks, the blocks' lines.

    A block is a run of lines without a blank line between them, but for blank lines within a fence. A heading that starts
    a block opens a section; one within a block starts a part of it, as only a block that is too large is opened.
    """
    root = Node("text", 0, len(text))
    stack, block, part, fence = [root], None, None, ""
    start = done = 0  # done: where the last line that is in the tree ended
    for line in text.split("\n"):
        end = start + len(line)
        if not fence and not line.strip():
            block = None
        else:
            heading = None if fence else _HEADING.match(line)
            if block is None:
                if done < start:
                    stack[-1].children.append(Node("blank", done, start))
                if heading:
                    while stack[-1].level >= len(heading[1]):
                        stack.pop()
                    section = Node("section", start, end, len(heading[1]))
                    stack[-1].children.append(section)
                    stack.append(section)
                block = part = Node("block", start, end)
                stack[-1].children.append(block)
            elif heading:
                if part is block:
                    block.children = [Node("part", block.start, done, children=block.children)]
                part = Node("part", start, end)
                block.children += [Node("part", done, start), part]
            else:
                part.children.append(Node("line", done, start))
            part.children.append(Node("line", start, end))
            part.end = block.end = done = end
            if fence:
                fence = "" if line.startswith(fence) else fence
            elif line.startswith(FENCES):
                fence = line[:3]
        start = end + 1
    if done < len(text):
        stack[-1].children.append(Node("blank", done, len(text)))
    for node in reversed(_below(root)):
        node.end = node.children[-1].end
    return root


def _below(root: Node) -> list[Node]:
    """The sections of a text, each after what it is in."""
    out = [x for x in root.children if x.kind == "section"]
    for node in out:
        out.extend(x for x in node.children if x.kind == "section")
    return out


def cut_line(text: str, start: int, end: int, room: Callable[[int], int]) -> list[tuple[int, int]]:
    """Pieces of a line within the room, cut after a sentence or at a space in their second half if there is one."""
    out = []
    while end - start > room(start):
        limit = room(start)
        part = text[start : start + limit]
        ends = [m.end() for m in _SENTENCE_END.finditer(part, limit // 2)]
        space = part.rfind(" ", limit // 2)
        stop = start + (ends[-1] if ends else space + 1 if space >= 0 else limit)
        out.append((start, stop))
        start = stop
    return [*out, (start, end)]


def cut_blank(text: str, start: int, end: int, room: Callable[[int], int]) -> list[tuple[int, int, str]]:
    """Pieces of blank lines within the room, cut between lines if a line fits, else within one ("space")."""
    out, kind = [], "blank"
    while end - start > room(start):
        stop = text.rfind("\n", start, start + room(start)) + 1 or start + room(start)
        out.append((start, stop, kind))
        kind = "blank" if "\n" in text[stop - 1 : stop + 1] else "space"
        start = stop
    return [*out, (start, end, kind)]


def pack(text: str, limit: int, overlap: int = 0) -> list[tuple[int, int, str]]:
    """Spans with the kind of node whose border starts them: siblings are merged while they fit, only oversized nodes are opened.

    The first span has room for the whole limit, the others for what the overlap leaves of it.
    """
    room = lambda start: limit if start == 0 else limit - overlap

    def of(node: Node) -> list[tuple[int, int, str]]:
        if node.end - node.start <= room(node.start):
            return [(node.start, node.end, node.kind)]
        if node.kind == "blank":
            return cut_blank(text, node.start, node.end, room)
        if not node.children:
            first, *rest = cut_line(text, node.start, node.end, room)
            return [(*first, node.kind), *((*x, "char") for x in rest)]
        out: list[tuple[int, int, str]] = []
        whole = False
        for child in node.children:
            if child.end == child.start:
                continue
            parts = of(child)
            between = not child.children and text[child.start] == "\n"
            if len(parts) == 1 and out and (whole or between) and parts[0][1] - out[-1][0] <= room(out[-1][0]):
                out[-1] = (out[-1][0], parts[0][1], out[-1][2])
            else:
                out.extend(parts)
                whole = len(parts) == 1
        return [(*out[0][:2], node.kind), *out[1:]]

    return of(parse(text))


def boundary(spans: list[tuple[int, int, str]]) -> str:
    """The finest border that starts a span: of a `block` or more, of a `line` in a block, or of a `char` in a line."""
    kinds = {kind for _, _, kind in spans[1:]}
    inside = kinds & {"line", "part", "char"}
    return "block" if not inside else "char" if kinds & {"char", "space"} else "line"


def pieces(text: str, limit: int, overlap: int) -> tuple[str, list[tuple[int, int, int, str]]]:
    """The finest border at which the limit cuts the text, and the pieces (start, end, overlap, cut), overlaps included.

    The text has LF line ends. The border is that of packing with the whole limit; an overlap leaves less, so that
    pieces may be cut finer.
    """
    overlap = max(0, min(overlap, limit - 1))
    plain = pack(text, limit)
    first, *rest = pack(text, limit, overlap) if overlap else plain
    out = [(first[0], first[1], 0, "start")]
    out += [(s - min(overlap, s), e, min(overlap, s), kind) for s, e, kind in rest]
    return boundary(plain), out


def limits(config: DataFrame, key: str, size: str, overlap: str, updated: str) -> DataFrame:
    """(limit_key, limit, overlap): each key's row with the latest update; of several, the one with the greatest size and overlap."""
    last = config.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("limit_key")).agg(F.max(F.struct(F.col(updated).alias("u"), F.col(size).cast("int").alias("s"), F.col(overlap).cast("int").alias("o"))).alias("m"))
    return last.select("limit_key", F.when(F.col("m.s") > 0, F.col("m.s")).otherwise(FALLBACK_LIMIT).alias("limit"), F.greatest(F.coalesce("m.o", F.lit(0)), F.lit(0)).alias("overlap"))


def split_oversized(rows: DataFrame, row_id: str, key: str, text: str, heading_path: str, config: DataFrame, *, config_key: str = "key", size: str = "max_chunk_size", overlap: str = "overlap_size", updated: str = "updated_at", default_limit: int = DEFAULT_LIMIT) -> DataFrame:
    """(row_id, piece, start, end, overlap, limit, text, heading_path, cut, boundary): texts over their key's limit as pieces within it.

    start and end are code points of the text; `text` has LF line ends, each of which counts as one character for the
    limit. A piece repeats the last `overlap` characters of what is before it, and without these repetitions the
    pieces give the text back exactly. cut names the border a piece starts at: section, block, blank (lines
    between blocks), part (a heading within a block), line, char, or space (within a blank line). boundary is the finest
    border that packing with the whole limit cuts at: `block` if all blocks fit the limit, else `line` if all lines do,
    else `char`.

    The limit is the key's latest one, FALLBACK_LIMIT (8192) if that is null or not positive, default_limit if the
    key has none. A null overlap is 0; one that is not below the limit is limit - 1, so that every piece has a character
    of its own. Texts within the limit, null and empty ones are not given. Repeated ids are rows of their own. No rows
    give no rows.

    Headings, blocks and lines form a tree; sibling subtrees are merged while they fit, and only oversized
    nodes are opened. Only oversized texts leave the JVM; rows are not shuffled unless the table of limits
    is too large to be broadcast by its own size.
    """
    known = limits(config, config_key, size, overlap, updated)
    read = rows.select(F.col(row_id).cast("long").alias("row_id"), F.col(key).alias("limit_key"), F.col(text).alias("text"), F.col(heading_path).alias("heading_path"))
    sized = read.join(known, "limit_key", "left").select("row_id", "text", "heading_path", F.coalesce("limit", F.lit(default_limit)).alias("limit"), F.coalesce("overlap", F.lit(0)).alias("overlap"))
    large = sized.where(F.length("text") > F.col("limit"))
    kinds = {"row_id": pa.int64(), "piece": pa.int32(), "start": pa.int32(), "end": pa.int32(), "overlap": pa.int32(), "limit": pa.int32(), "text": pa.string(), "heading_path": pa.string(), "cut": pa.string(), "boundary": pa.string()}

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            out: list[tuple] = []
            for i, t, h, limit, lap in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                plain, pairs = unix_lines(t)
                finest, parts = pieces(plain, limit, lap)
                at = lambda x: x + bisect.bisect_left(pairs, x)  # noqa: B023, E731
                out.extend((i, n, at(s), at(e), o, limit, plain[s:e], h, cut, finest) for n, (s, e, o, cut) in enumerate(parts))
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    return large.mapInArrow(split, "row_id long, piece int, start int, end int, overlap int, limit int, text string, heading_path string, cut string, boundary string")
