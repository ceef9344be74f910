import random
import re
from datetime import datetime

import pytest

from docpool.llm import split as sp

ROW = "id long, key string, text string, heading_path string, piece string, boundary int"
CONFIG = "key string, max_chunk_size int, overlap_size int, updated_at timestamp"


def blocks(text):
    """Blocks by the rule, each as its list of lines."""
    out, block, fence = [], [], ""
    for line in re.split(r"\r\n|\r|\n", text):
        if not fence and not line.strip():
            out, block = out + [block], []
            continue
        block = block + [line]
        if fence and line.startswith(fence):
            fence = ""
        elif not fence and line[:3] in ("```", "~~~"):
            fence = line[:3]
    return [b for b in out + [block] if b]


def random_text(rng):
    lines = []
    for _ in range(rng.randrange(3, 40)):
        lines.append(rng.choice(["", "", " " * rng.randrange(1, 160), "# Title", "### Deep", "```", "~~~", "- item " * rng.randrange(1, 5), "word " * rng.randrange(1, 25), "x" * rng.randrange(1, 120), "文。" * rng.randrange(1, 30)]))
    return rng.choice(["\n", "\r\n", "\r"]).join(lines)


@pytest.mark.parametrize("seed", range(60))
def test_pieces_of_random_texts(seed):
    rng = random.Random(seed)
    raw, limit = random_text(rng), rng.randrange(20, 150)
    text, overlap = sp.unix_lines(raw)[0], rng.choice([0, rng.randrange(0, limit), limit + 5])
    finest, found = sp.pieces(text, limit, overlap)
    assert all(0 < e - s <= limit for s, e, _, _ in found)
    assert found[0][0] == 0 and found[-1][1] == len(text)
    for (_, end, _, _), (start, _, lap, _) in zip(found, found[1:]):
        assert start + lap == end
        assert lap == min(overlap, limit - 1, end)
    assert "".join(text[s + lap : e] for s, e, lap, _ in found) == text
    size = [len("\n".join(b)) for b in blocks(text)]
    line = [len(x) for x in re.split(r"\r\n|\r|\n", text)]
    assert finest == ("block" if max(size, default=0) <= limit else "line" if max(line) <= limit else "char")
    if not overlap:  # the pieces' own cuts say the same
        inside = {"block": {"section", "block", "blank", "start", "space"}, "line": {"section", "block", "blank", "start", "part", "line"}}
        assert {cut for *_, cut in found} <= inside.get(finest, {cut for *_, cut in found})


def test_cuts_between_sections_first():
    text = "# A\n\n" + "a" * 30 + "\n\n# B\n\n" + "b" * 30 + "\n"
    assert [text[s:e] for s, e, _, _ in sp.pieces(text, 45, 0)[1]] == ["# A\n\n" + "a" * 30 + "\n\n", "# B\n\n" + "b" * 30 + "\n"]
    assert [text[s:e] for s, e, _, _ in sp.pieces("a" * 1400 + "\n\n" + "b" * 1000, 1500, 200)[1] if e] and [p[:2] for p in sp.pieces("a" * 1400 + "\n\n" + "b" * 1000, 1500, 200)[1]] == [(0, 1402), (1202, 2402)]
    assert [p[3] for p in sp.pieces("a" * 50 + "\n# H\n" + "b" * 50, 60, 0)[1]] == ["start", "part"]
    assert [p[:2] for p in sp.pieces("a" * 60 + "\n\n" + "b" * 60, 60, 0)[1]] == [(0, 60), (60, 62), (62, 122)]
    assert sp.pieces("One. Two three. Four five six seven.", 20, 0)[1][0][1] == len("One. Two three. ")


def test_offsets_are_those_of_the_text_with_its_own_line_ends(spark):
    text = "\r\n".join(["# T", "", *["word " * 20] * 8, "", "x\ry"]) + "\r\n"
    found = run(spark, [(1, "k", text, "")], [("k", 150, 0, datetime(2025, 1, 1))])
    assert len(found) > 3 and all(text[r.start : r.end].replace("\r\n", "\n").replace("\r", "\n") == r.text and len(r.text) <= 150 for r in found)
    assert "".join(text[r.start : r.end] for r in found) == text


def run(spark, rows, config):
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], ROW)
    return sp.split_oversized(df, "id", "key", "text", "heading_path", spark.createDataFrame(config, CONFIG)).orderBy("row_id", "piece").collect()


def test_limits(spark):
    t = datetime(2025, 1, 1), datetime(2025, 2, 1)
    config = [("a", 10, 0, t[0]), ("a", 20, 2, t[1]), ("a", 20, 2, t[1]), ("n", None, None, t[1]), ("z", 0, 5, t[1]), ("u", 5, 1, None), (None, 1, 1, t[1])]
    rows = [(1, "a", "w" * 21, "H > I"), (2, "a", "w" * 20, ""), (3, "n", "w" * 8192, ""), (4, "n", "w" * 8193, ""), (5, "z", "w" * 8193, ""), (6, "u", "w" * 6, None), (7, "none", "w" * 1500, ""), (8, None, "w" * 1501, ""), (9, "a", None, ""), (10, "a", "", "")]
    found = run(spark, rows, config)
    assert {r.row_id for r in found} == {1, 4, 5, 6, 8}
    first = [r for r in found if r.row_id == 1]
    assert [(r.start, r.end, r.overlap, r.text, r.heading_path, r.boundary) for r in first] == [(0, 20, 0, "w" * 20, "H > I", "char"), (18, 21, 2, "w" * 3, "H > I", "char")]
    assert {r.row_id: r.limit for r in found} == {1: 20, 4: 8192, 5: 8192, 6: 5, 8: 1500}


def test_repeats_long_none(spark):
    assert run(spark, [], []) == []
    rows = [(1, "a", "word " * 100_000, "")] * 2
    found = run(spark, rows, [])
    assert len(found) % 2 == 0 and all(len(r.text) <= 1500 for r in found)
