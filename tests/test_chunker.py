import pytest
from pyspark.sql import functions as F

from docpool.operators import chunker as ch


def cut(spark, content, size=1500):
    rows = ch.chunk_documents(spark.createDataFrame([(1, content)], "id long, content string"), "content", size).orderBy("chunk_index").collect()
    return [(r.heading_path, r.text) for r in rows]


def test_two_titles(spark):
    assert cut(spark, "# Tea\n\nleaves\n\n# Milk\n\nfrom cows\n") == [("Tea", "# Tea\n\nleaves"), ("Milk", "# Milk\n\nfrom cows")]


def test_six_levels(spark):
    found = cut(spark, "\n".join(f"{'#' * i} {c}\nabout {c}" for i, c in enumerate(["oak", "elm", "fir", "ash", "yew", "box"], 1)))
    assert len(found) == 6
    assert found[-1][0] == "oak > elm > fir > ash > yew > box"


def test_paths_close_deeper_levels(spark):
    assert [p for p, _ in cut(spark, "# A\nx\n## A1\nx\n# B\nx\n### B3\nx\n## B2\nx")] == ["A", "A > A1", "B", "B > B3", "B > B2"]


@pytest.mark.parametrize(("line", "path"), [("# H", "H"), ("###### H6", "H6"), ("####### H7", ""), ("#H", ""), ("#\tH", "H"), ("plain", ""), ("#", "")])
def test_headings(spark, line, path):
    assert cut(spark, f"{line}\nbody") == [(path, f"{line}\nbody")]


def test_text_before_the_first_title_and_fences(spark):
    assert cut(spark, "intro\n```\n# not code\n```") == [("", "intro\n```"), ("not code", "# not code\n```")]


def test_empty_title_is_kept_in_the_path(spark):
    assert [p for p, _ in cut(spark, "#\n## B\nx")] == ["", " > B"]


def test_no_sections(spark):
    assert cut(spark, "") == [("", "")]
    assert cut(spark, "\n\n") == [("", "\n\n")]
    assert cut(spark, None) == []


def test_even_parts(spark):
    found = cut(spark, "# H\n" + "q" * 58, 13)
    assert all(len(t) <= 13 and p == "H" for p, t in found)
    assert "".join(t for _, t in found) == "# H\n" + "q" * 58
    assert [len(t) for _, t in cut(spark, "あ" * 21, 10)] == [7, 7, 7]
    assert [len(t) for _, t in cut(spark, "b" * 9000, 0)] == [4500, 4500]


def test_texts_to_embed(spark):
    long = "A long sentence of prose that has fifty characters or more."
    docs = spark.createDataFrame([(1, f"# A\n{long}\n## B\n## C\nshort")], "id long, content string")
    found = [r.embed_text for r in ch.chunk_documents(docs, "content").orderBy("chunk_index").collect()]
    assert found == [f"A\n\n{long}", f"A > B\n\n{long}", f"A > C\n\n{long}"]
    docs = spark.createDataFrame([(1, "# Harbour\nships at the quay\n"), (2, "only prose"), (3, "#tag")], "id long, content string")
    assert [r.embed_text for r in ch.chunk_documents(docs, "content").orderBy("id").collect()] == ["Harbour\n\nships at the quay", "only prose", "#tag"]


def test_oversized_line(spark):
    rows = spark.createDataFrame([("x" * 65536,), ("x" * 65535 + "\ny",), ("",)], "c string").select(ch.oversized_line(F.col("c")).alias("o")).collect()
    assert [r.o for r in rows] == [True, False, False]
