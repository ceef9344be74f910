import pytest
from pyspark.sql import functions as F

from docpool.functions import text as tx


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("given", "wanted"), [("hello", "hello"), ("﻿hello", "hello"), ("a\r\nb", "a\nb"), ("a\rb", "a\nb"), ("﻿a\r\nb\rc\n", "a\nb\nc\n"), ("﻿﻿x", "﻿x"), ("", ""), (None, None)])
def test_normalise_content(spark, given, wanted):
    assert one(spark, tx.normalise_content(F.lit(given).cast("string"))) == wanted


def test_content_hash(spark):
    assert one(spark, tx.content_hash(F.lit("abc"))) == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


@pytest.mark.parametrize(("given", "wanted"), [("ＱＸ-７７", "qx-77"), ("ΑΣ", "ασ"), ("İ", "i"), ("ß", "ß"), ("ｶﾞ", "ガ"), ("ABC", "abc"), ("", "")])
def test_normalised(given, wanted):
    assert tx.normalised(given) == wanted


def test_norm_text_keeps_null(spark):
    rows = spark.createDataFrame([("Ａ",), (None,)], "t string").select(tx.norm_text("t").alias("n")).collect()
    assert [r.n for r in rows] == ["a", None]


def test_tokens(spark):
    wanted = ["qx-77", "f", "ü", "r", "日本語", "a_1", "42", "42"]
    assert tx.tokenise("QX-77 für 日本語 a_1 42 42") == wanted
    assert one(spark, tx.tokens(F.lit("qx-77 für 日本語 a_1 42 42"))) == wanted
    assert tx.tokenise("!!! ...") == []
    assert tx.id_tokens("see QX-77 and qx-77, x-") == ["qx-77", "qx-77"]


@pytest.mark.parametrize(("body", "part", "n"), [("aaaa", "aa", 2), ("abc", "x", 0), ("abc", "", 0), (None, "a", 0), ("a.b.c", ".", 2)])
def test_substring_count(spark, body, part, n):
    assert one(spark, tx.substring_count(F.lit(body).cast("string"), F.lit(part))) == n


def test_trim_and_first_tokens(spark):
    assert one(spark, tx.trim_space(F.lit(" \t　x y \n"))) == "x y"
    assert one(spark, tx.first_tokens(F.lit("a  b　c"), 3)) == "a  b　c"
    assert one(spark, tx.first_tokens(F.lit("a  b　c d"), 3)) == "a b c"
