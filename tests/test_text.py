"""Scalar rules on literal cases; the driver's tables hold no Hangul and no article headers."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as tx


def ask(spark, column, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("c"))).collect()]


def test_numbers_and_strategies(spark):
    assert ask(spark, tx.article_numbers, "제 10 조와 Article (11)") == [[10, 11]]
    got = ask(spark, tx.analysis, "제10조", "제10조와 제11조 비교", "표현의 자유", "hello", "제2장 제3항 ②")
    assert [r["search_strategy"] for r in got] == ["exact_article", "multi_article", "concept", "hybrid", "hybrid"]
    assert got[2]["concept_keywords"] == ["자유권", "기본권"]
    assert (got[4]["chapter_filters"], got[4]["paragraph_filters"]) == (["2"], ["3", "②"])
    assert ask(spark, tx.canonical, "평등권 은 는 무엇", "제 3 조") == ["평등권 는 무엇", "제3조"]
    assert ask(spark, lambda c: tx.concepts(c, fold=True), "… 인권 …") == [["인간의 존엄", "기본권"]]
    assert ask(spark, tx.keywords, "abc 가 나라 나라 x가") == [["x가", "나라"]]


def test_headers(spark):
    lines = ["제1조 (목적)", "제1조①", "제1조 ①", "Article 5", "Article 5 Title", "Article (5) Title", "Article 5 of the law", "12 제3조"]
    assert ask(spark, tx.header_number, *lines) == ["1", None, "1", "5", None, "5", None, "3"]
    assert ask(spark, lambda c: tx.header_number(c, True), "제1조①") == ["1"]
    assert ask(spark, tx.is_noise, "Page 3", "대한민국 헌법", "제1조 (목적)", "text") == [True, True, False, False]
    assert ask(spark, tx.structure_level, "제2장 국민", "제1조 장", "장") == ["장", None, None]
    assert ask(spark, tx.paragraph_key, "② text", "3. text", "text", "44. text") == ["②", "3", None, None]


def test_file_names(spark):
    codes = ["KR", "GH", "BR", "ZA", "US"]
    names = ["KR.pdf", "GH_1996.pdf", "constitution_BR.pdf", "ZA-constitution.pdf", "kr.pdf", "XX_1.pdf"]
    assert ask(spark, lambda c: tx.country_of_file(c, codes), *names) == ["KR", "GH", "BR", "ZA", None, None]
    assert ask(spark, tx.version_of_file, "KR_1987.pdf", "GH_v1996.pdf", "US_2023-12-01.pdf", "US_2023_12_01.pdf", "KR.pdf") == ["1987", "1996", "2023", "2023", None]


def test_identity_and_scores(spark):
    s = lambda x: F.lit(x).cast("string")
    made = spark.range(1).select(
        tx.article_id(s("KR"), s("1987"), s("10"), s(None), s(None), s(None)).alias("a"), tx.article_id(s("KR"), s("1987"), s("10"), s("①"), s(None), s(None)).alias("b"),
        tx.article_id(s("KR"), s(None), s(None), s(None), s("D"), s("4")).alias("c"), tx.article_id(s("KR"), s("1"), s(None), s(None), s(None), s(None)).alias("d"),
        tx.sigmoid(F.lit(0)).alias("e"), tx.sigmoid(F.lit(-800)).alias("f"), tx.pixels(F.lit(595), 150).alias("g"), tx.clamp01(F.lit("bad")).alias("h"),
    ).first()
    assert tuple(made) == ("KR:1987:10", "KR:1987:10:①", "KR:latest:D:4", "KR:1:unknown", 0.5, 0.5, 1239, 0.0)
    assert ask(spark, tx.genre, "A Theorem with proof", "a scene, an example", "nothing", None) == ["technical", "fiction", "general", "general"]
    assert ask(spark, tx.collapse, "  a \n b\t", None) == ["a b", ""]


@pytest.mark.parametrize("limit,want", [(3, "abc..."), (6, "abcdef")])
def test_truncate(spark, limit, want):
    assert ask(spark, lambda c: tx.truncate(c, limit, "..."), " abcdef ") == [want]
