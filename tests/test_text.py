from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions import vectors as V


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def test_token_estimate(spark):
    assert one(spark, T.estimate_tokens, "Hello 世界") == 4
    assert one(spark, T.estimate_tokens, None) == 0


def test_headings(spark):
    given = ["1. Introduction", "3.2 Experimental Setup", "Related Work", "mid results", "Our Results", "", None]
    got = [one(spark, T.section_type, g) for g in given]
    assert got == ["INTRODUCTION", "EXPERIMENTS", "RELATED_WORK", "RESULTS", None, None, None]


def test_first_section_looks_at_eight_lines(spark):
    assert one(spark, T.first_section, "\n" * 7 + "Abstract")["section_type"] == "ABSTRACT"
    assert one(spark, T.first_section, "x\n" * 8 + "Abstract") is None


def test_repeat_threshold(spark):
    assert [one(spark, T.repeat_threshold, n, "int") for n in (2, 10, 20)] == [3, 4, 7]


def test_query_terms(spark):
    assert one(spark, T.query_terms, "What is the learning rate?") == ["learning", "rate"]
    assert one(spark, T.query_terms, "如何") == ["如何"]
    assert one(spark, T.query_terms, "  ") is None


def test_route(spark):
    assert one(spark, T.route, "API rate limit?") == "SIMPLE"
    assert one(spark, T.route, "入职3年有几天年假") == "STANDARD"
    assert one(spark, T.route, "x" * 80) == "COMPLEX"
    assert one(spark, T.route, " ") == "STANDARD"


def test_citations(spark):
    assert one(spark, T.cited, "x (source: [ref2][ref1]) y [ref2]") == [2, 1]
    assert one(spark, T.without_citations, "x (source: [ref2][ref1]) y [ref2]") == "x y"
    assert one(spark, T.cited, "[ref99999999999]") == []


def test_faithfulness(spark):
    assert one(spark, T.faithfulness, "忠实性分数：8")["score"] == 0.8
    assert one(spark, T.faithfulness, "忠实性分数：8/10")["score"] == 81.0
    assert one(spark, lambda x: T.faithfulness(x, compat=False), "忠实性分数：8/10")["score"] == 0.8
    assert tuple(one(spark, T.faithfulness, "nothing")) == (0.5, True, "")


def test_strip_knows_wide_space(spark):
    assert one(spark, T.strip, "　 x  ") == "x  "


def test_page_numbers_and_running_heads(spark):
    assert [one(spark, T.is_page_number, x) for x in ("12", "p. 3", "3 / 10", "- 4 -", "12345", "Page 3")] == [True, True, True, True, False, False]
    assert one(spark, T.is_running_head, "Preprint. Under review.") and not one(spark, T.is_running_head, "We review")


def test_vector_codec_round_trip(spark):
    row = spark.createDataFrame([([0.5, -1.25],)], "v array<float>").select(V.from_text(V.to_literal(F.col("v"))).alias("a"), V.from_text(V.to_csv(F.col("v"))).alias("b")).first()
    assert row["a"] == row["b"] == [0.5, -1.25]
