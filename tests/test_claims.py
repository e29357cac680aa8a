import pytest
from pyspark.sql import functions as F

from quillstone.functions import claims as C
from quillstone.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [(" one \r\n\ttwo ", "one two"), ("‘k’ ‒ oﬃce so\u00adft z\u200bero\u00a0w", "'k' - office soft zero w"), ("①½", "11⁄2"), ("3,141", "3,141"), (None, None), ("p\x1dq", "p q")])
def test_normalized(spark, raw, want):
    assert one(spark, raw, T.normalized) == want


def test_match_form_folds_case(spark):
    assert one(spark, "Größe  M", T.match_form) == "grösse m"
    assert one(spark, "UPPER  Case", T.match_form) == "upper case"


def test_token_estimate(spark):
    assert [one(spark, "y" * n, T.token_estimate) for n in (0, 3, 4, 31, 32)] == [1, 1, 1, 7, 8]


@pytest.mark.parametrize(("value", "want"), [("5,250.5", 5250.5), ("(7)", -7.0), ("₹ 3,000", 3000.0), (" 12.5 % ", 12.5), ("none", None), (None, None), ("", None), ("2_500", 2500.0), ("7f", None), ("₹(8)", None), ("-2e2", -200.0), ("+.5", 0.5)])
def test_number_of(spark, value, want):
    assert one(spark, value, C.number_of) == want


@pytest.mark.parametrize(("value", "want"), [("season of 2007", 2007), ("fy 09", 2009), ("FY31 and 2012", 2012), ("then", None), (None, None), ("HY2FY10", None), ("1887", None), ("2015/16", 2015)])
def test_year_of(spark, value, want):
    assert one(spark, value, C.year_of) == want


@pytest.mark.parametrize(("value", "want"), [("on Oct. 9 2007", True), ("the 22nd of", False), ("22nd october, 1998", True), ("October 2007", False), ("2007", False), (None, False)])
def test_names_day(spark, value, want):
    assert one(spark, value, C.names_day) is want


@pytest.mark.parametrize(("name", "want"), [("Dr. Ada B. Quill", "ada b quill"), ("Harbour Mills Pvt Ltd", "harbour mills"), ("The Co", ""), ("北港", ""), (None, "")])
def test_entity_key(spark, name, want):
    assert one(spark, name, C.entity_key) == want


@pytest.mark.parametrize(("a", "b", "want"), [("Oats", "oats", 1.0), ("Total non-food stock", "food of the year", 0.0), ("mill number", "mill office wheel", 0.0), ("by the", "by the", 0.0), ("rye barn stock", "barn stock", 2 / 3), ("rye barn stock", "oats barn stock east", 2 / 5)])
def test_token_overlap(spark, a, b, want):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(C.token_overlap(C.metric_tokens(F.col("a")), C.metric_tokens(F.col("b"))).alias("x")).first()
    assert row["x"] == pytest.approx(want)


def test_percentage(spark):
    rows = spark.createDataFrame([("Per cent", "x"), (None, "milling yield"), ("kg", "yielding")], "u string, m string")
    assert [r[0] for r in rows.select(C.is_percentage(F.col("u"), F.col("m"))).collect()] == [True, True, False]


def test_like_keeps_wildcards_and_ascii_case(spark):
    rows = spark.createDataFrame([("Mole É",), ("mole é",), ("m_l\\k",)], "v string")
    like = lambda n: [r[0] for r in rows.select(T.like_anywhere(F.col("v"), n)).collect()]
    assert like("MOLE") == [True, True, False]
    assert like("É") == [True, False, False]
    assert like("m%e") == [True, True, False]
    assert like("l\\") == [False, False, True]
