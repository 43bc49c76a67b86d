"""Scalar text and label expressions against literal cases."""

import pytest
from conftest import one
from pyspark.sql import functions as F

from starslice.functions import labels as L
from starslice.functions import text as X


def ev(spark, fn, value):
    return one(spark.createDataFrame([(value,)], "v string").select(fn(F.col("v"))))


@pytest.mark.parametrize("raw, want", [
    ("1,231", 1231), ("1231", 1231), ("", 0), ("-", 0), ("—", 0), (" 77", 77), ("abc", None), ("1.5", None), ("-3", None),
])
def test_clean_int(spark, raw, want):
    assert ev(spark, X.clean_int, raw) == want


@pytest.mark.parametrize("raw, want", [
    ("Saint Louis City (City)", "saint louis city"), ("McDonald County", "mcdonald"), ("Cedar<", "cedar"),
    ("St.  Clair", "st clair"), ("  De Kalb ", "de kalb"), ("County", "county"),
])
def test_normalize_name(spark, raw, want):
    assert ev(spark, X.normalize_name, raw) == want


@pytest.mark.parametrize("raw, want", [("Total", True), ("Totals", True), ("Grand Totals:", True), ("grand total", True), ("Adair", False)])
def test_total_label(spark, raw, want):
    assert ev(spark, X.is_total_label, raw) is want


@pytest.mark.parametrize("raw, want", [
    ("Permittee Firearms Any-Deer", "firearms_any_deer"), ("Nonresident Archery", "non_resident_archery"),
    ("Non-Resident Firearms", "non_resident_firearms"),
])
def test_slug(spark, raw, want):
    assert ev(spark, X.slug, raw) == want


def test_names_and_routes(spark):
    assert ev(spark, X.feature_name, "The  Lake Of The Ozarks") == "The Lake of the Ozarks"
    assert ev(spark, X.route_name, "I- 70  Business") == "I-70 Business"
    assert ev(spark, X.inner_text, "<b>A &amp;lt; B</b>\n <i>c</i>") == "A &lt; B c"


@pytest.mark.parametrize("n, want", [(1, "1st"), (2, "2nd"), (3, "3rd"), (4, "4th"), (11, "11th"), (12, "12th"), (113, "113th"), (21, "21st")])
def test_ordinal(spark, n, want):
    assert one(spark.range(1).select(L.ordinal(F.lit(n)))) == want


def test_metric_formats(spark):
    got = spark.range(1).select(
        L.metric(F.lit(12345.6), "int"), L.metric(F.lit(0.1234), "pct"), L.metric(F.lit(0.05), "signed_pct"), L.metric(F.lit(-1.5), "z"),
        L.metric(F.lit(None).cast("double"), "dec2"), L.season_label(F.lit(1999)), L.season_label(F.lit(2003), False), L.short_year(F.lit(2015), True),
    ).collect()[0]
    assert tuple(got) == ("12,346", "12.3%", "+5.0%", "-1.50σ", "–", "1999-00", "2003", "'15")
