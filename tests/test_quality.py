"""Defects must be found, pinned defects must be accepted, and stale pins must fail."""

import pytest
from conftest import one, rows
from pyspark.sql import functions as F

from starslice.operators import quality as Q


def test_reconcile_finds_both_sides(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("z", None)], "k string, found int")
    b = spark.createDataFrame([("x", 1), ("y", 3), ("w", 4), ("z", None)], "k string, printed int")
    assert sorted(rows(Q.reconcile(a, b, ["k"], "found", "printed"))) == [("w", None, 4), ("y", 2, 3)]


def test_first_valid(spark):
    cand = spark.createDataFrame([("p", 0), ("p", 1), ("q", 0), ("r", 0)], "portion string, idx int")
    bad = spark.createDataFrame([("p", 0), ("q", 0), ("p", 0)], "portion string, idx int")
    got = {r.portion: (r.chosen, r.status) for r in Q.first_valid(cand, bad, ["portion"], "idx").collect()}
    assert got == {"p": (1, "warn"), "q": (None, "error"), "r": (0, "ok")}


PIN = "fips string, class string, printed int, fixed int"


def test_cell_pins(spark):
    # a hen cell printed as 1 although row and column totals say 0
    cells = spark.createDataFrame([("29015", "bearded_hen", 1), ("29015", "gobbler", 28), ("29017", "bearded_hen", 1)], "fips string, class string, n int")
    pins = spark.createDataFrame([("29015", "bearded_hen", 1, 0)], PIN)
    fixed = Q.apply_cell_pins(cells, pins, ["fips", "class"], "n")
    assert sorted(rows(fixed)) == [("29015", "bearded_hen", 0, True), ("29015", "gobbler", 28, False), ("29017", "bearded_hen", 1, False)]
    assert Q.stale_pins(cells, pins, ["fips", "class"], "n").count() == 0
    corrected = cells.withColumn("n", F.when(F.col("fips") == "29015", 0).otherwise(F.col("n")))
    assert Q.stale_pins(corrected, pins, ["fips", "class"], "n").count() == 1


def test_null_outs(spark):
    cells = spark.createDataFrame([(2018, "29101", 0.3), (2018, "29167", 9.1), (2019, "29101", 3.5)], "y int, fips string, d double")
    pins = spark.createDataFrame([(2018, "29101", 0.3, None), (2018, "29167", 9.1, None)], "y int, fips string, printed double, fixed double")
    assert sorted(rows(Q.apply_cell_pins(cells, pins, ["y", "fips"], "d").select("y", "fips", "d")), key=repr) == [
        (2018, "29101", None), (2018, "29167", None), (2019, "29101", 3.5)]


def test_column_swap(spark):
    cells = spark.createDataFrame([(2021, "spring", "gobbler", 312), (2021, "spring", "bearded_hen", 70), (2021, "spring", "juvenile_gobbler", 5), (2020, "spring", "bearded_hen", 1)],
                                  "y int, portion string, class string, n int")
    pins = spark.createDataFrame([(2021, "spring", "bearded_hen", "juvenile_gobbler")], "y int, portion string, class_a string, class_b string")
    got = {(r.y, r["class"]): r.n for r in Q.swap_classes(cells, pins, ["y", "portion"]).collect()}
    assert got == {(2021, "gobbler"): 312, (2021, "bearded_hen"): 5, (2021, "juvenile_gobbler"): 70, (2020, "bearded_hen"): 1}


def test_two_sided_tolerance(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 9.0), ("c", 9.0)], "k string, off double")
    pins = spark.createDataFrame([("b",), ("a",), ("gone",)], "k string")
    got = sorted(rows(Q.two_sided(df, F.col("off") > 5, pins, ["k"]).select("k", "problem")))
    assert got == [("a", "stale"), ("c", "unpinned"), ("gone", "stale")]


def test_derivation(spark):
    cells = spark.createDataFrame([("all", "k1", "doe", 10), ("youth", "k1", "doe", 3), ("nov", "k1", "doe", 4), ("all", "k2", "doe", 5), ("youth", "k2", "doe", 5), ("all", "k3", "doe", 1), ("nov", "k3", "doe", 2)],
                                  "portion string, key string, class string, n int")
    got = Q.derive_by_difference(cells, "all", ["youth", "nov"], ["key", "class"], "portion", "n")
    assert sorted(rows(got)) == [("k1", "doe", 3, True, False), ("k3", "doe", -1, True, True)]
    printed = spark.createDataFrame([("doe", 2)], "class string, printed int")
    errors = Q.derivation_errors(cells, got, printed, "all", ["youth", "nov", "late"], "portion", "class", "n")
    assert sorted(r.error for r in errors.collect()) == ["missing late", "negative doe"]


def test_dependency_and_duplicates(spark):
    df = spark.createDataFrame([("p", "fall", 1), ("p", "fall", 1), ("q", "fall", 1), ("q", "spring", 1)], "portion string, season string, n int")
    assert [r.portion for r in Q.dependency_violations(df, "portion", ["season"]).collect()] == ["q"]
    assert sorted(rows(Q.duplicate_keys(df, ["portion", "season"]))) == [("p", "fall", 2)]
    assert sorted(rows(Q.same_vocabulary(df, ["p", "r"], "portion"))) == [("q", "unexpected"), ("r", "missing")]


def test_latest_wins_and_revisions(spark):
    df = spark.createDataFrame([(2023, "any", 2023, 100, 10), (2023, "any", 2024, 110, 10), (2022, "any", 2023, 5, 1)], "y int, t string, report int, issued int, filled int")
    assert sorted(rows(Q.latest_wins(df, ["y", "t"], "report", ["issued", "filled"]))) == [(2022, "any", 5, 1, 2023), (2023, "any", 110, 10, 2024)]
    assert rows(Q.revisions(df, ["y", "t"], "report", ["issued", "filled"])) == [(2023, "any", 2024, 110, 10, 2023, 100, 10)]


def test_merge_needs_an_alias(spark):
    df = spark.createDataFrame([("a", True, 1), ("a", False, 2), ("b", False, 3), ("b", False, 4)], "k string, alias boolean, n int")
    got = {r.k: (r.n_rows, r.error) for r in Q.merge_duplicates(df.withColumnRenamed("n", "v"), ["k"], "alias", ["v"]).withColumnRenamed("n", "n_rows").collect()}
    assert got == {"a": (2, False), "b": (2, True)}


def test_remainder_bucket(spark):
    df = spark.createDataFrame([("e", "male", 1), ("e", "female", 0), ("e", None, 1)], "entity string, sex string, positive int")
    r = Q.remainder_bucket(df, "entity", "sex", ["male", "female"], "positive").collect()[0]
    assert (r.samples, r.positives, r.splits["unknown"]["samples"], r.splits["unknown"]["positives"], r.error) == (3, 2, 1, 1, False)


def test_match_quality(spark):
    rep = spark.createDataFrame([(1, 2020, 100), (2, 2020, 102), (3, 2020, 150), (4, 2020, 7)], "e int, y int, reported int")
    own = spark.createDataFrame([(1, 2020, 100), (2, 2020, 100), (3, 2020, 100)], "e int, y int, own int")
    assert rows(Q.match_quality(rep, own, ["e", "y"], "y")) == [(2020, 4, 1, 2, 1, 1, True)]


def test_group_sizes(spark):
    found = spark.createDataFrame([("n",), ("n",), ("s",)], "region string")
    want = spark.createDataFrame([("n", 2), ("s", 2), ("w", 1)], "region string, expected long")
    assert sorted(rows(Q.group_sizes(found, "region", want).select("region", "expected", "found"))) == [("s", 2, 1), ("w", 1, 0)]
