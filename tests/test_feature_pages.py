"""Landed pages as a data source: partitions, types, pushed filters, errors."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from starslice.sources import feature_pages as P

SCHEMA = "k long, name string, v double, ok boolean"


@pytest.fixture
def folder(spark, tmp_path):
    data = [(k, None if k % 5 == 0 else f'n"{k}', k / 4, k % 2 == 0) for k in range(23)]
    df = spark.createDataFrame(data, SCHEMA)
    P.write_pages(df, str(tmp_path / "p"), "k", 10)
    return str(tmp_path / "p"), data


def test_one_partition_a_page(spark, folder):
    path, data = folder
    got = P.feature_pages(spark, path, SCHEMA)
    assert sorted(rows(got)) == data and got.rdd.getNumPartitions() == 3
    assert sorted(rows(P.feature_pages(spark, path, "other string, k int").filter("k < 2"))) == [(None, 0), (None, 1)]
    assert P.unfinished(spark, path).count() == 0


@pytest.mark.parametrize("text", ["k >= 20 AND ok", "name = 'n\"7'", "k IN (3, 4, 99)", "v < 1 AND name IS NOT NULL", "v <= 0.5 OR k > 21", "name LIKE 'n%2'", "name IS NULL", "NOT ok AND k > 18", "k > 4 AND k < 6", "k = 99"])
def test_filters(spark, folder, text):
    path, data = folder
    want = rows(spark.createDataFrame(data, SCHEMA).filter(text))
    assert sorted(rows(P.feature_pages(spark, path, SCHEMA).filter(text)), key=str) == sorted(want, key=str)


def test_filters_are_pushed(spark, folder):
    """What the pages apply is gone from Spark's own filter; what they can't is left to it."""
    df = P.feature_pages(spark, folder[0], SCHEMA).filter("k >= 20 AND name LIKE '%2'")
    execution = df._jdf.queryExecution()
    assert ">=" in execution.analyzed().toString() and ">=" not in execution.executedPlan().toString()
    assert "Filter EndsWith(name" in execution.executedPlan().toString()


def test_errors(spark, tmp_path, folder):
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "p.json").write_text(json.dumps({"error": {"code": 500}}))
    with pytest.raises(Exception, match="the service answered"):
        P.feature_pages(spark, str(tmp_path / "bad"), SCHEMA).collect()
    (tmp_path / "typed").mkdir()
    (tmp_path / "typed" / "p.json").write_text(json.dumps({"features": [{"attributes": {"k": "x"}}]}))
    with pytest.raises(Exception):
        P.feature_pages(spark, str(tmp_path / "typed"), "k long").collect()
    (tmp_path / "empty").mkdir()
    assert P.feature_pages(spark, str(tmp_path / "empty"), SCHEMA).count() == 0
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "p0.json").write_text(json.dumps({"features": [], "exceededTransferLimit": True}))
    assert rows(P.unfinished(spark, str(tmp_path / "cut"))) == [(0, 1)]


def test_scan_is_reused_by_aggregates(spark, folder):
    path, data = folder
    total = P.feature_pages(spark, path, SCHEMA).groupBy("ok").agg(F.sum("k").alias("n"))
    assert dict(rows(total)) == {True: sum(r[0] for r in data if r[3]), False: sum(r[0] for r in data if not r[3])}


def test_many_pages_share_partitions(spark, tmp_path):
    data = [(k, f"n{k}", k / 4, k % 2 == 0) for k in range(300)]
    P.write_pages(spark.createDataFrame(data, SCHEMA), str(tmp_path / "p"), "k", 2)
    got = P.feature_pages(spark, str(tmp_path / "p"), SCHEMA)
    assert sorted(rows(got)) == data and P.TASKS <= got.rdd.getNumPartitions() < 150


def test_partitions_are_bounded_in_files_and_bytes():
    many = P.dealt([(str(k), 1) for k in range(100_000)])
    assert max(map(len, many)) == P.FILES and sum(many, []) == [str(k) for k in range(100_000)]
    big = P.dealt([("a", 2 * P.BYTES), *[(str(k), P.BYTES // 3) for k in range(6400)]])
    assert big[0] == ["a"] and max(map(len, big)) == 3
    assert P.dealt([]) == []
