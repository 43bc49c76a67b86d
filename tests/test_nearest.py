"""Nearest neighbours of every entity against all pairs: clusters, equal places, high latitudes, few rows."""

import math

import pytest
from conftest import rows

from starslice.operators.nearest import nearest_all

D = "entity bigint, lon double, lat double"


def brute(data, k):
    out = []
    for e, x, y in data:
        c = math.cos(math.radians(y))
        best = sorted((((x2 - x) * c) ** 2 + (y2 - y) ** 2, f) for f, x2, y2 in data if f != e)[:k]
        out += [(e, f, p + 1) for p, (_, f) in enumerate(best)]
    return sorted(out)


def test_clusters_and_equal_places(spark):
    data = [(i, i * 7919 % 1009 / 11.3 - 90, i * 3571 % 1013 / 14.7 - 34) for i in range(200)]
    data += [(1000 + i, -90.1 + i * 37 % 101 / 1e5, 38.2 + i * 53 % 103 / 1e5) for i in range(150)]  # a dense town
    data += [(2000 + i, 12.5, 41.25) for i in range(60)]  # one place
    data += [(3000, 179.0, 89.0), (3001, -179.0, 89.5), (3002, 10.0, -88.0)]
    got = nearest_all(spark.createDataFrame(data, D), 5, 8).select("entity", "neighbor", "pos")
    assert sorted(rows(got)) == brute(data, 5)


@pytest.mark.parametrize("data", [[], [(1, 0.0, 0.0)], [(1, 0.0, 0.0), (2, 0.0, 0.0), (3, -1.0, 5.0)]])
def test_few_rows(spark, data):
    missing = [(8, None, 1.0), (None, 1.0, 1.0), (9, float("nan"), 0.0)]
    got = nearest_all(spark.createDataFrame(data + missing, D), 5).select("entity", "neighbor", "pos")
    assert sorted(rows(got)) == brute(data, 5)
