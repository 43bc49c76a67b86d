"""Both physical forms of ranking against brute force, with one value holding a third of all rows."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from starslice.operators import ranking as K


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(7)
    raw = [(g, i, 5.0 if rng.random() < 0.34 else float(rng.randint(-3, 40))) for g in ("a", "b") for i in range(300)] + [("a", 999, None)]
    return raw, spark.createDataFrame(raw, "g string, entity int, v double")


def brute_rank(raw, positive):
    out = {}
    for g, e, v in raw:
        ok = v is not None and (not positive or v > 0)
        out[(g, e)] = 1 + sum(1 for h, _, w in raw if h == g and w is not None and w > v) if ok else None
    return out


@pytest.mark.parametrize("bounded", [True, False])
@pytest.mark.parametrize("positive", [True, False])
def test_competition_rank(data, bounded, positive):
    raw, df = data
    got = {(r.g, r.entity): r["rank"] for r in K.competition_rank(df, ["g"], "v", positive, bounded).collect()}
    assert got == brute_rank(raw, positive)


@pytest.mark.parametrize("bounded", [True, False])
def test_ordinal_rank(data, bounded):
    raw, df = data
    got = {(r.g, r.entity): r["rank"] for r in K.ordinal_rank(df, ["g"], "v", "entity", bounded).collect()}
    for g in "ab":
        order = sorted((e for h, e, _ in raw if h == g), key=lambda e: next((-(v if v is not None else -1e9), e) for h, x, v in raw if h == g and x == e))
        assert [got[(g, e)] for e in order] == list(range(1, len(order) + 1))


@pytest.mark.parametrize("bounded", [True, False])
def test_quantile_breaks(data, bounded):
    raw, df = data
    got = {r.g: r.breaks for r in K.quantile_breaks(df, ["g"], "v", 5, bounded).collect()}
    for g in "ab":
        vals = sorted(v for h, _, v in raw if h == g and v is not None)
        assert got[g] == [vals[(i + 1) * len(vals) // 5] for i in range(4)]


def test_order_statistics_without_groups(data):
    raw, df = data
    vals = sorted(v for _, _, v in raw if v is not None)
    got = K.order_statistics(df, [], "v", F.array(F.floor(F.col("n_rows") / 2))).collect()
    assert [r.v for r in got] == [vals[len(vals) // 2]]


def test_argmax_prefers_lowest_entity(spark):
    df = spark.createDataFrame([("x", 4, 9.0), ("x", 2, 9.0), ("x", 1, 3.0), ("y", 5, None)], "g string, entity int, v double")
    assert rows(K.argmax(["g"], df, "v")) == [("x", 2, 9.0)]


def test_prefix_sum_forms_agree(data):
    _, df = data
    flagged = df.filter("v IS NOT NULL").withColumn("w", F.lit(2))
    a = sorted(rows(K.prefix_sum(flagged, ["g"], [F.col("v").asc(), F.col("entity").asc()], "w", "s", True)), key=repr)
    b = sorted(rows(K.prefix_sum(flagged, ["g"], [F.col("v").asc(), F.col("entity").asc()], "w", "s", False).select("g", "entity", "v", "w", "s")), key=repr)
    assert a == b
