"""Slice semantics, additivity, density, series and metrics on the small scale factor."""

import math

import pytest
from conftest import one, rows
from pyspark.sql import functions as F

from starslice.operators import aggregates as A
from starslice.operators import series as S
from starslice.plans import metrics as M
from starslice.plans import reports as R
from starslice.plans.spec import SliceSpec
from starslice.sources.star import Star

O = SliceSpec(species="O")  # noqa: E741


def test_subtotals_are_excluded_unless_named(star):
    base = one(A.total(O.apply(star.fact)))
    grand = one(A.total(O.patch(portions=("fall_total", "spring_total")).apply(star.fact)))
    assert base == grand > 0
    assert one(A.total(O.patch(portions=("no_such",)).apply(star.fact))) == 0


def test_region_needs_a_dimension(star):
    with pytest.raises(ValueError):
        O.patch(region="ASIA").apply(star.fact)


def test_grid_is_dense(star):
    df = star.measures(O, {"v": O.patch(classes=("none",))})
    assert df.count() == 25 * 7 and df.agg(F.sum("v")).collect()[0][0] == 0


def test_partial_years(star):
    assert [r[0] for r in star.partial_years().collect()] == [2001]
    spring = Star(star.fact.filter("season = 'spring'"), star.dim)
    assert spring.partial_years().count() == 0  # no autumn anywhere: nothing is partial


def test_comparable_totals_respect_a_chosen_season(star):
    fall = dict(rows(A.comparable_totals(star, O.patch(season="fall"))))
    both = dict(rows(A.comparable_totals(star, O)))
    springs = dict(rows(A.sum_by(O.patch(season="spring").apply(star.fact), "season_year")))
    assert both == springs and 2001 not in fall


def test_years_in_range_falls_back_to_the_last(star):
    assert [r[0] for r in A.periods_in_range(star, O.patch(year_from=2050)).collect()] == [2001]


def test_every_registered_metric(star):
    ids = [m for m in M.METRICS]
    df = M.metric_frame(star, O, ids)
    assert df.count() == 175
    first = df.filter("season_year = 1995").agg(*[F.count(m).alias(m) for m in ids]).collect()[0]
    assert first["change_yoy"] == 0 and first["vs_5yr"] == 0 and first["trips_per_kill"] == 0 and first["count"] == 25
    bad = df.select([F.count_if(F.isnan(m)).alias(m) for m in ids]).collect()[0]
    assert not any(bad)


def test_two_attribute_denominators_differ(star):
    portion = M.metric_frame(star, O, ["public_land_share"]).filter("entity = 3 AND season_year = 2000").collect()[0]
    exact = M.attribute_share_exact(star, O).filter("entity = 3").count()
    assert portion.public_land_share == 0.0 and exact == 0  # zero by portion, undefined by cell


def test_metric_region_scope(star):
    asia = M.metric_frame(star, O.patch(region="ASIA"), ["zscore"]).filter("season_year = 1999").collect()
    assert {r.region for r in asia} == {"ASIA"}
    assert math.isclose(sum(r.zscore for r in asia), 0, abs_tol=1e-9)


def test_applicable_metric():
    assert M.applicable("buck_doe", "turkey") == "count" and M.applicable("buck_doe", "deer") == "buck_doe"
    assert M.applicable("nope", "deer") == "count"


def series(spark, values):
    flat = [(e, y, float(v)) for e, line in values.items() for y, v in line.items()]
    return spark.createDataFrame(flat, "entity int, season_year int, v double")


def test_calendar_and_dataset_neighbours(spark):
    df = series(spark, {1: {2000: 4, 2002: 6, 2003: 9}})
    got = rows(df.select("season_year", S.change("v", S.previous_calendar("v")), S.trailing_average("v")).orderBy("season_year"))
    assert got == [(2000, None, None), (2002, None, 4.0), (2003, 0.5, 5.0)]
    assert [r["change"] for r in S.adjacent_changes(df, "v").orderBy("season_year").collect()] == [0.5, 0.5]


def test_index_starts_at_first_positive(spark):
    df = series(spark, {1: {2000: 0, 2001: 5, 2002: 10}, 2: {2000: 0, 2001: 0, 2002: 0}})
    got = sorted(rows(df.select("entity", "season_year", S.index_100("v"))))
    assert got == [(1, 2000, 0.0), (1, 2001, 100.0), (1, 2002, 200.0), (2, 2000, None), (2, 2001, None), (2, 2002, None)]


def test_streak_and_leader_run(spark):
    df = series(spark, {1: {2000: 9, 2001: 1, 2002: 9, 2003: 9}, 2: {2000: 5, 2001: 5, 2002: 5, 2003: 5}, 3: {2000: 0, 2001: 0, 2002: 0, 2003: 0}})
    from starslice.operators.ranking import competition_rank

    ranked = competition_rank(df, ["season_year"], "v", bounded=True)
    assert dict(rows(S.top_n_streaks(ranked, 2003, 1))) == {1: 2, 2: 0, 3: 0}
    assert dict(rows(S.top_n_streaks(ranked, 2003, 2))) == {1: 4, 2: 4, 3: 0}
    assert rows(S.leader_run(df, "v", 2003)) == [(1, 9.0, 2)]
    assert rows(S.leader_run(df, "v", 2001)) == [(2, 5.0, 1)]


def test_shares_add_up(star):
    dense = star.measures(O, {"v": O})
    per = S.share(dense, "v").groupBy("season_year").agg(F.sum("share").alias("s")).collect()
    assert all(math.isclose(r.s, 1.0) for r in per)


def test_leaderboard_large_path_matches_window_path(star):
    small = rows(R.leaderboard(star, O, 2000, "count"))
    big = Star(star.fact, star.dim, star.attrs, star.effort)
    assert rows(R.leaderboard(big, O, 2000, "count")) == small
    card = rows(R.entity_card(star, O, "count", 11, 2000))
    assert rows(R.entity_card(big, O, "count", 11, 2000)) == card


def test_min_base_and_last_partial(star, spark):
    df = series(spark, {1: {1: 100, 2: 300}, 2: {1: 900, 2: 0}})
    assert one(R.min_base(df, "v", True)) == 30 and one(R.min_base(df, "v", False)) == 30
    assert one(R.min_base(df.filter("v > 1000"), "v", True)) == 10
    assert one(R.last_is_partial(star, O)) == 2001 and one(R.last_is_partial(star, O.patch(season="spring"))) == 0


def test_default_pair_skips_home(star):
    now = star.measures(O, {"v": O}).filter("season_year = 1999")
    lead = R.default_pair(now, None).collect()[0]
    assert R.default_pair(now, int(lead.a)).collect()[0].b == lead.b


def test_star_renames_columns(spark):
    fact = spark.createDataFrame([("d", 2000, "fall", "p", "m", False, False, 1, "c", 3)],
                                 "sp string, yr int, season string, portion string, method string, youth boolean, is_subtotal boolean, place int, class string, n int")
    dim = spark.createDataFrame([(1, "One", "R", 2.0)], "place int, name string, region string, area double")
    s = Star.of(fact, dim, {"species": "sp", "season_year": "yr", "entity": "place", "cnt": "n"})
    df = M.metric_frame(s.only("d"), SliceSpec(), ["per_sqmi"])
    assert [(r.entity, r.season_year, r.per_sqmi) for r in df.collect()] == [(1, 2000, 1.5)]


def test_facts_text(star):
    from starslice.plans.facts import make_facts

    facts = {r.id: r for r in make_facts(star, O, 2000, "deer", home=11, round_to=10).collect()}
    assert set(facts) >= {"home", "leader", "yoy", "density", "hunters", "dph", "opening", "buckdoe", "archery", "avg5", "region"}
    assert all(r.text and r.value for r in facts.values())
    top = make_facts(star, O, 2000, "deer", home=11, round_to=10, limit=8).collect()
    assert [r.priority for r in top] == sorted(r.priority for r in top) and len(top) == 8
    empty = SliceSpec(species="O", portions=("no_such",))
    assert make_facts(star, empty, 2000, "deer").count() == 0


def test_board_order(spark):
    data = [(1, "c", 5.0, None, 2, 1), (2, "a", 9.0, 0.5, 1, None), (3, "b", 5.0, 0.1, 2, -3), (4, "d", 0.0, 0.9, None, None)]
    df = spark.createDataFrame(data, "entity int, name string, value double, value2 double, rank int, delta int")
    by = lambda *how: [r.entity for r in df.orderBy(*R.board_order(*how)).collect()]
    assert by() == [2, 1, 3, 4] and by("rank", False) == [1, 3, 2, 4]
    assert by("name") == [2, 3, 1, 4] and by("value", False) == [2, 1, 3, 4]
    assert by("value2") == [3, 2, 4, 1] and by("value2", False) == [4, 2, 3, 1]
    assert by("delta") == [2, 4, 3, 1] and by("delta", False) == [1, 3, 2, 4]
