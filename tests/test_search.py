"""A log of searches gives what the single search gives; hot searches, repeats, empty and null values."""

from conftest import rows

from starslice.operators.search import name_search, search_log


def test_log_equals_single_searches(spark):
    names = [(i, n) for i, n in enumerate(["St. Louis", "Saint Clair", "Clay", "Clark", "Macon", "New Madrid", "anana banana", "Clay", *[f"Town {k}" for k in range(30)]])] + [(90, None), (91, "")]
    needles = ["st. l", "saint", "cla", "an", "TOWN", "own 2", "zz", " clay "]
    log = [(i, n) for i, n in enumerate(needles)] + [(50 + i, "cla") for i in range(40)] + [(99, None), (100, "  ")]
    frame = spark.createDataFrame(names, "entity int, name string")
    got = {}
    for i, entity, name, pos in rows(search_log(spark.createDataFrame(log, "id int, q string"), frame, "q", "name", "entity").drop("q")):
        got.setdefault(i, []).append((pos, entity))
    known = frame.filter("name <> ''")
    for i, needle in enumerate(needles):
        want = [(r.pos, r.entity) for r in name_search(known, [needle], "name", "entity").collect()]
        assert sorted(got.get(i, [])) == sorted(want), needle
    assert sorted(got[50]) == sorted(got[2]) == sorted(got[89]) and 99 not in got and 100 not in got


def test_empty_tables(spark):
    names, log = spark.createDataFrame([(1, "Clay")], "entity int, name string"), spark.createDataFrame([(1, "cl")], "id int, q string")
    assert rows(search_log(log.limit(0), names, "q", "name", "entity")) == []
    assert rows(search_log(log, names.limit(0), "q", "name", "entity")) == []


def test_the_limit_applies_before_the_shuffle(spark):
    names, log = spark.range(50).selectExpr("id AS entity", "concat('Town ', id) AS name"), spark.createDataFrame([(1, "town")], "id int, q string")
    plan = search_log(log, names, "q", "name", "entity")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan
