"""Atomic versions, the published documents, and periods that bound a scan."""

import json

import pytest
from conftest import one, rows
from pyspark.sql import functions as F

from starslice import workload
from starslice.operators import quality as Q
from starslice.plans import metrics as M
from starslice.plans import reports as R
from starslice.plans.spec import Calendar, SliceSpec
from starslice.sources import driver_tables as D
from starslice.sources import publish, scans, sinks
from starslice.sources import star as star_module

QUERIES = workload.queries()
O = SliceSpec(species="O")  # noqa: E741


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def fact(star):
    return D.published_rows(star.fact)


def test_versions(spark, fact, tmp_path):
    root = str(tmp_path / "t")
    first = publish.publish(fact, root)
    whole = one(fact.agg(F.sum("cnt")))
    old = publish.published(spark, root)
    assert one(old.agg(F.sum("cnt"))) == whole and old.columns == sinks.FACT_SCHEMA.names
    second = publish.publish(fact.filter("class = 'A'"), root, lambda staged: {"only A": staged.filter("class <> 'A'")})
    assert second > first and publish.manifest(spark, root)["version"] == second
    assert one(publish.published(spark, root).agg(F.count_distinct("class"))) == 1
    assert one(old.agg(F.sum("cnt"))) == whole  # a reader that has begun keeps its version
    found = publish.manifest(spark, root)
    assert found["rows"] == fact.filter("class = 'A'").count() == sum(p["rows"] for p in found["folders"])


def test_a_failure_leaves_the_old_version(spark, fact, tmp_path):
    root = str(tmp_path / "t")
    first = publish.publish(fact, root)
    with pytest.raises(Q.GateClosed, match="negative: "):
        publish.publish(fact.withColumn("cnt", -F.col("cnt")), root, lambda staged: {"negative": staged.filter("cnt < 0")})
    broken = fact.withColumn("cnt", F.when(F.col("class") == "R", F.raise_error(F.lit("source is gone")).cast("long")).otherwise(F.col("cnt")))
    with pytest.raises(Exception, match="source is gone"):
        publish.publish(broken, root)
    with pytest.raises(Exception, match="no such rule"):
        publish.publish(fact, root, lambda staged: {"rule": staged.filter(F.raise_error(F.lit("no such rule")).cast("boolean"))})
    assert publish.manifest(spark, root)["version"] == first
    assert one(publish.published(spark, root).agg(F.sum("cnt"))) == one(fact.agg(F.sum("cnt")))


def test_rows_lost_between_write_and_read_are_seen(spark, fact, tmp_path, monkeypatch):
    root, write = str(tmp_path / "t"), publish.write_layout

    def lossy(df, path, seen):
        write(df, path, seen=seen)
        folder = next((tmp_path / "t").rglob("season=spring"))
        for part in folder.glob("*.parquet"):
            part.unlink()

    monkeypatch.setattr(publish, "write_layout", lossy)
    with pytest.raises(Q.GateClosed, match="staged rows differ"):
        publish.publish(fact, root)
    with pytest.raises(FileNotFoundError):
        publish.published(spark, root)


def test_prune_keeps_the_valid_version(spark, fact, tmp_path):
    root, few = str(tmp_path / "t"), fact.filter("entity = 1")
    made = [publish.publish(few, root) for _ in range(4)]
    assert publish.prune(spark, root, keep=1) == made[:2]
    assert publish.prune(spark, root, keep=1) == [] and publish.published(spark, root).count() == few.count()


def test_empty_publication(spark, fact, tmp_path):
    publish.publish(fact.limit(0), str(tmp_path / "t"))
    assert publish.published(spark, str(tmp_path / "t")).count() == 0
    assert publish.calendar(spark, str(tmp_path / "t"), "O").periods == ()


def test_folders_are_chosen(spark, star, fact, tmp_path):
    root = str(tmp_path / "t")
    publish.publish(fact.unionByName(fact.withColumn("species", F.lit("X"))), root)
    whole = publish.published_star(spark, root, "O", star.dim, small=True)
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    text = plan(whole.slice(O.patch(year_from=1998, year_to=1999)).select("cnt"))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    filters = text[text.index("PartitionFilters"):text.index("PushedFilters")]
    assert "species" in filters and "season_year" in filters and "1998" in filters and "1999" in filters
    assert whole.calendar.periods[0] == (min(y for y, _ in whole.calendar.periods), whole.calendar.periods[0][1]) and not set(whole.calendar.periods[0][1]) - {"fall", "spring"}
    years = [y for y, _ in whole.calendar.periods]
    assert years == sorted(r[0] for r in star.fact.select("season_year").distinct().collect())


def test_calendar():
    c = Calendar(((1990, ("fall", "spring")), (1992, ("fall",)), (1993, ("spring",)), (1999, ("fall",))))
    assert [c.back(1999, n) for n in (0, 1, 2, 3, 9)] == [1999, 1993, 1992, 1990, 1990] and c.back(1990, 5) == 1990 and c.partial
    assert not Calendar(((1990, ("spring",)),)).partial and not Calendar(((1990, ("fall", "spring")),)).partial


# -- periods bound the scan ------------------------------------------------------------------------
@pytest.fixture
def settled_plans(monkeypatch):
    """Plans of the tables that a star writes."""
    seen, settle = [], star_module.settle

    def spy(df, label):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return settle(df, label)

    monkeypatch.setattr(star_module, "settle", spy)
    return seen


def bound(text, first, after):
    return f"o_orderdate" in text and f">= {first}-01-01" in text and f"< {after}-01-01" in text


def test_slices_bound_the_scan(spark, sf_dir):
    for name, first, after in (("year_slice", 1998, 1999), ("slice_filter", 1997, 2000), ("entity_by_portion", 1999, 2000), ("sum_by_entity", 2001, 2002)):
        text = plan(QUERIES[name](spark, sf_dir))
        assert f"GreaterThanOrEqual(o_orderdate,{first}-01-01" in text, name
        assert bound(QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString(), first, after), name


def test_reports_read_their_look_back(spark, sf_dir, settled_plans):
    for name, first, after in (("leaderboard", 1995, 2001), ("neighbors_compared", 1999, 2000), ("stats_strip", 2001, 2002), ("pressure_card", 2000, 2001)):
        del settled_plans[:]
        QUERIES[name](spark, sf_dir)
        assert bound(settled_plans[-1], first, after), name
    assert "PushedFilters: [EqualTo(season_year,1999)" in plan(QUERIES["map_values"](spark, sf_dir))


def test_missing_periods_widen_the_look_back(spark, star, settled_plans):
    """A list of periods with gaps: the sparkline's six periods reach further back than six years."""
    gaps = star.fact.filter("season_year NOT IN (1999, 2000)")
    loose = star_module.Star(gaps, star.dim, small=True)
    want = rows(R.leaderboard(star_module.Star(gaps, star.dim, written=("fact",), small=True), O, 2001, "count", "per_sqmi"))
    assert rows(R.leaderboard(loose, O, 2001, "count", "per_sqmi")) == want and len(settled_plans) == 2
    years = sorted(r[0] for r in gaps.select("season_year").distinct().collect())
    known = star_module.Star(gaps, star.dim, small=True, calendar=Calendar(tuple((y, ("fall", "spring")) for y in years)))
    del settled_plans[:]
    assert rows(R.leaderboard(known, O, 2001, "count", "per_sqmi")) == want
    assert len(settled_plans) == 1 and f">= {years[max(0, years.index(2001) - 5)]}" in settled_plans[0]


@pytest.mark.parametrize("metric", ["count", "change_yoy", "vs_5yr", "zscore", "archery_share", "buck_doe"])
def test_bounded_metrics_equal_unbounded_ones(spark, star, fact, tmp_path, metric):
    """Over a published table with a partial last period, which makes like-for-like metrics look at all periods' seasons."""
    partial = fact.filter("season_year < 2001 OR season = 'spring'")
    publish.publish(partial, str(tmp_path / "t"))
    laid_out = publish.published_star(spark, str(tmp_path / "t"), "O", star.dim, small=True)
    assert laid_out.calendar.partial
    plain = star_module.Star(partial, star.dim, written=("fact",), small=True)
    loose = star_module.Star(partial, star.dim, small=True)
    for year in (1993, 2000, 2001):
        value = [sorted(rows(M.metric_frame(s, O, [metric], at=year).filter(F.col("season_year") == year).select("entity", "base", F.round(metric, 9))), key=str) for s in (plain, loose, laid_out)]
        assert value[0] == value[1] == value[2]


# -- documents --------------------------------------------------------------------------------------
def expected_document(table, species):
    """The published form of one species by its definition."""
    mine = [r.asDict() for r in table if r.species == species]
    order = sorted({r["entity"] for r in mine})
    series, portions, labels = {}, {}, {}
    for r in mine:
        portions[r["portion"]] = {k: r[k] for k in ("season", "method", "youth", "is_subtotal")}
        labels[f"{species}:{r['season_year']}:{r['portion']}"] = {k: r[k] for k in ("portion_label", "source_url", "derived")}
        series.setdefault((r["season_year"], r["portion"], r["class"]), [0] * len(order))[order.index(r["entity"])] += r["cnt"]
    return {"state": "OR", "species": species, "counties": [str(e) for e in order], "classes": sorted({r["class"] for r in mine}), "portions": portions,
            "series": [[*k, v] for k, v in sorted(series.items())], "labels": labels}


def test_document_of_a_closed_dimension(spark, fact):
    both = fact.unionByName(fact.filter("entity % 2 = 0").withColumn("species", F.lit("X")))
    twice = both.unionByName(both.filter("entity = 4"))  # repeated cells add up
    table = twice.collect()
    docs = {r.species: json.loads(r.value) for r in sinks.series_documents(twice, size=1000).collect()}
    assert docs == {s: expected_document(table, s) for s in ("O", "X")}
    assert list(docs["O"]) == ["state", "species", "counties", "classes", "portions", "series", "labels"]


def test_documents_in_pieces(spark, star, fact, tmp_path):
    docs = sinks.series_documents(fact, size=4).collect()
    sizes = [len(json.loads(d.value)["counties"]) for d in docs]
    assert len(docs) > 4 and sum(sizes) == 25 and max(sizes) < 12
    sinks.write_series(fact, str(tmp_path / "s"), size=4)
    back = scans.published_series(spark, str(tmp_path / "s"), star.dim, "int")
    cols = ["state", "species", "season_year", "portion", "class", "entity", "cnt", "season", "method", "youth", "is_subtotal", "portion_label", "source_url", "derived"]
    want = fact.filter("cnt <> 0").withColumn("season_year", F.col("season_year").cast("int")).select(cols)
    assert back.select(cols).exceptAll(want).count() == 0 == want.exceptAll(back.select(cols)).count()
    assert one(back.agg(F.count_if("derived"))) > 0


def test_documents_made_elsewhere(spark, tmp_path):
    """Rows of mixed types, no label for one period, an entity that the dimension lacks."""
    doc = {"state": "MO", "species": "deer", "counties": ["29001", "29003"], "classes": ["doe", 'b"uck'], "portions": {"archery": {"season": "fall", "method": "archery", "youth": False, "is_subtotal": False}},
           "series": [[2019, "archery", "doe", [5, 0]], [2020, "archery", 'b"uck', [0, 7]], [2020, "archery", "doe", []]], "labels": {"deer:2019:archery": {"portion_label": "Archery", "source_url": "u", "derived": True}}}
    (tmp_path / "d.json").write_text(json.dumps(doc, indent=1))
    got = scans.published_series(spark, str(tmp_path / "d.json"))
    assert sorted(rows(got.select("season_year", "class", "entity", "cnt", "derived", "portion_label", "season"))) == [
        (2019, "doe", "29001", 5, True, "Archery", "fall"), (2020, 'b"uck', "29003", 7, False, None, "fall")]
    known = spark.createDataFrame([("29001",)], "entity string")
    with pytest.raises(Exception, match="unknown entity 29003"):
        scans.published_series(spark, str(tmp_path / "d.json"), known).collect()


def test_inconsistent_portions_are_refused(spark, fact):
    with pytest.raises(Q.GateClosed, match="inconsistent"):
        sinks.series_documents(fact.unionByName(fact.limit(1).withColumn("method", F.lit("other"))))
