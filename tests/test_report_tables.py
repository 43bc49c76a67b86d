"""Regional tables of report texts: order of lines, rows, totals, regions, severity."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from starslice.functions import vocab as V
from starslice.operators import report_tables as RT

HEADER, TOTAL, PLACE = r"County\s+Total\s+Harvest\b", r"Total\s*\(t\)\s*/\s*Avg\.?\s*\(a\)", r"St\.? Clair|Adair|Saline|Benton"
HEAD = "County Total Harvest  Deer Harvested\nper square mile  Number of public hunting areas"
BODY = "Adair 1,200 .5 3\nSt Clair 30  -1.25 4"
SUMS = "Total (t)/Avg (a) t=1,230 a=.4 t=7"


def read(spark, *texts):
    reports = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "year int, report string")
    places = spark.createDataFrame([("adair", "1", "N"), ("st clair", "2", "N"), ("saline", "3", "S")], "alias string, entity string, region string")
    return RT.regional_tables(reports, "report", places, PLACE, V.EFFORT_HEADER_PHRASES, HEADER, TOTAL)


def errors(spark, *texts):
    return sorted((r.year, r.error) for r in read(spark, *texts).errors.collect())


def test_tables(spark):
    text = f"prose Total (t)/Avg (a) 3\n{HEAD}\n{BODY}\n{SUMS}\nmore prose, Adair 12\n{HEAD}\nSaline 5 1 0\n{SUMS.replace('1,230', '5')}"
    got = read(spark, text, None, "", "no table")
    assert got.errors.count() == 0
    cells = {(r.table, r.entity, r.column): r.value for r in got.cells.collect()}
    assert cells == {(0, "1", "harvest"): 1200, (0, "1", "harvest_per_sqmi"): 0.5, (0, "1", "public_areas"): 3, (0, "2", "harvest"): 30, (0, "2", "harvest_per_sqmi"): -1.25,
                     (0, "2", "public_areas"): 4, (1, "3", "harvest"): 5, (1, "3", "harvest_per_sqmi"): 1, (1, "3", "public_areas"): 0}
    assert sorted(rows(got.totals.filter("table = 0").select("region", "column", "kind", "printed"))) == [("N", "harvest", "t", 1230.0), ("N", "harvest_per_sqmi", "a", 0.4), ("N", "public_areas", "t", 7.0)]
    assert {r.region for r in got.cells.filter("table = 1").collect()} == {"S"}


@pytest.mark.parametrize("text, error", [
    (f"{HEAD}\n{BODY}\n{HEAD}\nSaline 5 1 0\n{SUMS}", "two headers before a total line (line 1)"),
    (f"{HEAD}\n{BODY}", "no total line (line 1)"),
    (f"x\n{HEAD}\n{SUMS}", "no rows after the header (line 4)"),
    (f"{HEAD}\n{BODY}\nAdair 1 1 1\n{SUMS}", "repeated place: 1"),
    (f"{HEAD}\n{BODY}\nwhat is this\n{SUMS}", "unread text: what is this"),
    (f"{HEAD}\n{BODY}\nSaline 1 1\n{SUMS}", "unread text: Saline 1 1"),
    (f"{HEAD}\n{BODY} 9\n{SUMS}", "unread text: 9"),
    (f"{HEAD}\n{BODY}\nSaline 1 1 1\n{SUMS}", "regions mixed: N, S"),
    (f"{HEAD}\n{BODY}\nBenton 1 1 1\n{SUMS}", "unknown place: Benton"),
    (f"{HEAD}\n{BODY}\n{SUMS} t=9", "4 totals for 3 columns"),
])
def test_faults(spark, text, error):
    assert errors(spark, text) == [(0, error)]


def test_unknown_header(spark):
    """The first column must be the harvest; a phrase before it is another kind of table."""
    assert errors(spark, f"Number of public hunting areas {HEAD}\n{BODY}\n{SUMS}")[0][1].startswith("unknown header: Number of public")


def test_findings(spark):
    good = f"{HEAD}\n{BODY}\n{SUMS}".replace("a=.4", "a=-.3")  # the mean is -0.375
    off = good.replace("t=1,230", "t=1,231").replace("a=-.3", "a=.4").replace("t=7", "t=8")
    tables = read(spark, good, off, off, good)
    pins = spark.createDataFrame([(0, "N", "harvest_per_sqmi"), (2, "N", "harvest_per_sqmi")], "year int, region string, column string")
    got = RT.printed_findings(tables, ["year"], ("harvest",), ("harvest_per_sqmi",), 0.15, pins)
    assert sorted((r.year, r.column, r.severity) for r in got.collect()) == [
        (0, "harvest_per_sqmi", "stale"), (1, "harvest", "error"), (1, "harvest_per_sqmi", "error"), (1, "public_areas", "warning"),
        (2, "harvest", "error"), (2, "harvest_per_sqmi", "known"), (2, "public_areas", "warning")]
    unpinned = {(r.year, r.column): r.severity for r in RT.printed_findings(tables, ["year"], ("harvest",), (), 0.15).collect()}
    assert unpinned[1, "harvest"] == "error" and unpinned[1, "public_areas"] == "warning" and unpinned[1, "harvest_per_sqmi"] == "warning"


def test_distribution(spark):
    df = spark.createDataFrame([(1, 10, 4, 3, 2, 1), (2, 10, 4, 3, 2, 2), (3, 9, 4, 3, 2, 1), (4, 10, 4, 3, 2, 1)], "year int, total int, none int, one int, two int, three_plus int")
    assert sorted(rows(RT.distribution_findings(df, ["year"]).select("year", "problem"))) == [(2, "unpinned"), (3, "unpinned")]
    pins = spark.createDataFrame([(3,), (4,)], "year int")
    assert sorted(rows(RT.distribution_findings(df, ["year"], pins).select("year", "problem"))) == [(2, "unpinned"), (4, "stale")]
