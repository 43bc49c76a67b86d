"""Report texts to regional tables: every period's numbers are printed as a report, region by region, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starslice.functions import text as X
from starslice.functions import vocab as V
from starslice.operators import extract as E
from starslice.operators import report_tables as RT
from starslice.plans.spec import SliceSpec
from starslice.runtime import literal_rows, settle
from starslice.sources import driver_tables as D
from starslice.workload.page_queries import spelled
from starslice.workload.registry import query

HEADER, TOTAL, PLACE = r"^\s*County\s+Total\s+Harvest\b", r"^\s*Total\s*\(t\)\s*/\s*Avg", r"Land [a-j]+"


def numbers(s, d) -> DataFrame:
    """(season_year, region, entity, harvest, harvest_per_sqmi, public_areas) as printed."""
    O = SliceSpec(species="O")  # noqa: E741
    dense = D.star(s, d).measures(O, {"v": O})
    return dense.select("season_year", "region", "entity", F.col("v").alias("harvest"), F.round(F.col("v") / F.col("area"), 2).alias("harvest_per_sqmi"), (F.col("entity") % 4).alias("public_areas"))


def reports(s, d, region: Column | None = None, more_sum: Column | None = None, more_mean: Column | None = None, more_areas: Column | None = None) -> DataFrame:
    """(season_year, report): one text a period. Odd periods have two columns and all rows of a table on one line.

    ``region`` prints a row in another region's table; ``more_..`` is added to a printed total.
    """
    year, wide = F.col("season_year"), F.col("season_year") % 2 == 0
    rows = numbers(s, d)
    rows = rows.withColumn("region", region) if region is not None else rows
    small = lambda c: F.regexp_replace(F.format_number(c, 2), r"^0\.", ".")
    line = F.concat_ws("  ", spelled(), F.format_number("harvest", 0), small("harvest_per_sqmi"), F.when(wide, F.col("public_areas").cast("string")))
    zero = F.lit(0)
    tables = rows.withColumn("line", line).groupBy("season_year", "region").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("entity", "line"))), lambda r: r["line"]).alias("lines"),
        F.sum("harvest").alias("t"), F.round(F.avg("harvest_per_sqmi"), 1).alias("a"), F.sum("public_areas").alias("n"))
    add = lambda c, more: F.col(c) + (zero if more is None else more)
    total = F.concat_ws(
        "   ", F.lit("Total (t)/Avg. (a)"), F.concat(F.lit("t="), F.format_number(add("t", more_sum), 0)), F.concat(F.lit("a = "), F.format_number(add("a", more_mean), 1)),
        F.when(wide, F.concat(F.lit("t ="), add("n", more_areas).cast("string"))))
    head = F.when(wide, F.lit("  County   Total Harvest  Harvested deer per\n square mile  Number of public hunting areas")).otherwise(
        F.lit("  County   Total Harvest  Harvested deer\n per square mile"))
    text = F.concat_ws("\n", F.lit("Some prose about the season, Total 12."), head, F.when(wide, F.array_join("lines", "\n")).otherwise(F.array_join("lines", "   ")), total, F.lit(""))
    made = tables.select("season_year", F.struct("region", text.alias("text")).alias("p"))
    return made.groupBy(year.alias("season_year")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["text"]), "\n").alias("report"))


def read(s, d, texts: DataFrame) -> RT.RegionalTables:
    places = D.dim(s, d).select(X.normalize_name(spelled()).alias("alias"), "entity", "region")
    return RT.regional_tables(settle(texts, "reports"), "report", places, PLACE, V.EFFORT_HEADER_PHRASES, HEADER, TOTAL)


NUMBERS = "num AS (SELECT season_year, region, entity, v AS harvest, round(v / area, 2) AS density, entity % 4 AS areas FROM series)"


@query("regional_tables", f"""{NUMBERS} SELECT season_year, region, entity, 'harvest' AS "column", CAST(harvest AS DOUBLE) AS value FROM num UNION ALL SELECT season_year, region, entity, 'harvest_per_sqmi', density FROM num
  UNION ALL SELECT season_year, region, entity, 'public_areas', CAST(areas AS DOUBLE) FROM num WHERE season_year % 2 = 0""", "series")
def regional_tables(s, d):
    return read(s, d, reports(s, d)).cells.select("season_year", "region", "entity", "column", F.round("value", 2).alias("value"))


@query("region_per_table", """SELECT DISTINCT season_year, 'regions mixed: AFRICA, EUROPE' AS error FROM series WHERE season_year % 3 = 0""", "series")
def region_per_table(s, d):
    """In every third period the table of one region holds a place of another."""
    first = D.dim(s, d).filter("region = 'EUROPE'").agg(F.min("entity")).scalar()
    moved = F.when((F.col("season_year") % 3 == 0) & (F.col("entity") == first), "AFRICA").otherwise(F.col("region"))
    return read(s, d, reports(s, d, region=moved)).errors.select("season_year", "error")


@query("regional_findings", f"""{NUMBERS}, g AS (SELECT season_year, region, CAST(sum(harvest) AS DOUBLE) AS t, avg(density) AS a, CAST(sum(areas) AS DOUBLE) AS n FROM num GROUP BY season_year, region)
  SELECT season_year, region, 'harvest' AS "column", round(t, 4) AS found, t + 1 AS printed, 'error' AS severity FROM g WHERE region = 'AFRICA' AND season_year % 4 = 0
  UNION ALL SELECT season_year, region, 'harvest_per_sqmi', round(a, 4), round(round(a, 1) + 0.3, 1), CASE WHEN season_year = 2000 THEN 'known' ELSE 'error' END FROM g WHERE region = 'ASIA' AND season_year % 2 = 0
  UNION ALL SELECT season_year, region, 'harvest_per_sqmi', round(a, 4), round(a, 1), 'stale' FROM g WHERE region = 'ASIA' AND season_year = 1999
  UNION ALL SELECT season_year, region, 'public_areas', n, n + 2, 'warning' FROM g WHERE region = 'EUROPE' AND season_year % 2 = 0""", "series")
def regional_findings(s, d):
    year, region = F.col("season_year"), F.col("region")
    texts = reports(
        s, d, more_sum=F.when((region == "AFRICA") & (year % 4 == 0), 1).otherwise(0), more_mean=F.when((region == "ASIA") & (year % 2 == 0), 0.3).otherwise(0.0),
        more_areas=F.when(region == "EUROPE", 2).otherwise(0))
    pins = literal_rows(s, [(2000, "ASIA", "harvest_per_sqmi"), (1999, "ASIA", "harvest_per_sqmi")], "season_year int, region string, column string")
    found = RT.printed_findings(read(s, d, texts), ["season_year"], ("harvest",), ("harvest_per_sqmi",), 0.15, pins)
    return found.select("season_year", "region", "column", F.round("found", 4).alias("found"), F.round("printed", 1).alias("printed"), "severity")


@query("hunter_rows", """m AS (SELECT season_year, portion, CAST(sum(cnt) AS BIGINT) AS n FROM fact WHERE portion IN ('fall_archery', 'fall_main') GROUP BY season_year, portion),
  r AS (SELECT season_year, CASE portion WHEN 'fall_archery' THEN 'archery' ELSE 'firearms' END AS method, n + CASE WHEN season_year % 4 = 1 AND portion = 'fall_main' THEN 5 ELSE 0 END AS total,
    n // 2 AS none, n // 4 AS one, n // 8 AS two, n - n // 2 - n // 4 - n // 8 AS three_plus FROM m)
  SELECT season_year, method, total, none, one, two, three_plus, CASE WHEN total <> none + one + two + three_plus AND season_year <> 1997 THEN 'unpinned' WHEN total = none + one + two + three_plus AND season_year = 1998 AND method = 'archery' THEN 'stale' END AS problem FROM r
  UNION ALL SELECT season_year, 'combined', CAST(sum(total) AS BIGINT), CAST(sum(none) AS BIGINT), CAST(sum(one) AS BIGINT), CAST(sum(two) AS BIGINT), CAST(sum(three_plus) AS BIGINT), CASE WHEN season_year % 4 = 1 AND season_year <> 1997 THEN 'unpinned' END FROM r GROUP BY season_year""", "fact")
def hunter_rows(s, d):
    """A distribution per period, printed with the rows for 3 and for 4 or more apart; some totals are off by 5, and pins know of some."""
    year, p = F.col("season_year"), F.col("portion")
    per = D.star(s, d).fact.filter(p.isin("fall_archery", "fall_main")).groupBy("season_year").agg(
        F.sum(F.when(p == "fall_archery", F.col("cnt")).otherwise(0)).alias("a"), F.sum(F.when(p == "fall_main", F.col("cnt")).otherwise(0)).alias("f"))
    off = F.when(year % 4 == 1, 5).otherwise(0)
    half = lambda c, k: F.expr(f"{c} div {k}")
    rest = lambda c: F.expr(f"{c} - {c} div 2 - {c} div 4 - {c} div 8")

    def line(label: str, a: Column, f: Column) -> Column:
        return F.concat_ws(" ", F.lit(label), *[F.format_number(x, 0) for x in (a, f, a + f)])

    four = lambda c: F.floor(rest(c) / 3)
    report = F.concat_ws(
        "\n", F.lit("1 2 3 4\nPrevious table"), line("Total hunters", F.col("a"), F.col("f") + off), F.lit("Deer Harvested   Number of Hunters"),
        *[line(str(k), half("a", n), half("f", n)) for k, n in ((0, 2), (1, 4), (2, 8))], line("3", rest("a") - four("a"), rest("f") - four("f")), line("4 or more", four("a"), four("f")))
    rows = E.hunter_distribution(settle(per.select("season_year", report.alias("report")), "reports"), "report")
    pins = literal_rows(s, [(1997, "firearms"), (1997, "combined"), (1998, "archery")], "season_year int, method string")
    bad = RT.distribution_findings(rows, ["season_year", "method"], pins).select("season_year", "method", "problem")
    return rows.join(bad, ["season_year", "method"], "left")
