"""Derived metrics: every query returns all entities and periods from one aggregation pass."""

from __future__ import annotations

from pyspark.sql import functions as F

from starslice.operators import aggregates as A
from starslice.plans import metrics as M
from starslice.plans.spec import SliceSpec
from starslice.runtime import ratio
from starslice.sources import driver_tables as D
from starslice.workload.registry import query

O = SliceSpec(species="O")  # noqa: E741


def r6(c, name="value"):
    return F.round(c, 6).alias(name)


def _metric(name: str, metric: str, sql: str, needs: str = "series", spec: SliceSpec = O) -> None:
    @query(name, sql, needs)
    def run(s, d):
        effort = M.METRICS[metric].effort
        star = D.star(s, d, side=("effort",) if effort else ())
        return M.metric_frame(star, spec, [metric]).select("entity", "season_year", r6(F.col(metric)))


def _ratio_sql(num: str, den: str) -> str:
    return f"""SELECT g.entity, g.season_year, round(CASE WHEN coalesce(sum(CASE WHEN {den} THEN cnt END), 0) > 0
      THEN CAST(coalesce(sum(CASE WHEN {num} THEN cnt END), 0) AS DOUBLE) / sum(CASE WHEN {den} THEN cnt END) END, 6) AS value
    FROM grid g LEFT JOIN fact f ON f.entity = g.entity AND f.season_year = g.season_year GROUP BY g.entity, g.season_year"""


NS = "NOT is_subtotal"
_metric("metric_count", "count", "SELECT entity, season_year, CAST(v AS DOUBLE) AS value FROM series")
_metric("metric_density", "per_sqmi", "SELECT entity, season_year, round(v / area, 6) AS value FROM series")
_metric("metric_change_yoy", "change_yoy", """SELECT a.entity, a.season_year, round(CASE WHEN b.cmp > 0 THEN a.cmp / CAST(b.cmp AS DOUBLE) - 1 END, 6) AS value
  FROM series a LEFT JOIN series b ON b.entity = a.entity AND b.season_year = a.season_year - 1""")
_metric("metric_vs_5yr", "vs_5yr", """avgs AS (SELECT *, avg(cmp) OVER (PARTITION BY entity ORDER BY season_year ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS a FROM series)
  SELECT entity, season_year, round(CASE WHEN a > 0 THEN cmp / a - 1 END, 6) AS value FROM avgs""")
_metric("metric_zscore", "zscore", """st AS (SELECT season_year, avg(v / area) AS m, stddev_pop(v / area) AS sd FROM series WHERE v > 0 GROUP BY season_year)
  SELECT entity, s.season_year, round(CASE WHEN v > 0 AND sd > 0 THEN (v / area - m) / sd END, 6) AS value FROM series s JOIN st USING (season_year)""")
_metric("metric_class_ratio", "buck_doe", _ratio_sql(f"{NS} AND class = 'A'", f"{NS} AND class = 'N'"), "grid")
_metric("metric_class_share", "button_share", _ratio_sql(f"{NS} AND class = 'R'", NS), "grid")
_metric("metric_portion_share", "archery_share", _ratio_sql("portion IN ('fall_archery', 'spring_archery')", NS), "grid")
_metric("metric_youth_share", "youth_share", _ratio_sql(f"{NS} AND youth", f"{NS} AND method = 'firearm'"), "grid")
_metric("metric_opening_share", "opening_share", _ratio_sql("portion IN ('fall_opening', 'spring_opening')", "portion IN ('fall_main', 'spring_main')"), "grid")

ATTR_SQL = """den AS (SELECT entity, season_year, sum(cnt) AS den FROM fact WHERE {cond} AND (season_year, portion) IN (SELECT (season_year, portion) FROM attrs) GROUP BY ALL),
  num AS (SELECT entity, season_year, sum({key}) AS num FROM attrs WHERE {cond2} GROUP BY ALL)
  SELECT g.entity, g.season_year, round(CASE WHEN den > 0 THEN CAST(coalesce(num, 0) AS DOUBLE) / den END, 6) AS value
  FROM grid g LEFT JOIN den USING (entity, season_year) LEFT JOIN num USING (entity, season_year)"""


def _attr_metric(name: str, metric: str, sql: str) -> None:
    @query(name, sql, "grid attrs")
    def run(s, d):
        star = D.settled(s, d, "fact", "dim", "attrs")
        return M.metric_frame(star, O, [metric]).select("entity", "season_year", r6(F.col(metric)))


_attr_metric("metric_attribute_share", "public_land_share", ATTR_SQL.format(cond=NS, key="attr_a", cond2="true"))
_attr_metric("metric_attribute_share_fixed", "crossbow_share", ATTR_SQL.format(cond="portion = 'fall_archery'", key="attr_b", cond2="portion = 'fall_archery'"))


@query("attribute_share", """cell AS (SELECT season_year, portion, entity, sum(cnt) AS d FROM fact WHERE NOT is_subtotal GROUP BY ALL)
  SELECT entity, season_year, CAST(sum(attr_a) AS BIGINT) AS num, CAST(coalesce(sum(d), 0) AS BIGINT) AS den,
    round(CASE WHEN sum(d) > 0 THEN CAST(sum(attr_a) AS DOUBLE) / sum(d) END, 6) AS share
  FROM attrs LEFT JOIN cell USING (season_year, portion, entity) GROUP BY entity, season_year""", "fact attrs")
def attribute_share(s, d):
    star = D.settled(s, d, "fact", "attrs")
    return M.attribute_share_exact(star, O).withColumn("share", F.round("share", 6))


@query("attribute_share_struct", """cell AS (SELECT season_year, portion, entity, sum(cnt) AS d FROM fact WHERE NOT is_subtotal GROUP BY ALL)
  SELECT entity, CAST(sum(attr_a) AS BIGINT) AS land_num, CAST(sum(coalesce(d, 0)) AS BIGINT) AS land_den,
    CAST(sum(CASE WHEN portion = 'fall_archery' THEN attr_b END) AS BIGINT) AS fixed_num, CAST(sum(CASE WHEN portion = 'fall_archery' THEN coalesce(d, 0) END) AS BIGINT) AS fixed_den
  FROM attrs LEFT JOIN cell USING (season_year, portion, entity) WHERE season_year = 1998 GROUP BY entity""", "fact attrs")
def attribute_share_struct(s, d):
    star = D.settled(s, d, "fact", "attrs")
    cells = M.attribute_cells(star, O, "attr_a").filter("season_year = 1998").join(
        star.attrs.select("season_year", "portion", "entity", "attr_b"), ["season_year", "portion", "entity"]
    )
    fixed = F.col("portion") == "fall_archery"
    both = cells.groupBy("entity").agg(
        F.struct(F.sum("a").alias("num"), F.sum("d").alias("den")).alias("land"),
        F.struct(F.sum(F.when(fixed, F.col("attr_b"))).alias("num"), F.sum(F.when(fixed, F.col("d"))).alias("den")).alias("fixed"),
    )
    return both.select(
        "entity", F.col("land.num").alias("land_num"), F.col("land.den").alias("land_den"),
        F.col("fixed.num").alias("fixed_num"), F.col("fixed.den").alias("fixed_den"),
    )


@query("effort_metrics", """SELECT s.entity, s.season_year, round(fh, 6) AS firearms, round(ah, 6) AS archery, round(fh + ah, 6) AS hunters,
    round(CASE WHEN (fh + ah) * area > 0 THEN v / ((fh + ah) * area) END, 6) AS per_hunter
  FROM series s LEFT JOIN effort e ON e.entity = s.entity AND e.season_year = s.season_year""", "series effort")
def effort_metrics(s, d):
    star = D.star(s, d, side=("effort",))
    ids = ["firearms_hunters_per_sqmi", "archery_hunters_per_sqmi", "hunters_per_sqmi", "deer_per_hunter"]
    df = M.metric_frame(star, O, ids)
    return df.select("entity", "season_year", *[r6(F.col(i), n) for i, n in zip(ids, ["firearms", "archery", "hunters", "per_hunter"])])


@query("estimated_hunters", """SELECT e.entity, e.season_year, round((fh + ah) * area / 10.0) * 10 AS hunters FROM effort e JOIN dim USING (entity) WHERE fh + ah IS NOT NULL""", "effort")
def estimated_hunters(s, d):
    # counts here are small, so tens are kept; the harvest report rounds to hundreds
    joined = D.effort(s, d).join(D.dim(s, d).select("entity", "area"), "entity")
    people = joined.withColumn("hunters", F.round((F.col("fh") + F.col("ah")) * F.col("area") / 10) * 10)
    return people.filter("hunters IS NOT NULL").select("entity", "season_year", "hunters")


@query("season_ratio", """SELECT season_year, CAST(sum(CASE WHEN season = 'spring' THEN cnt ELSE 0 END) AS BIGINT) AS spring, CAST(sum(CASE WHEN season = 'fall' THEN cnt ELSE 0 END) AS BIGINT) AS fall,
    round(CASE WHEN sum(CASE WHEN season = 'fall' THEN cnt ELSE 0 END) > 0 THEN CAST(sum(CASE WHEN season = 'spring' THEN cnt ELSE 0 END) AS DOUBLE) / sum(CASE WHEN season = 'fall' THEN cnt ELSE 0 END) END, 6) AS ratio
  FROM fact WHERE NOT is_subtotal GROUP BY season_year""", "fact")
def season_ratio(s, d):
    sums = A.conditional(O.apply(D.fact(s, d).filter("species = 'O'")), ["season_year"], spring=F.col("season") == "spring", fall=F.col("season") == "fall")
    return sums.withColumn("ratio", F.round(ratio("spring", "fall"), 6))


@query("metric_all_years", """p AS (SELECT a.*, CASE WHEN b.cmp > 0 THEN a.cmp / CAST(b.cmp AS DOUBLE) - 1 END AS yoy, avg(a.cmp) OVER (PARTITION BY a.entity ORDER BY a.season_year ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS a5
    FROM series a LEFT JOIN series b ON b.entity = a.entity AND b.season_year = a.season_year - 1),
  k AS (SELECT g.entity, g.season_year, sum(CASE WHEN class = 'A' AND NOT is_subtotal THEN cnt END) AS b, sum(CASE WHEN class = 'N' AND NOT is_subtotal THEN cnt END) AS n
    FROM grid g LEFT JOIN fact f ON f.entity = g.entity AND f.season_year = g.season_year GROUP BY ALL)
  SELECT p.entity, p.season_year, CAST(v AS DOUBLE) AS count, round(v / area, 6) AS per_sqmi, round(yoy, 6) AS change_yoy, round(CASE WHEN a5 > 0 THEN cmp / a5 - 1 END, 6) AS vs_5yr,
    round(CASE WHEN n > 0 THEN CAST(coalesce(b, 0) AS DOUBLE) / n END, 6) AS buck_doe
  FROM p JOIN k ON k.entity = p.entity AND k.season_year = p.season_year""", "series")
def metric_all_years(s, d):
    ids = ["count", "per_sqmi", "change_yoy", "vs_5yr", "buck_doe"]
    df = M.metric_frame(D.star(s, d), O, ids)
    return df.select("entity", "season_year", *[r6(F.col(i), i) for i in ids])


@query("trend_density", """SELECT 'total' AS line, season_year, round(sum(v) / sum(area), 6) AS value FROM series GROUP BY season_year
  UNION ALL SELECT CAST(entity AS VARCHAR), season_year, round(v / area, 6) FROM series WHERE entity IN (2, 9)""", "series")
def trend_density(s, d):
    from starslice.plans import reports as R

    lines = R.trend_lines(D.star(s, d), O, [2, 9], "per_sqmi")
    return lines.withColumn("value", F.round("value", 6))
