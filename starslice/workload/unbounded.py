"""The same operators with the customer as the entity: the number of entities grows with the data.

Nothing here may order a whole period in one task, so ranks and breaks take the range-partitioned
form, and the entity x period frame is written once before it is compared with itself.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from starslice.operators import ranking as K
from starslice.operators import series as S
from starslice.operators import stats as T
from starslice.plans import reports as R
from starslice.plans.spec import SliceSpec
from starslice.runtime import settle
from starslice.sources import driver_tables as D
from starslice.sources.star import Star
from starslice.workload.registry import query

O = SliceSpec(species="O")  # noqa: E741

CUST = """cfact AS (SELECT season_year, o_custkey AS entity, CAST(sum(qty) AS BIGINT) AS cnt FROM base WHERE species = 'O' GROUP BY ALL),
  cdim AS (SELECT c_custkey AS entity, c_name AS name, c_mktsegment AS region, c_acctbal AS area FROM customer), cyears AS (SELECT DISTINCT season_year FROM cfact),
  cs AS (SELECT d.entity, d.name, d.region, d.area, y.season_year, coalesce(f.cnt, 0) AS v FROM cdim d CROSS JOIN cyears y LEFT JOIN cfact f ON f.entity = d.entity AND f.season_year = y.season_year),
  cr AS (SELECT *, CASE WHEN v > 0 THEN CAST(rank() OVER (PARTITION BY season_year, v > 0 ORDER BY v DESC) AS INT) END AS rank FROM cs)"""


def customer_star(s, d) -> Star:
    """Customers as entities and market segments as regions."""
    fact = D.fact(s, d, D.cells(s, d, "O", entity="o_custkey"))
    dim = D.table(s, d, "customer").select(
        F.col("c_custkey").alias("entity"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("region"),
        F.col("c_acctbal").alias("area"), F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"),
    )
    return Star(fact, dim)


def series(s, d):
    return customer_star(s, d).measures(O, {"v": O}).select("entity", "name", "region", "season_year", "v")


@query("leaderboard_unbounded", f"""{CUST}, b AS (SELECT *, lag(rank) OVER (PARTITION BY entity ORDER BY season_year) AS pr, array_to_string(list(v) OVER (PARTITION BY entity ORDER BY season_year ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), ',') AS spark FROM cr)
  SELECT entity, name, region, CAST(v AS DOUBLE) AS value, rank, CAST(pr - rank AS INT) AS delta, spark, round(v / CAST((SELECT sum(v) FROM cs WHERE season_year = 2000) AS DOUBLE), 8) AS share FROM b WHERE season_year = 2000""", "lines")
def leaderboard_unbounded(s, d):
    out = R.leaderboard(customer_star(s, d), O, 2000, "count")
    return out.drop("value2").withColumns({"share": F.round("share", 8), "spark": F.array_join(F.col("spark").cast("array<string>"), ",")})


@query("top_n_streak_unbounded", f"""{CUST} SELECT entity, CAST(count(CASE WHEN season_year > m THEN 1 END) AS INT) AS streak FROM (SELECT *, coalesce(max(CASE WHEN rank IS NULL OR rank > 10 THEN season_year END) OVER (PARTITION BY entity), 0) AS m FROM cr WHERE season_year <= 2000)
  GROUP BY entity HAVING count(CASE WHEN season_year > m THEN 1 END) > 0""", "lines")
def top_n_streak_unbounded(s, d):
    ranked = K.competition_rank(settle(series(s, d), "series"), ["season_year"], "v")
    return S.top_n_streaks(ranked, 2000, 10).filter("streak > 0")


@query("record_highest_unbounded", f"{CUST} SELECT entity, season_year, v, CAST(row_number() OVER (ORDER BY v DESC, entity, season_year) AS INT) AS pos FROM cs WHERE v > 0 QUALIFY pos <= 10", "lines")
def record_highest_unbounded(s, d):
    # only cells with rows can be records, so the dense frame is not needed
    cells = customer_star(s, d).fact.filter(O.category_predicate()).groupBy("entity", "season_year").agg(F.sum("cnt").alias("v"))
    return K.numbered(cells, 10, F.desc("v"), "entity", "season_year")


@query("choropleth_classes_unbounded", f"""{CUST}, o AS (SELECT season_year, v, row_number() OVER (PARTITION BY season_year ORDER BY v) - 1 AS p, count(*) OVER (PARTITION BY season_year) AS n FROM cs WHERE v > 0),
  k0 AS (SELECT DISTINCT season_year, v FROM o, (SELECT unnest(range(0, 4)) AS i) WHERE p = ((i + 1) * n) // 5), mm AS (SELECT season_year, min(v) AS lo, max(v) AS hi FROM o GROUP BY season_year),
  l AS (SELECT season_year, 0 AS c0, lo AS x FROM mm UNION ALL SELECT season_year, row_number() OVER (PARTITION BY season_year ORDER BY v), v FROM k0 JOIN mm USING (season_year) WHERE v > lo)
  SELECT season_year, CAST(c0 AS INT) AS class, x AS lo, coalesce(lead(x) OVER (PARTITION BY season_year ORDER BY c0), hi) AS hi FROM l JOIN mm USING (season_year)""", "lines")
def choropleth_classes_unbounded(s, d):
    cells = settle(customer_star(s, d).fact.filter(O.category_predicate()).groupBy("entity", "season_year").agg(F.sum("cnt").alias("v")), "cells")
    return T.class_ranges(T.sequential_breaks(cells.filter("v > 0"), ["season_year"], "v", 5), ["season_year"])


@query("best_season_unbounded", f"{CUST} SELECT entity, v, season_year FROM cs WHERE v > 0 QUALIFY row_number() OVER (PARTITION BY entity ORDER BY v DESC, season_year) = 1", "lines")
def best_season_unbounded(s, d):
    cells = customer_star(s, d).fact.filter(O.category_predicate()).groupBy("entity", "season_year").agg(F.sum("cnt").alias("v"))
    return K.argmax(["entity"], cells.filter("v > 0"), "v", entity="season_year")
