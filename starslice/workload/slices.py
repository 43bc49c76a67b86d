"""Filters, slices and group sums."""

from __future__ import annotations

from pyspark.sql import functions as F

from starslice.operators import aggregates as A
from starslice.plans.spec import SliceSpec, clamp
from starslice.sources import driver_tables as D
from starslice.workload.registry import query

O = SliceSpec(species="O")  # noqa: E741
S6 = "CAST(sum(cnt) AS BIGINT) AS cnt"


@query("species_slice", f"SELECT portion, class, {S6} FROM fact0 WHERE species = 'F' AND NOT is_subtotal GROUP BY portion, class", "fact")
def species_slice(s, d):
    return A.sum_by(SliceSpec(species="F").apply(D.fact(s, d)), "portion", "class")


@query("species_union", f"SELECT species, season_year, {S6} FROM fact0 WHERE NOT is_subtotal GROUP BY species, season_year", "fact")
def species_union(s, d):
    # both species live in one table: appending them is one scan, not a union of two
    both = D.fact(s, d).filter(F.col("species").isin("O", "F"))
    return A.sum_by(SliceSpec().apply(both), "species", "season_year")


@query("slice_filter", """SELECT season_year, portion, class, f.entity, cnt FROM fact f JOIN dim USING (entity)
  WHERE NOT is_subtotal AND season_year BETWEEN 1997 AND 1999 AND season = 'fall' AND method = 'firearm' AND NOT youth
    AND class IN ('A', 'R') AND region = 'ASIA'""", "fact dim")
def slice_filter(s, d):
    spec = O.patch(year_from=1997, year_to=1999, season="fall", method="firearm", youth=False, classes=("A", "R"), region="ASIA")
    star = D.star(s, d)
    return star.slice(spec).select("season_year", "portion", "class", "entity", "cnt")


@query("exclude_subtotals", """SELECT 'default' AS slice, portion, CAST(sum(cnt) AS BIGINT) AS cnt FROM fact WHERE NOT is_subtotal GROUP BY portion
  UNION ALL SELECT 'named', portion, CAST(sum(cnt) AS BIGINT) FROM fact WHERE portion IN ('fall_opening', 'fall_main') GROUP BY portion""", "fact")
def exclude_subtotals(s, d):
    named = O.patch(portions=("fall_opening", "fall_main"))
    tags = F.filter(
        F.array(F.when(O.category_predicate(), "default"), F.when(named.category_predicate(), "named")), lambda x: x.isNotNull()
    )
    return A.sum_by(D.star(s, d).fact.withColumn("slice", F.explode(tags)), "slice", "portion")


@query("class_filter", f"SELECT season_year, class, {S6} FROM fact WHERE NOT is_subtotal AND class IN ('A', 'no-such-class') GROUP BY season_year, class", "fact")
def class_filter(s, d):
    return A.sum_by(O.patch(classes=("A", "no-such-class")).apply(D.fact(s, d)), "season_year", "class")


@query("method_youth_filter", f"SELECT season, portion, {S6} FROM fact WHERE NOT is_subtotal AND method = 'firearm' AND youth GROUP BY season, portion", "fact")
def method_youth_filter(s, d):
    return A.sum_by(O.patch(method="firearm", youth=True).apply(D.fact(s, d)), "season", "portion")


@query("region_filter", f"SELECT season_year, {S6} FROM fact JOIN dim USING (entity) WHERE NOT is_subtotal AND region = 'EUROPE' GROUP BY season_year", "fact dim")
def region_filter(s, d):
    star = D.star(s, d)
    return A.sum_by(O.patch(region="EUROPE").apply(star.fact, star.dim), "season_year")


@query("year_slice", f"SELECT portion, {S6} FROM fact WHERE NOT is_subtotal AND season_year = 1998 GROUP BY portion", "fact")
def year_slice(s, d):
    return A.sum_by(D.star(s, d).slice(O.patch(year_from=1998, year_to=1998)), "portion")


@query("entity_slice", f"SELECT entity, season_year, {S6} FROM fact WHERE NOT is_subtotal AND entity IN (3, 7, 19) GROUP BY entity, season_year", "fact")
def entity_slice(s, d):
    return A.sum_by(O.patch(entities=(3, 7, 19)).apply(D.fact(s, d)), "entity", "season_year")


@query("partial_years", "SELECT season_year FROM fact GROUP BY season_year HAVING NOT bool_or(season = 'fall')", "fact")
def partial_years(s, d):
    return D.star(s, d).partial_years()


@query("comparable_totals", f"SELECT season_year, {S6} FROM fact WHERE NOT is_subtotal AND season = 'spring' GROUP BY season_year", "fact")
def comparable_totals(s, d):
    return A.comparable_totals(D.star(s, d), O)


@query("years_in_range", """SELECT 'inside' AS slice, season_year, CAST(greatest(least(season_year, 1999), 1997) AS INT) AS clamped FROM (SELECT DISTINCT season_year FROM fact) WHERE season_year BETWEEN 1996 AND 1998
  UNION ALL SELECT 'outside', CAST(max(season_year) AS INT), CAST(greatest(least(max(season_year), 1999), 1997) AS INT) FROM fact""", "fact")
def years_in_range(s, d):
    star = D.settled(s, d, "fact")
    inside = A.periods_in_range(star, O.patch(year_from=1996, year_to=1998)).withColumn("slice", F.lit("inside"))
    outside = A.periods_in_range(star, O.patch(year_from=2050, year_to=2060)).withColumn("slice", F.lit("outside"))
    return inside.unionByName(outside).withColumn("clamped", clamp(F.col("season_year"), 1997, 1999))


@query("latest_published", """SELECT CAST(max(CASE WHEN season_year BETWEEN 1995 AND 1999 THEN season_year END) AS INT) AS latest_in_range,
  CAST(max(CASE WHEN season_year <= 1999 AND ah IS NOT NULL THEN season_year END) AS INT) AS latest_with_measure FROM effort""", "effort")
def latest_published(s, d):
    return A.latest_period(D.effort(s, d), 1995, 1999, "ah")


@query("fact_dim_join", f"SELECT region, name, season, {S6} FROM fact JOIN dim USING (entity) WHERE NOT is_subtotal GROUP BY region, name, season", "fact dim")
def fact_dim_join(s, d):
    star = D.star(s, d)
    sums = A.sum_by(O.apply(star.fact), "entity", "season")
    return sums.join(star.dim, "entity").select("region", "name", "season", "cnt")


@query("dense_series", """SELECT g.entity, g.season_year, CAST(coalesce(sum(cnt), 0) AS BIGINT) AS cnt FROM grid g
  LEFT JOIN fact f ON f.entity = g.entity AND f.season_year = g.season_year AND portion = 'fall_archery' AND class = 'R'
  GROUP BY g.entity, g.season_year""", "grid")
def dense_series(s, d):
    spec = O.patch(portions=("fall_archery",), classes=("R",))
    return D.star(s, d).measures(spec, {"cnt": spec}).select("entity", "season_year", "cnt")


@query("sum_by_entity", "SELECT entity, name, CAST(coalesce((SELECT sum(cnt) FROM fact f WHERE f.entity = dim.entity AND NOT is_subtotal AND season_year = 2001), 0) AS BIGINT) AS cnt FROM dim", "fact dim")
def sum_by_entity(s, d):
    return A.dense_by_entity(D.star(s, d), O.patch(year_from=2001, year_to=2001)).select("entity", "name", "cnt")


@query("sum_by_entity_year", "SELECT entity, season_year, v AS cnt FROM series", "series")
def sum_by_entity_year(s, d):
    return D.star(s, d).measures(O, {"cnt": O}).select("entity", "season_year", "cnt")


@query("sum_by_year", f"SELECT season_year, {S6} FROM fact WHERE NOT is_subtotal GROUP BY season_year", "fact")
def sum_by_year(s, d):
    return A.sum_by(O.apply(D.fact(s, d)), "season_year", keep_zero=True)


@query("sum_by_code", f"SELECT method, {S6} FROM fact WHERE NOT is_subtotal GROUP BY method HAVING sum(cnt) <> 0", "fact")
def sum_by_code(s, d):
    return A.sum_by(O.apply(D.fact(s, d)), "method")


@query("grand_total", f"SELECT {S6} FROM fact WHERE NOT is_subtotal", "fact")
def grand_total(s, d):
    return A.total(O.apply(D.fact(s, d)))


@query("year_by_category", """SELECT season_year, CAST(sum(CASE WHEN class = 'A' THEN cnt ELSE 0 END) AS BIGINT) AS class_a,
  CAST(sum(CASE WHEN class = 'N' THEN cnt ELSE 0 END) AS BIGINT) AS class_n, CAST(sum(CASE WHEN class = 'R' THEN cnt ELSE 0 END) AS BIGINT) AS class_r,
  CAST(sum(CASE WHEN portion = 'fall_archery' THEN cnt ELSE 0 END) AS BIGINT) AS fall_archery,
  CAST(sum(CASE WHEN portion = 'spring_main' THEN cnt ELSE 0 END) AS BIGINT) AS spring_main FROM fact WHERE NOT is_subtotal GROUP BY season_year""", "fact")
def year_by_category(s, d):
    c, p = F.col("class"), F.col("portion")
    return A.conditional(
        O.apply(D.fact(s, d)), ["season_year"], class_a=c == "A", class_n=c == "N", class_r=c == "R",
        fall_archery=p == "fall_archery", spring_main=p == "spring_main",
    )


@query("place_series", """SELECT '3' AS place, season_year, v AS cnt FROM series WHERE entity = 3
  UNION ALL SELECT 'region:ASIA', season_year, CAST(sum(v) AS BIGINT) FROM series WHERE region = 'ASIA' GROUP BY season_year""", "series")
def place_series(s, d):
    return A.place_series(D.star(s, d), O, ["3", "region:ASIA"])


@query("resolve_place", """SELECT '3' AS place, false AS is_region, name AS label, CAST(1 AS BIGINT) AS members, area FROM dim WHERE entity = 3
  UNION ALL SELECT 'region:ASIA', true, 'ASIA region', count(*), sum(area) FROM dim WHERE region = 'ASIA'""", "dim")
def resolve_place(s, d):
    star = D.star(s, d)
    return A.places(star, ["3", "region:ASIA", "region:ATLANTIS"]).groupBy("place", "is_region").agg(
        F.when(F.first("is_region"), F.concat(F.first("region"), F.lit(" region"))).otherwise(F.first("name")).alias("label"),
        F.count("*").alias("members"), F.sum("area").alias("area"),
    )


@query("entity_by_portion", f"SELECT entity, portion, {S6} FROM fact WHERE NOT is_subtotal AND season_year = 1999 GROUP BY entity, portion", "fact")
def entity_by_portion(s, d):
    return A.sum_by(D.star(s, d).slice(O.patch(year_from=1999, year_to=1999)), "entity", "portion")


@query("entity_breakdown", f"""SELECT 'portion' AS dimension, portion AS item, {S6} FROM fact WHERE entity = 5 AND season_year = 1999 AND NOT is_subtotal GROUP BY portion
  UNION ALL SELECT 'class', class, CAST(sum(cnt) AS BIGINT) FROM fact WHERE entity = 5 AND season_year = 1999 AND NOT is_subtotal GROUP BY class""", "fact")
def entity_breakdown(s, d):
    star, spec = D.star(s, d), O.patch(region="ASIA")
    cells = A.sum_by(star.slice(spec.patch(region="", year_from=1999, year_to=1999, entities=(5,))), "portion", "class")
    items = F.array(
        F.struct(F.lit("portion").alias("dimension"), F.col("portion").alias("item")),
        F.struct(F.lit("class").alias("dimension"), F.col("class").alias("item")),
    )
    return A.sum_by(cells.select(F.inline(items), "cnt"), "dimension", "item")


@query("distinct_years", """SELECT 'year' AS kind, CAST(season_year AS VARCHAR) AS item FROM (SELECT DISTINCT season_year FROM fact)
  UNION ALL SELECT 'region', region FROM (SELECT DISTINCT region FROM dim) UNION ALL SELECT 'effort_year', CAST(season_year AS VARCHAR) FROM (SELECT DISTINCT season_year FROM effort)""", "fact dim effort")
def distinct_years(s, d):
    star = D.star(s, d, side=("effort",))
    pick = lambda df, kind, col: df.select(F.lit(kind).alias("kind"), F.col(col).cast("string").alias("item")).distinct()
    return (
        pick(star.fact, "year", "season_year").unionByName(pick(star.dim, "region", "region"))
        .unionByName(pick(star.effort, "effort_year", "season_year")).orderBy("kind", "item")
    )


@query("harvest_totals", f"SELECT season_year, entity, {S6} FROM fact WHERE NOT is_subtotal GROUP BY season_year, entity", "fact")
def harvest_totals(s, d):
    # the subtotal cells are never built here: base lines are aggregated straight away
    return (
        D.lines(s, d).filter(F.col("species") == "O").groupBy("season_year", "entity").agg(F.sum("qty").alias("cnt"))
    )


@query("name_search", """, hit AS (SELECT entity, label, key, starts_with(key, 'nation 1') AS prefix FROM
   (SELECT c_custkey AS entity, c_name AS label, 'nation ' || regexp_extract(lower(c_name), '#0*(\\d+)$', 1) AS key FROM customer) WHERE contains(key, 'nation 1') OR contains(key, '77'))
  SELECT entity, label, CAST(row_number() OVER (ORDER BY CASE WHEN prefix THEN 0 ELSE 1 END, key, entity) AS INT) AS pos FROM hit
  QUALIFY pos <= 8""".lstrip(", ").replace("hit AS", "WITH hit AS", 1))
def name_search(s, d):
    from starslice.operators.search import name_search as search

    names = D.table(s, d, "customer").select(
        F.col("c_custkey").alias("entity"), F.col("c_name").alias("label"),
        F.concat(F.lit("Nation "), F.regexp_extract(F.lower("c_name"), r"#0*(\d+)$", 1)).alias("key"),
    )
    return search(names, ["nation 1", "77"], "key", "entity", 8).select("entity", "label", "pos")


@query("search_log", """WITH names AS (SELECT c_custkey AS entity, 'nation ' || regexp_extract(lower(c_name), '#0*(\\d+)$', 1) AS key FROM customer),
  log AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'nation ' || (o_custkey % 29) WHEN 1 THEN CAST(o_orderkey % 500 AS VARCHAR) WHEN 2 THEN 'on ' || (o_custkey % 7) ELSE '' END AS needle FROM orders),
  hit AS (SELECT needle, entity, row_number() OVER (PARTITION BY needle ORDER BY CASE WHEN starts_with(key, needle) THEN 0 ELSE 1 END, key, entity) AS pos FROM (SELECT DISTINCT needle FROM log WHERE needle <> '') JOIN names ON contains(key, needle) QUALIFY pos <= 8)
  SELECT o_orderkey, entity, CAST(pos AS INT) AS pos FROM log JOIN hit USING (needle)""")
def search_log(s, d):
    """A log of searches, one an order; a quarter of them are empty."""
    from starslice.operators.search import search_log as searched

    names = D.table(s, d, "customer").select(
        F.col("c_custkey").alias("entity"), F.concat(F.lit("Nation "), F.regexp_extract(F.lower("c_name"), r"#0*(\d+)$", 1)).alias("name"))
    o, kind = F.col("o_orderkey"), F.col("o_orderkey") % 4
    needle = (
        F.when(kind == 0, F.concat(F.lit("NATION "), (F.col("o_custkey") % 29).cast("string"))).when(kind == 1, (o % 500).cast("string"))
        .when(kind == 2, F.concat(F.lit("On "), (F.col("o_custkey") % 7).cast("string"))).otherwise("")
    )
    log = D.table(s, d, "orders").select("o_orderkey", needle.alias("needle"))
    return searched(log, names, "needle", "name", "entity").select("o_orderkey", "entity", "pos")
