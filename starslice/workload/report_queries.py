"""Composite reports."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from starslice.plans import metrics as M
from starslice.plans import reports as R
from starslice.plans.spec import SliceSpec
from starslice.runtime import ratio, settle
from starslice.sources import driver_tables as D
from starslice.workload.registry import query
from starslice.workload.windows import RANKED, star

O = SliceSpec(species="O")  # noqa: E741


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


BOARD = f"""{RANKED}, b AS (SELECT *, array_to_string(list(v) OVER (PARTITION BY entity ORDER BY season_year ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), ',') AS spark, lag(rank) OVER (PARTITION BY entity ORDER BY season_year) AS pr FROM ranked)
  SELECT entity, name, region, CAST(v AS DOUBLE) AS value, round(v / area, 6) AS value2, rank, CAST(pr - rank AS INT) AS delta, spark, round(v / CAST((SELECT sum(v) FROM series WHERE season_year = 2000) AS DOUBLE), 6) AS share FROM b WHERE season_year = 2000"""


def _board(s, d, **kw):
    out = R.leaderboard(star(s, d), O, 2000, "count", "per_sqmi", **kw)
    return rounded(out, "value2", "share").withColumn("spark", F.array_join(F.col("spark").cast("array<string>"), ","))


@query("leaderboard", BOARD, "series")
def leaderboard(s, d):
    return _board(s, d)


@query("leaderboard_top15", f"{BOARD} ORDER BY rank, entity LIMIT 15", "series")
def leaderboard_top15(s, d):
    return _board(s, d, limit=15)


@query("leaderboard_sorted", f"{BOARD} ORDER BY delta DESC NULLS LAST, rank NULLS LAST, entity LIMIT 9", "series")
def leaderboard_sorted(s, d):
    return _board(s, d, limit=9, sort="delta", ascending=False)


@query("map_values", """z AS (SELECT avg(v / area) AS m, stddev_pop(v / area) AS sd FROM series WHERE season_year = 1999 AND v > 0)
  SELECT 'entity' AS grain, entity, season_year, round((v / area - m) / sd, 6) AS value FROM series, z WHERE season_year = 1999
  UNION ALL SELECT 'total', NULL, season_year, CAST(sum(v) AS DOUBLE) FROM series GROUP BY season_year UNION ALL SELECT 'selected', entity, season_year, CAST(v AS DOUBLE) FROM series WHERE entity = 6""", "series")
def map_values(s, d):
    df = M.metric_frame(star(s, d), O, ["zscore"])
    v = F.col("base").cast("double")
    now = df.filter("season_year = 1999").select(F.lit("entity").alias("grain"), "entity", "season_year", F.round("zscore", 6).alias("value"))
    total = df.groupBy("season_year").agg(F.sum(v).alias("value")).select(F.lit("total").alias("grain"), F.lit(None).cast("int").alias("entity"), "season_year", "value")
    one = df.filter("entity = 6").select(F.lit("selected").alias("grain"), "entity", "season_year", v.alias("value"))
    return now.unionByName(total).unionByName(one)


@query("stats_strip", """SELECT CAST(sum(v) AS BIGINT) AS total, count(CASE WHEN v > 0 THEN 1 END) AS reporting, count(*) AS in_scope, (SELECT entity FROM series WHERE season_year = 2001 AND region = 'AFRICA' ORDER BY v / area DESC, entity LIMIT 1) AS top_entity,
  round(max(v / area), 6) AS top_value FROM series WHERE season_year = 2001 AND region = 'AFRICA'""", "series")
def stats_strip(s, d):
    return rounded(R.stats_strip(star(s, d), O.patch(region="AFRICA"), 2001, "per_sqmi"), "top_value")


@query("entity_card", f"""r AS (SELECT *, CAST(rank() OVER (ORDER BY v DESC) AS INT) AS sr, CAST(rank() OVER (PARTITION BY region ORDER BY v DESC) AS INT) AS rr FROM series WHERE season_year = 2000 AND v > 0), {RANKED}
  SELECT name, CAST(v AS DOUBLE) AS value, sr AS state_rank, (SELECT count(*) FROM r) AS state_ranked, rr AS region_rank, (SELECT count(*) FROM r x WHERE x.region = r.region) AS region_ranked,
   CAST((SELECT count(*) FROM ranked q WHERE q.entity = 11 AND q.season_year <= 2000 AND q.season_year > coalesce((SELECT max(season_year) FROM ranked p WHERE p.entity = 11 AND p.season_year <= 2000 AND (p.rank IS NULL OR p.rank > 10)), 0)) AS INT) AS streak
  FROM r WHERE entity = 11""", "series")
def entity_card(s, d):
    return R.entity_card(star(s, d), O, "count", 11, 2000)


@query("avg_positive", "SELECT season_year, CAST(max(CASE WHEN entity = 11 THEN v END) AS BIGINT) AS own, CAST(round(avg(CASE WHEN v > 0 THEN v END)) AS BIGINT) AS average FROM series GROUP BY season_year", "series")
def avg_positive(s, d):
    return R.average_line(star(s, d), O, 11)


@query("avg_density", "SELECT season_year, round(max(CASE WHEN entity = 5 THEN fh + ah END), 6) AS own, round(avg(fh + ah), 1) AS average FROM effort GROUP BY season_year HAVING avg(fh + ah) IS NOT NULL", "effort")
def avg_density(s, d):
    return rounded(R.density_trend(D.effort(s, d), 5), "own")


@query("pressure_card", """m AS (SELECT s.entity, fh, ah, area, CASE WHEN (fh + ah) * area > 0 THEN v / ((fh + ah) * area) END AS dph, fh + ah AS den FROM series s LEFT JOIN effort e ON e.entity = s.entity AND e.season_year = s.season_year WHERE s.season_year = 2000),
  r AS (SELECT *, CASE WHEN dph > 0 THEN 1 + (SELECT count(*) FROM m x WHERE x.dph > m.dph) END AS rd, CASE WHEN den > 0 THEN 1 + (SELECT count(*) FROM m x WHERE x.den > m.den) END AS rh FROM m)
  SELECT round(fh, 6) AS firearms, round(ah, 6) AS archery, round((fh + ah) * area / 10) * 10 AS hunters, round(dph, 6) AS per_hunter, CAST(rd AS INT) AS rank_per_hunter, (SELECT count(rd) FROM r) AS ranked_per_hunter,
    CAST(rh AS INT) AS rank_density, (SELECT count(rh) FROM r) AS ranked_density FROM r WHERE entity = 5""", "series effort")
def pressure_card(s, d):
    return rounded(R.pressure_card(D.star(s, d, side=("effort",)).settled("effort"), O, 5, 2000, 10), "firearms", "archery", "per_hunter")


@query("region_effort", """SELECT region, s.season_year, count(*) AS members, round(sum((fh + ah) * s.area) / sum(s.area), 6) AS density, round(sum(v) / sum((fh + ah) * s.area), 6) AS per_hunter
  FROM series s JOIN effort e ON e.entity = s.entity AND e.season_year = s.season_year WHERE fh IS NOT NULL AND ah IS NOT NULL GROUP BY region, s.season_year""", "series effort")
def region_effort(s, d):
    return rounded(R.region_effort(D.star(s, d, side=("effort",)), O), "density", "per_hunter")


@query("region_share", """t AS (SELECT season_year, region, CAST(sum(v) AS BIGINT) AS v FROM series GROUP BY season_year, region)
  SELECT season_year, region, v, round(v / CAST(sum(v) OVER (PARTITION BY season_year) AS DOUBLE), 6) AS share, row_number() OVER (PARTITION BY season_year ORDER BY v DESC, region) = 1 AS top FROM t""", "series")
def region_share(s, d):
    from starslice.operators import ranking as K
    from starslice.operators import series as S

    dense = star(s, d).measures(O, {"v": O})
    per = dense.groupBy("season_year", "region").agg(F.sum("v").alias("v"))
    lead = K.argmax(["season_year"], per, "v", "region").select("season_year", F.col("region").alias("first"))
    out = S.share(per, "v").join(lead, "season_year")
    return rounded(out.select("season_year", "region", "v", "share", (F.col("region") == F.col("first")).alias("top")), "share")


@query("trend_overlays", """x AS (SELECT CAST(entity AS VARCHAR) AS line, season_year, v FROM series WHERE entity IN (1, 8) AND season_year >= 1996 UNION ALL SELECT 'total', season_year, CAST(sum(v) AS BIGINT) FROM series WHERE region = 'ASIA' AND season_year >= 1996 GROUP BY season_year),
  k AS (SELECT line, season_year, CASE WHEN season_year NOT IN (SELECT season_year FROM partial) THEN v END AS v FROM x)
  SELECT 'index' AS mode, line, season_year, round(100 * v / CAST(first_value(v IGNORE NULLS) OVER (PARTITION BY line ORDER BY season_year ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS DOUBLE), 6) AS value FROM k
  UNION ALL SELECT 'count', line, season_year, CAST(v AS DOUBLE) FROM x WHERE line <> 'total'""", "series")
def trend_overlays(s, d):
    st, spec = star(s, d), O.patch(region="ASIA", year_from=1996)
    modes = [R.trend_lines(st, spec, [1, 8], m).withColumn("mode", F.lit(m)) for m in ("index", "count")]
    return rounded(modes[0].unionByName(modes[1]), "value")


@query("compare_series", """y AS (SELECT species, season_year, CASE WHEN bool_or(season = 'fall') THEN coalesce(sum(CASE WHEN NOT is_subtotal AND method = 'firearm' THEN cnt END), 0) END AS v FROM fact0 WHERE season_year >= 1996 GROUP BY species, season_year),
  i AS (SELECT species, season_year, round(100 * v / CAST(first_value(CASE WHEN v > 0 THEN v END IGNORE NULLS) OVER (PARTITION BY species ORDER BY season_year ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS DOUBLE), 6) AS value FROM y)
  SELECT coalesce(a.season_year, b.season_year) AS season_year, a.value AS first, b.value AS second FROM (SELECT * FROM i WHERE species = 'O') a FULL JOIN (SELECT * FROM i WHERE species = 'F') b ON a.season_year = b.season_year""", "fact")
def compare_series(s, d):
    whole = D.star(s, d, "")
    return rounded(R.compare_species(whole, SliceSpec(year_from=1996, method="firearm", season="fall"), ("O", "F")), "first", "second")


GATED = """y AS (SELECT species, season_year, CASE WHEN species <> 'F' OR bool_or(season = 'fall') THEN coalesce(sum(CASE WHEN NOT is_subtotal THEN cnt END), 0) END AS v FROM fact0 WHERE season_year >= 1996 AND (season = 'spring' OR season_year < 1998) GROUP BY species, season_year),
  i AS (SELECT species, season_year, round(100 * v / CAST(first_value(CASE WHEN v > 0 THEN v END IGNORE NULLS) OVER (PARTITION BY species ORDER BY season_year ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS DOUBLE), 6) AS value FROM y)"""


def _spring_since_1998(s, d):
    whole = D.star(s, d, "")
    return replace(whole, fact=whole.fact.filter("season = 'spring' OR season_year < 1998"), reread=None)


@query("compare_series_gated", f"""{GATED} SELECT coalesce(a.season_year, b.season_year) AS season_year, a.value AS first, b.value AS second FROM (SELECT * FROM i WHERE species = 'O') a FULL JOIN (SELECT * FROM i WHERE species = 'F') b ON a.season_year = b.season_year""", "fact")
def compare_series_gated(s, d):
    """Autumn rows end with 1997; only the second species is one whose periods can be partial."""
    return rounded(R.compare_species(_spring_since_1998(s, d), SliceSpec(year_from=1996), ("O", "F"), may_be_partial=("F",)), "first", "second")


@query("trend_index_gated", f"{GATED} SELECT season_year, value FROM i WHERE species = 'O'", "fact")
def trend_index_gated(s, d):
    """The index line of a species without partial periods keeps periods that have spring rows only."""
    lines = R.trend_lines(_spring_since_1998(s, d).only("O"), SliceSpec(year_from=1996), [], "index", may_be_partial=False)
    return rounded(lines.select("season_year", "value"), "value")


@query("season_stats", """SELECT season_year, round(sum(CASE WHEN portion IN ('fall_opening', 'spring_opening') THEN cnt END) / CAST(sum(CASE WHEN portion IN ('fall_main', 'spring_main') THEN cnt END) AS DOUBLE), 6) AS opening_share,
  round(coalesce(sum(CASE WHEN NOT is_subtotal AND youth THEN cnt END), 0) / CAST(sum(CASE WHEN NOT is_subtotal AND method = 'firearm' THEN cnt END) AS DOUBLE), 6) AS youth_share,
  round(sum(CASE WHEN NOT is_subtotal AND season = 'spring' THEN cnt END) / CAST(sum(CASE WHEN NOT is_subtotal AND season = 'fall' THEN cnt END) AS DOUBLE), 6) AS spring_fall FROM fact WHERE entity = 5 GROUP BY season_year""", "fact")
def season_stats(s, d):
    return rounded(R.season_stats(D.star(s, d), O.patch(region="ASIA"), entity=5), "opening_share", "youth_share", "spring_fall")


NEAR = """me AS (SELECT lon, lat FROM dim WHERE entity = 12), near AS (SELECT dim.entity, pow((dim.lon - me.lon) * cos(radians(me.lat)), 2) + pow(dim.lat - me.lat, 2) AS dist FROM dim, me WHERE dim.entity <> 12 ORDER BY dist, dim.entity LIMIT 5)"""


@query("neighbors_compared", f"{NEAR}, {RANKED} SELECT entity, name, CAST(v AS DOUBLE) AS value, rank, entity = 12 AS self FROM ranked WHERE season_year = 1999 AND (entity = 12 OR entity IN (SELECT entity FROM near))", "series")
def neighbors_compared(s, d):
    return R.neighbors_compared(star(s, d), O, "count", 12, 1999)


@query("nearest_k", """pts AS (SELECT c_custkey AS entity, ((c_custkey * 7919) % 10007) / 100.0 AS lon, ((c_custkey * 104729) % 10009) / 200.0 AS lat FROM customer), me AS (SELECT lon, lat FROM pts WHERE entity = 17)
  SELECT pts.entity, round(pow((pts.lon - me.lon) * cos(radians(me.lat)), 2) + pow(pts.lat - me.lat, 2), 6) AS dist FROM pts, me WHERE pts.entity <> 17 ORDER BY dist, pts.entity LIMIT 5""".replace("pts AS", "WITH pts AS", 1))
def nearest_k(s, d):
    key = F.col("c_custkey")
    pts = D.table(s, d, "customer").select(
        key.alias("entity"), (F.pmod(key * 7919, F.lit(10007)) / 100.0).alias("lon"), (F.pmod(key * 104729, F.lit(10009)) / 200.0).alias("lat")
    )
    return R.nearest(pts, 17, 5).select("entity", F.round("dist", 6).alias("dist"))


@query("nearest_all", """WITH pts AS (SELECT c_custkey AS entity, ((c_custkey * 7919) % 10007) / 100.0::DOUBLE AS lon, ((c_custkey * 104729) % 10009) / 200.0::DOUBLE AS lat FROM customer),
  d AS (SELECT a.entity, b.entity AS neighbor, pow((b.lon - a.lon) * cos(radians(a.lat)), 2) + pow(b.lat - a.lat, 2) AS dist FROM pts a JOIN pts b ON a.entity <> b.entity)
  SELECT entity, neighbor, round(dist, 6) AS dist, CAST(row_number() OVER (PARTITION BY entity ORDER BY dist, neighbor) AS INT) AS pos FROM d QUALIFY pos <= 5""")
def nearest_all(s, d):
    from starslice.operators.nearest import nearest_all as every

    key = F.col("c_custkey")
    pts = D.table(s, d, "customer").select(
        key.alias("entity"), (F.pmod(key * 7919, F.lit(10007)) / 100.0).alias("lon"), (F.pmod(key * 104729, F.lit(10009)) / 200.0).alias("lat")
    )
    return every(pts, 5).withColumn("dist", F.round("dist", 6))


H2H = """mem AS (SELECT 0 AS side, false AS isr, entity FROM dim WHERE entity = 4 UNION ALL SELECT 1, true, entity FROM dim WHERE region = 'ASIA'),
  ab AS (SELECT entity, season_year, sum(CASE WHEN class = 'A' THEN cnt END) AS b, sum(CASE WHEN class = 'N' THEN cnt END) AS n FROM fact WHERE NOT is_subtotal GROUP BY ALL),
  cell AS (SELECT season_year, portion, entity, sum(cnt) AS d FROM fact WHERE NOT is_subtotal GROUP BY ALL), ex AS (SELECT entity, season_year, sum(attr_a) AS num, sum(coalesce(d, 0)) AS den FROM attrs LEFT JOIN cell USING (season_year, portion, entity) GROUP BY ALL),
  ln AS (SELECT side, isr, s.season_year, sum(v) AS v, sum(area) AS area, sum(b) AS b, sum(n) AS n, sum(num) AS num, sum(ex.den) AS den, sum(CASE WHEN fh + ah IS NOT NULL THEN (fh + ah) * area END) AS hunters, sum(CASE WHEN fh + ah IS NOT NULL THEN area END) AS ea, sum(CASE WHEN fh + ah IS NOT NULL THEN v END) AS ev
    FROM series s JOIN mem USING (entity) LEFT JOIN ab ON ab.entity = s.entity AND ab.season_year = s.season_year LEFT JOIN ex ON ex.entity = s.entity AND ex.season_year = s.season_year LEFT JOIN effort e ON e.entity = s.entity AND e.season_year = s.season_year GROUP BY side, isr, s.season_year),
  w AS (SELECT *, lag(v) OVER (PARTITION BY side ORDER BY season_year) AS prev, avg(v) OVER (PARTITION BY side ORDER BY season_year ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS avg5, max(v) OVER (PARTITION BY side) AS best,
    first_value(season_year) OVER (PARTITION BY side ORDER BY v DESC, season_year) AS byr FROM ln), now AS (SELECT * FROM w WHERE season_year = 2000),
  rg AS (SELECT region, sum(v) AS v FROM series WHERE season_year = 2000 GROUP BY region),
  rk AS (SELECT side, CASE WHEN isr THEN 1 + (SELECT count(*) FROM rg WHERE rg.v > now.v) ELSE 1 + (SELECT count(*) FROM series s WHERE s.season_year = 2000 AND s.v > now.v) END AS rk FROM now),
  long AS (SELECT side, unnest(['harvest', 'per_area', 'rank', 'change', 'avg5', 'buck_doe', 'hunters_per_area', 'per_hunter', 'attribute_share', 'best', 'best_year']) AS stat,
    unnest([CAST(v AS DOUBLE), v / area, CAST(rk AS DOUBLE), v / CAST(prev AS DOUBLE) - 1, avg5, b / CAST(n AS DOUBLE), hunters / ea, ev / hunters, num / CAST(den AS DOUBLE), CAST(best AS DOUBLE), CAST(byr AS DOUBLE)]) AS val FROM now JOIN rk USING (side)),
  h2h AS (SELECT stat, round(max(CASE WHEN side = 0 THEN val END), 6) AS a, round(max(CASE WHEN side = 1 THEN val END), 6) AS b FROM long GROUP BY stat)"""


def _h2h(s, d):
    st = D.settled(s, d, "fact", "dim", "attrs", "effort")
    return rounded(R.h2h_stats(st, O, ("4", "region:ASIA"), 2000), "a", "b")


@query("h2h_stats", f"{H2H} SELECT stat, a, b FROM h2h", "series effort attrs")
def h2h_stats(s, d):
    return _h2h(s, d).select("stat", "a", "b")


@query("h2h_winner", f"{H2H}, w2 AS (SELECT stat, CASE WHEN a <> b AND stat NOT IN ('rank', 'hunters_per_area', 'best_year') THEN CASE WHEN a > b THEN 'a' ELSE 'b' END END AS winner FROM h2h) SELECT stat, winner, count(CASE WHEN winner = 'a' THEN 1 END) OVER () AS score_a, count(CASE WHEN winner = 'b' THEN 1 END) OVER () AS score_b FROM w2", "series effort attrs")
def h2h_winner(s, d):
    won = R.h2h_winners(settle(_h2h(s, d), "h2h"))
    score = R.h2h_score(won)
    return won.withColumn("score_a", score.select("a").scalar()).withColumn("score_b", score.select("b").scalar())


@query("fill_rate", """SELECT o_orderpriority AS permit_type, CAST(year(o_orderdate) AS INT) AS season_year, count(*) AS issued, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS filled,
  round(count(CASE WHEN o_orderstatus = 'F' THEN 1 END) / CAST(count(*) AS DOUBLE), 6) AS fill_rate FROM orders GROUP BY ALL""")
def fill_rate(s, d):
    per = D.table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("permit_type"), F.year("o_orderdate").alias("season_year")).agg(
        F.count("*").alias("issued"), F.count_if(F.col("o_orderstatus") == "F").alias("filled")
    )
    return per.withColumn("fill_rate", F.round(ratio("filled", "issued"), 6))
