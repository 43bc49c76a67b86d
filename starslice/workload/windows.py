"""Ranks, runs, trends, records and other window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from starslice.operators import ranking as K
from starslice.operators import series as S
from starslice.plans import metrics as M
from starslice.plans.spec import SliceSpec
from starslice.sources import driver_tables as D
from starslice.workload.registry import query

O = SliceSpec(species="O")  # noqa: E741


def star(s, d):
    return D.star(s, d)


def counts(s, d, spec: SliceSpec = O):
    """(star, dense series with the count v)."""
    st = star(s, d)
    return st, st.measures(spec, {"v": spec}).select("entity", "name", "region", "area", "season_year", "v")


RANKED = """ranked AS (SELECT *, CASE WHEN v > 0 THEN CAST(rank() OVER (PARTITION BY season_year, v > 0 ORDER BY v DESC) AS INT) END AS rank FROM series)"""


@query("competition_rank", f"{RANKED} SELECT entity, season_year, v, rank FROM ranked", "series")
def competition_rank(s, d):
    st, df = counts(s, d)
    return K.competition_rank(df, ["season_year"], "v", bounded=st.small).select("entity", "season_year", "v", "rank")


CUSTOMER_YEAR = """cy AS (SELECT o_custkey AS entity, season_year, CAST(sum(qty) AS BIGINT) AS v FROM base GROUP BY o_custkey, season_year)"""


def customer_years(s, d):
    """Per-customer sums: the case where the entity is unbounded."""
    return D.lines(s, d).groupBy(F.col("o_custkey").alias("entity"), "season_year").agg(F.sum("qty").alias("v"))


@query("competition_rank_unbounded", f"{CUSTOMER_YEAR} SELECT entity, season_year, v, CAST(rank() OVER (PARTITION BY season_year ORDER BY v DESC) AS INT) AS rank FROM cy", "lines")
def competition_rank_unbounded(s, d):
    from starslice.runtime import settle

    return K.competition_rank(settle(customer_years(s, d), "customer-years"), ["season_year"], "v")


@query("quantile_breaks_unbounded", f"""{CUSTOMER_YEAR}, p AS (SELECT season_year, v, row_number() OVER (PARTITION BY season_year ORDER BY v) - 1 AS pos, count(*) OVER (PARTITION BY season_year) AS n FROM cy)
  SELECT season_year, CAST(i AS INT) AS pos, v, n AS n_rows FROM p, (SELECT unnest(range(0, 4)) AS i) WHERE pos = ((i + 1) * n) // 5""", "lines")
def quantile_breaks_unbounded(s, d):
    return K.order_statistics(customer_years(s, d), ["season_year"], "v", K.quantile_positions(5))


@query("rank_diverging", """y AS (SELECT a.entity, a.season_year, CASE WHEN b.cmp > 0 THEN round(a.cmp / CAST(b.cmp AS DOUBLE) - 1, 9) END AS change FROM series a LEFT JOIN series b ON b.entity = a.entity AND b.season_year = a.season_year - 1)
  SELECT entity, season_year, round(change, 6) AS change, CASE WHEN change IS NOT NULL THEN CAST(rank() OVER (PARTITION BY season_year, change IS NULL ORDER BY change DESC) AS INT) END AS rank FROM y""", "series")
def rank_diverging(s, d):
    st = star(s, d)
    df = M.metric_frame(st, O, ["change_yoy"]).withColumn("change", F.round("change_yoy", 9))
    ranked = K.competition_rank(df, ["season_year"], "change", positive_only=not M.METRICS["change_yoy"].diverging, bounded=st.small)
    return ranked.select("entity", "season_year", F.round("change", 6).alias("change"), "rank")


@query("ordinal_rank", "SELECT entity, season_year, CAST(row_number() OVER (PARTITION BY season_year ORDER BY v DESC, entity) AS INT) AS rank FROM series", "series")
def ordinal_rank(s, d):
    st, df = counts(s, d)
    return K.ordinal_rank(df, ["season_year"], "v", "entity", bounded=st.small).select("entity", "season_year", "rank")


@query("rank_delta", f"{RANKED} SELECT a.entity, a.season_year, a.rank, CAST(b.rank - a.rank AS INT) AS delta FROM ranked a LEFT JOIN ranked b ON b.entity = a.entity AND b.season_year = a.season_year - 1", "series")
def rank_delta(s, d):
    st, df = counts(s, d)
    return S.with_rank_delta(df, "v", True, st.small).select("entity", "season_year", "rank", "delta")


@query("rank_in_region", """SELECT entity, season_year, region, CASE WHEN v > 0 THEN CAST(rank() OVER (PARTITION BY season_year, region, v > 0 ORDER BY v DESC) AS INT) END AS rank,
  count(CASE WHEN v > 0 THEN 1 END) OVER (PARTITION BY season_year, region) AS ranked FROM series""", "series")
def rank_in_region(s, d):
    st, df = counts(s, d)
    keys = ["season_year", "region"]
    ranked = K.competition_rank(df, keys, "v", bounded=st.small)
    sizes = df.groupBy(*keys).agg(F.count_if(F.col("v") > 0).alias("ranked"))
    return ranked.join(sizes, keys).select("entity", "season_year", "region", "rank", "ranked")


@query("place_rank", """p AS (SELECT 'entity' AS grain, CAST(entity AS VARCHAR) AS place, v FROM series WHERE season_year = 1999 UNION ALL SELECT 'region', region, CAST(sum(v) AS BIGINT) FROM series WHERE season_year = 1999 GROUP BY region)
  SELECT grain, place, v, CASE WHEN v > 0 OR grain = 'region' THEN CAST(rank() OVER (PARTITION BY grain ORDER BY v DESC) AS INT) END AS rank FROM p""", "series")
def place_rank(s, d):
    st, df = counts(s, d)
    now = df.filter("season_year = 1999")
    own = now.select(F.lit("entity").alias("grain"), F.col("entity").cast("string").alias("place"), "v")
    regions = now.groupBy("region").agg(F.sum("v").alias("v")).select(F.lit("region").alias("grain"), F.col("region").alias("place"), "v")
    ranked = K.competition_rank(own, ["grain"], "v", bounded=st.small).unionByName(
        K.competition_rank(regions, ["grain"], "v", positive_only=False, bounded=True)
    )
    return ranked


STREAK = f"""{RANKED}, st AS (SELECT entity, CAST(count(*) AS INT) AS streak FROM ranked r WHERE season_year <= 2000 AND season_year >
    coalesce((SELECT max(season_year) FROM ranked q WHERE q.entity = r.entity AND q.season_year <= 2000 AND (q.rank IS NULL OR q.rank > 10)), 0) GROUP BY entity)"""


@query("top_n_streak", f"{STREAK} SELECT dim.entity, coalesce(streak, 0) AS streak FROM dim LEFT JOIN st USING (entity)", "series")
def top_n_streak(s, d):
    st, df = counts(s, d)
    ranked = K.competition_rank(df, ["season_year"], "v", bounded=st.small)
    return S.top_n_streaks(ranked, 2000, 10)


@query("streak_board", f"{STREAK} SELECT st.entity, streak FROM st JOIN series s ON s.entity = st.entity AND s.season_year = 2000 AND v > 0 WHERE streak >= 2 ORDER BY streak DESC, st.entity LIMIT 10", "series")
def streak_board(s, d):
    st, df = counts(s, d)
    ranked = K.competition_rank(df, ["season_year"], "v", bounded=st.small)
    alive = ranked.filter("season_year = 2000 AND v > 0").select("entity")
    runs = S.top_n_streaks(ranked, 2000, 10).filter("streak >= 2").join(alive, "entity", "left_semi")
    return K.top(runs, 10, F.desc("streak"), "entity")


@query("leader_run", """lead1 AS (SELECT season_year, entity, v FROM series WHERE season_year <= 2000 QUALIFY row_number() OVER (PARTITION BY season_year ORDER BY v DESC, entity) = 1),
  now AS (SELECT entity, v FROM lead1 WHERE season_year = 2000)
  SELECT now.entity, now.v, CAST(count(*) AS INT) AS run FROM lead1, now WHERE season_year > coalesce((SELECT max(season_year) FROM lead1 WHERE season_year < 2000 AND (entity <> now.entity OR v <= 0)), 0) GROUP BY now.entity, now.v""", "series")
def leader_run(s, d):
    _, df = counts(s, d)
    return S.leader_run(df, "v", 2000)


@query("vs_trailing_avg", "SELECT entity, season_year, v, round(avg(v) OVER (PARTITION BY entity ORDER BY season_year ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS avg5 FROM series", "series")
def vs_trailing_avg(s, d):
    _, df = counts(s, d)
    return df.select("entity", "season_year", "v", F.round(S.trailing_average("v"), 6).alias("avg5"))


@query("sparkline", "SELECT entity, season_year, array_to_string(list(v) OVER (PARTITION BY entity ORDER BY season_year ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), ',') AS spark FROM series", "series")
def sparkline(s, d):
    _, df = counts(s, d)
    return df.select("entity", "season_year", F.array_join(S.sparkline("v").cast("array<string>"), ",").alias("spark"))


@query("yoy_change", """SELECT a.entity, a.season_year, round(CASE WHEN b.v > 0 THEN a.v / CAST(b.v AS DOUBLE) - 1 END, 6) AS change FROM series a LEFT JOIN series b ON b.entity = a.entity AND b.season_year = a.season_year - 1""", "series")
def yoy_change(s, d):
    _, df = counts(s, d)
    return df.select("entity", "season_year", F.round(S.change("v", S.previous_calendar("v")), 6).alias("change"))


@query("trend_index", """t AS (SELECT season_year, CAST(sum(v) AS BIGINT) AS v FROM series GROUP BY season_year), kept AS (SELECT season_year, CASE WHEN season_year NOT IN (SELECT season_year FROM partial) THEN v END AS v FROM t)
  SELECT season_year, round(100 * CAST(v AS DOUBLE) / first_value(v IGNORE NULLS) OVER (ORDER BY season_year ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 6) AS value FROM kept""", "series")
def trend_index(s, d):
    from starslice.plans import reports as R

    lines = R.trend_lines(star(s, d), O, [], "index")
    return lines.select("season_year", F.round("value", 6).alias("value"))


@query("share_of_total", "SELECT entity, season_year, v, round(v / CAST(sum(v) OVER (PARTITION BY season_year) AS DOUBLE), 6) AS share FROM series QUALIFY region = 'ASIA'", "series")
def share_of_total(s, d):
    # shares are of the whole state, so the region is applied after the total
    _, df = counts(s, d)
    return S.share(df, "v").filter("region = 'ASIA'").select("entity", "season_year", "v", F.round("share", 6).alias("share"))


@query("percent_mix", """c AS (SELECT p.place, portion, sum(cnt) AS v FROM fact JOIN dim USING (entity) JOIN (VALUES ('4'), ('region:ASIA')) p(place) ON p.place = CAST(entity AS VARCHAR) OR p.place = 'region:' || region
    WHERE NOT is_subtotal AND season_year = 1999 GROUP BY p.place, portion), keys AS (SELECT DISTINCT portion FROM c WHERE v > 0)
  SELECT pl.place, keys.portion, round(100 * CAST(coalesce(v, 0) AS DOUBLE) / (SELECT sum(v) FROM c x WHERE x.place = pl.place), 6) AS pct
  FROM (VALUES ('4'), ('region:ASIA')) pl(place) CROSS JOIN keys LEFT JOIN c ON c.place = pl.place AND c.portion = keys.portion""", "fact dim")
def percent_mix(s, d):
    from starslice.plans import reports as R

    return R.percent_mix(star(s, d), O, ["4", "region:ASIA"], 1999).withColumn("pct", F.round("pct", 6))


@query("record_highest", "SELECT entity, season_year, v, CAST(row_number() OVER (ORDER BY v DESC, entity, season_year) AS INT) AS pos FROM series WHERE v > 0 QUALIFY pos <= 10", "series")
def record_highest(s, d):
    _, df = counts(s, d)
    best = df.filter("v > 0").select("entity", "season_year", "v")
    return K.numbered(best, 10, F.desc("v"), "entity", "season_year")


RECORDS = """pos AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM series WHERE v > 0),
  mb AS (SELECT CAST(greatest(10, floor(coalesce(max(CASE WHEN i = n // 2 THEN v END), 0) * 0.1 + 0.5)) AS BIGINT) AS min_base FROM pos)"""


@query("min_base", f"{RECORDS} SELECT min_base FROM mb", "series")
def min_base(s, d):
    from starslice.plans import reports as R

    st, df = counts(s, d)
    return R.min_base(df, "v", bounded=st.small)


@query("record_changes", f"""{RECORDS}, z AS (SELECT entity, season_year, CASE WHEN v >= (SELECT min_base FROM mb) AND season_year <> 2001 THEN v ELSE 0 END AS v FROM series),
  ch AS (SELECT entity, season_year, v, lag(v) OVER (PARTITION BY entity ORDER BY season_year) AS p FROM z), r AS (SELECT entity, season_year, round(CAST(v AS DOUBLE) / p - 1, 9) AS change FROM ch WHERE p > 0 AND v > 0),
  o AS (SELECT 'jump' AS record, *, CAST(row_number() OVER (ORDER BY change DESC, entity, season_year) AS INT) AS pos FROM r UNION ALL SELECT 'drop', *, CAST(row_number() OVER (ORDER BY change, entity, season_year) AS INT) FROM r)
  SELECT record, entity, season_year, round(change, 6) AS change, pos FROM o WHERE pos <= 10""", "series")
def record_changes(s, d):
    from starslice.plans import reports as R

    return R.record_changes(star(s, d), O).withColumn("change", F.round("change", 6))


@query("best_worst_year", """t AS (SELECT season_year, CAST(sum(v) AS BIGINT) AS v FROM series GROUP BY season_year)
  SELECT 'best' AS record, season_year, v FROM (SELECT * FROM t ORDER BY v DESC, season_year LIMIT 1)
  UNION ALL SELECT 'worst', season_year, v FROM (SELECT * FROM t WHERE v > 0 AND season_year NOT IN (SELECT season_year FROM partial) ORDER BY v, season_year LIMIT 1)""", "series")
def best_worst_year(s, d):
    from starslice.plans import reports as R

    return R.best_worst_year(star(s, d), O)


@query("best_season", "SELECT entity, v, season_year FROM series QUALIFY row_number() OVER (PARTITION BY entity ORDER BY v DESC, season_year) = 1", "series")
def best_season(s, d):
    _, df = counts(s, d)
    return K.argmax(["entity"], df, "v", entity="season_year")


@query("leader_and_runner_up", "SELECT season_year, CAST(pos AS INT) AS pos, entity, v FROM (SELECT *, row_number() OVER (PARTITION BY season_year ORDER BY v DESC, entity) AS pos FROM series) WHERE pos <= 2", "series")
def leader_and_runner_up(s, d):
    st, df = counts(s, d)
    ranked = K.ordinal_rank(df, ["season_year"], "v", "entity", bounded=st.small, name="pos")
    return ranked.filter("pos <= 2").select("season_year", "pos", "entity", "v")


@query("default_pair", """o AS (SELECT CAST(entity AS VARCHAR) AS place, v, entity FROM series WHERE season_year = 1999), a AS (SELECT place FROM o ORDER BY v DESC, entity LIMIT 1),
  b AS (SELECT place FROM o WHERE place <> (SELECT place FROM a) ORDER BY v DESC, entity LIMIT 1), b9 AS (SELECT place FROM o WHERE place <> '9' ORDER BY v DESC, entity LIMIT 1)
  SELECT 'none' AS home, (SELECT place FROM a) AS a, (SELECT place FROM b) AS b UNION ALL SELECT '9', '9', (SELECT place FROM b9)""", "series")
def default_pair(s, d):
    from starslice.plans import reports as R

    _, df = counts(s, d)
    now = df.filter("season_year = 1999")
    return R.default_pair(now, None).unionByName(R.default_pair(now, 9))


@query("portions_ranked", "SELECT portion, CAST(sum(cnt) AS BIGINT) AS cnt, CAST(row_number() OVER (ORDER BY sum(cnt) DESC, portion) AS INT) AS pos FROM fact WHERE NOT is_subtotal AND season_year = 1999 GROUP BY portion HAVING sum(cnt) > 0", "fact")
def portions_ranked(s, d):
    rows = D.star(s, d).slice(O.patch(year_from=1999, year_to=1999))
    per = rows.groupBy("portion").agg(F.sum("cnt").alias("cnt")).filter("cnt > 0")
    return K.ordinal_rank(per, [], "cnt", "portion", name="pos")
