"""Statistics and classification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from starslice.operators import ranking as K
from starslice.operators import stats as T
from starslice.plans import metrics as M
from starslice.plans.spec import SliceSpec
from starslice.sources import driver_tables as D
from starslice.workload.registry import query

O = SliceSpec(species="O")  # noqa: E741
Y = ["season_year"]

DENS = "dens AS (SELECT entity, season_year, round(v / area, 6) AS x FROM series)"
RATIO = """rat AS (SELECT g.entity, g.season_year, CASE WHEN sum(CASE WHEN class = 'N' AND NOT is_subtotal THEN cnt END) > 0 THEN
    round(CAST(coalesce(sum(CASE WHEN class = 'A' AND NOT is_subtotal THEN cnt END), 0) AS DOUBLE) / sum(CASE WHEN class = 'N' AND NOT is_subtotal THEN cnt END), 6) END AS y
  FROM grid g LEFT JOIN fact f ON f.entity = g.entity AND f.season_year = g.season_year GROUP BY ALL)"""
YOY = """yoy AS (SELECT a.entity, a.season_year, round(CASE WHEN b.cmp > 0 THEN a.cmp / CAST(b.cmp AS DOUBLE) - 1 END, 6) AS x
  FROM series a LEFT JOIN series b ON b.entity = a.entity AND b.season_year = a.season_year - 1)"""


def frame(s, d, *metrics):
    st = D.star(s, d)
    df = M.metric_frame(st, O, list(metrics))
    return st, df.select("entity", "season_year", *[F.round(m, 6).alias(m) for m in metrics])


@query("metric_pairs", f"{DENS}, {RATIO} SELECT entity, season_year, x, y FROM dens JOIN rat USING (entity, season_year) WHERE x IS NOT NULL AND y IS NOT NULL", "series")
def metric_pairs(s, d):
    _, df = frame(s, d, "per_sqmi", "buck_doe")
    return T.pairs(df.withColumnsRenamed({"per_sqmi": "x", "buck_doe": "y"}), "x", "y")


def _regr(x, y):
    return f"""SELECT season_year, count(*) AS n, round(regr_slope({y}, {x}), 5) AS slope, round(regr_intercept({y}, {x}), 5) AS intercept, round(regr_r2({y}, {x}), 5) AS r2,
  round(CASE WHEN count(*) > 2 THEN corr({y}, {x}) END, 5) AS r FROM dens JOIN rat USING (entity, season_year) WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY season_year"""


def _regression(s, d, **logs):
    _, df = frame(s, d, "per_sqmi", "buck_doe")
    out = T.regression(df, Y, "per_sqmi", "buck_doe", **logs)
    return out.select("season_year", "n", *[F.round(c, 5).alias(c) for c in ("slope", "intercept", "r2", "r")])


@query("scatter_stats", f"{DENS}, {RATIO} {_regr('x', 'y')}", "series")
def scatter_stats(s, d):
    return _regression(s, d)


@query("scatter_stats_log", f"{DENS}, {RATIO} {_regr('log10(x)', 'log10(y)')}", "series")
def scatter_stats_log(s, d):
    return _regression(s, d, log_x=True, log_y=True)


def _breaks(src: str, k: int = 5, by: str = "season_year") -> str:
    group = f"PARTITION BY {by}" if by else ""
    return f"""SELECT {by + ',' if by else ''} x, row_number() OVER ({group} ORDER BY x) - 1 AS p, count(*) OVER ({group}) AS n FROM {src} WHERE x IS NOT NULL"""


QB = f"""o AS ({_breaks('dens')}), b AS (SELECT season_year, i, max(x) AS x FROM o, (SELECT unnest(range(0, 4)) AS i) WHERE p = ((i + 1) * n) // 5 GROUP BY season_year, i)"""


@query("quantile_breaks", f"{DENS}, {QB} SELECT season_year, CAST(i AS INT) AS pos, x AS value FROM b", "series")
def quantile_breaks(s, d):
    st, df = frame(s, d, "per_sqmi")
    out = K.order_statistics(df, Y, "per_sqmi", K.quantile_positions(5), st.small)
    return out.select("season_year", "pos", F.col("per_sqmi").alias("value"))


@query("quantile_classes", f"{DENS}, {QB} SELECT entity, dens.season_year, CAST((SELECT count(*) FROM b WHERE b.season_year = dens.season_year AND b.x <= dens.x) AS INT) AS class FROM dens", "series")
def quantile_classes(s, d):
    st, df = frame(s, d, "per_sqmi")
    br = K.quantile_breaks(df, Y, "per_sqmi", 5, st.small)
    return df.join(br, Y).select("entity", "season_year", T.class_index(F.col("per_sqmi"), F.col("breaks")).alias("class"))


SEQ = f"""{QB}, mm AS (SELECT season_year, min(x) AS lo, max(x) AS hi FROM dens GROUP BY season_year), k0 AS (SELECT DISTINCT season_year, x FROM b),
  k1 AS (SELECT season_year, x FROM k0 JOIN mm USING (season_year) WHERE x > lo),
  l AS (SELECT season_year, 0 AS c0, lo AS x FROM mm UNION ALL SELECT season_year, row_number() OVER (PARTITION BY season_year ORDER BY x), x FROM k1)
  SELECT season_year, CAST(c0 AS INT) AS class, l.x AS lo, coalesce(lead(l.x) OVER (PARTITION BY season_year ORDER BY c0), hi) AS hi FROM l JOIN mm USING (season_year)"""


@query("choropleth_classes", f"{DENS}, {SEQ}", "series")
def choropleth_classes(s, d):
    st, df = frame(s, d, "per_sqmi")
    return T.class_ranges(T.sequential_breaks(df, Y, "per_sqmi", 5, st.small), Y)


@query("shared_classes", f"{DENS.replace('SELECT entity, season_year,', 'SELECT entity, 0 AS season_year,')}, {SEQ.replace('SELECT season_year, CAST', 'SELECT CAST')}", "series")
def shared_classes(s, d):
    # one scale over all periods, used by small multiples
    st, df = frame(s, d, "per_sqmi")
    return T.class_ranges(T.sequential_breaks(df, [], "per_sqmi", 5, st.small), [])


@query("diverging_classes", f"""{YOY}, o AS (SELECT season_year, x < 0 AS neg, x, row_number() OVER (PARTITION BY season_year, x < 0 ORDER BY x) - 1 AS p, count(*) OVER (PARTITION BY season_year, x < 0) AS n FROM yoy WHERE x IS NOT NULL),
  b AS (SELECT DISTINCT season_year, x FROM o, (SELECT unnest(range(0, 2)) AS i) WHERE p = ((i + 1) * n) // 3 AND x <> 0 UNION SELECT season_year, 0.0 FROM o GROUP BY season_year HAVING bool_or(neg) AND NOT bool_and(neg)),
  mm AS (SELECT season_year, min(x) AS lo, max(x) AS hi FROM o GROUP BY season_year),
  l AS (SELECT season_year, 0 AS c0, lo AS x FROM mm UNION ALL SELECT season_year, row_number() OVER (PARTITION BY season_year ORDER BY x), x FROM b)
  SELECT season_year, CAST(c0 AS INT) AS class, l.x AS lo, coalesce(lead(l.x) OVER (PARTITION BY season_year ORDER BY c0), hi) AS hi FROM l JOIN mm USING (season_year)""", "series")
def diverging_classes(s, d):
    st, df = frame(s, d, "change_yoy")
    df = df.filter("change_yoy IS NOT NULL")
    return T.class_ranges(T.diverging_breaks(df, Y, "change_yoy", 3, st.small), Y)


@query("bubble_scale", f"{YOY} SELECT entity, season_year, round(CASE WHEN x IS NULL THEN 0 ELSE greatest(2, 22 * sqrt(abs(x) / max(abs(x)) OVER (PARTITION BY season_year))) END, 6) AS radius FROM yoy", "series")
def bubble_scale(s, d):
    _, df = frame(s, d, "change_yoy")
    return T.bubble_radius(df, Y, "change_yoy").select("entity", "season_year", F.round("radius", 6).alias("radius"))


@query("equal_width_bins", f"""{DENS} SELECT entity, season_year, CAST(CASE WHEN hi <= lo THEN 0 ELSE least(4, greatest(0, floor((x - lo) / (hi - lo) * 5))) END AS INT) AS bin
  FROM (SELECT *, min(x) OVER (PARTITION BY season_year) AS lo, max(x) OVER (PARTITION BY season_year) AS hi FROM dens)""", "series")
def equal_width_bins(s, d):
    _, df = frame(s, d, "per_sqmi")
    return T.equal_width_bin(df, Y, "per_sqmi", 5).select("entity", "season_year", "bin")
