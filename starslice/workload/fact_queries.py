"""Generated facts for a full period and for a period without autumn rows."""

from __future__ import annotations

from starslice.plans.facts import make_facts
from starslice.plans.spec import SliceSpec
from starslice.sources import driver_tables as D
from starslice.workload.registry import query
from starslice.workload.windows import RANKED

O = SliceSpec(species="O")  # noqa: E741


def g(e: str) -> str:
    return f"format('{{:,}}', CAST(round({e}) AS BIGINT))"


def p(e: str, digits: int = 1) -> str:
    return f"format('{{:.{digits}f}}', round(100.0 * ({e}), {digits})) || '%'"


def x(e: str, digits: int) -> str:
    return f"format('{{:.{digits}f}}', round({e}, {digits}))"


SHARED = """tot AS (SELECT season_year, sum(u) AS t FROM u GROUP BY season_year), now AS (SELECT * FROM u WHERE season_year = {y}),
  rk AS (SELECT *, CASE WHEN u > 0 THEN CAST(rank() OVER (PARTITION BY season_year, u > 0 ORDER BY u DESC) AS INT) END AS rk FROM u),
  ld AS (SELECT season_year, entity, u FROM u QUALIFY row_number() OVER (PARTITION BY season_year ORDER BY u DESC, entity) = 1),
  sk AS (SELECT entity, count(*) AS n FROM rk r WHERE season_year > coalesce((SELECT max(season_year) FROM rk q WHERE q.entity = r.entity AND (q.rk IS NULL OR q.rk > 10)), 0) GROUP BY entity),
  dl AS (SELECT a.entity, a.u - b.u AS d FROM u a JOIN u b ON b.entity = a.entity AND b.season_year = {y} - 1 WHERE a.season_year = {y} AND (a.u > 0 OR b.u > 0)),
  av AS (SELECT avg(t) AS m, count(*) AS n FROM tot WHERE season_year BETWEEN {y} - 5 AND {y} - 1),
  T AS (SELECT t FROM tot WHERE season_year = {y}), Q AS (SELECT t FROM tot WHERE season_year = {y} - 1)"""


def common(y: int, prev_label: str) -> str:
    return f"""SELECT 2 AS priority, 'leader' AS id, CAST(entity AS VARCHAR) AS entity, {g('u')} AS value, 'animals' AS caption FROM ld WHERE season_year = {y}
  UNION ALL SELECT 3, 'yoy', NULL, CASE WHEN T.t > Q.t THEN '+' ELSE '' END || {p('T.t / CAST(Q.t AS DOUBLE) - 1')}, {g('Q.t')} || ' → ' || {g('T.t')} FROM T, Q
  UNION ALL SELECT 4, 'density', CAST(entity AS VARCHAR), {x('u / area', 2)}, 'animals per area' FROM (SELECT * FROM now ORDER BY u / area DESC, entity LIMIT 1)
  UNION ALL SELECT 7, 'streak', CAST(entity AS VARCHAR), CAST(n AS VARCHAR), 'seasons in the top 10' FROM (SELECT * FROM sk WHERE n >= 3 ORDER BY n DESC, entity LIMIT 1)
  UNION ALL SELECT 11, 'gain', CAST(entity AS VARCHAR), '+' || {g('d')}, 'vs {prev_label}' FROM (SELECT * FROM dl WHERE d > 0 ORDER BY d DESC, entity LIMIT 1)
  UNION ALL SELECT 12, 'loss', CAST(entity AS VARCHAR), '−' || {g('-d')}, 'vs {prev_label}' FROM (SELECT * FROM dl WHERE d < 0 ORDER BY d, entity LIMIT 1)
  UNION ALL SELECT 13, 'avg5', NULL, CASE WHEN T.t > m THEN '+' ELSE '' END || {p('T.t / m - 1')}, 'vs ' || n || '-season avg' FROM T, av
  UNION ALL SELECT 14, 'region', NULL, {p('v / CAST((SELECT t FROM T) AS DOUBLE)', 0)}, 'of the state' FROM (SELECT region, sum(u) AS v FROM now GROUP BY region ORDER BY v DESC, region LIMIT 1)"""


DEER = f"""u AS (SELECT *, v AS u FROM series WHERE season_year <= 2000), {SHARED.format(y=2000)},
  ef AS (SELECT e.entity, floor((fh + ah) * area / 10 + 0.5) * 10 AS h, u / ((fh + ah) * area) AS d FROM effort e JOIN now ON now.entity = e.entity WHERE e.season_year = 2000 AND fh + ah > 0),
  st AS (SELECT sum(CASE WHEN portion LIKE '%_opening' THEN cnt END) AS o, sum(CASE WHEN portion LIKE '%_main' THEN cnt END) AS mn, sum(CASE WHEN NOT is_subtotal AND class = 'A' THEN cnt END) AS b, sum(CASE WHEN NOT is_subtotal AND class = 'N' THEN cnt END) AS n,
    sum(CASE WHEN portion LIKE '%_archery' THEN cnt END) AS a, sum(CASE WHEN NOT is_subtotal THEN cnt END) AS al FROM fact WHERE season_year = 2000)
  {common(2000, '1999-00')}
  UNION ALL SELECT 1, 'home', '11', '#' || rk, {g('u')} || ' animals' FROM rk WHERE entity = 11 AND season_year = 2000
  UNION ALL SELECT 5, 'hunters', CAST(entity AS VARCHAR), '≈' || {g('h')}, 'hunters, 2000-01' FROM (SELECT * FROM ef ORDER BY h DESC, entity LIMIT 1)
  UNION ALL SELECT 6, 'dph', CAST(entity AS VARCHAR), {x('d', 2)}, 'per hunter' FROM (SELECT * FROM ef ORDER BY d DESC, entity LIMIT 1)
  UNION ALL SELECT 8, 'opening', NULL, {p('o / CAST(mn AS DOUBLE)', 0)}, 'of the main portion' FROM st UNION ALL SELECT 9, 'buckdoe', NULL, {x('b / CAST(n AS DOUBLE)', 2)}, 'bucks per doe' FROM st
  UNION ALL SELECT 10, 'archery', NULL, {p('a / CAST(al AS DOUBLE)', 0)}, 'archery share' FROM st"""


@query("fact_rows", DEER, "series effort")
def fact_rows(s, d):
    star = D.star(s, d, side=("effort",)).settled("effort")
    return make_facts(star, O, 2000, "deer", home=11, round_to=10).select("priority", "id", "entity", "value", "caption")


TURKEY = f"""u AS (SELECT *, cmp AS u FROM series WHERE season_year <= 2001), {SHARED.format(y=2001)},
  cell AS (SELECT season_year, portion, entity, sum(cnt) AS d FROM fact WHERE NOT is_subtotal GROUP BY ALL),
  sh AS (SELECT entity, sum(attr_a) / CAST(sum(coalesce(d, 0)) AS DOUBLE) AS s FROM attrs LEFT JOIN cell USING (season_year, portion, entity) WHERE season_year = 2001 GROUP BY entity)
  {common(2001, '2000')}
  UNION ALL SELECT 9, 'public', CAST(entity AS VARCHAR), {p('s', 0)}, 'attribute share' FROM (SELECT sh.* FROM sh JOIN now USING (entity) WHERE u >= 50 ORDER BY s DESC, entity LIMIT 1)"""


@query("fact_rows_partial", TURKEY, "series attrs")
def fact_rows_partial(s, d):
    star = D.settled(s, d, "fact", "dim", "attrs")
    return make_facts(star, O, 2001, "turkey").select("priority", "id", "entity", "value", "caption")
