"""Query registry: a Spark query and the independent SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

LINES = """base AS (
  SELECT l_linestatus AS species, CAST(year(o_orderdate) AS INT) AS season_year,
    CASE WHEN month(o_orderdate) >= 9 THEN 'fall' ELSE 'spring' END AS season,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'main' WHEN '2-HIGH' THEN 'archery' WHEN '3-MEDIUM' THEN 'youth'
      WHEN '4-NOT SPECIFIED' THEN 'managed' ELSE 'late' END AS kind,
    day(o_orderdate) <= 7 AS opening, c_nationkey AS entity, l_returnflag AS class, CAST(l_quantity AS BIGINT) AS qty,
    o_custkey, l_discount, l_tax
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""
FACT = """r0 AS (
  SELECT species, season_year, season, kind, false AS is_subtotal, entity, class, qty FROM base
  UNION ALL SELECT species, season_year, season, 'opening', true, entity, class, qty FROM base WHERE kind = 'main' AND opening
  UNION ALL SELECT species, season_year, season, 'total', true, entity, class, qty FROM base),
fact0 AS (SELECT species, season_year, season, concat(season, '_', kind) AS portion,
    CASE kind WHEN 'archery' THEN 'archery' WHEN 'managed' THEN 'mixed' WHEN 'total' THEN 'mixed' ELSE 'firearm' END AS method,
    kind = 'youth' AS youth, is_subtotal, entity, class, CAST(SUM(qty) AS BIGINT) AS cnt
  FROM r0 GROUP BY species, season_year, season, kind, is_subtotal, entity, class),
fact AS (SELECT * FROM fact0 WHERE species = 'O')"""
DIM = """dim AS (SELECT n_nationkey AS entity, n_name AS name, r_name AS region,
    CAST((SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS DOUBLE) AS area,
    CAST(n_nationkey % 5 AS DOUBLE) AS lon, CAST(n_nationkey // 5 AS DOUBLE) AS lat
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""
ATTRS = """attrs0 AS (SELECT species, season_year, concat(season, '_', kind) AS portion, entity,
    CAST(SUM(CASE WHEN l_discount > 0.05 THEN qty ELSE 0 END) AS BIGINT) AS attr_a,
    CAST(SUM(CASE WHEN l_tax < 0.02 THEN qty ELSE 0 END) AS BIGINT) AS attr_b
  FROM base WHERE (season_year >= 1999 OR (season_year = 1998 AND season = 'fall' AND kind = 'archery')) AND entity % 7 <> 3
  GROUP BY species, season_year, season, kind, entity),
attrs AS (SELECT * FROM attrs0 WHERE species = 'O')"""
EFFORT = """effort AS (SELECT c_nationkey AS entity, CAST(year(o_orderdate) AS INT) AS season_year,
    CASE WHEN year(o_orderdate) >= 1997 THEN count(DISTINCT CASE WHEN o_orderpriority IN ('1-URGENT','3-MEDIUM','5-LOW') THEN o_custkey END) / max(area) END AS fh,
    CASE WHEN year(o_orderdate) >= 1998 THEN count(DISTINCT CASE WHEN o_orderpriority = '2-HIGH' THEN o_custkey END) / max(area) END AS ah
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN dim ON dim.entity = c_nationkey
  WHERE c_nationkey <> 24 GROUP BY c_nationkey, year(o_orderdate))"""
YEARS = "years AS (SELECT DISTINCT season_year FROM fact), grid AS (SELECT * FROM dim, years)"
# dense entity x year with the plain count and the spring count; cmp = like-for-like count
SERIES = """partial AS (SELECT season_year FROM fact GROUP BY season_year HAVING NOT bool_or(season = 'fall')),
series AS (SELECT g.entity, g.name, g.region, g.area, g.season_year,
    CAST(coalesce(sum(CASE WHEN NOT is_subtotal THEN cnt END), 0) AS BIGINT) AS v,
    CAST(coalesce(sum(CASE WHEN NOT is_subtotal AND (season = 'spring' OR NOT EXISTS (SELECT 1 FROM partial)) THEN cnt END), 0) AS BIGINT) AS cmp
  FROM grid g LEFT JOIN fact f ON f.entity = g.entity AND f.season_year = g.season_year
  GROUP BY g.entity, g.name, g.region, g.area, g.season_year)"""
SAMPLES = """samples AS (SELECT user_id % 25 AS entity, CAST(ts AS DATE) AS period, event_type AS split,
    CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS positive FROM events)"""

_NEEDS = {
    "lines": [LINES], "fact": [LINES, FACT], "dim": [DIM], "samples": [SAMPLES],
    "attrs": [LINES, ATTRS], "effort": [DIM, EFFORT],
    "grid": [LINES, FACT, DIM, YEARS], "series": [LINES, FACT, DIM, YEARS, SERIES],
}


def with_ctes(needs: str, sql: str) -> str:
    """Prefix ``sql`` with the shared CTEs named in ``needs`` (space separated)."""
    parts: list[str] = []
    for need in needs.split():
        parts += [p for p in _NEEDS[need] if p not in parts]
    sql = sql.strip()
    if not parts:
        return sql
    joiner = "\n" if sql[:6].upper() == "SELECT" else ",\n"
    return "WITH " + ",\n".join(parts) + joiner + sql


def query(name: str, sql: str | None = None, needs: str = ""):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its SQL twin."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_ctes(needs, sql)
        return fn

    return add
