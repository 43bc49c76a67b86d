"""Reconciliation, pins, de-duplication and publishing on the driver tables.

The tables carry no printed totals, so a "printed" side is derived from the same rows with a
deterministic defect; the rules must find exactly those defects.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from starslice.operators import quality as Q
from starslice.operators.quality import GateClosed
from starslice.plans import metrics as M
from starslice.plans.spec import SliceSpec
from starslice.runtime import literal_rows, settle, shared_dir
from starslice.sources import driver_tables as D
from starslice.sources import publish, scans, sinks
from starslice.workload.registry import query

O = SliceSpec(species="O")  # noqa: E741
CELL = ["season_year", "portion", "entity", "class"]


def cells(s, d):
    return O.apply(D.fact(s, d)).select(*CELL, "cnt")


CELLS = "cells AS (SELECT season_year, portion, entity, class, cnt FROM fact WHERE NOT is_subtotal)"


@query("column_reconcile", f"""{CELLS}, f AS (SELECT season_year, portion, class, CAST(sum(cnt) AS BIGINT) AS found FROM cells GROUP BY ALL)
  SELECT season_year, portion, class, found, found + 7 AS printed FROM f WHERE (season_year + length(portion)) % 5 = 0""", "fact")
def column_reconcile(s, d):
    keys = ["season_year", "portion", "class"]
    found = settle(Q.column_sums(cells(s, d), keys, "cnt"), "sums")
    defect = F.when((F.col("season_year") + F.length("portion")) % 5 == 0, 7).otherwise(0)
    printed = found.select(*keys, (F.col("found") + defect).alias("printed"))
    return Q.reconcile(found, printed, keys, "found", "printed")


@query("row_reconcile", f"""{CELLS}, r AS (SELECT season_year, portion, entity, CAST(sum(cnt) AS BIGINT) AS found FROM cells GROUP BY ALL)
  SELECT season_year, portion, entity, found, found - 3 AS printed FROM r WHERE entity % 9 = 4 AND season_year = 1998""", "fact")
def row_reconcile(s, d):
    keys = ["season_year", "portion", "entity"]
    found = settle(Q.column_sums(cells(s, d), keys, "cnt"), "sums")
    defect = F.when((F.col("entity") % 9 == 4) & (F.col("season_year") == 1998), 3).otherwise(0)
    return Q.reconcile(found, found.select(*keys, (F.col("found") - defect).alias("printed")), keys, "found", "printed")


@query("duplicate_keys", "SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(s, d):
    return Q.duplicate_keys(D.table(s, d, "lineitem"), ["l_partkey", "l_suppkey"])


VALID = """cand AS (SELECT DISTINCT season_year, portion, v AS version FROM fact, (SELECT unnest([0, 1]) AS v) WHERE NOT is_subtotal),
  bad AS (SELECT * FROM cand WHERE (version = 0 AND (season_year + length(portion)) % 4 = 0) OR (version = 1 AND (season_year + length(portion)) % 8 = 0))"""


@query("first_valid_table", f"""{VALID}, t AS (SELECT c.season_year, c.portion, c.version, b.version IS NOT NULL AS isbad FROM cand c LEFT JOIN bad b ON b.season_year = c.season_year AND b.portion = c.portion AND b.version = c.version)
  SELECT season_year, portion, min(CASE WHEN NOT isbad THEN version END) AS chosen, count(CASE WHEN isbad THEN 1 END) AS invalid,
    CASE WHEN bool_and(isbad) THEN 'error' WHEN bool_or(isbad) THEN 'warn' ELSE 'ok' END AS status FROM t GROUP BY season_year, portion""", "fact")
def first_valid_table(s, d):
    # two printed versions of every table; version 0 is off by one for some tables, version 1 for fewer
    keys = ["season_year", "portion"]
    sums = settle(Q.column_sums(cells(s, d), keys, "cnt"), "sums").withColumn("version", F.explode(F.array(F.lit(0), F.lit(1))))
    tag = F.col("season_year") + F.length("portion")
    printed = F.col("found") + F.when(F.when(F.col("version") == 0, tag % 4 == 0).otherwise(tag % 8 == 0), 1).otherwise(0)
    tables = sums.withColumn("printed", printed)
    return Q.first_valid(tables, tables.filter("found <> printed"), keys, "version")


@query("recap_diff", f"""{CELLS}, p AS (SELECT season_year, portion, entity, CAST(sum(cnt) AS BIGINT) AS v FROM cells GROUP BY ALL HAVING sum(cnt) <> 0),
  q AS (SELECT season_year, portion, entity, CASE WHEN entity % 6 = 0 AND season_year = 1997 THEN v + 1 ELSE v END AS v FROM p WHERE NOT (entity = 8 AND season_year = 1999))
  SELECT coalesce(p.season_year, q.season_year) AS season_year, coalesce(p.portion, q.portion) AS portion, coalesce(p.entity, q.entity) AS entity, p.v AS found, q.v AS recap
  FROM p FULL JOIN q ON p.season_year = q.season_year AND p.portion = q.portion AND p.entity = q.entity WHERE p.v IS DISTINCT FROM q.v""", "fact")
def recap_diff(s, d):
    keys = ["season_year", "portion", "entity"]
    primary = settle(Q.column_sums(cells(s, d), keys, "cnt").filter("found <> 0"), "sums")
    y, e = F.col("season_year"), F.col("entity")
    recap = primary.filter(~((e == 8) & (y == 1999))).select(
        *keys, F.when((e % 6 == 0) & (y == 1997), F.col("found") + 1).otherwise(F.col("found")).alias("recap")
    )
    return Q.reconcile(primary, recap, keys, "found", "recap")


@query("derive_by_difference", """x AS (SELECT season_year, entity, class, CAST(sum(CASE WHEN portion = 'fall_total' THEN cnt ELSE -cnt END) AS BIGINT) AS cnt FROM fact WHERE portion IN ('fall_total', 'fall_archery', 'fall_youth', 'fall_managed', 'fall_late') GROUP BY ALL)
  SELECT season_year, entity, class, cnt, true AS derived, false AS negative FROM x WHERE cnt <> 0""", "fact")
def derive_by_difference(s, d):
    fact = D.star(s, d).fact
    return Q.derive_by_difference(fact, "fall_total", ["fall_archery", "fall_youth", "fall_managed", "fall_late"], ["season_year", "entity", "class"], "portion", "cnt")


@query("grand_total_check", """SELECT season_year, season, CAST(sum(CASE WHEN NOT is_subtotal THEN cnt END) AS BIGINT) AS parts, CAST(sum(CASE WHEN portion LIKE '%_total' THEN cnt END) AS BIGINT) AS grand, true AS ok FROM fact GROUP BY ROLLUP(season_year, season)""", "fact")
def grand_total_check(s, d):
    sub = F.col("is_subtotal")
    rolled = D.star(s, d).fact.rollup("season_year", "season").agg(
        F.sum(F.when(~sub, F.col("cnt"))).alias("parts"), F.sum(F.when(F.col("portion").endswith("_total"), F.col("cnt"))).alias("grand")
    )
    return rolled.withColumn("ok", F.col("parts") == F.col("grand"))


@query("summary_check", f"""{CELLS}, t AS (SELECT season_year, portion, CAST(sum(cnt) AS BIGINT) AS found FROM cells GROUP BY ALL)
  SELECT season_year, portion, found, CASE WHEN portion = 'fall_late' THEN found + 2 ELSE found END AS summary, portion = 'fall_late' AS warn FROM t WHERE portion LIKE 'fall%'""", "fact")
def summary_check(s, d):
    keys = ["season_year", "portion"]
    found = settle(Q.column_sums(cells(s, d), keys, "cnt"), "sums")
    late = F.col("portion") == "fall_late"
    box = found.filter(F.col("portion").startswith("fall")).select(*keys, (F.col("found") + F.when(late, 2).otherwise(0)).alias("summary"))
    return box.join(found, keys, "left").withColumn("warn", ~F.col("found").eqNullSafe(F.col("summary")))


@query("fd_violations", "SELECT p_brand, min(p_type || ',' || lpad(CAST(p_size AS VARCHAR), 4, '0')) AS low, max(p_type || ',' || lpad(CAST(p_size AS VARCHAR), 4, '0')) AS high FROM part GROUP BY p_brand HAVING count(DISTINCT (p_type, p_size)) > 1")
def fd_violations(s, d):
    text = lambda c: F.concat_ws(",", f"{c}.p_type", F.lpad(F.col(f"{c}.p_size").cast("string"), 4, "0")).alias(c)
    return Q.dependency_violations(D.table(s, d, "part"), "p_brand", ["p_type", "p_size"]).select("p_brand", text("low"), text("high"))


@query("key_coverage", """a AS (SELECT DISTINCT CASE WHEN o_custkey % 97 = 5 THEN -o_custkey ELSE o_custkey END AS o_custkey FROM orders), b AS (SELECT c_custkey AS o_custkey FROM customer)
  SELECT o_custkey, 'missing' AS side FROM b WHERE o_custkey NOT IN (SELECT o_custkey FROM a) UNION ALL SELECT o_custkey, 'unexpected' FROM a WHERE o_custkey NOT IN (SELECT o_custkey FROM b)""".replace("a AS", "WITH a AS", 1))
def key_coverage(s, d):
    # customers that never ordered, and those whose key is misread in every order
    key = F.when(F.col("o_custkey") % 97 == 5, -F.col("o_custkey")).otherwise(F.col("o_custkey"))
    found, expected = D.table(s, d, "orders").select(key.alias("o_custkey")), D.table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return Q.key_coverage(found, expected, "o_custkey")


@query("group_size_check", """f AS (SELECT CASE WHEN c_custkey % 97 = 5 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END AS c_nationkey, count(*) AS found FROM customer GROUP BY 1), e AS (SELECT c_nationkey, count(DISTINCT o_custkey) AS expected FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
  SELECT c_nationkey, expected, coalesce(found, 0) AS found FROM f FULL JOIN e USING (c_nationkey) WHERE found IS DISTINCT FROM expected""".replace("f AS", "WITH f AS", 1))
def group_size_check(s, d):
    customer = D.table(s, d, "customer").select("c_custkey", "c_nationkey")
    buyers = D.table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    active = customer.join(buyers, "c_custkey", "left_semi")
    # some customers are booked under the next nation
    booked = customer.withColumn("c_nationkey", F.when(F.col("c_custkey") % 97 == 5, (F.col("c_nationkey") + 1) % 25).otherwise(F.col("c_nationkey")))
    return Q.group_sizes(booked, "c_nationkey", active.groupBy("c_nationkey").agg(F.count("*").alias("expected")))


PRINT = """m AS (SELECT region, season_year, avg(fh) AS mean FROM effort JOIN dim USING (entity) WHERE fh IS NOT NULL GROUP BY ALL),
  chk AS (SELECT region, season_year, mean, CASE WHEN season_year = 1999 THEN mean + 0.5 ELSE mean + 0.1 END AS printed FROM m)"""


def _means(s, d):
    eff = settle(D.effort(s, d).join(D.dim(s, d).select("entity", "region"), "entity").filter("fh IS NOT NULL"), "effort")
    by = ["region", "season_year"]
    printed = eff.groupBy(*by).agg((F.avg("fh") + F.when(F.col("season_year") == 1999, 0.5).otherwise(0.1)).alias("printed"))
    return Q.mean_check(eff, by, "fh", printed, 0.15)


@query("avg_reconcile", f"{PRINT} SELECT region, season_year, round(mean, 6) AS mean, round(printed, 6) AS printed, abs(mean - printed) > 0.15 AS violates FROM chk", "effort")
def avg_reconcile(s, d):
    return _means(s, d).withColumns({"mean": F.round("mean", 6), "printed": F.round("printed", 6)})


@query("pinned_tolerance", f"""{PRINT}, pins AS (SELECT region, 1999 AS season_year FROM (VALUES ('AFRICA'), ('ASIA'), ('EUROPE')) v(region) UNION ALL SELECT 'AMERICA', 1998)
  SELECT region, season_year, CASE WHEN abs(mean - printed) > 0.15 THEN 'unpinned' ELSE 'stale' END AS problem FROM chk WHERE (abs(mean - printed) > 0.15) <> ((region, season_year) IN (SELECT (region, season_year) FROM pins))""", "effort")
def pinned_tolerance(s, d):
    pins = literal_rows(s, [("AFRICA", 1999), ("ASIA", 1999), ("EUROPE", 1999), ("AMERICA", 1998)], "region string, season_year int")
    return Q.two_sided(_means(s, d), F.col("violates"), pins, ["region", "season_year"]).select("region", "season_year", "problem")


@query("crosscheck", f"""{CELLS}, own AS (SELECT entity, season_year, CAST(sum(cnt) AS BIGINT) AS own FROM cells WHERE NOT (entity = 13 AND season_year = 1996) GROUP BY ALL),
  rep AS (SELECT entity, season_year, CAST(sum(cnt) AS BIGINT) + CASE WHEN (entity * 7 + season_year) % 11 = 0 THEN CAST(sum(cnt) AS BIGINT) // 10 WHEN (entity * 7 + season_year) % 5 = 0 THEN CAST(sum(cnt) AS BIGINT) // 50 ELSE 0 END AS reported FROM cells GROUP BY entity, season_year)
  SELECT season_year, count(*) AS n, count(CASE WHEN reported = own THEN 1 END) AS exact, count(CASE WHEN abs(reported - own) / CAST(own AS DOUBLE) > 0.01 THEN 1 END) AS over_1pct,
   count(CASE WHEN abs(reported - own) / CAST(own AS DOUBLE) > 0.05 THEN 1 END) AS over_5pct, count(CASE WHEN own IS NULL THEN 1 END) AS missing, count(CASE WHEN abs(reported - own) / CAST(own AS DOUBLE) > 0.05 THEN 1 END) * 10 > count(*) AS failed FROM rep LEFT JOIN own USING (entity, season_year) GROUP BY season_year""", "fact")
def crosscheck(s, d):
    keys = ["entity", "season_year"]
    sums = settle(Q.column_sums(cells(s, d), keys, "cnt"), "sums")
    v, tag = F.col("found"), F.col("entity") * 7 + F.col("season_year")
    reported = sums.select(*keys, (v + F.when(tag % 11 == 0, F.floor(v / 10)).when(tag % 5 == 0, F.floor(v / 50)).otherwise(0)).alias("reported"))
    own = sums.filter(~((F.col("entity") == 13) & (F.col("season_year") == 1996))).select(*keys, v.alias("own"))
    return Q.match_quality(reported, own, keys, "season_year")


@query("pinned_cell_fix", f"""{CELLS} SELECT season_year, portion, entity, class, CASE WHEN entity = 5 THEN cnt - 1 ELSE cnt END AS cnt, entity = 5 AS pinned FROM cells""", "fact")
def pinned_cell_fix(s, d):
    table = settle(cells(s, d), "table")
    # pins for entities 5 and 6; those of entity 6 expect a value that is no longer printed
    pins = table.filter("entity IN (5, 6)").select(*CELL, (F.col("cnt") + F.when(F.col("entity") == 6, 1).otherwise(0)).alias("printed"), (F.col("cnt") - 1).alias("fixed"))
    return Q.apply_cell_pins(table, pins, CELL, "cnt")


@query("stale_pins", f"""{CELLS} SELECT season_year, portion, entity, class, cnt + 1 AS printed, cnt - 1 AS fixed FROM cells WHERE entity = 6""", "fact")
def stale_pins(s, d):
    table = settle(cells(s, d), "table")
    pins = table.filter("entity IN (5, 6)").select(*CELL, (F.col("cnt") + F.when(F.col("entity") == 6, 1).otherwise(0)).alias("printed"), (F.col("cnt") - 1).alias("fixed"))
    return Q.stale_pins(table, pins, CELL, "cnt").select(*CELL, "printed", "fixed")


@query("pinned_nullout", "SELECT entity, season_year, CASE WHEN NOT (season_year = 1998 AND entity IN (2, 9)) THEN round(fh, 6) END AS fh, round(ah, 6) AS ah FROM effort", "effort")
def pinned_nullout(s, d):
    eff = settle(D.effort(s, d), "effort").withColumns({"fh": F.round("fh", 6), "ah": F.round("ah", 6)})
    keys = ["entity", "season_year"]
    pins = eff.filter("season_year = 1998 AND entity IN (2, 9)").select(*keys, F.col("fh").alias("printed"), F.lit(None).cast("double").alias("fixed"))
    return Q.apply_cell_pins(eff, pins, keys, "fh").select("entity", "season_year", "fh", "ah")


@query("pinned_swap", f"""{CELLS} SELECT season_year, portion, class2 AS class, CAST(sum(cnt) AS BIGINT) AS cnt FROM (SELECT *, CASE WHEN season_year = 1999 AND portion = 'spring_main' THEN CASE class WHEN 'A' THEN 'R' WHEN 'R' THEN 'A' ELSE class END ELSE class END AS class2 FROM cells) GROUP BY ALL""", "fact")
def pinned_swap(s, d):
    pins = literal_rows(s, [(1999, "spring_main", "A", "R")], "season_year int, portion string, class_a string, class_b string")
    swapped = Q.swap_classes(cells(s, d), pins, ["season_year", "portion"])
    return swapped.groupBy("season_year", "portion", "class").agg(F.sum("cnt").alias("cnt"))


# -- reports of one key ------------------------------------------------------------------------
REPORTS = """rep AS (SELECT o_custkey AS custkey, o_orderpriority AS priority, CAST(year(o_orderdate) AS INT) AS report, count(*) AS issued, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS filled FROM orders GROUP BY ALL)"""
RKEYS, RVALS = ["custkey", "priority"], ["issued", "filled"]


def reports(s, d):
    o = D.table(s, d, "orders")
    return o.groupBy(F.col("o_custkey").alias("custkey"), F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").alias("report")).agg(
        F.count("*").alias("issued"), F.count_if(F.col("o_orderstatus") == "F").alias("filled")
    )


@query("latest_wins", f"WITH {REPORTS} SELECT custkey, priority, issued, filled, report AS source_report FROM rep QUALIFY row_number() OVER (PARTITION BY custkey, priority ORDER BY report DESC) = 1")
def latest_wins(s, d):
    return Q.latest_wins(reports(s, d), RKEYS, "report", RVALS)


@query("revisions", f"""WITH {REPORTS}, l AS (SELECT *, lag(report) OVER w AS prev_report, lag(issued) OVER w AS prev_issued, lag(filled) OVER w AS prev_filled FROM rep WINDOW w AS (PARTITION BY custkey, priority ORDER BY report))
  SELECT * FROM l WHERE prev_report IS NOT NULL AND (issued <> prev_issued OR filled <> prev_filled)""")
def revisions(s, d):
    return Q.revisions(reports(s, d), RKEYS, "report", RVALS)


# -- detail samples ----------------------------------------------------------------------------
@query("sample_counts", "SELECT CAST(period AS VARCHAR) AS period, count(*) AS n FROM samples GROUP BY period", "samples")
def sample_counts(s, d):
    return D.samples(s, d).groupBy("period").agg(F.count("*").alias("n")).withColumn("period", F.col("period").cast("string"))


@query("sampling_report", "SELECT CAST(period AS VARCHAR) AS period, count(DISTINCT entity) AS rows, count(*) AS samples, CAST(sum(positive) AS BIGINT) AS positives FROM samples GROUP BY period", "samples")
def sampling_report(s, d):
    per = D.samples(s, d).groupBy("period", "entity").agg(F.count("*").alias("samples"), F.sum("positive").alias("positives"))
    return per.groupBy(F.col("period").cast("string").alias("period")).agg(
        F.count("*").alias("rows"), F.sum("samples").alias("samples"), F.sum("positives").alias("positives")
    )


@query("cumulative_to_date", """SELECT entity, CAST(sum(CASE WHEN period = DATE '2024-01-20' THEN 1 ELSE 0 END) AS BIGINT) AS samples, CAST(sum(CASE WHEN period = DATE '2024-01-20' THEN positive ELSE 0 END) AS BIGINT) AS positives,
  count(*) AS cum_samples, CAST(sum(positive) AS BIGINT) AS cum_positives, CAST(min(period) AS VARCHAR) AS since FROM samples WHERE period <= DATE '2024-01-20' GROUP BY entity""", "samples")
def cumulative_to_date(s, d):
    upto = F.lit("2024-01-20").cast("date")
    now = F.col("period") == upto
    return D.samples(s, d).filter(F.col("period") <= upto).groupBy("entity").agg(
        F.count_if(now).alias("samples"), F.sum(F.when(now, F.col("positive")).otherwise(0)).alias("positives"),
        F.count("*").alias("cum_samples"), F.sum("positive").alias("cum_positives"), F.min("period").cast("string").alias("since"),
    )


@query("remainder_bucket", """SELECT entity, count(*) AS samples, CAST(sum(positive) AS BIGINT) AS positives, count(CASE WHEN split = 'click' THEN 1 END) AS click_samples, count(CASE WHEN split = 'view' THEN 1 END) AS view_samples,
  count(CASE WHEN split NOT IN ('click', 'view') THEN 1 END) AS unknown_samples, CAST(sum(CASE WHEN split NOT IN ('click', 'view') THEN positive ELSE 0 END) AS BIGINT) AS unknown_positives, false AS error FROM samples GROUP BY entity""", "samples")
def remainder_bucket(s, d):
    out = Q.remainder_bucket(D.samples(s, d), "entity", "split", ["click", "view"], "positive")
    part = lambda k, f: F.col("splits")[k][f]
    return out.select(
        "entity", "samples", "positives", part("click", "samples").alias("click_samples"), part("view", "samples").alias("view_samples"),
        part("unknown", "samples").alias("unknown_samples"), part("unknown", "positives").alias("unknown_positives"), "error",
    )


@query("bounds_check", """a AS (SELECT entity, CAST(period AS VARCHAR) AS period, count(*) - CASE WHEN entity % 5 = 0 THEN 9 ELSE 0 END AS samples, CAST(sum(positive) AS BIGINT) AS positives FROM samples GROUP BY samples.entity, samples.period)
  SELECT entity, period, samples, positives FROM a WHERE positives > samples""", "samples")
def bounds_check(s, d):
    # reported sample counts are short by 9 for every fifth entity
    short = F.when(F.col("entity") % 5 == 0, 9).otherwise(0)
    per = D.samples(s, d).groupBy("entity", "period").agg(F.count("*").alias("n"), F.sum("positive").alias("positives"))
    return per.select("entity", F.col("period").cast("string").alias("period"), (F.col("n") - short).alias("samples"), "positives").filter("positives > samples")


@query("agg_vs_detail", """p AS (SELECT CAST(period AS VARCHAR) AS period, count(*) AS detail FROM samples GROUP BY samples.period)
  SELECT period, CASE WHEN day(CAST(period AS DATE)) <> 9 THEN detail + CASE WHEN day(CAST(period AS DATE)) % 10 = 3 THEN 1 ELSE 0 END END AS agg, detail FROM p WHERE day(CAST(period AS DATE)) % 10 = 3 OR day(CAST(period AS DATE)) = 9""", "samples")
def agg_vs_detail(s, d):
    day = F.dayofmonth("period")
    detail = settle(D.samples(s, d).groupBy("period").agg(F.count("*").alias("detail")), "detail")
    agg = detail.filter(day != 9).select("period", (F.col("detail") + F.when(day % 10 == 3, 1).otherwise(0)).alias("agg"))
    return Q.reconcile(agg, detail, ["period"], "agg", "detail").select(F.col("period").cast("string").alias("period"), "agg", "detail")


@query("merge_duplicates", """k AS (SELECT CASE WHEN user_id % 25 = 24 THEN 23 ELSE user_id % 25 END AS entity, user_id % 25 = 24 AS alias, user_id % 25 AS raw, count(*) AS samples, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS positives FROM events GROUP BY ALL)
  SELECT entity, CAST(sum(samples) AS BIGINT) AS samples, CAST(sum(positives) AS BIGINT) AS positives, count(*) AS n, bool_or(alias) AS via_alias, count(*) > 1 AND NOT bool_or(alias) AS error FROM k GROUP BY entity""".replace("k AS", "WITH k AS", 1))
def merge_duplicates(s, d):
    # bucket 24 is a known second spelling of 23
    raw = D.samples(s, d).groupBy(F.col("entity").alias("raw")).agg(F.count("*").alias("samples"), F.sum("positive").alias("positives"))
    keyed = raw.withColumn("alias", F.col("raw") == 24).withColumn("entity", F.when(F.col("alias"), F.lit(23).cast("long")).otherwise(F.col("raw")))
    return Q.merge_duplicates(keyed, ["entity"], "alias", ["samples", "positives"])


# -- publishing ---------------------------------------------------------------------------------
def _target(s, name):
    return f"{shared_dir(s)}/starslice/{name}-{uuid.uuid4().hex}"


def _rules(rows):
    return {
        "duplicate cells": Q.duplicate_keys(rows, ["species", *CELL]),
        "portion attributes": Q.dependency_violations(rows, "portion", list(sinks.ATTRIBUTES)),
        "negative": rows.filter("cnt < 0"),
    }


@query("publish_gate", "SELECT species, season_year, count(*) AS n, CAST(sum(cnt) AS BIGINT) AS cnt FROM fact0 GROUP BY ALL", "fact")
def publish_gate(s, d):
    root = _target(s, "published")
    publish.publish(sinks.typed(D.star(s, d, "").fact), root, _rules)
    return publish.published(s, root).groupBy("species", F.col("season_year").cast("int").alias("season_year")).agg(F.count("*").alias("n"), F.sum("cnt").alias("cnt"))


PUBLISHED = """pub AS (SELECT 'OR' AS state, species, season_year, season, portion,
    upper(season[1]) || substr(season, 2) || ' ' || upper(split_part(portion, '_', 2)[1]) || substr(split_part(portion, '_', 2), 2) AS portion_label,
    method, youth, is_subtotal, ends_with(portion, '_managed') AS derived, entity, class, cnt, 'orders/' || season_year || '/' || species AS source_url FROM fact0)"""


@query("published_fact", f"{PUBLISHED} SELECT * FROM pub", "fact")
def published_fact(s, d):
    """A version is published, a second one with repeated cells is refused: readers still get the first one."""
    root = _target(s, "published")
    rows = settle(D.published_rows(D.star(s, d, "").fact), "rows")
    publish.publish(rows, root, _rules)
    try:
        publish.publish(rows.unionByName(rows.filter("class = 'A'")), root, _rules)
        raise AssertionError("repeated cells were published")
    except GateClosed:
        return publish.published(s, root).withColumn("season_year", F.col("season_year").cast("int"))


@query("published_change", """cur AS (SELECT * FROM series WHERE season_year = 2000), prev AS (SELECT entity, cmp FROM series WHERE season_year = 1999)
  SELECT entity, CAST(v AS BIGINT) AS base, round(CASE WHEN p.cmp > 0 THEN c.cmp / CAST(p.cmp AS DOUBLE) - 1 END, 6) AS change FROM cur c LEFT JOIN prev p USING (entity)""", "series")
def published_change(s, d):
    """One period's change over a published table: the manifest names the periods, so two folders of the species are read."""
    root = _target(s, "published")
    publish.publish(sinks.typed(D.star(s, d, "").fact), root, _rules)
    star = publish.published_star(s, root, "O", D.dim(s, d), small=True)
    df = M.metric_frame(star, SliceSpec(species="O"), ["change_yoy"], at=2000).filter("season_year = 2000")
    return df.select("entity", "base", F.round("change_yoy", 6).alias("change"))


@query("pivot_series", f"""{PUBLISHED}, s AS (SELECT DISTINCT state, species, season_year, portion, class, portion_label, source_url, derived FROM pub), e AS (SELECT DISTINCT species, entity FROM fact0)
  SELECT s.state, s.species, s.season_year, s.portion, s.class, s.portion_label, s.source_url, s.derived, string_agg(CAST(coalesce(cnt, 0) AS VARCHAR), ',' ORDER BY e.entity) AS counts
  FROM s JOIN e USING (species) LEFT JOIN fact0 f ON f.species = s.species AND f.season_year = s.season_year AND f.portion = s.portion AND f.class = s.class AND f.entity = e.entity GROUP BY ALL""", "fact")
def pivot_series(s, d):
    series = sinks.pivot_series(D.published_rows(D.star(s, d, "").fact))
    text = F.array_join(F.col("counts").cast("array<string>"), ",")
    return series.select("state", "species", F.col("season_year").cast("int").alias("season_year"), "portion", "class", *sinks.LABELS, text.alias("counts"))


LONG = "SELECT state, species, season_year, portion, class, entity, cnt, season, method, youth, is_subtotal, portion_label, source_url, derived FROM pub WHERE cnt <> 0"


@query("unpivot_series", f"{PUBLISHED} {LONG}", "fact")
def unpivot_series(s, d):
    rows = settle(D.published_rows(D.star(s, d, "").fact), "rows")
    back = sinks.unpivot_series(sinks.pivot_series(rows, size=7), sinks.portion_attributes(rows))
    return back.withColumn("season_year", F.col("season_year").cast("int"))


@query("published_document", f"{PUBLISHED} {LONG}", "fact")
def published_document(s, d):
    """Documents are written and read back as variants, with attributes, labels, state and derived portions."""
    path = _target(s, "documents")
    sinks.write_series(settle(D.published_rows(D.star(s, d, "").fact), "rows"), path)
    return scans.published_series(s, path, D.dim(s, d), "int")


@query("row_array_document", "SELECT species, season_year, portion, entity, attr_a, attr_b FROM attrs0", "attrs")
def row_array_document(s, d):
    """Attribute rows as arrays of mixed types, read back by the names of their columns."""
    path, columns = _target(s, "attributes"), ["species", "season_year", "portion", "entity", "attr_a", "attr_b"]
    sinks.row_array_documents(D.attributes(s, d), columns, columns[:4], "OR", size=500).select("value", "piece").write.partitionBy("piece").text(path)
    return scans.row_arrays(s, path, {"species": "string", "season_year": "int", "portion": "string", "entity": "int", "attr_a": "bigint", "attr_b": "bigint"})


@query("class_unpivot", f"""{CELLS}, w AS (SELECT season_year, portion, entity, sum(CASE WHEN class = 'A' THEN cnt ELSE 0 END) AS A, sum(CASE WHEN class = 'N' THEN cnt ELSE 0 END) AS N, sum(CASE WHEN class = 'R' THEN cnt ELSE 0 END) AS R FROM cells GROUP BY ALL)
  SELECT season_year, portion, entity, class, CAST(cnt AS BIGINT) AS cnt FROM w UNPIVOT (cnt FOR class IN (A, N, R))""", "fact")
def class_unpivot(s, d):
    from starslice.operators.extract import unpivot_classes

    wide = cells(s, d).groupBy("season_year", "portion", "entity").pivot("class", ["A", "N", "R"]).agg(F.sum("cnt")).fillna(0)
    return unpivot_classes(wide, ["season_year", "portion", "entity"], ["A", "N", "R"])
