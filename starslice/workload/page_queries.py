"""Report pages to facts: the autumn cells are printed as HTML pages, with the faults that such pages have, and built back.

One page a period, one table a portion, one row an entity, with printed totals. The markup is tag soup: omitted end tags, a table inside the cell of a
layout table, a table inside a cell, a table that is never closed, character references.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starslice.functions import text as X
from starslice.plans.build import Build, Pins, build_fact
from starslice.sources import driver_tables as D
from starslice.workload.registry import query

# printed title, portion, subtotal, method, youth: in the order of the page
PARTS = [
    ("Archery", "fall_archery", False, "archery", False), ("Main season", "fall_main", False, "firearm", False),
    ("Youth days", "fall_youth", False, "firearm", True), ("Managed hunts", "fall_managed", False, "mixed", False),
    ("Late season", "fall_late", False, "firearm", False), ("Opening days", "fall_opening", True, "firearm", False),
    ("Grand totals", "grand_total", True, "mixed", False),
]
RULES = [(title.lower(), *rest) for title, *rest in PARTS]
HEADERS = {"a": "class:A", "n": "class:N", "r": "class:R", "total": "total"}
CLASSES = ("A", "N", "R")


@dataclass(frozen=True)
class Faults:
    """What is printed wrong, as columns over season_year, portion, entity (and A, N, R, total of a row or of a Total row)."""

    name: Column | None = None
    row_total: Column | None = None
    more: Column | None = None  # added to class A and to the total of a row
    column_total: Column | None = None  # added to the total of the Total row
    total_in: str = ""  # the portion whose Total row stands in a Top 5 table before it
    box: Column | None = None  # added to the totals of the summary box


def spelled(entity: str = "entity") -> Column:
    """A place name in letters: digits don't survive the normalisation of names."""
    return F.concat(F.lit("Land "), F.translate(F.col(entity).cast("string"), "0123456789", "abcdefghij"))


def printed(n: Column) -> Column:
    return F.when(n == 0, "&mdash;").otherwise(F.format_number(n, 0))


def pages(s, d, faults: Faults = Faults()) -> DataFrame:
    """(page_id, species, season_year, source_url, html): one page a period."""
    star = D.star(s, d)
    cells = star.fact.filter("season = 'fall'").withColumn("portion", F.when(F.col("portion") == "fall_total", "grand_total").otherwise(F.col("portion")))
    wide = cells.groupBy("season_year", "portion", "entity").agg(
        *[F.sum(F.when(F.col("class") == c, F.col("cnt")).otherwise(0)).alias(c) for c in CLASSES], F.sum("cnt").alias("total"))
    first = F.min("entity").over(_window()).alias("first")
    wide = wide.select("*", first)
    more = F.coalesce(faults.more, F.lit(0)) if faults.more is not None else F.lit(0)
    name = F.coalesce(faults.name, spelled()) if faults.name is not None else spelled()
    shown = printed(F.col("total") + more)
    shown = F.coalesce(faults.row_total, shown) if faults.row_total is not None else shown
    portion = F.col("portion")
    # the first row of one portion holds a note, which is a table of its own
    note = F.when((portion == "fall_late") & (F.col("entity") == F.col("first")), "<table><tr><td>* estimated</td></tr></table>").otherwise("")
    texts = [F.concat(name, note), printed(F.col("A") + more), printed(F.col("N")), printed(F.col("R")), shown]
    rows = wide.withColumn("line", _line(texts, portion == "fall_main"))
    sums = [F.sum(c).alias(c) for c in CLASSES]
    tables = rows.groupBy("season_year", "portion").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("entity", "line"))), lambda r: r["line"]), "").alias("body"), *sums, F.sum("total").alias("total"))
    extra = faults.column_total if faults.column_total is not None else F.lit(0)
    last = _line([F.lit("Grand&#32;Total"), *[printed(F.col(c)) for c in CLASSES], printed(F.col("total") + extra)], portion == "fall_main")
    head = F.lit("<tr><th>County</th><th>A</th><th>N</th><th>R</th><th>Total</th></tr>")
    away = portion == faults.total_in
    title = F.lit(None).cast("string")
    for text, slug, *_ in PARTS:
        title = F.when(portion == slug, text).otherwise(title)
    top = F.when(away, F.concat(F.lit("<table><caption>Top 5 counties</caption>"), head, last, F.lit("</table>"))).otherwise("")
    table = F.concat(F.lit("<table class=\"report\">"), head, "body", F.when(away, "").otherwise(last), F.when(portion == "fall_managed", "").otherwise("</table>"))
    section = F.concat(F.lit("<h3>Title "), title, F.lit("</h3>"), top, table)
    framed = F.when(portion == "fall_youth", F.concat(F.lit("<table><tr><td>"), section, F.lit("</td></tr></table>"))).otherwise(section)
    order = F.lit(0)
    for k, part in enumerate(PARTS):
        order = F.when(portion == part[1], k).otherwise(order)
    box = faults.box if faults.box is not None else F.lit(0)
    boxed = _line([title, *[printed(F.col(c)) for c in CLASSES], printed(F.col("total") + box)], F.lit(False))
    parts = tables.select("season_year", F.struct(order.alias("k"), framed.alias("html"), boxed.alias("box")).alias("p"))
    ordered = parts.groupBy("season_year").agg(F.sort_array(F.collect_list("p")).alias("p"))
    summary = F.concat(F.lit("<h3>Season Summary</h3><table><tr><td>Season/Portion</td><td>A</td><td>N</td><td>R</td><td>Total</td></tr>"), F.array_join(F.transform("p", lambda x: x["box"]), ""), F.lit("</table>"))
    html = F.concat(F.lit("<html><h2>Report</h2>"), summary, F.array_join(F.transform("p", lambda x: x["html"]), "\n"))
    return ordered.select(F.col("season_year").alias("page_id"), F.lit("O").alias("species"), "season_year", F.lit("reports").alias("source_url"), html.alias("html"))


def _window():
    from pyspark.sql import Window

    return Window.partitionBy("season_year", "portion")


def _line(texts: list[Column], loose: Column) -> Column:
    """A table row; ``loose``: without the end tags, which may be omitted."""
    tight = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), t, F.lit("</td>")) for t in texts], F.lit("</tr>"))
    return F.when(loose, F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td> "), t) for t in texts])).otherwise(tight)


def build(s, d, faults: Faults = Faults(), pins: Pins = Pins(), **options) -> Build:
    dim = D.dim(s, d)
    aliases = dim.select(X.normalize_name(spelled()).alias("alias"), "entity")
    return build_fact(pages(s, d, faults), aliases, RULES, HEADERS, pins=pins, summary_classes=CLASSES, **options)


PAGE = """page AS (SELECT season_year, CASE portion WHEN 'fall_total' THEN 'grand_total' ELSE portion END AS portion, is_subtotal,
    CASE portion WHEN 'fall_total' THEN 'mixed' ELSE method END AS method, youth, entity, class, cnt FROM fact WHERE season = 'fall')"""


@query("page_fact", f"{PAGE} SELECT CAST(season_year AS INT) AS season_year, 'fall' AS season, portion, is_subtotal, method, youth, false AS derived, entity, class, cnt FROM page WHERE cnt <> 0", "fact")
def page_fact(s, d):
    made = build(s, d)
    return made.fact.filter("cnt <> 0").select("season_year", "season", "portion", "is_subtotal", "method", "youth", "derived", "entity", "class", "cnt")


@query("page_errors", f"""{PAGE}, y AS (SELECT DISTINCT season_year AS page_id FROM page), f AS (SELECT season_year, min(entity) AS entity FROM page WHERE portion = 'fall_youth' GROUP BY season_year)
  SELECT page_id, 'column sum differs: total' AS error FROM y WHERE page_id % 3 IN (0, 2) UNION ALL SELECT page_id, unnest(['unknown name: Atlantis', 'no header row']) FROM y WHERE page_id % 3 = 1
  UNION ALL SELECT page_id, 'not a number: n/a' FROM y WHERE page_id % 3 = 2 UNION ALL SELECT f.season_year, 'row sum differs: Land ' || translate(CAST(entity AS VARCHAR), '0123456789', 'abcdefghij') FROM f WHERE f.season_year % 3 = 2
  UNION ALL SELECT page_id, 'portions do not add up to the grand total' FROM y""", "fact dim")
def page_errors(s, d):
    """Every page has one broken table: a wrong total, an unknown name, or a cell that is no number. The portion is lost, and so the page's sum.

    The layout table behind the main season's has that season's title, but no header: where the portion is lost, that is an error as well.
    """
    year, portion, here = F.col("season_year") % 3, F.col("portion"), F.col("entity") == F.col("first")
    faults = Faults(
        name=F.when((year == 1) & (portion == "fall_main") & here, "Atlantis"), row_total=F.when((year == 2) & (portion == "fall_youth") & here, "n/a"),
        column_total=F.when((year == 0) & (portion == "fall_archery"), 1).otherwise(0))
    return build(s, d, faults).errors.select("page_id", "error")


@query("page_totals", f"""{PAGE} SELECT CAST(season_year AS INT) AS season_year, portion, CAST(sum(cnt) AS BIGINT) AS cnt, portion = 'fall_late' AS borrowed FROM page GROUP BY season_year, portion""", "fact")
def page_totals(s, d):
    """One table's Total row stands in the Top 5 table before it, which is skipped otherwise."""
    made = build(s, d, Faults(total_in="fall_late"), borrow_totals=True)
    lent = made.warnings.filter("error = 'total row taken from the table before'").select(F.col("page_id").alias("season_year")).withColumn("portion", F.lit("fall_late"))
    per = made.fact.groupBy("season_year", "portion").agg(F.sum("cnt").alias("cnt"))
    return per.join(lent.withColumn("borrowed", F.lit(True)), ["season_year", "portion"], "left").withColumn("borrowed", F.coalesce("borrowed", F.lit(False)))


@query("page_derived", f"""{PAGE} SELECT CAST(season_year AS INT) AS season_year, portion, entity, class, cnt, portion = 'fall_late' AS derived FROM page WHERE cnt <> 0""", "fact")
def page_derived(s, d):
    """One table's rows are wrong on every page; it is rebuilt as the grand total minus the other portions, which gives its printed totals."""
    years = D.star(s, d).fact.filter("season = 'fall'").select(F.col("season_year").alias("page_id")).distinct()
    parts = [p[1] for p in PARTS if not p[2] and p[1] != "fall_late"]
    pins = Pins(derived=years.select("page_id", F.lit("fall_late").alias("portion"), F.lit("grand_total").alias("total"), F.array(*[F.lit(p) for p in parts]).alias("parts")))
    made = build(s, d, Faults(more=F.when(F.col("portion") == "fall_late", 1)), pins)
    return made.fact.filter("cnt <> 0").select("season_year", "portion", "entity", "class", "cnt", "derived")


@query("page_summary", f"""{PAGE}, t AS (SELECT season_year, CAST(sum(cnt) AS BIGINT) AS n FROM page WHERE portion = 'fall_archery' GROUP BY season_year)
  SELECT CAST(season_year AS INT) AS page_id, concat('summary box differs: Archery ', n + 7, ' ', n) AS error FROM t WHERE season_year % 2 = 0""", "fact")
def page_summary(s, d):
    """The summary box of every second page prints another total for one portion than its table."""
    off = F.when((F.col("season_year") % 2 == 0) & (F.col("portion") == "fall_archery"), 7).otherwise(0)
    return build(s, d, Faults(box=off)).warnings.filter("error LIKE 'summary box%'").select("page_id", "error")
