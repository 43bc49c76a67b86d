"""Regional tables in report texts: ordered lines are read by a fold, so a report is parsed in its own row.

A table is a header, rows of places and a line of totals. The fold keeps the header that is open and the first row behind it, and closes the table at its
total line; what breaks that order is a finding, not a guess.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starslice.functions import text as X
from starslice.operators import extract as E
from starslice.operators import quality as Q

NUMBER = r"-?(?:\d[\d,]*(?:\.\d+)?|\.\d+)"
_STATE = "struct<head: int, first: int, tables: array<struct<head: int, first: int, total: int>>, faults: array<struct<line: int, error: string>>>"


def table_spans(reports: DataFrame, text: str, header: str, place: str, total: str) -> tuple[DataFrame, DataFrame]:
    """(tables, errors) by three line patterns. Tables: (.., table, header, body, total): the texts of its parts, headers over several lines joined.

    Errors (.., line, error): a header without a total line, two headers before one, a total line without rows. Total lines outside a table, and all
    other text outside tables, are prose.
    """
    keys = [c for c in reports.columns if c != text]
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")

    def step(s: Column, x: Column) -> Column:
        line, at = x["line"], x["at"]
        is_head, is_total, is_open = line.rlike(header), line.rlike(total), s["head"] >= 0
        is_row = is_open & ~is_head & ~is_total & (s["first"] < 0) & line.rlike(rf"(?i)(?<![A-Za-z])(?:{place})(?![A-Za-z])")
        fault = F.when(is_head & is_open, F.struct(s["head"].alias("line"), F.lit("two headers before a total line").alias("error"))).when(
            is_total & is_open & (s["first"] < 0), F.struct(at.alias("line"), F.lit("no rows after the header").alias("error")))
        made = is_total & is_open & (s["first"] >= 0)
        return F.struct(
            F.when(is_head, at).when(is_total, F.lit(-1)).otherwise(s["head"]).alias("head"),
            F.when(is_head | is_total, F.lit(-1)).when(is_row, at).otherwise(s["first"]).alias("first"),
            F.when(made, F.concat(s["tables"], F.array(F.struct(s["head"].alias("head"), s["first"].alias("first"), at.alias("total"))))).otherwise(s["tables"]).alias("tables"),
            F.when(fault.isNotNull(), F.concat(s["faults"], F.array(fault))).otherwise(s["faults"]).alias("faults"),
        ).cast(_STATE)

    start = F.struct(F.lit(-1).alias("head"), F.lit(-1).alias("first"), F.array().alias("tables"), F.array().alias("faults")).cast(_STATE)
    numbered = F.transform("_l", lambda ln, i: F.struct(ln.alias("line"), i.alias("at")))
    read = reports.withColumn("_l", lines).withColumn("_s", F.aggregate(numbered, start, step))
    part = lambda a, b: F.array_join(F.slice("_l", F.col(a) + 1, F.greatest(F.col(b) - F.col(a), F.lit(0))), "\n")
    spans = read.select(*keys, "_l", F.posexplode("_s.tables").alias("table", "_t")).select(*keys, "table", "_l", "_t.*")
    tables = spans.select(*keys, "table", part("head", "first").alias("header"), part("first", "total").alias("body"), F.get("_l", F.col("total")).alias("total"))
    left = F.when(F.col("_s.head") >= 0, F.array(F.struct(F.col("_s.head").alias("line"), F.lit("no total line").alias("error")))).otherwise(F.array().cast("array<struct<line: int, error: string>>"))
    errors = read.select(*keys, F.inline(F.concat("_s.faults", left)))
    return tables, errors


@dataclass(frozen=True)
class RegionalTables:
    cells: DataFrame  # .., table, region, entity, column, value
    totals: DataFrame  # .., table, region, column, kind (t: a sum, a: an average), printed
    errors: DataFrame  # .., table, error


def regional_tables(reports: DataFrame, text: str, places: DataFrame, place: str, phrases: list[tuple[str, str]], header: str, total: str) -> RegionalTables:
    """The tables of report texts. ``places`` has alias (normalised), entity and region; ``place`` is a pattern of their printed names.

    ``phrases`` (pattern, column) name a header's columns in the order of their positions; the first phrase must come first. Each of these is an error:
    an unknown header, text that no row explains, a place that is repeated or unknown, a total line with another number of values than columns, a
    table with places of several regions.
    """
    keys = [c for c in reports.columns if c != text]
    T = [*keys, "table"]
    spans, order_errors = table_spans(reports, text, header, place, total)
    columns = E.header_order(F.regexp_replace("header", r"\s+", " "), phrases)
    tables = spans.withColumn("columns", columns)
    known = F.coalesce(F.get("columns", F.lit(0)) == phrases[0][1], F.lit(False))
    strange = tables.filter(~known).select(*T, F.concat(F.lit("unknown header: "), X.collapse(F.col("header"))).alias("error"))
    good = tables.filter(known)

    width = F.size("columns") - 1
    row = F.concat(F.lit(rf"(?i)(?<![A-Za-z])({place})\s+({NUMBER}(?:\s+{NUMBER}){{"), width.cast("string"), F.lit(r"})(?![\d.,])"))
    hits = F.arrays_zip(F.regexp_extract_all("body", row, 1).alias("name"), F.regexp_extract_all("body", row, 2).alias("values"))
    found = good.select(*T, "columns", F.inline(hits)).withColumn("alias", X.normalize_name(F.col("name"))).join(places, "alias", "left")
    rest = X.collapse(F.regexp_replace(F.col("body"), row, F.lit(" ")))
    unread = good.select(*T, rest.alias("rest")).filter("rest <> ''").select(*T, F.concat(F.lit("unread text: "), F.col("rest")).alias("error"))
    unknown = found.filter("entity IS NULL").select(*T, F.concat(F.lit("unknown place: "), F.col("name")).alias("error"))
    twice = Q.duplicate_keys(found.filter("entity IS NOT NULL"), [*T, "entity"]).select(*T, F.concat(F.lit("repeated place: "), F.col("entity").cast("string")).alias("error"))
    per = found.filter("region IS NOT NULL").groupBy(*T).agg(F.sort_array(F.collect_set("region")).alias("_r"))  # a table's regions are few
    mixed = per.filter(F.size("_r") > 1).select(*T, F.concat(F.lit("regions mixed: "), F.array_join("_r", ", ")).alias("error"))
    region = per.select(*T, F.get("_r", F.lit(0)).alias("region"))

    marks = rf"([ta])\s*=\s*({NUMBER})"
    sums = good.withColumn("_k", F.regexp_extract_all("total", F.lit(marks), 1)).withColumn("_v", F.regexp_extract_all("total", F.lit(marks), 2))
    uneven = sums.filter(F.size("_k") != F.size("columns")).select(*T, F.concat(F.size("_k").cast("string"), F.lit(" totals for "), F.size("columns").cast("string"), F.lit(" columns")).alias("error"))
    number = lambda c: F.replace(c, F.lit(","), F.lit("")).try_cast("double")
    even = sums.filter(F.size("_k") == F.size("columns")).join(region, T, "left")
    totals = even.select(*T, "region", F.inline(F.arrays_zip(F.col("columns").alias("column"), F.col("_k").alias("kind"), F.col("_v").alias("printed"))))
    cells = found.select(*T, "entity", F.inline(F.arrays_zip(F.col("columns").alias("column"), F.split("values", r"\s+").alias("value")))).join(region, T, "left")
    errors = order_errors.select(*keys, F.lit(None).cast("int").alias("table"), F.concat("error", F.lit(" (line "), (F.col("line") + 1).cast("string"), F.lit(")")).alias("error"))
    return RegionalTables(
        cells.select(*T, "region", "entity", "column", number(F.col("value")).alias("value")),
        totals.withColumn("printed", number(F.col("printed"))),
        reduce(DataFrame.unionByName, [errors, strange, unread, unknown, twice, mixed, uneven]),
    )


def printed_findings(tables: RegionalTables, keys: list[str], strict_sums: tuple[str, ...], strict_means: tuple[str, ...], tolerance: float,
                     pins: DataFrame | None = None) -> DataFrame:
    """(.., region, column, kind, found, printed, severity): printed sums and averages that the rows don't give.

    A sum must agree; an average must be within ``tolerance``. A finding in a strict column is an ``error``, in another a ``warning``. ``pins``
    (.., region, column) name averages that are known to be off: ``known``; one that agrees again is ``stale``, which is an error too.
    """
    at = [*keys, "table", "column"]
    found = tables.cells.groupBy(*at).agg(F.sum("value").alias("sum"), F.avg("value").alias("mean"))
    both = tables.totals.join(found, at).withColumn("found", F.when(F.col("kind") == "t", F.col("sum")).otherwise(F.col("mean")))
    limit = F.when(F.col("kind") == "t", F.lit(1e-6)).otherwise(F.lit(tolerance))
    both = both.withColumn("off", F.abs(F.col("found") - F.col("printed")) > limit)
    strict = F.when(F.col("kind") == "t", F.col("column").isin(*strict_sums)).otherwise(F.col("column").isin(*strict_means))
    if pins is not None:
        both = both.join(pins.select(*keys, "region", "column", F.lit(True).alias("_pin")), [*keys, "region", "column"], "left")
    pin = F.coalesce(F.col("_pin"), F.lit(False)) & (F.col("kind") == "a") if pins is not None else F.lit(False)
    severity = F.when(pin & F.col("off"), "known").when(pin, "stale").when(F.col("off") & strict, "error").when(F.col("off"), "warning")
    return both.withColumn("severity", severity).filter("severity IS NOT NULL").select(*keys, "region", "column", "kind", "found", "printed", "severity")


def distribution_findings(rows: DataFrame, keys: list[str], pins: DataFrame | None = None) -> DataFrame:
    """(.., total, parts, problem): rows of a distribution whose parts don't add up to the total without a pin, and pins that no longer apply."""
    parts = F.col("none") + F.col("one") + F.col("two") + F.col("three_plus")
    checked = rows.select(*keys, "total", parts.alias("parts"))
    violates = ~F.col("parts").eqNullSafe(F.col("total"))
    if pins is None:
        return checked.filter(violates).withColumn("problem", F.lit("unpinned"))
    return Q.two_sided(checked, violates, pins, keys)
