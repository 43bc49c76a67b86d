"""From landed report pages to a validated fact table.

The pages are parsed once into a written cell table; tables, checks and the fact are plain joins and
group sums over it. Nothing is published unless ``errors`` is empty (``sources.publish``).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starslice.functions import vocab as V
from starslice.operators import extract as E
from starslice.operators import quality as Q
from starslice.runtime import settle

T = E.TABLE


@dataclass(frozen=True)
class Build:
    fact: DataFrame  # species, season_year, season, portion, portion_label, method, youth, is_subtotal, derived, entity, class, cnt, source_url
    attributes: DataFrame  # species, season_year, portion, entity, name, value
    errors: DataFrame  # page_id, table_idx, error
    warnings: DataFrame  # page_id, table_idx, error: known or harmless defects
    skipped: DataFrame  # page_id, table_idx, title


@dataclass(frozen=True)
class Pins:
    """Known defects of the pages; each must still be there, or it is an error.

    ``cells`` (page_id, portion, entity, role, printed, fixed): a misprint. ``swaps`` (page_id, portion, class_a, class_b, as roles): exchanged
    columns. ``derived`` (page_id, portion, total, parts): a broken table, rebuilt as one portion minus others. ``apart`` (page_id, portion,
    entity): the entities in which two valid tables of a portion differ; the first one counts.
    """

    cells: DataFrame | None = None
    swaps: DataFrame | None = None
    derived: DataFrame | None = None
    apart: DataFrame | None = None


PORTION = ["page_id", "portion"]


def _say(df: DataFrame, *text, table: bool = True) -> DataFrame:
    """(page_id, table_idx, error); a finding about a page or portion has no table."""
    at = F.col("table_idx") if table else F.lit(None).cast("int").alias("table_idx")
    return df.select("page_id", at, F.concat(*[F.lit(t) if isinstance(t, str) else t for t in text]).alias("error"))


def _names(column: str):
    """A group's values in order, in words; a page's portions and entities are few."""
    return F.concat_ws(", ", F.sort_array(F.collect_set(F.col(column).cast("string"))))


def build_fact(pages: DataFrame, aliases: DataFrame, rules: list[tuple] = V.DEER_TITLE_RULES, headers: dict[str, str] = V.DEER_HEADERS,
               season_of: str | None = "fall", caption_titles: bool = True, remaps: tuple[tuple[str, str, str], ...] = (),
               pins: Pins = Pins(), skip_titles: str = V.DEER_SKIPPED_TITLES, title_only: bool = False, borrow_totals: bool = False,
               summary_classes: tuple[str, ...] = V.SUMMARY_CLASSES) -> Build:
    """``pages`` has page_id, species, season_year, source_url, html; ``aliases`` has alias, entity.

    ``season_of`` is the season of every portion, or None when the first word of the portion names it.
    ``caption_titles``: a specific caption is the title; otherwise the heading is, and a date-range caption only
    extends the label. ``title_only`` passes over headings that don't begin with "Title". ``remaps`` reads a mislabelled header as another one
    where that one is absent. ``borrow_totals``: a table without a Total row takes it from the table before it on the page, which may be a
    skipped one. ``summary_classes`` are the columns of a page's summary box, whose totals are compared with those of the tables.
    """
    meta = pages.select("page_id", "species", "season_year", "source_url")
    doc = pages.select("page_id", "html")
    heading, caption = F.col("heading"), F.col("caption")
    name = E.table_title(caption, heading, V.GENERIC_CAPTIONS) if caption_titles else heading
    label = name if caption_titles else E.with_date_range(heading, caption)
    found = E.html_tables(doc, "html", "h2|h3", "title ") if title_only else E.html_tables(doc, "html")
    titled = settle(found.select(*T, "closed", F.concat_ws(" ", name, caption).alias("title"), name.alias("name"), label.alias("label")), "titles")
    kept, skipped = E.skip_titles(titled, skip_titles)
    skipped = skipped.select(*T, F.col("name").alias("title"))
    boxed = F.lower(F.coalesce("name", F.lit(""))).rlike(V.SUMMARY_TITLES)
    boxes = kept.filter(boxed).select(*T)
    kept = settle(kept.filter(~boxed).withColumn("rule", E.first_match(F.col("name"), rules)), "tables")
    known = kept.filter("rule IS NOT NULL").select(*T, F.col("label").alias("title"), "rule.*")
    unclassified = _say(kept.filter("rule IS NULL"), "no rule for title ", F.coalesce("name", F.lit("")))

    every = settle(E.html_cells(doc, "html"), "cells")
    cells = every.join(known.select(*T), T, "left_semi")
    header, body = E.split_header(cells)
    for present, absent, read_as in remaps:
        header = E.remap_header(header, present, absent, read_as)
    roles, header_errors = E.header_roles(header, headers)
    rows = E.parsed_rows(body, roles)
    data, totals, twice = E.split_totals(rows)
    data = E.resolve(data, "label", aliases).join(known.select(*T, "portion"), T)
    stale = []
    if pins.cells is not None:
        old = Q.stale_pins(data, pins.cells, [*PORTION, "entity", "role"], "value")
        stale.append(_say(old, "stale pin: ", F.col("portion"), " ", F.col("role"), table=False))
        data = Q.apply_cell_pins(data, pins.cells, [*PORTION, "entity", "role"], "value").drop("pinned")
    if pins.swaps is not None:
        data = Q.swap_classes(data, pins.swaps, PORTION, "role")
    data = settle(data, "rows")
    printed = totals.select(*T, "role", F.col("value").alias("printed"), F.lit(False).alias("borrowed"))
    if borrow_totals:
        printed = printed.unionByName(E.borrowed_totals(every, header, roles, totals).select(*T, "role", F.col("value").alias("printed"), F.lit(True).alias("borrowed")))
    printed = settle(printed, "printed")

    widths = _say(E.width_errors(header, body), "row width ", F.col("found").cast("string"))
    rejects = _say(rows.filter("value IS NULL"), "not a number: ", F.col("text"))
    unknown = _say(data.filter("entity IS NULL").select(*T, "label").distinct(), "unknown name: ", F.col("label"))
    off = Q.reconcile(Q.column_sums(data, [*T, "role"], "value"), printed, [*T, "role"], "found", "printed")
    columns = _say(off, "column sum differs: ", F.col("role"))
    is_class = F.col("role").startswith("class:")
    per_row = data.groupBy(*T, "entity", "label").agg(
        F.sum(F.when(is_class, F.col("value"))).alias("classes"), F.sum(F.when(F.col("role") == "total", F.col("value"))).alias("total")
    )
    across = _say(per_row.filter(~F.col("classes").eqNullSafe(F.col("total"))), "row sum differs: ", F.col("label"))
    repeated = _say(Q.duplicate_keys(data.filter("role = 'total'"), [*T, "entity"]), "repeated entity ", F.col("entity").cast("string"))
    headless = E.header_problems(known, cells)
    violations = settle(
        headless.unionByName(header_errors).unionByName(twice).unionByName(widths).unionByName(rejects).unionByName(unknown).unionByName(columns)
        .unionByName(across).unionByName(repeated), "violations",
    )

    placed = violations.join(known.select(*T, "portion"), T)
    choice = Q.first_valid(known, placed, PORTION, "table_idx")
    to_derive = None if pins.derived is None else pins.derived.select(*PORTION)
    if to_derive is not None:
        choice = choice.join(to_derive.withColumn("_derive", F.lit(True)), PORTION, "left").withColumn(
            "status", F.when(F.col("_derive"), "derive").otherwise(F.col("status")))
        healed = choice.filter("status = 'derive' AND chosen IS NOT NULL")
        stale.append(_say(healed, "the table that a pin derives now validates: ", F.col("portion"), table=False))
        choice = choice.withColumn("chosen", F.when(F.col("status") != "derive", F.col("chosen"))).drop("_derive")
    chosen = known.join(choice.filter("chosen IS NOT NULL").select(*PORTION, F.col("chosen").alias("table_idx")), [*T, "portion"], "left_semi")
    chosen = settle(chosen.withColumn("derived", F.lit(False)), "chosen")
    lost = choice.filter("status = 'error'").select(*PORTION)
    hopeless = placed.join(lost, PORTION, "left_semi").select(*T, "error")
    harmless = placed.join(lost, PORTION, "left_anti").select(*T, "error")

    taken = data.join(chosen.select(*T), T, "left_semi").select(*T, "portion", "entity", "role", "value")
    if to_derive is not None:
        made, tables, faults = _derived(known, chosen, taken, printed, pins.derived)
        taken, chosen = taken.unionByName(made), chosen.unionByName(tables)
        stale.append(faults)
        harmless = harmless.unionByName(_say(tables, "derived: ", F.col("portion")))

    # non-subtotal portions must add up to the grand total where one is printed
    of_chosen = printed.filter("role = 'total'").join(chosen, T)
    sums = of_chosen.groupBy("page_id").agg(
        F.sum(F.when(~F.col("is_subtotal"), F.col("printed"))).alias("parts"),
        F.max(F.when(F.col("portion") == "grand_total", F.col("printed"))).alias("grand"),
    )
    grand = _say(sums.filter(F.col("grand").isNotNull() & ~F.col("parts").eqNullSafe(F.col("grand"))), "portions do not add up to the grand total", table=False)
    # the summary box is advisory
    boxed_totals = E.summary_rows(every.join(boxes, T, "left_semi"), summary_classes)
    boxed_totals = boxed_totals.withColumn("portion", E.first_match(F.col("label"), rules)["portion"]).select(*T, "label", "portion", F.col("total").alias("boxed"))
    boxed_off = boxed_totals.join(of_chosen.select(*PORTION, "printed"), PORTION).filter("boxed <> printed")
    boxed_off = _say(boxed_off, "summary box differs: ", F.col("label"), " ", F.col("boxed").cast("string"), " ", F.col("printed").cast("string"))

    apart, expected = _disagreements(known, placed, data, printed, pins.apart)
    collide = E.alias_collisions(aliases, "entity").select(
        F.lit(None).cast(pages.schema["page_id"].dataType).alias("page_id"), F.lit(None).cast("int").alias("table_idx"), F.concat(F.lit("alias names several entities: "), F.col("alias")).alias("error"))

    season = F.lit(season_of) if season_of else F.split("portion", "_")[0]
    long = taken.join(chosen.drop("portion"), T).join(meta, "page_id").withColumn("season", season)
    fact = long.filter(is_class).select(
        "species", "season_year", "season", "portion", F.col("title").alias("portion_label"), "method", "youth", "is_subtotal", "derived", "entity",
        F.substring_index("role", ":", -1).alias("class"), F.col("value").alias("cnt"), "source_url",
    )
    extras = long.filter(F.col("role").startswith("extra:")).select(
        "species", "season_year", "portion", "entity", F.substring_index("role", ":", -1).alias("name"), "value"
    )
    lent = _say(printed.filter("borrowed").select(*T).distinct(), "total row taken from the table before")
    open_ended = _say(titled.filter("NOT closed"), "table without an end tag")
    errors = reduce(DataFrame.unionByName, [unclassified, hopeless, grand, apart, collide, *stale])
    warnings = reduce(DataFrame.unionByName, [harmless, boxed_off, expected, lent, open_ended])
    return Build(fact, extras, errors, warnings, skipped)


def _derived(known: DataFrame, chosen: DataFrame, taken: DataFrame, printed: DataFrame, pins: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, tables, errors) of the pinned portions: the cells of one portion minus those of others, which must add up to the printed totals.

    The broken table (the first of its portion) lends its place, its title and its printed totals.
    """
    target = pins.select("page_id", F.col("portion").alias("target"), "total", "parts")
    needs = target.select("page_id", "target", F.explode(F.array_union(F.array("total"), "parts")).alias("portion"), (F.col("portion") == F.col("total")).alias("whole"))
    missing = needs.join(chosen.select(*PORTION), PORTION, "left_anti").groupBy("page_id", "target").agg(_names("portion").alias("lacks"))
    ready = target.join(missing, ["page_id", "target"], "left_anti").select("page_id", "target")
    signed = needs.join(ready, ["page_id", "target"], "left_semi").join(taken, PORTION).withColumn("v", F.when(F.col("whole"), F.col("value")).otherwise(-F.col("value")))
    signed = signed.filter(F.col("role").startswith("class:") | (F.col("role") == "total"))
    made = signed.groupBy("page_id", "target", "entity", "role").agg(F.sum("v").alias("value"))
    filled = made.groupBy("page_id", "target", "entity").agg(F.max(F.col("value") != 0).alias("any")).filter("any").drop("any")
    made = settle(made.join(filled, ["page_id", "target", "entity"], "left_semi"), "derived")
    bad = known.groupBy(*PORTION).agg(F.min("table_idx").alias("table_idx"))
    bad = known.join(bad, [*T, "portion"], "left_semi").join(ready.withColumnRenamed("target", "portion"), PORTION, "left_semi")
    below = made.filter("value < 0").groupBy("page_id", "target").agg(_names("entity").alias("who"))
    sums = made.groupBy("page_id", F.col("target").alias("portion"), "role").agg(F.sum("value").alias("found"))
    shown = printed.join(bad.select(*T, "portion"), T).filter(F.col("role").startswith("class:") | (F.col("role") == "total")).select(*PORTION, "role", "printed")
    off = Q.reconcile(sums, shown, [*PORTION, "role"], "found", "printed")
    faults = _say(missing, "cannot derive ", F.col("target"), ", missing ", F.col("lacks"), table=False).unionByName(
        _say(below, "derived counts below zero: ", F.col("target"), table=False)).unionByName(
        _say(off, "derived sum differs: ", F.col("portion"), " ", F.col("role"), table=False))
    wrong = off.select(*PORTION).unionByName(below.select("page_id", F.col("target").alias("portion"))).distinct()
    tables = bad.join(wrong, PORTION, "left_anti").withColumn("derived", F.lit(True)).withColumn("title", F.concat("title", F.lit(" (derived)")))
    cells = made.withColumnRenamed("target", "portion").join(tables.select(*T, "portion"), PORTION)
    return cells.select(*T, "portion", "entity", "role", "value"), tables.select(*chosen.columns), faults


def _disagreements(known: DataFrame, placed: DataFrame, data: DataFrame, printed: DataFrame, pins: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(errors, warnings): valid tables of one portion that print different cells. A pin must name exactly the entities that differ."""
    valid = known.join(placed.select(*T).distinct(), T, "left_anti").select(*T, "portion")
    several = valid.groupBy(*PORTION).agg(F.count("*").alias("n")).filter("n > 1")
    cell = data.join(valid.select(*T), T, "left_semi").filter(F.col("value") != 0).groupBy(*PORTION, "entity", "role").agg(
        F.count_distinct("table_idx").alias("tables"), F.count_distinct("value").alias("values"))
    differ = cell.join(several, PORTION).filter("tables <> n OR values <> 1").select(*PORTION, "entity").distinct()
    totals = printed.join(valid, T).groupBy(*PORTION, "role").agg(F.count_distinct("printed").alias("values")).filter("values > 1").select(*PORTION).distinct()
    if pins is None:
        return _say(differ.select(*PORTION).distinct(), "valid tables disagree: ", F.col("portion"), table=False), _say(differ.limit(0), "", table=False)
    pinned = pins.select(*PORTION, "entity")
    both = differ.withColumn("f", F.lit(1)).withColumn("p", F.lit(0)).unionByName(pinned.withColumn("f", F.lit(0)).withColumn("p", F.lit(1)))
    sides = both.groupBy(*PORTION, "entity").agg(F.max("f").alias("f"), F.max("p").alias("p")).groupBy(*PORTION).agg(
        F.bool_and(F.col("f") == F.col("p")).alias("same"), (F.max("p") == 1).alias("pinned"))
    sides = sides.join(totals.withColumn("uneven", F.lit(True)), PORTION, "left").withColumn("uneven", F.coalesce("uneven", F.lit(False)))
    bad = sides.filter("NOT same OR uneven")
    text = F.when(F.col("pinned"), "a pin names other entities than those that disagree: ").otherwise("valid tables disagree: ")
    return _say(bad, text, F.col("portion"), table=False), _say(sides.filter("same AND NOT uneven"), "known disagreement: ", F.col("portion"), table=False)
