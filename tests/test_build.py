"""Pages to fact end to end, with typical defects."""

import pytest
from conftest import one, rows
from pyspark.sql import functions as F

from starslice.operators import quality as Q
from starslice.plans import reports as R
from starslice.plans.build import Pins, build_fact
from starslice.sources import publish, scans, sinks


def table(lines, caption=""):
    body = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in line) + "</tr>" for line in lines)
    return f"<table><caption>{caption}</caption>{body}</table>"


HEAD = ["County", "Antlered Buck", "Button Buck", "Doe", "Total"]
ARCHERY = [HEAD, ["Adair", "5", "1", "4", "10"], ["Mcdonald", "2", "-", "1", "3"], ["Total", "7", "1", "5", "13"]]
BROKEN = [HEAD, ["Adair", "5", "1", "4", "11"], ["Mcdonald", "2", "-", "1", "3"], ["Total", "7", "1", "5", "13"]]
NOVEMBER = [HEAD, ["Adair", "1,000", "0", "0", "1,000"], ["Mcdonald", "0", "0", "2", "2"], ["Totals", "1000", "0", "2", "1,002"]]


def page(grand=1015, archery=ARCHERY, extra=""):
    total = [HEAD, ["Adair", "1,005", "1", "4", "1,010"], ["Mcdonald", "2", "0", "3", "5"], ["Grand Total", "1,007", "1", "7", str(grand)]]
    return (
        "<h2>2019</h2><h3>Title Archery</h3>" + table(BROKEN, "All Counties") + table(archery, "Archery (corrected)")
        + "<h3>November Firearms</h3>" + table(NOVEMBER) + "<h3>Archery</h3>" + table(ARCHERY[:2], "Top 5 counties")
        + "<h3>Grand Totals</h3>" + table(total) + extra
    )


@pytest.fixture(scope="module")
def aliases(spark):
    return spark.createDataFrame([("adair", "29001"), ("mcdonald", "29119")], "alias string, entity string")


def pages(spark, html):
    return spark.createDataFrame([(1, "deer", 2019, "src", html)], "page_id int, species string, season_year int, source_url string, html string")


def test_good_page(spark, aliases, tmp_path):
    b = build_fact(pages(spark, page()), aliases)
    assert b.errors.count() == 0
    assert sorted({r.error for r in b.warnings.collect()}) == ["column sum differs: total", "row sum differs: Adair"]
    assert [r.title for r in b.skipped.collect()] == ["Archery Top 5 counties"]
    totals = {r.portion: r.n for r in b.fact.groupBy("portion").agg(F.sum("cnt").alias("n")).collect()}
    assert totals == {"archery": 13, "november": 1002, "grand_total": 1015}
    assert b.fact.count() == 3 * 2 * 3  # three rows per table row
    assert one(b.fact.filter("entity = '29119' AND class = 'doe' AND portion = 'archery'").select("cnt")) == 1
    assert rows(b.fact.filter("portion = 'grand_total'").select("is_subtotal", "method", "season").distinct()) == [(True, "mixed", "fall")]
    publish.publish(sinks.typed(b.fact), str(tmp_path / "f"), lambda _: {"errors": b.errors})
    assert one(publish.published(spark, str(tmp_path / "f")).agg(F.sum("cnt"))) == 2030


def test_bad_pages_are_blocked(spark, aliases, tmp_path):
    wrong = [HEAD, ["Atlantis", "5", "1", "4", "10"], ["Adair", "2", "x", "1", "3"], ["Total", "7", "1", "5", "13"]]
    b = build_fact(pages(spark, page(archery=wrong, extra="<h3>Mystery season</h3>" + table(ARCHERY))), aliases)
    errors = {r.error for r in b.errors.collect()}
    assert {"unknown name: Atlantis", "not a number: x", "no rule for title Mystery season", "row sum differs: Adair"} <= errors
    with pytest.raises(Q.GateClosed):
        publish.publish(sinks.typed(b.fact), str(tmp_path / "f"), lambda _: {"errors": b.errors})
    off = build_fact(pages(spark, page(grand=1016)), aliases)
    assert "column sum differs: total" in {r.error for r in off.errors.collect()}


def test_pin_repairs_a_misprint(spark, aliases):
    bad = [HEAD, ["Adair", "6", "1", "4", "10"], ["Mcdonald", "2", "-", "1", "3"], ["Total", "7", "1", "5", "13"]]
    html = page(archery=bad)
    assert build_fact(pages(spark, html), aliases).errors.count() > 0
    pin = spark.createDataFrame([(1, "archery", "29001", "class:antlered_buck", 6, 5)], "page_id int, portion string, entity string, role string, printed long, fixed long")
    assert build_fact(pages(spark, html), aliases, pins=Pins(cells=pin)).errors.count() == 0


def test_small_rules(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "layer string")
    assert sorted(rows(Q.overlap(df, ["a", "z"], "layer"))) == [("a", True), ("z", False)]
    assert rows(Q.too_few(df, ["layer"], 2)) == [("b", 1)]
    permits = spark.createDataFrame([(2020, "any", 200, 50), (2020, "none", 0, 5), (2021, "any", 10, 5)], "year int, permit_type string, permits_issued int, deer_harvested int")
    hunters = spark.createDataFrame([(2020, "firearms", 100, 60), (2020, "archery", 10, 1)], "year int, method string, hunters_total int, hunters_0_deer int")
    got = {(r.year, r.permit_type): (r.fill_rate, r.success_rate) for r in R.permits_vs_harvest(permits, hunters).collect()}
    assert got == {(2020, "any"): (0.25, 0.4), (2020, "none"): (None, 0.4), (2021, "any"): (0.5, None)}


def test_layer_predicates(spark):
    from starslice.functions import vocab as V

    shapes = spark.createDataFrame(
        [({"rttyp": "I", "fullname": " I- 70 "}, "LineString"), ({"rttyp": "U", "fullname": "US 63"}, "LineString"), ({"acreage": "1200", "public_site": "Y", "fullname": "Big"}, None)],
        "properties map<string,string>, kind string")
    assert [r.name for r in scans.layer(shapes, V.LAYER_FILTERS["interstates"], "fullname").collect()] == ["I- 70"]
    assert scans.layer(shapes, V.LAYER_FILTERS["public_land"], "fullname").count() == 0


def test_turkey_page(spark, aliases):
    """Headings carry the title, a mislabelled header and swapped columns are repaired, extras go to the attributes."""
    from starslice.functions import vocab as V

    lines = [["County", "Adult Gobbler", "Bearded Hen", "Total", "Public Land"], ["Adair", "70", "5", "75", "9"], ["Total", "5", "70", "75", "9"]]
    html = "<h3>Fall Turkey Firearm</h3>" + table(lines, "10/1/2021-10/31/2021") + "<h3>Fall Turkey Firearm</h3>" + table(lines, "Top 10 counties")
    raw = spark.createDataFrame([(7, "turkey", 2021, "src", html)], "page_id int, species string, season_year int, source_url string, html string")
    pins = spark.createDataFrame([(7, "fall_firearms", "class:adult_gobbler", "class:adult_hen")], "page_id int, portion string, class_a string, class_b string")
    b = build_fact(raw, aliases, V.TURKEY_TITLE_RULES, V.FALL_HEADERS, None, False, (("bearded hen", "adult hen", "adult hen"),), pins=Pins(swaps=pins), skip_titles=V.TURKEY_SKIPPED_TITLES)
    assert b.errors.count() == 0 and b.skipped.count() == 1
    got = {r["class"]: (r.cnt, r.season, r.portion_label) for r in b.fact.collect()}
    label = "Fall Turkey Firearm (10/1/2021-10/31/2021)"
    assert got == {"adult_gobbler": (5, "fall", label), "adult_hen": (70, "fall", label)}
    assert rows(b.attributes.select("entity", "name", "value")) == [("29001", "public_land", 9)]
    unpinned = build_fact(raw, aliases, V.TURKEY_TITLE_RULES, V.FALL_HEADERS, None, False, (("bearded hen", "adult hen", "adult hen"),), skip_titles=V.TURKEY_SKIPPED_TITLES)
    assert unpinned.errors.count() == 2


def errors_of(spark, aliases, html, **options):
    return {r.error for r in build_fact(pages(spark, html), aliases, **options).errors.collect()}


def test_headerless_tables_and_rows_above_the_header_are_errors(spark, aliases):
    assert "no header row" in errors_of(spark, aliases, "<h3>Archery</h3>" + table(ARCHERY[1:]))
    b = build_fact(pages(spark, "<h3>Archery</h3>" + table(ARCHERY[1:]) + "<h3>Archery</h3>" + table(ARCHERY)), aliases)
    assert one(b.fact.agg(F.sum("cnt"))) == 13 and {r.error for r in b.warnings.collect()} == {"no header row"}
    assert "row above the header" in errors_of(spark, aliases, "<h3>Archery</h3>" + table([["Adair", "9", "9", "9", "27"], *ARCHERY]))


def test_omitted_end_tags(spark, aliases):
    body = "".join("<tr>" + "".join(f"<td>{c}" for c in line) for line in ARCHERY)
    b = build_fact(pages(spark, f"<h3>Archery</h3><table>{body}</table>"), aliases)
    assert b.errors.count() == 0 and one(b.fact.agg(F.sum("cnt"))) == 13


def test_unclosed_heading_does_not_move_titles(spark, aliases):
    html = "<h3>Archery</h3><strong>note " + table(ARCHERY) + "<h3>November Firearms</h3>" + table(NOVEMBER) + "<strong>end</strong>"
    b = build_fact(pages(spark, html), aliases)
    assert {r.portion: r.n for r in b.fact.groupBy("portion").agg(F.sum("cnt").alias("n")).collect()} == {"archery": 13, "november": 1002}


def test_disagreeing_tables_stale_pins_and_collisions(spark, aliases):
    other = [HEAD, ["Adair", "4", "2", "4", "10"], ["Mcdonald", "2", "-", "1", "3"], ["Total", "6", "2", "5", "13"]]
    assert errors_of(spark, aliases, "<h3>Archery</h3>" + table(ARCHERY) + "<h3>Archery</h3>" + table(other)) == {"valid tables disagree: archery"}
    assert errors_of(spark, aliases, "<h3>Archery</h3>" + table(ARCHERY) + "<h3>Archery</h3>" + table(ARCHERY)) == set()
    pins = spark.createDataFrame([(1, "archery", "29001", "class:doe", 99, 4)], "page_id int, portion string, entity string, role string, printed long, fixed long")
    assert errors_of(spark, aliases, "<h3>Archery</h3>" + table(ARCHERY), pins=Pins(cells=pins)) == {"stale pin: archery class:doe"}
    twice = aliases.union(spark.createDataFrame([("adair", "29003")], "alias string, entity string"))
    assert "alias names several entities: adair" in errors_of(spark, twice, "<h3>Archery</h3>" + table(ARCHERY))


def test_character_references(spark, aliases):
    dashes = [HEAD, ["Adair", "5", "1", "4", "10"], ["Mc&#68;onald", "2", "&mdash;", "1", "3"], ["Total", "7", "1", "5", "1&#x33;"]]
    b = build_fact(pages(spark, "<h3>Archery</h3>" + table(dashes)), aliases)
    assert b.errors.count() == 0 and one(b.fact.agg(F.sum("cnt"))) == 13


def test_title_only_headings(spark, aliases):
    """Headings that don't begin with "Title" are passed over."""
    html = "<h2>Title Archery</h2><h3>by county</h3>" + table(ARCHERY)
    assert errors_of(spark, aliases, html, title_only=True) == set()
    assert errors_of(spark, aliases, html) == {"no rule for title by county"}


def test_nested_and_unclosed_tables(spark, aliases):
    nested = "<h3>Archery</h3>" + table(ARCHERY).replace("Adair", "Adair<table><tr><td>note</td></tr></table>", 1)
    b = build_fact(pages(spark, nested), aliases)
    assert b.errors.count() == 0 and one(b.fact.agg(F.sum("cnt"))) == 13 and {r.error for r in b.warnings.collect()} == {"no header row"}
    html = "<h3>Archery</h3>" + table(ARCHERY).replace("</table>", "") + "<h3>November Firearms</h3>" + table(NOVEMBER)
    b = build_fact(pages(spark, html), aliases)
    assert {r.portion: r.n for r in b.fact.groupBy("portion").agg(F.sum("cnt").alias("n")).collect()} == {"archery": 13, "november": 1002}
    assert b.errors.count() == 0 and {r.error for r in b.warnings.collect()} == {"table without an end tag"}


def test_total_of_a_skipped_table(spark, aliases):
    html = "<h3>Archery</h3>" + table([HEAD, ARCHERY[-1]], "Top 5 counties") + "<h3>Archery</h3>" + table(ARCHERY[:-1])
    b = build_fact(pages(spark, html), aliases, borrow_totals=True)
    assert b.errors.count() == 0 and one(b.fact.agg(F.sum("cnt"))) == 13
    assert {r.error for r in b.warnings.collect()} == {"total row taken from the table before"}
    assert "column sum differs: total" in errors_of(spark, aliases, html)
    other = html.replace("<td>13</td>", "<td>14</td>")
    assert errors_of(spark, aliases, other, borrow_totals=True) == {"column sum differs: total"}


def derived_pin(spark, *parts):
    return Pins(derived=spark.createDataFrame([(1, "late_antlerless", "all_firearms", list(parts))], "page_id int, portion string, total string, parts array<string>"))


def firearms(late, whole=None):
    whole = whole or [HEAD, ["Adair", "1,005", "1", "6", "1,012"], ["Mcdonald", "2", "0", "3", "5"], ["Total", "1,007", "1", "9", "1,017"]]
    return "<h3>November Firearms</h3>" + table(NOVEMBER) + "<h3>Antlerless Firearms</h3>" + table(late) + "<h3>All Firearms</h3>" + table(whole)


SHIFTED = [HEAD, ["Adair", "2", "0", "1", "3"], ["Mcdonald", "5", "1", "6", "12"], ["Total", "7", "1", "7", "14"]]


def test_derived_table(spark, aliases):
    shifted = [*SHIFTED[:2], ["Mcdonald", "5", "1", "6", "11"], ["Total", "7", "1", "7", "15"]]
    html = firearms(shifted)
    assert errors_of(spark, aliases, html) >= {"row sum differs: Mcdonald"}
    b = build_fact(pages(spark, html), aliases, pins=derived_pin(spark, "november"))
    assert b.errors.count() == 0 and "derived: late_antlerless" in {r.error for r in b.warnings.collect()}
    got = {(r.entity, r["class"]): r.cnt for r in b.fact.filter("portion = 'late_antlerless' AND derived").collect()}
    assert got == {("29001", "antlered_buck"): 5, ("29001", "button_buck"): 1, ("29001", "doe"): 6, ("29119", "antlered_buck"): 2, ("29119", "button_buck"): 0, ("29119", "doe"): 1}
    assert {r.portion_label for r in b.fact.filter("derived").collect()} == {"Antlerless Firearms (derived)"} and b.fact.filter("NOT derived").count() == 12


def test_derivation_faults(spark, aliases):
    shifted = [*SHIFTED[:2], ["Mcdonald", "5", "1", "6", "11"], ["Total", "7", "1", "7", "15"]]
    assert errors_of(spark, aliases, firearms(SHIFTED[:1] + [["Adair", "5", "1", "6", "12"], ["Mcdonald", "2", "0", "1", "3"], ["Total", "7", "1", "7", "15"]]), pins=derived_pin(spark, "november")) >= {"the table that a pin derives now validates: late_antlerless"}
    assert "cannot derive late_antlerless, missing early_youth" in errors_of(spark, aliases, firearms(shifted), pins=derived_pin(spark, "november", "early_youth"))
    less = [HEAD, ["Adair", "5", "1", "6", "12"], ["Mcdonald", "2", "0", "3", "5"], ["Total", "7", "1", "9", "17"]]
    below = errors_of(spark, aliases, firearms(shifted, less), pins=derived_pin(spark, "november"))
    assert "derived counts below zero: late_antlerless" in below and "derived sum differs: late_antlerless total" in below


def test_pinned_disagreement(spark, aliases):
    other = [HEAD, ["Adair", "2", "-", "1", "3"], ["Mcdonald", "5", "1", "4", "10"], ["Total", "7", "1", "5", "13"]]
    html = "<h3>Archery</h3>" + table(ARCHERY) + "<h3>Archery</h3>" + table(other)
    pin = lambda *who: Pins(apart=spark.createDataFrame([(1, "archery", e) for e in who], "page_id int, portion string, entity string"))
    b = build_fact(pages(spark, html), aliases, pins=pin("29001", "29119"))
    assert b.errors.count() == 0 and {r.error for r in b.warnings.collect()} == {"known disagreement: archery"}
    assert one(b.fact.filter("entity = '29001' AND class = 'doe'").select("cnt")) == 4  # the first one counts
    stale = {"a pin names other entities than those that disagree: archery"}
    assert errors_of(spark, aliases, html, pins=pin("29001")) == stale
    assert errors_of(spark, aliases, "<h3>Archery</h3>" + table(ARCHERY), pins=pin("29001")) == stale
    uneven = [HEAD, ["Adair", "4", "1", "4", "9"], ["Mcdonald", "2", "-", "1", "3"], ["Total", "6", "1", "5", "12"]]
    assert errors_of(spark, aliases, "<h3>Archery</h3>" + table(ARCHERY) + "<h3>Archery</h3>" + table(uneven), pins=pin("29001")) == stale


def test_summary_box_is_advisory(spark, aliases):
    box = "<h3>Season Summary</h3>" + table([["Season/Portion", *HEAD[1:]], ["Archery", "7", "1", "5", "14"], ["November Firearms", "1000", "0", "2", "1002"], ["Hours", "x", "", "", ""], ["Unheard of", "1", "1", "1", "3"]])
    b = build_fact(pages(spark, box + "<h3>Archery</h3>" + table(ARCHERY) + "<h3>November Firearms</h3>" + table(NOVEMBER)), aliases)
    assert b.errors.count() == 0 and {r.error for r in b.warnings.collect()} == {"summary box differs: Archery 14 13"}
