"""Document tables to fact rows, on small hand-written pages."""

import pytest
from conftest import one, rows
from pyspark.sql import functions as F

from starslice.functions import vocab as V
from starslice.operators import extract as E

PAGE = """
<h2>2017</h2><h3>Title Fall Turkey Firearm</h3>
<!-- <table><tr><td>no</td></tr></table> -->
<table><tr><th>County</th><th>Adult  Gobbler</th><th>Bearded Hen</th><th>Total</th></tr>
<tr><td>Adair</td><td>1,200</td><td>-</td><td>1,200</td></tr>
<tr><td> </td><td></td><td>&nbsp;</td><td></td></tr>
<tr><td>County</td><td>Adult Gobbler</td><td>Bearded Hen</td><td>Total</td></tr>
<tr><td>Andrew</td><td>3</td><td>x4</td><td>7</td></tr>
<tr><td>Grand Totals:</td><td>1203</td><td>4</td><td>1207</td></tr></table>
<strong>12,345</strong>
<table><tr><td>County</td><td>Adult Gobbler</td><td>Mystery</td></tr><tr><td>Adair</td><td>1</td></tr></table>
"""


@pytest.fixture(scope="module")
def cells(spark):
    return E.html_cells(
        spark.createDataFrame([(1, PAGE)], "page_id int, html string"), "html")


def test_cells_drop_blank_rows_and_comments(cells):
    got = rows(cells.filter("table_idx = 0").groupBy("row_idx").count().orderBy("row_idx"))
    assert got == [(0, 4), (1, 4), (2, 4), (3, 4), (4, 4)]
    assert cells.filter("text = 'no'").count() == 0
    assert one(cells.filter("table_idx = 0 AND row_idx = 0 AND col_idx = 1").select("text")) == "Adult Gobbler"


def test_header_body_and_roles(cells):
    header, body = E.split_header(cells)
    assert body.filter("lower(text) = 'county'").count() == 0
    roles, errors = E.header_roles(header, V.FALL_HEADERS)
    assert sorted(r.error for r in errors.collect()) == ["no total column", "unknown header mystery"]
    width = rows(E.width_errors(header, body).select("table_idx", "found", "expected"))
    assert width == [(1, 2, 3)]
    parsed = E.parsed_rows(body, roles).filter("table_idx = 0")
    bad = [r.text for r in parsed.filter("value IS NULL").collect()]
    assert bad == ["x4"]
    data, totals, twice = E.split_totals(parsed)
    assert {r.label for r in data.collect()} == {"Adair", "Andrew"} and twice.count() == 0
    assert {r.role: r.value for r in totals.collect()}["total"] == 1207


def test_remapped_header(cells):
    header, _ = E.split_header(cells)
    fixed = E.remap_header(header, "bearded hen", "adult hen", "adult hen").filter("table_idx = 0")
    assert "adult hen" in {r.header for r in fixed.collect()}


def test_borrowed_totals(spark):
    """The first Total row of the table before that is as wide as the borrower's header, read by the borrower's columns."""
    lines = {0: [["Top"], ["Total", "9"], ["Totals", "1", "2"], ["Total", "7", "7"]], 1: [["County", "Doe", "Total"], ["Adair", "1", "2"]], 2: [["County", "Doe", "Total"], ["Total", "5", "5"]], 3: [["County", "Total"]]}
    flat = [(1, t, r, c, x) for t, rs in lines.items() for r, row in enumerate(rs) for c, x in enumerate(row)]
    cells = spark.createDataFrame(flat, "page_id int, table_idx int, row_idx int, col_idx int, text string")
    header, body = E.split_header(cells)
    roles, _ = E.header_roles(header, {"doe": "class:doe", "total": "total"})
    _, totals, _ = E.split_totals(E.parsed_rows(body, roles))
    got = sorted(rows(E.borrowed_totals(cells, header, roles, totals).select("table_idx", "role", "value")))
    assert got == [(1, "class:doe", 1), (1, "total", 2)]  # table 3 is narrower than the Total row before it


def test_tag_stream(spark):
    """Nested tables, missing and stray end tags; titles and cells have the same numbers."""
    html = ["<h3>A</h3><table><tr><td>x<table><tr><td>in<tr><td>in2</table>y<td>z</table><h3>B</h3><table><tr><td>q</td></tr><h3>C</h3><table><tr><td>r</td></tr>",
            "</table><strong>12</strong><h2>Title T</h2><table class='a'><caption>cap<tr><th>County</th></tr></TABLE ><h4>open<table><tr><td></td></tr></table>",
            "<h2>Title T</h2><h3>Note</h3><table><tr><td><strong>Adair</strong></td></tr></table><table><tr><td>1</td></tr></table>", None, "", "<tablex><td>no table"]
    df = spark.createDataFrame(list(enumerate(html)), "page_id int, html string")
    assert sorted(rows(E.html_tables(df, "html"))) == [
        (0, 0, "A", "", True), (0, 1, "A", "", True), (0, 2, "B", "", False), (0, 3, "C", "", False),
        (1, 0, "T", "cap", True), (1, 1, "T", "", True), (2, 0, "Note", "", True), (2, 1, "Adair", "", True)]
    assert [r.heading for r in E.html_tables(df, "html", "h2|h3", "title ").orderBy("page_id", "table_idx").collect()] == [None] * 4 + ["T"] * 4
    assert sorted(rows(E.html_cells(df, "html").filter("page_id < 2"))) == [
        (0, 0, 0, 0, "x y"), (0, 0, 0, 1, "z"), (0, 1, 0, 0, "in"), (0, 1, 1, 0, "in2"), (0, 2, 0, 0, "q"), (0, 3, 0, 0, "r"), (1, 0, 0, 0, "County")]
    assert E.html_cells(df.filter("page_id > 2"), "html").count() == 0


def test_nearest_heading_skips_numbers(spark):
    pages = spark.createDataFrame([(1, PAGE)], "page_id int, html string")
    got = rows(E.html_tables(pages, "html").select("table_idx", "heading", "caption"))
    assert got == [(0, "Fall Turkey Firearm", ""), (1, "Fall Turkey Firearm", "")]


@pytest.mark.parametrize("title, portion, subtotal", [
    ("Antlerless Firearms November 25-December 6, 2015", "late_antlerless", False),
    ("Opening Weekend of November Firearms", "opening_weekend", True), ("Nothing known", None, None),
])
def test_deer_titles(spark, title, portion, subtotal):
    hit = one(spark.createDataFrame([(title,)], "t string").select(E.first_match(F.col("t"), V.DEER_TITLE_RULES)))
    assert (hit and hit["portion"], hit and hit["is_subtotal"]) == (portion, subtotal)


def test_turkey_titles(spark):
    got = spark.createDataFrame([("Spring Opening Day",), ("2017 Fall Turkey Firearm Report",)], "t string").select(
        E.first_match(F.col("t"), V.TURKEY_TITLE_RULES).alias("m")).select("m.portion", "m.is_subtotal")
    assert rows(got) == [("spring_opening_day", True), ("fall_firearms", False)]


def test_titles(spark):
    df = spark.createDataFrame([("All Counties", "Archery"), ("Late Youth", "Archery"), (None, "Archery")], "c string, h string")
    assert [r[0] for r in df.select(E.table_title(F.col("c"), F.col("h"), V.GENERIC_CAPTIONS)).collect()] == ["Archery All Counties", "Late Youth", "Archery"]
    dated = spark.createDataFrame([("4/20-5/10",), ("Spring",), ("All counties x",)], "c string").select(E.with_date_range(F.lit("Spring Total"), F.col("c")))
    assert [r[0] for r in dated.collect()] == ["Spring Total (4/20-5/10)", "Spring Total", "Spring Total"]
    kept, skipped = E.skip_titles(spark.createDataFrame([("Top 5 counties",), ("Archery",), (None,)], "title string"), V.SKIPPED_TITLES["deer"])
    assert kept.count() == 2 and skipped.count() == 1


def test_summary_rows(spark):
    cells = spark.createDataFrame(
        [(1, 0, r, c, t) for r, line in enumerate([["Season/Portion", "a", "b", "c", "Total"], ["Archery", "1", "2", "3", "6"], ["Note", "x", "2", "3", "4"], ["Short", "1"]]) for c, t in enumerate(line)],
        "page_id int, table_idx int, row_idx int, col_idx int, text string")
    got = rows(E.summary_rows(cells, ("buck", "button", "doe")).select("label", "buck", "button", "doe", "total"))
    assert got == [("Archery", 1, 2, 3, 6)]


def test_aliases(spark):
    names = spark.createDataFrame([("29119", "McDonald", ["Mc Donald"]), ("29189", "Saint Louis", ["St. Louis"]), ("29510", "Saint Louis City", None), ("x", "ST LOUIS", [])],
                                  "fips string, name string, aliases array<string>")
    dim = E.alias_dim(names, "fips")
    assert rows(E.alias_collisions(dim, "fips")) == [("st louis", 2)]
    extra = spark.createDataFrame(list(V.EXTRA_ALIASES.items()), "alias string, fips string")
    full = E.fill_aliases(dim.filter("fips <> 'x'"), extra)
    raw = spark.createDataFrame([("Mcdonald",), ("Saint Louis City (City)",), ("Sainte Genevieve",), ("Carrol",), ("Atlantis",)], "printed string")
    got = {r.printed: r.fips for r in E.resolve(raw, "printed", full).collect()}
    assert got == {"Mcdonald": "29119", "Saint Louis City (City)": "29510", "Sainte Genevieve": "29186", "Carrol": "29033", "Atlantis": None}


def test_header_order(spark):
    head = "County  Total Harvest Harvested deer per square mile Firearms hunters\nper square mile Number of public hunting areas"
    got = one(spark.createDataFrame([(head,)], "h string").select(E.header_order(F.col("h"), V.EFFORT_HEADER_PHRASES)))
    assert got == ["harvest", "harvest_per_sqmi", "firearms_hunters_per_sqmi", "public_areas"]


def test_block_rows(spark):
    blocks = spark.createDataFrame([(1, "Adair 1,200 2.5\nSt. Clair 3 4 oops")], "k int, block string")
    got, left = E.block_rows(blocks, "block", r"Adair|St\.? Clair", 2)
    assert rows(got) == [(1, "Adair", [1200.0, 2.5]), (1, "St. Clair", [3.0, 4.0])]
    assert rows(left) == [(1, "oops")]


def test_line_records(spark):
    text = "Permit Type\n 2022 2023 Change 2022 2023 Change\nPermittee  Any-Deer 1,000 2,000 +5% 10 20 <1%\nnot a record"
    reports = spark.createDataFrame([(2023, text), (2024, text)], "report int, text string")
    got = rows(E.line_records(reports.filter("report = 2023"), "text"))
    assert got == [(2023, "Permittee Any-Deer", 2022, 1000, 10), (2023, "Permittee Any-Deer", 2023, 2000, 20)]
    assert [r.report for r in E.year_header_errors(reports, "text", "report").collect()] == [2024]


def test_hunter_distribution(spark):
    text = "1 200 300 400\nTotal hunters 10 20 30\nDeer Harvested Number of Hunters\n0 1 2 3\n1 2 3 4\n2 3 4 5\n3 1 1 1\n4 or more 3 10 17"
    got = rows(E.hunter_distribution(spark.createDataFrame([(2020, text)], "y int, t string"), "t"))
    assert got == [(2020, "archery", 10, 1, 2, 3, 4), (2020, "firearms", 20, 2, 3, 4, 11), (2020, "combined", 30, 3, 4, 5, 18)]


def test_text_sections_keep_every_line(spark):
    docs = spark.createDataFrame([(1, "intro\n# A\nx\ny\n# B\n# C\nz")], "doc_id int, text string")
    got = rows(E.text_sections(docs, "text", lambda ln: ln.startswith("#")))
    assert got == [(1, -1, None, ["intro"]), (1, 0, "# A", ["x", "y"]), (1, 1, "# B", []), (1, 2, "# C", ["z"])]


def test_links(spark):
    urls = ["https://h/x?sp=turkey&y=1990-2500&yr=2005&s=fall&p=spring,DROP&co=29001,1,29003&r=North%20East", "https://h/x", "https://h/x?y=2019-2016&yo=q&m=archery"]
    df = E.filter_links(spark.createDataFrame([(u,) for u in urls], "url string"), "url", {"deer": (2015, 2025), "turkey": (2000, 2024)}, "deer", ("spring", "fall"), ("archery", "firearm"))
    a, b, c = df.collect()
    assert (a.species, a.year_from, a.year_to, a.year, a.season, a.portions, a.entities, a.region) == ("turkey", 2000, 2024, 2005, "fall", ["spring"], ["29001", "29003"], "North East")
    assert (b.species, b.year_from, b.year_to, b.year, b.portions) == ("deer", 2015, 2025, 2025, [])
    assert (c.year_from, c.year_to, c.method, c.youth) == (2016, 2016, "archery", "")


def test_view_links_fall_back_field_by_field(spark):
    urls = ["https://x.example/?view=board&metric=b&m2=a&sel=00012&cmp=00001,region%3AUp%20St.&ov=t,r,t", "https://x.example/?view=&sp=y&metric=b&m2=b&sel=12&cmp=region%3A9,00002,00003",
            "https://x.example/", None, "not a url at all", "https://x.example/?view=board&view=map&cmp=,,00004&sel=%zz&ov"]
    links = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    got = {r.i: tuple(r)[2:] for r in E.view_links(links, "url", ("x", "y"), "x", ("map", "board"), {"a": ("x", "y"), "b": ("x",)}, {"roads": "r", "trails": "t"}).collect()}
    assert got[0] == ("x", "board", "b", "a", "00012", "00001", "region:Up St.", ["roads", "trails"])
    assert got[1] == ("y", "map", "a", "", "", "", "00002", [])
    plain = ("x", "map", "a", "", "", "", "", [])
    assert got[2] == got[3] == got[4] == plain
    assert got[5] == ("x", "board", "a", "", "", "00004", "", [])


def test_malformed_links_are_read_as_far_as_they_go(spark):
    links = spark.createDataFrame([("http://a b/?y=2016-2017&y=1-2#y=3",), (None,), ("http://x/?y=%zz",)], "url string")
    df = E.filter_links(links, "url", {"deer": (2015, 2025)}, "deer", ("spring",), ("archery",))
    assert sorted((r.year_from, r.year_to) for r in df.collect()) == [(2015, 2025)] * 2 + [(2016, 2017)]
