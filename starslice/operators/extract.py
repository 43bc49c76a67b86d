"""Tables of documents to tables of facts.

Splitting a document stays inside its own row (regular expressions over the text column and
``posexplode``), so a corpus is parsed without a shuffle. A cell table has the columns
page_id, table_idx, row_idx, col_idx, text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starslice.functions import text as X
from starslice.runtime import literal_rows

TABLE = ["page_id", "table_idx"]


# -- markup --------------------------------------------------------------------------
def _opened(tag: str, inner: Column) -> Column:
    """What stands behind each start tag, up to the next one or its end tag: HTML lets the end tags of rows and cells be omitted."""
    return F.slice(F.split(F.regexp_replace(inner, rf"(?is)</(?:{tag})\s*>.*?(?=<(?:{tag})[\s>]|$)", ""), rf"(?i)<(?:{tag})(?:\s[^>]*)?>"), 2, 1_000_000_000)


_STATE = "struct<stack: array<struct<t: int, cell: boolean>>, n: int, owners: array<struct<owner: int, opened: int, shut: int>>>"


def tag_stream(pages: DataFrame, html: str, table: str = "table", row: str = "tr", cell: str = "t[dh]") -> DataFrame:
    """(.., _segments, _fold): the markup cut before every start and end tag of a table, and the table that each piece belongs to.

    A fold over the pieces keeps the stack of open tables, each with whether one of its cells is open. A start tag inside an open cell opens a
    nested table; elsewhere it ends the open one first, whose end tag is missing. An end tag without a start tag is ignored. ``opened`` is
    the table that a piece opens and ``shut`` the one that its end tag closes. Tables are numbered by their start tags; ``_fold.n`` is their number.
    """
    own = F.split(X.visible_markup(F.col(html)), rf"(?i)(?=</?(?:{table})[\s>])")

    def step(s: Column, seg: Column) -> Column:
        stack, depth = s["stack"], F.size(s["stack"])
        opens, closes = seg.rlike(rf"(?i)^<(?:{table})[\s>]"), seg.rlike(rf"(?i)^</(?:{table})[\s>]")
        top = F.get(stack, depth - 1)
        less = F.when((depth > 0) & (closes | (opens & ~top["cell"])), F.slice(stack, F.lit(1), F.greatest(depth - 1, F.lit(0)))).otherwise(stack)
        fresh = F.array(F.struct(s["n"].alias("t"), F.lit(False).alias("cell")))
        more = F.when(opens, F.concat(less, fresh)).otherwise(less)
        # the last tag of a row or cell tells whether a cell is open at the end of the piece
        last = F.lower(F.regexp_extract(seg, rf"(?is).*<(/?)(?:{row}|{cell}|caption)(?=[\s>])", 0))
        tag = F.regexp_extract(last, r"<(/?[a-z0-9]+)$", 1)
        inner = F.get(more, F.size(more) - 1)
        state = F.when(tag == "", inner["cell"]).otherwise(tag.rlike(f"^(?:{cell}|caption)$"))
        kept = F.when(F.size(more) > 0, F.concat(F.slice(more, F.lit(1), F.greatest(F.size(more) - 1, F.lit(0))), F.array(F.struct(
            inner["t"].alias("t"), state.alias("cell"))))).otherwise(more)
        mark = F.struct(
            F.coalesce(inner["t"], F.lit(-1)).alias("owner"), F.when(opens, s["n"]).alias("opened"), F.when(closes & (depth > 0), top["t"]).alias("shut"))
        return F.struct(kept.alias("stack"), (s["n"] + opens.cast("int")).alias("n"), F.concat(s["owners"], F.array(mark)).alias("owners")).cast(_STATE)

    start = F.struct(F.array().alias("stack"), F.lit(0).alias("n"), F.array().alias("owners")).cast(_STATE)
    cut = pages.withColumn("_segments", F.coalesce(own, F.array().cast("array<string>")))
    return cut.select(*[c for c in pages.columns if c != html], "_segments", F.aggregate("_segments", start, step).alias("_fold"))


def _own_text(table: str) -> Column:
    """The markup of table ``table_idx`` itself, without its own tags and without the tables inside it."""
    pieces = F.filter(F.transform("_segments", lambda seg, i: F.when(F.get("_owners", i)["owner"] == F.col("table_idx"), seg)), lambda x: x.isNotNull())
    return F.array_join(F.transform(pieces, lambda seg: F.regexp_replace(seg, rf"(?i)^</?(?:{table})(?:\s[^>]*)?>", " ")), " ")


def _numbered(stream: DataFrame) -> DataFrame:
    """One row per table. A page without one goes in the generator: a filter would be pushed below the fold and evaluate it again."""
    return stream.withColumn("table_idx", F.explode(F.when(F.col("_fold.n") > 0, F.sequence(F.lit(0), F.col("_fold.n") - 1)))).withColumn("_owners", F.col("_fold.owners"))


def html_cells(pages: DataFrame, html: str, table: str = "table", row: str = "tr", cell: str = "t[dh]") -> DataFrame:
    """Markup tables to cells; whitespace collapsed, rows without any text dropped. A nested table is a table of its own and no part of the outer one."""
    other = [c for c in pages.columns if c != html]
    tables = _numbered(tag_stream(pages, html, table, row, cell)).select(*other, "table_idx", _own_text(table).alias("_t"))
    rows = tables.select(*other, "table_idx", _opened(row, F.col("_t")).alias("_rows"))
    texts = F.transform("_rows", lambda r: F.transform(_opened(cell, r), lambda c: X.inner_text(c)))
    kept = F.filter(texts, lambda r: F.exists(r, lambda c: c != ""))
    numbered = rows.select(*other, "table_idx", F.posexplode(kept).alias("row_idx", "_r"))
    return numbered.select(*other, "table_idx", "row_idx", F.posexplode("_r").alias("col_idx", "text"))


def _headings(markup: Column, headings: str) -> Column:
    """The elements of these tags, in order; one without its end tag is no heading."""
    return F.regexp_extract_all(markup, F.lit(rf"(?is)<({headings})(?:\s[^>]*)?>(?:(?!<(?:{headings})[\s>]).)*?</\1\s*>"), F.lit(0))


def _usable(text: Column, only: str) -> Column:
    """Empty and purely numeric headings are passed over, and with ``only`` those that don't begin with it."""
    return ~text.rlike(r"^[\d,]*$") & (F.lower(text).startswith(only.lower()) if only else F.lit(True))


def html_tables(pages: DataFrame, html: str, headings: str = "h2|h3|h4|strong", only: str = "") -> DataFrame:
    """(.., table_idx, heading, caption, closed): the tables of a page, numbered as in ``html_cells``.

    The heading is the nearest usable one before the table's start tag, wherever it stands; headings that don't begin with ``only`` are passed
    over. A leading "Title" is dropped. ``closed`` is false for a table whose end tag is missing.
    """
    last = F.transform("_segments", lambda seg: F.try_element_at(F.filter(F.transform(_headings(seg, headings), X.inner_text), lambda t: _usable(t, only)), F.lit(-1)))
    tables = _numbered(tag_stream(pages, html).withColumn("_last", last))
    opened = F.transform("_owners", lambda o: F.coalesce(o["opened"], F.lit(-1)))
    before = F.slice("_last", F.lit(1), (F.array_position(opened, F.col("table_idx")) - 1).cast("int"))
    heading = F.try_element_at(F.filter(before, lambda t: t.isNotNull()), F.lit(-1))
    caption = X.inner_text(F.regexp_extract(_own_text("table"), r"(?is)<caption(?:\s[^>]*)?>(.*?)(?:</caption\s*>|<t(?:r|body|head|foot)[\s>]|$)", 1))
    closed = F.exists("_owners", lambda o: o["shut"] == F.col("table_idx"))
    return tables.select(
        *[c for c in pages.columns if c != html], "table_idx", F.regexp_replace(heading, r"(?i)^title\s+", "").alias("heading"), caption.alias("caption"),
        F.coalesce(closed, F.lit(False)).alias("closed"))


def nearest_heading(pages: DataFrame, html: str, item: str, headings: str = "h2|h3|h4|strong") -> DataFrame:
    """(.., item_idx, heading, raw, item): every ``item`` element (which doesn't nest) with the nearest usable heading before it.

    Headings and items are found in one scan of the text, and the lookup stays inside the page's row, so no ordering across rows is needed.
    """
    other = [c for c in pages.columns if c != html]
    # a heading ends with its own end tag and never holds an item: one without an end tag is no heading
    own = "|".join(rf"<{h}(?:\s[^>]*)?>(?:(?!<(?:{item})[\s>]).)*?</{h}\s*>" for h in headings.split("|"))
    pattern = rf"(?is)<(?:{item})(?:\s[^>]*)?>.*?</(?:{item})>|{own}"
    is_item = lambda e: e.rlike(rf"(?i)^<(?:{item})[\s>]")
    found = pages.select(*other, F.regexp_extract_all(X.visible_markup(F.col(html)), F.lit(pattern), F.lit(0)).alias("_e"))
    usable = F.filter(F.transform("_e", lambda e, i: F.when(~is_item(e) & _usable(X.inner_text(e), ""), i)), lambda i: i.isNotNull())
    found = found.withColumn("_h", usable)
    items = F.filter(
        F.transform("_e", lambda e, i: F.when(is_item(e), F.struct(
            e.alias("raw"), F.get("_e", F.array_max(F.filter("_h", lambda h: h < i))).alias("head")))),
        lambda s: s.isNotNull(),
    )
    flat = found.select(*other, F.posexplode(items).alias("item_idx", "_i"))
    title = F.regexp_replace(X.inner_text(F.col("_i.head")), r"(?i)^title\s+", "")
    return flat.select(*other, "item_idx", title.alias("heading"), F.col("_i.raw").alias("raw"), X.inner_text(F.col("_i.raw")).alias("item"))


def table_title(caption: Column, heading: Column, generic: tuple[str, ...]) -> Column:
    """A specific caption wins; a generic one is appended to the heading; no caption leaves the heading."""
    has = F.coalesce(caption, F.lit("")) != ""
    return (
        F.when(has & ~F.lower(caption).isin(*generic), caption)
        .when(has, F.concat_ws(" ", heading, caption)).otherwise(heading)
    )


def with_date_range(title: Column, caption: Column) -> Column:
    """Append a date-range caption that is neither generic nor already a season title."""
    low = F.lower(caption)
    keep = caption.isNotNull() & (caption != "") & ~low.startswith("all counties") & ~low.rlike("spring|fall|turkey")
    return F.when(keep, F.format_string("%s (%s)", title, caption)).otherwise(title)


def first_match(title: Column, rules: list[tuple]) -> Column:
    """Struct of the first rule whose pattern is found, NULL when none is (an error for the caller)."""
    low = F.lower(title)
    out = F.lit(None)
    for pattern, slug, subtotal, method, youth in reversed(rules):
        hit = F.struct(F.lit(slug).alias("portion"), F.lit(subtotal).alias("is_subtotal"), F.lit(method).alias("method"), F.lit(youth).alias("youth"))
        out = F.when(low.rlike(pattern), hit).otherwise(out)
    return out


def first_match_slug(title: Column, rules: list[tuple[str, str]]) -> Column:
    return F.coalesce(*[F.when(title.rlike(p), s) for p, s in rules])


# -- parsed tables ----------------------------------------------------------------------
def header_rows(cells: DataFrame, labels: tuple[str, ...] = ("county",)) -> DataFrame:
    """(page, table, row): rows whose first cell is a header label."""
    return cells.filter((F.col("col_idx") == 0) & F.lower("text").isin(*labels)).select(*TABLE, "row_idx")


def split_header(cells: DataFrame, labels: tuple[str, ...] = ("county",)) -> tuple[DataFrame, DataFrame]:
    """(header, body): the first header row of each table, and the rows after it without repeated headers."""
    marks = header_rows(cells, labels)
    first = marks.groupBy(*TABLE).agg(F.min("row_idx").alias("_h"))
    after = cells.join(first, TABLE)
    header = after.filter(F.col("row_idx") == F.col("_h")).select(*TABLE, "col_idx", F.lower("text").alias("header"))
    body = after.filter(F.col("row_idx") > F.col("_h")).drop("_h").join(marks, [*TABLE, "row_idx"], "left_anti")
    return header, body


def header_problems(tables: DataFrame, cells: DataFrame, labels: tuple[str, ...] = ("county",)) -> DataFrame:
    """(page, table, error): tables without a header row (or without any cell), and rows that stand above it."""
    first = header_rows(cells, labels).groupBy(*TABLE).agg(F.min("row_idx").alias("_h"))
    none = tables.select(*TABLE).join(first, TABLE, "left_anti").withColumn("error", F.lit("no header row"))
    above = cells.join(first, TABLE).filter(F.col("row_idx") < F.col("_h")).select(*TABLE).distinct()
    return none.unionByName(above.withColumn("error", F.lit("row above the header")))


def remap_header(header: DataFrame, present: str, absent: str, role_as: str) -> DataFrame:
    """Read one header as another in tables that have the first but not the second."""
    sets = header.groupBy(*TABLE).agg(F.collect_set("header").alias("_s"))  # as wide as one table
    hit = F.array_contains("_s", present) & ~F.array_contains("_s", absent) & (F.col("header") == present)
    return header.join(sets, TABLE).withColumn("header", F.when(hit, role_as).otherwise(F.col("header"))).drop("_s")


def header_roles(header: DataFrame, roles: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(roles per column, errors): unknown headers and tables without a total column are errors."""
    known = literal_rows(header.sparkSession, list(roles.items()), "header string, role string")
    named = header.filter(F.col("col_idx") > 0)
    mapped = named.join(known, "header").select(*TABLE, "col_idx", "role")
    unknown = named.join(known, "header", "left_anti").select(*TABLE, F.concat(F.lit("unknown header "), F.col("header")).alias("error"))
    no_total = header.select(*TABLE).distinct().join(mapped.filter("role = 'total'").select(*TABLE).distinct(), TABLE, "left_anti")
    return mapped, unknown.unionByName(no_total.withColumn("error", F.lit("no total column")))


def width_errors(header: DataFrame, body: DataFrame) -> DataFrame:
    """Body rows whose cell count differs from the header's."""
    want = header.groupBy(*TABLE).agg(F.count("*").alias("expected"))
    got = body.groupBy(*TABLE, "row_idx").agg(F.count("*").alias("found"))
    return got.join(want, TABLE).filter(F.col("found") != F.col("expected"))


def parsed_rows(body: DataFrame, roles: DataFrame) -> DataFrame:
    """(page, table, row, label, role, text, value): one row per class, extra or total cell; NULL value = reject."""
    label = body.filter("col_idx = 0").select(*TABLE, "row_idx", F.col("text").alias("label"))
    cells = body.join(roles.filter("role <> 'skip'"), [*TABLE, "col_idx"])
    return cells.join(label, [*TABLE, "row_idx"]).select(
        *TABLE, "row_idx", "label", "role", "text", X.clean_int(F.col("text")).alias("value")
    )


def split_totals(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entity rows, total rows, errors): a table with two total rows is an error."""
    total = X.is_total_label(F.col("label"))
    totals = rows.filter(total)
    twice = totals.groupBy(*TABLE).agg(F.count_distinct("row_idx").alias("n")).filter("n > 1")
    return rows.filter(~total), totals, twice.select(*TABLE, F.lit("two total rows").alias("error"))


def borrowed_totals(cells: DataFrame, header: DataFrame, roles: DataFrame, totals: DataFrame) -> DataFrame:
    """(page, table, role, value): for tables without a Total row, the first one of the table before it on the page that is as wide as their header.

    ``cells`` are those of all tables, so that a table that is skipped otherwise can lend its row; columns are read by the borrower's header.
    """
    lacking = header.groupBy(*TABLE).agg(F.count("*").alias("width")).join(totals.select(*TABLE).distinct(), TABLE, "left_anti")
    rows = cells.groupBy(*TABLE, "row_idx").agg(F.count("*").alias("width"), F.max(F.when(F.col("col_idx") == 0, F.col("text"))).alias("label"))
    lenders = rows.filter(X.is_total_label(F.col("label"))).withColumn("lender", F.col("table_idx")).withColumn("table_idx", F.col("table_idx") + 1)
    first = lenders.join(lacking, [*TABLE, "width"], "left_semi").groupBy(*TABLE, "lender").agg(F.min("row_idx").alias("row_idx"))
    values = cells.withColumnRenamed("table_idx", "lender").join(first, ["page_id", "lender", "row_idx"])
    return values.join(roles.filter("role <> 'skip'"), [*TABLE, "col_idx"]).select(*TABLE, "role", X.clean_int(F.col("text")).alias("value"))


def summary_rows(cells: DataFrame, classes: tuple[str, ...], skip: str = "season/portion") -> DataFrame:
    """Rows of a summary box: a label and one whole number per class and the total; other rows are ignored."""
    rows = cells.groupBy(*TABLE, "row_idx").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "text"))), lambda c: c["text"]).alias("c")
    )
    vals = F.transform(F.slice("c", 2, len(classes) + 1), lambda t: X.clean_int(t))
    full = rows.filter((F.size("c") == len(classes) + 2) & (F.lower(F.col("c")[0]) != skip)).withColumn("v", vals)
    return full.filter(~F.exists("v", lambda x: x.isNull())).select(
        *TABLE, "row_idx", F.col("c")[0].alias("label"), *[F.col("v")[i].alias(n) for i, n in enumerate((*classes, "total"))]
    )


def unpivot_classes(wide: DataFrame, keys: list[str], classes: list[str]) -> DataFrame:
    """One row per class, zeros included."""
    return wide.unpivot(keys, classes, "class", "cnt")


def skip_titles(tables: DataFrame, pattern: str) -> tuple[DataFrame, DataFrame]:
    """(kept, skipped): duplicate views are set aside for the audit, not lost."""
    hit = F.coalesce(F.lower("title").rlike(pattern), F.lit(False))
    return tables.filter(~hit), tables.filter(hit)


# -- names to keys ---------------------------------------------------------------------------
def alias_dim(names: DataFrame, key: str, name: str = "name", aliases: str = "aliases") -> DataFrame:
    """(alias, key): the name and every alias of an entity, normalised."""
    spelled = names.select(key, F.explode(F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>")))).alias("_a"))
    return spelled.select(X.normalize_name(F.col("_a")).alias("alias"), key).distinct()


def alias_collisions(aliases: DataFrame, key: str) -> DataFrame:
    """Aliases that name more than one entity; pairs are made unique first, so a hot alias is spread."""
    return aliases.select("alias", key).distinct().groupBy("alias").agg(F.count("*").alias("n")).filter("n > 1")


def fill_aliases(aliases: DataFrame, extra: DataFrame) -> DataFrame:
    """Extra spellings that only fill gaps."""
    return aliases.unionByName(extra.join(aliases, "alias", "left_anti"))


def resolve(rows: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Rows with their key; NULL when the name is unknown."""
    return rows.withColumn("alias", X.normalize_name(F.col(column))).join(aliases, "alias", "left")


def bucket_key(name: Column, not_a_place: tuple[str, ...], spellings: dict[str, str]) -> tuple[Column, Column]:
    """(name to look up, is a known non-place): a source's own misspellings are mapped first."""
    low = F.lower(X.strip(F.coalesce(name, F.lit(""))))
    fixed = reduce(lambda acc, kv: F.when(low == kv[0], kv[1]).otherwise(acc), spellings.items(), name)
    return fixed, low.isin(*not_a_place)


# -- text reports -----------------------------------------------------------------------------
def text_sections(docs: DataFrame, text: str, is_header) -> DataFrame:
    """(section, header, lines): lines cut at header lines; lines before the first header are section -1."""
    lines = F.split(text, "\n")
    at = F.filter(F.transform(lines, lambda ln, i: F.when(is_header(ln), i)), lambda i: i.isNotNull())
    body = docs.withColumn("_l", lines).withColumn("_at", at)
    spans = F.transform(
        "_at",
        lambda p, k: F.struct(
            k.alias("section"), F.get("_l", p).alias("header"),
            F.slice("_l", p + 2, F.coalesce(F.get("_at", k + 1), F.size("_l")) - p - 1).alias("lines"),
        ),
    )
    lead = F.struct(
        F.lit(-1).alias("section"), F.lit(None).cast("string").alias("header"),
        F.slice("_l", 1, F.coalesce(F.get("_at", F.lit(0)), F.size("_l"))).alias("lines"),
    )
    every = F.filter(F.concat(F.array(lead), spans), lambda s: (s["section"] >= 0) | (F.size(s["lines"]) > 0))
    return body.select(*[c for c in docs.columns if c != text], F.inline(every))


def block_rows(blocks: DataFrame, block: str, names: str, width: int) -> tuple[DataFrame, DataFrame]:
    """(rows, leftovers): ``name n1 .. nk`` records found in a text block, and text no record explains.

    ``names`` is an alternation of entity names. Repeats of a name are for the caller to reject.
    """
    num = r"[\d,]+(?:\.\d+)?"
    row = rf"(?i)(?<![A-Za-z])({names})\s+({num}(?:\s+{num}){{{width - 1}}})(?![\d.,])"
    keys = [c for c in blocks.columns if c != block]
    hits = F.arrays_zip(
        F.regexp_extract_all(block, F.lit(row), 1).alias("name"), F.regexp_extract_all(block, F.lit(row), 2).alias("nums")
    )
    rows = blocks.select(*keys, F.inline(hits)).select(
        *keys, "name", F.transform(F.split("nums", r"\s+"), lambda n: X.clean_decimal(n)).alias("values")
    )
    rest = X.collapse(F.regexp_replace(block, row, " "))
    return rows, blocks.select(*keys, rest.alias("leftover")).filter("leftover <> ''")


def header_order(header: Column, phrases: list[tuple[str, str]]) -> Column:
    """Columns in the order in which their phrases appear in a header."""
    low = F.regexp_replace(F.lower(header), r"\s+", " ")
    found = F.array(*[F.struct(F.regexp_instr(low, F.lit(p)).alias("at"), F.lit(c).alias("col")) for p, c in phrases])
    return F.transform(F.array_sort(F.filter(found, lambda s: s["at"] > 0)), lambda s: s["col"])


def _tokens(line: Column) -> Column:
    return F.filter(F.split(line, r"\s+"), lambda w: w != "")


def _is_count(token: Column) -> Column:
    return token.rlike(r"^[0-9,]+$") & token.rlike("[0-9]")


def _is_change(token: Column) -> Column:
    """A signed or bounded percentage; the number itself may be missing."""
    return token.endswith("%") & (F.length(F.translate(token, "+-<>0123456789%", "")) == 0)


def _years(line: Column) -> Column:
    """The years of a header of two year pairs, each followed by the word Change; NULL for any other line."""
    words = _tokens(line)
    years = F.filter(words, lambda w: w.rlike("^[0-9]{4}$"))
    marks = F.filter(words, lambda w: w == "Change")
    in_place = (F.get(words, F.lit(2)) == "Change") & (F.get(words, F.lit(5)) == "Change")
    return F.when((F.size(words) == 6) & (F.size(years) == 4) & (F.size(marks) == 2) & in_place, years)


def _record(line: Column) -> Column:
    """(label, values) of a line that ends in count count change count count change; NULL for any other line."""
    words = _tokens(line)
    n = F.size(words)
    values = F.slice(words, F.greatest(n - 5, F.lit(1)), 6)
    label = F.array_join(F.slice(words, 1, F.greatest(n - 6, F.lit(0))), " ")
    kinds = [_is_change if k in (2, 5) else _is_count for k in range(6)]
    typed = reduce(lambda a, b: a & b, [is_kind(F.get(values, F.lit(k))) for k, is_kind in enumerate(kinds)])
    lettered = (F.length(label) > 0) & (F.length(F.translate(F.lower(label), "abcdefghijklmnopqrstuvwxyz- ", "")) == 0) & label.rlike("^[A-Za-z]")
    return F.when((n > 6) & typed & lettered, F.named_struct(F.lit("label"), label, F.lit("values"), values))


def line_records(reports: DataFrame, text: str) -> DataFrame:
    """Two-year record lines of a report: (.., label, season_year, issued, filled), two rows per line.

    The year header of the same report gives the years; a report without one yields NULL years. Records are looked for behind the
    header, or in the whole report where it has none.
    """
    keys = [c for c in reports.columns if c != text]
    lines = F.split(text, "\n")
    found = F.filter(F.transform(lines, lambda ln, i: F.named_struct(F.lit("y"), _years(ln), F.lit("i"), i)), lambda h: h["y"].isNotNull())
    head = reports.select(*keys, F.get(found, F.lit(0)).alias("_h"), F.posexplode(lines).alias("_at", "_line"))
    rows = head.filter(F.coalesce(F.col("_at") > F.col("_h.i"), F.lit(True))).withColumn("_r", _record(F.col("_line"))).filter("_r IS NOT NULL")
    value = lambda k: X.clean_int(F.get("_r.values", F.lit(k)))
    sides = [F.struct(F.get("_h.y", F.lit(i)).cast("int").alias("season_year"), value(i).alias("issued"), value(3 + i).alias("filled")) for i in (0, 1)]
    return rows.select(*keys, F.col("_r.label").alias("label"), F.inline(F.array(*sides)))


def year_header_errors(reports: DataFrame, text: str, year: str) -> DataFrame:
    """Reports whose two year pairs differ or do not end in the report year."""
    found = F.filter(F.transform(F.split(text, "\n"), _years), lambda y: y.isNotNull())
    y = [F.get(F.get(found, F.lit(0)), F.lit(k)).cast("int") for k in range(4)]
    ok = (y[0] == y[2]) & (y[1] == y[3]) & (y[1] == F.col(year)) & (y[0] == F.col(year) - 1)
    return reports.filter(~F.coalesce(ok, F.lit(False)))


# Fixed value: the heading of the distribution in the reports.
DISTRIBUTION_HEADING = r"deer\s+harvested\s+number\s+of\s+hunters"


def hunter_distribution(reports: DataFrame, text: str, heading: str = DISTRIBUTION_HEADING) -> DataFrame:
    """(method, total, none, one, two, three_plus) per report; the rows for 3 and 4-or-more are folded.

    The rows are looked for behind the heading of the distribution only; a report without it has no distribution.
    """
    keys = [c for c in reports.columns if c != text]
    three = r"\s+([\d,]+)\s+([\d,]+)\s+([\d,]+)"

    behind = F.regexp_extract(text, rf"(?is){heading}(.*)", 1)

    def grab(pattern: str, group: int, where: Column | str = behind) -> Column:
        return X.clean_int(F.nullif(F.regexp_extract(where, rf"(?im){pattern}{three}\s*$", group), F.lit("")))

    methods = [
        F.struct(
            F.lit(m).alias("method"), grab(r"total\s+hunters", g, text).alias("total"), grab("^0", g).alias("none"), grab("^1", g).alias("one"),
            grab("^2", g).alias("two"), (grab("^3", g) + grab("^4 or more", g)).alias("three_plus"),
        )
        for g, m in ((1, "archery"), (2, "firearms"), (3, "combined"))
    ]
    return reports.filter(F.col(text).rlike(rf"(?i){heading}")).select(*keys, F.inline(F.array(*methods)))


# -- shared links -----------------------------------------------------------------------------
def _parameters(url: str) -> Column:
    """The parameters of a link's query string as [name, value] in order; links that are no valid addresses are read alike, so none fails the job."""
    query = F.coalesce(F.regexp_extract(F.col(url), r"^[^?#]*\?([^#]*)", 1), F.lit(""))
    return F.transform(F.split(query, "&"), lambda p: F.split(p, "=", 2))


def _parameter(parameters: str, name: str) -> Column:
    """The decoded value of the first parameter of that name; empty where there is none or its value can't be decoded."""
    found = F.filter(parameters, lambda p: F.get(p, F.lit(0)) == name)
    return F.coalesce(F.try_url_decode(F.get(F.get(found, F.lit(0)), F.lit(1))), F.lit(""))


def filter_links(links: DataFrame, url: str, species: dict[str, tuple[int, int]], default: str, seasons: tuple[str, ...],
                 methods: tuple[str, ...], entity_pattern: str = r"^\d{5}$", region_chars: int | None = None,
                 most_entities: int | None = None) -> DataFrame:
    """Query strings of shared links to validated slices: bad values fall back, years are clamped."""
    get = lambda k: _parameter("_q", k)
    one_of = lambda v, allowed: F.when(v.isin(*allowed), v).otherwise("")
    words = lambda v, pat: F.filter(F.split(v, ","), lambda w: w.rlike(pat))
    sp = F.when(get("sp").isin(*species), get("sp")).otherwise(default)
    lo = reduce(lambda acc, kv: F.when(F.col("species") == kv[0], kv[1][0]).otherwise(acc), species.items(), F.lit(0))
    hi = reduce(lambda acc, kv: F.when(F.col("species") == kv[0], kv[1][1]).otherwise(acc), species.items(), F.lit(0))
    span = F.split(get("y"), "-")
    # a missing, malformed or zero bound means the full range
    number = lambda c: F.when(X.strip(c).rlike(r"^\d{1,9}$"), X.strip(c).try_cast("int"))
    bound = lambda c: F.when(number(c) != 0, number(c))
    df = links.withColumn("_q", _parameters(url)).withColumn("species", sp)
    df = df.withColumn("year_to", F.greatest(F.least(F.coalesce(bound(F.get(span, F.lit(1))), hi), hi), lo))
    df = df.withColumn("year_from", F.greatest(F.least(F.coalesce(bound(F.get(span, F.lit(0))), lo), F.col("year_to")), lo))
    picked, entities = number(get("yr")), words(get("co"), entity_pattern)
    return df.select(
        *links.columns, "species", "year_from", "year_to",
        F.when(picked.between(F.col("year_from"), F.col("year_to")), picked).otherwise(F.col("year_to")).alias("year"),
        one_of(get("s"), seasons).alias("season"), words(get("p"), r"^[a-z_]+$").alias("portions"),
        one_of(get("m"), methods).alias("method"), one_of(get("yo"), ("y", "n")).alias("youth"),
        words(get("c"), r"^[a-z_]+$").alias("classes"), (F.substring(get("r"), 1, region_chars) if region_chars else get("r")).alias("region"),
        (F.slice(entities, 1, most_entities) if most_entities else entities).alias("entities"),
    )


def view_links(links: DataFrame, url: str, kinds: tuple[str, ...], default: str, views: tuple[str, ...], metrics: dict[str, tuple[str, ...]], layers: dict[str, str],
               second: dict[str, tuple[str, ...]] | None = None, entity_pattern: str = r"^\d{5}$", region_pattern: str = r"^region:[A-Za-z. ]{1,30}$") -> DataFrame:
    """What shared links show, beside their slice: (.., species, view, metric, metric2, selected, compare_a, compare_b, layers).

    ``metrics`` and ``second`` (the same where it isn't given) name for each metric the species that it applies to. An unknown view is the first of ``views``; a metric that is
    unknown or doesn't apply is the first of ``metrics``, and no second one. A bad entity or compared place is the empty string; a place is an entity or a named region. ``layers``
    maps layers to their tokens in links; those found come in the order of ``layers``, each once. A parameter's first occurrence counts.
    """
    get = lambda k: _parameter("_q", k)

    def for_kind(value: Column, of: dict[str, tuple[str, ...]], otherwise: str) -> Column:
        fits = [F.col("species").isin(*own) & (value == m) for m, own in of.items()]
        return F.when(reduce(lambda a, b: a | b, fits, F.lit(False)), value).otherwise(otherwise)

    words = lambda v: F.split(v, ",")
    place = lambda w: F.when(w.rlike(entity_pattern) | w.rlike(region_pattern), w).otherwise("")
    # empty words don't count as places
    sides = F.filter(words(get("cmp")), lambda w: w != "")
    tokens = words(get("ov"))
    shown = F.filter(F.array(*[F.when(F.array_contains(tokens, token), F.lit(layer)) for layer, token in layers.items()]), lambda x: x.isNotNull())
    df = links.withColumn("_q", _parameters(url)).withColumn("species", F.when(get("sp").isin(*kinds), get("sp")).otherwise(default))
    return df.select(
        *links.columns, "species", F.when(get("view").isin(*views), get("view")).otherwise(views[0]).alias("view"),
        for_kind(get("metric"), metrics, next(iter(metrics))).alias("metric"), for_kind(get("m2"), second or metrics, "").alias("metric2"),
        F.when(get("sel").rlike(entity_pattern), get("sel")).otherwise("").alias("selected"),
        *[F.coalesce(place(F.get(sides, F.lit(k))), F.lit("")).alias(f"compare_{side}") for k, side in enumerate("ab")], shown.alias("layers"),
    )
