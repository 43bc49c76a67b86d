"""Extraction jobs over pages, documents and labelled rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from starslice.functions import text as X
from starslice.operators import extract as E
from starslice.sources import driver_tables as D
from starslice.workload.registry import query


def letters(c):
    """Customer names carry digits only; letters make them usable as place names."""
    return F.translate(c, "0123456789", "abcdefghij")


L = "translate(c_name, '0123456789', 'abcdefghij')"


def norm_sql(e: str) -> str:
    e = f"regexp_replace(replace(lower({e}), chr(160), ' '), '\\(.*?\\)', ' ', 'g')"
    return f"regexp_replace(trim(regexp_replace(regexp_replace({e}, '[^a-z ]', ' ', 'g'), '\\s+', ' ', 'g')), ' county$', '')"


@query("page_scan", r"""SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '/([a-z]{2})/(\d+)', 1) AS lang, count(*) AS pages,
  CAST(max(TRY_CAST(regexp_extract(url, '/([a-z]{2})/(\d+)', 2) AS INT)) AS INT) AS last, CAST(sum(length(html)) AS BIGINT) AS chars FROM pages GROUP BY 1, 2""")
def page_scan(s, d):
    """Every page by the keys in its address; a page without them is in the group of the empty key."""
    part = lambda g: F.regexp_extract("url", r"/([a-z]{2})/(\d+)", g)
    return D.table(s, d, "pages").groupBy(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), part(1).alias("lang")).agg(
        F.count("*").alias("pages"), F.max(part(2).try_cast("int")).alias("last"), F.sum(F.length("html")).alias("chars")
    )


def names(s, d):
    c = D.table(s, d, "customer")
    own = letters(F.col("c_name"))
    return c.select("c_custkey", own.alias("name"), F.array(F.concat(F.lit("St. "), own), F.concat(F.upper(own), F.lit(" (City) County"))).alias("aliases"))


ALIAS = f"""al AS (SELECT DISTINCT {norm_sql('a')} AS alias, c_custkey FROM (SELECT c_custkey, unnest([{L}, 'St. ' || {L}, upper({L}) || ' (City) County']) AS a FROM customer))"""


@query("alias_dim", f"WITH {ALIAS} SELECT alias, c_custkey FROM al")
def alias_dim(s, d):
    return E.alias_dim(names(s, d), "c_custkey")


@query("alias_resolve", f"""WITH {ALIAS}, raw AS (SELECT o_orderkey, {norm_sql(f"CASE WHEN o_custkey % 97 = 0 THEN 'Atlantis' ELSE upper({L}) || ' (' || o_orderpriority || ') County' END")} AS alias FROM orders JOIN customer ON c_custkey = o_custkey)
  SELECT al.c_custkey, count(*) AS n FROM raw LEFT JOIN al USING (alias) GROUP BY 1""")
def alias_resolve(s, d):
    orders = D.table(s, d, "orders").join(D.table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    raw = orders.select(
        "o_orderkey",
        F.when(F.col("o_custkey") % 97 == 0, "Atlantis")
        .otherwise(F.concat(F.upper(letters(F.col("c_name"))), F.lit(" ("), F.col("o_orderpriority"), F.lit(") County"))).alias("printed"),
    )
    return E.resolve(raw, "printed", E.alias_dim(names(s, d), "c_custkey")).groupBy("c_custkey").agg(F.count("*").alias("n"))


@query("alias_collisions", f"""WITH al AS (SELECT DISTINCT {norm_sql('a')} AS alias, p_partkey FROM (SELECT p_partkey, unnest([p_name, p_name || ' (' || p_brand || ')', p_type || ' ' || p_name]) AS a FROM part))
  SELECT alias, count(DISTINCT p_partkey) AS n FROM al GROUP BY alias HAVING count(DISTINCT p_partkey) > 1""")
def alias_collisions(s, d):
    parts = D.table(s, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.array(
        F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")")), F.concat_ws(" ", "p_type", "p_name")
    ).alias("aliases"))
    return E.alias_collisions(E.alias_dim(parts, "p_partkey"), "p_partkey")


@query("normalize_names", f"""SELECT p_partkey, {norm_sql("'  ' || upper(p_name) || chr(160) || '(' || p_brand || ') ' || p_type || '. County'")} AS name FROM part""")
def normalize_names(s, d):
    raw = F.concat(F.lit("  "), F.upper("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(") "), F.col("p_type"), F.lit(". County"))
    return D.table(s, d, "part").select("p_partkey", X.normalize_name(raw).alias("name"))


UNESC = "replace(replace(replace(replace(replace(replace({e}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"
VIS = r"regexp_replace(html, '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>', ' ', 'g')"


def text_sql(e: str) -> str:
    return "trim(regexp_replace(" + UNESC.format(e=f"regexp_replace({e}, '<[^>]*>', ' ', 'g')") + r", '[\s\x{00a0}]+', ' ', 'g'))"


@query("html_cells", rf"""WITH t AS (SELECT page_id, unnest(regexp_extract_all({VIS}, '(?is)<ul(?:\s[^>]*)?>(.*?)</ul>', 1)) AS t, generate_subscripts(regexp_extract_all({VIS}, '(?is)<ul(?:\s[^>]*)?>(.*?)</ul>', 1), 1) - 1 AS table_idx FROM pages),
  r AS (SELECT page_id, table_idx, unnest(regexp_extract_all(t, '(?is)<li(?:\s[^>]*)?>(.*?)</li>', 1)) AS r, generate_subscripts(regexp_extract_all(t, '(?is)<li(?:\s[^>]*)?>(.*?)</li>', 1), 1) AS i FROM t),
  c AS (SELECT page_id, table_idx, i, unnest(regexp_extract_all(r, '(?is)<a(?:\s[^>]*)?>(.*?)</a>', 1)) AS c, generate_subscripts(regexp_extract_all(r, '(?is)<a(?:\s[^>]*)?>(.*?)</a>', 1), 1) - 1 AS col_idx FROM r),
  x AS (SELECT page_id, table_idx, i, col_idx, {text_sql('c')} AS text FROM c), k AS (SELECT * FROM x QUALIFY bool_or(text <> '') OVER (PARTITION BY page_id, table_idx, i))
  SELECT page_id, CAST(table_idx AS INT) AS table_idx, CAST(dense_rank() OVER (PARTITION BY page_id, table_idx ORDER BY i) - 1 AS INT) AS row_idx, CAST(col_idx AS INT) AS col_idx, text FROM k""")
def html_cells(s, d):
    return E.html_cells(D.table(s, d, "pages").select("page_id", "html"), "html", "ul", "li", "a")


@query("nearest_heading", rf"""WITH e AS (SELECT page_id, unnest(regexp_extract_all({VIS}, '(?is)<(?:title|h1|h2)>.*?</(?:title|h1|h2)>|<li>.*?</li>')) AS e, generate_subscripts(regexp_extract_all({VIS}, '(?is)<(?:title|h1|h2)>.*?</(?:title|h1|h2)>|<li>.*?</li>'), 1) AS i FROM pages),
  x AS (SELECT page_id, i, starts_with(e, '<li') AS item, {text_sql('e')} AS text FROM e), h AS (SELECT *, last_value(CASE WHEN NOT item AND text <> '' AND NOT regexp_matches(text, '^[\d,]+$') THEN text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i) AS heading FROM x)
  SELECT page_id, heading, text AS item, count(*) AS n FROM h WHERE item GROUP BY ALL""")
def nearest_heading(s, d):
    items = E.nearest_heading(D.table(s, d, "pages").select("page_id", "html"), "html", "li", "title|h1|h2")
    return items.groupBy("page_id", "heading", "item").agg(F.count("*").alias("n"))


MONEY = """CASE p_partkey % 8 WHEN 0 THEN '' WHEN 1 THEN '-' WHEN 2 THEN chr(8212) WHEN 3 THEN chr(160) || CAST(p_size AS VARCHAR) WHEN 4 THEN 'n/a' WHEN 5 THEN CAST(p_retailprice AS VARCHAR) ELSE format('{:,}', CAST(floor(p_retailprice) AS BIGINT)) END"""


@query("clean_ints", f"""WITH r AS (SELECT p_partkey, {MONEY} AS raw FROM part), b AS (SELECT p_partkey, trim(replace(replace(raw, ',', ''), chr(160), '')) AS bare FROM r)
  SELECT p_partkey, CASE WHEN bare IN ('', '-', chr(8212)) THEN 0 WHEN regexp_full_match(bare, '\\d+') THEN CAST(bare AS BIGINT) END AS value FROM b""")
def clean_ints(s, d):
    k = F.col("p_partkey") % 8
    raw = (
        F.when(k == 0, "").when(k == 1, "-").when(k == 2, X.EM_DASH).when(k == 3, F.concat(F.lit(X.NBSP), F.col("p_size").cast("string")))
        .when(k == 4, "n/a").when(k == 5, F.col("p_retailprice").cast("string")).otherwise(F.format_number(F.floor("p_retailprice"), 0))
    )
    return D.table(s, d, "part").select("p_partkey", X.clean_int(raw).alias("value"))


RULES = [(r"\sthe\s.*\sof\s", "english"), (r"\s(der|und)\s", "german"), (r"\sles?\s", "french"), (r"\s(que|el)\s", "spanish")]


@query("classify_first_match", r"""SELECT CASE WHEN regexp_matches(lower(text), '(?s)\sthe\s.*\sof\s') THEN 'english' WHEN regexp_matches(lower(text), '\s(der|und)\s') THEN 'german' WHEN regexp_matches(lower(text), '\sles?\s') THEN 'french'
  WHEN regexp_matches(lower(text), '\s(que|el)\s') THEN 'spanish' END AS slug, lang, count(*) AS n FROM documents GROUP BY ALL""")
def classify_first_match(s, d):
    # the dot matches line breaks, so the rules see the whole text
    rules = [(f"(?s){p}", slug) for p, slug in RULES]
    docs = D.table(s, d, "documents").select("lang", E.first_match_slug(F.lower("text"), rules).alias("slug"))
    return docs.groupBy("slug", "lang").agg(F.count("*").alias("n"))


@query("text_sections", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
  h AS (SELECT *, regexp_matches(line, '^\S+( \S+){0,2}$') AS head FROM l), g AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS section FROM h)
  SELECT doc_id, CAST(section AS INT) AS section, max(CASE WHEN head THEN line END) AS header, CAST(count(CASE WHEN NOT head THEN 1 END) AS INT) AS n_lines, CAST(coalesce(sum(CASE WHEN NOT head THEN length(line) END), 0) AS BIGINT) AS n_chars FROM g GROUP BY doc_id, section""")
def text_sections(s, d):
    docs = D.table(s, d, "documents").select("doc_id", "text")
    cut = E.text_sections(docs, "text", lambda ln: ln.rlike(r"^\S+( \S+){0,2}$"))
    chars = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return cut.select("doc_id", "section", "header", F.size("lines").alias("n_lines"), chars.alias("n_chars"))


@query("header_order", """WITH p AS (SELECT doc_id, unnest(['tion', 'ment', 'eau', 'ble', 'sch', 'cion']) AS ph, strpos(regexp_replace(lower(text), '\\s+', ' ', 'g'), ph) AS pos FROM documents)
  SELECT doc_id, string_agg(ph, ',' ORDER BY pos, ph) AS columns FROM p WHERE pos > 0 GROUP BY doc_id""")
def header_order(s, d):
    phrases = [(p, p) for p in ("tion", "ment", "eau", "ble", "sch", "cion")]
    cols = E.header_order(F.col("text"), phrases)
    return D.table(s, d, "documents").select("doc_id", F.array_join(cols, ",").alias("columns")).filter("columns <> ''")


@query("slugify", r"""SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower('Permittee ' || p_name || CASE WHEN p_size % 2 = 0 THEN ' Non-Resident ' ELSE ' nonresident ' END || p_brand), '^permittee\s+', ''), '\bnon-?\s*resident\b', 'non_resident', 'g'), '[^a-z_]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part""")
def slugify(s, d):
    label = F.concat(F.lit("Permittee "), "p_name", F.when(F.col("p_size") % 2 == 0, " Non-Resident ").otherwise(" nonresident "), "p_brand")
    return D.table(s, d, "part").select("p_partkey", X.slug(label).alias("slug"))


@query("line_records", f"""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'Any Deer' ELSE 'Non-Resident Archery' END AS label, CAST(2010 + c_custkey % 3 + i AS INT) AS season_year, CASE WHEN i = 0 THEN c_custkey + 1200 ELSE c_custkey * 3 END AS issued, CASE WHEN i = 0 THEN c_custkey + 7 ELSE c_custkey * 2 END AS filled
  FROM customer, (SELECT unnest([0, 1]) AS i) WHERE c_custkey % 11 <> 3""")
def line_records(s, d):
    """A two-line report per customer is printed to text and parsed back; every eleventh has a broken line."""
    c, year = F.col("c_custkey"), 2010 + F.col("c_custkey") % 3
    num = lambda v: F.format_number(v, 0)
    years = F.format_string("%d %d", year, year + 1)
    head = F.concat(F.lit("  "), years, F.lit(" Change "), years, F.lit(" Change"))
    label = F.when(c % 5 == 0, "Any Deer").otherwise("Non-Resident  Archery")
    line = F.concat_ws(" ", label, num(c + 1200), num(c * 3), F.lit("+5%"), num(c + 7), num(c * 2), F.when(c % 11 == 3, "n.a.").otherwise("<1%"))
    reports = D.table(s, d, "customer").select("c_custkey", F.concat_ws("\n", F.lit("Permit Type"), head, F.lit("some prose"), line).alias("report"))
    return E.line_records(reports, "report")


@query("bucket_unknowns", """SELECT CAST(period AS VARCHAR) AS period, count(CASE WHEN entity NOT IN (0, 1) THEN 1 END) AS kept, count(CASE WHEN entity IN (0, 1) THEN 1 END) AS excluded, CAST(sum(CASE WHEN entity IN (0, 1) THEN positive ELSE 0 END) AS BIGINT) AS excluded_positives FROM samples GROUP BY samples.period""", "samples")
def bucket_unknowns(s, d):
    samples = D.samples(s, d)
    e = F.col("entity")
    printed = F.when(e == 0, " Unknown ").when(e == 1, "Out of state").when(e == 2, "Nashun 2").otherwise(F.concat(F.lit("NATION_"), e.cast("string")))
    name, nowhere = E.bucket_key(printed, ("", "unknown", "out of state"), {"nashun 2": "NATION_2"})
    dim = D.table(s, d, "nation").select(F.col("n_name").alias("place"), F.lit(1).alias("known"))
    keyed = samples.withColumn("nowhere", nowhere).withColumn("place", name).join(dim, "place", "left")
    return keyed.groupBy(F.col("period").cast("string").alias("period")).agg(
        F.count("known").alias("kept"), F.count_if("nowhere").alias("excluded"),
        F.sum(F.when(F.col("nowhere"), F.col("positive")).otherwise(0)).alias("excluded_positives"),
    )


@query("filter_links", """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'turkey' ELSE 'deer' END AS species, year(o_orderdate) AS y, o_orderpriority FROM orders),
  c AS (SELECT *, CASE WHEN species = 'turkey' THEN 1997 ELSE 1996 END AS lo, CASE WHEN species = 'turkey' THEN 2000 ELSE 2001 END AS hi FROM o), t AS (SELECT *, greatest(least(y + 2, hi), lo) AS yt FROM c)
  SELECT o_orderkey, species, CAST(greatest(least(y - 1, yt), lo) AS INT) AS year_from, CAST(yt AS INT) AS year_to, CAST(CASE WHEN y BETWEEN greatest(least(y - 1, yt), lo) AND yt THEN y ELSE yt END AS INT) AS year,
    CASE WHEN o_orderkey % 3 = 0 THEN 'fall' ELSE '' END AS season, CASE WHEN o_orderkey % 2 = 0 THEN 'archery,late_youth' ELSE 'archery' END AS portions, 'A region' AS region, '00001,00002' AS entities FROM t""")
def filter_links(s, d):
    """Share links written from order fields, some of them with bad values, parsed back to slices."""
    k, y = F.col("o_orderkey"), F.year("o_orderdate")
    link = F.concat(
        F.lit("https://stars.example/?sp="), F.when(F.col("o_orderstatus") == "F", "turkey").otherwise("bear"),
        F.format_string("&y=%d-%d&yr=%d", y - 1, y + 2, y), F.when(k % 3 == 0, "&s=fall").otherwise("&s=monsoon"),
        F.when(k % 2 == 0, "&p=archery,late_youth").otherwise("&p=archery,DROP%20TABLE"), F.lit("&r=A%20region&co=00001,xyz,00002&m=catapult"),
    )
    links = D.table(s, d, "orders").select("o_orderkey", link.alias("url"))
    out = E.filter_links(links, "url", {"deer": (1996, 2001), "turkey": (1997, 2000)}, "deer", ("spring", "fall"), ("archery", "firearm", "mixed"))
    return out.select(
        "o_orderkey", "species", "year_from", "year_to", "year", "season", F.array_join("portions", ",").alias("portions"), "region",
        F.array_join("entities", ",").alias("entities"),
    )


@query("view_links", """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, CASE WHEN o_orderstatus = 'F' THEN 'turkey' ELSE 'deer' END AS species FROM orders)
  SELECT k AS o_orderkey, species, CASE k % 3 WHEN 0 THEN 'board' WHEN 1 THEN 'map' ELSE 'map' END AS view,
    CASE WHEN k % 2 = 0 THEN 'count' WHEN species = 'deer' THEN 'buck_doe' ELSE 'count' END AS metric, CASE WHEN species = 'turkey' AND c % 2 = 0 THEN 'public_land_share' ELSE '' END AS metric2,
    CASE WHEN c % 5 = 0 THEN '' ELSE lpad(CAST(c % 1000 AS VARCHAR), 5, '0') END AS selected, lpad(CAST(c % 1000 AS VARCHAR), 5, '0') AS compare_a, CASE WHEN k % 5 = 0 THEN '' ELSE 'region:MIDDLE EAST' END AS compare_b,
    CASE WHEN c % 3 = 0 THEN 'roads,sites' ELSE 'sites' END AS layers FROM o""")
def view_links(s, d):
    """What shared links show, written from order fields and read back; some name unknown views, metrics that don't apply, bad places and layers."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    code = F.lpad((c % 1000).cast("string"), 5, "0")
    link = F.concat(
        F.lit("https://stars.example/?view="), F.when(k % 3 == 0, "board").when(k % 3 == 1, "map").otherwise("globe"),
        F.when(F.col("o_orderstatus") == "F", "&sp=turkey").otherwise("&sp=bear"), F.when(k % 2 == 0, "&metric=nothing").otherwise("&metric=buck_doe"),
        F.when(c % 2 == 0, "&m2=public_land_share").otherwise("&m2="), F.when(c % 5 == 0, "&sel=1234").otherwise(F.concat(F.lit("&sel="), code)),
        F.lit("&cmp=,"), code, F.when(k % 5 == 0, ",place").otherwise(",region%3AMIDDLE%20EAST"), F.when(c % 3 == 0, "&ov=s,zz,r,s").otherwise("&ov=s"),
    )
    links = D.table(s, d, "orders").select("o_orderkey", link.alias("url"))
    out = E.view_links(links, "url", ("deer", "turkey"), "deer", ("map", "board", "trends"),
                       {"count": ("deer", "turkey"), "buck_doe": ("deer",), "public_land_share": ("turkey",)}, {"roads": "r", "sites": "s"})
    return out.withColumn("layers", F.array_join("layers", ",")).drop("url")


@query("feature_pages", """SELECT county, samples, positives, since FROM (SELECT CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END AS county, c_custkey AS samples, CAST(c_acctbal > 0 AS INT) AS positives, CAST(c_acctbal AS DOUBLE) AS since FROM customer)
  WHERE samples >= 300 AND county IS NOT NULL AND positives = 1""")
def feature_pages(s, d):
    """Customers are landed as pages of a feature service and scanned with filters."""
    import uuid

    from starslice.runtime import shared_dir
    from starslice.sources import feature_pages as P

    path = f"{shared_dir(s)}/starslice/pages-{uuid.uuid4().hex}"
    k = F.col("c_custkey")
    rows = D.table(s, d, "customer").select(
        (k - 1).alias("OBJECTID"), F.when(k % 7 != 0, F.col("c_name")).alias("county"), k.alias("samples"),
        (F.col("c_acctbal") > 0).cast("int").alias("positives"), F.col("c_acctbal").cast("double").alias("since"))
    P.write_pages(rows, path, "OBJECTID", 100)
    landed = P.feature_pages(s, path, "county string, samples bigint, positives int, since double")
    return landed.filter("samples >= 300 AND county IS NOT NULL AND positives = 1")
