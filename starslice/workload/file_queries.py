"""Landed files, names and vocabularies: files are written from the given tables in the form of their sources, and scanned back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from starslice.functions import text as X
from starslice.functions import vocab as V
from starslice.operators import geo as G
from starslice.operators import quality as Q
from starslice.plans import metrics as M
from starslice.plans import reports as R
from starslice.plans.spec import SliceSpec
from starslice.runtime import literal_rows, shared_dir
from starslice.sources import driver_tables as D
from starslice.sources import scans, sinks
from starslice.workload.geo_queries import VERTS, vertices
from starslice.workload.registry import query

O = SliceSpec(species="O")  # noqa: E741


def _folder(s, name: str) -> str:
    return f"{shared_dir(s)}/starslice/{name}-{uuid.uuid4().hex}"


@query("gazetteer", """SELECT concat(20 + c_nationkey, lpad(CAST(c_custkey AS VARCHAR), 7, '0')) AS GEOID, c_name AS NAME, CAST(c_acctbal AS DOUBLE) AS ALAND_SQMI FROM customer WHERE c_nationkey = 9""")
def gazetteer(s, d):
    """Tab-separated, with blanks behind a header name and around values; one state's rows are kept."""
    path = _folder(s, "gazetteer")
    key = F.concat((F.col("c_nationkey") + 20).cast("string"), F.lpad(F.col("c_custkey").cast("string"), 7, "0"))
    printed = D.table(s, d, "customer").select(F.lit("XX").alias("USPS"), key.alias("GEOID"), F.concat("c_name", F.lit(" ")).alias("NAME"), F.concat(F.lit(" "), F.col("c_acctbal").cast("string")).alias("ALAND_SQMI   "))
    printed.write.option("sep", "\t").option("header", True).option("ignoreTrailingWhiteSpace", False).option("ignoreLeadingWhiteSpace", False).csv(path)
    return scans.gazetteer(s, path, "29").select("GEOID", "NAME", F.col("ALAND_SQMI").cast("double").alias("ALAND_SQMI"))


@query("county_codes", "SELECT concat(lpad(CAST(c_nationkey AS VARCHAR), 2, '0'), lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0')) AS fips, c_name AS name, count(*) AS n FROM customer GROUP BY ALL")
def county_codes(s, d):
    path = _folder(s, "codes")
    customer = D.table(s, d, "customer")
    digits = lambda c, n: F.lpad(c.cast("string"), n, "0")
    customer.select(
        F.lit("XX").alias("STATE"), digits(F.col("c_nationkey"), 2).alias("STATEFP"), digits(F.col("c_custkey") % 1000, 3).alias("COUNTYFP"), F.col("c_name").alias("COUNTYNAME"),
    ).write.option("sep", "|").option("header", True).csv(path)
    return scans.county_codes(s, path).groupBy("fips", F.col("COUNTYNAME").alias("name")).agg(F.count("*").alias("n"))


FEATURES = 2000  # of a landed document, on average


def _shapes(s, d):
    """The squares as landed GeoJSON documents, some with a hole; every fifth is a road, others have acres.

    There are sixteen documents, or more as the shapes are many: a document is read as a whole.
    """
    path = _folder(s, "shapes")
    verts = vertices(s, d)
    k = F.col("geom")
    kinds = verts.select("geom").distinct().select(
        "geom", F.concat(F.lit("  Lake  Of The "), k.cast("string")).alias("FULLNAME"), F.when(k % 5 == 0, "I").otherwise("U").alias("RTTYP"),
        (k * 100).cast("string").alias("Acreage"), F.when(k % 2 == 0, "Y").otherwise("N").alias("PUBLIC_SITE"))
    features = sinks.geojson_features(verts, kinds)
    pieces = max(16, -(-kinds.count() // FEATURES))
    docs = features.groupBy(F.pmod(F.xxhash64("value"), F.lit(pieces)).alias("piece")).agg(F.array_join(F.collect_list("value"), ",").alias("f"))
    docs.select("piece", F.concat(F.lit('{"type":"FeatureCollection","features":['), "f", F.lit("]}")).alias("value")).write.partitionBy("piece").text(path)
    return scans.geojson(s, path)


@query("geojson_round_trip", f"WITH {VERTS} SELECT concat('Lake of the ', geom) AS name, 'Polygon' AS kind, ring, count(*) AS points, round(sum(x), 4) AS x, round(sum(y), 4) AS y FROM v GROUP BY geom, ring")
def geojson_round_trip(s, d):
    """Written as features, read with lower-cased keys, exploded to vertices; names are cleaned."""
    shapes = _shapes(s, d).withColumn("name", X.feature_name(X.strip(F.col("properties")["fullname"])))
    points = scans.vertices(shapes, "name").groupBy("geom", "ring").agg(F.count("*").alias("points"), F.round(F.sum("x"), 4).alias("x"), F.round(F.sum("y"), 4).alias("y"))
    return points.join(shapes.select(F.col("name").alias("geom"), "kind"), "geom").select(F.col("geom").alias("name"), "kind", "ring", "points", "x", "y")


@query("layer_filter", f"""WITH {VERTS}, g AS (SELECT DISTINCT geom FROM v) SELECT 'interstates' AS layer, count(*) AS n FROM g WHERE geom % 5 = 0 UNION ALL SELECT 'public_land', count(*) FROM g WHERE geom * 100 >= 1000 AND geom % 2 = 0""")
def layer_filter(s, d):
    shapes = _shapes(s, d)
    layers = [scans.layer(shapes, V.LAYER_FILTERS[name], "fullname").agg(F.lit(name).alias("layer"), F.count("*").alias("n")) for name in ("interstates", "public_land")]
    return layers[0].unionByName(layers[1])


@query("oriented_rings", f"WITH {VERTS} SELECT geom, part, ring, round(CASE WHEN ring = 0 THEN abs(area) ELSE -abs(area) END, 5) + 0.0 AS area FROM area")
def oriented_rings(s, d):
    return G.ring_area(G.orient(vertices(s, d))).select("geom", "part", "ring", (F.round("area", 5) + F.lit(0.0)).alias("area"))


@query("envelope_rows", "SELECT c_custkey AS k, c_name AS name, CASE WHEN c_acctbal > 0 THEN CAST(c_acctbal AS DOUBLE) END AS amount FROM customer")
def envelope_rows(s, d):
    """One JSON document with a header for each range of rows."""
    path = _folder(s, "envelope")
    rows = D.table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal").cast("double")).alias("amount"))
    sinks.write_envelope(rows, path, "rows", ["k"], size=400, state="XX", generated="2024-01-01")
    return scans.envelope(s, path, "rows", "k bigint, name string, amount double")


@query("vocabulary_equal", "SELECT portion, side FROM (VALUES ('fall_late', 'unexpected'), ('winter', 'missing')) v(portion, side)")
def vocabulary_equal(s, d):
    """The portions that occur against a list that lacks one and names one that never occurs."""
    expected = [f"{season}_{kind}" for season in ("fall", "spring") for kind in ("main", "archery", "youth", "managed", "late", "opening", "total")]
    wanted = [p for p in expected if p != "fall_late"] + ["winter"]
    return Q.same_vocabulary(D.star(s, d).fact, wanted, "portion")


@query("layers_present", "SELECT w.class, EXISTS (SELECT 1 FROM lineitem WHERE l_returnflag = w.class) AS present FROM (VALUES ('A'), ('R'), ('X')) w(class)")
def layers_present(s, d):
    return Q.overlap(D.table(s, d, "lineitem").select(F.col("l_returnflag").alias("class")), ["A", "R", "X"], "class")


@query("too_few_rows", "SELECT c_nationkey, c_mktsegment, count(*) AS found FROM customer GROUP BY ALL HAVING count(*) < 12")
def too_few_rows(s, d):
    return Q.too_few(D.table(s, d, "customer"), ["c_nationkey", "c_mktsegment"], 12)


@query("metric_applicable", """SELECT kind, wanted, CASE WHEN kind = 'deer' AND wanted IN ('buck_doe', 'count') THEN wanted WHEN kind = 'turkey' AND wanted IN ('crossbow_share', 'count') THEN wanted ELSE 'count' END AS metric, count(*) AS n
  FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN 'turkey' ELSE 'deer' END AS kind, CASE o_orderkey % 4 WHEN 0 THEN 'buck_doe' WHEN 1 THEN 'crossbow_share' WHEN 2 THEN 'count' ELSE 'nonsense' END AS wanted FROM orders) GROUP BY ALL""")
def metric_applicable(s, d):
    """A metric that doesn't apply to a species gives way to the count; requests are joined with the registry."""
    k = F.col("o_orderkey") % 4
    asked = D.table(s, d, "orders").select(
        F.when(F.col("o_orderstatus") == "F", "turkey").otherwise("deer").alias("kind"),
        F.when(k == 0, "buck_doe").when(k == 1, "crossbow_share").when(k == 2, "count").otherwise("nonsense").alias("wanted"))
    rules = literal_rows(s, [(kind, m, M.applicable(m, kind)) for kind in ("deer", "turkey") for m in M.METRICS], "kind string, wanted string, metric string")
    return asked.groupBy("kind", "wanted").agg(F.count("*").alias("n")).join(rules, ["kind", "wanted"], "left").select("kind", "wanted", F.coalesce("metric", F.lit("count")).alias("metric"), "n")


@query("labelled_classes", """SELECT class, CASE class WHEN 'N' THEN 'Kept' WHEN 'A' THEN 'Accepted' ELSE 'Returned' END AS label, CAST(CASE class WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS INT) AS sort_order, CAST(sum(cnt) AS BIGINT) AS cnt FROM fact WHERE NOT is_subtotal GROUP BY class""", "fact")
def labelled_classes(s, d):
    labels = V.label_dimension(s, {"N": "Kept", "A": "Accepted", "R": "Returned"}, "class")
    sums = O.apply(D.star(s, d).fact).groupBy("class").agg(F.sum("cnt").alias("cnt"))
    return sums.join(labels, "class").select("class", "label", "sort_order", "cnt").orderBy("sort_order")


@query("metric_trips", """SELECT s.entity, s.season_year, round(CASE WHEN fh > 0 THEN 10 / fh END, 6) AS value FROM series s LEFT JOIN effort e USING (entity, season_year)""", "series effort")
def metric_trips(s, d):
    """Trips per kill where the source publishes them."""
    import dataclasses

    from starslice.runtime import ratio

    star = D.star(s, d, side=("effort",))
    effort = star.effort.withColumn("trips", ratio(F.lit(10.0), "fh"))
    return M.metric_frame(dataclasses.replace(star, effort=effort), O, ["trips_per_kill"]).select("entity", "season_year", F.round("trips_per_kill", 6).alias("value"))


@query("permits_harvest", """SELECT CAST(y AS INT) AS year, t AS permit_type, issued AS permits_issued, filled AS deer_harvested, round(CASE WHEN issued > 0 THEN filled / CAST(issued AS DOUBLE) END, 6) AS fill_rate,
  round(1 - none / CAST(total AS DOUBLE), 6) AS success_rate FROM (SELECT year(o_orderdate) AS y, o_orderpriority AS t, count(*) AS issued, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS filled FROM orders GROUP BY ALL)
  JOIN (SELECT year(o_orderdate) AS y, count(*) AS total, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS none FROM orders GROUP BY ALL) USING (y)""")
def permits_harvest(s, d):
    """Fill rate of every kind of permit beside the success rate of the period's firearms hunters."""
    orders, status = D.table(s, d, "orders").withColumn("year", F.year("o_orderdate")), F.col("o_orderstatus")
    permits = orders.groupBy("year", F.col("o_orderpriority").alias("permit_type")).agg(F.count("*").alias("permits_issued"), F.count_if(status == "F").alias("deer_harvested"))
    hunters = orders.groupBy("year").agg(F.count("*").alias("hunters_total"), F.count_if(status == "O").alias("hunters_0_deer")).withColumn("method", F.lit("firearms"))
    made = R.permits_vs_harvest(permits, hunters)
    return made.select("year", "permit_type", "permits_issued", "deer_harvested", F.round("fill_rate", 6).alias("fill_rate"), F.round("success_rate", 6).alias("success_rate"))


@query("estimated_people", "SELECT entity, season_year, round((fh + ah) * area / 100) * 100 AS hunters FROM effort JOIN dim USING (entity)", "effort")
def estimated_people(s, d):
    effort = D.effort(s, d).join(D.dim(s, d).select("entity", "area"), "entity")
    return effort.select("entity", "season_year", M.estimated_people(F.col("fh") + F.col("ah")).alias("hunters"))
