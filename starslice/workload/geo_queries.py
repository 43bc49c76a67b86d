"""Geometry jobs on vertex tables that are derived from customer keys, and the streaming rollup."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from starslice.operators import cover as C
from starslice.operators import geo as G
from starslice.runtime import shared_dir
from starslice.sources import driver_tables as D
from starslice.streaming import live as LV
from starslice.streaming import rollup as SR
from starslice.workload.registry import query

def key():
    return F.col("c_custkey")


def scatter(factor: int, modulus: int, scale: float):
    """A deterministic coordinate from the customer key."""
    return F.pmod(key() * factor, F.lit(modulus)) / scale


def vertices(s, d):
    """A square ring per customer; every tenth has a hole, every third runs clockwise, a few have no area."""
    half = F.when(key() % 37 == 5, 0.0).otherwise(F.lit(0.1) + (key() % 17) / 10.0)
    rings = F.filter(
        F.array(
            F.struct(F.lit(0).alias("ring"), scatter(7919, 10007, 100.0).alias("cx"), half.alias("h")),
            F.struct(F.when(key() % 10 == 0, 1).alias("ring"), (scatter(7919, 10007, 100.0) + half / 4).alias("cx"), (half / 2).alias("h")),
        ),
        lambda r: r["ring"].isNotNull(),
    )
    base = D.table(s, d, "customer").select(key().alias("geom"), scatter(104729, 10009, 200.0).alias("cy"), F.inline(rings))
    j = F.when(F.col("geom") % 3 == 0, 4 - F.col("seq")).otherwise(F.col("seq"))
    return base.withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(4)))).select(
        "geom", F.lit(0).alias("part"), "ring", "seq",
        (F.col("cx") + F.when(j.isin(1, 2), F.col("h")).otherwise(-F.col("h"))).alias("x"),
        (F.col("cy") + F.when(j.isin(2, 3), F.col("h")).otherwise(-F.col("h"))).alias("y"),
    )


VERTS = """ctr AS (SELECT c_custkey AS geom, ((c_custkey * 7919) % 10007) / 100.0 AS cx, ((c_custkey * 104729) % 10009) / 200.0 AS cy, CASE WHEN c_custkey % 37 = 5 THEN 0.0 ELSE CAST(0.1 AS DOUBLE) + (c_custkey % 17) / 10.0 END AS h FROM customer),
rg AS (SELECT geom, 0 AS ring, CAST(cx AS DOUBLE) AS cx, CAST(cy AS DOUBLE) AS cy, CAST(h AS DOUBLE) AS h FROM ctr UNION ALL SELECT geom, 1, CAST(cx AS DOUBLE) + CAST(h AS DOUBLE) / 4, CAST(cy AS DOUBLE), CAST(h AS DOUBLE) / 2 FROM ctr WHERE geom % 10 = 0),
sq AS (SELECT geom, ring, seq, cx, cy, h, CASE WHEN geom % 3 = 0 THEN 4 - seq ELSE seq END AS j FROM rg, (SELECT unnest(range(0, 5)) AS seq)),
v AS (SELECT geom, 0 AS part, ring, CAST(seq AS INT) AS seq, cx + CASE WHEN j IN (1, 2) THEN h ELSE -h END AS x, cy + CASE WHEN j IN (2, 3) THEN h ELSE -h END AS y FROM sq),
e AS (SELECT geom, part, ring, seq, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM v WINDOW w AS (PARTITION BY geom, ring ORDER BY seq)),
area AS (SELECT geom, part, ring, sum(x1 * y2 - x2 * y1) / 2 AS area FROM e WHERE x2 IS NOT NULL GROUP BY ALL)"""


@query("ring_area", f"WITH {VERTS} SELECT geom, part, ring, round(area, 5) AS area FROM area")
def ring_area(s, d):
    return G.ring_area(vertices(s, d)).withColumn("area", F.round("area", 5))


@query("polygon_centroid", f"""WITH {VERTS}, m AS (SELECT geom, ring, sum(x1 * y2 - x2 * y1) / 2 AS a, sum((x1 + x2) * (x1 * y2 - x2 * y1)) AS mx, sum((y1 + y2) * (x1 * y2 - x2 * y1)) AS my FROM e WHERE x2 IS NOT NULL GROUP BY ALL),
  t AS (SELECT geom, sum(sg * a) AS a, sum(sg * mx) AS mx, sum(sg * my) AS my FROM (SELECT *, sign(a) * CASE WHEN ring = 0 THEN 1 ELSE -1 END AS sg FROM m) GROUP BY geom)
  SELECT geom, round(a, 4) AS area, round(mx / (6 * a), 4) AS x, round(my / (6 * a), 4) AS y FROM t WHERE a > 0.000001""")
def polygon_centroid(s, d):
    out = G.polygon_centroid(vertices(s, d)).filter("area > 0.000001")
    return out.select("geom", *[F.round(c, 4).alias(c) for c in ("area", "x", "y")])


@query("ring_acres", f"""WITH {VERTS}, l AS (SELECT geom, part, ring, avg(y) AS lat FROM v GROUP BY ALL)
  SELECT geom, part, ring, round(abs(area) * 111.32 * 111.32 * cos(radians(lat)) * 247.105381, 2) AS acres FROM area JOIN l USING (geom, part, ring) WHERE abs(area) * 111.32 * 111.32 * cos(radians(lat)) * 247.105381 >= 100000""")
def ring_acres(s, d):
    return G.ring_acres(vertices(s, d), 100000).withColumn("acres", F.round("acres", 2))


@query("ring_quality", f"WITH {VERTS} SELECT geom, part, ring, CAST(5 AS BIGINT) AS points FROM rg JOIN (SELECT 0 AS part) ON true WHERE h = 0")
def ring_quality(s, d):
    return G.ring_quality(vertices(s, d), 3).select("geom", "part", "ring", "points")


@query("bbox_filter", f"""WITH {VERTS}, b AS (SELECT geom, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM v GROUP BY geom)
  SELECT geom, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1, x0 >= 20.005 AND x1 <= 60.005 AND y0 >= 10.0025 AND y1 <= 30.0025 AS inside FROM b WHERE x0 <= 60.005 AND x1 >= 20.005 AND y0 <= 30.0025 AND y1 >= 10.0025""")
def bbox_filter(s, d):
    out = G.bbox_filter(vertices(s, d), (20.005, 10.0025, 60.005, 30.0025))
    return out.select("geom", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")], "inside")


CLIP = """t AS (SELECT *, x2 - x1 AS dx, y2 - y1 AS dy FROM e WHERE x2 IS NOT NULL),
  p AS (SELECT *, CASE WHEN dx <> 0 THEN least((20.005 - x1) / dx, (60.005 - x1) / dx) WHEN x1 BETWEEN 20.005 AND 60.005 THEN 0 ELSE 2 END AS ax, CASE WHEN dx <> 0 THEN greatest((20.005 - x1) / dx, (60.005 - x1) / dx) WHEN x1 BETWEEN 20.005 AND 60.005 THEN 1 ELSE -1 END AS bx,
    CASE WHEN dy <> 0 THEN least((10.0025 - y1) / dy, (30.0025 - y1) / dy) WHEN y1 BETWEEN 10.0025 AND 30.0025 THEN 0 ELSE 2 END AS ay, CASE WHEN dy <> 0 THEN greatest((10.0025 - y1) / dy, (30.0025 - y1) / dy) WHEN y1 BETWEEN 10.0025 AND 30.0025 THEN 1 ELSE -1 END AS by FROM t),
  c AS (SELECT *, greatest(0, ax, ay) AS t0, least(1, bx, "by") AS t1 FROM p), k AS (SELECT * FROM c WHERE t0 < t1),
  n AS (SELECT *, CASE WHEN t0 = 0 AND lag(t1) OVER w = 1 AND lag(seq) OVER w = seq - 1 THEN 0 ELSE 1 END AS brk FROM k WINDOW w AS (PARTITION BY geom, ring ORDER BY seq))"""


@query("segment_clip", f"""WITH {VERTS}, {CLIP.replace('AS by FROM t', 'AS "by" FROM t')}
  SELECT geom, part, ring, seq, round(x1 + t0 * dx, 5) AS cx1, round(y1 + t0 * dy, 5) AS cy1, round(x1 + t1 * dx, 5) AS cx2, round(y1 + t1 * dy, 5) AS cy2, CAST(sum(brk) OVER (PARTITION BY geom, ring ORDER BY seq) - 1 AS INT) AS run FROM n""")
def segment_clip(s, d):
    v = vertices(s, d)
    out = G.segment_clip(v, (20.005, 10.0025, 60.005, 30.0025))
    return out.select("geom", "part", "ring", "seq", *[F.round(c, 5).alias(c) for c in ("cx1", "cy1", "cx2", "cy2")], "run")


def trails(s, d):
    """A seven-vertex line per customer with small steps and bends."""
    i = F.col("seq")
    return D.table(s, d, "customer").select(key().alias("geom")).withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(6)))).select(
        "geom", F.lit(0).alias("part"), F.lit(0).alias("ring"), "seq",
        (F.col("geom") % 11 + i * 0.031).alias("x"), (((F.col("geom") * 31 + i * 17) % 100) / 250.0).alias("y"),
    )


TRAILS = """v AS (SELECT c_custkey AS geom, 0 AS part, 0 AS ring, CAST(seq AS INT) AS seq, CAST(c_custkey % 11 AS DOUBLE) + CAST(seq AS DOUBLE) * CAST(0.031 AS DOUBLE) AS x, CAST((c_custkey * 31 + seq * 17) % 100 AS DOUBLE) / CAST(250.0 AS DOUBLE) AS y
  FROM customer, (SELECT unnest(range(0, 7)) AS seq))"""


@query("dedupe_vertices", f"""WITH {TRAILS}, r AS (SELECT geom, part, ring, seq, round(x, 1) AS x, round(y, 0) AS y FROM (SELECT * REPLACE (y * 0 AS y) FROM v)),
  l AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM r WINDOW w AS (PARTITION BY geom ORDER BY seq)) SELECT geom, part, ring, seq, x, y FROM l WHERE px IS NULL OR px <> x OR py <> y""")
def dedupe_vertices(s, d):
    flat = trails(s, d).withColumn("y", F.col("y") * 0)
    return G.dedupe_vertices(flat, 1)


@query("thin_vertices", f"""WITH {TRAILS}, n AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM v WINDOW w AS (PARTITION BY geom ORDER BY seq)),
  t AS (SELECT *, CASE WHEN (nx - px) * (nx - px) + (ny - py) * (ny - py) > 0 THEN greatest(0, least(1, ((x - px) * (nx - px) + (y - py) * (ny - py)) / ((nx - px) * (nx - px) + (ny - py) * (ny - py)))) ELSE 0 END AS t FROM n)
  SELECT geom, part, ring, seq, round(x, 6) AS x, round(y, 6) AS y FROM t WHERE px IS NULL OR nx IS NULL OR sqrt(pow(x - (px + t * (nx - px)), 2) + pow(y - (py + t * (ny - py)), 2)) >= 0.0517""")
def thin_vertices(s, d):
    out = G.thin_vertices(trails(s, d), 0.0517)
    return out.withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


@query("collect_parts", """SELECT p_brand AS layer, p_type AS name, count(*) AS n_parts, CAST(0 AS INT) AS chunk, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS parts, CASE WHEN count(*) > 1 THEN 'multi' ELSE 'single' END AS kind FROM part GROUP BY ALL""")
def collect_parts(s, d):
    features = D.table(s, d, "part").select(F.col("p_brand").alias("layer"), F.col("p_type").alias("name"), "p_partkey")
    out = G.collect_parts(features, ["layer", "name"], "p_partkey")
    return out.withColumn("parts", F.array_join(F.col("parts").cast("array<string>"), ","))


@query("line_groups", """WITH RECURSIVE p AS (SELECT c_custkey AS piece, c_custkey AS a, c_custkey + 1 AS b FROM customer WHERE c_custkey % 50 <> 49 UNION ALL SELECT -c_custkey, -c_custkey - 10, CAST(-5 AS BIGINT) FROM customer WHERE c_custkey % 3 = 0),
  e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r(node, root) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b), m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
  SELECT piece, least(root, a) AS "group" FROM p JOIN m ON m.node = p.a""")
def line_groups(s, d):
    # chains of fifty pieces, and one hub that a third of the customers touch
    c = D.table(s, d, "customer")
    chain = c.filter(key() % 50 != 49).select(key().alias("piece"), key().alias("a"), (key() + 1).alias("b"))
    hub = c.filter(key() % 3 == 0).select((-key()).alias("piece"), (-key() - 10).alias("a"), F.lit(-5).cast("long").alias("b"))
    return G.line_groups(chain.unionByName(hub))


def lonlat(s, d):
    return D.table(s, d, "customer").select(
        key().alias("geom"), (F.lit(-96.0) + scatter(7919, 10007, 1500.0)).alias("lon"), (F.lit(36.0) + scatter(104729, 10009, 2200.0)).alias("lat")
    )


LONLAT = "ll AS (SELECT c_custkey AS geom, CAST(-96.0 AS DOUBLE) + CAST((c_custkey * 7919) % 10007 AS DOUBLE) / CAST(1500.0 AS DOUBLE) AS lon, CAST(36.0 AS DOUBLE) + CAST((c_custkey * 104729) % 10009 AS DOUBLE) / CAST(2200.0 AS DOUBLE) AS lat FROM customer)"


@query("albers_project", f"""WITH {LONLAT}, k AS (SELECT (sin(radians(36.5)) + sin(radians(40.5))) / 2 AS n), k2 AS (SELECT n, pow(cos(radians(36.5)), 2) + 2 * n * sin(radians(36.5)) AS c FROM k),
  q AS (SELECT geom, sqrt(c - 2 * n * sin(radians(lat))) / n AS rho, n * (radians(lon) - radians(-92.5)) AS th, sqrt(c - 2 * n * sin(radians(38.5))) / n AS rho0 FROM ll, k2), p AS (SELECT geom, rho * sin(th) AS x, rho0 - rho * cos(th) AS y FROM q),
  b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p), s AS (SELECT *, 1000 / (x1 - x0) AS sc FROM b)
  SELECT geom, round(x, 7) AS x, round(y, 7) AS y, round((x - x0) * sc, 1) AS px, round(round((y1 - y0) * sc) - (y - y0) * sc, 1) AS py FROM p, s""")
def albers_project(s, d):
    x, y = G.albers_forward(F.col("lon"), F.col("lat"), 36.5, 40.5, 38.5, -92.5)
    out = G.fit_to_width(lonlat(s, d).select("geom", x.alias("x"), y.alias("y")), 1000.0)
    return out.withColumns({"x": F.round("x", 7), "y": F.round("y", 7)})


@query("albers_inverse", f"""WITH RECURSIVE {LONLAT}, g AS (SELECT geom, round((lon + 96.0) * 90000.0) AS x, round((lat - 23.0) * 110000.0) AS y FROM ll),
  e AS (SELECT 6378137.0::DOUBLE AS a, (2 / 298.257222101::DOUBLE - 1 / pow(298.257222101::DOUBLE, 2)) AS e2), c AS (SELECT a, e2, sqrt(e2) AS e FROM e),
  s AS (SELECT i, sin(radians(p)) AS s FROM (VALUES (1, 29.5::DOUBLE), (2, 45.5), (0, 23.0)) v(i, p)),
  q AS (SELECT i, (1 - s * s) / (1 - e2 * s * s) AS m2, (1 - e2) * (s / (1 - e2 * s * s) + atanh(e * s) / e) AS q FROM s, c),
  k AS (SELECT (a.m2 - b.m2) / (b.q - a.q) AS n, a.m2 + (a.m2 - b.m2) / (b.q - a.q) * a.q AS cc, o.q AS q0 FROM q a, q b, q o WHERE a.i = 1 AND b.i = 2 AND o.i = 0),
  t AS (SELECT geom, x, y, n, (cc - (x * x / (a * a) + pow(sqrt(cc - n * q0) / n - y / a, 2)) * n * n) / n AS q, degrees(atan2(x / a, sqrt(cc - n * q0) / n - y / a) / n) - 96 AS lon, e, e2 FROM g, k, c),
  b AS (SELECT geom, x, y, q, lon, e, e2, 0::DOUBLE AS lo, 1.5::DOUBLE AS hi, 0 AS step FROM t
    UNION ALL SELECT geom, x, y, q, lon, e, e2, CASE WHEN v < q THEN m ELSE lo END, CASE WHEN v < q THEN hi ELSE m END, step + 1
      FROM (SELECT *, (1 - e2) * (sin(m) / (1 - e2 * sin(m) * sin(m)) + atanh(e * sin(m)) / e) AS v FROM (SELECT *, (lo + hi) / 2 AS m FROM b WHERE step < 45)))
  SELECT geom, x, y, round(lon, 6) AS lon, round(degrees((lo + hi) / 2), 4) AS lat FROM b WHERE step = 45""")
def albers_inverse(s, d):
    # planar points on a grid of metres; the twin solves for the latitude by bisection on the exact area formula
    lon, lat = G.ConicFrame(29.5, 45.5, (-96.0, 23.0)).locate(F.col("x"), F.col("y"))
    grid = lonlat(s, d).select("geom", (F.round((F.col("lon") + 96.0) * 90000.0)).alias("x"), F.round((F.col("lat") - 23.0) * 110000.0).alias("y"))
    return grid.select("geom", "x", "y", F.round(lon, 6).alias("lon"), F.round(lat, 4).alias("lat"))


@query("point_in_polygon", """WITH p AS (SELECT c_custkey, CAST(((c_custkey * 7919) % 5003) / 1000.7 AS DOUBLE) AS x, CAST(((c_custkey * 104729) % 5003) / 1000.9 AS DOUBLE) AS y FROM customer),
  m AS (SELECT c_custkey, n_nationkey FROM p JOIN nation ON x >= n_nationkey % 5 AND x < n_nationkey % 5 + 1 AND y >= n_nationkey // 5 AND y < n_nationkey // 5 + 1
    WHERE NOT (n_nationkey = 12 AND x >= 2.25 AND x < 2.75 AND y >= 2.25 AND y < 2.75))
  SELECT 'match' AS outcome, CAST(n_nationkey AS BIGINT) AS key, count(*) AS n FROM m GROUP BY n_nationkey UNION ALL SELECT 'unmatched', c_custkey, 0 FROM p WHERE c_custkey NOT IN (SELECT c_custkey FROM m)""")
def point_in_polygon(s, d):
    # one square per nation, the twelfth with a hole; points without exactly one polygon are reported
    n = F.col("n_nationkey")
    rings = F.filter(
        F.array(
            F.struct(F.lit(0).alias("ring"), F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")),
            F.struct(F.when(n == 12, 1).alias("ring"), F.lit(0.25).alias("lo"), F.lit(0.75).alias("hi")),
        ),
        lambda r: r["ring"].isNotNull(),
    )
    j = F.col("seq")
    squares = (
        D.table(s, d, "nation").select(n.alias("geom"), F.inline(rings)).withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(4))))
        .select("geom", F.lit(0).alias("part"), "ring", "seq",
                (F.col("geom") % 5 + F.when(j.isin(1, 2), F.col("hi")).otherwise(F.col("lo"))).alias("x"),
                (F.floor(F.col("geom") / 5) + F.when(j.isin(2, 3), F.col("hi")).otherwise(F.col("lo"))).alias("y"))
    )
    points = D.table(s, d, "customer").select(
        "c_custkey", scatter(7919, 5003, 1000.7).alias("x"), scatter(104729, 5003, 1000.9).alias("y")
    )
    matches = G.point_in_polygon(points, squares)
    per = matches.groupBy(F.col("geom").cast("long").alias("key")).agg(F.count("*").alias("n")).withColumn("outcome", F.lit("match"))
    bad = G.exactly_one(points, matches, "c_custkey").select(key().alias("key"), "n", F.lit("unmatched").alias("outcome"))
    return per.unionByName(bad)


@query("cover_points", """WITH c AS (SELECT s_suppkey AS geom, ((s_suppkey * 7919) % 10007) / 100.0::DOUBLE AS cx, ((s_suppkey * 104729) % 10009) / 200.0::DOUBLE AS cy FROM supplier),
  v AS (SELECT geom, cx, cy, seq, 1.0::DOUBLE + ((geom * 31 + (seq % 60) * (seq % 60) * 7) % 13) / 10.0::DOUBLE AS r, 2 * pi() * (seq % 60) / 60 AS t FROM c, (SELECT unnest(range(0, 61)) AS seq)),
  e AS (SELECT geom, cx + r * cos(t) AS x1, cy + r * sin(t) AS y1, cx + lead(r) OVER w * cos(lead(t) OVER w) AS x2, cy + lead(r) OVER w * sin(lead(t) OVER w) AS y2 FROM v WINDOW w AS (PARTITION BY geom ORDER BY seq)),
  p AS (SELECT o_orderkey, ((o_orderkey * 7919) % 100003) / 1000.07::DOUBLE AS x, ((o_orderkey * 104729) % 100019) / 2000.09::DOUBLE AS y FROM orders),
  near AS (SELECT o_orderkey, x, y, geom FROM p JOIN c ON abs(x - cx) < 2.5 AND abs(y - cy) < 2.5)
  SELECT o_orderkey, geom FROM near JOIN e USING (geom) WHERE (y1 > y) <> (y2 > y) AND x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) GROUP BY o_orderkey, geom HAVING count(*) % 2 = 1""")
def cover_points(s, d):
    """A jagged ring of sixty edges for each supplier, overlapping others; each order is a point."""
    k, step = F.col("s_suppkey"), F.col("seq") % 60
    r, t = F.lit(1.0) + ((k * 31 + step * step * 7) % 13) / 10.0, step * (2 * math.pi / 60)
    rings = D.table(s, d, "supplier").select(k, F.explode(F.sequence(F.lit(0), F.lit(60))).alias("seq")).select(
        k.alias("geom"), F.lit(0).alias("part"), F.lit(0).alias("ring"), "seq",
        (F.pmod(k * 7919, F.lit(10007)) / 100.0 + r * F.cos(t)).alias("x"), (F.pmod(k * 104729, F.lit(10009)) / 200.0 + r * F.sin(t)).alias("y"))
    o = F.col("o_orderkey")
    points = D.table(s, d, "orders").select(o, (F.pmod(o * 7919, F.lit(100003)) / 1000.07).alias("x"), (F.pmod(o * 104729, F.lit(100019)) / 2000.09).alias("y"))
    return C.point_in_polygon(points, rings).select("o_orderkey", "geom")


@query("live_season", """SELECT entity, CAST(period AS VARCHAR) AS period, count(*) AS samples, CAST(sum(positive) AS BIGINT) AS positives, period < DATE '2024-01-08' AS closed FROM samples GROUP BY samples.entity, samples.period""", "samples")
def live_season(s, d):
    """The live part lands in three drops, each with rows of all days (late ones) and repeats of the drop before; the last batch is replayed."""
    root = f"{shared_dir(s)}/starslice/live-{uuid.uuid4().hex}"
    edge = F.lit("2024-01-08").cast("date")
    raw = D.samples(s, d)
    live = LV.LiveSamples(s, f"{root}/table")
    rows = raw.select("entity", "period", "sample_id", "positive").filter(F.col("period") >= edge)
    third = F.pmod(F.xxhash64("sample_id"), F.lit(3))
    for k in range(3):
        again = (third == k - 1) & (F.col("sample_id") % 5 == 0)
        rows.filter((third == k) | again).repartition(2).write.mode("append").parquet(f"{root}/inbox/drop={k}")
    inbox = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).option("recursiveFileLookup", True).parquet(f"{root}/inbox")
    LV.run_available(inbox, live, f"{root}/state")
    live.add(rows.filter(third == 2), live.manifest()["batch"])
    now = live.table().withColumn("closed", F.lit(False))
    before = raw.filter(F.col("period") < edge).groupBy("entity", "period").agg(F.count("*").alias("samples"), F.sum("positive").alias("positives"))
    merged = SR.merge_closed(before.withColumn("closed", F.lit(True)), now, ["entity", "period"])
    return merged.select("entity", F.col("period").cast("string").alias("period"), "samples", "positives", "closed")


@query("stream_rollup", "SELECT entity, CAST(period AS VARCHAR) AS period, count(*) AS samples, CAST(sum(positive) AS BIGINT) AS positives FROM samples GROUP BY samples.entity, samples.period", "samples")
def stream_rollup(s, d):
    table = SR.rollup_folder(s, d, "events*.parquet")
    return table.select("entity", SR.utc_day(F.col("period_start")).cast("string").alias("period"), "samples", "positives")
