"""Geometry jobs on a vertex table (geom, part, ring, seq, x, y); ring 0 is the outline, others are holes.

``seq`` counts 0, 1, 2, ... along a ring whose last vertex repeats the first. Neighbouring
vertices meet by grouping on (ring, seq), not by ordering a ring inside one task, so one huge
ring is spread like many small ones.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starslice.operators.ranking import prefix_sum
from starslice.runtime import ratio, settle

RING = ["geom", "part", "ring"]
KM_PER_DEGREE = 111.32
ACRES_PER_KM2 = 247.105381


BLOCK = 1024  # vertices of a ring that go to one task together; changes cost, not results


def _beside(vertices: DataFrame, offsets: dict[str, int]) -> DataFrame:
    """Each vertex with its neighbours: columns ``x_<name>``, ``y_<name>`` per offset in ``seq``.

    Vertices are dealt by ring and block first, those at a block's ends to the next block too; they are copied to their neighbours' positions and
    grouped only there. So no task holds more positions than its blocks have, however few files the vertices come from.
    """
    block = lambda seq: F.floor(seq / BLOCK)
    reached = F.array_distinct(F.array(*[block(F.col("seq") - o) for o in offsets.values()]))
    parts = int(vertices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = vertices.select(*RING, "seq", "x", "y", F.explode(reached).alias("_block")).withColumn("_deal", F.xxhash64(*RING, "_block"))
    copies = F.array(*[F.struct((F.col("seq") - o).alias("at"), F.lit(n).alias("role")) for n, o in offsets.items()])
    spread = dealt.repartition(parts, "_deal").select(*RING, "x", "y", "_block", "_deal", F.inline(copies)).filter(block(F.col("at")).eqNullSafe(F.col("_block")))
    pick = lambda n, c: F.max(F.when(F.col("role") == n, F.col(c))).alias(f"{c}_{n}")
    return spread.groupBy("_deal", *RING, F.col("at").alias("seq")).agg(*[pick(n, c) for n in offsets for c in ("x", "y")]).drop("_deal")


def edges(vertices: DataFrame) -> DataFrame:
    """(.., seq, x1, y1, x2, y2): one row per segment."""
    both = _beside(vertices, {"a": 0, "b": 1}).filter(F.col("x_a").isNotNull() & F.col("x_b").isNotNull())
    return both.withColumnsRenamed({"x_a": "x1", "y_a": "y1", "x_b": "x2", "y_b": "y2"})


def _cross() -> Column:
    return F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")


def ring_area(vertices: DataFrame) -> DataFrame:
    """Signed shoelace area per ring (counter-clockwise is positive)."""
    return edges(vertices).groupBy(*RING).agg((F.sum(_cross()) / 2).alias("area"))


def polygon_centroid(vertices: DataFrame) -> DataFrame:
    """Area-weighted centroid per geometry; holes subtract whatever their orientation."""
    mx = F.sum((F.col("x1") + F.col("x2")) * _cross()).alias("mx")
    my = F.sum((F.col("y1") + F.col("y2")) * _cross()).alias("my")
    per_ring = edges(vertices).groupBy(*RING).agg((F.sum(_cross()) / 2).alias("a"), mx, my)
    # a positive sign for outlines and a negative one for holes
    sign = F.signum("a") * F.when(F.col("ring") == 0, 1).otherwise(-1)
    total = per_ring.groupBy("geom").agg(
        F.sum(sign * F.col("a")).alias("area"), F.sum(sign * F.col("mx")).alias("mx"), F.sum(sign * F.col("my")).alias("my")
    )
    return total.filter(F.col("area") > 0).select(
        "geom", "area", (F.col("mx") / (6 * F.col("area"))).alias("x"), (F.col("my") / (6 * F.col("area"))).alias("y")
    )


def orient(vertices: DataFrame) -> DataFrame:
    """Outlines counter-clockwise and holes clockwise: rings of the wrong sign get their order reversed."""
    areas = ring_area(vertices)
    last = vertices.groupBy(*RING).agg(F.max("seq").alias("_last"))
    wrong = (F.col("area") < 0) == (F.col("ring") == 0)
    return (
        vertices.join(areas.join(last, RING), RING)
        .withColumn("seq", F.when(wrong, F.col("_last") - F.col("seq")).otherwise(F.col("seq"))).drop("_last", "area")
    )


def ring_acres(vertices: DataFrame, min_acres: float = 0.0) -> DataFrame:
    """Approximate acreage of rings given in degrees, small rings left out."""
    lat = vertices.groupBy(*RING).agg(F.avg("y").alias("_lat"))
    acres = F.abs("area") * KM_PER_DEGREE**2 * F.cos(F.radians("_lat")) * ACRES_PER_KM2
    return ring_area(vertices).join(lat, RING).select(*RING, acres.alias("acres")).filter(F.col("acres") >= min_acres)


def ring_quality(vertices: DataFrame, digits: int) -> DataFrame:
    """Rings with fewer than four points or no area once coordinates are rounded."""
    rounded = vertices.withColumns({"x": F.round("x", digits), "y": F.round("y", digits)})
    n = rounded.groupBy(*RING).agg(F.count("*").alias("points"))
    return n.join(ring_area(rounded), RING, "left").filter((F.col("points") < 4) | (F.coalesce("area", F.lit(0.0)) == 0))


def bounding_boxes(vertices: DataFrame) -> DataFrame:
    return vertices.groupBy("geom").agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")
    )


def bbox_filter(vertices: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Geometries whose bounding box touches ``box``; ``inside`` when it lies wholly in it."""
    x0, y0, x1, y1 = box
    c = F.col
    hits = (c("x0") <= x1) & (c("x1") >= x0) & (c("y0") <= y1) & (c("y1") >= y0)
    inside = (c("x0") >= x0) & (c("x1") <= x1) & (c("y0") >= y0) & (c("y1") <= y1)
    return bounding_boxes(vertices).filter(hits).withColumn("inside", inside)


def segment_clip(vertices: DataFrame, box: tuple[float, float, float, float], bounded: bool = False) -> DataFrame:
    """Segments clipped to a box by their entry and exit parameters, with a run number per line.

    A new run starts where a segment does not continue from the end of the one before.
    """
    x0, y0, x1, y1 = box
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")

    def span(p: Column, d: Column, lo: float, hi: float) -> tuple[Column, Column]:
        """Parameters between which p + t*d lies in [lo, hi]; an empty span when it never does."""
        a, b = (lo - p) / F.when(d != 0, d), (hi - p) / F.when(d != 0, d)
        inside = (p >= lo) & (p <= hi)
        return (
            F.when(d != 0, F.least(a, b)).when(inside, F.lit(0.0)).otherwise(F.lit(2.0)),
            F.when(d != 0, F.greatest(a, b)).when(inside, F.lit(1.0)).otherwise(F.lit(-1.0)),
        )

    (ax, bx), (ay, by) = span(F.col("x1"), dx, x0, x1), span(F.col("y1"), dy, y0, y1)
    cut = edges(vertices).withColumns({"t0": F.greatest(F.lit(0.0), ax, ay), "t1": F.least(F.lit(1.0), bx, by)}).filter("t0 < t1")
    at = lambda p, d, t: p + d * F.col(t)
    clipped = cut.select(
        *RING, "seq", "t0", "t1", at(F.col("x1"), dx, "t0").alias("cx1"), at(F.col("y1"), dy, "t0").alias("cy1"),
        at(F.col("x1"), dx, "t1").alias("cx2"), at(F.col("y1"), dy, "t1").alias("cy2"),
    )
    # a segment continues a run when its predecessor reaches its own end and it starts at its own start
    whole_end = clipped.filter("t1 = 1").select(*RING, (F.col("seq") + 1).alias("seq"), F.lit(True).alias("_joined"))
    tagged = clipped.join(whole_end, [*RING, "seq"], "left")
    starts = tagged.withColumn("_new", F.when(F.col("_joined") & (F.col("t0") == 0), 0).otherwise(1))
    numbered = prefix_sum(starts, RING, [F.col("seq").asc()], "_new", "_runs", bounded)
    return numbered.withColumn("run", (F.col("_runs") + F.col("_new") - 1).cast("int")).drop("_joined", "_new", "_runs", "t0", "t1")


def dedupe_vertices(vertices: DataFrame, digits: int) -> DataFrame:
    """Rounded vertices without consecutive repeats."""
    rounded = vertices.withColumns({"x": F.round("x", digits), "y": F.round("y", digits)})
    both = _beside(rounded, {"own": 0, "prev": -1}).filter(F.col("x_own").isNotNull())
    same = F.col("x_own").eqNullSafe(F.col("x_prev")) & F.col("y_own").eqNullSafe(F.col("y_prev"))
    return both.filter(~same).select(*RING, "seq", F.col("x_own").alias("x"), F.col("y_own").alias("y"))


def thin_vertices(vertices: DataFrame, tolerance: float) -> DataFrame:
    """Drop inner vertices closer than ``tolerance`` to the segment between their two neighbours."""
    near = _beside(vertices, {"own": 0, "prev": -1, "next": 1}).filter(F.col("x_own").isNotNull())
    c = F.col
    dx, dy = c("x_next") - c("x_prev"), c("y_next") - c("y_prev")
    length2 = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((c("x_own") - c("x_prev")) * dx + (c("y_own") - c("y_prev")) * dy) / F.when(length2 > 0, length2)))
    t = F.when(length2 > 0, t).otherwise(0.0)
    dist = F.hypot(c("x_own") - (c("x_prev") + t * dx), c("y_own") - (c("y_prev") + t * dy))
    inner = c("x_prev").isNotNull() & c("x_next").isNotNull()
    return near.filter(~(inner & (dist < tolerance))).select(*RING, "seq", c("x_own").alias("x"), c("y_own").alias("y"))


def collect_parts(features: DataFrame, by: list[str], part: str, chunks: int = 1) -> DataFrame:
    """Features of one name as rows (name, chunk) with its parts; single or multi by their number.

    ``chunks`` deals every name's parts by hash into so many rows, whatever their number; use more than one where a name may
    have more parts than a row can hold.
    """
    sizes = features.groupBy(*by).agg(F.count("*").alias("n_parts"))
    dealt = features.withColumn("chunk", F.pmod(F.xxhash64(part), F.lit(chunks)).cast("int"))
    rows = dealt.groupBy(*by, "chunk").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return rows.join(sizes, by).select(*by, "n_parts", "chunk", "parts", F.when(F.col("n_parts") > 1, "multi").otherwise("single").alias("kind"))


def explode_parts(features: DataFrame, kind: str, coordinates: str) -> DataFrame:
    """One row per part of single or multi geometries; ``coordinates`` already nests one level per part."""
    return features.select("*", F.posexplode(coordinates).alias("part", "part_coordinates")).withColumn(
        "part_kind", F.regexp_replace(kind, "^Multi", "")
    ).drop(coordinates)


# -- point in polygon -------------------------------------------------------------------
def point_in_polygon(points: DataFrame, vertices: DataFrame, cell: float = 1.0) -> DataFrame:
    """(point columns, geom) for every point inside a polygon, holes excluded.

    Polygons are listed under the grid cells that their boxes cover, each cell with only the edges
    that cross its horizontal band. A point meets the polygons of its own cell through an equality
    join; the residual test is the exact edge parity (outlines and holes both flip it).
    """
    to_cell = lambda c: F.floor(F.col(c) / cell)
    bands = (
        edges(vertices).withColumn("cy", F.explode(F.sequence(F.floor(F.least("y1", "y2") / cell), F.floor(F.greatest("y1", "y2") / cell))))
        .groupBy("geom", "cy").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
    )
    listed = (
        bounding_boxes(vertices)
        .select("geom", F.explode(F.sequence(to_cell("x0"), to_cell("x1"))).alias("cx"), "y0", "y1", "x0", "x1")
        .join(bands, "geom")
    )
    located = points.withColumns({"cx": to_cell("x"), "cy": to_cell("y")})
    x, y = F.col("x"), F.col("y")
    crosses = F.filter(
        "edges",
        lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0))),
    )
    near = located.join(listed, ["cx", "cy"]).filter(x.between(F.col("x0"), F.col("x1")) & y.between(F.col("y0"), F.col("y1")))
    return near.filter(F.size(crosses) % 2 == 1).select(*points.columns, "geom")


def exactly_one(points: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """Points that lie in no polygon or in several."""
    n = matches.groupBy(key).agg(F.count("*").alias("n"))
    return points.select(key).join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0))).filter("n <> 1")


# -- connected line pieces -----------------------------------------------------------------
def line_groups(pieces: DataFrame, key: str = "piece", a: str = "a", b: str = "b") -> DataFrame:
    """(piece, group): pieces that are connected through shared end points; the group is its smallest end point.

    Alternates two rewrites until nothing changes: every node links its larger neighbours to its
    smallest one, then its smaller neighbours. Long chains shrink by pointer jumping, so rounds grow
    with the logarithm of the chain length. Each round is written, which also bounds the lineage.
    """
    links = settle(pieces.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "links")
    while not _is_star_forest(links):
        links = settle(_star(_star(links, larger=True), larger=False), "links")
    labels = links.groupBy(F.col("u").alias(a)).agg(F.min("v").alias("root"))
    return pieces.join(labels, a, "left").select(key, F.coalesce("root", F.col(a)).alias("group"))


def _is_star_forest(links: DataFrame) -> bool:
    """No node is both a child and a parent, and no child has two parents: every group is one star."""
    ends = F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("child")), F.struct(F.col("v").alias("n"), F.lit(0).alias("child")))
    roles = links.select(F.inline(ends)).groupBy("n").agg(F.sum("child").alias("c"), F.min("child").alias("p"))
    return roles.filter("c > 1 OR (c = 1 AND p = 0)").limit(1).count() == 0


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """One rewrite: the neighbours on one side of each node are linked to the node's smallest neighbour.

    The minimum is a map-side aggregate joined back, so a node with very many links stays spread out.
    """
    if larger:
        near = links.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(links.select(F.col("v").alias("n"), F.col("u").alias("m")))
    else:
        near = links.select(F.col("u").alias("n"), F.col("v").alias("m"))
    low = near.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("lo"))
    side = F.col("m") > F.col("n") if larger else F.lit(True)
    moved = near.filter(side).join(low, "n").select(F.col("m").alias("u"), F.col("lo").alias("v"))
    if not larger:
        moved = moved.unionByName(low.select(F.col("n").alias("u"), F.col("lo").alias("v")))
    kept = moved.filter("u <> v")
    return kept if larger else kept.distinct()  # the second rewrite merges the duplicates of the first


# -- projections ---------------------------------------------------------------------------
def albers_forward(lon: Column, lat: Column, lat1: float, lat2: float, lat0: float, lon0: float) -> tuple[Column, Column]:
    """Spherical Albers equal-area conic."""
    p1, p2, p0 = (math.radians(v) for v in (lat1, lat2, lat0))
    n = (math.sin(p1) + math.sin(p2)) / 2
    c = math.cos(p1) ** 2 + 2 * n * math.sin(p1)
    rho0 = math.sqrt(c - 2 * n * math.sin(p0)) / n
    rho = F.sqrt(F.lit(c) - 2 * n * F.sin(F.radians(lat))) / n
    theta = n * (F.radians(lon) - math.radians(lon0))
    return rho * F.sin(theta), F.lit(rho0) - rho * F.cos(theta)


def fit_to_width(points: DataFrame, width: float) -> DataFrame:
    """Scale projected points to a frame of fixed width with y pointing down; extents come from one aggregate."""
    ends = points.agg(F.struct(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))).scalar()
    df = points.withColumn("_e", ends)
    scale = ratio(F.lit(width), F.col("_e.x1") - F.col("_e.x0"))
    height = F.round((F.col("_e.y1") - F.col("_e.y0")) * scale)
    return df.withColumns({
        "px": F.round((F.col("x") - F.col("_e.x0")) * scale, 1), "py": F.round(height - (F.col("y") - F.col("_e.y0")) * scale, 1)
    }).drop("_e")


@dataclass(frozen=True)
class Ellipsoid:
    """Semi-major axis in metres and flattening."""

    axis: float
    flattening: float

    @property
    def squared_eccentricity(self) -> float:
        return self.flattening * (2 - self.flattening)


# Published ellipsoids.
ELLIPSOIDS = {"GRS80": Ellipsoid(6378137.0, 1 / 298.257222101), "WGS84": Ellipsoid(6378137.0, 1 / 298.257223563), "Clarke1866": Ellipsoid(6378206.4, 1 / 294.978698214)}


def authalic_sine(sine: Column, ellipsoid: Ellipsoid) -> Column:
    """Sine of the authalic latitude: the sphere of equal area has the same surface south of it. ``sine`` is that of the geodetic one.

    The area integral of the ellipsoid as a power series in e2 sin2, sum of (k + 1) / (2 k + 1) z ** k; six terms leave less than 1e-12.
    """
    e2 = ellipsoid.squared_eccentricity
    terms = [(k + 1) / (2 * k + 1) for k in range(7)]

    def series(z):
        total = terms[-1]
        for c in reversed(terms[:-1]):
            total = z * total + c
        return total

    return sine * series(sine * sine * e2) / series(e2)


def geodetic_latitude(authalic: Column, ellipsoid: Ellipsoid) -> Column:
    """Latitude (radians) from the authalic latitude by the closed series in multiples of its angle (Snyder 1987, 3-18)."""
    e2 = ellipsoid.squared_eccentricity
    waves = ((2, e2 / 3 + 31 * e2 ** 2 / 180 + 517 * e2 ** 3 / 5040), (4, 23 * e2 ** 2 / 360 + 251 * e2 ** 3 / 3780), (6, 761 * e2 ** 3 / 45360))
    return authalic + sum((F.sin(authalic * m) * w for m, w in waves), F.lit(0.0))


@dataclass(frozen=True)
class ConicFrame:
    """An equal-area conic on the sphere of the ellipsoid's area, touched along two parallels; degrees in, metres out."""

    south: float
    north: float
    origin: tuple[float, float]  # longitude, latitude
    ellipsoid: Ellipsoid = ELLIPSOIDS["GRS80"]

    def _constants(self) -> tuple[float, float, float, float]:
        e2 = self.ellipsoid.squared_eccentricity
        sines = [math.sin(math.radians(v)) for v in (self.south, self.north, self.origin[1])]
        # squared radius of each standard parallel, in axes; area south of a parallel, in the same unit
        widths = [(1 - s * s) / (1 - e2 * s * s) for s in sines[:2]]
        whole = (1 - e2) * 2 * sum((k + 1) / (2 * k + 1) * e2 ** k for k in range(7))
        areas = [(1 - e2) * 2 * s * sum((k + 1) / (2 * k + 1) * (e2 * s * s) ** k for k in range(7)) for s in sines]
        cone = (widths[0] - widths[1]) / (areas[1] - areas[0])
        reach = widths[0] + cone * areas[0]
        return cone, reach, whole, math.sqrt(reach - cone * areas[2]) / cone

    def project(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        cone, reach, whole, top = self._constants()
        area = authalic_sine(F.sin(F.radians(lat)), self.ellipsoid) * whole
        radius = F.sqrt(F.lit(reach) - area * cone) / cone
        turn = F.radians(lon - self.origin[0]) * cone
        return radius * F.sin(turn) * self.ellipsoid.axis, (F.lit(top) - radius * F.cos(turn)) * self.ellipsoid.axis

    def locate(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Longitude and latitude of projected points, without iteration."""
        cone, reach, whole, top = self._constants()
        east, down = x / self.ellipsoid.axis, F.lit(top) - y / self.ellipsoid.axis
        area = (F.lit(reach) - (east * east + down * down) * (cone * cone)) / cone
        authalic = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), area / whole)))
        return F.degrees(F.atan2(east, down) / cone) + self.origin[0], F.degrees(geodetic_latitude(authalic, self.ellipsoid))
