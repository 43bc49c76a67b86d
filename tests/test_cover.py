"""The adaptive cover against the ray test over all edges: units, dense corners, holes, shared borders, corners of cells."""

import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from starslice.operators import cover as C

V = "geom string, part int, ring int, seq int, x double, y double"


def closed(geom, points, ring=0):
    return [(geom, 0, ring, i, float(x), float(y)) for i, (x, y) in enumerate([*points, points[0]])]


def wave(cx, cy, r, n, bumps):
    return [(cx + r * (1 + 0.4 * math.sin(bumps * t)) * math.cos(t), cy + r * (1 + 0.4 * math.sin(bumps * t)) * math.sin(t)) for t in (2 * math.pi * k / n for k in range(n))]


def spikes(cx, cy, n):
    """n thin triangles that meet in one point."""
    out = []
    for k in range(n):
        t = 2 * math.pi * k / n
        out += [(cx, cy), (cx + 3 * math.cos(t), cy + 3 * math.sin(t)), (cx + 3 * math.cos(t + 2 / n), cy + 3 * math.sin(t + 2 / n))]
    return out


def brute(points, vertices):
    rings = {}
    for geom, _, ring, seq, x, y in sorted(vertices):
        rings.setdefault((geom, ring), []).append((x, y))
    out = []
    for i, x, y in points:
        for geom in sorted({g for g, _ in rings}):
            inside = False
            for (g, _), v in rings.items():
                if g == geom:
                    for (x1, y1), (x2, y2) in zip(v, v[1:]):
                        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                            inside = not inside
            if inside:
                out.append((i, geom))
    return sorted(out)


SHAPES = (
    closed("wave", wave(0, 0, 5, 200, 9)) + closed("wave", wave(0, 0, 1.5, 60, 4), 1) + closed("spikes", spikes(8, 1, 40))
    + closed("left", [(-4, -9), (0, -9), (0, -7), (-4, -7)]) + closed("right", [(0, -9), (4, -9), (4, -7), (0, -7)][::-1])
)


@pytest.mark.parametrize("most,levels,scale,east,north", [(2, 4, 1.0, 0.0, 0.0), (8, 8, 111320.0, 5e5, 4.2e6), (24, 8, 1e-4, -93.0, 38.0), (1000, 12, 1.0, 0.0, 0.0)])
def test_cover_equals_rays(spark, most, levels, scale, east, north):
    moved = [(g, p, r, s, x * scale + east, y * scale + north) for g, p, r, s, x, y in SHAPES]
    points = [(i, ((i * 3571) % 4001 / 4001 * 24 - 9) * scale + east, ((i * 7919) % 4003 / 4003 * 20 - 11) * scale + north) for i in range(1200)]
    points += [(5000 + i, v[4], v[5]) for i, v in enumerate(moved[::7])]  # on vertices
    points += [(9000 + i, (i % 9 - 4) * scale + east, (i // 9 - 9) * scale + north) for i in range(81)]  # on borders and corners of cells
    want = brute(points, moved)
    found = C.point_in_polygon(spark.createDataFrame(points, "id int, x double, y double"), spark.createDataFrame(moved, V), most, levels)
    assert sorted(rows(found.select("id", "geom"))) == want and len(want) > 300


def test_leaves_are_bounded_and_solid_cells_have_no_edges(spark):
    cover = C.polygon_cover(spark.createDataFrame(SHAPES, V), 8, 6)
    plain = cover.filter("pieces = 1")
    assert plain.filter(F.size("edges") > 8).count() == 0
    assert plain.filter("inside AND edges IS NULL").count() > 0
    assert cover.filter("pieces > 1").select("geom").distinct().collect()[0].geom == "spikes"  # edges through one point


def test_missing_coordinates_flat_polygons_and_empty_tables(spark):
    flat = closed("flat", [(0, 0), (4, 0), (2, 0)]) + closed("box", [(0, 0), (4, 0), (4, 4), (0, 4)])
    shapes = spark.createDataFrame(flat, V)
    points = spark.createDataFrame([(1, None, 1.0), (2, 1.0, None), (3, 1.0, 1.0), (3, 1.0, 1.0), (4, float("nan"), 1.0)], "id int, x double, y double")
    assert rows(C.point_in_polygon(points, shapes).select("id", "geom")) == [(3, "box"), (3, "box")]
    assert rows(C.point_in_polygon(points, shapes.limit(0))) == []
    assert rows(C.point_in_polygon(points.limit(0), shapes)) == []


def test_points_meet_cells_by_equality(spark):
    cover = C.polygon_cover(spark.createDataFrame(SHAPES, V), 16, 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = C.locate(spark.range(100).select("id", (F.col("id") / 10).alias("x"), F.lit(1.5).alias("y")), cover)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_points_of_one_file_are_dealt_to_all_tasks(spark, tmp_path):
    points = [(i, ((i * 3571) % 4001 / 4001 * 24 - 9), ((i * 7919) % 4003 / 4003 * 20 - 11)) for i in range(400)]
    spark.createDataFrame(points, "id int, x double, y double").coalesce(1).write.parquet(str(tmp_path / "points"))
    cover = C.polygon_cover(spark.createDataFrame(SHAPES, V), 1000, 12)
    found = C.locate(spark.read.parquet(str(tmp_path / "points")), cover).withColumn("task", F.spark_partition_id())
    assert found.select("task").distinct().count() > 1
    assert sorted(rows(found.select("id", "geom"))) == brute(points, SHAPES)


def test_a_point_meets_the_edges_of_its_band_only(spark):
    tall = closed("tall", [(0, 0), *[(3 + (k % 2) / 4, k / 8) for k in range(1, 64)], (0, 8)])
    bands = C._banded(C.polygon_cover(spark.createDataFrame(tall, V), 1000, 12)).collect()
    assert max(len(r.beside) for r in bands) < 20 and sum(len(r.beside) for r in bands) >= 63


def test_places_of_a_jagged_ring_meet_few_edges_each(spark):
    ring = lambda k, cx, cy: closed(f"ring {k}", [(cx + r * math.cos(t), cy + r * math.sin(t)) for r, t in ((1 + (k + s * s * 7) % 13 / 10, 2 * math.pi * s / 60) for s in range(60))])
    shapes = ring(1, 0.3, 0.7) + ring(2, 1.1, -0.4) + closed("tie", [(-2, -2), (2, 2), (2, -2), (-2, 2)])
    points = [(i, (i * 3571) % 4001 / 4001 * 7 - 3, (i * 7919) % 4003 / 4003 * 6 - 3) for i in range(1500)]
    points += [(5000 + i, v[4], v[5]) for i, v in enumerate(shapes[-5:])] + [(9000 + i, i % 24 / 4 - 3, i // 24 / 4 - 3) for i in range(576)]  # vertices, corners of squares
    want = brute(points, shapes)
    cover = C.polygon_cover(spark.createDataFrame(shapes, V))
    assert cover.filter(F.size("edges") > 2 * C.FEW).count() > 0
    found = C.locate(spark.createDataFrame(points, "id int, x double, y double"), cover)
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[1]  # pairs of place and edges run as generated code
    assert sorted(rows(found.select("id", "geom"))) == want and len(want) > 300
    squares = C._cut(cover.filter(F.size("edges") > C.FEW).select(*C.CELL, "inside", "edges")).collect()
    assert sum(not r.edges for r in squares) > 5
    corners = [(k, (r.ix + 1) * 2.0 ** r.e, r.iy * 2.0 ** r.e) for k, r in enumerate(squares)]
    assert {(k, squares[k].geom) for k, r in enumerate(squares) if r.inside} == {(k, g) for k, g in brute(corners, shapes) if squares[k].geom == g}
