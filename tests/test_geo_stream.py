"""Geometry against brute force, connected pieces, and the streaming rollup against the batch result."""

import math

import pytest
from conftest import one, rows
from pyspark.sql import functions as F

from starslice.operators import geo as G
from starslice.streaming import rollup as SR

V = "geom string, part int, ring int, seq int, x double, y double"


def ring(geom, points, r=0, part=0):
    return [(geom, part, r, i, float(x), float(y)) for i, (x, y) in enumerate(points)]


SQUARE = [(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]
HOLE = [(0.5, 0.5), (1, 0.5), (1, 1), (0.5, 1), (0.5, 0.5)]


@pytest.fixture(scope="module")
def shapes(spark):
    return spark.createDataFrame(ring("a", SQUARE) + ring("a", HOLE, 1) + ring("b", SQUARE[::-1]) + ring("flat", [(0, 0), (1, 0), (0, 0), (0, 0)]), V)


def test_area_centroid_orientation(shapes):
    areas = {(r.geom, r.ring): r.area for r in G.ring_area(shapes).collect()}
    assert areas[("a", 0)] == 4 and areas[("a", 1)] == 0.25 and areas[("b", 0)] == -4
    c = {r.geom: (r.area, r.x, r.y) for r in G.polygon_centroid(shapes).collect()}
    assert c["a"][0] == 3.75 and math.isclose(c["a"][1], (4 * 1 - 0.25 * 0.75) / 3.75) and c["b"] == (4, 1, 1) and "flat" not in c
    turned = {(r.geom, r.ring): r.area for r in G.ring_area(G.orient(shapes)).collect()}
    assert turned[("b", 0)] == 4 and turned[("a", 1)] == -0.25
    assert [r.geom for r in G.ring_quality(shapes, 3).collect()] == ["flat"]


def test_point_in_polygon_brute_force(spark, shapes):
    pts = [(i, (i * 37 % 101) / 40.0, (i * 53 % 103) / 40.0) for i in range(300)]
    points = spark.createDataFrame(pts, "id int, x double, y double")
    for cell in (0.3, 1.0, 10.0):
        got = sorted(rows(G.point_in_polygon(points, shapes.filter("geom IN ('a', 'b')"), cell).select("id", "geom")))
        want = []
        for i, x, y in pts:
            if 0 <= x < 2 and 0 <= y < 2:
                want.append((i, "b"))
                if not (0.5 <= x < 1 and 0.5 <= y < 1):
                    want.append((i, "a"))
        assert got == sorted(want)


def test_clip_runs(spark):
    line = spark.createDataFrame(ring("l", [(0, 0.5), (3, 0.5), (3, 5), (0.5, 5), (0.5, 0.2), (0.7, 0.2)]), V)
    for bounded in (True, False):
        got = sorted(rows(G.segment_clip(line, (0, 0, 1, 1), bounded).select("seq", "cx1", "cy1", "cx2", "cy2", "run")))
        assert [(r[0], r[5]) for r in got] == [(0, 0), (3, 1), (4, 1)]
        assert [round(v, 6) for v in got[1][1:5]] == [0.5, 1.0, 0.5, 0.2]


def test_dedupe_and_thin(spark):
    line = spark.createDataFrame(ring("l", [(0, 0), (0.01, 0), (1, 0.001), (2, 0), (2, 2)]), V)
    assert [r.seq for r in G.dedupe_vertices(line, 1).orderBy("seq").collect()] == [0, 2, 3, 4]
    assert [r.seq for r in G.thin_vertices(line, 0.1).orderBy("seq").collect()] == [0, 3, 4]


def test_line_groups_chain_and_hub(spark):
    chain = [(i, 1000 + i, 1001 + i) for i in range(0, 90) if i != 44]
    hub = [(200 + i, 5000 + i, 7) for i in range(40)]
    loop = [(400, 1, 2), (401, 2, 3), (402, 3, 1)]
    pieces = spark.createDataFrame(chain + hub + loop, "piece int, a int, b int")
    got = {r.piece: r.group for r in G.line_groups(pieces).collect()}
    assert got[0] == got[43] == 1000 and got[45] == got[89] == 1045
    assert {got[200 + i] for i in range(40)} == {7} and {got[400], got[401], got[402]} == {1}
    assert len(got) == len(chain) + len(hub) + len(loop)


def test_collect_parts_chunks_large_names(spark):
    df = spark.createDataFrame([("big", i) for i in range(50)] + [("small", 1)], "name string, p int")
    out = G.collect_parts(df, ["name"], "p", chunks=8).collect()
    assert sum(len(r.parts) for r in out if r.name == "big") == 50 and max(len(r.parts) for r in out) < 50
    assert [(r.kind, r.parts) for r in out if r.name == "small"] == [("single", [1])]


def test_acres_and_boxes(spark):
    v = spark.createDataFrame(ring("a", [(-92, 38), (-91.9, 38), (-91.9, 38.1), (-92, 38.1), (-92, 38)]), V)
    lat = (38 * 3 + 38.1 * 2) / 5
    assert math.isclose(one(G.ring_acres(v).select("acres")), 0.01 * 111.32**2 * math.cos(math.radians(lat)) * 247.105381, rel_tol=1e-9)
    assert G.ring_acres(v, 1e9).count() == 0
    assert rows(G.bbox_filter(v, (-91.95, 37, -90, 39)).select("geom", "inside")) == [("a", False)]


def test_albers_round_trip(spark):
    conic = G.ConicFrame(29.5, 45.5, (-96.0, 23.0))
    x, y = conic.project(F.col("lon"), F.col("lat"))
    lon, lat = conic.locate(F.col("x"), F.col("y"))
    df = spark.createDataFrame([(-92.5, 38.5), (-96.0, 23.0), (-89.1, 36.0)], "lon double, lat double")
    for r in df.withColumns({"x": x, "y": y}).withColumns({"lon2": lon, "lat2": lat}).collect():
        assert math.isclose(r.lon, r.lon2, abs_tol=1e-9) and math.isclose(r.lat, r.lat2, abs_tol=1e-6)
    # published worked example: Clarke 1866 ellipsoid, 35 N 75 W
    clarke = G.ConicFrame(29.5, 45.5, (-96.0, 23.0), G.ELLIPSOIDS["Clarke1866"])
    x, y = clarke.project(F.lit(-75.0), F.lit(35.0))
    r = spark.range(1).select(x.alias("x"), y.alias("y")).collect()[0]
    assert abs(r.x - 1885472.7) < 0.5 and abs(r.y - 1535925.0) < 0.5


def test_stream_equals_batch_and_survives_restart(spark, tmp_path):
    days = [(f"2024-01-{1 + i % 9:02d} 10:00:00", i % 3, "error" if i % 4 == 0 else "view", i) for i in range(90)]
    full = spark.createDataFrame(days, "t string, user_id long, event_type string, event_id long").select(
        "event_id", F.to_timestamp("t").alias("ts"), "user_id", "event_type", F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    inbox = str(tmp_path / "in")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        raw = SR.sample_stream(spark, inbox, "*.parquet")
        s = raw.select(F.col("user_id").alias("entity"), "ts", (F.col("event_type") == "error").cast("long").alias("positive"))
        rollup = SR.windowed_rollup(s, late="30 days")
        SR.run_available(rollup, out, state)
        return rollup.schema

    full.filter("event_id < 40").coalesce(1).write.mode("append").parquet(inbox)
    run()
    full.filter("event_id >= 40").coalesce(1).write.mode("append").parquet(inbox)
    run()  # continues from the saved state
    live = SR.live_table(spark, out, run())  # a run without new files must not change the table
    batch = full.groupBy(F.col("user_id").alias("entity"), F.date_trunc("day", "ts").alias("period_start")).agg(
        F.count("*").alias("samples"), F.sum((F.col("event_type") == "error").cast("long")).alias("positives"))
    assert live.exceptAll(batch).count() == 0 and batch.exceptAll(live).count() == 0
    last = SR.running_totals(live).groupBy("entity").agg(F.max("cum_samples").alias("n"), F.max("cum_positives").alias("p"))
    assert one(last.agg(F.sum("n"))) == 90 and one(last.agg(F.sum("p"))) == 23


def test_closed_periods_win(spark):
    closed = spark.createDataFrame([(1, 2020, 5)], "entity int, year int, samples int")
    live = spark.createDataFrame([(1, 2020, 4), (1, 2021, 2)], "entity int, year int, samples int")
    assert sorted(rows(SR.merge_closed(closed, live, ["entity", "year"]))) == [(1, 2020, 5), (1, 2021, 2)]


def counts(df):
    return {(r.entity, str(r.period)): (r.samples, r.positives) for r in df.collect()}


def test_live_table_is_exact(spark, tmp_path):
    """Late rows, repeats, corrections, replays and a failed batch: the table always equals the distinct samples, the latest batch's values."""
    import random

    from starslice.streaming import live as LV

    rng, schema = random.Random(3), "entity bigint, period date, sample_id bigint, positive bigint"
    live, truth = LV.LiveSamples(spark, str(tmp_path / "t"), late=2), {}
    batches = []
    for b in range(5):
        rows = {}
        for _ in range(40):
            day = max(1, min(28, 3 * b + 1 - rng.choice([0, 0, 0, 1, 2, 5, 9])))
            key = (f"2024-02-{day:02d}", rng.randrange(30))
            rows[key] = (rng.randrange(3), rng.randrange(2))
        batches.append(rows)
    import datetime

    def frame(rows, twice=True):
        data = [(e, datetime.date.fromisoformat(p), i, v) for (p, i), (e, v) in rows.items()]
        return spark.createDataFrame(data + (data[:7] if twice else []) + [(1, None, 1, 1)], schema)

    closed = set()
    for b, rows in enumerate(batches):
        live.add(frame(rows), b)
        truth |= rows
        live.add(frame(batches[0]), b)  # a replay of a listed batch changes nothing
        want = {}
        for (p, _), (e, v) in truth.items():
            n, k = want.get((e, p), (0, 0))
            want[e, p] = (n + 1, k + v)
        assert counts(live.table()) == want, b
        closed |= {p for p, e in live.manifest()["periods"].items() if e["compact"] is not None}
    assert len(closed) > 3
    newest = max(live.manifest()["periods"])
    opened = [p for p, e in live.manifest()["periods"].items() if e["segments"]]
    assert all((datetime.date.fromisoformat(newest) - datetime.date.fromisoformat(p)).days <= 2 for p in opened)


def test_live_batch_that_fails_leaves_the_table(spark, tmp_path, monkeypatch):
    from starslice.sources import files
    from starslice.streaming import live as LV

    live = LV.LiveSamples(spark, str(tmp_path / "t"))
    rows = spark.sql("SELECT CAST(id % 3 AS BIGINT) AS entity, DATE '2024-01-05' AS period, id AS sample_id, 1L AS positive FROM range(10)")
    assert live.table().count() == 0
    live.add(rows.filter("sample_id < 6"), 0)
    put = files.Folder.put_json
    monkeypatch.setattr(files.Folder, "put_json", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        live.add(rows, 1)
    monkeypatch.setattr(files.Folder, "put_json", put)
    assert sum(n for n, _ in counts(live.table()).values()) == 6
    live.add(rows, 1)  # the replay overwrites what the failed one wrote
    assert sum(n for n, _ in counts(live.table()).values()) == 10


def test_neighbours_meet_across_blocks_and_repeats(spark, monkeypatch):
    """A small block, so that most neighbours are of two blocks; repeated positions keep the greatest, null ones are a position."""
    at = {"geom": "g", "part": 0, "ring": 0}
    data = [(k, float(k * k), float(-k)) for k in range(11)] + [(4, 99.0, -50.0), (None, 1.0, 2.0), (20, 3.0, None)]
    table = spark.createDataFrame([(*at.values(), *r) for r in data], "geom string, part int, ring int, seq int, x double, y double")
    offsets = {"own": 0, "prev": -1, "next": 1}
    want = {}
    for seq, x, y in data:
        for role, o in offsets.items():
            place = want.setdefault(None if seq is None else seq - o, {})
            for c, v in (("x", x), ("y", y)):
                known = place.get(f"{c}_{role}")
                place[f"{c}_{role}"] = v if known is None else known if v is None else max(known, v)
    names = [f"{c}_{n}" for n in offsets for c in "xy"]
    for size in (1, 2, 3, 1024):
        monkeypatch.setattr(G, "BLOCK", size)
        got = {r.seq: [r[n] for n in names] for r in G._beside(table, offsets).collect()}
        assert got == {k: [v.get(n) for n in names] for k, v in want.items()}


def test_neighbours_are_grouped_after_the_only_shuffle(spark, tmp_path):
    """One file's vertices are dealt to tasks before they are copied and grouped."""
    flat = spark.range(1000).select((F.col("id") % 50).alias("geom"), F.lit(0).alias("part"), F.lit(0).alias("ring"), F.floor(F.col("id") / 50).cast("int").alias("seq"), F.rand(1).alias("x"), F.rand(2).alias("y"))
    flat.coalesce(1).write.parquet(str(tmp_path / "v"))
    plan = G._beside(spark.read.parquet(str(tmp_path / "v")), {"a": 0, "b": 1})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.rindex("HashAggregate") < plan.index("Exchange")
