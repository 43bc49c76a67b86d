"""Landed files and published forms: scans, round trips and pruning."""

import json

from conftest import one, rows
from pyspark.sql import functions as F

from starslice.sources import scans, sinks


def plan(df, mode="formatted"):
    return df._jdf.queryExecution().toString() if mode == "all" else df._jdf.queryExecution().executedPlan().toString()


def put(folder, name, text):
    (folder / name).write_text(text, encoding="utf-8")
    return str(folder / name)


def test_pages(spark, tmp_path):
    put(tmp_path, "deer_2019_20.html", "<p>a\nb</p>")
    put(tmp_path, "turkey-2020.html", "<p>c</p>")
    got = sorted(rows(scans.pages(spark, str(tmp_path)).select("species", "season_year", "html")))
    assert got == [("deer", 2019, "<p>a\nb</p>"), ("turkey", 2020, "<p>c</p>")]


def test_delimited(spark, tmp_path):
    gaz = put(tmp_path, "gaz.txt", "USPS\tGEOID\tALAND_SQMI  \nMO\t29001\t567.3 \nKS\t20001\t1.0\n")
    assert rows(scans.gazetteer(spark, gaz, "29").select("GEOID", "ALAND_SQMI")) == [("29001", "567.3")]
    codes = put(tmp_path, "codes.txt", "STATE|STATEFP|COUNTYFP|COUNTYNAME\nMO|29|001|Adair County\n")
    assert rows(scans.county_codes(spark, codes).select("fips", "COUNTYNAME")) == [("29001", "Adair County")]


def test_json_sources(spark, tmp_path):
    path = put(tmp_path, "al.json", json.dumps([{"fips": "1", "name": "A", "aliases": ["a", "aa"]}, {"fips": "2", "name": "B", "aliases": []}], indent=1))
    assert scans.aliases(spark, path).agg(F.sum(F.size("aliases"))).collect()[0][0] == 2
    (tmp_path / "svc").mkdir()
    for i, years in enumerate((["2018", "2019"], ["2020"])):
        put(tmp_path / "svc", f"p{i}.json", json.dumps({"fields": [], "features": [{"attributes": {"PERMITYEAR": y, "n": 5}} for y in years]}))
    got = scans.features(spark, str(tmp_path / "svc"), "PERMITYEAR string, n int")
    assert sorted(rows(got)) == [("2018", 5), ("2019", 5), ("2020", 5)]
    env = put(tmp_path, "env.json", json.dumps({"generated": "2024-01-01", "rows": [{"county_fips": "1", "year": 2020, "samples": 3}]}))
    assert rows(scans.envelope(spark, env, "rows", "county_fips string, year int, samples int")) == [("1", 2020, 3)]
    arr = put(tmp_path, "arr.json", json.dumps({"columns": ["year", "portion", "public_land"], "rows": [[2020, "spring", 7], [2021, "fall", 8]]}))
    assert sorted(rows(scans.row_arrays(spark, arr, {"public_land": "int", "year": "int"}))) == [(7, 2020), (8, 2021)]


GEO = {"type": "FeatureCollection", "features": [
    {"properties": {"NAME": "sq", "Region": "N"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]], [[0.5, 0.5], [0.5, 1], [1, 1], [1, 0.5], [0.5, 0.5]]]}},
    {"properties": {"NAME": "mp"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[5, 5], [6, 5], [6, 6], [5, 5]]], [[[8, 8], [9, 8], [9, 9], [8, 8]]]]}},
    {"properties": {"NAME": "ln"}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}},
    {"properties": {"NAME": "ml"}, "geometry": {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[3, 3], [4, 4], [5, 5]]]}},
    {"properties": {"NAME": "pt"}, "geometry": {"type": "Point", "coordinates": [7, 8]}},
]}


def test_geojson_round_trip(spark, tmp_path):
    path = put(tmp_path, "g.json", json.dumps(GEO))
    shapes = scans.geojson(spark, path).withColumn("name", F.col("properties")["name"])
    v = scans.vertices(shapes, "name")
    counts = {(r.geom, r.part, r.ring): r["count"] for r in v.groupBy("geom", "part", "ring").count().collect()}
    assert counts == {("sq", 0, 0): 5, ("sq", 0, 1): 5, ("mp", 0, 0): 4, ("mp", 1, 0): 4, ("ln", 0, 0): 2, ("ml", 0, 0): 2, ("ml", 1, 0): 3, ("pt", 0, 0): 1}
    polys = v.filter("geom IN ('sq', 'mp')")
    back = {json.loads(r.value)["properties"]["name"]: json.loads(r.value)["geometry"] for r in sinks.geojson_features(polys, shapes.select(F.col("name").alias("geom"), "name")).collect()}
    assert back["sq"] == GEO["features"][0]["geometry"] and back["mp"]["type"] == "MultiPolygon" and len(back["mp"]["coordinates"]) == 2


def test_documents(spark, star, tmp_path):
    sinks.write_envelope(star.dim.select("entity", "name"), str(tmp_path / "e"), "rows", ["entity"], source="test")
    doc = json.loads("".join(p.read_text() for p in (tmp_path / "e").rglob("part-*")))
    assert doc["source"] == "test" and [r["entity"] for r in doc["rows"]] == list(range(25))
    lines = spark.createDataFrame([(2, None, "b"), (1, 0.5, "a")], "k int, v double, s string")
    sinks.write_lines(lines, str(tmp_path / "l"), "k")
    text = "".join(p.read_text() for p in sorted((tmp_path / "l").glob("part-*"))).splitlines()
    assert [json.loads(t) for t in text] == [{"k": 1, "v": 0.5, "s": "a"}, {"k": 2, "v": None, "s": "b"}]
    assert sorted(r.value for r in sinks.row_arrays(lines, ["s", "k", "v"]).collect()) == ['["a",1,0.5]', '["b",2,null]']


def test_row_arrays_of_mixed_types(spark, tmp_path):
    """Positions come from each document's own columns; quotes, brackets and line feeds stay; a name that a document lacks is null."""
    data = [(k, 'a"]},[%d\n' % k, None if k % 3 else k / 2, k % 2 == 0) for k in range(25)]
    df = spark.createDataFrame(data, "k int, s string, v double, b boolean")
    docs = sinks.row_array_documents(df, ["s", "v", "k", "b"], ["k"], "MO", size=6)
    parsed = [json.loads(r.value) for r in docs.orderBy("piece").collect()]
    assert len(parsed) > 2 and all(p["state"] == "MO" and p["columns"] == ["s", "v", "k", "b"] for p in parsed)
    assert [tuple(r) for p in parsed for r in p["rows"]] == [(s, v, k, b) for k, s, v, b in data]
    docs.select("value", "piece").write.partitionBy("piece").text(str(tmp_path / "rows"))
    (tmp_path / "rows" / "piece=99").mkdir()
    put(tmp_path / "rows" / "piece=99", "more.json", json.dumps({"columns": ["k", "other"], "rows": [[100, "x"]]}))
    back = scans.row_arrays(spark, str(tmp_path / "rows"), {"k": "int", "s": "string", "v": "double", "b": "boolean"})
    assert sorted(rows(back)) == data + [(100, None, None, None)]


def test_documents_grow_in_number_not_in_size(spark, tmp_path, monkeypatch):
    """Landed GeoJSON: a document is read by one task as a whole, so many shapes make more documents."""
    from starslice.workload import file_queries as Q

    spark.range(100).select(F.col("id").alias("c_custkey")).write.parquet(str(tmp_path / "customer.parquet"))
    kept = []
    for most in (2000, 2):
        monkeypatch.setattr(Q, "FEATURES", most, raising=False)
        monkeypatch.setattr(Q, "_folder", lambda s, name, most=most: str(tmp_path / f"{name}-{most}"))
        kept.append(sorted((r.properties["fullname"], r.kind, r.coordinates) for r in Q._shapes(spark, str(tmp_path)).collect()))
    folders = [len(list((tmp_path / f"shapes-{most}").glob("piece=*"))) for most in (2000, 2)]
    assert kept[0] == kept[1] and len(kept[0]) == 100 and folders[0] <= 16 < folders[1]
