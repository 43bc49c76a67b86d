"""Scans of landed source files: pages, alias lists, gazetteers, feature services, GeoJSON, envelopes and published series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PATH = r"([a-z]+)[_-](\d{4})(?:[_-]\d{2,4})?\.[a-z]+$"


def pages(spark: SparkSession, folder: str, pattern: str = _PATH) -> DataFrame:
    """(species, season_year, path, html): one row per landed file, keys taken from the file name."""
    raw = spark.read.text(folder, wholetext=True).withColumn("path", F.input_file_name())
    return raw.select(
        F.regexp_extract("path", pattern, 1).alias("species"), F.regexp_extract("path", pattern, 2).try_cast("int").alias("season_year"),
        "path", F.col("value").alias("html"),
    )


def aliases(spark: SparkSession, path: str) -> DataFrame:
    """Entity names with their alias arrays from a JSON list."""
    return spark.read.schema("fips string, name string, aliases array<string>").option("multiLine", True).json(path)


def delimited(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """Delimited text with a header; header names and text values are trimmed."""
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    return raw.select(*[F.trim(F.col(f"`{c}`")).alias(c.strip()) for c in raw.columns])


def gazetteer(spark: SparkSession, path: str, prefix: str, key: str = "GEOID") -> DataFrame:
    """Rows of one state from a tab-separated gazetteer."""
    return delimited(spark, path, "\t").filter(F.col(key).startswith(prefix))


def county_codes(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-separated county codes with the five-digit key."""
    return delimited(spark, path, "|").withColumn("fips", F.concat("STATEFP", "COUNTYFP"))


def features(spark: SparkSession, path: str, attributes: str | T.StructType) -> DataFrame:
    """Rows of a feature service from all landed result pages; ``attributes`` is their schema."""
    inner = attributes if isinstance(attributes, str) else attributes.simpleString().removeprefix("struct<").removesuffix(">")
    schema = f"features array<struct<attributes: struct<{inner}>>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f")).select("f.attributes.*")


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """(feature, properties, kind, coordinates): property keys lower-cased, coordinates kept as JSON text."""
    schema = "features array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    return raw.select(F.posexplode("features").alias("feature", "f")).select(
        "feature", F.transform_keys("f.properties", lambda k, _: F.lower(k)).alias("properties"),
        F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"),
    )


def layer(shapes: DataFrame, predicate: str, name: str) -> DataFrame:
    """The features of one overlay layer with their display name; features without a shape are left out."""
    return shapes.filter(predicate).filter("kind IS NOT NULL").withColumn("name", F.trim(F.col("properties")[name]))


def vertices(shapes: DataFrame, geom: str) -> DataFrame:
    """Vertex table (geom, part, ring, seq, x, y) of points, lines, polygons and their multi forms."""
    kind, text = F.col("kind"), F.col("coordinates")
    deep = "array<" * 4 + "double" + ">" * 4
    # every kind is brought to part > ring > vertex > number before it is decoded once
    lifted = (
        F.when(kind == "MultiPolygon", text).when(kind == "Polygon", F.concat(F.lit("["), text, F.lit("]")))
        .when(kind == "LineString", F.concat(F.lit("[["), text, F.lit("]]")))
        .when(kind == "MultiLineString", F.regexp_replace(F.regexp_replace(text, r"^\s*\[\s*\[\s*\[", "[[[["), r"\]\s*\]\s*\]\s*$", "]]]]"))
        .when(kind == "Point", F.concat(F.lit("[[["), text, F.lit("]]]")))
    )
    lines = kind == "MultiLineString"
    parts = shapes.withColumn("_lines", lines).select(F.col(geom).alias("geom"), "_lines", F.posexplode(F.from_json(lifted, deep)).alias("part", "_p"))
    rings = parts.select("geom", "part", "_lines", F.posexplode("_p").alias("ring", "_r"))
    flat = rings.select("geom", "part", "ring", "_lines", F.posexplode("_r").alias("seq", "_v"))
    # pieces of a multi-line are parts, not rings
    return flat.select(
        "geom", F.when(F.col("_lines"), F.col("ring")).otherwise(F.col("part")).alias("part"),
        F.when(F.col("_lines"), 0).otherwise(F.col("ring")).alias("ring"), "seq",
        F.col("_v")[0].alias("x"), F.col("_v")[1].alias("y"),
    )


def envelope(spark: SparkSession, path: str, field: str, row_schema: str) -> DataFrame:
    """Rows of one field of a JSON document."""
    raw = spark.read.schema(f"`{field}` array<struct<{row_schema}>>").option("multiLine", True).json(path)
    return raw.select(F.explode(field).alias("r")).select("r.*")


def row_arrays(spark: SparkSession, path: str, wanted: dict[str, str]) -> DataFrame:
    """Row-array JSON (``columns`` and ``rows``) by column name; ``wanted`` maps a name to its type.

    Rows are arrays of values of different types, so a document is read as a variant and each value is taken at the position of its column. A name
    that the document lacks is null; a value of another type is an error.
    """
    raw = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    names = F.variant_get("v", "$.columns", "array<string>")
    rows = raw.select(names.alias("columns"), F.explode(F.variant_get("v", "$.rows", "array<variant>")).alias("r"))
    cells = rows.select("columns", F.variant_get("r", "$", "array<variant>").alias("r"))
    value = lambda c: F.get("r", F.nullif(F.array_position("columns", F.lit(c)), F.lit(0)).cast("int") - 1)
    return cells.select(*[F.variant_get(value(c), "$", t).alias(c) for c, t in wanted.items()])


def published_series(spark: SparkSession, path: str, known: DataFrame | None = None, entity_type: str = "string") -> DataFrame:
    """Long rows of published pivot documents: zeros dropped, portion attributes and labels attached.

    A row of ``series`` is [period, portion, class, counts]; its label is found under "species:period:portion", and one without a label is not
    derived. ``known`` (a dimension) makes an entity that it lacks an error.
    """
    raw = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    docs = raw.select(
        F.variant_get("v", "$.state", "string").alias("state"), F.variant_get("v", "$.species", "string").alias("species"),
        F.variant_get("v", "$.counties", "array<string>").alias("counties"),
        F.variant_get("v", "$.portions", "map<string, struct<season: string, method: string, youth: boolean, is_subtotal: boolean>>").alias("portions"),
        F.variant_get("v", "$.labels", "map<string, struct<portion_label: string, source_url: string, derived: boolean>>").alias("labels"),
        F.explode(F.variant_get("v", "$.series", "array<variant>")).alias("s"),
    )
    at = lambda k, t: F.variant_get("s", f"$[{k}]", t)
    rows = docs.select(
        "state", "species", "counties", "portions", "labels", at(0, "int").alias("season_year"), at(1, "string").alias("portion"),
        at(2, "string").alias("class"), at(3, "array<bigint>").alias("counts"),
    )
    key = F.concat_ws(":", "species", F.col("season_year").cast("string"), "portion")
    cells = rows.select(
        "state", "species", "season_year", "portion", "class", F.col("portions")[F.col("portion")].alias("attr"), F.col("labels")[key].alias("label"),
        F.inline(F.arrays_zip(F.col("counties").alias("entity"), F.col("counts").alias("cnt"))),
    ).filter(F.col("cnt") != 0)
    out = cells.select(
        "state", "species", "season_year", "portion", "class", F.col("entity").cast(entity_type).alias("entity"), "cnt", "attr.*",
        "label.portion_label", "label.source_url", F.coalesce("label.derived", F.lit(False)).alias("derived"),
    )
    if known is None:
        return out
    names = known.select(F.col("entity").cast(entity_type).alias("entity"), F.lit(True).alias("_known")).distinct()
    checked = F.when(F.col("_known"), F.col("entity")).otherwise(F.raise_error(F.concat(F.lit("unknown entity "), F.col("entity").cast("string"))))
    return out.join(names, "entity", "left").withColumn("entity", checked).select(*out.columns)


def species_fact(spark: SparkSession, path: str, species: str, *columns: str) -> DataFrame:
    """One species from a laid-out fact: other folders are not listed and other columns are not read."""
    df = spark.read.parquet(path).filter(F.col("species") == species)
    return df.select(*columns) if columns else df
