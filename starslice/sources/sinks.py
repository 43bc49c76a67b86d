"""Sinks: the fact's schema, the pivoted form and its documents, row-array JSON, other documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starslice.operators.quality import GateClosed, dependency_violations
from starslice.runtime import settle

# the published columns; an entity keeps its own type, and sums of a region or of many periods don't fit into 32 bits
FACT_SCHEMA = T.StructType([
    T.StructField("state", T.StringType()), T.StructField("species", T.StringType()), T.StructField("season_year", T.ShortType()),
    T.StructField("season", T.StringType()), T.StructField("portion", T.StringType()), T.StructField("portion_label", T.StringType()),
    T.StructField("method", T.StringType()), T.StructField("youth", T.BooleanType()), T.StructField("is_subtotal", T.BooleanType()),
    T.StructField("derived", T.BooleanType()), T.StructField("entity", T.StringType()), T.StructField("class", T.StringType()),
    T.StructField("cnt", T.LongType()), T.StructField("source_url", T.StringType()),
])
ATTRIBUTES = ("season", "method", "youth", "is_subtotal")  # of a portion
LABELS = ("portion_label", "source_url", "derived")  # of a portion in a period
SERIES = ("species", "season_year", "portion", "class")


def typed(df: DataFrame, schema: T.StructType = FACT_SCHEMA) -> DataFrame:
    """``df`` with the columns of ``schema``, cast. The entity keeps its type; a column that ``df`` lacks is null, ``derived`` false."""

    def column(f: T.StructField) -> Column:
        if f.name not in df.columns:
            return F.lit(False if f.name == "derived" else None).cast(f.dataType).alias(f.name)
        return F.col(f.name) if f.name == "entity" else F.col(f.name).cast(f.dataType).alias(f.name)

    return df.select(*[column(f) for f in schema.fields])


# -- the pivoted form ---------------------------------------------------------------------------------
def entity_pieces(fact: DataFrame, size: int) -> DataFrame:
    """(species, entity, piece, pos): the entities of each species in ascending order, cut into ranges of about ``size``; written once."""
    found = settle(fact.select("species", "entity").distinct(), "entities")
    pieces = max(1, -(-found.count() // size))
    ranged = found.repartitionByRange(pieces, "species", "entity").sortWithinPartitions("species", "entity")
    # a partition is a range of entities, numbered in order
    numbered = ranged.select("species", "entity", F.monotonically_increasing_id().alias("n")).withColumn("piece", F.shiftright("n", 33).cast("int"))
    numbered = settle(numbered, "pieces")
    first = numbered.groupBy("species", "piece").agg(F.min("n").alias("first"))
    return numbered.join(first, ["species", "piece"]).select("species", "entity", "piece", (F.col("n") - F.col("first")).cast("int").alias("pos"))


def pivot_series(fact: DataFrame, size: int = 1000) -> DataFrame:
    """One dense array of counts per series and piece: (state, species, season_year, portion, class, piece, entities, counts, labels...).

    ``entities`` are those of the species' piece in ascending order, ``counts`` theirs: repeated cells add up and zeros are explicit. An array is as long
    as a piece, about ``size``, whatever the dimension is; a dimension of up to ``size`` entities is one piece. A piece lists the series that have
    rows in it. A portion's label, source and ``derived`` in a period are those of its first row, by the order of these columns.
    """
    pieces = settle(entity_pieces(fact, size), "numbered")
    of_piece = pieces.groupBy("species", "piece").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "entity"))), lambda e: e["entity"]).alias("entities"))
    sums = fact.groupBy(*SERIES, "entity").agg(F.sum("cnt").alias("cnt"), F.min(F.struct("state", *LABELS)).alias("label"))
    cells = sums.join(pieces, ["species", "entity"]).groupBy(*SERIES, "piece").agg(
        F.map_from_entries(F.collect_list(F.struct("pos", "cnt"))).alias("m")
    )
    labels = sums.groupBy("species", "season_year", "portion").agg(F.min("label").alias("label"))
    dense = F.transform("entities", lambda _, pos: F.coalesce(F.col("m")[pos], F.lit(0)))
    named = cells.join(of_piece, ["species", "piece"]).join(labels, ["species", "season_year", "portion"])
    return named.select(F.col("label.state").alias("state"), *SERIES, "piece", "entities", dense.alias("counts"), *[f"label.{c}" for c in LABELS])


def portion_attributes(fact: DataFrame) -> DataFrame:
    """One struct of attributes per portion (a portion determines them)."""
    return fact.groupBy("species", "portion").agg(F.first(F.struct(*ATTRIBUTES)).alias("attr"))


def unpivot_series(series: DataFrame, portions: DataFrame) -> DataFrame:
    """Decode the arrays to long rows; zeros are dropped and portion attributes attached."""
    long = series.select("state", *SERIES, *LABELS, F.inline(F.arrays_zip(F.col("entities").alias("entity"), F.col("counts").alias("cnt")))).filter(F.col("cnt") != 0)
    return long.join(portions, ["species", "portion"]).select("state", *SERIES, "entity", "cnt", "attr.*", *LABELS)


def _json_row(*columns: Column) -> Column:
    """A JSON array of values of different types."""
    # arrays hold one type, so each value is written alone
    parts = [F.regexp_replace(F.to_json(F.array(c), {"ignoreNullFields": "false"}), r"(?s)^\[(.*)\]$", "$1") for c in columns]
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def series_documents(fact: DataFrame, size: int = 1000) -> DataFrame:
    """(species, piece, value): the published documents, one JSON text per species and piece of entities.

    A document has state, species, counties, classes, portions, series (rows of [period, portion, class, counts], ordered) and labels (by
    "species:period:portion"). Its size is bounded by the piece and the closed vocabularies of periods, portions and classes. A
    portion with several sets of attributes is an error.
    """
    broken = dependency_violations(fact.select(F.struct("species", "portion").alias("key"), *ATTRIBUTES), "key", list(ATTRIBUTES)).limit(1).collect()
    if broken:
        raise GateClosed(f"portion with inconsistent attributes: {broken[0]['key']}")
    series = settle(pivot_series(fact, size), "series")
    text = F.struct(*[F.col(c) for c in ("season_year", "portion", "class")], _json_row(F.col("season_year"), F.col("portion"), F.col("class"), F.col("counts")).alias("t"))
    key = F.concat_ws(":", "species", F.col("season_year").cast("string"), "portion")
    docs = series.groupBy("species", "piece").agg(
        F.min("state").alias("state"), F.first(F.transform("entities", lambda e: e.cast("string"))).alias("counties"),
        F.transform(F.sort_array(F.collect_list(text)), lambda r: r["t"]).alias("rows"),
        F.map_from_entries(F.sort_array(F.collect_set(F.struct(key.alias("key"), F.struct(*LABELS).alias("label"))))).alias("labels"),
    )
    whole = series.groupBy("species").agg(F.sort_array(F.collect_set("class")).alias("classes"))
    attrs = portion_attributes(fact).groupBy("species").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("portion", "attr")))).alias("portions"))
    made = docs.join(whole, "species").join(attrs, "species")
    field = lambda name, c: F.concat(F.lit(f'"{name}":'), c)
    plain = lambda c: F.regexp_replace(F.to_json(F.struct(F.col(c)), {"ignoreNullFields": "false"}), r"(?s)^\{(.*)\}$", "$1")
    value = F.concat(F.lit("{"), F.concat_ws(
        ",", *[plain(c) for c in ("state", "species", "counties", "classes", "portions")],
        field("series", F.concat(F.lit("["), F.concat_ws(",", "rows"), F.lit("]"))), plain("labels")), F.lit("}"))
    return made.select("species", "piece", value.alias("value"))


def write_series(fact: DataFrame, path: str, size: int = 1000) -> None:
    """The published documents as text files in a folder per species and piece."""
    series_documents(fact, size).write.mode("overwrite").partitionBy("species", "piece").text(path)


# -- row arrays -----------------------------------------------------------------------------------------
def row_arrays(df: DataFrame, columns: list[str]) -> DataFrame:
    """Row-array JSON lines: each row an array of values in ``columns`` order."""
    return df.select(_json_row(*[F.col(c) for c in columns]).alias("value"))


def row_array_documents(df: DataFrame, columns: list[str], order: list[str], state: str, size: int = 10_000) -> DataFrame:
    """(piece, value): documents of state, columns and rows; a document holds a range of about ``size`` rows in ``order``."""
    rows = settle(df.select(*dict.fromkeys([*order, *columns])), "rows")
    pieces = max(1, -(-rows.count() // size))
    ranged = rows.repartitionByRange(pieces, *order).withColumn("piece", F.spark_partition_id())
    keyed = F.struct(*[F.col(c) for c in order], _json_row(*[F.col(c) for c in columns]).alias("t"))
    docs = ranged.groupBy("piece").agg(F.transform(F.sort_array(F.collect_list(keyed)), lambda r: r["t"]).alias("rows"))
    head = F.regexp_replace(F.to_json(F.struct(F.lit(state).alias("state"), F.array(*[F.lit(c) for c in columns]).alias("columns"))), r"\}$", "")
    return docs.select("piece", F.concat(head, F.lit(',"rows":['), F.concat_ws(",", "rows"), F.lit("]}")).alias("value"))


def documents(df: DataFrame, *columns: str | Column) -> DataFrame:
    """One JSON document per row, ready for ``write.text``; ordering is left to the caller."""
    return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"))


def write_lines(df: DataFrame, path: str, *order: str) -> None:
    """JSON lines in a deterministic order (a range-partitioned sort, not one task)."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_envelope(df: DataFrame, path: str, field: str, order: list[str], size: int = 10_000, **header: str) -> None:
    """JSON documents with a header and a sorted row list, one for each range of about ``size`` rows, in a folder of its own."""
    rows = settle(df, "rows")
    pieces = max(1, -(-rows.count() // size))
    ranged = rows.repartitionByRange(pieces, *order).withColumn("piece", F.spark_partition_id())
    keyed = F.struct(*order, *[c for c in df.columns if c not in order])
    docs = ranged.groupBy("piece").agg(F.sort_array(F.collect_list(keyed)).alias(field))
    head = [F.lit(v).alias(k) for k, v in header.items()]
    text = F.to_json(F.struct(*head, F.col(field)), {"ignoreNullFields": "false"})
    docs.select("piece", text.alias("value")).write.mode("overwrite").partitionBy("piece").text(path)


def geojson_features(vertices: DataFrame, properties: DataFrame, geom: str = "geom") -> DataFrame:
    """One GeoJSON feature text per polygon geometry; rings are assembled per geometry."""
    point = F.array("x", "y")
    rings = vertices.groupBy(geom, "part", "ring").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("seq", point.alias("p")))), lambda v: v["p"]).alias("r")
    )
    parts = rings.groupBy(geom, "part").agg(F.transform(F.sort_array(F.collect_list(F.struct("ring", "r"))), lambda v: v["r"]).alias("p"))
    shapes = parts.groupBy(geom).agg(F.transform(F.sort_array(F.collect_list(F.struct("part", "p"))), lambda v: v["p"]).alias("c"))
    single = F.size("c") == 1
    shape = F.when(single, F.to_json(F.struct(F.lit("Polygon").alias("type"), F.col("c")[0].alias("coordinates")))).otherwise(
        F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.col("c").alias("coordinates")))
    )
    props = properties.select(geom, F.to_json(F.struct(*[c for c in properties.columns if c != geom])).alias("_props"))
    return shapes.join(props, geom).select(
        F.concat(F.lit('{"type":"Feature","properties":'), "_props", F.lit(',"geometry":'), shape, F.lit("}")).alias("value")
    )
