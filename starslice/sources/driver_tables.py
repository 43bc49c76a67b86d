"""Adapter: expresses the generic order tables as a harvest-style star.

entity = nation, region = region, period = order year, portion = season + kind derived from
the order date and priority, class = return flag, species = line status. Every function is lazy.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starslice.runtime import settle_all
from starslice.sources.sinks import typed
from starslice.sources.star import Star

KINDS = {"1-URGENT": "main", "2-HIGH": "archery", "3-MEDIUM": "youth", "4-NOT SPECIFIED": "managed"}
METHODS = {"archery": "archery", "managed": "mixed", "total": "mixed"}


_schemas: dict[tuple[str, str], T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of one table; its schema is read from the footers once per application."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _schemas:
        _schemas[key] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[key]).parquet(path)


def _lookup(key, mapping: dict[str, str], default: str):
    out = F.lit(default)
    for k, v in mapping.items():
        out = F.when(key == k, v).otherwise(out)
    return out


Years = tuple[int | None, int | None]  # first and last period, None: open
ALL: Years = (None, None)


def orders_by_entity(spark, sf_dir, years: Years = ALL) -> DataFrame:
    """Orders with their star keys. The period is derived from the date, so a range of periods is a half-open range of dates at the scan."""
    orders = table(spark, sf_dir, "orders")
    first, last = years
    if first is not None:
        orders = orders.filter(F.col("o_orderdate") >= F.lit(date(first, 1, 1)))
    if last is not None:
        orders = orders.filter(F.col("o_orderdate") < F.lit(date(last + 1, 1, 1)))
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("entity"))
    when = F.col("o_orderdate")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            "o_orderkey", "o_custkey", "entity",
            F.year(when).alias("season_year"),
            F.when(F.month(when) >= 9, "fall").otherwise("spring").alias("season"),
            _lookup(F.col("o_orderpriority"), KINDS, "late").alias("kind"),
            (F.dayofmonth(when) <= 7).alias("opening"),
        )
    )


def lines(spark, sf_dir, years: Years = ALL) -> DataFrame:
    """One row per order line with its star keys."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_linestatus").alias("species"), F.col("l_returnflag").alias("class"),
        F.col("l_quantity").cast("long").alias("qty"), "l_discount", "l_tax",
    )
    return li.join(orders_by_entity(spark, sf_dir, years), F.col("l_orderkey") == F.col("o_orderkey"))


def cells(spark, sf_dir, species: str = "", entity: str = "entity", years: Years = ALL) -> DataFrame:
    """The lines aggregated to base cells with the plain and the two attribute quantities: one pass over the lines."""
    qty = F.col("qty")
    rows = lines(spark, sf_dir, years)
    rows = rows.filter(F.col("species") == species) if species else rows
    return rows.groupBy("species", "season_year", "season", "kind", "opening", F.col(entity).alias("entity"), "class").agg(
        F.sum("qty").alias("qty"),
        F.sum(F.when(F.col("l_discount") > 0.05, qty).otherwise(0)).alias("qty_a"),
        F.sum(F.when(F.col("l_tax") < 0.02, qty).otherwise(0)).alias("qty_b"),
    )


def fact(spark, sf_dir, base: DataFrame | None = None, years: Years = ALL) -> DataFrame:
    """Base cells plus the two overlapping subtotal portions; columns that are not read are pruned from the scan."""
    kinds = F.filter(
        F.array(
            F.struct(F.col("kind"), F.lit(False).alias("is_subtotal")),
            F.struct(F.when((F.col("kind") == "main") & F.col("opening"), "opening").alias("kind"), F.lit(True).alias("is_subtotal")),
            F.struct(F.lit("total").alias("kind"), F.lit(True).alias("is_subtotal")),
        ),
        lambda k: k["kind"].isNotNull(),
    )
    return (
        (cells(spark, sf_dir, years=years) if base is None else base).withColumn("k", F.explode(kinds))
        .groupBy("species", "season_year", "season", F.col("k.kind").alias("kind"), F.col("k.is_subtotal").alias("is_subtotal"), "entity", "class")
        .agg(F.sum("qty").alias("cnt"))
        .select(
            "species", "season_year", "season",
            F.concat_ws("_", "season", "kind").alias("portion"),
            _lookup(F.col("kind"), METHODS, "firearm").alias("method"),
            (F.col("kind") == "youth").alias("youth"),
            "is_subtotal", "entity", "class", "cnt",
        )
    )


def published_rows(rows: DataFrame) -> DataFrame:
    """The fact with the columns of a published one: state, labels, sources, and which portions are derived."""
    return typed(rows.withColumns({
        "state": F.lit("OR"), "portion_label": F.initcap(F.replace("portion", F.lit("_"), F.lit(" "))), "derived": F.col("portion").endswith("_managed"),
        "source_url": F.concat(F.lit("orders/"), F.col("season_year").cast("string"), F.lit("/"), F.col("species")),
    }))


def dim(spark, sf_dir) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    area = (
        table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("entity"))
        .agg(F.count("*").alias("area"))
    )
    return (
        nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("n_nationkey").alias("entity"), F.col("n_name").alias("name"), F.col("r_name").alias("region"),
            (F.col("n_nationkey") % 5).cast("double").alias("lon"),
            F.floor(F.col("n_nationkey") / 5).cast("double").alias("lat"),
        )
        .join(area, "entity", "left")
        .select("entity", "name", "region", F.coalesce("area", F.lit(0)).cast("double").alias("area"), "lon", "lat")
    )


def attributes(spark, sf_dir, base: DataFrame | None = None, years: Years = ALL) -> DataFrame:
    reported = (F.col("season_year") >= 1999) | (
        (F.col("season_year") == 1998) & (F.col("season") == "fall") & (F.col("kind") == "archery")
    )
    return (
        (cells(spark, sf_dir, years=years) if base is None else base)
        .filter(reported & (F.col("entity") % 7 != 3))
        .groupBy("species", "season_year", "season", "kind", "entity")
        .agg(F.sum("qty_a").alias("attr_a"), F.sum("qty_b").alias("attr_b"))
        .select("species", "season_year", F.concat_ws("_", "season", "kind").alias("portion"), "entity", "attr_a", "attr_b")
    )


def effort(spark, sf_dir, years: Years = ALL) -> DataFrame:
    """Distinct customers by method per entity and period, as a density; NULL before publication.

    Distinct people are counted by grouping on the person first, so one hot entity is
    spread over its people before the final count.
    """
    kind, year = F.col("kind"), F.col("season_year")
    people = (
        orders_by_entity(spark, sf_dir, years).filter(F.col("entity") != 24)
        .groupBy("entity", "season_year", "o_custkey")
        .agg(F.max(kind.isin("main", "youth", "late")).cast("long").alias("f"), F.max(kind == "archery").cast("long").alias("a"))
    )
    hunters = people.groupBy("entity", "season_year").agg(F.sum("f").alias("f"), F.sum("a").alias("a"))
    area = dim(spark, sf_dir).select("entity", "area")
    return hunters.join(area, "entity").select(
        "entity", "season_year",
        F.when(year >= 1997, F.col("f") / F.col("area")).alias("fh"),
        F.when(year >= 1998, F.col("a") / F.col("area")).alias("ah"),
    )


def samples(spark, sf_dir) -> DataFrame:
    """Detail sample rows: entity, day, result and split key."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        (F.col("user_id") % 25).alias("entity"), F.to_date("ts").alias("period"), F.col("event_type").alias("split"),
        (F.col("event_type") == "error").cast("long").alias("positive"), F.col("event_id").alias("sample_id"), "ts",
    )


def star(spark, sf_dir, species: str = "O", side: tuple[str, ...] = (), years: Years = ALL) -> Star:
    """The lazy star of one species (all species for ""), with the side tables that are asked for."""
    make = {"attrs": attributes, "effort": effort}
    sides = {k: make[k](spark, sf_dir, years=years) for k in side}
    again = lambda first, last: star(spark, sf_dir, "", side, (first, last))
    full = Star(fact(spark, sf_dir, years=years), dim(spark, sf_dir), small=True, reread=again, **sides)  # nations: a closed list
    return full.only(species) if species else full


def settled(spark, sf_dir, *parts: str, species: str = "O") -> Star:
    """The star with its named parts written once (fact and dim by default).

    Fact and attributes share one written cell table, so the lines are scanned a single time.
    """
    parts = parts or ("fact", "dim")
    if "attrs" not in parts:
        return star(spark, sf_dir, species, tuple({"effort"} & set(parts))).settled(*parts)
    first = {"cells": cells(spark, sf_dir, species)}
    first |= {p: f(spark, sf_dir) for p, f in (("dim", dim), ("effort", effort)) if p in parts}
    done = settle_all(first)
    base = done.pop("cells")
    if "fact" in parts:
        done |= settle_all({"fact": fact(spark, sf_dir, base)})
    return Star(
        done.get("fact", fact(spark, sf_dir, base)), done.get("dim", dim(spark, sf_dir)), attributes(spark, sf_dir, base),
        done.get("effort"), written=("fact", *done), small=True,  # the fact is at most one small aggregate away from the written cells
    )
