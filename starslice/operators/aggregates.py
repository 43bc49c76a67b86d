"""Group sums over a filtered fact, breakdowns, places and period rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starslice.plans.spec import SliceSpec
from starslice.runtime import literal_rows
from starslice.sources.star import Star


def sum_by(rows: DataFrame, *keys: str, keep_zero: bool = False) -> DataFrame:
    """Sum the measure by any columns; groups that sum to zero are dropped unless kept."""
    out = rows.groupBy(*keys).agg(F.sum("cnt").alias("cnt"))
    return out if keep_zero else out.filter(F.col("cnt") != 0)


def dense_by_entity(star: Star, spec: SliceSpec) -> DataFrame:
    """Sum per entity over the slice; entities without rows are 0."""
    sums = sum_by(star.slice(spec), "entity", keep_zero=True)
    return star.dim.join(sums, "entity", "left").fillna(0, subset=["cnt"])


def total(rows: DataFrame) -> DataFrame:
    return rows.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("cnt"))


def entity_breakdown(star: Star, spec: SliceSpec, entity, year: int, by: str) -> DataFrame:
    """One entity's mix in one period; the region filter does not apply at this scope."""
    scoped = spec.patch(region="", year_from=year, year_to=year, entities=(entity,))
    return sum_by(star.slice(scoped), by)


def periods_in_range(star: Star, spec: SliceSpec) -> DataFrame:
    """Periods present inside the range; the last period when the range holds none."""
    y = F.col("season_year")
    seen = star.fact.agg(F.collect_set(F.when(spec.period_predicate(), y)).alias("inside"), F.max(y).alias("last"))
    kept = F.when(F.size("inside") > 0, F.col("inside")).otherwise(F.array("last"))
    return seen.filter("last IS NOT NULL").select(F.explode(kept).alias("season_year"))


def latest_period(effort: DataFrame, year_from: int, year_to: int, measure: str) -> DataFrame:
    """Latest published period in a range, and the latest one whose measure is filled."""
    y = F.col("season_year")
    return effort.agg(
        F.max(F.when(y.between(year_from, year_to), y)).alias("latest_in_range"),
        F.max(F.when((y <= year_to) & F.col(measure).isNotNull(), y)).alias("latest_with_measure"),
    )


def in_region(star: Star, region: str) -> DataFrame:
    """The fact with a flag instead of a filter, for rules that look at the whole dataset."""
    if not region:
        return star.fact.withColumn("_in", F.lit(True))
    members = star.dim.filter(F.col("region") == region).select("entity", F.lit(True).alias("_in"))
    return star.fact.join(members, "entity", "left").withColumn("_in", F.coalesce("_in", F.lit(False)))


def comparable_totals(star: Star, spec: SliceSpec) -> DataFrame:
    """Totals per period like for like: autumn is left out when some period lacks it and no season is chosen.

    One pass: both totals per period, then the choice inside a single row of all periods.
    """
    keep = spec.category_predicate() & F.col("_in")
    fall = F.col("season") == "fall"
    total = lambda c: F.sum(F.when(c, F.col("cnt")))
    per = in_region(star, spec.region).groupBy("season_year").agg(
        total(keep).alias("all"), total(keep & ~fall).alias("spring"), F.bool_or(fall).alias("f"), F.bool_or(~fall).alias("o")
    )
    packed = per.agg(
        F.collect_list(F.struct("season_year", "all", "spring")).alias("r"),
        (F.bool_or("f") & F.bool_or("o") & ~F.bool_and("f") & F.lit(not spec.season)).alias("like"),
    )
    rows = packed.select("like", F.inline("r"))
    return rows.select("season_year", F.when(F.col("like"), F.col("spring")).otherwise(F.col("all")).alias("cnt")).filter("cnt IS NOT NULL")


def places(star: Star, keys: list[str]) -> DataFrame:
    """Resolve place keys: an entity, or ``region:<name>``. One row per (place, member entity)."""
    wanted = literal_rows(star.dim.sparkSession, list(enumerate(keys)), "side int, place string")
    # an entity answers to its own key and to its region's, which makes this an equality join
    keyed = star.dim.withColumn("place", F.explode(F.array(F.col("entity").cast("string"), F.concat(F.lit("region:"), "region"))))
    return keyed.join(wanted, "place").select(
        "side", "place", F.col("place").startswith("region:").alias("is_region"), "entity", "name", "region", "area"
    )


def place_series(star: Star, spec: SliceSpec, keys: list[str]) -> DataFrame:
    """One total per place and period, dense over the periods present."""
    members = places(star, keys).select("place", "entity")
    dense = star.measures(spec.patch(region=""), {"cnt": spec.patch(region="")}).select("entity", "season_year", "cnt")
    return dense.join(members, "entity").groupBy("place", "season_year").agg(F.sum("cnt").alias("cnt"))


def conditional(rows: DataFrame, keys: list[str], **conds: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.sum(F.when(c, F.col("cnt")).otherwise(0)).alias(k) for k, c in conds.items()])
