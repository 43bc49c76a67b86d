"""The metric registry: every derived metric for every entity and period in one pass.

A metric names the conditional sums it needs (as patched slices) and a column over them;
``metric_frame`` merges the needs of all requested metrics into a single aggregation.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starslice.operators import series as S
from starslice.plans.spec import SliceSpec
from starslice.runtime import ratio
from starslice.sources.star import Star


@dataclass(frozen=True)
class Roles:
    """Which classes and portions play the parts that the ratio metrics talk about."""

    buck: tuple[str, ...]
    button: tuple[str, ...]
    doe: tuple[str, ...]
    archery: tuple[str, ...]
    opening: tuple[str, ...]
    main: tuple[str, ...]
    attr_fixed: tuple[str, ...]


# The vocabulary of the wildlife harvest tables.
HARVEST_ROLES = Roles(
    buck=("antlered_buck",), button=("button_buck",), doe=("doe",), archery=("archery",),
    opening=("opening_weekend",), main=("november",), attr_fixed=("fall_archery",),
)
ORDER_ROLES = Roles(
    buck=("A",), button=("R",), doe=("N",), archery=("fall_archery", "spring_archery"),
    opening=("fall_opening", "spring_opening"), main=("fall_main", "spring_main"), attr_fixed=("fall_archery",),
)


@dataclass(frozen=True)
class MetricDef:
    id: str
    label: str
    fmt: str
    diverging: bool = False
    kinds: tuple[str, ...] = ("deer", "turkey")
    sums: Callable[[SliceSpec, Roles], dict[str, SliceSpec]] = field(default=lambda spec, roles: {"base": spec})
    value: Callable[[], Column] | None = None
    comparable: bool = False
    effort: bool = False
    look_back: int = 0  # periods of the list before the one asked for that the value reads


def _pair(name: str, num: dict, den: dict):
    """Two patched slices ``<name>_num`` and ``<name>_den``; a patch value may be a role name."""

    def fill(patch: dict, roles: Roles) -> dict:
        return {k: getattr(roles, v[1:]) if isinstance(v, str) and v.startswith("@") else v for k, v in patch.items()}

    return lambda spec, roles: {
        f"{name}_num": spec.patch(**fill(num, roles)), f"{name}_den": spec.patch(**fill(den, roles))
    }


def _share(name: str) -> Callable[[], Column]:
    return lambda: ratio(f"{name}_num", f"{name}_den")


_HUNTERS = lambda: F.col("fh") + F.col("ah")  # noqa: E731  NULL when either side is missing

METRICS: dict[str, MetricDef] = {
    m.id: m
    for m in [
        MetricDef("count", "Harvest", "int", value=lambda: F.col("base").cast("double")),
        MetricDef("per_sqmi", "Harvest per area", "dec2", value=lambda: ratio("base", "area")),
        MetricDef("change_yoy", "Change on last season", "signed_pct", True, comparable=True, look_back=1,
                  value=lambda: S.change("cmp", S.previous_calendar("cmp"))),
        MetricDef("vs_5yr", "Against the 5-season mean", "signed_pct", True, comparable=True, look_back=5,
                  value=lambda: S.change("cmp", S.trailing_average("cmp"))),
        MetricDef("zscore", "Density z-score", "z", True),
        MetricDef("buck_doe", "Bucks per doe", "dec2", kinds=("deer",),
                  sums=_pair("bd", {"classes": "@buck"}, {"classes": "@doe"}), value=_share("bd")),
        MetricDef("button_share", "Button buck share", "pct", kinds=("deer",),
                  sums=_pair("bs", {"classes": "@button"}, {"classes": ()}), value=_share("bs")),
        MetricDef("archery_share", "Archery share", "pct", kinds=("deer",),
                  sums=_pair("as", {"portions": "@archery"}, {"portions": (), "method": ""}), value=_share("as")),
        MetricDef("youth_share", "Youth share", "pct", kinds=("deer",),
                  sums=_pair("ys", {"portions": (), "youth": True, "method": ""},
                             {"portions": (), "youth": None, "method": "firearm"}), value=_share("ys")),
        MetricDef("opening_share", "Opening share", "pct", kinds=("deer",),
                  sums=_pair("os", {"portions": "@opening"}, {"portions": "@main"}), value=_share("os")),
        MetricDef("hunters_per_sqmi", "Hunters per area", "dec1", kinds=("deer",), effort=True, value=_HUNTERS),
        MetricDef("firearms_hunters_per_sqmi", "Firearms hunters per area", "dec1", kinds=("deer",), effort=True,
                  value=lambda: F.col("fh")),
        MetricDef("archery_hunters_per_sqmi", "Archery hunters per area", "dec1", kinds=("deer",), effort=True,
                  value=lambda: F.col("ah")),
        MetricDef("deer_per_hunter", "Harvest per hunter", "dec2", kinds=("deer",), effort=True,
                  value=lambda: ratio("base", _HUNTERS() * F.col("area"))),
        MetricDef("trips_per_kill", "Trips per kill", "dec1", kinds=("deer",), effort=True, value=lambda: F.col("trips")),
        MetricDef("public_land_share", "Public land share", "pct", kinds=("turkey",)),
        MetricDef("crossbow_share", "Crossbow share", "pct", kinds=("turkey",)),
    ]
}


def applicable(metric: str, kind: str, fallback: str = "count") -> str:
    """The metric itself where it applies to this kind of species, else the fallback."""
    known = METRICS.get(metric)
    return metric if known and kind in known.kinds else fallback


def metric_frame(star: Star, spec: SliceSpec, metrics: list[str], roles: Roles = ORDER_ROLES, at: int | None = None, back: int = 0) -> DataFrame:
    """entity, name, region, area, season_year, base and one column per metric, for all periods.

    With ``at``, only that period and the ``back`` ones before it are asked for: the scan is bounded by what the metrics of these periods
    read, and rows of earlier periods may be there or not.
    """
    sums: dict = {"base": spec}
    for m in metrics:
        sums.update(METRICS[m].sums(spec, roles))
    like_for_like = any(METRICS[m].comparable for m in metrics)
    reach = back + max((METRICS[m].look_back for m in metrics), default=0)
    df = star.measures(spec, sums, comparable=spec if like_for_like else None, at=at, back=reach)
    if any(METRICS[m].effort for m in metrics):
        df = df.join(_with_trips(star.effort), ["entity", "season_year"], "left")
    if "zscore" in metrics:
        df = with_zscore(df)
    for m, key, fixed in (("public_land_share", "attr_a", ()), ("crossbow_share", "attr_b", roles.attr_fixed)):
        if m in metrics:
            parts = attribute_parts(star, spec, key, fixed).withColumnRenamed("num", f"_{m}_n").withColumnRenamed("den", f"_{m}_d")
            df = df.join(parts, ["entity", "season_year"], "left").withColumn(m, ratio(F.coalesce(f"_{m}_n", F.lit(0)), f"_{m}_d"))
    ready = {m: METRICS[m].value() for m in metrics if METRICS[m].value is not None}
    return df.withColumns(ready).select(
        "entity", "name", "region", "area", "season_year", "base", *metrics
    )


def _with_trips(effort: DataFrame) -> DataFrame:
    """Published trips per kill where the source carries it; otherwise undefined."""
    return effort if "trips" in effort.columns else effort.withColumn("trips", F.lit(None).cast("double"))


def with_zscore(df: DataFrame, name: str = "zscore") -> DataFrame:
    """Population z-score of the density over entities with a positive count, per period."""
    dens = F.when(F.col("base") > 0, ratio("base", "area"))
    stats = df.groupBy("season_year").agg(F.avg(dens).alias("_m"), F.stddev_pop(dens).alias("_sd"))
    return (
        df.join(stats, "season_year")
        .withColumn(name, F.when(F.col("_sd") > 0, (dens - F.col("_m")) / F.col("_sd")))
        .drop("_m", "_sd")
    )


def attribute_parts(star: Star, spec: SliceSpec, key: str, fixed: tuple[str, ...] = ()) -> DataFrame:
    """Numerator and denominator per entity and period over portions that report attributes at all.

    The denominator counts every entity in such a portion, so an entity without an
    attribute row reads as zero rather than as undefined.
    """
    allowed = fixed or spec.portions
    if allowed:
        attrs = star.attrs.filter(F.col("portion").isin(*allowed))
    else:
        base = star.fact.filter(~F.col("is_subtotal")).select("portion").distinct()
        attrs = star.attrs.join(base, "portion", "left_semi")
    reported = attrs.select("season_year", "portion").distinct()
    chosen = spec.patch(classes=(), portions=())
    rows = star.fact.filter(chosen.category_predicate() if not allowed else _portion_free(chosen))
    den = (
        rows.groupBy("entity", "season_year", "portion").agg(F.sum("cnt").alias("d"))
        .join(reported, ["season_year", "portion"], "left_semi")
        .groupBy("entity", "season_year").agg(F.sum("d").alias("den"))
    )
    num = attrs.groupBy("entity", "season_year").agg(F.sum(key).alias("num"))
    return den.join(num, ["entity", "season_year"], "left")


def _portion_free(spec: SliceSpec) -> Column:
    """Season, method and youth only: the caller restricts the portions by a semi-join."""
    cond = F.lit(True)
    if spec.season:
        cond &= F.col("season") == spec.season
    if spec.method:
        cond &= F.col("method") == spec.method
    if spec.youth is not None:
        cond &= F.col("youth") == F.lit(spec.youth)
    return cond


def attribute_cells(star: Star, spec: SliceSpec, key: str) -> DataFrame:
    """Cell-exact parts: only (period, portion, entity) cells that have an attribute row count."""
    cells = (
        spec.patch(classes=()).all_years().apply(star.fact)
        .groupBy("season_year", "portion", "entity").agg(F.sum("cnt").alias("d"))
    )
    attrs = star.attrs.select("season_year", "portion", "entity", F.col(key).alias("a"))
    base = star.fact.filter(~F.col("is_subtotal")).select("portion").distinct()
    attrs = attrs.filter(F.col("portion").isin(*spec.portions)) if spec.portions else attrs.join(base, "portion", "left_semi")
    return attrs.join(cells, ["season_year", "portion", "entity"], "left").withColumn("d", F.coalesce("d", F.lit(0)))


def attribute_share_exact(star: Star, spec: SliceSpec, key: str = "attr_a") -> DataFrame:
    """Cell-exact share per entity and period; NULL when nothing was reported."""
    parts = attribute_cells(star, spec, key).groupBy("entity", "season_year").agg(
        F.sum("a").alias("num"), F.sum("d").alias("den")
    )
    return parts.withColumn("share", ratio("num", "den"))


def estimated_people(density: Column, area: str = "area") -> Column:
    """Head count from a density, rounded to hundreds (half up)."""
    return F.round(density * F.col(area), -2)
