"""The star: a tidy fact table, its dimension and the two side tables.

Canonical columns
  fact   species, season_year, season, portion, method, youth, is_subtotal, entity, class, cnt
  dim    entity, name, region, area, lon, lat
  attrs  species, season_year, portion, entity, attr_a, attr_b   (counts overlapping the classes)
  effort entity, season_year, fh, ah                             (hunter density, nullable)
``Star.of`` renames a caller's columns to these names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starslice.plans.spec import Calendar, SliceSpec
from starslice.runtime import settle, settle_all


@dataclass(frozen=True)
class Star:
    fact: DataFrame
    dim: DataFrame
    attrs: DataFrame | None = None
    effort: DataFrame | None = None
    written: tuple[str, ...] = ()  # parts that are scans of settled tables
    # declared by the caller: True if the dimension is a closed list (as counties are), so that a window may order a period;
    # otherwise ranks and order statistics use range partitions. No size is probed.
    small: bool = False
    # the list of periods where it is known without a scan (see sources.layout)
    calendar: Calendar | None = None
    # makes this star anew for the periods first..last: where the period is derived from another column (a date), only the source
    # can turn a range of periods into a filter that its scan understands
    reread: Callable[[int | None, int | None], Star] | None = None

    @staticmethod
    def of(fact: DataFrame, dim: DataFrame, names: dict[str, str] | None = None, **side) -> Star:
        """``names`` maps a canonical name to the caller's column name."""
        back = {theirs: ours for ours, theirs in (names or {}).items()}
        fix = lambda df: df if df is None else df.withColumnsRenamed(back)
        return Star(fix(fact), fix(dim), **{k: fix(v) for k, v in side.items()})

    def only(self, species: str) -> Star:
        """One species' dataset; partition pruning when the fact is stored by species."""
        attrs = self.attrs and self.attrs.filter(F.col("species") == species)
        again = self.reread and (lambda first, last: self.reread(first, last).only(species))
        return replace(self, fact=self.fact.filter(F.col("species") == species), attrs=attrs, reread=again)

    def during(self, first: int | None, last: int | None) -> Star:
        """The star of the periods from ``first`` to ``last`` (None: open), with the bound where the scan can use it."""
        if first is None and last is None:
            return self
        bound = SliceSpec(year_from=first, year_to=last).period_predicate()
        anew = self.reread(first, last) if self.reread is not None else self
        parts = {p: anew if p not in self.written else self for p in ("fact", "attrs", "effort") if getattr(self, p) is not None}
        return replace(self, **{p: getattr(of, p).filter(bound) for p, of in parts.items()})

    def slice(self, spec: SliceSpec) -> DataFrame:
        """The rows of a slice; its periods bound the scan."""
        return spec.apply(self.during(spec.year_from, spec.year_to).fact, self.dim)

    def settled(self, *parts: str) -> Star:
        """Write the named parts (fact and dim by default) once for plans that read them repeatedly."""
        parts = parts or ("fact", "dim")
        done = settle_all({p: getattr(self, p) for p in parts if getattr(self, p) is not None})
        return replace(self, **done, written=self.written + tuple(done))

    # -- one-row values, used as scalar subqueries ------------------------------------
    def partial_years(self) -> DataFrame:
        """Periods without autumn rows, provided autumn rows exist at all."""
        fall = F.col("season") == "fall"
        return partial_periods(self.fact.select("season_year", fall.alias("_fall"), (~fall).alias("_other")))

    def grid(self, years: Column, region: str = "") -> DataFrame:
        """entity x period, dense: every entity of the dimension for every period present."""
        dim = self.dim.filter(F.col("region") == region) if region else self.dim
        return dim.withColumn("_years", years).withColumn("season_year", F.explode("_years")).drop("_years")

    def measures(self, spec: SliceSpec, sums: dict[str, SliceSpec | Column], comparable: SliceSpec | None = None,
                 keep_seasons: bool = False, at: int | None = None, back: int = 0) -> DataFrame:
        """Dense entity x period frame with several conditional sums from one pass over the fact.

        The period range of ``spec`` is ignored, so trends can look back; its region restricts the
        entities. A value may be a slice or a ready predicate. ``comparable`` adds ``cmp``: like-for-like
        sums, spring only when some period is partial and the slice chose no season.

        The aggregate is written once unless the fact already is, because the list of periods, the
        partial-period test and the frame itself all read it. ``keep_seasons`` leaves the columns that
        ``partial_periods`` needs in the frame.

        ``at`` asks only for that period and the ``back`` periods of the list before it: the scan is bounded. If the list of periods isn't
        known, as many calendar years are read; should one of them be missing in the data, and with it the start of the list, all are.
        Like-for-like sums ask whether any period is partial, so without a known list they read all periods.
        """
        if at is not None and "fact" not in self.written:
            if self.calendar is not None:
                return self.during(self.calendar.back(at, back), at).measures(spec, sums, comparable, keep_seasons)
            if comparable is None:
                near = self.during(at - back, at)
                near = replace(near, fact=settle(near._sums(spec, sums), "measures"))
                if back == 0 or near.fact.select("season_year").distinct().count() == back + 1:
                    return near._dense(near.fact, spec, list(sums), keep_seasons)
        wanted = dict(sums)
        if comparable is not None:
            wanted |= {"_all": comparable, "_spring": comparable if comparable.season else comparable.patch(season="spring")}
        wide = self._sums(spec, wanted)
        if "fact" not in self.written:
            wide = settle(wide, "measures")
        df = self._dense(wide, spec, list(wanted), keep_seasons)
        if comparable is not None:
            partial = _any_partial(wide, "_fall", "_other") if self.calendar is None else F.lit(self.calendar.partial)
            df = df.withColumn("cmp", F.when(partial, F.col("_spring")).otherwise(F.col("_all"))).drop("_all", "_spring")
        return df

    def _sums(self, spec: SliceSpec, wanted: dict[str, SliceSpec | Column]) -> DataFrame:
        pred = lambda s: s.category_predicate() if isinstance(s, SliceSpec) else s
        fall = F.col("season") == "fall"
        return self.fact.groupBy("entity", "season_year").agg(
            *[F.sum(F.when(pred(s), F.col("cnt")).otherwise(0)).alias(k) for k, s in wanted.items()],
            F.bool_or(fall).alias("_fall"), F.bool_or(~fall).alias("_other"),
        )

    def _dense(self, wide: DataFrame, spec: SliceSpec, wanted: list[str], keep_seasons: bool) -> DataFrame:
        years = wide.agg(F.sort_array(F.collect_set("season_year"))).scalar()
        return self.grid(years, spec.region).join(
            wide if keep_seasons else wide.drop("_fall", "_other"), ["entity", "season_year"], "left"
        ).fillna(0, subset=wanted)

    def has_partial(self) -> Column:
        fall = F.col("season") == "fall"
        return _any_partial(self.fact.select("season_year", fall.alias("f"), (~fall).alias("o")), "f", "o")


def _per_period(rows: DataFrame, fall: str, other: str) -> DataFrame:
    return rows.groupBy("season_year").agg(F.bool_or(fall).alias("f"), F.bool_or(other).alias("o"))


def _any_partial(rows: DataFrame, fall: str, other: str) -> Column:
    """Scalar: both seasons occur, and some period has no autumn rows."""
    return _per_period(rows, fall, other).agg(F.bool_or("f") & F.bool_or("o") & ~F.bool_and("f")).scalar()


def partial_periods(rows: DataFrame, fall: str = "_fall", other: str = "_other") -> DataFrame:
    """Periods without autumn rows when both seasons occur; the few periods are compared inside one row."""
    packed = _per_period(rows, fall, other).filter("f IS NOT NULL").agg(
        F.collect_list(F.when(~F.col("f"), F.col("season_year"))).alias("y"), (F.bool_or("f") & F.bool_or("o")).alias("mixed")
    )
    return packed.filter("mixed").select(F.explode("y").alias("season_year"))
