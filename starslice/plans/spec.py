"""The slice specification: one declarative filter compiled to a Catalyst predicate."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SliceSpec:
    """AND across fields, OR inside a list; an empty field means "all"."""

    species: str = ""
    year_from: int | None = None
    year_to: int | None = None
    season: str = ""
    portions: tuple[str, ...] = ()
    method: str = ""
    youth: bool | None = None
    classes: tuple[str, ...] = ()
    region: str = ""
    entities: tuple = ()

    def patch(self, **fields) -> SliceSpec:
        """Metrics replace fields of the slice; they do not AND another condition."""
        return replace(self, **fields)

    def all_years(self) -> SliceSpec:
        return replace(self, year_from=None, year_to=None)

    # -- predicates -----------------------------------------------------------------
    def category_predicate(self) -> Column:
        """Everything except species, period, region and entity."""
        cond = F.col("portion").isin(*self.portions) if self.portions else ~F.col("is_subtotal")
        if self.classes:
            cond &= F.col("class").isin(*self.classes)
        if self.season:
            cond &= F.col("season") == self.season
        if self.method:
            cond &= F.col("method") == self.method
        if self.youth is not None:
            cond &= F.col("youth") == F.lit(self.youth)
        return cond

    def period_predicate(self) -> Column:
        cond = F.lit(True)
        if self.year_from is not None:
            cond &= F.col("season_year") >= self.year_from
        if self.year_to is not None:
            cond &= F.col("season_year") <= self.year_to
        return cond

    def predicate(self) -> Column:
        cond = self.category_predicate() & self.period_predicate()
        if self.species:
            cond &= F.col("species") == self.species
        return cond

    def apply(self, fact: DataFrame, dim: DataFrame | None = None) -> DataFrame:
        """Filter ``fact``; a region goes through the dimension as a semi-join."""
        out = fact.filter(self.predicate())
        if self.entities:
            out = out.filter(F.col("entity").isin(*self.entities))
        if self.region:
            if dim is None:
                raise ValueError("a region filter needs the dimension")
            members = dim.filter(F.col("region") == self.region).select("entity")
            out = out.join(members, "entity", "left_semi")
        return out


@dataclass(frozen=True)
class Calendar:
    """The periods of a dataset and the seasons of each, ascending: known without reading rows, from a layout's folders or a declaration."""

    periods: tuple[tuple[int, tuple[str, ...]], ...]

    def back(self, at: int, n: int) -> int:
        """The n-th period before ``at`` in the list, or the first one."""
        before = [y for y, _ in self.periods if y < at]
        return at if n == 0 or not before else before[max(0, len(before) - n)]

    @property
    def partial(self) -> bool:
        """Some period has no autumn rows although both seasons occur."""
        fall = ["fall" in s for _, s in self.periods]
        other = any(set(s) - {"fall"} for _, s in self.periods)
        return any(fall) and other and not all(fall)


def clamp(value: Column, lo, hi) -> Column:
    return F.greatest(F.least(value, F.lit(hi)), F.lit(lo))
