"""Series operators on a dense entity x period frame.

Every window here is partitioned by the entity, so a partition is as long as the list of
periods; comparisons across entities use grouped aggregates joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starslice.operators.ranking import argmax, competition_rank
from starslice.runtime import ratio

PERIOD = "season_year"


def line(key: str = "entity"):
    return W.partitionBy(key).orderBy(PERIOD)


def previous_calendar(value: str, key: str = "entity") -> Column:
    """Value of the calendar period just before, NULL when that period is absent."""
    w = line(key)
    return F.when(F.lag(PERIOD).over(w) == F.col(PERIOD) - 1, F.lag(value).over(w))


def change(cur: str | Column, prev: str | Column) -> Column:
    return ratio(cur, prev) - 1


def trailing_average(value: str, back: int = 5, key: str = "entity") -> Column:
    """Mean of up to ``back`` earlier periods, the current one excluded; NULL in the first."""
    return F.avg(value).over(line(key).rowsBetween(-back, -1))


def trailing_count(value: str, back: int = 5, key: str = "entity") -> Column:
    return F.count(value).over(line(key).rowsBetween(-back, -1))


def index_100(value: str, key: str = "entity") -> Column:
    """Index with the first positive value = 100."""
    whole = line(key).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first = F.first(F.when(F.col(value) > 0, F.col(value)), ignorenulls=True).over(whole)
    return ratio(value, first) * 100


def sparkline(value: str, length: int = 6, key: str = "entity") -> Column:
    return F.collect_list(value).over(line(key).rowsBetween(-(length - 1), 0))


def share(df: DataFrame, value: str, name: str = "share", by: tuple[str, ...] = (PERIOD,)) -> DataFrame:
    """Value over the total of its group, from a grouped sum joined back."""
    totals = df.groupBy(*by).agg(F.sum(value).alias("_total"))
    return df.join(totals, list(by)).withColumn(name, ratio(value, "_total")).drop("_total")


def with_rank_delta(df: DataFrame, value: str, positive_only: bool, bounded: bool) -> DataFrame:
    """Rank per period and its change since the previous calendar period."""
    ranked = competition_rank(df, [PERIOD], value, positive_only, bounded)
    prev = previous_calendar("rank")
    return ranked.withColumn("delta", (prev - F.col("rank")).cast("int"))


def top_n_streaks(ranked: DataFrame, last: int | Column, n: int = 10) -> DataFrame:
    """Length of each entity's current run inside the top ``n``, ending at period ``last``."""
    inside = F.coalesce(F.col("rank") <= n, F.lit(False))
    runs = ranked.filter(F.col(PERIOD) <= last).groupBy("entity").agg(
        F.max(F.when(~inside, F.col(PERIOD))).alias("_miss"),
        F.collect_set(F.when(inside, F.col(PERIOD))).alias("_hits"),
    )
    after = F.filter("_hits", lambda y: F.col("_miss").isNull() | (y > F.col("_miss")))
    return runs.select("entity", F.size(after).cast("int").alias("streak"))


def leader_run(series: DataFrame, value: str, last: int) -> DataFrame:
    """The leader of period ``last`` and for how many periods in a row it has led."""
    leaders = argmax([PERIOD], series.filter(F.col(PERIOD) <= last), value)
    # one row per period from here on
    packed = leaders.agg(F.sort_array(F.collect_list(F.struct(PERIOD, "entity", value)), asc=False).alias("l"))
    head = F.element_at("l", 1)
    broken = F.filter(
        "l", lambda r: (r[PERIOD] < head[PERIOD]) & ((r["entity"] != head["entity"]) | (r[value] <= 0))
    )
    length = F.size(F.filter("l", lambda r: r[PERIOD] > F.coalesce(F.array_max(F.transform(broken, lambda b: b[PERIOD])), F.lit(-1))))
    return packed.select(head["entity"].alias("entity"), head[value].alias(value), length.cast("int").alias("run"))


def adjacent_changes(series: DataFrame, value: str) -> DataFrame:
    """Change against the preceding period in dataset order, where both are positive."""
    prev = F.lag(value).over(line())
    return (
        series.withColumn("prev", prev)
        .filter((F.col("prev") > 0) & (F.col(value) > 0))
        .withColumn("change", change(value, "prev"))
    )
