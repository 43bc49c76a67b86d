"""Ranks, exact order statistics, argmax and top-k.

Two physical forms give the same answer, and the caller chooses. With ``bounded`` (the dimension is
declared a closed list) a window orders each group. Otherwise equal values are collapsed
first, the distinct values are range-partitioned, and a running total over the partitions
turns a position inside a partition into a global one, so no task holds a whole group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starslice.runtime import settle

_BEFORE = (W.unboundedPreceding, -1)


def running_counts(df: DataFrame, by: list[str], value: str, descending: bool = False, bounded: bool = False) -> DataFrame:
    """One row per (by, value): ``n`` equal rows and ``before`` rows that sort in front of it."""
    order = F.col(value).desc() if descending else F.col(value).asc()
    vals = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    return prefix_sum(vals, by, [order], "n", "before", bounded)


def _ranged_prefix_sum(rows: DataFrame, by: list[str], order: list[Column], weight: str, name: str) -> DataFrame:
    """Sum of ``weight`` over the rows of the same group that sort in front; ``order`` must be unique per group."""
    keys = [F.col(c).asc() for c in by] + order
    placed = settle(
        rows.repartitionByRange(*keys).withColumn("_bucket", F.spark_partition_id()), "placed"
    )
    # one row per (group, range partition), so this window is as small as the partition count
    w = W.partitionBy(*by).orderBy("_bucket").rowsBetween(*_BEFORE)
    heads = (
        placed.groupBy(*by, "_bucket").agg(F.sum(weight).alias("_w"))
        .withColumn("_head", F.coalesce(F.sum("_w").over(w), F.lit(0))).drop("_w")
    )
    inside = W.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(*_BEFORE)
    return (
        placed.join(heads, [*by, "_bucket"])
        .withColumn(name, F.col("_head") + F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        .drop("_bucket", "_head")
    )


def prefix_sum(rows: DataFrame, by: list[str], order: list[Column], weight: str, name: str, bounded: bool = False) -> DataFrame:
    """Sum of ``weight`` over the rows of the group in front of each row (0 for the first)."""
    if bounded:
        w = W.partitionBy(*by).orderBy(*order).rowsBetween(*_BEFORE)
        return rows.withColumn(name, F.coalesce(F.sum(weight).over(w), F.lit(0)))
    return _ranged_prefix_sum(rows, by, order, weight, name)


def eligible(value: str, positive_only: bool) -> Column:
    """Rankable rows: defined and, for count-like measures, positive."""
    v = F.col(value)
    return v.isNotNull() & (v > 0) if positive_only else v.isNotNull()


def competition_rank(df: DataFrame, by: list[str], value: str, positive_only: bool = True, bounded: bool = False,
                     name: str = "rank") -> DataFrame:
    """1 = highest, ties share a rank, ineligible rows get NULL."""
    ok = eligible(value, positive_only)
    if bounded:
        w = W.partitionBy(*by, ok).orderBy(F.col(value).desc())
        return df.withColumn(name, F.when(ok, F.rank().over(w)).cast("int"))
    counts = running_counts(df.filter(ok), by, value, descending=True)
    ranks = counts.select(*by, F.col(value).alias("_v"), (F.col("before") + 1).cast("int").alias(name))
    same = reduce(lambda a, b: a & b, [df[c].eqNullSafe(ranks[c]) for c in by], df[value] == ranks["_v"])
    return df.join(ranks, same & ok, "left").select(*[df[c] for c in df.columns], name)


def ordinal_rank(df: DataFrame, by: list[str], value: str, tie: str, bounded: bool = False, name: str = "rank") -> DataFrame:
    """Unique positions; ties are ordered by the (unique) ``tie`` column."""
    order = [F.col(value).desc_nulls_last(), F.col(tie).asc()]
    if bounded:
        return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("int"))
    placed = _ranged_prefix_sum(df.withColumn("_one", F.lit(1)), by, order, "_one", "_front")
    return placed.withColumn(name, (F.col("_front") + 1).cast("int")).drop("_one", "_front")


def order_statistics(df: DataFrame, by: list[str], value: str, positions: Column, bounded: bool = False) -> DataFrame:
    """Exact values at 0-based ``positions`` (an array built from the group's row count ``n_rows``)."""
    counts = running_counts(df.filter(F.col(value).isNotNull()), by, value, bounded=bounded)
    counts = counts if bounded else settle(counts, "counts")
    sizes = counts.groupBy(*by).agg(F.sum("n").alias("n_rows"))
    joined = counts.join(sizes, by) if by else counts.withColumn("n_rows", sizes.scalar())
    joined = joined.withColumn("_p", positions)
    here = F.transform(
        "_p", lambda p, i: F.when((F.col("before") <= p) & (p < F.col("before") + F.col("n")), i)
    )
    return (
        joined.withColumn("pos", F.explode(F.filter(here, lambda i: i.isNotNull())))
        .select(*by, F.col("pos").cast("int").alias("pos"), value, "n_rows")
    )


def quantile_positions(k: int) -> Column:
    """0-based positions floor((i+1)*n/k): equal-count class breaks without interpolation."""
    return F.transform(F.sequence(F.lit(1), F.lit(k - 1)), lambda i: F.floor(i * F.col("n_rows") / k))


def quantile_breaks(df: DataFrame, by: list[str], value: str, k: int, bounded: bool = False) -> DataFrame:
    """Array of the k-1 break values per group."""
    stats = order_statistics(df, by, value, quantile_positions(k), bounded)
    packed = F.sort_array(F.collect_list(F.struct("pos", value)))
    return stats.groupBy(*by).agg(F.transform(packed, lambda s: s[value]).alias("breaks"))


def argmax(by: list[str], df: DataFrame, value: str, entity: str = "entity") -> DataFrame:
    """The leader per group; the lowest entity wins a tie."""
    ok = df.filter(F.col(value).isNotNull())
    return ok.groupBy(*by).agg(F.min_by(F.struct(entity, value), F.struct(-F.col(value), F.col(entity))).alias("_m")).select(
        *by, F.col(f"_m.{entity}").alias(entity), F.col(f"_m.{value}").alias(value)
    )


def top(df: DataFrame, limit: int, *order) -> DataFrame:
    """Top rows with a deterministic order (planned as TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(limit)


def numbered(df: DataFrame, limit: int, *order, name: str = "pos") -> DataFrame:
    """Top rows with their position; numbers at most ``limit`` rows."""
    best = top(df, limit, *order)
    return best.withColumn(name, F.row_number().over(W.orderBy(*order)).cast("int"))
