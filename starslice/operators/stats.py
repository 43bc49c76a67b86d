"""Regression, class breaks, choropleth scales, symbol sizes and equal-width bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starslice.operators import ranking as K
from starslice.runtime import ratio


def pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows where both measures are defined."""
    return df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())


def regression(df: DataFrame, by: list[str], x: str, y: str, log_x: bool = False, log_y: bool = False) -> DataFrame:
    """Least-squares line and correlation per group.

    A log axis is honoured only when a group has more than one row and all its values are
    positive; both forms are aggregated in the same pass and the right one is picked.
    """
    fx, fy = F.col(x).cast("double"), F.col(y).cast("double")
    lx, ly = F.log10(F.when(fx > 0, fx)), F.log10(F.when(fy > 0, fy))
    parts = []
    for tag, a, b in (("nn", fx, fy), ("ln", lx, fy), ("nl", fx, ly), ("ll", lx, ly)):
        parts += [
            F.regr_slope(b, a).alias(f"slope_{tag}"), F.regr_intercept(b, a).alias(f"icpt_{tag}"),
            F.regr_r2(b, a).alias(f"r2_{tag}"),
        ]
    agg = pairs(df, x, y).groupBy(*by).agg(
        F.count("*").alias("n"), F.min(fx).alias("_x"), F.min(fy).alias("_y"), *parts
    )
    use_x = F.lit(log_x) & (F.col("n") > 1) & (F.col("_x") > 0)
    use_y = F.lit(log_y) & (F.col("n") > 1) & (F.col("_y") > 0)

    def pick(stat: str) -> Column:
        return (
            F.when(use_x & use_y, F.col(f"{stat}_ll")).when(use_x, F.col(f"{stat}_ln"))
            .when(use_y, F.col(f"{stat}_nl")).otherwise(F.col(f"{stat}_nn"))
        )

    slope, r2 = pick("slope"), pick("r2")
    return agg.select(
        *by, "n", slope.alias("slope"), pick("icpt").alias("intercept"), r2.alias("r2"),
        F.when(F.col("n") > 2, F.signum(slope) * F.sqrt(r2)).alias("r"),
    )


def class_index(value: Column, breaks: Column) -> Column:
    """Number of breaks that are not above the value."""
    return F.when(value.isNotNull(), F.size(F.filter(breaks, lambda b: b <= value)))


def sequential_breaks(df: DataFrame, by: list[str], value: str, k: int = 5, bounded: bool = False) -> DataFrame:
    """Equal-count breaks with repeats merged and a lowest break at or below the minimum dropped."""
    raw = K.quantile_breaks(df, by, value, k, bounded)
    lows = df.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    if by:
        raw = raw.join(lows, by)
    else:  # one scale for everything: the two limits are scalars
        raw = raw.withColumns({c: lows.select(c).scalar() for c in ("lo", "hi")})
    distinct = F.array_distinct("breaks")
    kept = F.when(distinct[0] <= F.col("lo"), F.slice(distinct, 2, F.greatest(F.size(distinct) - 1, F.lit(0)))).otherwise(distinct)
    return raw.withColumn("breaks", kept)


def diverging_breaks(df: DataFrame, by: list[str], value: str, k: int = 3, bounded: bool = False) -> DataFrame:
    """Three classes on each side of zero; zero itself is a break when both sides have values."""
    v = F.col(value)
    signed = df.filter(v.isNotNull()).withColumn("_neg", v < 0)
    sides = K.quantile_breaks(signed, [*by, "_neg"], value, k, bounded)
    packed = sides.groupBy(*by).agg(
        F.max(F.when(F.col("_neg"), F.col("breaks"))).alias("n"), F.max(F.when(~F.col("_neg"), F.col("breaks"))).alias("p")
    )
    ends = df.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    none = F.array().cast("array<double>")
    neg = F.array_distinct(F.filter(F.coalesce("n", none), lambda b: b < 0))
    pos = F.array_distinct(F.filter(F.coalesce("p", none), lambda b: b > 0))
    zero = F.when(F.col("n").isNotNull() & F.col("p").isNotNull(), F.array(F.lit(0.0))).otherwise(none)
    return packed.join(ends, by).select(*by, "lo", "hi", F.concat(neg, zero, pos).alias("breaks"))


def class_ranges(scales: DataFrame, by: list[str]) -> DataFrame:
    """One row per class with its lower and upper limit."""
    limits = F.concat(F.array("lo"), F.col("breaks"), F.array("hi"))
    spans = F.transform(
        F.sequence(F.lit(0), F.size("breaks")),
        lambda i: F.struct(i.alias("class"), F.get(limits, i).alias("lo"), F.get(limits, i + 1).alias("hi")),
    )
    return scales.select(*by, F.inline(spans))


def bubble_radius(df: DataFrame, by: list[str], value: str, r_min: float = 2.0, r_max: float = 22.0) -> DataFrame:
    """Radius with area proportional to the absolute value; 0 where undefined."""
    size = F.abs(F.col(value))
    top = df.groupBy(*by).agg(F.max(size).alias("_max"))
    r = F.greatest(F.lit(r_min), r_max * F.sqrt(ratio(size, F.col("_max"))))
    return df.join(top, by).withColumn("radius", F.when(F.col(value).isNotNull() & (F.col("_max") > 0), r).otherwise(0.0)).drop("_max")


def equal_width_bin(df: DataFrame, by: list[str], value: str, k: int = 5) -> DataFrame:
    """Bin 0..k-1 between the group's minimum and maximum; undefined values and flat groups fall in bin 0."""
    ends = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    t = ratio(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    at = F.least(F.lit(k - 1), F.greatest(F.lit(0), F.floor(t * k)))
    return df.join(ends, by).withColumn("bin", F.coalesce(at, F.lit(0)).cast("int")).drop("_lo", "_hi")
