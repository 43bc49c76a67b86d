"""Reconciliation, pinned known defects and data-quality rules. Each rule yields violation rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starslice.runtime import literal_rows, ratio


def reconcile(found: DataFrame, printed: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Keys whose values differ, or that exist on one side only (keyed symmetric difference)."""
    return found.join(printed, keys, "full").filter(~F.col(a).eqNullSafe(F.col(b)))


def column_sums(cells: DataFrame, keys: list[str], value: str) -> DataFrame:
    return cells.groupBy(*keys).agg(F.sum(value).alias("found"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def dependency_violations(df: DataFrame, key: str, dependents: list[str]) -> DataFrame:
    """Keys that do not determine their dependents; min and max keep the aggregation map-side."""
    what = F.struct(*dependents)
    return (
        df.groupBy(key).agg(F.min(what).alias("low"), F.max(what).alias("high"))
        .filter(~F.col("low").eqNullSafe(F.col("high")))
    )


def key_coverage(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Set difference in both directions: keys are tagged by origin and grouped, so each input is read once."""
    tagged = found.select(key, F.lit(1).alias("f"), F.lit(0).alias("e")).unionByName(expected.select(key, F.lit(0).alias("f"), F.lit(1).alias("e")))
    sides = tagged.groupBy(key).agg(F.max("f").alias("f"), F.max("e").alias("e")).filter("f <> e")
    return sides.select(key, F.when(F.col("e") == 1, "missing").otherwise("unexpected").alias("side"))


def same_vocabulary(found: DataFrame, expected: list[str], column: str) -> DataFrame:
    """Values outside the expected set and expected values never seen; empty means equal sets."""
    want = literal_rows(found.sparkSession, [(v,) for v in expected], f"{column} string")
    return key_coverage(found, want, column)


def overlap(found: DataFrame, wanted: list[str], column: str) -> DataFrame:
    """Wanted values with whether they occur."""
    want = literal_rows(found.sparkSession, [(v,) for v in wanted], f"{column} string")
    seen = found.select(column).distinct().withColumn("_seen", F.lit(True))
    return want.join(seen, column, "left").select(column, F.col("_seen").isNotNull().alias("present"))


def too_few(rows: DataFrame, by: list[str], minimum: int) -> DataFrame:
    """Groups with fewer rows than a parser must find."""
    return rows.groupBy(*by).agg(F.count("*").alias("found")).filter(F.col("found") < minimum)


def group_sizes(found: DataFrame, by: str, expected: DataFrame) -> DataFrame:
    """Group counts against expected counts; missing groups count as 0."""
    n = found.groupBy(by).agg(F.count("*").alias("found"))
    return expected.join(n, by, "full").withColumn("found", F.coalesce("found", F.lit(0))).filter(
        ~F.col("found").eqNullSafe(F.col("expected"))
    )


def first_valid(candidates: DataFrame, violations: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Per key the first candidate without violations.

    ``warn`` when an alternate is invalid, ``error`` when every candidate is.
    """
    flagged = violations.select(*keys, order).distinct().withColumn("_bad", F.lit(True))
    tagged = candidates.select(*keys, order).distinct().join(flagged, [*keys, order], "left")
    return tagged.groupBy(*keys).agg(
        F.min(F.when(F.col("_bad").isNull(), F.col(order))).alias("chosen"), F.count("_bad").alias("invalid")
    ).withColumn(
        "status", F.when(F.col("chosen").isNull(), "error").when(F.col("invalid") > 0, "warn").otherwise("ok")
    )


# -- pins: known defects of a source, each of which must still be there --------------------
def apply_cell_pins(df: DataFrame, pins: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Replace a printed value by its fixed one (NULL nulls it out) where the pin still matches."""
    marked = pins.select(*keys, F.col("printed").alias("_printed"), F.col("fixed").alias("_fixed"), F.lit(True).alias("_pin"))
    hit = F.col("_pin").isNotNull() & F.col(value).eqNullSafe(F.col("_printed"))
    return (
        df.join(marked, keys, "left")
        .withColumn("pinned", hit).withColumn(value, F.when(hit, F.col("_fixed")).otherwise(F.col(value)))
        .drop("_printed", "_fixed", "_pin")
    )


def stale_pins(df: DataFrame, pins: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Pins whose printed value is no longer in the source; a non-empty result blocks the build."""
    seen = df.select(*keys, F.col(value).alias("printed"))
    return pins.join(seen, [*keys, "printed"], "left_anti")


def two_sided(df: DataFrame, violates: Column, pins: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that violate without a pin (``unpinned``) and pins that no longer apply (``stale``)."""
    marked = pins.select(*keys, F.lit(True).alias("_pin"))
    tagged = df.withColumn("_bad", F.coalesce(violates, F.lit(False))).join(marked, keys, "full")
    bad, pin = F.coalesce("_bad", F.lit(False)), F.coalesce("_pin", F.lit(False))
    return tagged.filter(bad != pin).withColumn("problem", F.when(bad, "unpinned").otherwise("stale")).drop("_bad", "_pin")


def swap_classes(df: DataFrame, pins: DataFrame, keys: list[str], column: str = "class") -> DataFrame:
    """Exchange two class labels where a pin names them for the table."""
    marked = pins.select(*keys, F.col("class_a").alias("_a"), F.col("class_b").alias("_b"))
    c = F.col(column)
    return (
        df.join(marked, keys, "left")
        .withColumn(column, F.when(c == F.col("_a"), F.col("_b")).when(c == F.col("_b"), F.col("_a")).otherwise(c))
        .drop("_a", "_b")
    )


# -- derivation ------------------------------------------------------------------------------
def derive_by_difference(cells: DataFrame, total: str, parts: list[str], keys: list[str], table: str, value: str) -> DataFrame:
    """Total minus parts per key, from one signed aggregation; all-zero rows are dropped.

    Negative cells stay in the result so that the caller can turn them into errors.
    """
    sign = F.when(F.col(table) == total, 1).when(F.col(table).isin(*parts), -1)
    return (
        cells.filter(F.col(table).isin(total, *parts)).groupBy(*keys)
        .agg(F.sum(sign * F.col(value)).alias(value)).filter(F.col(value) != 0)
        .withColumn("derived", F.lit(True)).withColumn("negative", F.col(value) < 0)
    )


def derivation_errors(cells: DataFrame, derived: DataFrame, printed: DataFrame, total: str, parts: list[str], table: str,
                      col: str, value: str) -> DataFrame:
    """Missing parts, negative results and derived sums that differ from the printed totals."""
    missing = same_vocabulary(cells.filter(F.col(table).isin(total, *parts)), [total, *parts], table).filter(F.col("side") == "missing")
    negative = derived.filter("negative").select(F.concat(F.lit("negative "), F.col(col)).alias("error"))
    off = reconcile(derived.groupBy(col).agg(F.sum(value).alias("found")), printed, [col], "found", "printed")
    return (
        missing.select(F.concat(F.lit("missing "), F.col(table)).alias("error")).unionByName(negative.distinct())
        .unionByName(off.select(F.concat(F.lit("printed "), F.col(col)).alias("error")))
    )


# -- tolerances ------------------------------------------------------------------------------
def mean_check(df: DataFrame, by: list[str], value: str, printed: DataFrame, tolerance: float) -> DataFrame:
    """Group mean against the printed average."""
    mean = df.groupBy(*by).agg(F.avg(value).alias("mean"))
    return mean.join(printed, by).withColumn("violates", F.abs(F.col("mean") - F.col("printed")) > tolerance)


def match_quality(reported: DataFrame, own: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Per group: rows, exact matches, off by more than 1 % and 5 %, missing, and whether it fails (over a tenth beyond 5 %)."""
    off = F.abs(ratio(F.col("reported") - F.col("own"), F.col("own")))
    return reported.join(own, keys, "left").groupBy(group).agg(
        F.count("*").alias("n"), F.count_if(F.col("reported") == F.col("own")).alias("exact"),
        F.count_if(off > 0.01).alias("over_1pct"), F.count_if(off > 0.05).alias("over_5pct"),
        F.count_if(F.col("own").isNull()).alias("missing"),
    ).withColumn("failed", F.col("over_5pct") * 10 > F.col("n"))


# -- several reports of one key ----------------------------------------------------------------
def latest_wins(df: DataFrame, keys: list[str], report: str, values: list[str]) -> DataFrame:
    """The row of the latest report per key, by a map-side maximum instead of a per-key sort."""
    best = F.max_by(F.struct(*values), F.col(report)).alias("_v")
    return df.groupBy(*keys).agg(best, F.max(report).alias("source_report")).select(*keys, "_v.*", "source_report")


def revisions(df: DataFrame, keys: list[str], report: str, values: list[str]) -> DataFrame:
    """Consecutive reports of a key that disagree; a key has one row per report."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys).orderBy(report)
    tagged = df.withColumn("_old", F.lag(F.struct(F.col(report).alias("prev_report"), *[F.col(v).alias(f"prev_{v}") for v in values])).over(w))
    differs = reduce(lambda a, b: a | b, [~F.col(v).eqNullSafe(F.col(f"_old.prev_{v}")) for v in values])
    return tagged.filter(F.col("_old").isNotNull() & differs).select(*keys, report, *values, "_old.*")


def merge_duplicates(df: DataFrame, keys: list[str], is_alias: str, values: list[str]) -> DataFrame:
    """Sum rows of one key; several rows are legitimate only when one of them came through an alias."""
    return df.groupBy(*keys).agg(
        *[F.sum(v).alias(v) for v in values], F.count("*").alias("n"), F.bool_or(is_alias).alias("via_alias")
    ).withColumn("error", (F.col("n") > 1) & ~F.col("via_alias"))


def remainder_bucket(df: DataFrame, key: str, split: str, known: list[str], positive: str) -> DataFrame:
    """Counts per key with a map of splits; ``unknown`` takes what the known splits leave."""
    named = {k: (F.count_if(F.col(split) == k), F.sum(F.when(F.col(split) == k, F.col(positive)).otherwise(0))) for k in known}
    wide = df.groupBy(key).agg(
        F.count("*").alias("samples"), F.sum(positive).alias("positives"),
        *[n.alias(f"{k}_n") for k, (n, _) in named.items()], *[p.alias(f"{k}_p") for k, (_, p) in named.items()],
    )
    rest_n = F.col("samples") - reduce(lambda a, b: a + b, [F.col(f"{k}_n") for k in known])
    rest_p = F.col("positives") - reduce(lambda a, b: a + b, [F.col(f"{k}_p") for k in known])
    pack = lambda n, p: F.struct(n.alias("samples"), p.alias("positives"))
    entries = [x for k in known for x in (F.lit(k), pack(F.col(f"{k}_n"), F.col(f"{k}_p")))]
    return wide.select(
        key, "samples", "positives", F.create_map(*entries, F.lit("unknown"), pack(rest_n, rest_p)).alias("splits"),
        ((rest_n < 0) | (rest_p < 0) | (rest_p > rest_n)).alias("error"),
    )


class GateClosed(RuntimeError):
    """A check found violations, so nothing was written."""


def gate(checks: dict[str, DataFrame]) -> DataFrame:
    """One row per rule with its violation count."""
    parts = [df.agg(F.lit(name).alias("rule"), F.count("*").alias("violations")) for name, df in checks.items()]
    return reduce(DataFrame.unionByName, parts)
