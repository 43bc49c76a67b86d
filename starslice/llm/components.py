"""Connected components of links between ids, by alternating star rewrites over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starslice.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b); the component is its smallest id.

    Each round ties an id's larger neighbours to its smallest one, then its smaller neighbours likewise, until every id but the
    smallest ones has one neighbour, a smallest one. The smallest neighbour is an aggregate, so an id with very many links is
    summed before it is shuffled; the rounds grow with the logarithm of the longest chain. Rounds are written, which cuts the lineage.
    """
    def tie(edges: DataFrame, larger: bool) -> DataFrame:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")) if larger else edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        kept = both.filter("v > u") if larger else both
        out = kept.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        if not larger:
            out = out.union(low.select(F.col("u"), F.col("m")))
        return out.filter("a <> b").distinct()

    def open_ids(edges: DataFrame) -> int:
        """1 if some id is tied to two ids, or to one that is tied itself, else 0; one exchange, where a round has eight."""
        none = F.lit(None).cast("long")
        ends = edges.select(F.col("a").alias("u"), F.col("b").alias("to"), F.lit(0).alias("root")).union(edges.select("b", none, F.lit(1)))
        tied = ends.groupBy("u").agg(F.min("to").alias("low"), F.max("to").alias("high"), F.max("root").alias("root"))
        return tied.filter("low < high OR (low IS NOT NULL AND root = 1)").limit(1).count()

    edges = scratch.put(f"{name}_edges0", links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    k = 0
    while open_ids(edges):
        k += 1
        edges = scratch.put(f"{name}_edges{k}", tie(tie(edges, True), False))
        scratch.drop(f"{name}_edges{k - 1}")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
