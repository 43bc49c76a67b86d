"""Star-schema slicing, ranking, comparison and reconciliation on Spark DataFrames."""

from starslice.plans.spec import SliceSpec
from starslice.sources.star import Star

__all__ = ["SliceSpec", "Star"]
