"""Type-ahead search over a name column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(text: Column) -> Column:
    """Search key: lower case with ``st.`` / ``st `` written out as ``saint``."""
    return F.trim(F.regexp_replace(F.lower(text), r"\bst\.?\s+", "saint "))


def name_search(names: DataFrame, needles: list[str], column: str, tie: str, limit: int = 8) -> DataFrame:
    """Matches of any needle, names starting with the first needle in front; the top ``limit`` rows."""
    key = fold(F.col(column))
    wanted = [fold(F.lit(n)) for n in needles]
    hit = reduce(lambda a, b: a | b, [F.contains(key, w) for w in wanted])
    best = (
        names.filter(hit)
        .withColumn("_late", F.when(F.startswith(key, wanted[0]), 0).otherwise(1))
        .withColumn("_key", key)
        .orderBy("_late", "_key", tie)
        .limit(limit)
    )
    # positions are numbered inside one array of at most ``limit`` rows
    ranked = best.agg(F.sort_array(F.collect_list(F.struct("_late", "_key", tie, *[c for c in names.columns if c != tie]))).alias("r"))
    return ranked.select(F.posexplode("r").alias("_pos", "r")).select("r.*", (F.col("_pos") + 1).cast("int").alias("pos"))


def search_log(log: DataFrame, names: DataFrame, needle: str, column: str, tie: str, limit: int = 8) -> DataFrame:
    """Each row of ``log`` with its matches (``tie``, ``column``) and their position ``pos``: the answers ``name_search`` gives, for a whole log of searches.

    Searches are made distinct first. Names are listed under those of their parts that are searched for and met by equality, so no search is
    compared with all names; of a part that very many names hold, the best ``limit`` are picked before the shuffle as well as after it. The
    list of a name grows with the square of its length. Empty and null searches and null names match nothing.
    """
    wanted = fold(F.col(needle))
    asked = log.select(wanted.alias("_needle")).filter("length(_needle) > 0").distinct()
    lengths = asked.agg(F.array_sort(F.collect_set(F.length("_needle")))).scalar()  # as many whole numbers as the longest search has letters
    keyed = names.select(F.col(tie), F.col(column), fold(F.col(column)).alias("_key")).filter("length(_key) > 0").withColumn("_lengths", lengths)
    used = F.filter("_lengths", lambda n: n <= F.length("_key"))
    parts = F.array_distinct(F.flatten(F.transform(used, lambda n: F.transform(F.sequence(F.lit(1), F.length("_key") - n + 1), lambda i: F.substring(F.col("_key"), i, n)))))
    listed = keyed.select(tie, column, "_key", F.explode(parts).alias("_needle")).join(asked, "_needle", "left_semi")
    # a name has each part once, so nothing but the window needs rows of one part together: its limit applies before the shuffle
    listed = listed.withColumn("_late", F.when(F.startswith(F.col("_key"), F.col("_needle")), 0).otherwise(1))
    best = Window.partitionBy("_needle").orderBy("_late", "_key", tie)
    top = listed.withColumn("pos", F.row_number().over(best)).filter(F.col("pos") <= limit).select("_needle", tie, column, "pos")
    return log.withColumn("_needle", wanted).join(top, "_needle").select(*log.columns, tie, column, "pos")
