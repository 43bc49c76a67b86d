"""Benchmark decontamination (operator 8): short test items inside long documents, by size-partitioned MinHash containment search.

Items are partitioned by size: class c holds items of up to 2 ** c distinct shingles. An item's sketch is its smallest shingle
hashes, as many as the class needs: a document with a share ``threshold`` of an item's q shingles lacks at most
floor((1 - threshold) q) of them, so one of any floor((1 - threshold) q) + 1 is in the document. Documents that hold a sketch hash are
candidates, none is missed; the exact shared shingles of each candidate pair are then counted. DataFrame functions only.

Words are runs of letters and digits (A-Z in lower case, every character beyond ASCII is a letter), so punctuation doesn't matter.

Defined results: null and empty texts and texts without words contain and are contained in nothing; a text of fewer words than a
shingle is one shingle; rows with a null id are ignored here and stay in ``decontaminated``; rows of one id are one document (or
item); extra columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import string
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starslice.llm.common import Scratch

SMALL = 200_000  # rows that are broadcast; beyond them joins shuffle


def shingles(text: Column, size: int) -> Column:
    """Hashes of all windows of ``size`` words, in order."""
    plain = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    words = F.filter(F.split(plain, r"[^0-9a-z\x{80}-\x{10FFFF}]+"), lambda w: w != "")

    def windows(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - F.lit(size - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, size)))
        return F.when(F.size(w) > 0, many).otherwise(F.array().cast("array<bigint>"))

    return F.element_at(F.transform(F.array(words), windows), 1)  # as an argument, the words are split once a text


def bounded(df: DataFrame, limit: int = SMALL) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows, else as it is, for a join that shuffles."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def sketches(items: DataFrame, threshold: Fraction) -> DataFrame:
    """(h, item, n): the sketch of each item of ``items`` (item, n, hashes)."""
    of_class = F.pow(F.lit(2), F.ceil(F.log2("n"))).cast("long")
    length = F.floor(of_class * (threshold.denominator - threshold.numerator) / threshold.denominator) + 1
    return items.select(F.explode(F.slice(F.array_sort("hashes"), F.lit(1), length.cast("int"))).alias("h"), "item", "n")


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                    item_text: str = "text", size: int = 5, threshold: float = 0.8) -> DataFrame:
    """(id, item, n_shared, n_item): every document that has a share ``threshold`` or more of an item's distinct shingles."""
    t = Fraction(threshold).limit_denominator(1000)
    scratch = Scratch(docs.sparkSession, "decontaminate")
    sets = (items.select(F.col(item_col).alias("item"), shingles(F.col(item_text), size).alias("hashes")).filter("item IS NOT NULL")
            .select("item", F.explode("hashes").alias("h")).groupBy("item").agg(F.collect_set("h").alias("hashes")).withColumn("n", F.size("hashes")))
    sets = scratch.put("items", sets)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL")
    found = (texts.select("id", F.explode(shingles(F.col("text"), size)).alias("h")).join(bounded(sketches(sets, t)), "h").select("id", "item").distinct())
    found = scratch.put("candidates", found)
    near = texts.join(bounded(found.select("id").distinct()), "id", "left_semi").select("id", F.explode(shingles(F.col("text"), size)).alias("h"))
    every = sets.select(F.explode("hashes").alias("h"), "item", "n")
    # an item's hash occurs many times in a long text: partial sums meet before the shuffle
    shared = near.join(bounded(every), "h").groupBy("id", "item", "n", "h").count().groupBy("id", "item", "n").agg(F.count("*").alias("n_shared"))
    exact = shared.join(found, ["id", "item"], "left_semi").filter(F.col("n_shared") * t.denominator >= F.col("n") * t.numerator)
    return exact.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_shared", F.col("n").cast("long").alias("n_item"))


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without those that contain an item."""
    scratch = Scratch(docs.sparkSession, "decontaminated")
    hits = scratch.put("hits", contained_items(docs, items, id_col, **options).select(id_col).distinct())
    return docs.join(bounded(hits), id_col, "left_anti").select(*docs.columns)


OP8_SQL = """
WITH d0 AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
i0 AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark),
d AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d0 WHERE len(w) > 0)),
i AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM i0 WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN i USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item FROM c JOIN n USING (item_id) WHERE 5 * n_shared >= 4 * n_item"""
