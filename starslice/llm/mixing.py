"""Mixing sources to target weights (operator 6): a time-varying curriculum, with DataFrame functions only.

Each source has a weight and a schedule, a rate that goes linearly from ``start`` to ``end`` over training time 0..1. The weights share
out the words of all documents; a target stops at ``most`` times its source's size and the excess is shared anew by weight until no
target is above. Inside a source documents stand in the order of a hash of their id. The source is read again and again until its
target is met, the last document cut to fit. A document's place in the cumulative demand of its source, put through the inverse
of the integrated schedule, is its training position; ``training_order`` sorts by it.

No source is held together: documents are dealt by range over (source, hash), and running totals are summed part by part.

Defined results: a null text has size 0; a null source is a source, the last one; sizes and targets of sources without words are 0
and their documents aren't taken; rows with a null id are taken as others; repeated rows are taken each for itself; columns of ``docs``
named like the outputs are replaced. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starslice.llm.common import Scratch, fresh, n_words, running_total

WEIGHTS = (5, 2, 1)  # of sources in code point order, repeating
RATES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))  # start and end of their schedules, repeating
SOURCES = 200_000  # sources that are broadcast; more are joined by a shuffle


def by_turn(rank: Column, values: tuple) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (rank % len(values) + 1).cast("int"))


def shared_targets(sources: DataFrame, most: int) -> DataFrame:
    """``sources`` (source_size, weight) with ``target``: all words by weight, at most ``most`` times the source's size.

    A round is one sum over the sources: those above their limit get the limit, the rest is shared among the others.
    """
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    all_weights = sources.agg(F.sum("weight")).first()[0] or 1
    rest, weights, capped = total, all_weights, 0
    while True:
        above = F.col("weight").cast("decimal(38,0)") * rest > F.col("source_size").cast("decimal(38,0)") * (most * weights)
        n, words, w = sources.filter(above).agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if n == capped:
            break
        rest, weights, capped = total - most * words, max(1, all_weights - w), n
    share = F.col("weight").cast("double") * float(rest) / float(weights)
    return sources.withColumn("target", F.when(above, (F.col("source_size") * most).cast("double")).otherwise(share))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = 3,
        weights: tuple = WEIGHTS, rates: tuple = RATES, size: Column | None = None) -> DataFrame:
    """(id, source, size, source_size, target, taken, copies) for each row of ``docs``.

    ``copies`` is an array of (epoch, words, position): each time that the document is read, how many of its words, and when.
    ``size`` replaces the number of words of the text.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.put("sizes", docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), (n_words(F.col(text_col)) if size is None else size).alias("size")))
    last = F.col("source").isNull()
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_one", F.lit(1))
    ranked = running_total(sources, scratch, "rank", [last, F.col("source")], "_one", "rank").select("source", "source_size", "rank")
    starts = running_total(ranked, scratch, "starts", [last, F.col("source")], "source_size", "source_start")
    known = scratch.put("sources", starts.withColumn("weight", by_turn(F.col("rank"), weights)))
    known = shared_targets(known, most).withColumn("start", by_turn(F.col("rank"), tuple(r[0] for r in rates))).withColumn("end", by_turn(F.col("rank"), tuple(r[1] for r in rates)))
    known = known.withColumn("demand", F.round("target").cast("long")).drop("rank", "weight")
    order = [last, F.col("source"), F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))), F.col("id"), F.col("size")]
    placed = running_total(rows, scratch, "placed", order, "size", "before")
    few = known.limit(SOURCES + 1).count() <= SOURCES
    of = known.withColumnRenamed("source", "_source")
    both = placed.join(F.broadcast(of) if few else of, F.col("source").eqNullSafe(F.col("_source")))
    offset = F.col("before") - F.col("source_start")
    epochs = F.sequence(F.lit(0), F.lit(most))

    def copy(epoch: Column) -> Column:
        begin = epoch * F.col("source_size") + offset
        words = F.greatest(F.least(F.col("demand") - begin, F.col("size")), F.lit(0))
        u = (begin.cast("double") + words.cast("double") / 2) / F.greatest(F.col("demand"), F.lit(1)).cast("double")
        a, b = F.col("start"), F.col("end")
        at = F.when(a == b, u).otherwise((F.sqrt(a * a + (b * b - a * a) * u) - a) / (b - a))
        return F.struct(epoch.cast("int").alias("epoch"), words.alias("words"), at.alias("position"))

    copies = F.filter(F.transform(epochs, copy), lambda c: c["words"] > 0)
    taken = F.aggregate(F.col("copies"), F.lit(0).cast("long"), lambda t, c: t + c["words"])
    return (both.withColumn("copies", copies).withColumn("taken", taken)
            .select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "taken", "copies"))


PLACE = ("epoch", "words", "position")


def training_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: a row of ``docs`` for each reading of it, with epoch, words and position, range-sorted by position.

    Rows with the same id, source and text are one document. A document of which nothing is taken isn't in it. Texts are shuffled
    twice: to meet their places, and into training order.
    """
    base = docs.drop(*PLACE)
    key, size = fresh(base, "mix_key", "mix_size")
    parts = [F.col(id_col), F.col(source_col), F.col(text_col)]
    keyed = base.withColumn(key, F.xxhash64(*parts, *[p.isNull() for p in parts]))
    sizes = keyed.groupBy(key, source_col).agg(F.max(n_words(F.col(text_col))).alias(size))
    places = mix(sizes, key, text_col, source_col, size=F.col(size), **options).select(F.col(key), F.inline("copies"))
    repeated = keyed.groupBy(key).count().filter("count > 1").limit(1).count()
    once = keyed.dropDuplicates([key]) if repeated else keyed
    return once.join(places, key).orderBy("position", "epoch", key).select(*base.columns, *PLACE)


OP6_SQL = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM s0),
s2 AS (SELECT *, CASE r % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, CASE r % 3 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 1::DOUBLE ELSE 0.5::DOUBLE END AS a,
  CASE r % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1::DOUBLE ELSE 1.5::DOUBLE END AS b FROM s1),
s3 AS (SELECT *, row_number() OVER o AS k, sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ws FROM s2 WINDOW o AS (ORDER BY source_size / w, r)),
f AS (SELECT min(k) AS k FROM s3 WHERE w * rest <= 3 * source_size * ws),
p AS (SELECT CAST(rest AS DOUBLE) AS rest, CAST(ws AS DOUBLE) AS ws, s3.k FROM s3 JOIN f USING (k)),
s4 AS (SELECT source, source_size, a, b, CASE WHEN s3.k < p.k THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(w AS DOUBLE) * p.rest / p.ws END AS target FROM s3, p),
s AS (SELECT *, CAST(round(target) AS BIGINT) AS demand FROM s4),
c AS (SELECT d.*, s.source_size, s.a, s.b, s.target, s.demand,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
e AS (SELECT c.*, CAST(greatest(least(demand - g.e * source_size - c, size), 0) AS BIGINT) AS words, g.e * source_size + c AS begin0 FROM c, range(0, 4) g(e)),
t AS (SELECT *, CASE WHEN words > 0 THEN (CAST(begin0 AS DOUBLE) + CAST(words AS DOUBLE) / 2) / CAST(demand AS DOUBLE) END AS u FROM e)
SELECT doc_id, size, source_size, target, CAST(sum(words) AS BIGINT) AS taken,
  CAST(floor(1000000 * min(CASE WHEN a = b THEN u ELSE (sqrt(a * a + (b * b - a * a) * u) - a) / (b - a) END)) AS BIGINT) AS first_position_ppm
FROM t GROUP BY doc_id, size, source_size, target"""
