"""Source divergence audit (operator 13): how far the word shares of a language's sources are apart, by three-dimensional cube partitioning.

Terms are counted for each group (lang, source) in one pass over the texts, pre-aggregated in each task. A language keeps the terms of at least
``least`` of its documents. Smoothed shares are integers, p = 1 + floor(10^9 (count + 1) / (N + V)), and a term's divergence
is floor((p - q)^2 / q); nothing is rounded.

Divergences of all pairs of sources are a product of the (source, term) matrix with itself. It is cut into cubes: a task owns a cell (block of
sources, block of sources, block of terms) of one language. It gets the slices of both source blocks, replicated to the cells that need them,
fills two small dense matrices of p and adds up divergences over its terms. Sums over the term axis are then an aggregation by pair. A cell
has about ``GROUPS`` x ``GROUPS`` x ``TERMS`` entries, whatever the corpus is: blocks are dealt by hash and their number follows the
counts of sources and kept terms. Terms that no source of a cell has need no rows: they add the same to each pair, and are counted.

Defined results: a null text, lang or source reads as empty; repeated rows are counted each; an empty table gives no rows; a group without
kept terms is compared by its smoothed shares; where a language keeps no terms all its pairs have value 0. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starslice.llm.common import Scratch, ship
from starslice.llm.matches import matches
from starslice.llm.spelling import HELD, as_batches

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
GROUPS, TERMS = 32, 4096
TERMS_HELD = 300_000  # terms of groups that a task holds before it gives their counts on
ONE = 1_000_000_000

COUNTED = T.StructType([
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("term", T.StringType()),
    T.StructField("count", T.LongType()), T.StructField("docs", T.LongType())])


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, count, docs) in rows that still have to be added up; each group has a row without a term as well."""
    ship(docs.sparkSession)

    def counted(batches):
        count: dict = defaultdict(Counter)
        seen: dict = defaultdict(Counter)
        groups = set()

        def given():
            for (lang, source), terms in count.items():
                in_docs = seen[lang, source]
                for term, n in terms.items():
                    yield lang, source, term, n, in_docs[term]
            count.clear()
            seen.clear()

        held = 0
        for batch in batches:
            for lang, source, text in zip(*[batch.column(c).to_pylist() for c in range(3)]):
                if (lang, source) not in groups:
                    if len(groups) >= HELD:
                        groups.clear()
                    groups.add((lang, source))
                    yield lang, source, None, 0, 0
                terms, own = count[lang, source], set()
                held -= len(terms)
                for found in matches(TERM, text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")):  # bytes.lower() changes A-Z only
                    terms.update(found)
                    own.update(found)
                seen[lang, source].update(own)
                held += len(terms)
                if held >= TERMS_HELD:
                    yield from given()
                    held = 0
        yield from given()

    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    return read.mapInArrow(lambda batches: as_batches(counted(batches), COUNTED), COUNTED)


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (total + terms)) in decimals, which hold any product of two counts. Without terms: 1."""
    over = (count + 1).cast("decimal(20,0)") * F.lit(ONE).cast("decimal(10,0)")
    return F.when(terms > 0, 1 + F.call_function("div", over, (total + terms).cast("decimal(20,0)"))).otherwise(F.lit(1)).cast("long")


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); p and q are at most 10^9 + 1, so the square fits."""
    return F.call_function("div", (p - q) * (p - q), q)


def shares(docs: DataFrame, scratch: Scratch, least: int = 3, **columns: str) -> tuple[DataFrame, DataFrame]:
    """``terms``: (lang, source, term, p, q) of occurring kept terms, q of the language. ``groups``: (lang, source, p0, terms, sources)."""
    # dealt by (lang, term) once: sums of a source and of the language both follow without another shuffle
    dealt = term_counts(docs, **columns).repartition("lang", "term")
    summed = dealt.groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    kept = summed.withColumns({"lang_count": F.sum("count").over(of_term), "lang_docs": F.sum("docs").over(of_term)})
    counts = scratch.put("counts", kept.filter(F.col("term").isNull() | (F.col("lang_docs") >= least)).drop("docs", "lang_docs"))

    # a term's first source (any one of them) counts it for the language
    first = F.col("source") == F.min("source").over(of_term)
    once = counts.withColumn("first", first & F.col("term").isNotNull())
    groups = scratch.put("groups", once.groupBy("lang", "source").agg(F.sum("count").alias("total"), F.count_if("first").alias("firsts")))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("firsts").alias("terms"), F.count("*").alias("sources"))
    groups = groups.select("lang", "source", "total").join(langs, "lang")
    groups = scratch.put("shares", groups.withColumn("p0", share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))))
    terms = counts.filter("term IS NOT NULL").join(groups, ["lang", "source"])
    terms = terms.withColumns({"p": share(F.col("count"), F.col("total"), F.col("terms")), "q": share(F.col("lang_count"), F.col("lang_total"), F.col("terms"))})
    return scratch.put("terms", terms.select("lang", "source", "term", "p", "q", "terms", "sources")), groups


def blocks(n: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / size)).cast("int")


def block_of(value: Column, n: Column) -> Column:
    return F.pmod(F.xxhash64(value), n.cast("long")).cast("int")


CELL = T.StructType([
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("other", T.StringType()),
    T.StructField("part", T.LongType()), T.StructField("seen", T.LongType())])


def cell_divergences(rows):
    """Divergences of a cell's pairs (a pandas frame), summed over the terms that it has. Rows without a term give a source's p of absent terms."""
    import pandas as pd  # in the task only: the driver does without

    of_terms = rows["term"].notna().to_numpy()
    term, names = pd.factorize(rows["term"][of_terms])
    sides = []
    for bit in (1, 2):
        here = (rows["side"].to_numpy() & bit) > 0
        group = rows[here & ~of_terms]
        sources = pd.Index(group["source"])
        matrix = np.repeat(group["p"].to_numpy(np.int64)[:, None], len(names), axis=1)
        own = here[of_terms]
        filled = rows[of_terms][own]
        matrix[sources.get_indexer(filled["source"]), term[own]] = filled["p"].to_numpy(np.int64)
        sides.append((sources, matrix))
    (left, p), (right, q) = sides
    sums = np.zeros((len(left), len(right)), np.int64)
    for k in range(len(left)):
        apart = p[k] - q
        sums[k] = (apart * apart // q).sum(axis=1)
    return pd.DataFrame({
        "lang": rows["lang"].iloc[0] if len(rows) else "", "source": np.repeat(left.to_numpy(object), len(right)),
        "other": np.tile(right.to_numpy(object), len(left)), "part": sums.ravel(), "seen": len(names)})


def pair_divergences(terms: DataFrame, groups: DataFrame, block: int = GROUPS, slab: int = TERMS) -> DataFrame:
    """(lang, source, other, value) of all pairs of different sources of a language, the value summed over all kept terms."""
    size = {"group_blocks": blocks(F.col("sources"), block), "term_blocks": blocks(F.col("terms"), slab)}
    placed = {"own": block_of(F.col("source"), F.col("group_blocks"))}
    of_terms = terms.withColumns(size).withColumns(placed).withColumn("slab", block_of(F.col("term"), F.col("term_blocks")))
    of_groups = groups.withColumns(size).withColumns(placed).withColumns({
        "slab": F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)), "term": F.lit(None).cast("string"), "p": F.col("p0")})
    columns = ["lang", "source", "term", "p", "slab", "own", "group_blocks"]
    slices = of_terms.select(*columns).unionByName(of_groups.select(*columns))
    # a slice goes to the cells of its row of blocks as left side (1) and to those of its column as right side (2), to its own once for both
    cells = F.transform(F.sequence(F.lit(0), F.col("group_blocks") - 1), lambda b: F.when(
        b == F.col("own"), F.array(F.struct(b.alias("i"), b.alias("j"), F.lit(3).alias("side")))).otherwise(
        F.array(F.struct(F.col("own").alias("i"), b.alias("j"), F.lit(1).alias("side")), F.struct(b.alias("i"), F.col("own").alias("j"), F.lit(2).alias("side")))))
    sent = slices.withColumn("cell", F.explode(F.flatten(cells))).select("lang", "cell.i", "cell.j", "slab", "cell.side", "source", "term", "p")
    parts = sent.groupBy("lang", "i", "j", "slab").applyInPandas(cell_divergences, CELL)
    sums = parts.filter("source != other").groupBy("lang", "source", "other").agg(F.sum("part").alias("part"), F.sum("seen").alias("seen"))
    p = groups.select("lang", "source", F.col("p0").alias("p"), "terms")
    q = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("q"))
    unseen = (F.col("terms") - F.col("seen")) * divergence(F.col("p"), F.col("q"))
    return sums.join(p, ["lang", "source"]).join(q, ["lang", "other"]).select("lang", "source", "other", (F.col("part") + unseen).alias("value"))


def audit(docs: DataFrame, least: int = 3, top: int = 200, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank). Part ``pair``: every other source of the language; part ``term``: the ``top`` terms that a
    source uses more than its language does."""
    scratch = Scratch(docs.sparkSession, "divergence")
    terms, groups = shares(docs, scratch, least, lang_col=lang_col, source_col=source_col, text_col=text_col)
    pairs = pair_divergences(terms, groups).select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    more = terms.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    # each part has its own window: the bound on a term's rank is then applied before rows are shuffled
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [pairs.withColumn("rank", F.row_number().over(order)), more.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)]
    return reduce(DataFrame.unionByName, ranked)


OP13_SQL = """
WITH docs AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT doc, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM docs),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
vocabulary AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM words GROUP BY lang, source, term),
sources AS (SELECT DISTINCT lang, source FROM docs),
totals AS (
  SELECT s.lang, s.source, coalesce(sum(c.n) FILTER (WHERE k.term IS NOT NULL), 0)::HUGEINT AS total
  FROM sources s LEFT JOIN counts c USING (lang, source) LEFT JOIN kept k USING (lang, term) GROUP BY s.lang, s.source),
shares AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (t.total + v.v))::HUGEINT AS p,
    (1 + (1000000000::HUGEINT * (k.n + 1)) // (v.total + v.v))::HUGEINT AS q
  FROM totals t JOIN vocabulary v USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
