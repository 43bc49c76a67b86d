"""Chat formatting (operator 5): cumulative-snapshot collapse, then rendering, with DataFrame functions only.

Logs often hold a conversation again each time it grows. Turns are numbered in the order (turn, role, text); the running sum of
hashes of (number, role, text) identifies every prefix of a conversation. Equal conversations are one, with the smallest id;
a conversation whose hash is that of a shorter prefix of another one goes, by an anti-join; the maximal ones are rendered. Four sums
of 32 bits make a hash, so two prefixes agree by chance once in 2 ** 128.

Prefixes and conversations are made distinct by aggregates before they meet, so an opening turn that a third of all conversations
share is one row on each side.

Defined results: null roles and texts count as values of their own and render as the empty string; turns with equal numbers are
ordered by role and text, and repeated rows stay repeated turns; rows with a null conversation id are ignored; null turns come first;
extra columns are ignored. Empty tables give empty results. A rendered conversation is one row and must fit in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starslice.llm.common import Scratch

TEMPLATE = ("<|", "|>\n", "\n")  # before the role, between role and text, after a turn


def prefixes(turns: DataFrame, conv: str, turn: str, role: str, text: str, scratch: Scratch) -> DataFrame:
    """(conv, n, h0..h3): every prefix of n turns of each conversation and its hash.

    Turns are dealt by range over (conv, turn, role, text), so a conversation that holds very many of them is spread over parts; each part numbers and
    sums its own turns, and a conversation that goes on in a later part takes the sums of the parts before along.
    """
    order = ["conv", "turn", "role", "text"]
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).filter("conv IS NOT NULL")
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = scratch.put("dealt", rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    numbered = with_carry(dealt.withColumn("one", F.lit(1).cast("long")), {"one": "n"}, order)
    own = [F.col("n").cast("int"), F.col("role"), F.col("role").isNull(), F.col("text"), F.col("text").isNull()]
    a, b = F.xxhash64(F.lit(1), *own), F.xxhash64(F.lit(2), *own)
    parts_of = [a.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(a, 32), b.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(b, 32)]
    hashed = scratch.put("hashed", numbered.select("conv", "part", "n", *[p.alias(f"p{k}") for k, p in enumerate(parts_of)]))
    return with_carry(hashed, {f"p{k}": f"h{k}" for k in range(4)}, ["conv", "n"]).select("conv", F.col("n").cast("int").alias("n"), *[f"h{k}" for k in range(4)])


def with_carry(dealt: DataFrame, sums: dict[str, str], order: list[str]) -> DataFrame:
    """``dealt`` with the running sums of its columns in each conversation. ``part`` ascends with the order of all rows.

    A conversation in several parts begins, fills or ends them: there are at most two such rows a part to carry sums between.
    """
    run = Window.partitionBy("part", "conv").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    of_part = dealt.groupBy("conv", "part").agg(*[F.sum(c).alias(c) for c in sums])
    several = of_part.groupBy("conv").agg(F.count("*").alias("parts")).filter("parts > 1")
    carried = of_part.join(several, "conv", "left_semi").select("conv", "part", *[F.sum(c).over(before).alias(f"_{c}") for c in sums])
    own = dealt.withColumns({out: F.sum(c).over(run) for c, out in sums.items()}).drop(*[c for c in sums if c != "n"])
    return own.join(carried, ["conv", "part"], "left").withColumns({out: F.col(out) + F.coalesce(f"_{c}", F.lit(0)) for c, out in sums.items()})


def collapsed(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, n_turns, n_copies): the maximal conversations, each with the number of conversations equal to it, itself included."""
    scratch = Scratch(turns.sparkSession, "chat")
    every = scratch.put("prefixes", prefixes(turns, conv, turn, role, text, scratch))
    key = ["n", "h0", "h1", "h2", "h3"]
    length = every.groupBy("conv").agg(F.max(F.struct(*key)).alias("last"))
    whole = length.select("conv", "last.*").groupBy(*key).agg(F.min("conv").alias("conv"), F.count("*").alias("n_copies"))
    shorter = every.join(whole.select("conv", F.col("n").alias("n_all")), "conv").filter("n < n_all").select(*key).distinct()
    return whole.join(shorter, key, "left_anti").select("conv", F.col("n").cast("long").alias("n_turns"), "n_copies")


def rendered(turns: DataFrame, kept: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
             template: tuple[str, str, str] = TEMPLATE) -> DataFrame:
    """``kept`` with ``rendered``: the turns of each conversation in order, in the form of ``template``."""
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    own = rows.join(kept, "conv").groupBy("conv", "n_turns", "n_copies").agg(F.array_sort(F.collect_list(F.struct(
        F.col("turn").isNotNull().alias("t0"), "turn", F.col("role").isNotNull().alias("r0"), "role", F.col("text").isNotNull().alias("x0"), "text"))).alias("all"))
    before, between, after = template
    turn_text = F.transform("all", lambda x: F.concat(F.lit(before), F.coalesce(x["role"], F.lit("")), F.lit(between), F.coalesce(x["text"], F.lit("")), F.lit(after)))
    return own.select(F.col("conv").alias(conv), "n_turns", "n_copies", F.array_join(turn_text, "").alias("rendered"))


def format_chats(turns: DataFrame, **columns) -> DataFrame:
    """The maximal conversations, rendered."""
    kept = Scratch(turns.sparkSession, "chat-kept").put("kept", collapsed(turns, **columns))
    return rendered(turns, kept, **columns)


OP5_SQL = """
WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id, n, md5(string_agg(CAST(n AS VARCHAR) || chr(1) || coalesce('r' || role, '') || chr(1) || coalesce('t' || text, ''), chr(2))
  OVER (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS h FROM t),
l AS (SELECT conv_id, max(n) AS n_turns FROM t GROUP BY conv_id),
w AS (SELECT min(conv_id) AS conv_id, n_turns, h, count(*) AS n_copies FROM l JOIN p USING (conv_id) WHERE n = n_turns GROUP BY n_turns, h),
s AS (SELECT DISTINCT h FROM p JOIN l USING (conv_id) WHERE n < n_turns),
k AS (SELECT * FROM w WHERE h NOT IN (SELECT h FROM s))
SELECT k.conv_id, n_turns, n_copies, string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY n) AS rendered
FROM k JOIN t USING (conv_id) GROUP BY k.conv_id, n_turns, n_copies"""
