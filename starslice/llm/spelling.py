"""Spelling variants (operator 12): words one edit apart, by an index of variable-length grams, and the most frequent form of each.

1. Gram dictionary. Every word spreads a weight of one over its grams of 2 to 4 code points; a gram that gathers a share of at least
   1 / ``share`` of all words is frequent and stays. So the dictionary has at most ``share`` grams, whatever the corpus is.
2. Decomposition. A word is cut from its left and from its right end: a gram is one code point, extended while it is in the dictionary, up to
   ``longest`` code points. What a cut depends on are its own code points and, if it could have gone on, one more.
3. Affected grams. An edit at a place can change the left cuts that have read that place or go beyond it, and the right cuts likewise; all
   other grams of the word are the same in the other word, at the same distance from their end.
4. List merging. Words whose unaffected grams all agree are those in the intersection of these grams' lists. The lists are merged by one
   join on the joint hash of the unaffected grams from both ends (128 bits, with the length of the shorter word). A list holds only
   words that differ in the affected part, a few code points long.
5. Verification. With the unaffected parts equal, two words are one edit apart if their affected parts are. The join tests it, so that no
   other pair leaves it.

Words get ids in code-point order, so ties are settled by ids. Forms are followed to the root by doubling pointers; each form is at least
twice as frequent as its word, so chains are short and have no circle.

Defined results: null and empty texts have no words; repeated rows are counted each; a null id reads as an empty one in the
deletion rule; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starslice.llm.common import Scratch, arrow_type, ship
from starslice.llm.matches import UPPER, matches

RUNS = re.compile("[A-Za-zÀ-ÿ]+")
HELD = 100_000  # words, or rows of the index, that a task holds before it gives them on


def as_batches(rows: Iterator[tuple], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of at most ``HELD`` rows."""
    kinds = [(f.name, arrow_type(f)) for f in schema]
    held = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(zip(*held), kinds)], [n for n, _ in kinds])

    for row in rows:
        held.append(row)
        if len(held) >= HELD:
            yield batch()
            held = []
    if held:
        yield batch()


def spelled(doc_id, run: str, every: int) -> str:
    """A run as it counts: where ``every`` divides the hash of id and run, one of its code points is left out."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % every:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1:]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 5, least: int = 3, every: int = 97) -> DataFrame:
    """Words of at least ``shortest`` code points with at least ``least`` occurrences: (word, n)."""
    ship(docs.sparkSession)
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])

    def counted(batches):
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                runs: Counter = Counter()
                for found in matches(RUNS, text):
                    runs.update(found)
                for run, n in runs.items():
                    word = spelled(doc_id, run.translate(UPPER), every)
                    if len(word) >= shortest:
                        total[word] += n
                if len(total) >= HELD:
                    yield from total.items()
                    total.clear()
        yield from total.items()

    counts = docs.select(id_col, text_col).mapInArrow(lambda batches: as_batches(counted(batches), schema), schema)
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


WEIGHT = 1_000_000


def grams_of(word: str, longest: int = 4) -> set[str]:
    return {word[k:k + size] for size in range(2, longest + 1) for k in range(len(word) - size + 1)}


def frequent_grams(words: DataFrame, share: int = 2000, longest: int = 4) -> frozenset[str]:
    """The gram dictionary: at most ``share`` grams, as the weights of all words' grams add up to the number of words."""
    schema = T.StructType([T.StructField("gram", T.StringType()), T.StructField("weight", T.LongType())])

    def weighed(batches):
        total: Counter = Counter()
        for batch in batches:
            for word in batch.column(0).to_pylist():
                grams = grams_of(word, longest)
                for g in grams:
                    total[g] += WEIGHT // len(grams)
                if len(total) >= HELD:
                    yield from total.items()
                    total.clear()
        yield from total.items()

    n = words.count()
    grams = words.select("word").mapInArrow(lambda batches: as_batches(weighed(batches), schema), schema).groupBy("gram").agg(F.sum("weight").alias("weight"))
    return frozenset(r.gram for r in grams.filter(F.col("weight") * share >= n * WEIGHT).select("gram").collect())


def gram_limit(length: int) -> int:
    """Longest gram in a word of this length: an affected part of at most two grams then leaves grams on one side at least."""
    return min(4, max(2, length // 4))


def cuts(word: str, frequent: frozenset[str], longest: int) -> tuple[list[int], list[int], list[bytes]]:
    """Ends of the grams cut from the left, how many code points each cut depends on, and a running hash up to each; 0 is the first end."""
    ends, read, digests = [0], [0], [b""]
    at, n, state = 0, len(word), xxhash.xxh3_128()
    while at < n:
        size = 1
        while size < longest and at + size < n and word[at:at + size + 1] in frequent:
            size += 1
        state.update(word[at:at + size].encode())
        at += size
        ends.append(at)
        read.append(at if size == longest else at + 1)
        digests.append(state.digest())
    return ends, read, digests


def mirrored(frequent: frozenset[str]) -> frozenset[str]:
    return frozenset(g[::-1] for g in frequent)


def affected_parts(word: str, frequent: frozenset[str], backward: frozenset[str], longest: int, gone: int) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, hash of the unaffected grams) for every edit of ``gone`` code points (0: an insertion before a place), without repeats.

    ``backward`` holds the dictionary's grams mirrored, for the cuts from the right end.
    """
    n = len(word)
    left, left_read, left_hash = cuts(word, frequent, longest)
    right, right_read, right_hash = cuts(word[::-1], backward, longest)
    j, k, last = 0, len(right) - 1, None
    for place in range(n - gone + 1):
        while j + 1 < len(left) and left_read[j + 1] <= place:
            j += 1
        while right_read[k] > n - place - gone:
            k -= 1
        if (j, k) != last:
            last = (j, k)
            yield left[j], n - right[k], left_hash[j] + b"|" + right_hash[k]


INDEX = T.StructType([
    T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("role", T.ByteType()),
    T.StructField("part", T.StringType()), T.StructField("id", T.LongType()), T.StructField("n", T.LongType())])
EQUAL, SHORTER, LONGER = 0, 1, 2


def gram_index(words: DataFrame, frequent: frozenset[str]) -> DataFrame:
    """Rows of the index for ``words`` (id, word, n): joint hash of the unaffected grams, the affected part, and the word's role in a pair."""
    ship(words.sparkSession)
    backward = mirrored(frequent)

    def rows(batches):
        for batch in batches:
            for i, word, n in zip(*[batch.column(c).to_pylist() for c in range(3)]):
                length = len(word)
                for role, shorter, gone in ((EQUAL, length, 1), (SHORTER, length, 0), (LONGER, length - 1, 1)):
                    kind = b"%d|%d|" % (role == EQUAL, shorter)
                    for start, end, same in affected_parts(word, frequent, backward, gram_limit(shorter), gone):
                        key = xxhash.xxh3_128_intdigest(kind + same)
                        yield (key >> 64) - (1 << 63), (key & 0xFFFFFFFFFFFFFFFF) - (1 << 63), role, word[start:end], i, n

    return words.select("id", "word", "n").mapInArrow(lambda batches: as_batches(rows(batches), INDEX), INDEX)


def near_pairs(index: DataFrame) -> DataFrame:
    """Pairs of words one edit apart, one row for each direction: (id, n, other, other_n)."""
    a, b = index.alias("a"), index.alias("b")
    one_edit = F.levenshtein(F.col("a.part"), F.col("b.part"), 1) == 1
    equal = (F.col("a.role") == EQUAL) & (F.col("b.role") == EQUAL) & (F.col("a.id") < F.col("b.id"))
    uneven = (F.col("a.role") == SHORTER) & (F.col("b.role") == LONGER)
    found = a.join(b, (F.col("a.k1") == F.col("b.k1")) & (F.col("a.k2") == F.col("b.k2")) & (equal | uneven) & one_edit)
    pairs = found.select(F.col("a.id").alias("x"), F.col("b.id").alias("y"), F.col("a.n").alias("nx"), F.col("b.n").alias("ny")).distinct()
    return pairs.select(F.inline(F.array(
        F.struct(F.col("x").alias("id"), F.col("nx").alias("n"), F.col("y").alias("other"), F.col("ny").alias("other_n")),
        F.struct(F.col("y").alias("id"), F.col("ny").alias("n"), F.col("x").alias("other"), F.col("nx").alias("other_n")))))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root): the last word that the forms (id, form) lead to. Only words with a form are given."""
    now, name = scratch.put("roots", forms.select("id", F.col("form").alias("root"))), "roots"
    for k in range(1, 64):
        on = now.select(F.col("id").alias("root"), F.col("root").alias("next"))
        made = scratch.put(f"roots{k}", now.join(on, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        open_rows = made.filter("moved").limit(1).count()
        scratch.drop(name)
        now, name = made.drop("moved"), f"roots{k}"
        if not open_rows:
            break
    return now


def variants(words: DataFrame, scratch: Scratch | None = None, share: int = 2000, ratio: int = 2) -> DataFrame:
    """``words`` (word, n; words of at least five code points, each once) with ``n_near``, ``form``, ``form_n`` and ``root``.

    A word's form is its near word of largest n, the smallest in code-point order of equals, if its n is at least ``ratio`` times the word's.
    """
    scratch = scratch or Scratch(words.sparkSession, "spelling")
    # ids ascend in code-point order: range partitions are numbered in their order, and rows in theirs
    ranged = scratch.put("counted", words.select("word", "n")).repartitionByRange("word").sortWithinPartitions("word")
    words = scratch.put("words", ranged.select(F.monotonically_increasing_id().alias("id"), "word", "n"))
    index = scratch.put("index", gram_index(words, frequent_grams(words, share)))
    best = F.max(F.struct(F.col("other_n"), (-F.col("other")).alias("o")))
    near = near_pairs(index).groupBy("id", "n").agg(F.count("other").alias("n_near"), best.alias("best"))
    large = F.col("best.other_n") >= ratio * F.col("n")
    near = scratch.put("near", near.select("id", "n_near", F.when(large, -F.col("best.o")).alias("form"), F.when(large, F.col("best.other_n")).alias("form_n")))
    scratch.drop("index", "counted")
    ended = roots(near.filter("form IS NOT NULL").select("id", "form"), scratch)
    named = near.join(ended, "id", "left")
    for c in ("form", "root"):
        named = named.join(words.select(F.col("id").alias(c), F.col("word").alias(f"{c}_word")), c, "left")
    named = named.select("id", "n_near", "form_word", "form_n", "root_word")
    return words.join(named, "id", "left").select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"),
        "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words of all texts with their near words' number, form and root."""
    return variants(word_counts(docs, id_col, text_col))
