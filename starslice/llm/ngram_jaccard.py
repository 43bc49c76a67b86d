"""N-gram Jaccard join (operator 7): all links of a similarity join over word shingles, by filters under several token orders.

A text's set holds the hashes (64 bits) of its distinct word shingles. Texts with equal sets are one class and only its smallest id
goes on. Two sets of Jaccard similarity t or more share a token among the first n - ceil(t n) + 1 tokens of each, under any order
of all tokens. Prefix tokens under a first order (tokens that are frequent in the corpus come last) are grouped; two members of a
group are candidates if they also share a prefix token under two more orders, and if their sizes and the parities of their tokens allow the
similarity. The texts of candidates are then compared exactly.

A pair that links is a candidate at the first token that both have, and all that they share stands there or behind. So the number of
tokens from there on (the room of a member) bounds the intersection, and members whose room is too small for each other are no candidates.

A group doesn't emit its pairs. In each round it compares one pivot with its members that aren't yet in the pivot's component, as a
link inside a component changes nothing. The first pivot has the fewest tokens before the group's, so in a family of near copies it
is the one that most others link with. After a few rounds, or one whose pivots leave nothing to compare, the pairs left between
components of a group are compared one by one, so no link between components is lost; see ``between`` for how they are found.

Defined results: a null or empty text has an empty set and links with nothing, its component is its own id; a text of fewer words
than a shingle is one shingle; repeated rows give one row, and where an id has several texts the greatest one counts; rows with a null
id are left out; extra columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starslice.llm.common import Scratch, TextBatch, add_columns, arrow_batches, mix64, one_text_per_id, pieces, ship
from starslice.llm.components import components

ROUNDS = 3  # of pivots, before the pairs that are left
HEAVY = 1_000_000  # so many frequent tokens at most are ordered after all others
ORDERS = (31, 32)  # seeds of the further orders
SEEN_BITS = 1 << 27
BITS = 256  # of a prefix under a further order
SEMI_ROWS = 1_000_000  # ids that are broadcast to filter documents; more are joined by a shuffle


def prefix_length(n: np.ndarray, t: Fraction) -> np.ndarray:
    return n - -(-(n * t.numerator) // t.denominator) + 1


def text_sets(texts: list[str | None], size: int):
    """For each piece of texts: its slice, the shingle hashes, distinct in each text and ordered by text, and where texts begin."""
    for part in pieces(texts):
        batch = TextBatch(texts[part], lower=True)
        h, doc = batch.shingles(batch.word_hash(), size)
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
        yield part, h, doc, np.searchsorted(doc, np.arange(batch.n + 1))


def heavy_tokens(docs: DataFrame, size: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that some partition has in two documents or more, sorted, and the levels of their counts, by which they are ordered;
    of more than HEAVY, those with the greatest counts.

    A share of all documents would let groups grow with the corpus: what a passage shares stays before it until the passage is in
    thousands of documents. A token of k documents is twice in one of p partitions as soon as k is some roots of p. Equal sets
    count once in a partition. The list only serves the order of tokens, which may be any order.
    """
    def local(batches):
        # a token's first occurrence only sets a bit, later ones are kept: most tokens have no second one
        seen, counts, once = set(), [(np.empty(0, np.uint64), np.empty(0, np.int32))], np.zeros(SEEN_BITS // 8, np.uint8)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                for _, h, doc, at in text_sets(batch.column(0).slice(start, 1000).to_pylist(), size):
                    sums = np.add.reduceat(np.append(h, np.uint64(0)), at[:-1])
                    fresh = np.array([b > a and (int(s), b - a) not in seen and not seen.add((int(s), b - a)) for s, a, b in zip(sums, at[:-1], at[1:])], bool)
                    own = np.sort(h[fresh[doc]])
                    bit = own % np.uint64(SEEN_BITS)
                    at, mask = (bit >> np.uint64(3)).astype(np.int64), np.uint8(1) << (bit & np.uint64(7)).astype(np.uint8)
                    again = (once[at] & mask) > 0
                    again[1:] |= own[1:] == own[:-1]
                    np.bitwise_or.at(once, at, mask)
                    counts.append((own[again], None))
                    if sum(len(c[0]) for c in counts[1:]) > len(counts[0][0]):
                        counts = [added(counts)]
        h, n = added(counts)
        for start in range(0, len(h), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[start:start + 100_000].astype(np.int64)) for x in (h.view(np.int64), n + 1)], names=["h", "n"])

    def added(counts):
        h = np.concatenate([c[0] for c in counts])
        n = np.concatenate([np.ones(len(c[0]), np.int32) if c[1] is None else c[1] for c in counts])
        order = np.argsort(h, kind="stable")  # two sorted pieces: a merge
        h, n = h[order], n[order]
        head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))[:len(h)]
        return (h[head], np.add.reduceat(n, head)) if len(h) else (h, n)

    found = scratch.put("frequent", docs.select("text").mapInArrow(local, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
                        .withColumn("level", F.floor(F.log2("n") * 8).cast("int")))
    held, least = 0, None
    for level, n in sorted(found.groupBy("level").count().collect(), reverse=True):
        if held + n > HEAVY:
            break
        held, least = held + n, level
    late = found.filter(F.col("level") >= (least if least is not None else 1 << 20)).select("h", F.least("level", F.lit(255)).cast("short").alias("level")).toArrow()
    scratch.drop("frequent")
    h, level = late.column("h").to_numpy().view(np.uint64), late.column("level").to_numpy().astype(np.uint8)
    order = np.argsort(h)
    return h[order], level[order]


INDEX = T.StructType([T.StructField("n", T.LongType()), T.StructField("f1", T.LongType()), T.StructField("f2", T.LongType()),
                      T.StructField("bits", T.ArrayType(T.LongType())), T.StructField("parity", T.ArrayType(T.LongType())), T.StructField("prefix", T.ArrayType(T.LongType()))])


def index(docs: DataFrame, size: int, t: Fraction, scratch: Scratch) -> DataFrame:
    """(id, n, f1, f2, bits, parity, prefix): set size, fingerprint, prefixes under the further orders as bits, parities of the set's
    tokens in as many bits as the next power of two, prefix under the first order."""
    heavy = docs.sparkSession.sparkContext.broadcast(heavy_tokens(docs, size, scratch))

    def of(texts):
        out = {k: [] for k in INDEX.names}
        late, level = heavy.value
        for part, h, doc, at in text_sets(texts, size):
            n = np.diff(at)
            p = prefix_length(n, t)
            mixed = mix64(h, 7)
            both = [np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)]) for x in (h, mixed)]
            f1, f2 = ((x[at[1:]] - x[at[:-1]]).view(np.int64) for x in both)
            at_late = np.minimum(np.searchsorted(late, h), max(0, len(late) - 1))
            is_late = late[at_late] == h if len(late) else np.zeros(len(h), bool)

            rank = np.arange(len(h)) - at[doc]
            behind = (np.where(is_late, level[at_late], 0) if len(late) else np.zeros(len(h))).astype(np.uint64) << np.uint64(56)

            def first(code):
                """Rows of the prefix of each text, under the order by heaviness, then code."""
                return np.lexsort((behind | (code >> np.uint64(8)), doc))[rank < p[doc]]

            own = first(mixed)
            cut = np.searchsorted(doc[own], np.arange(len(n) + 1))
            bits = np.zeros((len(n), len(ORDERS) * BITS // 8), np.uint8)
            for k, seed in enumerate(ORDERS):
                code = mix64(h, seed)
                rows = first(code)
                bit = (mix64(code[rows], 99) % np.uint64(BITS)).astype(int)
                np.bitwise_or.at(bits, (doc[rows], k * BITS // 8 + bit // 8), (1 << (bit % 8)).astype(np.uint8))
            wide = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
            ends = np.concatenate([[0], np.cumsum(wide)])
            odd = np.bincount(ends[doc] + (mix64(h, 55) % wide[doc].astype(np.uint64)).astype(np.int64), minlength=ends[-1]) & 1
            words = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)
            out["parity"] += [words[a // 64:b // 64] for a, b in zip(ends[:-1], ends[1:])]
            out["n"] += n.tolist()
            out["f1"] += f1.tolist()
            out["f2"] += f2.tolist()
            out["bits"] += bits.view(np.int64).tolist()
            out["prefix"] += [h[own[a:b]].view(np.int64) for a, b in zip(cut[:-1], cut[1:])]
        return out

    return add_columns(docs, ["text"], INDEX, of).drop("text")


def grouped(rows: DataFrame, *more: str) -> DataFrame:
    """(token, id, *more) of the tokens that two ids or more have, all of longs; rows of a token stream by, none is held but the last."""
    names = ["token", "id", *more]

    def shared(batches):
        last, gone = [np.empty(0, np.int64) for _ in names], False  # the row before, and whether it went out
        for batch in batches:
            if not batch.num_rows:
                continue
            values = [np.concatenate([x, batch.column(k).to_numpy(zero_copy_only=False)]) for k, x in enumerate(last)]
            same = values[0][1:] == values[0][:-1]
            out = np.zeros(len(values[0]), bool)
            out[1:] |= same
            out[:-1] |= same
            if gone:
                out[0] = False
            yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in values], names=names)
            gone = len(same) > 0 and bool(same[-1])
            last = [x[-1:] for x in values]

    return rows.select(*names).repartition("token").sortWithinPartitions("token", "id").mapInArrow(shared, ", ".join(f"{c} long" for c in names))


def possible(t: Fraction) -> Column:
    """Whether a member (n, room) and another (n2, room2) of a group may have similarity ``t``: by their sizes, and as they share
    no more tokens than the smaller room has."""
    sizes = F.least("n", "n2") * t.denominator >= F.greatest("n", "n2") * t.numerator
    return sizes & (F.least("room", "room2") * (t.denominator + t.numerator) >= (F.col("n") + F.col("n2")) * t.numerator)


def between(mine: DataFrame, t: Fraction) -> DataFrame:
    """Pairs (id, id2, token) of members (token, id, n, room, label) of a group that have different labels and are ``possible``.

    The larger member of a pair looks for the smaller one, which must have room for half of what a partner of its own size needs to
    share, and is found in its band of sizes. So members with many tokens of their own before the group's look in bands below theirs only,
    and don't look where no size or only their own label is. In each band the label of the member with the fewest tokens before
    the group's is the main one; its members look among those of other labels only, so a large component isn't paired with itself.
    """
    p, q = t.numerator, t.denominator
    wide = max(float(np.log(q / p)), 0.01) / 4
    band = lambda n: F.floor(F.log(n) / F.lit(wide))
    homes = mine.filter(F.col("room") * (p + q) >= F.col("n") * 2 * p).withColumn("band", band("n"))
    main = homes.groupBy("token", "band").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.min("n").alias("low"),
                                              F.min_by("label", F.struct(F.col("n") - F.col("room"), "id")).alias("main"))
    bounds = mine.withColumn("from", F.ceil(F.col("n") * p / q)).withColumn("to", F.least("n", F.floor(F.col("room") * (p + q) / p) - F.col("n")))
    # a bound that is rounded is one too wide rather than too narrow
    looks = (bounds.filter("to >= from - 1").select("token", "id", "n", "room", "label", "to", F.explode(F.sequence(band(F.greatest(F.lit(1), F.col("from") - 1)), band(F.col("to") + 1))).alias("band"))
             .join(main, ["token", "band"]).filter("low <= to + 1 AND (l0 <> l1 OR l0 <> label)")
             .select("token", "band", "id", "n", "room", "label", (F.col("label") == F.col("main")).alias("others")))
    found = homes.select("token", "band", F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("room").alias("room2"), F.col("label").alias("label2"))
    found = found.join(main.select("token", "band", "main"), ["token", "band"])
    found = found.select("*", F.explode(F.when(F.col("label2") == F.col("main"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("others"))
    smaller = (F.col("n2") < F.col("n")) | ((F.col("n2") == F.col("n")) & (F.col("id2") < F.col("id")))
    return looks.join(found, ["token", "band", "others"]).filter((F.col("label") != F.col("label2")) & smaller & possible(t)).select("id", "id2", "token")


def apart(a: str, b: str, t: Fraction) -> Column:
    """A lower bound of the number of tokens that only one of two sets has: bits in which their parities differ, after the wider
    one is folded to the other's width. Sets of similarity ``t`` have widths of one power of two apart, or more if ``t`` is below a half."""
    def folded(x, other):
        if 2 * t < 1:
            to = F.size(other)
            return F.when(F.size(x) > to, F.transform(F.sequence(F.lit(0), to - 1), lambda i: F.aggregate(
                F.sequence(i, F.size(x) - 1, to), F.lit(0).cast("long"), lambda total, j: total.bitwiseXOR(F.get(x, j))))).otherwise(x)
        half = F.size(x) / 2
        halves = F.zip_with(F.slice(x, F.lit(1), half.cast("int")), F.slice(x, (half + 1).cast("int"), half.cast("int")), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x) > F.size(other), halves).otherwise(x)

    x, y = folded(F.col(a), F.col(b)), folded(F.col(b), F.col(a))
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, k: total + k)


TILE = 64  # ids a side of a tile, on average


def compare(pairs: DataFrame, docs: DataFrame, scratch: Scratch, name: str, size: int, t: Fraction, star: bool) -> DataFrame | None:
    """The pairs (a, b) whose texts' sets have Jaccard similarity ``t`` or more. ``pairs`` has a token that they share. None if there are no pairs.

    The pairs of a token are dealt by the hashes of their ids into tiles of about TILE ids a side (``star``: one pivot and TILE
    others). A tile gets each of its texts once, so many pairs among few texts don't multiply them.
    """
    of_token = pairs.groupBy("token").agg(F.count("*").alias("pairs"))
    sides = F.ceil((F.col("pairs") if star else F.sqrt("pairs")) / TILE)
    side = lambda c: F.pmod(F.xxhash64(c), sides)
    pairs = scratch.put(f"{name}_pairs", pairs.join(of_token, "token").select("a", "b", F.struct("token", side("a").alias("i"), side("b").alias("j")).alias("tile")))
    if not pairs.limit(1).count():
        return None
    wanted = pairs.select("tile", F.col("a").alias("id")).union(pairs.select("tile", "b")).distinct()
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    few = ids.limit(SEMI_ROWS + 1).count() <= SEMI_ROWS
    texts = docs.join(F.broadcast(ids) if few else ids, "id", "left_semi")
    held = wanted.join(texts, "id").groupBy("tile").agg(F.collect_list(F.struct("id", "text")).alias("texts"))
    tiles = held.join(pairs.groupBy("tile").agg(F.collect_list(F.struct("a", "b")).alias("pairs")), "tile")

    def exact(texts, pairs):
        out = []
        for own, asked in zip(texts, pairs):
            sets, ids = {}, [x["id"] for x in own]
            for part, h, _, at in text_sets([x["text"] for x in own], size):
                sets.update((k, h[a:b]) for k, a, b in zip(ids[part], at[:-1], at[1:]))
            linked = []
            for p in asked:
                x, y = sets[p["a"]], sets[p["b"]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both * t.denominator >= t.numerator * (len(x) + len(y) - both):
                    linked.append(p)
            out.append(linked)
        return {"linked": out}

    kind = T.StructType([T.StructField("linked", T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])))])
    found = add_columns(tiles.select("texts", "pairs"), ["texts", "pairs"], kind, exact, rows=4).select(F.inline("linked"))
    with arrow_batches(docs.sparkSession, 16):
        return scratch.put(f"{name}_links", found)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8) -> DataFrame:
    """(id_col, n_shingles, component_id) for each id of ``docs``. Two texts link at a similarity of ``threshold`` or more."""
    with arrow_batches(docs.sparkSession, 1000):
        return _components(docs, id_col, text_col, size, threshold)


def _components(docs: DataFrame, id_col: str, text_col: str, size: int, threshold: float) -> DataFrame:
    ship(docs.sparkSession)
    t = Fraction(threshold).limit_denominator(1000)
    scratch = Scratch(docs.sparkSession, "ngram-jaccard")
    plain = one_text_per_id(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), scratch)
    known = scratch.put("index", index(plain, size, t, scratch))
    classes = scratch.put("classes", known.filter("n > 0").groupBy("n", "f1", "f2").agg(F.min("id").alias("rep"), F.first("bits").alias("bits"), F.first("parity").alias("parity")))
    reps = classes.select(F.col("rep").alias("id"), "n", "bits", "parity")
    groups = scratch.put("groups", grouped(known.select("id", "n", F.posexplode("prefix").alias("before", "token")).withColumn("room", F.col("n") - F.col("before")), "room").join(reps.select("id", "n"), "id"))
    scratch.free()
    labels, tested, k = None, None, 0
    while k <= ROUNDS:
        mine = groups.join(labels, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component") if labels is not None else groups.withColumn("label", F.col("id"))
        # the first pivots have the fewest tokens before the group's, later ones are any with room for a partner of their own size
        order = F.col("n") - F.col("room") if k == 0 else (F.col("room") * (t.denominator + t.numerator) < F.col("n") * 2 * t.numerator).cast("long")
        pivot = F.min(F.struct(order.alias("o"), F.xxhash64("id", F.lit(k)).alias("r"), "id", "label", "n", "room")).alias("pivot")
        open_ = mine.groupBy("token").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), pivot).filter("l0 <> l1")
        if k == ROUNDS:
            pairs = between(scratch.put("open", mine.join(open_.select("token"), "token", "left_semi").select("token", "id", "n", "room", "label")), t)
        else:
            others = open_.select("token", *[F.col(f"pivot.{c}").alias(f"{c}2") for c in ("id", "label", "n", "room")])
            pairs = mine.join(others, "token").filter((F.col("label") != F.col("label2")) & possible(t))
        pairs = pairs.groupBy(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).agg(F.min("token").alias("token"))
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        half = BITS // 64
        shared = " AND ".join("(" + " OR ".join(f"(ba[{j}] & bb[{j}]) <> 0" for j in range(o * half, (o + 1) * half)) + ")" for o in range(len(ORDERS)))
        for what, fits in (("bits", F.expr(shared)),
                           # of sets of similarity t, at most a share (1 - t) / (1 + t) of all tokens is in one only
                           ("parity", apart("pa", "pb", t) * (t.denominator + t.numerator) <= (F.col("na") + F.col("nb")) * (t.denominator - t.numerator))):
            for side in "ab":
                pairs = pairs.join(reps.select(F.col("id").alias(side), *([F.col("n").alias(f"n{side}")] if what == "parity" else []), F.col(what).alias(f"{what[0]}{side}")), side)
            pairs = pairs.filter(fits).select("a", "b", "token")
        new = compare(pairs, plain, scratch, f"round{k}", size, t, star=k < ROUNDS)
        done = scratch.spark.read.parquet(scratch.paths[f"round{k}_pairs"]).select("a", "b")
        tested = done if tested is None else tested.union(done)
        scratch.free()
        if new is not None and new.limit(1).count():
            # the labels so far stand for the links that made them
            links = new if labels is None else new.union(labels.select(F.col("id").alias("a"), F.col("component").alias("b")))
            labels = scratch.put(f"labels{k}", components(links, scratch, f"cc{k}"))
        # nothing to compare with these pivots tells nothing about the other members: straight to the pairs that are left
        k = k + 1 if new is not None or k == ROUNDS else ROUNDS
    of_class = classes.select("n", "f1", "f2", "rep")
    if labels is not None:
        of_class = of_class.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("rep", F.coalesce("component", "rep"))
    of_class = of_class.select("n", "f1", "f2", F.col("rep").alias("component_id"))
    rows = known.select("id", "n", "f1", "f2").join(of_class, ["n", "f1", "f2"], "left")
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def greatest_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of each id, one of those with its greatest text."""
    text = F.struct(F.col(text_col).isNotNull(), F.col(text_col))  # never null, so null texts are ordered, too
    best = docs.groupBy(F.col(id_col).alias("key")).agg(F.max_by(F.struct(*[F.col(c) for c in docs.columns]), text).alias("row"))
    return best.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def one_of_each(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with the smallest id of each component; rows with a null id stay, of a repeated id a row with its greatest text."""
    scratch = Scratch(docs.sparkSession, "one-of-each")
    rows = jaccard_components(docs, id_col, **options)
    others = scratch.put("others", rows.filter(F.col("component_id") != F.col(id_col)).select(id_col))
    few = others.limit(SEMI_ROWS + 1).count() <= SEMI_ROWS
    kept = docs.join(F.broadcast(others) if few else others, docs[id_col].cast("long") == others[id_col], "left_anti")
    if kept.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1").limit(1).count():
        kept = kept.filter(F.col(id_col).isNull()).unionByName(greatest_texts(kept.filter(F.col(id_col).isNotNull()), id_col, options.get("text_col", "text")))
    return kept
