"""Line dedup against all earlier documents (operator 10).

A document loses every block of ``block_words`` words or more that stands, word for word, in an earlier document (smaller id); words are
compared, not the white space between them, and blocks may begin and end anywhere. Blocks are judged on the input, so what a
document loses is always still in an earlier one: in the earliest that holds it.

Such a block is a chain of windows of ``block_words`` words, each with an earlier holder, so a window only needs the smallest id that
has it; no pair of documents is chosen, and neither partitions nor repeats inside a text nor frequent lines change the result. The
smallest hash of ``line_words`` neighbouring words in a window is its anchor. First, neighbouring windows of one anchor are looked up as
one span. A window that only a part of two spans shares has the same anchor in both, so then the windows of anchors with several
spans are looked up one by one. What is found is sorted within pieces of the input first: of a span in a third of all documents
no more rows than pieces are shuffled. No text is shuffled to find the blocks.

Defined results: null and empty texts and rows with a null id stay as they are. Repeated rows (same id and text) end alike. Where
an id has several texts, each loses only blocks whose words it has at that place. Columns of ``docs`` pass through; outputs
replace columns of the same name.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starslice.llm.common import Scratch, TextBatch, add_columns, fresh, mix64, pieces, powers, ship

LINE_WORDS = 4
BLOCK_WORDS = 20
ANCHOR_BITS = 1 << 27
PIECE = 2_000_000  # spans that are sorted at once


def word_sums(batch: TextBatch) -> tuple[np.ndarray, np.ndarray]:
    """For each text in turn and each of its words, the sum of hash * BASE ** index of the words before it, one sum more at the end
    of each text; and where a text's sums begin."""
    ids, length = batch.word_hash(), np.diff(batch.bounds)
    up, _ = powers(int(length.max(initial=0)) + 1)
    index = np.arange(len(ids)) - np.repeat(batch.bounds[:-1], length)
    total = np.concatenate([[np.uint64(0)], np.cumsum(ids * up[index], dtype=np.uint64)])
    first = batch.bounds[:-1] + np.arange(batch.n)
    sums = np.zeros(len(ids) + batch.n, np.uint64)
    at = np.arange(len(sums)) - np.repeat(np.arange(batch.n), length + 1)
    sums[:] = total[at] - np.repeat(total[batch.bounds[:-1]], length + 1)
    return sums, first


def span_code(sums, first, last):
    """Hash of words [first, last) of a text, the same wherever in a text they stand."""
    _, down = powers(int(np.max(first, initial=0)) + 1)
    return (sums[last] - sums[first]) * down[first]


def smallest(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours, by doubling."""
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        x, reach = np.minimum(x[:-step], x[step:]), reach + step
    return x


def spans(batch: TextBatch, size: int, anchor_words: int, bits: np.ndarray | None) -> list[np.ndarray]:
    """Code, anchor, text, first word (within the text) and word behind the last of spans that cover all windows of ``size`` words.

    A window's anchor is the smallest hash of its runs of ``anchor_words`` words, so equal windows have equal anchors. Without ``bits``
    a span is all neighbouring windows of one anchor; with them, each window whose anchor is set in them.
    """
    n = len(batch.start) - size + 1
    if n < 1:
        return [np.empty(0, np.int64)] * 5
    sums, begin = word_sums(batch)
    _, down = powers(int(np.diff(batch.bounds).max()) + 1)

    def code(first, last):
        doc = batch.doc[first]
        return (sums[last + doc] - sums[first + doc]) * down[first - batch.bounds[doc]]

    run = np.flatnonzero(batch.doc[:len(batch.doc) - anchor_words + 1] == batch.doc[anchor_words - 1:])
    hashes = np.zeros(len(batch.doc) - anchor_words + 1, np.uint64)
    hashes[run] = mix64(code(run, run + anchor_words), 3)
    at = np.flatnonzero(batch.doc[:n] == batch.doc[size - 1:])
    anchor = smallest(hashes, size - anchor_words + 1)[at]
    if bits is None:
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1) | (batch.doc[at[1:]] != batch.doc[at[:-1]])
        first, last = at[new], at[np.append(np.flatnonzero(new)[1:], len(at)) - 1] + size if len(at) else at
        anchor = anchor[new]
    else:
        bit = anchor & np.uint64(ANCHOR_BITS - 1)
        own = (bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0
        first, last, anchor = at[own], at[own] + size, np.zeros(int(own.sum()), np.uint64)  # no longer needed
    doc = batch.doc[first]
    return [code(first, last).view(np.int64), anchor.view(np.int64), doc, first - batch.bounds[doc], last - batch.bounds[doc]]


def ascending(late: np.ndarray, early: np.ndarray) -> list[int]:
    """Indices of the longest run that ascends on both sides (patience sorting); ``late`` ascends already."""
    tops: list[int] = []
    piles: list[int] = []
    back = np.full(len(late), -1)
    for i, b in enumerate(early.tolist()):
        k = bisect_left(tops, b)
        back[i] = piles[k - 1] if k else -1
        tops[k:k + 1], piles[k:k + 1] = [b], [i]
    out, at = [], piles[-1] if piles else -1
    while at >= 0:
        out.append(at)
        at = back[at]
    return out[::-1]


SPANS = T.StructType([T.StructField("code", T.LongType()), T.StructField("anchor", T.LongType()), T.StructField("id", T.LongType()),
                      T.StructField("word", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("known", T.BooleanType())])


def heads_and_later(rows: list[np.ndarray]) -> pa.RecordBatch:
    """Of each code the rows of its smallest id, and as known repeats those of all other ids. Rows: code, anchor, id, word, last."""
    order = np.lexsort((rows[3], rows[2], rows[0]))
    rows = [x[order] for x in rows]
    head = np.ones(len(order), bool)
    head[1:] = rows[0][1:] != rows[0][:-1]
    known = rows[2] != rows[2][np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    return pa.RecordBatch.from_arrays([pa.array(x.astype(t)) for x, t in zip(rows, (np.int64, np.int64, np.int64, np.int32, np.int32))] + [pa.array(known)], names=SPANS.names)


def held_spans(docs: DataFrame, size: int, anchor_words: int, bits=None) -> DataFrame:
    """The spans of ``docs`` (id, text). Pieces of a partition are sorted alone; which they are doesn't change what is known in the end."""
    ship(docs.sparkSession)

    def local(batches):
        held, n = [], 0
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).to_pylist()
            for part in pieces(texts):
                code, anchor, doc, word, last = spans(TextBatch(texts[part]), size, anchor_words, bits.value if bits else None)
                held.append([code, anchor, ids[part][doc], word, last])
                n += len(code)
                if n > PIECE:
                    yield heads_and_later([np.concatenate(x) for x in zip(*held)])
                    held, n = [], 0
        if held:
            yield heads_and_later([np.concatenate(x) for x in zip(*held)])

    return docs.mapInArrow(local, SPANS)


def repeats(near: DataFrame) -> DataFrame:
    """The rows of ``near`` whose code a smaller id has: those known, and among the heads all but the smallest id of all."""
    def across(batches):
        code0, id0 = np.empty(0, np.int64), np.empty(0, np.int64)  # the smallest id of the code that the batch before ended with
        for batch in batches:
            if not batch.num_rows:
                continue
            code = np.concatenate([code0, batch.column(0).to_numpy(zero_copy_only=False)])
            own = np.concatenate([id0, batch.column(2).to_numpy(zero_copy_only=False)])
            head = np.ones(len(code), bool)
            head[1:] = code[1:] != code[:-1]
            first = own[np.maximum.accumulate(np.where(head, np.arange(len(code)), 0))]
            yield batch.filter(pa.array((own != first)[len(code0):]))
            code0, id0 = code[-1:], first[-1:]

    heads = near.filter("NOT known").select("code", F.lit(0).cast("long").alias("anchor"), "id", "word", "last", "known")
    far = heads.repartition("code").sortWithinPartitions("code", "id").mapInArrow(across, SPANS)
    return near.filter("known").unionByName(far).select("id", F.array(*[F.col(c).cast("long") for c in ("word", "last", "code")]).alias("block"))


def anchor_bits(near: DataFrame) -> np.ndarray:
    """ANCHOR_BITS bits, set for the anchors of different spans. Other anchors may share a bit; that only adds windows to compare."""
    several = near.filter("NOT known").groupBy("anchor").agg(F.min("code").alias("a"), F.max("code").alias("b")).filter("a <> b")
    bit = F.col("anchor").bitwiseAND(F.lit(ANCHOR_BITS - 1))
    words = several.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, CAST(anchor & 63 AS INT)))").alias("bits")).toArrow()
    out = np.zeros(ANCHOR_BITS // 64, np.int64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def removed_blocks(docs: DataFrame, scratch: Scratch, line_words: int, block_words: int) -> DataFrame:
    """(id, blocks): the word ranges that each document loses, one after the other: first word, word behind the last, hash of the words."""
    line_words = min(line_words, block_words)
    whole = scratch.put("spans", held_spans(docs, block_words, line_words))
    bits = docs.sparkSession.sparkContext.broadcast(anchor_bits(whole))
    of_spans = scratch.put("of_spans", repeats(whole))
    scratch.drop("spans")
    scratch.free()
    windows = scratch.put("windows", held_spans(docs, block_words, line_words, bits))
    of_windows = scratch.put("of_windows", repeats(windows))
    scratch.drop("windows")
    scratch.free()
    return of_spans.union(of_windows).groupBy("id").agg(F.flatten(F.collect_list("block")).alias("blocks"))


RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed_words", T.LongType()), T.StructField("n_blocks", T.LongType())])


def cut_blocks(texts: list[str | None], blocks: list) -> dict[str, list]:
    """Texts without their blocks; a removed block takes the white space behind it along."""
    out: dict[str, list] = {"text": [], "n_words": [], "n_removed_words": [], "n_blocks": []}
    for part in pieces(texts):
        batch = TextBatch(texts[part])
        sums, begin = word_sums(batch) if any(blocks[part]) else (None, None)
        for i, (text, own) in enumerate(zip(texts[part], blocks[part])):
            w0, w1 = batch.bounds[i], batch.bounds[i + 1]
            asked = np.array(own or [], np.int64).reshape(-1, 3)
            asked = asked[asked[:, 1] <= w1 - w0]
            if len(asked):
                first, last, code = asked.T
                equal = span_code(sums[begin[i]:begin[i] + w1 - w0 + 1], first, last).view(np.int64) == code
                depth = np.bincount(first[equal], minlength=w1 - w0 + 1) - np.bincount(last[equal], minlength=w1 - w0 + 1)
                gone = np.cumsum(depth)[:-1] > 0
            else:
                gone = np.zeros(w1 - w0, bool)
            edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).reshape(-1, 2)
            if len(edge):
                starts, at, left = np.append(batch.start[w0:w1], batch.last[i]), batch.first[i], []
                for a, b in edge:
                    left.append(batch.raw[at:starts[a]].tobytes())
                    at = starts[b]
                text = b"".join([*left, batch.raw[at:batch.last[i]].tobytes()]).decode("utf-8", "surrogatepass")
            for k, x in zip(out, (text, w1 - w0, gone.sum(), len(edge))):
                out[k].append(x)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", line_words: int = LINE_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the blocks that an earlier document has; adds n_words (before), n_removed_words and n_blocks."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    blocks = scratch.put("blocks", removed_blocks(plain, scratch, line_words, block_words))
    scratch.drop("of_spans", "of_windows")
    scratch.free()
    base = docs.drop(*RESULT.names)
    key, found = fresh(docs, "block_id", "block_list")
    marked = blocks.select(F.col("id").alias(key), F.col("blocks").alias(found))
    joined = base.join(marked, base[id_col].cast("long") == F.col(key), "left")
    added = T.StructType([T.StructField(text_col, T.StringType()), *RESULT.fields])

    def cut(texts, own):
        made = cut_blocks(texts, own)
        return {text_col: made.pop("text")} | made

    made = add_columns(joined, [text_col, found], added, cut, rows=200)
    return made.select(*[c for c in docs.columns if c not in RESULT.names], *RESULT.names)
