"""Suffix-array dedup (operator 9): removes bytes covered by a string of ``length`` bytes that also starts in an earlier document.

Sorting every suffix of the corpus would shuffle each byte many times, so suffixes are sorted only where two documents can agree.
Every string of ``length`` bytes holds an anchor, a 16-byte gram chosen by content alone, so equal strings hold the same one:

1. The grams of all documents are grouped, from each input partition one row a gram; those of two documents or more are shared.
2. The surroundings of shared anchors are dealt by gram. Of equal surroundings in a partition the earliest document's are sent and
   the others are settled at once.
3. In a task the suffixes that start around an anchor are sorted to depth ``length`` by deep-shallow sorting: multikey quicksort by
   words of 8 bytes to a depth of 16, then blind tries, which branch at the first byte in which suffixes differ, order the groups
   with longer common prefixes. Equal suffixes end in one leaf; all but those of the smallest id are marked.
4. A document's marks cover its removed bytes.

Whole copies of an earlier document are found by digest and left out of 1 to 3. The surroundings of a gram in more than HOT
rows are dealt once more, by hashes of their suffixes, so that no task holds them all.

Defined results: null and empty texts have no bytes; a text shorter than ``length`` loses nothing; strings are judged on the input;
repeated rows give one row, and where an id has several texts the greatest one counts; rows with a null id are left out; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starslice.llm.anchors import GRAM, anchors, extents
from starslice.llm.common import Scratch, TextBatch, add_columns, mix64, one_text_per_id, pieces, ship
from starslice.llm.ngram_jaccard import grouped

HOT = 100_000
SHALLOW = 16
CHUNK = 8_000  # surroundings sorted at once


def equal_strings(group: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A number for each row of bytes, equal for equal rows of a group and for no others: deep-shallow sorting."""
    leaf = np.arange(len(rows))  # rows that stand alone keep their own
    order = np.argsort(group, kind="stable")
    head = np.ones(len(order), bool)
    head[1:] = group[order][1:] != group[order][:-1]

    def alone(head):
        return head & np.append(head[1:], True)

    # multikey quicksort: split each group by the next 8 bytes, rows that stand alone leave
    for depth in range(0, SHALLOW, 8):
        stay = ~alone(head)
        order, head = order[stay], head[stay]
        if not len(order):
            return leaf
        word = np.ascontiguousarray(rows[order, depth:depth + 8]).view(">u8").ravel().astype(np.uint64)
        number = np.cumsum(head)
        by = np.lexsort((word, number))
        order, word, number = order[by], word[by], number[by]
        head = np.ones(len(order), bool)
        head[1:] = (number[1:] != number[:-1]) | (word[1:] != word[:-1])
    # blind tries: a node compares its rows with the first of them and branches where they first differ
    while True:
        stay = ~alone(head)
        order, head = order[stay], head[stay]
        if not len(order):
            return leaf
        first = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
        differ = rows[order, SHALLOW:] != rows[order[first], SHALLOW:]
        at = differ.argmax(1)
        same = ~differ[np.arange(len(order)), at]
        leaf[order[same]] = order[first[same]]
        order, at, first = order[~same], at[~same], first[~same]
        if not len(order):
            return leaf
        byte = rows[order, SHALLOW + at]
        by = np.lexsort((byte, at, first))
        order, at, first, byte = order[by], at[by], first[by], byte[by]
        head = np.ones(len(order), bool)
        head[1:] = (first[1:] != first[:-1]) | (at[1:] != at[:-1]) | (byte[1:] != byte[:-1])


def surroundings(batch: TextBatch, at: np.ndarray, h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes around anchors, a row each, and how many of them before and behind belong to strings of the anchor inside its text."""
    reach = length - GRAM
    pad = np.zeros(reach + length, np.uint8)
    raw = np.concatenate([pad, batch.raw, pad])
    rows = np.lib.stride_tricks.sliding_window_view(raw, reach + length)[at + len(pad) - reach]
    doc = np.searchsorted(batch.last, at)
    before, behind = extents(h, at, reach + 1)
    before, behind = np.minimum(at - batch.first[doc], before), np.minimum(batch.last[doc] - at, GRAM + behind)
    inside = np.arange(reach + length)[None, :]
    rows = np.where((inside >= reach - before[:, None]) & (inside < reach + behind[:, None]), rows, 0).astype(np.uint8)
    return rows, before, behind


def marks(gram: np.ndarray, doc: np.ndarray, rows: np.ndarray, before: np.ndarray, behind: np.ndarray, length: int) -> np.ndarray:
    """Bit k of a row: the string that starts ``k`` bytes before the anchor also starts in an earlier document of these rows."""
    reach = length - GRAM
    k = np.arange(reach + 1)
    valid = (k[None, :] <= before[:, None]) & (length - k[None, :] <= behind[:, None])
    row, back = np.nonzero(valid)
    strings = np.lib.stride_tricks.sliding_window_view(rows, length, axis=1)[row, reach - back]
    _, number = np.unique(gram, return_inverse=True)
    leaf = equal_strings(number[row] * (reach + 1) + back, strings)
    low = np.full(len(leaf), np.iinfo(np.int64).max)
    np.minimum.at(low, leaf, doc[row])
    out = np.zeros(len(rows), np.int64)
    late = doc[row] > low[leaf]
    np.bitwise_or.at(out, row[late], np.int64(1) << back[late].astype(np.int64))
    return out


GRAMS = T.StructType([T.StructField("token", T.LongType()), T.StructField("id", T.LongType()), T.StructField("known", T.BooleanType())])
AROUND = T.StructType([T.StructField("gram", T.LongType()), T.StructField("id", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("before", T.IntegerType()),
                       T.StructField("behind", T.IntegerType()), T.StructField("bytes", T.BinaryType()), T.StructField("marks", T.LongType())])


def shared_grams(docs: DataFrame, scratch: Scratch, length: int) -> DataFrame:
    """(id, token): the grams of anchors of each document that another document has too."""
    def local(batches):
        tokens, ids = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for batch in batches:
            own, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for part in pieces(texts):
                b = TextBatch(texts[part])
                at, h, _ = anchors(b, length)
                doc = own[part][np.searchsorted(b.last, at)]
                order = np.lexsort((doc, h))
                h, doc = h[order].view(np.int64), doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                tokens.append(h[new])
                ids.append(doc[new])
        tokens, ids = np.concatenate(tokens), np.concatenate(ids)
        order = np.lexsort((ids, tokens))
        tokens, ids = tokens[order], ids[order]
        same = tokens[1:] == tokens[:-1]
        head, known = np.ones(len(tokens), bool), np.zeros(len(tokens), bool)
        head[1:] = ~same
        known[1:] |= same
        known[:-1] |= same
        # one row of a gram goes on to the other partitions; those of a gram that is shared here are known
        for rows, flag in ((np.flatnonzero(head), False), (np.flatnonzero(known), True)):
            for a in range(0, len(rows), 200_000):
                some = rows[a:a + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(tokens[some]), pa.array(ids[some]), pa.array(np.full(len(some), flag))], names=GRAMS.names)

    found = docs.mapInArrow(local, GRAMS)
    found = scratch.put("grams", found)
    across = grouped(found.filter("NOT known"))
    return found.filter("known").select("token", "id").unionByName(across.select("token", "id"))


def around_shared(texts: DataFrame, length: int) -> DataFrame:
    """A row for each shared anchor; ``texts`` is (id, text, tokens). Rows with marks are settled, the others have their bytes."""
    def local(batches):
        seen: dict[bytes, int] = {}
        held = []
        for batch in batches:
            own, body, grams = (batch.column(k) for k in range(3))
            own, body = own.to_numpy(zero_copy_only=False), body.to_pylist()
            for part in pieces(body):
                b = TextBatch(body[part])
                at, h, all_h = anchors(b, length)
                doc = np.searchsorted(b.last, at)
                wanted = [np.asarray(x.values).view(np.uint64) for x in grams[part.start:part.stop]]
                if not len(at) or not wanted:
                    continue
                pairs = mix64(np.concatenate(wanted) ^ mix64(np.repeat(np.arange(len(wanted)), [len(x) for x in wanted]).astype(np.uint64), 8))
                keep = np.isin(mix64(h ^ mix64(doc.astype(np.uint64), 8)), pairs)
                at, h, doc = at[keep], h[keep], doc[keep]
                for a in range(0, len(at), 50_000):
                    some = slice(a, a + 50_000)
                    rows, before, behind = surroundings(b, at[some], all_h, length)
                    held.append((h[some].view(np.int64), own[part][doc[some]], (at[some] - b.first[doc[some]]).astype(np.int32), before.astype(np.int32), behind.astype(np.int32), rows))
        if not held:
            return
        gram, doc, at, before, behind, rows = (np.concatenate([x[k] for x in held]) for k in range(6))
        held.clear()
        # equal surroundings in this partition: the earliest document's go on, of the others every string is marked
        code = np.ascontiguousarray(np.concatenate([rows, np.stack([before, behind], 1).astype(np.uint8)], axis=1))
        _, which = np.unique(code.view(np.dtype((np.void, code.shape[1]))).ravel(), return_inverse=True)
        low = np.full(which.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, which, doc)
        later = doc > low[which]
        k = np.arange(length - GRAM + 1)
        bits = ((k[None, :] <= before[:, None]) & (length - k[None, :] <= behind[:, None])) @ (np.int64(1) << k.astype(np.int64))
        for a in range(0, len(doc), 20_000):
            s = slice(a, a + 20_000)
            data = [None if gone else x.tobytes() for gone, x in zip(later[s], rows[s])]
            yield pa.RecordBatch.from_arrays([
                pa.array(gram[s]), pa.array(doc[s]), pa.array(at[s]), pa.array(before[s]), pa.array(behind[s]), pa.array(data, pa.binary()),
                pa.array(bits[s], mask=~later[s])], names=AROUND.names)

    return texts.mapInArrow(local, AROUND)


MARKS = T.StructType([T.StructField("id", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("marks", T.LongType())])


def sorted_marks(around: DataFrame, length: int) -> DataFrame:
    """Marks of the rows of each gram; grams stream by and are sorted some thousand rows at a time, whole grams together."""
    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) < CHUNK:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            gram = table.column("gram").to_numpy()
            cut = int(np.flatnonzero(gram != gram[-1])[-1]) + 1 if gram[0] != gram[-1] else 0
            if cut:
                yield from done(table.slice(0, cut))
            held = table.slice(cut).to_batches()
        if held:
            yield from done(pa.Table.from_batches(held))

    def done(table):
        if not table.num_rows:
            return
        gram, doc, before, behind = (table.column(k).to_numpy() for k in ("gram", "id", "before", "behind"))
        rows = np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.uint8).reshape(len(doc), -1)
        ends = np.flatnonzero(np.append(gram[1:] != gram[:-1], True)) + 1
        start = 0
        for k, end in enumerate(ends):
            if end - start >= CHUNK or k == len(ends) - 1:
                found = marks(gram[start:end], doc[start:end], rows[start:end], before[start:end], behind[start:end], length)
                some = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays([pa.array(doc[start:end][some]), pa.array(table.column("at").to_numpy()[start:end][some]), pa.array(found[some])], names=MARKS.names)
                start = end

    return around.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, MARKS)


def hot_marks(around: DataFrame, length: int) -> DataFrame:
    """Marks of the rows of grams that are too frequent for one task: every string is dealt by its own hash."""
    reach = length - GRAM
    k = F.explode(F.sequence(F.lit(0), F.least(F.col("before"), F.lit(reach)))).alias("k")
    strings = around.select("gram", "id", "at", "behind", "bytes", k).filter(F.col("behind") >= length - F.col("k"))
    strings = strings.select("id", "at", "k", F.sha2(F.concat(F.substring("bytes", reach + 1 - F.col("k"), F.lit(length)), F.col("k").cast("string").cast("binary")), 256).alias("code"))
    low = strings.groupBy("code").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low <> high")
    late = strings.join(low, "code").filter("id > low").select("id", "at", "k").distinct()
    return late.groupBy("id", "at").agg(F.expr("bit_or(shiftleft(1L, k))").alias("marks"))


KEPT = T.StructType([T.StructField("kept", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType())])


def dedup_suffixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """(id_col, kept, n_bytes, n_removed, n_spans) for each id: its bytes without those that repeat an earlier document's.

    ``length`` is from 17 to 79: the marks of an anchor are the bits of a long.
    """
    if not GRAM < length <= GRAM + 63:
        raise ValueError(f"length must be from {GRAM + 1} to {GRAM + 63}")
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    plain = one_text_per_id(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), scratch)
    digest = plain.select("id", F.md5(F.coalesce("text", F.lit(""))).alias("d"))
    copies = scratch.put("copies", digest.join(digest.groupBy("d").agg(F.min("id").alias("first")), "d").filter("id <> first").select("id"))
    shared = scratch.put("shared", shared_grams(plain, scratch, length).join(copies, "id", "left_anti").groupBy("id").agg(F.collect_set("token").alias("tokens")))
    scratch.drop("grams")
    scratch.free()
    around = scratch.put("around", around_shared(plain.join(shared, "id").select("id", "text", "tokens"), length))
    scratch.free()
    settled = around.filter("marks IS NOT NULL").select("id", "at", "marks")
    rest = around.filter("marks IS NULL").drop("marks")
    hot = scratch.put("hot", rest.groupBy("gram").count().filter(F.col("count") > HOT).select("gram"))
    if hot.limit(1).count():
        found = sorted_marks(rest.join(hot, "gram", "left_anti"), length).unionByName(hot_marks(rest.join(hot, "gram", "left_semi"), length))
    else:
        found = sorted_marks(rest, length)
    found = settled.unionByName(found).groupBy("id").agg(F.collect_list(F.struct("at", "marks")).alias("found"))
    found = scratch.put("found", found)
    scratch.drop("around", "shared")
    scratch.free()
    extra = found.select("id", "found", F.lit(False).alias("copy")).unionByName(copies.select("id", F.lit(None).cast(found.schema["found"].dataType).alias("found"), F.lit(True).alias("copy")))

    def keep(texts, found, copy):
        out = {k: [] for k in KEPT.names}
        for text, own, whole in zip(texts, found, copy):
            raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
            step = np.zeros(len(raw) + 1, np.int64)
            if whole and len(raw) >= length:
                step[0], step[-1] = 1, -1
            elif own:
                at = np.array([x["at"] for x in own], np.int64)
                bits = np.array([x["marks"] for x in own], np.int64)
                row, back = np.nonzero((bits[:, None] >> np.arange(length - GRAM + 1)) & 1)
                start = np.unique(at[row] - back)
                step[start] += 1
                step[start + length] -= 1
            gone = np.cumsum(step)[:-1] > 0
            out["kept"].append(raw[~gone].tobytes())
            for k, x in zip(KEPT.names[1:], (len(raw), gone.sum(), (np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())):
                out[k].append(int(x))
        return out

    return add_columns(plain.join(extra, "id", "left"), ["text", "found", "copy"], KEPT, keep, rows=200).select(F.col("id").alias(id_col), *KEPT.names)

