"""Quality classifier (operator 3): a weak-label model trains a hashed linear scorer.

Two questions are asked of each document: is its form sound, and is its language civil. For each, overlapping heuristic
labellers vote good, bad or abstain; expectation-maximisation over the vote patterns of all documents estimates how often each
labeller is right; the posterior of a bounded sample of documents trains a sparse linear scorer over hashed features (word
stems and binned form counts); the scorer judges every whole text.

Defined results: a null or empty text has no features and gets the scorer's bias; repeated rows get equal scores; with no
documents to learn from every document is kept; columns named like the outputs are replaced; null ids are kept and scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starslice.llm.common import Scratch, TextBatch, add_columns, mix64, pieces
from starslice.llm.shape import BAD, FORM_LABELLERS, form_values, form_votes, shapes
from starslice.llm.weak import VoteModel, fit_votes, pattern_counts

BUCKETS = 1 << 20
STEMS = (5, 6, 7, 8)  # bytes
LETTER = np.isin(np.arange(256), [*range(97, 123), *range(128, 256)])
# Common English insults.
INSULTS = "idiot moron stupid loser scum trash pathetic worthless disgusting clown imbecile dumbass bastard bitch".split()
CIVIL = 4  # labellers of language: insults, mined stems, mined words, an annotator's label
BINS = 21


def insult_hashes() -> np.ndarray:
    own = TextBatch([" ".join(INSULTS)])
    return own.word_hash()


class Features:
    """Hashed features of a batch of whole texts. ``doc``/``bucket``: a stem of a word of a text, with repeats."""

    def __init__(self, texts: list[str | None]):
        form = TextBatch(texts)
        self.values, self.n = form_values(shapes(form)), form.n
        text = TextBatch(texts, lower=True)
        letter = np.concatenate([[False], LETTER[text.raw], [False]])
        edge = np.flatnonzero(letter[1:] != letter[:-1])
        start, end = edge[0::2], edge[1::2]
        self.word_doc, self.word = np.searchsorted(text.last, start), text.span_hash(start, end)
        raw, head = np.concatenate([text.raw, np.zeros(8, np.uint8)]), np.zeros(len(start), np.uint64)
        for k in range(8):
            head |= raw[start + k].astype(np.uint64) << np.uint64(56 - 8 * k)
        doc, bucket = [], []
        for k in STEMS:
            own = np.flatnonzero(end - start >= k)
            doc.append(self.word_doc[own])
            bucket.append((mix64(head[own] >> np.uint64(64 - 8 * k), k) % np.uint64(BUCKETS)).astype(np.int64))
        self.doc, self.bucket = np.concatenate(doc), np.concatenate(bucket)
        step = np.where(np.isnan(self.values), BINS, np.minimum(BINS - 1, np.nan_to_num(self.values) / BAD * BINS)).astype(np.uint64)
        kind = np.arange(self.values.shape[1], dtype=np.uint64) * np.uint64(100)
        self.form_bucket = (mix64(step + kind, 99) % np.uint64(BUCKETS)).astype(np.int64)  # texts x measures

    def any_of(self, doc: np.ndarray, flags: np.ndarray) -> np.ndarray:
        return np.bincount(doc[flags], minlength=self.n) > 0

    def of_each(self) -> list[np.ndarray]:
        """Distinct stem buckets of each text."""
        keys = np.unique(self.doc * BUCKETS + self.bucket)
        return np.split((keys % BUCKETS).astype(np.int32), np.searchsorted(keys, np.arange(1, self.n) * BUCKETS))

    def words_of_each(self) -> list[np.ndarray]:
        """Distinct word hashes (signed) of each text."""
        cut = np.searchsorted(self.word_doc, np.arange(1, self.n))
        return [np.unique(x.view(np.int64)) for x in np.split(self.word, cut)]


@dataclass(frozen=True)
class Ragged:
    """Arrays of several rows in one flat array: row k is ``values[starts[k]:starts[k + 1]]``. Large arrays go back to the system when they are let go."""

    values: np.ndarray
    starts: np.ndarray

    @classmethod
    def read(cls, df: DataFrame, column: str) -> Ragged:
        """One array column of a bounded table."""
        found = df.select(column).toArrow().column(0).combine_chunks()
        found = found.chunk(0) if isinstance(found, pa.ChunkedArray) else found
        return cls(found.flatten().to_numpy().copy(), np.concatenate([[0], np.cumsum(found.value_lengths().to_numpy())]).astype(np.int64))

    def __len__(self) -> int:
        return len(self.starts) - 1

    def __getitem__(self, k: int) -> np.ndarray:
        return self.values[self.starts[k]:self.starts[k + 1]]

    def take(self, rows: np.ndarray) -> Ragged:
        size = np.diff(self.starts)[rows]
        starts = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        at = np.arange(starts[-1]) + np.repeat(self.starts[:-1][rows] - starts[:-1], size)
        return Ragged(self.values[at], starts)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self), dtype=np.int32), np.diff(self.starts))


@dataclass(frozen=True)
class Mined:
    """Word hashes and stem buckets that the labelled rows tie to uncivil texts."""

    words: np.ndarray
    stems: np.ndarray

    def votes(self, f: Features, labels: list[int | None] | None = None) -> np.ndarray:
        def found(doc, flags, known):
            return np.where(f.any_of(doc, flags), 0, 1) if known else np.full(f.n, -1)

        insult = np.where(f.any_of(f.word_doc, np.isin(f.word, insult_hashes())), 0, -1)
        mark = np.full(f.n, -1) if labels is None else np.array([-1 if x is None else int(x == 0) for x in labels])
        return np.stack([insult, found(f.doc, np.isin(f.bucket, self.stems), len(self.stems)),
                         found(f.word_doc, np.isin(f.word.view(np.int64), self.words), len(self.words)), mark], axis=1)


@dataclass(frozen=True)
class Scorer:
    """Sparse weights over hashed features; ``at`` ascends."""

    at: np.ndarray
    weight: np.ndarray
    bias: float

    def p(self, n: int, doc: np.ndarray, bucket: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Probability of good for each of ``n`` texts; ``dense`` is ``self.dense()``. A feature counts once in a text."""
        at = np.flatnonzero(dense[bucket])
        pairs = np.unique(doc[at] * BUCKETS + bucket[at])
        z = self.bias + np.bincount(pairs // BUCKETS, dense[pairs % BUCKETS], n)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    def dense(self) -> np.ndarray:
        out = np.zeros(BUCKETS)
        out[self.at] = self.weight
        return out


def train_scorer(rows: Ragged, target: np.ndarray, penalty: float = 4e-4, rounds: int = 100) -> Scorer:
    """Logistic regression on soft labels with an L1 penalty, by accelerated proximal gradient; no rows: everything is good."""
    if not len(rows):
        return Scorer(np.empty(0, np.int64), np.empty(0), 5.0)
    target = np.asarray(target, float)
    bucket, row = rows.values, rows.row()
    seen = np.bincount(bucket, minlength=BUCKETS)
    often = seen >= 3  # one or two documents say nothing about others
    keep, at = often[bucket], np.flatnonzero(often)
    row, column = row[keep], (np.cumsum(often, dtype=np.int32) - 1)[bucket[keep]]
    scale = 1 / np.sqrt(np.maximum(1, seen[often] / len(rows) * 50))  # common features step less
    del bucket, keep
    bias = float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)))
    w = y = np.zeros(len(at))
    t, n, step = 1.0, len(rows), 0.5
    parts = [slice(k, k + 1_000_000) for k in range(0, max(1, len(row)), 1_000_000)]  # bounds the working memory
    last = np.inf
    for _ in range(rounds):
        step_of, z = scale * y, np.full(n, bias)
        for part in parts:
            z += np.bincount(row[part], step_of[column[part]], n)
        p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        gap = p - target
        gradient = scale * sum(np.bincount(column[part], gap[row[part]], len(at)) for part in parts) / n
        loss = float(np.mean(np.logaddexp(0, z) - target * z))
        if loss > last + 1e-3:
            step, t, y = step / 2, 1.0, w
            last = np.inf
            continue
        last = loss
        new = y - step * gradient
        new = np.sign(new) * np.maximum(0, np.abs(new) - step * penalty * scale)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y, w = new + (before - 1) / t * (new - w), new
        bias -= 0.5 * gap.mean()
    used = w != 0
    return Scorer(at[used], (scale * w)[used], bias)


@dataclass(frozen=True)
class QualityModel:
    form_votes: VoteModel
    civil_votes: VoteModel
    mined: Mined
    form: Scorer
    civil: Scorer


def sample_of(docs: DataFrame, labels: DataFrame | None, id_col: str, text_col: str, limit: int) -> DataFrame:
    """At most ``limit`` documents to learn from, labelled ones where there are labels, in the order of a hash of their id."""
    names = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    if labels is not None:
        marks = labels.groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").alias("_label"))
        chosen = marks.filter(F.col("_id").isNotNull()).orderBy(F.xxhash64("_id"), "_id").limit(limit)
    else:
        chosen = names.select("_id").filter(F.col("_id").isNotNull()).distinct().orderBy(F.xxhash64("_id"), "_id").limit(limit).withColumn("_label", F.lit(None).cast("int"))
    texts = names.join(F.broadcast(chosen), "_id")  # bounded by ``limit``
    return texts.groupBy("_id", "_label").agg(F.max("_text").alias("_text"))


def mine(terms: Ragged, labels: list[int | None], odds: float = 6.0) -> np.ndarray:
    """Terms ``odds`` times as frequent in uncivil documents as in the others, with a log-likelihood ratio of 2 ln(terms) or more.

    Of that many terms, chance ties less than one so closely to uncivil documents.
    """
    known = np.array([k for k, x in enumerate(labels) if x is not None], np.int64)
    if not len(known):
        return np.empty(0, np.int64)
    bad = np.array([labels[k] != 0 for k in known])
    of_bad, of_good = (terms.take(known[bad == side]).values for side in (True, False))
    every, a = np.unique(of_bad, return_counts=True)  # only terms of uncivil documents can be tied to them
    where = np.minimum(np.searchsorted(every, of_good), max(0, len(every) - 1))
    b = np.bincount(where[every[where] == of_good] if len(every) else where[:0], minlength=len(every))
    del of_bad, of_good, where
    share = bad.mean()
    if not 0 < share < 1:
        return np.empty(0, np.int64)
    n = a + b
    ratio = 2 * (a * np.log(np.maximum(a, 1e-9) / (n * share)) + b * np.log(np.maximum(b, 1e-9) / (n * (1 - share))))
    return every[(ratio >= 2 * np.log(max(len(every), 2))) & (a / bad.sum() >= odds * (b + 0.5) / ((~bad).sum() + 1))]


def one_of_each(words: Ragged, seeds: int = 6, smallest: int = 3) -> list[int]:
    """Rows of a sample without later near copies: those that share the smallest hashed words under any of several orders.

    A text copied many times would else tie all of its words to its label.
    """
    seen, keep = set(), []
    for k in range(len(words)):
        own, keys = words[k], []
        for seed in range(seeds):
            mixed = mix64(own.view(np.uint64), 200 + seed)
            keys.append((seed, *np.sort(mixed if len(mixed) <= smallest else np.partition(mixed, smallest)[:smallest]).tolist()))
        if seen.isdisjoint(keys):
            keep.append(k)
        seen.update(keys)
    return keep


def fit(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", sample: int = 10_000) -> QualityModel:
    """Fit both vote models on all documents and both scorers on at most ``sample`` documents."""
    spark = docs.sparkSession

    def features(texts):
        out = {"f": [], "w": [], "b": [], "v": []}
        for part in pieces(texts):
            f = Features(texts[part])
            for k, x in zip("fwbv", (f.of_each(), f.words_of_each(), f.form_bucket.tolist(), form_votes(f.values).tolist())):
                out[k] += x
        return out

    longs, ints = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())
    kinds = T.StructType([T.StructField("f", ints), T.StructField("w", longs), T.StructField("b", ints), T.StructField("v", ints)])
    chosen = add_columns(sample_of(docs, labels, id_col, text_col, sample), ["_text"], kinds, features).select("_id", "_label", "f", "w", "b", "v")
    scratch = Scratch(spark, "quality-classifier")
    learn = scratch.put("sample", chosen).orderBy("_id")  # at most ``sample`` rows, taken a column at a time: the driver holds two of them at most
    marks = [r[0] for r in learn.select("_label").collect()]
    words = Ragged.read(learn, "w")
    keep = np.array(one_of_each(words), np.int64)
    marks, words = [marks[k] for k in keep], words.take(keep)
    rows = Ragged.read(learn, "f").take(keep)
    mined = Mined(mine(words, marks), mine(rows, marks))
    civil_of = np.full((len(rows), CIVIL), -1)
    insults = insult_hashes().view(np.int64)
    for k, mark in enumerate(marks):
        civil_of[k] = [0 if np.isin(insults, words[k]).any() else -1,
                       -1 if not len(mined.stems) else 0 if np.isin(rows[k], mined.stems).any() else 1,
                       -1 if not len(mined.words) else 0 if np.isin(words[k], mined.words).any() else 1, -1 if mark is None else int(mark == 0)]
    del rows, words
    known = spark.sparkContext.broadcast(mined)

    def vote(texts):
        out = []
        for part in pieces(texts):
            f = Features(texts[part])
            out += np.concatenate([form_votes(f.values), known.value.votes(f)], axis=1).tolist()
        return {"_votes": out}

    votes = add_columns(docs.select(F.col(text_col).alias("_text")), ["_text"], T.StructType([T.StructField("_votes", T.ArrayType(T.IntegerType()))]), vote)
    patterns, counts = pattern_counts(votes.select("_votes"), "_votes")
    known.destroy()
    patterns = patterns.reshape(-1, FORM_LABELLERS + CIVIL)
    form_model = fit_votes(patterns[:, :FORM_LABELLERS], counts, FORM_LABELLERS)
    # labelled rows of the sample stand in with their annotator's vote, which the scan of all rows doesn't have
    both = np.concatenate([patterns[:, FORM_LABELLERS:], civil_of])
    civil_model = fit_votes(both, np.concatenate([counts, np.ones(len(civil_of))]), CIVIL, prior=0.9)
    form_of = Ragged.read(learn, "v").take(keep).values.reshape(-1, FORM_LABELLERS).astype(int)
    form = train_scorer(Ragged.read(learn, "b").take(keep), form_model.posterior(form_of), penalty=1e-4, rounds=400)
    civil = train_scorer(Ragged.read(learn, "f").take(keep), civil_model.posterior(civil_of))
    scratch.drop("sample")
    return QualityModel(form_model, civil_model, mined, form, civil)


SCORES = T.StructType([T.StructField("p_form", T.DoubleType()), T.StructField("p_civil", T.DoubleType()), T.StructField("keep", T.BooleanType())])


def classify(docs: DataFrame, model: QualityModel, text_col: str = "text", sound: float = 0.5, civil: float = 0.6, only_kept: bool = False) -> DataFrame:
    """``docs`` with the two probabilities and ``keep``: both reach their thresholds. With ``only_kept`` the others go."""
    shared = docs.sparkSession.sparkContext.broadcast((model.form, model.civil))
    dense: list[np.ndarray] = []

    def score(texts):
        scorers = shared.value
        if not dense:  # once in a task
            dense.extend(s.dense() for s in scorers)
        out = {"p_form": [], "p_civil": [], "keep": []}
        for part in pieces(texts):
            f = Features(texts[part])
            each = np.repeat(np.arange(f.n), f.form_bucket.shape[1])
            a = scorers[0].p(f.n, each, f.form_bucket.ravel(), dense[0]).round(9)
            b = scorers[1].p(f.n, f.doc, f.bucket, dense[1]).round(9)
            for k, x in zip(out, (a, b, (a >= sound) & (b >= civil))):
                out[k] += x.tolist()
        return out

    return add_columns(docs, [text_col], SCORES, score, keep="keep" if only_kept else None)
