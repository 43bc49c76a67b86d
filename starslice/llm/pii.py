"""PII (operator 1): a linear-chain conditional random field over word-shape features adds spans to those of base patterns.

The base finds emails, addresses, card and phone numbers by pattern in whole texts. The field labels words: outside, or begin or
inside of a kind. It is trained from a small labelled table (texts and their spans) by gradient ascent on the exact likelihood, and
decoded by Viterbi in numpy batches. A word with neither a digit nor an @ is always outside, so chains fall apart there and only
the runs between such words are decoded, which is exact. A run that is labelled as a kind becomes a span unless it touches a base
span or the field is not sure of it.

Defined results: null and empty texts have no spans; offsets are code points, the end exclusive; repeated rows get equal spans; null
ids are kept; columns named like the outputs are replaced; with an empty labelled table there are base spans only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starslice.llm.common import add_columns

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + 2 * len(KINDS)  # outside, begin of each kind, inside of each kind
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a match never starts inside a run of digits: one from the run's start would have been found first
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
MARKED = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ so that a long run of letters is read once."""
    done, at = 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        start = at
        if domain:
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                yield start, domain.end()
                done = domain.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind as listed and then by start."""
    if not text:
        return []
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def runs_of(text: str | None) -> list[list[tuple[int, int]]]:
    """Runs of neighbouring words that hold a digit or an @: (start, end) of each word."""
    runs: list[list[tuple[int, int]]] = []
    for m in MARKED.finditer(text or ""):
        a, b = m.span()
        if runs and not text[runs[-1][-1][1]:a].strip(" \t\n\x0b\x0c\r"):
            runs[-1].append((a, b))
        else:
            runs.append([(a, b)])
    return runs


def bin_of(n: int, bounds: tuple[int, ...]) -> int:
    return sum(n >= b for b in bounds)


DIGITS, LETTERS, DOTS = (1, 2, 3, 4, 5, 8, 10, 13, 16, 20), (1, 2, 4, 8), (1, 2, 3, 4)
# each slot of features: its number of values. A word has one value of each slot, and those of its neighbours.
OWN = (len(DIGITS) + 1, len(LETTERS) + 1, len(DOTS) + 1, 3, 4, 4, 2, 3, 3)
SLOTS = (*OWN, *OWN, *OWN)
OFFSETS = np.concatenate([[0], np.cumsum(SLOTS)])
FEATURES = int(OFFSETS[-1])


def word_shape(word: str) -> tuple[int, ...]:
    """Shape of a word: binned counts, marks, first and last character, and whether its digits could be a card or an address."""
    core = word.strip(".,;:!?\"'<>[]{}#*$%&|")
    digits = sum("0" <= c <= "9" for c in core)
    letters = sum(c.isalpha() for c in core)
    first, last = core[:1], core[-1:]
    parts = core.split(".")
    address = 0 if len(parts) != 4 or not all(p.isdigit() and p.isascii() for p in parts) else 1 + all(len(p) <= 3 and int(p) <= 255 for p in parts)
    plain = core.replace("-", "")
    number = 0 if not (plain.isdigit() and plain.isascii() and 12 <= len(plain) <= 19) else 1 + luhn(plain)
    mail = 0 if "@" not in core else 1 + bool(re.fullmatch(r"[^@]+@[^@.]+(\.[^@.]+)+", core))
    return (bin_of(digits, DIGITS), bin_of(letters, LETTERS), bin_of(core.count("."), DOTS), mail, {"+": 1, "(": 2}.get(first, 3 if first.isdigit() else 0),
            1 if last == ")" else 2 if last.isdigit() else 3 if last.isalpha() else 0, int("-" in core), address, number)


NOTHING = (0,) * len(OWN)


def features_of(text: str, run: list[tuple[int, int]]) -> np.ndarray:
    """Indices of the features of each word of a run; the words around the run have no shape."""
    shapes = [NOTHING, *[word_shape(text[a:b]) for a, b in run], NOTHING]
    rows = np.array([shapes[k] + shapes[k - 1] + shapes[k + 1] for k in range(1, len(shapes) - 1)])
    return rows + OFFSETS[:-1]


def allowed() -> np.ndarray:
    """0 where a label may follow another, else minus infinity: inside follows begin or inside of its kind. The last row starts a run."""
    k = len(KINDS)
    out = np.zeros((LABELS + 1, LABELS))
    for kind in range(k):
        inside = 1 + k + kind
        out[:, inside] = -np.inf
        out[[1 + kind, inside], inside] = 0
    return out


@dataclass(frozen=True)
class Field:
    """Weights of feature and label, and of a label after another (last row: at the start of a run)."""

    emit: np.ndarray
    step: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        return self.emit[features].sum(-2)

    def decode(self, runs: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """Best labels of each run (Viterbi), and the log-probability of each run's labelling. Runs go in batches of equal length."""
        out: list = [None] * len(runs)
        sure = np.zeros(len(runs))
        length = np.array([len(r) for r in runs], int)
        move = self.step + allowed()
        for n in np.unique(length):
            own = np.flatnonzero(length == n)
            for part in range(0, len(own), max(1, 200_000 // int(n))):
                at = own[part:part + max(1, 200_000 // int(n))]
                score = self.scores(np.stack([runs[i] for i in at]))
                best, total, back = move[-1] + score[:, 0], move[-1] + score[:, 0], []
                for t in range(1, n):
                    ways = best[:, :, None] + move[None, :-1]
                    back.append(ways.argmax(1))
                    best = ways.max(1) + score[:, t]
                    total = np.logaddexp.reduce(total[:, :, None] + move[None, :-1], axis=1) + score[:, t]
                labels = np.empty((len(at), n), int)
                labels[:, -1] = best.argmax(1)
                for t in range(n - 2, -1, -1):
                    labels[:, t] = back[t][np.arange(len(at)), labels[:, t + 1]]
                sure[at] = best.max(1) - np.logaddexp.reduce(total, axis=1)
                for i, row in zip(at, labels):
                    out[i] = row
        return out, sure


def train(runs: list[np.ndarray], labels: list[np.ndarray], rounds: int = 200, penalty: float = 0.01) -> Field:
    """Maximum likelihood with a quadratic penalty, by Adam on gradients from forward and backward sums; whole batches of equal length."""
    emit, step = np.zeros((FEATURES, LABELS)), np.zeros((LABELS + 1, LABELS))
    if not runs:
        emit[:, 0] = 1.0
        return Field(emit, step)
    length = np.array([len(r) for r in runs])
    batches = [(np.stack([runs[i] for i in own]), np.stack([labels[i] for i in own])) for n in np.unique(length) for own in [np.flatnonzero(length == n)]]
    rule, total = allowed(), len(runs)
    m1, m2 = [np.zeros_like(emit), np.zeros_like(step)], [np.zeros_like(emit), np.zeros_like(step)]
    for k in range(1, rounds + 1):
        grad_emit, grad_step = -penalty * emit, -penalty * step
        move = step + rule
        for f, y in batches:
            score, n = emit[f].sum(-2), f.shape[1]
            forward = [move[-1] + score[:, 0]]
            for t in range(1, n):
                forward.append(np.logaddexp.reduce(forward[-1][:, :, None] + move[None, :-1], axis=1) + score[:, t])
            z = np.logaddexp.reduce(forward[-1], axis=1)
            backward = np.zeros_like(forward[0])
            for t in range(n - 1, -1, -1):
                gap = -np.exp(forward[t] + backward - z[:, None])
                gap[np.arange(len(y)), y[:, t]] += 1
                for slot in range(f.shape[2]):
                    np.add.at(grad_emit, f[:, t, slot], gap / total)
                if t:
                    pair = np.exp(forward[t - 1][:, :, None] + move[None, :-1] + (score[:, t] + backward)[:, None, :] - z[:, None, None])
                    grad_step[:-1] -= pair.sum(0) / total
                    np.add.at(grad_step, (y[:, t - 1], y[:, t]), 1 / total)
                    backward = np.logaddexp.reduce(move[None, :-1] + (score[:, t] + backward)[:, None, :], axis=2)
                else:
                    grad_step[-1] += gap.sum(0) / total
        for i, (w, g) in enumerate(((emit, grad_emit), (step, grad_step))):
            m1[i] = 0.9 * m1[i] + 0.1 * g
            m2[i] = 0.999 * m2[i] + 0.001 * g * g
            w += 0.1 * (m1[i] / (1 - 0.9 ** k)) / (np.sqrt(m2[i] / (1 - 0.999 ** k)) + 1e-8)
    return Field(emit, step)


def run_labels(run: list[tuple[int, int]], spans: list[tuple[str, int, int]]) -> np.ndarray:
    """Labels of a run's words: a word that overlaps a span is its begin, if it is the span's first, or its inside."""
    out, held = np.zeros(len(run), int), None
    for k, (a, b) in enumerate(run):
        own = next((s for s in spans if s[1] < b and s[2] > a), None)
        if own:
            kind = KINDS.index(own[0])
            out[k] = 1 + len(KINDS) + kind if own == held else 1 + kind
        held = own
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def labelled_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 2000) -> DataFrame:
    """A small labelled table (text, spans) where nobody has labelled one: at most ``limit`` documents in the order of a hash of their
    id, with their base spans."""
    ids = docs.select(F.col(id_col).alias("_id")).filter("_id IS NOT NULL").distinct().orderBy(F.xxhash64("_id"), "_id").limit(limit)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "_id")  # bounded by ``limit``
    return add_columns(texts, ["text"], T.StructType([T.StructField("spans", SPANS)]),
                       lambda texts: {"spans": [[dict(kind=k, start=a, end=b) for k, a, b in base_spans(t)] for t in texts]}).select("_id", "text", "spans")


def fit(labelled: DataFrame, rounds: int = 200) -> Field:
    """Train on a labelled table (text, spans), which is small: its runs are gathered on the driver."""
    def rows(texts, spans):
        out = {"f": [], "y": []}
        for text, own in zip(texts, spans):
            own = [(s["kind"], s["start"], s["end"]) for s in own or []]
            runs = runs_of(text)
            out["f"].append([features_of(text, r).ravel().tolist() for r in runs])
            out["y"].append([run_labels(r, own).tolist() for r in runs])
        return out

    lists = T.ArrayType(T.ArrayType(T.IntegerType()))
    made = add_columns(labelled.select("text", "spans"), ["text", "spans"], T.StructType([T.StructField("f", lists), T.StructField("y", lists)]), rows).select("f", "y")
    found = sorted((tuple(f), tuple(y)) for r in made.collect() for f, y in zip(r["f"], r["y"]))
    return train([np.array(f).reshape(-1, len(SLOTS)) for f, _ in found], [np.array(y) for _, y in found], rounds)


def added_spans(texts: list[str | None], base: list[list[tuple[str, int, int]]], field: Field, sure: float) -> list[list[tuple[str, int, int]]]:
    """Spans of the field's labels, without those that touch a base span or a run of which it is less than ``sure``."""
    runs, where = [], []
    for i, text in enumerate(texts):
        for run in runs_of(text):
            runs.append(run)
            where.append(i)
    labels, log_p = field.decode([features_of(texts[i], r) for i, r in zip(where, runs)])
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    n = len(KINDS)
    for i, run, row, p in zip(where, runs, labels, log_p):
        if p < np.log(sure) or not row.any():
            continue
        found: list[list] = []
        for (a, b), y in zip(run, row):
            if 1 <= y <= n:
                found.append([KINDS[y - 1], a, b])
            elif y > n:
                found[-1][2] = b
        text = texts[i]
        for kind, a, b in found:
            edge = " \t\n\x0b\x0c\r.,;:!?\"'<>[]{}#*$%&|"
            b -= len(text[a:b]) - len(text[a:b].rstrip(edge))
            a += len(text[a:b]) - len(text[a:b].lstrip(edge))
            if a < b and not any(s[1] < b and s[2] > a for s in base[i]):
                out[i].append((kind, a, b))
    return out


def find(docs: DataFrame, field: Field, text_col: str = "text", sure: float = 0.9) -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans`` (those and the field's), each by kind and start."""
    shared = docs.sparkSession.sparkContext.broadcast((field.emit, field.step))

    def spans(texts):
        base = [base_spans(t) for t in texts]
        more = added_spans(texts, base, Field(*shared.value), sure)
        every = [sorted(a + b, key=lambda s: (KINDS.index(s[0]), s[1])) for a, b in zip(base, more)]
        return {k: [[dict(kind=s[0], start=s[1], end=s[2]) for s in own] for own in x] for k, x in (("base_spans", base), ("spans", every))}

    return add_columns(docs, [text_col], T.StructType([T.StructField("base_spans", SPANS), T.StructField("spans", SPANS)]), spans)
