"""Counts that describe a text's form; they feed the heuristics of the quality operators."""

from __future__ import annotations

import numpy as np

from starslice.llm.common import IS_SPACE, TextBatch, mix64

SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
UPPER, LOWER = np.isin(np.arange(256), range(65, 91)), np.isin(np.arange(256), range(97, 123))
IN_CHARACTER = np.isin(np.arange(256), range(0x80, 0xC0))  # all but the first byte of a character


def repeated_words(batch: TextBatch, ids: np.ndarray, size: int = 3) -> np.ndarray:
    """For each text, its words that lie in a window of ``size`` words which the text holds twice or more."""
    h, at = batch.windows(ids, size)
    _, which, count = np.unique(mix64(h ^ mix64(batch.doc[at].astype(np.uint64), 5)), return_inverse=True, return_counts=True)
    again = at[count[which] > 1]
    covered = np.zeros(len(ids), bool)
    for k in range(size):
        covered[again + k] = True
    return np.bincount(batch.doc[covered], minlength=batch.n)


def repeated_lines(batch: TextBatch) -> tuple[np.ndarray, np.ndarray]:
    """For each text, its \\n-split lines with a word, and how many of them equal an earlier one."""
    end = np.flatnonzero(batch.raw == 10)
    start = np.concatenate([[0], end[:-1] + 1])
    filled = np.searchsorted(batch.start, start) < np.searchsorted(batch.start, end)
    start, end = start[filled], end[filled]
    doc = np.searchsorted(batch.last, start)
    lines = np.bincount(doc, minlength=batch.n)
    _, first = np.unique(mix64(batch.span_hash(start, end) ^ mix64(doc.astype(np.uint64), 6)), return_index=True)
    return lines, lines - np.bincount(doc[first], minlength=batch.n)


def shapes(batch: TextBatch) -> dict[str, np.ndarray]:
    """Form counts of whole texts, an array each; all zero for null and empty texts."""
    ids = batch.word_hash()
    lines, dup = repeated_lines(batch)
    doubled = np.flatnonzero((ids[1:] == ids[:-1]) & (batch.doc[1:] == batch.doc[:-1]))
    upper = batch.per_text(UPPER[batch.raw])
    return {
        "n_words": np.diff(batch.bounds), "word_chars": batch.per_text(~IN_CHARACTER[batch.raw] & ~IS_SPACE[batch.raw]),
        "n_symbols": batch.per_text(SYMBOLS[batch.raw]), "n_lines": lines, "n_dup_lines": dup, "n_repeat_words": repeated_words(batch, ids),
        "upper": upper, "letters": upper + batch.per_text(LOWER[batch.raw]), "bangs": batch.per_text(batch.raw == 33),
        "n_doubled": np.bincount(batch.doc[doubled], minlength=batch.n),
    }


#: Rules on form: what is measured, the largest good and the smallest bad value. In between a rule abstains.
FORM_RULES = [
    ("symbols a word", 0.08, 0.3), ("upper-case share of letters", 0.25, 0.5), ("repeated share of words", 0.3, 0.6),
    ("exclamation marks a word", 0.1, 0.4), ("repeated share of lines", 0.2, 0.6), ("doubled share of words", 0.1, 0.3),
    ("characters a word beyond 4", 6.0, 12.0),
]


def form_values(s: dict[str, np.ndarray]) -> np.ndarray:
    """The measures of FORM_RULES, a row for each text; NaN where there is too little text to judge."""
    n, many = np.maximum(s["n_words"], 1), s["n_words"] >= 5
    values = np.stack([
        s["n_symbols"] / n, np.where(s["letters"] >= 20, s["upper"] / np.maximum(s["letters"], 1), np.nan), s["n_repeat_words"] / n, s["bangs"] / n,
        np.where(s["n_lines"] >= 3, s["n_dup_lines"] / np.maximum(s["n_lines"], 1), np.nan), s["n_doubled"] / n, np.abs(s["word_chars"] / n - 4),
    ], axis=1)
    return np.where(many[:, None], values, np.nan)


FORM_LABELLERS = len(FORM_RULES) + 2
GOOD, BAD = np.array([r[1] for r in FORM_RULES]), np.array([r[2] for r in FORM_RULES])


def form_votes(values: np.ndarray) -> np.ndarray:
    """Votes of the overlapping labellers: 1 good, 0 bad, -1 abstains.

    Each rule looks for one defect: it votes bad where its measure is beyond the bad bound and says nothing otherwise, as a text
    without this defect may have another. Two labellers vouch: one where no measure is beyond its bad bound, one where all are
    within the good ones. A text too short to judge shows no defect.
    """
    vouch = np.stack([~(values >= BAD).any(1), ~(values > GOOD).any(1)], axis=1)
    return np.concatenate([np.where(values >= BAD, 0, -1), np.where(vouch, 1, -1)], axis=1)
