"""Quality rules (operator 4): rules vote or abstain, and the posterior of a weak-label model replaces an all-must-pass filter.

``measure`` counts over whole texts and lets the rules vote; ``fit`` estimates by expectation-maximisation how often each rule is right,
from the vote patterns of all rows; ``judge`` adds the posterior probability of good quality and the verdict. The base filter (too
few words, or too many repeated ones) is never overruled.

Defined results: a null or empty text has no words and fails the base filter; repeated rows get equal verdicts; with an empty table the
model is its starting belief; null ids are judged too; columns named like the outputs are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starslice.llm.common import TextBatch, add_columns, pieces
from starslice.llm.shape import FORM_LABELLERS, form_values, form_votes, shapes
from starslice.llm.weak import VoteModel, fit_votes, pattern_counts

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURES = T.StructType([*[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("base_failed", T.BooleanType()), T.StructField("votes", T.ArrayType(T.IntegerType()))])
RULES = FORM_LABELLERS + 1


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the base counts, ``base_failed`` and ``votes`` (1 good, 0 bad, -1 abstains) of each rule."""

    def count(texts):
        out = {f.name: [] for f in MEASURES}
        for part in pieces(texts):
            s = shapes(TextBatch(texts[part]))
            n = s["n_words"]
            failed = (n < 50) | (100 * s["n_repeat_words"] > 50 * n)
            # one more rule: long texts with hardly a repeated word are seldom made by machines
            fresh = np.where((n >= 100) & (20 * s["n_repeat_words"] <= n), 1, -1)
            for k, x in zip(out, (*[s[c] for c in COUNTS], failed, np.concatenate([form_votes(form_values(s)), fresh[:, None]], axis=1))):
                out[k] += x.tolist()
        return out

    return add_columns(docs, [text_col], MEASURES, count)


def fit(measured: DataFrame) -> VoteModel:
    """The model of the votes of all rows."""
    patterns, counts = pattern_counts(measured, "votes")
    return fit_votes(patterns.reshape(-1, RULES), counts, RULES)


def judge(measured: DataFrame, model: VoteModel, threshold: float = 0.5) -> DataFrame:
    """``measured`` with ``p_good`` (from the votes) and ``kept``; the votes go."""
    # log-odds are a sum over the rules, so no table of vote patterns is needed
    odds = np.log(model.vote[:, 1]) - np.log(model.vote[:, 0])
    z = F.lit(float(np.log(model.prior / (1 - model.prior))))
    for j in range(RULES):
        v = F.element_at("votes", j + 1)
        z = z + F.when(v == 0, float(odds[j, 0])).when(v == 1, float(odds[j, 1])).otherwise(float(odds[j, 2]))
    p = F.round(1 / (1 + F.exp(-z)), 9)
    return (measured.drop("p_good", "kept").withColumn("p_good", p)
            .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold)).drop("votes"))
