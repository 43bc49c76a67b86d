"""Content-defined anchors: positions in bytes that any two equal strings of a given length share."""

from __future__ import annotations

import numpy as np

from starslice.llm.common import TextBatch, mix64, powers

GRAM = 16  # bytes of an anchor


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over values[i:i + width] for each i, by doubling; shorter at the end."""
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:-step] = pick(out[:-step], out[step:])
        have += step
    return out


def anchors(batch: TextBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position and gram hash of the anchors of a batch, and the gram hashes of all positions: every string of ``length`` bytes inside a text holds one, and equal strings hold
    the same. An anchor is the gram of the smallest hash in some such string, or one that equals it."""
    n = len(batch.raw)
    span = length - GRAM + 1  # grams of a string
    starts = np.maximum(batch.last - batch.first - length + 1, 0)
    valid = np.zeros(n + 1, np.int8)
    np.add.at(valid, batch.first, starts > 0)
    np.add.at(valid, batch.first + starts, -(starts > 0).astype(np.int8))
    inside = np.cumsum(valid[:n]) > 0  # a string of this length starts here
    if not inside.any():
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    at = np.arange(max(0, n - GRAM + 1))
    _, down = powers(n)
    h = mix64((batch.sums[GRAM:n + 1] - batch.sums[:n - GRAM + 1]) * down[:len(at)], 3)
    low = sliding(h, span, np.minimum)
    low[~inside[:len(low)]] = 0
    # position j is in the strings that start at j - span + 1 .. j: the largest of their minima is its own hash or less
    most = sliding(low[::-1], span, np.maximum)[::-1]
    found = np.flatnonzero((h == most) & (most > 0))
    return found, h[found], h


def extents(h: np.ndarray, found: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """How many grams before and behind each anchor, ``span`` - 1 at most, come ahead of the next gram with a smaller hash. A string
    belongs to the anchors whose gram has the smallest hash in it; these are the strings of an anchor."""
    own = h[found]
    before, behind = np.full(len(found), span - 1), np.full(len(found), span - 1)
    for d in range(span - 1, 0, -1):
        before[(found >= d) & (h[np.maximum(found - d, 0)] < own)] = d - 1
        behind[(found + d < len(h)) & (h[np.minimum(found + d, len(h) - 1)] < own)] = d - 1
    return before, behind
