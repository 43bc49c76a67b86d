"""Token counts (operator 2): whole documents are encoded once, and their tokens attributed to sections by character spans.

A token's place in the text comes from the lengths of the tokens' bytes, so nothing is encoded twice and counts add up to those of the
whole document. Token spans are joined with section spans by merging both sorted lists. A token that crosses a boundary belongs to the section
that holds most of its bytes, the earlier one of equals.

A section is a line with its line feed; ``sections`` may be another rule. Defined results: null and empty texts have no tokens
and no sections; repeated rows are counted each; a null id is kept; columns of ``docs`` named like the outputs are replaced. Special
tokens' strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starslice.llm.common import add_columns


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """A byte-level vocabulary of ranks, opened where it is used."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """Byte position behind each token of a text."""
        return np.cumsum(self.length[self.encoding.encode_to_numpy(text, disallowed_special=())])


def line_ends(raw: np.ndarray) -> np.ndarray:
    """Byte position behind each line, its line feed included; the last line may have none."""
    ends = np.flatnonzero(raw == 10) + 1
    return ends if not len(raw) or (len(ends) and ends[-1] == len(raw)) else np.append(ends, len(raw))


def attribute(token_ends: np.ndarray, section_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them cross its bounds."""
    starts = np.concatenate([[0], token_ends[:-1]]) if len(token_ends) else token_ends
    first = np.searchsorted(section_ends, starts, side="right")
    last = np.searchsorted(section_ends, token_ends, side="left")
    own = first.copy()
    section_starts = np.concatenate([[0], section_ends[:-1]])
    for k in np.flatnonzero(first != last):
        at = np.arange(first[k], last[k] + 1)
        share = np.minimum(section_ends[at], token_ends[k]) - np.maximum(section_starts[at], starts[k])
        own[k] = at[np.argmax(share)]  # the first of the largest
    n = len(section_ends)
    return np.bincount(own, minlength=n), np.bincount(own[first != last], minlength=n)


SECTIONS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("sections", T.ArrayType(T.StructType([
    T.StructField(c, T.LongType()) for c in ("section", "start_char", "end_char", "n_tokens", "n_crossing")])))])


def section_tokens(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None, sections: Callable[[np.ndarray], np.ndarray] = line_ends) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``sections``: an array of (section, start_char, end_char, n_tokens, n_crossing).

    ``sections`` gets a text's UTF-8 bytes and returns the ascending byte positions behind its sections, the last one the text's end.
    """
    path = vocabulary or default_vocabulary()
    opened: list[Encoder] = []

    def count(texts):
        if not opened:
            opened.append(Encoder(path))
        out = {"n_tokens": [], "sections": []}
        for text in texts:
            raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
            tokens, ends = opened[0].ends(text or ""), sections(raw)
            n, crossing = attribute(tokens, ends)
            chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[np.concatenate([[0], ends]).astype(int)]
            out["n_tokens"].append(len(tokens))
            out["sections"].append([dict(section=k, start_char=a, end_char=b, n_tokens=x, n_crossing=y) for k, (a, b, x, y) in
                                    enumerate(zip(chars[:-1].tolist(), chars[1:].tolist(), n.tolist(), crossing.tolist()))])
        return out

    return add_columns(docs, [text_col], SECTIONS, count)


def section_rows(counted: DataFrame) -> DataFrame:
    """A row for each section."""
    return counted.withColumnRenamed("n_tokens", "doc_tokens").select("*", F.inline("sections")).drop("sections")
