"""Matches of a pattern in whole texts, in lists of bounded length, and sums that are kept while a partition is read."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

SMALL = 1_000_000  # code points of a text whose matches fit into one list
AT_ONCE = 100_000  # matches of a longer text in one list

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def matches(pattern, text: str | None) -> Iterator[list[str]]:
    """All matches of a pattern without groups, in order. Null: none. A long text's matches come in several lists."""
    if not text:
        return
    if len(text) <= SMALL:
        yield pattern.findall(text)
        return
    found = (m.group() for m in pattern.finditer(text))
    while part := list(islice(found, AT_ONCE)):
        yield part
