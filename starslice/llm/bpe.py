"""Byte-level BPE (operator 11): texts to token ids and back, by merging padded matrices of token rows.

A text is cut by the vocabulary's pattern. Pieces that the vocabulary holds are one token; the others are put into padded numpy matrices,
one for each length bucket, a row of byte tokens each. In a round every row merges its leftmost pair of least rank. Ranks of
pairs come from a hash table over all pairs of tokens that join to a token; only the pairs beside a merge are looked up again. Merged cells are
removed by compaction, finished rows leave the matrix, and the matrix gets narrower with them.

Where a pair of least rank occurs again further right in its row, that is merged in the same round, as long as no merge before it has made a
pair of lower rank, which would come first. So a row of a million bytes needs as many rounds as it has distinct merges, not a million.

Defined results: null and empty texts have no tokens; repeated rows are encoded each; ids and other columns pass through; columns named like
the outputs are replaced. Special tokens' strings are ordinary text. Pieces are remembered for a Python worker, up to
``REMEMBERED`` of them; a piece's matrix holds at most ``CELLS`` cells unless one piece alone is longer.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from starslice.llm.common import add_columns, mix64
from starslice.llm.common import pieces as slices
from starslice.llm.matches import SMALL, matches

CELLS = 1 << 18
REMEMBERED = 200_000
NONE = np.int32(2**31 - 1)  # above every rank
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


class PairTable:
    """Ranks of token pairs by open addressing: a probe looks at the next slot, for all open keys at once."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        bits = max(4, int(4 * max(1, len(keys)) - 1).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.keys, self.ranks = np.full(1 << bits, EMPTY, np.uint64), np.full(1 << bits, NONE, np.int32)
        slot, left = mix64(keys) & self.mask, np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == EMPTY]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.ranks[slot[put]] = keys[put], ranks[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + np.uint64(1)) & self.mask

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NONE`` for pairs that join to no token (padding, -1, is in no pair)."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        out = np.full(len(keys), NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = keys[todo]
        slot = mix64(keys) & self.mask
        while len(todo):
            there = self.keys[slot]
            same = there == keys
            out[todo[same]] = self.ranks[slot[same]]
            on = np.flatnonzero(~same & (there != EMPTY))
            todo, keys, slot = todo[on], keys[on], (slot[on] + np.uint64(1)) & self.mask
        return out


class Codec:
    """A vocabulary of ranks with its pair table; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        keys, found = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    found.append(rank)
        self.table = PairTable(np.array(keys, np.uint64), np.array(found, np.int32))
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.tokens = tokens
        self.known: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str | None = None) -> Codec:
        """The codec of a rank file, opened where it is used; without a path the public 50k vocabulary of this machine."""
        if path not in _loaded:
            import public_tokenizers

            with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            _loaded[path] = cls(ranks, public_tokenizers.PATTERN)
        return _loaded[path]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of whole texts as little-endian unsigned 32-bit integers; neighbouring texts' pieces are merged together."""
        out = []
        for part in slices(texts, SMALL):
            cut = [matches(self.pattern, t) for t in texts[part]]
            if len(cut) == 1:  # may be long: its pieces come in lists
                out.append(b"".join(b"".join(self.ids_of([found])) for found in cut[0]))
            else:
                out += self.ids_of([next(found, []) for found in cut])
        return out

    def ids_of(self, cut: list[list[str]]) -> list[bytes]:
        fresh = set().union(*cut) - self.known.keys()
        if len(fresh) + len(self.known) > REMEMBERED:
            self.known.clear()
            fresh = set().union(*cut)
        self.remember(fresh)
        return [b"".join(map(self.known.__getitem__, found)) for found in cut]

    def remember(self, pieces: Iterable[str]) -> None:
        open_pieces = []
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            rank = self.ranks.get(raw)
            if rank is None:
                open_pieces.append((len(raw), raw, piece))
            else:
                self.known[piece] = rank.to_bytes(4, "little")
        open_pieces.sort(key=lambda p: p[0])
        start = 0
        while start < len(open_pieces):
            bucket = open_pieces[start][0].bit_length()  # rows of one matrix differ in length by less than twice
            width, end = 0, start
            while end < len(open_pieces) and open_pieces[end][0].bit_length() == bucket and (end == start or open_pieces[end][0] * (end + 1 - start) <= CELLS):
                width, end = open_pieces[end][0], end + 1
            rows = open_pieces[start:end]
            self.known.update(zip([piece for _, _, piece in rows], self.merge([raw for _, raw, _ in rows], width)))
            start = end

    def merge(self, rows: list[bytes], width: int) -> list[bytes]:
        """Token ids, as little-endian unsigned 32-bit integers, of byte strings of at most ``width`` bytes, all rows in one padded matrix."""
        done = [b""] * len(rows)
        size = np.array([len(r) for r in rows])
        tokens = np.full((len(rows), width + 1), -1, np.int32)  # the last column stays padding
        inside = np.arange(width + 1) < size[:, None]
        tokens[inside] = self.byte_ids[np.frombuffer(b"".join(rows), np.uint8)]
        ranks = np.full(tokens.shape, NONE, np.int32)
        ranks[:, :-1] = self.table.look_up(tokens[:, :-1].ravel(), tokens[:, 1:].ravel()).reshape(len(rows), width)
        own = np.arange(len(rows))
        while len(own):
            best = ranks.min(axis=1)
            over = best == NONE
            if over.any():
                ids, step = tokens[over].astype("<u4").tobytes(), 4 * tokens.shape[1]
                for k, (row, n) in enumerate(zip(own[over].tolist(), size[over].tolist())):
                    done[row] = ids[k * step:k * step + 4 * n]
                stay = ~over
                width = int(size[stay].max(initial=0)) + 1
                own, size, best, tokens, ranks = own[stay], size[stay], best[stay], tokens[stay, :width], ranks[stay, :width]
                continue
            row, at = self.merged_now(tokens, ranks, best)
            tokens[row, at] = best[row]
            ranks[row, at] = NONE
            left = np.ones(tokens.shape, bool)
            left[row, at + 1] = False
            # compaction: the cells that are left, in order, fill the front of their row
            lost = np.bincount(row, minlength=len(own))
            front = np.arange(tokens.shape[1]) < (tokens.shape[1] - lost)[:, None]
            packed, packed_ranks = np.full(tokens.shape, -1, np.int32), np.full(tokens.shape, NONE, np.int32)
            packed[front], packed_ranks[front] = tokens[left], ranks[left]
            tokens, ranks = packed, packed_ranks
            size = size - lost
            at = at - (np.arange(len(row)) - np.searchsorted(row, row))  # merges before it in its row
            for side in (at - 1, at):
                ok = side >= 0
                ranks[row[ok], side[ok]] = self.table.look_up(tokens[row[ok], side[ok]], tokens[row[ok], side[ok] + 1])
        return done

    def merged_now(self, tokens: np.ndarray, ranks: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and first cells of the pairs to merge in this round, ordered by row and cell."""
        row, at = np.nonzero(ranks == best[:, None])
        if len(row) == len(best):
            return row, at
        # of pairs that overlap, every second one, from the left
        n = len(row)
        starts = np.ones(n, bool)
        starts[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
        run = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
        alone = (np.arange(n) - run) % 2 == 0
        row, at = row[alone], at[alone]
        # a merge that makes a pair of lower rank is the last one of its row in this round
        new = best[row]
        before = np.where(at > 0, tokens[row, np.maximum(at - 1, 0)], -1)
        beside = np.zeros(len(row), bool)
        beside[1:] = (row[1:] == row[:-1]) & (at[1:] == at[:-1] + 2)
        before = np.where(beside, new, before)
        behind = np.where(at + 2 < tokens.shape[1], tokens[row, np.minimum(at + 2, tokens.shape[1] - 1)], -1)
        lower = (self.table.look_up(before, new) < new) | (self.table.look_up(new, behind) < new)
        ends = np.cumsum(lower) - lower  # number of such merges before this one
        first = np.searchsorted(row, np.arange(len(best)))
        keep = ends == ends[first[row]]
        return row[keep], at[keep]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_loaded: dict[str | None, Codec] = {}


def encode(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None, packed: bool = False) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``ids``: an array of token ids or, ``packed``, their little-endian unsigned 32-bit integers as binary."""
    kind = T.BinaryType() if packed else T.ArrayType(T.LongType(), False)

    def run(texts):
        codec = Codec.load(vocabulary)
        coded = codec.encode(texts)
        return {"n_tokens": [len(c) // 4 for c in coded], "ids": coded if packed else [np.frombuffer(c, "<u4").tolist() for c in coded]}

    return add_columns(docs, [text_col], T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids", kind)]), run, rows=100)


def decode(encoded: DataFrame, ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """``encoded`` with ``decoded``: the bytes of the tokens of ``ids_col`` (an array, or packed). Null: no tokens."""
    packed = isinstance(encoded.schema[ids_col].dataType, T.BinaryType)

    def run(ids):
        codec = Codec.load(vocabulary)
        return {"decoded": [codec.decode(bytes(i or b"") if packed else np.array(i or [], "<u4").tobytes()) for i in ids]}

    return add_columns(encoded, [ids_col], T.StructType([T.StructField("decoded", T.BinaryType())]), run, rows=100)
