"""Byte-pair merges of many short words at once, as matrices.

Words of similar length form a matrix of symbols. A second matrix holds the rank
of each adjacent pair; every step joins each word's pair of lowest rank, the
leftmost of equal ones, looks up its two new neighbours, and drops words that
have no pair left.
"""

from __future__ import annotations

import numpy as np

NEVER = np.int32(2**31 - 1)
WIDTHS = (8, 16, 32)  # words are merged together with others up to these lengths; longer ones are not for this
MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Rank and product of the pairs that may be joined, as a hash table over two numbers."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, made: np.ndarray):
        self.bits = max(4, (2 * len(left)).bit_length())
        keys = self._keys(np.asarray(left), np.asarray(right))
        self.keys = np.full(2**self.bits, np.iinfo(np.uint64).max, np.uint64)
        self.rank = np.full(2**self.bits, NEVER, np.int32)
        self.made = np.zeros(2**self.bits, np.int32)
        todo, place = np.arange(len(keys)), self._home(keys)
        while len(todo):
            _, first = np.unique(place[todo], return_index=True)  # one newcomer a place
            first = todo[first[self.rank[place[todo[first]]] == NEVER]]
            self.keys[place[first]], self.rank[place[first]], self.made[place[first]] = keys[first], rank[first], made[first]
            left_over = np.ones(len(keys), bool)
            left_over[first] = False
            todo = todo[left_over[todo]]
            place[todo] = (place[todo] + 1) & (2**self.bits - 1)

    @staticmethod
    def _keys(left, right):
        return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint32).astype(np.uint64)

    def _home(self, keys):
        return ((keys * MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of the pairs; a place with rank ``NEVER`` for those that are not there."""
        keys = self._keys(left, right)
        place = self._home(keys)
        todo = np.flatnonzero((self.keys[place] != keys) & (self.rank[place] != NEVER))
        while len(todo):
            place[todo] = (place[todo] + 1) & (2**self.bits - 1)
            at = place[todo]
            todo = todo[(self.keys[at] != keys[todo]) & (self.rank[at] != NEVER)]
        return place


def merge_words(symbols: np.ndarray, lengths: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merged symbols in a row and their number for each word; no word is longer than the last width."""
    starts = np.cumsum(lengths) - lengths
    out = np.full((len(lengths), int(lengths.max(initial=0))), -1, np.int32)
    low = 0
    for width in WIDTHS:
        words = np.flatnonzero((lengths > low) & (lengths <= width))
        low = width
        if len(words):
            at = np.arange(width)
            cells = starts[words][:, None] + at
            given = at < lengths[words][:, None]
            m = np.where(given, symbols[np.minimum(cells, len(symbols) - 1)], -1).astype(np.int32)
            _merge_matrix(m, table, words, out)
    keep = out >= 0
    return out[keep], keep.sum(axis=1)


def cut_rows(names: list[str], flat: np.ndarray, lengths: np.ndarray) -> dict[str, bytes]:
    """What ``merge_words`` gives by name, as the bytes of 32-bit numbers."""
    data, ends = flat.astype(np.int32).tobytes(), (4 * np.cumsum(lengths)).tolist()
    return {n: data[a:b] for n, a, b in zip(names, [0, *ends], ends)}


def _merge_matrix(m: np.ndarray, table: PairTable, words: np.ndarray, out: np.ndarray) -> None:
    n, width = m.shape
    at = np.arange(width)
    pair = np.full((n, width), -1, np.int64)  # places of the pairs that begin at a symbol
    rank = np.full((n, width), NEVER, np.int32)
    r, c = np.nonzero(m[:, 1:] >= 0)
    pair[r, c] = table.find(m[r, c], m[r, c + 1])
    rank[r, c] = table.rank[pair[r, c]]

    def store(done):
        span = min(width, out.shape[1])
        out[words[done], :span] = m[done, :span]

    while True:
        best = rank.argmin(axis=1)
        row = np.arange(len(m))
        open_ = rank[row, best] != NEVER
        if not open_.all():
            store(~open_)
            m, pair, rank, best, words = m[open_], pair[open_], rank[open_], best[open_], words[open_]
            row = np.arange(len(m))
        if not len(m):
            return
        new = table.made[pair[row, best]]
        # what stands behind the pair moves one place to the front
        move = np.minimum(at + (at > best[:, None]), width - 1)
        m, pair, rank = (np.take_along_axis(x, move, axis=1) for x in (m, pair, rank))
        m[:, -1], rank[:, -1] = -1, NEVER
        m[row, best] = new
        for place, ok in ((best, (best + 1 < width) & (m[row, np.minimum(best + 1, width - 1)] >= 0)), (best - 1, best > 0)):
            some = np.flatnonzero(ok)
            found = table.find(m[some, place[some]], m[some, place[some] + 1])
            pair[some, place[some]], rank[some, place[some]] = found, table.rank[found]
            none = np.flatnonzero(~ok & (place >= 0))
            rank[none, place[none]] = NEVER
