"""Greedy word-piece lengths by a linear longest-match automaton.

A trie holds the pieces that begin a word and, under a second root, those that
continue one. Each node knows where to go on when the next byte does not fit
and how many pieces are closed by going there, so a word's number of pieces is
a sum along one pass over its bytes; no piece is ever built.
"""

from __future__ import annotations

import json
from collections import deque
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tabloom.llm.arrow import append
from tabloom.llm.bpe import byte_characters

CACHED = 400_000


def word_pieces(vocabulary_path: str) -> tuple[set[bytes], set[bytes]]:
    """(first, later) pieces of a byte-level vocabulary: those with a leading space begin words, the others go on.

    Every single byte is in both, so each word can be covered.
    """
    with open(vocabulary_path, "rb") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec["added_tokens"]}
    shown = {c: b for b, c in enumerate(byte_characters())}
    first, later = {bytes([b]) for b in range(256)}, {bytes([b]) for b in range(256)}
    for piece in spec["model"]["vocab"]:
        if piece not in special:
            raw = bytes(shown[c] for c in piece)
            if raw.startswith(b" ") and len(raw) > 1:
                first.add(raw[1:])
            elif not raw.startswith(b" "):
                later.add(raw)
    return first, later


class LongestMatch:
    """The automaton: child by (node, byte), failure link and number of pieces closed by taking it."""

    FIRST, LATER = 0, 1

    def __init__(self, first: set[bytes], later: set[bytes]):
        self.child: dict[int, int] = {}
        parent, byte, whole = [-1, -1], [0, 0], [False, False]
        for root, pieces in ((self.FIRST, first), (self.LATER, later)):
            for piece in pieces:
                node = root
                for b in piece:
                    step = node * 256 + b
                    if step not in self.child:
                        self.child[step] = len(parent)
                        parent.append(node)
                        byte.append(b)
                        whole.append(False)
                    node = self.child[step]
                whole[node] = whole[node] or bool(piece)
        self.fail, self.closed = [-1] * len(parent), [0] * len(parent)
        below: list[list[int]] = [[] for _ in parent]
        for node in range(2, len(parent)):
            below[parent[node]].append(node)
        todo = deque(chain(below[self.FIRST], below[self.LATER]))
        while todo:
            node = todo.popleft()
            todo.extend(below[node])
            if whole[node]:
                self.fail[node], self.closed[node] = self.LATER, 1
                continue
            up = parent[node]
            closed, at = self.closed[up], self.fail[up]
            while at >= 0 and at * 256 + byte[node] not in self.child:
                closed, at = closed + self.closed[at], self.fail[at]
            if at >= 0:
                self.fail[node], self.closed[node] = self.child[at * 256 + byte[node]], closed

    def state(self) -> tuple:
        return self.child, self.fail, self.closed

    @classmethod
    def of(cls, state: tuple) -> LongestMatch:
        made = cls.__new__(cls)
        made.child, made.fail, made.closed = state
        return made

    def count(self, word: bytes) -> int:
        """Pieces of the word; 1 (the unknown piece) if the vocabulary cannot cover it, 0 for no word."""
        if not word:
            return 0
        child, fail, closed = self.child, self.fail, self.closed
        node, total = self.FIRST, 0
        for b in word:
            while (down := child.get(node * 256 + b)) is None:
                if fail[node] < 0:
                    return 1
                total += closed[node]
                node = fail[node]
            node = down
        while node != self.LATER:
            if fail[node] < 0:
                return 1
            total += closed[node]
            node = fail[node]
        return total


def token_counts(df: DataFrame, vocabulary_path: str, text: str = "text", words: str = "n_words",
                 tokens: str = "n_tokens") -> DataFrame:
    """Adds the number of words ([^\\x20\\x09-\\x0D]+, in UTF-8) and of their greedy longest-match pieces.

    Null and empty texts count 0 of both. The automaton is broadcast; its size
    is the vocabulary's, whatever the table's.
    """
    spark: SparkSession = df.sparkSession
    automaton = spark.sparkContext.broadcast(LongestMatch(*word_pieces(vocabulary_path)).state())

    def make():
        known: dict[bytes, int] = {}
        count = LongestMatch.of(automaton.value).count

        def work(texts):
            nonlocal known
            split = [t.encode().split() if t else [] for t in texts]
            if len(known) > CACHED:
                known = {}
            for word in set(chain.from_iterable(split)) - known.keys():
                known[word] = count(word)
            look = known.__getitem__
            return [list(map(len, split)), [sum(map(look, s)) for s in split]]

        return work

    return append(df, [text], [(words, T.LongType()), (tokens, T.LongType())], make)
