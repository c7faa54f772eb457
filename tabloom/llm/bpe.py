"""Byte-level BPE through a minimal acyclic transducer of frequent words.

The corpus' most widespread words are compiled, with their token ids, into one
automaton that shares prefixes and suffixes. Following a word's bytes adds up
the numbers on its edges, and the sum is the word's place in the table of ids.
The automaton is one file that every executor maps into memory; a word that it
lacks is merged exactly, pair by pair, together with the other new words of its
batch. Which words it holds never changes a result, only how often the merging
is needed.
"""

from __future__ import annotations

import gc
import heapq
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.arrow import append, gather, local_path, publish
from tabloom.llm.merging import WIDTHS, PairTable, cut_rows, merge_words
from tabloom.session import checkpoint

LEXICON = 200_000  # words in the automaton: the bound of what the driver holds
CACHED = 400_000  # words whose ids a task remembers
LONG = 40  # symbols from which a word is merged with a heap

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def splitter():
    """The pre-tokenizer: text to words that concatenate to it.

    Texts of code points below 256 use a plain ``re`` with the same classes
    spelt out, which is three times as fast.
    """
    full = regex.compile(PATTERN)
    letters, digits, space = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
    plain = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{digits}]+| ?[^{space}{letters}{digits}]+"
                       f"|[{space}]+(?![^{space}])|[{space}]+")

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return full.findall(text)
        return plain.findall(text)

    return split


class Vocabulary:
    """Ids, merges and special strings of a byte-level BPE file."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        shown = {c: b for b, c in enumerate(byte_characters())}
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(shown[c] for c in s) for s, i in vocab.items() if s not in self.special}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.symbol = [vocab[c] for c in byte_characters()]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []  # the token that each rank's merge gives
        for pair in spec["model"]["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault((vocab[a], vocab[b]), len(self.made))
            self.made.append(vocab[a + b])

    def merge(self, word: bytes) -> tuple[int, ...]:
        """The exact merges of one word: always the lowest rank, the leftmost of equals."""
        ids = [self.symbol[b] for b in word]
        if len(ids) > LONG:
            return self._merge_long(ids)
        never, get, made = len(self.made), self.rank.get, self.made
        ranks = [get(p, never) for p in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) < never:
            i = ranks.index(least)
            ids[i:i + 2] = [made[least]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), never)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), never)
        return tuple(ids)

    def _merge_long(self, ids: list[int]) -> tuple[int, ...]:
        n, get, made = len(ids), self.rank.get, self.made
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = made[m], False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else n
                if left >= 0 and right < n and (m := get((ids[left], ids[right]))) is not None:
                    heapq.heappush(heap, (m, left, ids[left], ids[right]))
        return tuple(x for x, ok in zip(ids, alive) if ok)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + other.index(b)) for b in range(256)]


def compile_transducer(entries: dict[bytes, tuple[int, ...]]) -> bytes:
    """The minimal acyclic automaton of the words, numbered by place, with their ids, as one file.

    Words are added in sorted order; a state is fixed, and replaced by an equal
    one where there is one, as soon as no later word can pass through it.
    """
    words = sorted(entries)
    register: dict[tuple, int] = {}
    fixed: list[tuple[bool, tuple]] = []
    path: list[list] = [[False, []]]  # states of the last word: final, edges of fixed states

    def fix(state) -> int:
        key = (state[0], tuple(state[1]))
        if key not in register:
            register[key] = len(fixed)
            fixed.append(key)
        return register[key]

    last = b""
    for word in words:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        for depth in range(len(last), common, -1):
            path[depth - 1][1].append((last[depth - 1], fix(path.pop())))
        path.extend([False, []] for _ in range(len(word) - common))
        path[-1][0] = True
        last = word
    for depth in range(len(last), 0, -1):
        path[depth - 1][1].append((last[depth - 1], fix(path.pop())))
    root = fix(path[0])

    count: list[int] = []  # words that a state accepts; targets are fixed before their sources
    keys, targets, skips = [], [], []
    for state, (final, edges) in enumerate(fixed):
        seen = int(final)
        for label, target in edges:
            keys.append(state * 256 + label)
            targets.append(target)
            skips.append(seen)
            seen += count[target]
        count.append(seen)
    ids = [entries[w] for w in words]
    arrays = [np.array(keys, np.int64), np.array(targets, np.int32), np.array(skips, np.int32),
              np.array([f for f, _ in fixed], np.int32), np.cumsum([0, *map(len, ids)]).astype(np.int32),
              np.fromiter(chain.from_iterable(ids), np.int32)]
    head = json.dumps({"root": root, "longest": max(map(len, words), default=0),
                       "arrays": [[a.dtype.str, len(a)] for a in arrays]}).encode()
    return b"".join([len(head).to_bytes(8, "little"), head, b"\0" * (-len(head) % 8),
                     *(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)])


class Transducer:
    """Read side of ``compile_transducer``: arrays mapped from the file, many words followed at once."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            size = int.from_bytes(f.read(8), "little")
            head = json.loads(f.read(size))
        at, arrays = 8 + size + -size % 8, []
        for kind, n in head["arrays"]:
            arrays.append(np.memmap(path, np.dtype(kind), "r", at, (n,)) if n else np.zeros(0, kind))
            at += n * np.dtype(kind).itemsize
            at += -at % 8
        self.root, self.longest = head["root"], head["longest"]
        self.keys, self.targets, self.skips, self.final, self.starts, self.ids = arrays

    def find(self, words: list[bytes]) -> list[tuple[int, ...] | None]:
        out: list[tuple[int, ...] | None] = [None] * len(words)
        known = [i for i, w in enumerate(words) if 0 < len(w) <= self.longest]
        if not known or not len(self.keys):
            return out
        length = np.array([len(words[i]) for i in known])
        flat = np.frombuffer(b"".join(words[i] for i in known), np.uint8)
        start = np.cumsum(length) - length
        live = np.arange(len(known))
        state, place = np.full(len(known), self.root, np.int64), np.zeros(len(known), np.int64)
        for step in range(int(length.max())):
            live = live[length[live] > step]
            key = state[live] * 256 + flat[start[live] + step]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[edge] == key
            state[live[~hit]] = -1
            live, edge = live[hit], edge[hit]
            state[live], place[live] = self.targets[edge], place[live] + self.skips[edge]
        ok = np.flatnonzero((state >= 0) & (self.final[np.maximum(state, 0)] == 1))
        begin, end = self.starts[place[ok]].tolist(), self.starts[place[ok] + 1].tolist()
        for k, a, b in zip(ok.tolist(), begin, end):
            out[known[k]] = tuple(self.ids[a:b].tolist())
        return out


class Encoder:
    """Texts to ids in one task. The ids of a word are kept as bytes, so that those of a batch are one join away."""

    def __init__(self, vocabulary: Vocabulary, transducer: Transducer):
        self.vocabulary, self.transducer, self.split = vocabulary, transducer, splitter()
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") \
            if vocabulary.special else None
        self.known: dict[str, bytes] = {}
        self.symbol = np.array(vocabulary.symbol, np.int32)
        pairs = np.array(list(vocabulary.rank), np.int32).reshape(-1, 2)
        ranks = np.fromiter(vocabulary.rank.values(), np.int32, len(pairs))
        self.table = PairTable(pairs[:, 0], pairs[:, 1], ranks, np.array(vocabulary.made, np.int32)[ranks])
        raw = vocabulary.bytes_of
        self.tokens = pa.array([raw.get(i) for i in range(max(raw) + 1)], pa.binary())
        gc.set_threshold(1_000_000)  # the words of a batch are no garbage, and walking them takes time

    def words(self, text: str) -> list[str]:
        if self.cuts is None or not any(s in text for s in self.vocabulary.special):
            return self.split(text)
        special = self.vocabulary.special
        return list(chain.from_iterable([p] if p in special else self.split(p) for p in self.cuts.split(text) if p))

    def _ids_of(self, words: list[str]) -> dict[str, bytes]:
        """The ids of new words: from the automaton, or merged, up to the last width many at once."""
        raw = [w.encode() for w in words]
        made, short = {}, []
        for k, ids in enumerate(self.transducer.find(raw)):
            if ids is None and len(raw[k]) <= WIDTHS[-1]:
                short.append(k)
            else:
                made[words[k]] = np.array(self.vocabulary.merge(raw[k]) if ids is None else ids, np.int32).tobytes()
        flat = self.symbol[np.frombuffer(b"".join(raw[k] for k in short), np.uint8)]
        lengths = np.array([len(raw[k]) for k in short], np.int64)
        return made | cut_rows([words[k] for k in short], *merge_words(flat, lengths, self.table))

    def encode(self, texts: list[str]) -> pa.ListArray:
        split = [self.words(t) for t in texts]
        if len(self.known) > CACHED:
            self.known = {}
        if not self.known:
            self.known |= {s: np.int32(i).tobytes() for s, i in self.vocabulary.special.items()}
        known = self.known
        if new := [w for w in set(chain.from_iterable(split)) if w not in known]:
            known |= self._ids_of(new)
        rows = [b"".join(map(known.__getitem__, words)) for words in split]
        ends = np.cumsum([0, *map(len, rows)]) // 4
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(rows), np.int32)))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The texts of the ids of each row; bytes that are no UTF-8 become replacement characters."""
        tokens = self.tokens.take(ids.values)
        if tokens.null_count:
            raise KeyError("an id that the vocabulary lacks")
        raw = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, tokens), b"")
        try:
            return raw.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([b.decode("utf-8", "replace") for b in raw.to_pylist()], pa.string())


def widespread_words(df: DataFrame, text: str, limit: int = LEXICON) -> list[str]:
    """The pre-tokens found in most blocks of rows, over all rows: at most ``limit``, and no count in part."""
    def make():
        split, count = splitter(), {}

        def flush():
            nonlocal count
            made, count = [list(count), list(count.values())], {}
            return made

        def add(texts):
            pieces = set(chain.from_iterable(t.split(" ") for t in texts if t))
            plain = [p for p in pieces if p.isascii()]  # these are one text; one other letter would slow all of them
            words = set(split(" " + " ".join(plain))).union(*(split(" " + p) for p in pieces if not p.isascii()))
            for word in words:
                count[word] = count.get(word, 0) + 1
            return flush() if len(count) > CACHED else None

        return add, flush

    parts = gather(df, [text], [("word", T.StringType()), ("blocks", T.LongType())], make)
    counted = checkpoint(parts.groupBy("word").agg(F.sum("blocks").alias("blocks")))
    # a histogram finds the count that leaves at most ``limit`` words, so no task sends more than its share of them
    step = F.floor(F.log2("blocks") * 32)
    left, least = limit, None
    for r in counted.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # 32 rows a doubling
        left -= r["count"]
        if left < 0:
            break
        least = r["step"]
    if least is None:
        return []
    return sorted(r["word"] for r in counted.filter(step >= least).select("word").collect())


class BpeCodec:
    """Encodes and decodes columns with a byte-level BPE vocabulary file.

    Null texts are treated as empty: no ids, empty decoded text. A special
    string in a text is its one id. Equal rows give equal results; an input
    column with an output column's name is replaced.
    """

    def __init__(self, spark: SparkSession, vocabulary_path: str, words: list[str]):
        with open(vocabulary_path, "rb") as f:
            raw = f.read()
        vocabulary = Vocabulary(raw)
        split = splitter()
        words = [w for w in words if w and split(w) == [w]]
        merged = {w.encode(): vocabulary.merge(w.encode()) for w in words}
        self.vocabulary = publish(spark, "bpe-vocabulary", raw)
        self.lexicon = publish(spark, "bpe-lexicon", compile_transducer(merged))

    @classmethod
    def fit(cls, df: DataFrame, vocabulary_path: str, text: str = "text", limit: int = LEXICON) -> BpeCodec:
        return cls(df.sparkSession, vocabulary_path, widespread_words(df, text, limit))

    def _encoder(self):
        vocabulary, lexicon = self.vocabulary, self.lexicon

        def load():
            with open(local_path(vocabulary), "rb") as f:
                return Encoder(Vocabulary(f.read()), Transducer(local_path(lexicon)))

        return load

    def encode(self, df: DataFrame, text: str = "text", ids: str = "token_ids", decoded: str | None = None) -> DataFrame:
        """Adds the ids and, if named, the text decoded from them in the same pass."""
        load, both = self._encoder(), decoded is not None
        fields = [(ids, T.ArrayType(T.IntegerType()))] + ([(decoded, T.StringType())] if both else [])

        def make():
            encoder = load()

            def work(texts):
                found = encoder.encode([t or "" for t in texts])
                return [found] + ([encoder.decode(found)] if both else [])

            return work

        return append(df, [text], fields, make)

    def decode(self, df: DataFrame, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
        """Adds the text of the ids; null ids give an empty text."""
        load = self._encoder()

        def make():
            encoder = load()
            return lambda rows: [encoder.decode(pa.array([i or [] for i in rows], pa.list_(pa.int32())))]

        return append(df, [ids], [(text, T.StringType())], make)
