"""Alignment of two tokenizers' tokens over the bytes of each text.

Tokenizer A is a byte-level BPE file, which reads the text behind one space, B a
merge-type sentencepiece model, which puts that space itself. The ends of both
chains of tokens are merged as sorted lists: one state vector holds the two
pointers of every lane of a batch, and a step compares all lanes' ends at once,
emits a cut and a link where they are equal, and moves the pointer of the
smaller end, or both. Lanes that are through are taken out of the state.

A lane is a text's stretch of at most ``LANE`` tokens of A and the tokens of B
that end within it, so long texts do not hold up a batch; equal ends always lie
in the same lane.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.skew import skew_join
from tabloom.llm.arrow import append, local_path, own, publish
from tabloom.llm.bpe import Vocabulary, splitter
from tabloom.llm.merging import WIDTHS, PairTable, cut_rows, merge_words
from tabloom.llm.pieces import CACHED, LONG, PieceCodec, PieceEncoder
from tabloom.sources.io import scratch

LANE = 128  # tokens of A in a lane
CHARS = 1_000_000  # characters aligned at once; a longer text is aligned alone
PAIRS = 2_000_000  # id pairs, of 24 bytes each, that are broadcast; more are joined by shuffling
STEPS = 8  # steps between two compactions

LINK = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("n", T.IntegerType())])


class PlainBytes:
    """Ids of a byte-level vocabulary for texts in which no string is special; new words of a batch are merged together."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.split = vocabulary, splitter()
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        top = max(vocabulary.bytes_of) + 1
        self.raw = [vocabulary.bytes_of.get(i, b"") for i in range(top)]
        self.lengths = np.array([len(b) for b in self.raw], np.int64)
        self.symbol = np.array(vocabulary.symbol, np.int32)
        pairs = np.array(list(vocabulary.rank), np.int32).reshape(-1, 2)
        ranks = np.fromiter(vocabulary.rank.values(), np.int32, len(pairs))
        self.table = PairTable(pairs[:, 0], pairs[:, 1], ranks, np.array(vocabulary.made, np.int32)[ranks])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of them up to each text's end."""
        if len(self.known) > CACHED:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        split = [self.split(t) for t in texts]
        found = [list(map(known.get, words)) for words in split]
        gaps = [k for k, parts in enumerate(found) if None in parts]
        new = {w: before.get(w) for k in gaps for w, ids in zip(split[k], found[k]) if ids is None}
        new |= self._ids_of([w for w, ids in new.items() if ids is None])
        known |= {w: ids for w, ids in new.items() if len(w) <= LONG}
        for k in gaps:
            found[k] = [new[w] if ids is None else ids for w, ids in zip(split[k], found[k])]
        rows = [b"".join(parts) for parts in found]
        return np.frombuffer(b"".join(rows), np.int32), np.cumsum([0, *map(len, rows)]) // 4

    def _ids_of(self, words: list[str]) -> dict[str, bytes]:
        raw = [w.encode() for w in words]
        short = [k for k, b in enumerate(raw) if len(b) <= WIDTHS[-1]]
        out = {words[k]: array("i", self.vocabulary.merge(b)).tobytes() for k, b in enumerate(raw) if len(b) > WIDTHS[-1]}
        flat = self.symbol[np.frombuffer(b"".join(raw[k] for k in short), np.uint8)]
        return out | cut_rows([words[k] for k in short], *merge_words(flat, np.array([len(raw[k]) for k in short], np.int64), self.table))


class PlainPieces(PieceEncoder):
    """The piece encoder with the new chunks of a batch merged together; pairs are all halves of pieces."""

    def __init__(self, vocabulary):
        super().__init__(vocabulary, check=False)
        ids, losses = vocabulary.id, sorted(set(vocabulary.loss.values()))
        place = {x: k for k, x in enumerate(losses)}
        halves = [(ids[p[:k]], ids[p[k:]], place[vocabulary.loss[p]], i) for p, i in ids.items()
                  for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        self.table = PairTable(*np.array(halves, np.int64).reshape(-1, 4).T)
        self.letters = np.full(0x110000, -1, np.int32)
        single = [(ord(p), i) for p, i in ids.items() if len(p) == 1]
        self.letters[[c for c, _ in single]] = [i for _, i in single]

    def _ids_of(self, keys: list[str]) -> dict[str, bytes]:
        spelt = [self.spelt(w) for w in keys]
        short = [k for k, s in enumerate(spelt) if len(s) <= WIDTHS[-1]]
        lengths = np.array([len(spelt[k]) for k in short], np.int64)
        flat = self.letters[np.frombuffer("".join(spelt[k] for k in short).encode("utf-32-le"), np.uint32)]
        # characters that are no piece become bytes, one by one
        row = np.repeat(np.arange(len(short)), lengths)
        odd = np.zeros(len(short), bool)
        odd[row[flat < 0]] = True
        plain = [k for k, o in zip(short, odd.tolist()) if not o]
        done = set(plain)
        out = {keys[k]: array("i", self.vocabulary.merge(s)).tobytes() for k, s in enumerate(spelt) if k not in done}
        return out | cut_rows([keys[k] for k in plain], *merge_words(flat[~odd[row]], lengths[~odd], self.table))


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray, texts_a: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """For each token whether it ends a group, from the ends of all tokens of a batch.

    Ends are byte offsets in the joined texts, so they rise over the batch, and
    both chains end together at each text's end. ``texts_a`` holds the number of
    A tokens up to each text's end, beginning with 0.
    """
    cut_a, cut_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
    if not len(ends_a):
        return cut_a, cut_b
    sizes = np.diff(texts_a)
    lanes = -(-sizes // lane)
    first = np.cumsum(lanes) - lanes
    from_a = np.repeat(texts_a[:-1], lanes) + lane * (np.arange(lanes.sum()) - np.repeat(first, lanes))
    from_b = np.searchsorted(ends_b, np.where(from_a > 0, ends_a[from_a - 1], 0), "right")
    # one state: both pointers and both limits of every lane
    state = np.stack([from_a, from_b, np.append(from_a[1:], len(ends_a)), np.append(from_b[1:], len(ends_b))])
    never = np.int64(2**62)
    a, b = np.append(ends_a, never), np.append(ends_b, never)
    while state.shape[1]:
        for _ in range(STEPS):
            at_a, at_b, stop_a, stop_b = state
            end_a, end_b = np.where(at_a < stop_a, a[at_a], never), np.where(at_b < stop_b, b[at_b], never)
            meet = (end_a == end_b) & (end_a < never)
            cut_a[at_a[meet]] = True
            cut_b[at_b[meet]] = True
            at_a += (end_a <= end_b) & (end_a < never)
            at_b += (end_b <= end_a) & (end_b < never)
        state = state[:, (state[0] < state[2]) | (state[1] < state[3])]
    return cut_a, cut_b


class Aligner:
    """Texts to groups and links in one task."""

    def __init__(self, a: PlainBytes, b: PieceEncoder):
        self.a, self.b, self.raw_b, self.lengths_b = a, b, b.vocabulary.shown, b.vocabulary.lengths
        n_a, n_b = len(a.raw), len(self.raw_b)
        self.n_b = n_b
        # a token as written, by id and whether it ends its group: A's first, then B's
        self.shown = [f"{i}{end}" for i in range(n_a) for end in ",|"] + [f"{i}{end}" for i in range(n_b) for end in ",;"]

    def align(self, texts: list[str | None]):
        """Lists of n_a, n_b, n_groups, groups, and of links as one struct array with its offsets."""
        out: list[list] = [[], [], [], []]
        links, ends = [], [0]
        at = 0
        while at < len(texts):
            size, upto = 0, at
            while upto < len(texts) and (upto == at or size + len(texts[upto] or "") <= CHARS):
                size += len(texts[upto] or "")
                upto += 1
            *columns, abn, counts = self._some(texts[at:upto])
            for have, more in zip(out, columns):
                have.extend(more)
            links.append(abn)
            ends.extend((ends[-1] + np.cumsum(counts)).tolist())
            at = upto
        flat = np.concatenate(links, axis=1) if links else np.zeros((3, 0), np.int32)
        return out, flat, ends

    def _some(self, texts):
        full = [" " + t if t else "" for t in texts]
        ids_a, upto_a = self.a.encode(full)
        ids_b, upto_b = self.b.encode([t or "" for t in texts])
        raw_a, raw_b, list_a, list_b = self.a.raw, self.raw_b, ids_a.tolist(), ids_b.tolist()
        same = np.zeros(len(texts), bool)
        for k, t in enumerate(full):
            want = t.encode()
            same[k] = bool(t) and b"".join(map(raw_b.__getitem__, list_b[upto_b[k]:upto_b[k + 1]])) == want \
                and b"".join(map(raw_a.__getitem__, list_a[upto_a[k]:upto_a[k + 1]])) == want
        n_a, n_b = np.diff(upto_a) * same, np.diff(upto_b) * same
        if not same.all():  # texts whose bytes the tokens do not give have no tokens
            ids_a, ids_b = ids_a[np.repeat(same, np.diff(upto_a))], ids_b[np.repeat(same, np.diff(upto_b))]
        upto_a, upto_b = np.cumsum([0, *n_a]), np.cumsum([0, *n_b])
        cut_a, cut_b = common_ends(np.cumsum(self.a.lengths[ids_a]), np.cumsum(self.lengths_b[ids_b]), upto_a)
        last_a, last_b = np.flatnonzero(cut_a), np.flatnonzero(cut_b)
        groups = np.searchsorted(last_a, upto_a)  # groups up to each text's end

        # in the written form a group's tokens of A stand before its tokens of B
        first_b, many_a = np.append(0, last_b + 1), np.append(last_a + 1, len(ids_a))
        written = np.empty(len(ids_a) + len(ids_b), np.int64)
        written[np.arange(len(ids_a)) + first_b[np.cumsum(cut_a) - cut_a]] = 2 * ids_a.astype(np.int64) + cut_a
        written[np.arange(len(ids_b)) + many_a[np.cumsum(cut_b) - cut_b]] = 2 * (len(raw_a) + ids_b.astype(np.int64)) + cut_b
        shown, pieces = self.shown.__getitem__, written.tolist()
        starts = (upto_a + upto_b).tolist()
        text = ["".join(map(shown, pieces[i:j]))[:-1] for i, j in zip(starts, starts[1:])]

        # different links of each text, with how often they occur
        span = np.int64(len(raw_a)) * self.n_b
        row = np.repeat(np.arange(len(texts)), np.diff(groups))
        key, n = np.unique(row * span + ids_a[last_a].astype(np.int64) * self.n_b + ids_b[last_b], return_counts=True)
        pair = key % span
        abn = np.stack([pair // self.n_b, pair % self.n_b, n]).astype(np.int32)
        return n_a.tolist(), n_b.tolist(), np.diff(groups).tolist(), text, abn, np.bincount(key // span, minlength=len(texts))


def align(df: DataFrame, byte_file: str, piece_model: str, text: str = "text") -> DataFrame:
    """``df`` with n_a, n_b, n_groups, groups and links of each row.

    ``groups`` is written ``a1,a2|b1;a3|b2,b3`` in ids. A link is a pair of
    tokens that end together; ``links`` holds a row's different id pairs (a, b)
    with their number n. Rows with null or empty texts, or whose tokens do not
    spell the text behind a space, have zeros and empty values. Equal rows give
    equal results; input columns with these names are replaced. A text is
    aligned as a whole, in memory of about 150 bytes a token.
    """
    with open(byte_file, "rb") as f:
        vocabulary = publish(df.sparkSession, "bpe-vocabulary", f.read())
    load = PieceCodec(df.sparkSession, piece_model).loader(check=False)
    fields = [("n_a", T.LongType()), ("n_b", T.LongType()), ("n_groups", T.LongType()), ("groups", T.StringType()),
              ("links", T.ArrayType(LINK))]

    def make():
        from pyspark.sql.pandas.types import to_arrow_type

        with open(local_path(vocabulary), "rb") as f:
            aligner = Aligner(PlainBytes(Vocabulary(f.read())), PlainPieces(load().vocabulary))
        kind = to_arrow_type(fields[-1][1])

        def work(texts):
            columns, abn, ends = aligner.align(texts)
            items = pa.StructArray.from_arrays([pa.array(x) for x in abn], fields=list(kind.value_type))
            return [*columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items, type=kind)]

        return work

    return append(df, [text], fields, make)


def weigh(aligned: DataFrame, pairs_limit: int = PAIRS) -> DataFrame:
    """``aligned`` without ``links`` but with n_links, n_best and count_sum.

    A pair's count is the number of links with it in all rows. ``n_best`` are
    the links whose pair has the highest count of its B id, ties included;
    ``count_sum`` adds the counts of a row's links. The rows are written once to
    the shared folder. Counts are sent to the executors where there are at most
    ``pairs_limit``; more are joined by a shuffle in which hot pairs are spread.
    """
    spark = aligned.sparkSession
    row = "__row"
    path = scratch(spark, "aligned")
    rest = aligned.drop("links")
    aligned.withColumn(row, F.monotonically_increasing_id()).write.parquet(path)
    stored = spark.read.parquet(path)
    links = stored.select(row, F.inline("links"))
    links.groupBy("a", "b").agg(F.sum("n").alias("total")).write.parquet(f"{path}-pairs")
    pairs = spark.read.parquet(f"{path}-pairs")
    most = pairs.groupBy("b").agg(F.max("total").alias("most"))  # a row for each id of B
    scored = pairs.join(F.broadcast(most), "b").select("a", "b", "total", (F.col("total") == F.col("most")).cast("long").alias("best"))
    if pairs.count() <= pairs_limit:
        joined = links.join(F.broadcast(scored), ["a", "b"])
    else:
        joined = skew_join(links, scored, ["a", "b"])
    sums = joined.groupBy(row).agg(
        F.sum("n").alias("__n"), F.sum(F.col("n") * F.col("best")).alias("__best"), F.sum(F.col("n") * F.col("total")).alias("__sum"))
    found = {"n_links": "__n", "n_best": "__best", "count_sum": "__sum"}
    out = stored.join(sums, row, "left")
    return out.select(*[c for n, c in zip(rest.columns, own(rest)) if n not in found],
                      *[F.coalesce(F.col(c), F.lit(0)).alias(n) for n, c in found.items()])
