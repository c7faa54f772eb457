"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is a chain of characters, spaces shown as U+2581, with one put before it.
An agenda holds the adjacent pairs whose join is a piece, ordered by the piece's
score, the leftmost of equal ones first; the best pair is joined and its new
neighbours enter the agenda, until it is empty. Characters that are no piece
become byte pieces.

No merge crosses two characters that no piece has side by side. Space symbols
after other characters and line breaks are such places, so texts fall into
chunks, and chunks into parts, that never influence each other. A task remembers
the ids of both. The new parts of every Arrow batch are also encoded by the
sentencepiece library, and other ids stop the job.
"""

from __future__ import annotations

import codecs
import heapq
import math
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tabloom.llm.arrow import append, local_path, publish

SPACE = "▁"
CACHED = 400_000  # chunks whose ids a task remembers
HEAP = 32  # symbols from which the agenda is a heap
LONG = 80  # characters beyond which a chunk is not remembered
MARK = "\x01"  # in a split text: the chunk that follows has no space before it

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class PieceVocabulary:
    """Pieces, scores and byte pieces of a model file, and the agenda that merges a chunk."""

    def __init__(self, raw: bytes):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=raw)
        ids = range(lib.get_piece_size())
        if any(lib.is_unused(i) for i in ids):
            raise ValueError("unused pieces are not supported")
        special = {i for i in ids if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i)}
        piece = [lib.id_to_piece(i) for i in ids]
        self.id = {p: i for i, p in enumerate(piece) if i not in special}
        self.loss = {p: -lib.get_score(i) for p, i in self.id.items()}
        self.byte = {int(piece[i][3:5], 16): i for i in special if lib.is_byte(i)}
        if len(self.byte) != 256:
            raise ValueError("the model has no byte fallback")
        self.raw = [p.encode() for p in piece]  # a piece's bytes in the text; None where it stands for no bytes
        self.control = frozenset(i for i in special if lib.is_control(i))
        for i in special:
            self.raw[i] = bytes([int(piece[i][3:5], 16)]) if lib.is_byte(i) else None
        self.shown = [b"" if r is None else r.replace(SPACE.encode(), b" ") for r in self.raw]
        self.shown[lib.unk_id()] = " ⁇ ".encode()
        self.lengths = np.array([len(s) if r is not None else 0 for s, r in zip(self.shown, self.raw)], np.int64)
        joined = [p for p in self.id if len(p) > 1]
        self.apart = not any(SPACE in p.lstrip(SPACE) for p in joined)  # chunks begin at spaces
        self.lines = self.apart and not any("\n" in p for p in joined)  # and at line breaks
        self.cut = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if self.lines else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.joined = {pair for p in joined for pair in zip(p, p[1:])}
        probe = "a  é́ ﬁ 東.\n b "
        if self.merge(SPACE + probe.replace(" ", SPACE)) != lib.encode(probe):
            raise ValueError("only merge-type models without normalisation are supported")

    def parts(self, chunk: str) -> list[str]:
        """The chunk cut between characters that no piece has side by side, which no merge can cross."""
        joined, at, out = self.joined, 0, []
        for i, pair in enumerate(zip(chunk, chunk[1:]), 1):
            if pair not in joined:
                out.append(chunk[at:i])
                at = i
        return [*out, chunk[at:]] if chunk else []

    def merge(self, chunk: str) -> list[int]:
        """Ids of one chunk, by the agenda: a list searched for its least loss, or a heap if it is long."""
        symbols = list(chunk)
        if len(symbols) > HEAP:
            self._join_by_heap(symbols)
        elif len(symbols) > 1:
            get, never = self.loss.get, math.inf
            agenda = [get(p, never) for p in map(str.__add__, symbols, symbols[1:])]
            while agenda and (best := min(agenda)) != never:
                i = agenda.index(best)
                piece = symbols[i] + symbols[i + 1]
                symbols[i:i + 2] = [piece]
                del agenda[i]
                if i:
                    agenda[i - 1] = get(symbols[i - 1] + piece, never)
                if i < len(agenda):
                    agenda[i] = get(piece + symbols[i + 1], never)
        own = list(map(self.id.get, symbols))
        if None not in own:
            return own
        return [x for s, i in zip(symbols, own) if s for x in ([i] if i is not None else [self.byte[b] for b in s.encode()])]

    def _join_by_heap(self, symbols: list[str]) -> None:
        """Joins in place; the right symbol of a pair is left empty."""
        loss, n = self.loss, len(symbols)
        agenda = [(loss[p], i, p) for i, p in enumerate(map(str.__add__, symbols, symbols[1:])) if p in loss]
        heapq.heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while agenda:
            _, i, piece = heapq.heappop(agenda)
            j = after[i]
            if j >= n or not symbols[i] or symbols[i] + symbols[j] != piece:
                continue  # one of the two has been joined elsewhere
            symbols[i], symbols[j] = piece, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (p := piece + symbols[k]) in loss:
                    heapq.heappush(agenda, (loss[p], i, p))
            k = before[i]
            if k >= 0 and (p := symbols[k] + piece) in loss:
                heapq.heappush(agenda, (loss[p], k, p))

    def decode(self, ids) -> str:
        """The text of the ids as the library gives it: the space put before the text is taken away."""
        runs: list[list[int]] = [[]]  # byte pieces on two sides of a control piece are not read together
        if self.control.isdisjoint(ids):
            runs = [ids]
        else:
            for i in ids:
                runs.append([]) if i in self.control else runs[-1].append(i)
        shown = [b"".join(map(self.shown.__getitem__, run)) for run in runs]
        first = next((run[0] for run in runs if run), None)
        lead = first is not None and self.raw[first] is not None and self.raw[first].startswith(SPACE.encode())
        text = "".join(s.decode("utf-8", "each_byte") for s in shown)
        return text[1:] if lead else text


class PieceEncoder:
    """Texts to ids in one task; ``check`` compares new chunks with the library."""

    def __init__(self, vocabulary: PieceVocabulary, check: bool = True):
        self.vocabulary, self.check = vocabulary, check
        self.known: dict[str, bytes] = {}  # ids of chunks by key
        self.before: dict[str, bytes] = {}
        self.ids: dict[str, bytes] = {}  # ids of parts by their characters

    def chunks(self, text: str) -> list[str]:
        """Keys of the text's chunks: a plain word stands for itself with a space before it."""
        v = self.vocabulary
        if not text:
            return []
        if v.lines and SPACE not in text and MARK not in text:
            spaced = text.replace("\n", f" \n {MARK}") if "\n" in text else text
            if "  " not in spaced and spaced[0] != " " and spaced[-1] != " ":
                return spaced.split(" ")
        shown = SPACE + text.replace(" ", SPACE)
        if not v.apart:
            return [SPACE + shown]
        return [SPACE + c for c in v.cut.findall(shown)]  # keys of this kind begin with one more symbol

    @staticmethod
    def spelt(key: str) -> str:
        """The chunk's characters."""
        if key[:1] == SPACE:
            return key[1:]
        if key[:1] == MARK:
            return key[1:]
        return key if key == "\n" else SPACE + key

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of them up to each text's end."""
        split = [self.chunks(t) for t in texts]
        if len(self.known) > CACHED:
            self.known, self.before = {}, self.known  # frequent chunks come back from the older half
        known, before = self.known, self.before
        found = [list(map(known.get, keys)) for keys in split]
        gaps = [k for k, parts in enumerate(found) if None in parts]
        new = {w: before.get(w) for k in gaps for w, ids in zip(split[k], found[k]) if ids is None}
        new |= self._ids_of([w for w, ids in new.items() if ids is None])
        known |= {w: ids for w, ids in new.items() if len(w) <= LONG}
        for k in gaps:
            found[k] = [new[w] if ids is None else ids for w, ids in zip(split[k], found[k])]
        rows = [b"".join(parts) for parts in found]
        return np.frombuffer(b"".join(rows), np.int32), np.cumsum([0, *map(len, rows)]) // 4

    def _ids_of(self, keys: list[str]) -> dict[str, bytes]:
        """Ids of chunks that are not known, by key."""
        parts = {w: self.vocabulary.parts(self.spelt(w)) for w in keys}
        fresh = {s: self.ids.get(s) for own in parts.values() for s in own}
        fresh |= (made := {s: array("i", self.vocabulary.merge(s)).tobytes() for s, ids in fresh.items() if ids is None})
        if made and self.check:
            self._compare(made)
        if len(self.ids) > CACHED:
            self.ids = {}
        self.ids |= {s: ids for s, ids in made.items() if len(s) <= LONG}
        return {w: b"".join(map(fresh.__getitem__, own)) for w, own in parts.items()}

    def _compare(self, made: dict[str, bytes]) -> None:
        """The new parts, one a line where line breaks part them, through the library."""
        alone = {s: ids for s, ids in made.items() if s != "\n"}
        if self.vocabulary.lines:
            lead, line = (array("i", self.vocabulary.merge(s)).tobytes() for s in (SPACE, "\n"))
            texts = ["".join("\n" + s for s in alone).replace(SPACE, " ")] if alone else []
            want = [lead + b"".join(line + ids for ids in alone.values())]
        else:  # only parts that begin with a space symbol are texts by themselves
            alone = {s: ids for s, ids in alone.items() if s.startswith(SPACE)}
            texts, want = [s[1:].replace(SPACE, " ") for s in alone], list(alone.values())
        for text, ids in zip(texts, want):
            if array("i", self.vocabulary.library.encode(text)).tobytes() != ids:
                raise RuntimeError("the sentencepiece library gives other ids for these texts")


class PieceCodec:
    """Encodes and decodes columns with a sentencepiece model of the merge type.

    Null texts are treated as empty: no ids, empty decoded text. Begin and end
    ids are not added; strings that look like special pieces are plain text.
    Equal rows give equal results; an input column with an output column's name
    is replaced.
    """

    def __init__(self, spark: SparkSession, model_path: str):
        with open(model_path, "rb") as f:
            raw = f.read()
        PieceVocabulary(raw)  # a model of another kind fails here
        self.model = publish(spark, "piece-model", raw)

    def loader(self, check: bool = True):
        """A function for tasks that gives an encoder."""
        model = self.model

        def load() -> PieceEncoder:
            with open(local_path(model), "rb") as f:
                return PieceEncoder(PieceVocabulary(f.read()), check)

        return load

    def encode(self, df: DataFrame, text: str = "text", ids: str = "piece_ids", decoded: str | None = None) -> DataFrame:
        """Adds the ids and, if named, the text decoded from them in the same pass."""
        load, both = self.loader(), decoded is not None
        fields = [(ids, T.ArrayType(T.IntegerType()))] + ([(decoded, T.StringType())] if both else [])

        def make():
            from pyspark.sql.pandas.types import to_arrow_type

            encoder, kind = load(), to_arrow_type(fields[0][1])

            def work(texts):
                flat, ends = encoder.encode([t or "" for t in texts])
                made = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat), type=kind)]
                if both:
                    listed = flat.tolist()
                    made.append([encoder.vocabulary.decode(listed[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())])
                return made

            return work

        return append(df, [text], fields, make)

    def decode(self, df: DataFrame, ids: str = "piece_ids", text: str = "decoded") -> DataFrame:
        """Adds the text of the ids; null ids give an empty text."""
        load = self.loader()

        def make():
            encoder = load()
            return lambda rows: [[encoder.vocabulary.decode(i or []) for i in rows]]

        return append(df, [ids], [(text, T.StringType())], make)
