"""Benchmark decontamination by pigeonhole pieces and bit-parallel edit distance.

An item of m characters may be found with up to k = m / 20 edits. Cut into
k + 1 pieces, at least one piece of every such occurrence is untouched, so an
automaton of all pieces finds the candidates and the distance confirms them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.order import numbered, running_totals
from tabloom.functions.skew import skew_join
from tabloom.llm.archive import opened
from tabloom.llm.arrow import append
from tabloom.session import checkpoint
from tabloom.sources.io import scratch

PER_EDIT = 20  # characters of an item for each edit allowed
BLOCK = 2_000_000  # characters of different items that one pass over the texts searches for

HITS = T.ArrayType(T.StructType([
    T.StructField("item", T.LongType()), T.StructField("distance", T.IntegerType()),
    T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))

# ASCII punctuation and white space become spaces; other characters stay.
PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def normal(text: str | None) -> str:
    """Lower case, words joined by one space."""
    return b" ".join((text or "").lower().encode().translate(PLAIN).split()).decode()


def edit_budget(item: str) -> int:
    return len(item) // PER_EDIT


class Myers:
    """Distance of a pattern to the best-fitting part of a text, one machine word of any length a character."""

    def __init__(self, pattern: str):
        self.m, self.at = len(pattern), {}
        for i, c in enumerate(pattern):
            self.at[c] = self.at.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """(distance, end) of the closest part, the earliest of equals."""
        mask, top, get = (1 << self.m) - 1, 1 << (self.m - 1), self.at.get
        up, down, score = mask, 0, self.m
        best = (score, 0)
        for j, c in enumerate(text):
            same = get(c, 0)
            vertical = same | down
            across = (((same & up) + up) ^ up) | same
            more, less = down | ~(across | up) & mask, up & across
            if more & top:
                score += 1
            elif less & top:
                score -= 1
                if score < best[0]:
                    best = (score, j + 1)
            more, less = more << 1, less << 1
            up = (less | ~(vertical | more)) & mask
            down = more & vertical & mask
        return best


class Searcher:
    """All pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.owners: dict[str, list[tuple[int, int]]] = {}
        self.patterns: list[tuple[str, int, list[int]]] = []
        ids: dict[str, list[int]] = {}
        for item_id, text in items:
            if text:
                ids.setdefault(text, []).append(item_id)
        self.automaton = ahocorasick.Automaton()
        for number, (text, own) in enumerate(sorted(ids.items())):
            k = edit_budget(text)
            if not k:
                text = f" {text} "  # too short for an edit: whole words only
            self.patterns.append((text, k, sorted(set(own))))
            cuts = [len(text) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                self.owners.setdefault(text[a:b], []).append((number, a))
        for piece in self.owners:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.forward: dict[int, Myers] = {}
        self.backward: dict[int, Myers] = {}

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end) of each item's best occurrence, places in the padded normal form."""
        if not self.owners or not text:
            return []
        text = f" {text} "
        windows: dict[int, set[int]] = {}
        for end, piece in self.automaton.iter(text):
            first = end - len(piece) + 1
            for number, offset in self.owners[piece]:
                windows.setdefault(number, set()).add(first - offset)
        found = []
        for number, starts in windows.items():
            pattern, k, ids = self.patterns[number]
            hit = self._best(number, pattern, k, text, sorted(starts))
            if hit is not None:
                found.extend((item, *hit) for item in ids)
        return sorted(found)

    def _best(self, number: int, pattern: str, k: int, text: str, starts: list[int]):
        at = text.find(pattern)
        if at >= 0:
            return 0, at, at + len(pattern)
        if not k:
            return None
        m, best, spans = len(pattern), None, []
        for s in starts:
            a, b = max(0, s - k), min(len(text), s + m + k)
            if spans and a <= spans[-1][1]:
                spans[-1][1] = b
            else:
                spans.append([a, b])
        forward = self.forward.setdefault(number, None) or Myers(pattern)
        self.forward[number] = forward
        for a, b in spans:
            distance, end = forward.best(text[a:b])
            if distance <= k and (best is None or distance < best[0]):
                best = (distance, a, a + end)
        if best is None:
            return None
        backward = self.backward.setdefault(number, None) or Myers(pattern[::-1])
        self.backward[number] = backward
        distance, a, end = best
        _, length = backward.best(text[max(0, end - m - distance):end][::-1])
        return distance, end - length, end


class Benchmark:
    """Items made ready to be searched for, in blocks of bounded size in the shared folder.

    Items are normalised and made different in Spark, so equal ones are searched
    for once; their ids, of any type and null among them, are joined to what is
    found. Tasks read a block's file themselves: no item passes through the
    driver. A block holds at most ``BLOCK`` characters and one item more.
    """

    def __init__(self, path: str, blocks: list[int], ids: DataFrame):
        self.path, self.blocks, self.ids = path, blocks, ids

    @classmethod
    def fit(cls, benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Benchmark:
        spark = benchmark.sparkSession
        path = scratch(spark, "benchmark")
        given = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("norm"))
        normed = append(given, ["norm"], [("norm", T.StringType())], lambda: lambda texts: [[normal(t) for t in texts]])
        normed.filter(F.col("norm") != "").write.parquet(f"{path}/items")
        items = spark.read.schema(normed.schema).parquet(f"{path}/items")
        texts = numbered(items.select("norm").distinct(), "item")
        sized = texts.select("item", "norm", F.char_length("norm").cast("long").alias("n"), F.lit(0).alias("g"),
                             F.floor(F.col("item") / 65_536).alias("blk"))
        before = F.col("cum_n") - F.col("n")
        placed = checkpoint(running_totals(sized, ["g"], "blk", [F.col("item")], ["n"]).select(
            "item", "norm", F.floor(before / BLOCK).alias("block")))
        placed.repartition("block").write.partitionBy("block").parquet(f"{path}/blocks")
        blocks = sorted(r["block"] for r in placed.select("block").distinct().collect())  # a number a block
        ids = skew_join(items, placed.select("item", "norm"), ["norm"]).select("item", "item_id")
        return cls(path, blocks, ids)

    def _search(self, block: int):
        path = f"{self.path}/blocks/block={block}"

        def make():
            import pyarrow.dataset as ds

            store, root = opened(path)
            items = ds.dataset(root, format="parquet", filesystem=store).to_table(columns=["item", "norm"])
            searcher = Searcher(list(zip(items["item"].to_pylist(), items["norm"].to_pylist())))
            return lambda texts: [[searcher.search(normal(t)) for t in texts]]

        return make

    def find(self, df: DataFrame, text: str = "text", hits: str = "hits") -> DataFrame:
        """``df`` with the items found in each text. More blocks than one are searched for one after the other,
        each in a pass of its own over the written rows, so an executor holds one block's automaton at a time."""
        if not self.blocks:
            return df.withColumn(hits, F.array().cast(HITS))
        if len(self.blocks) == 1:
            return append(df, [text], [(hits, HITS)], self._search(self.blocks[0]))
        spark, path, row = df.sparkSession, scratch(df.sparkSession, "searched"), "__row"
        df.withColumn(row, F.monotonically_increasing_id()).write.parquet(f"{path}/rows")
        stored = spark.read.parquet(f"{path}/rows")
        for b in self.blocks:
            found = append(stored.select(row, F.col(text).alias("__text")), ["__text"], [("__hits", HITS)], self._search(b))
            found.filter(F.size("__hits") > 0).select(row, "__hits").write.parquet(f"{path}/found/{b}")
        found = spark.read.parquet(*[f"{path}/found/{b}" for b in self.blocks])
        merged = found.groupBy(row).agg(F.array_sort(F.flatten(F.collect_list("__hits"))).alias("__hits"))  # a list a block
        out = stored.drop(hits).join(merged, row, "left")
        return out.withColumn(hits, F.coalesce("__hits", F.array().cast(HITS))).drop(row, "__hits")

    def named(self, found: DataFrame, keep: list[str], hits: str = "hits") -> DataFrame:
        """A row for each text and item found in it: the kept columns, item_id, distance, start and end.

        Items of equal text are all named. Kept columns of these names give way.
        """
        new = ["item_id", "distance", "start", "end"]
        kept = [c for c in keep if c not in new]
        rows = found.select(*[found[c].alias(f"__k{i}") for i, c in enumerate(kept)], F.explode(hits).alias("h"))
        flat = rows.select(*[F.col(f"__k{i}") for i in range(len(kept))], F.col("h.item").alias("item"), "h.distance", "h.start", "h.end")
        named = skew_join(checkpoint(flat), self.ids, ["item"])  # written once, as the join counts its keys first
        return named.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(kept)], *new)


def leaks(df: DataFrame, benchmark: DataFrame, text: str = "text", hits: str = "hits", item_id: str = "item_id",
          item_text: str = "text") -> DataFrame:
    """Adds the items found in each text with their edit distance, an empty list where there is none.

    Null and empty texts, and null or empty items, match nothing. A hit names
    its item by number; ``Benchmark.named`` gives the ids. An item shorter than
    20 characters must occur exactly, as whole words. Every row is searched for
    every item.
    """
    return Benchmark.fit(benchmark, item_id, item_text).find(df, text, hits)


def leak_rows(df: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item_id: str = "item_id",
              item_text: str = "text") -> DataFrame:
    """A row for each text and benchmark item found in it, the items by their own ids."""
    mark, ready = "__leaks", Benchmark.fit(benchmark, item_id, item_text)
    return ready.named(ready.find(df, text, mark), keep, mark)
