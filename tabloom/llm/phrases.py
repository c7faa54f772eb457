"""Phrases of two and three words that occur together far more often than their parts suggest.

Words are counted first; those that occur often enough to be part of a candidate
get numbers. Each task then packs the numbers of every two and three words in a
row into one integer and counts it in a counting quotient filter. Filters are
cut by leading bits into ranges, shuffled by range and merged in order, one
range at a time; the mix behind them spreads any frequent phrase evenly. What
the merged filters hold often enough is turned back into words.
"""

from __future__ import annotations

import json
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.skew import skew_join
from tabloom.llm.arrow import gather, local_path, publish
from tabloom.operators.dedup import group_head
from tabloom.sources.io import scratch

LEAST = 10  # occurrences of a candidate
TOP = 2_000  # phrases of a language
SHARE = 50  # a longer candidate with this percentage of the occurrences takes a phrase's place
SCALE = 1_000_000
LEXICON = 2**20 - 1  # words that get numbers, the most frequent ones: the bound of what the driver and a task hold
CACHED = 400_000  # words counted in a task before it hands them on
BUFFER = 2**20  # keys gathered before they are sorted, and slots of a task's filter
RANGE = 2**18  # occurrences to a range of filters
RANGES = 2**16
NO_LANG = "und"

END = b"\xff"  # no byte of UTF-8: stands between pieces
PLAIN = bytes(0xFF if c in b".,;:!?\n\v\f\r" else c for c in range(256))


def word_list(text: str) -> list[bytes]:
    """The text's words in lower case, with ``END`` between pieces."""
    raw = text.encode().lower().translate(PLAIN)  # of bytes, so A-Z alone
    return raw.replace(END, b" \xff ").split()


def by_lang(texts, langs):
    """(language, its words with ``END`` after each text) of a batch."""
    lists: dict[str, list] = {}
    for text, lang in zip(texts, langs):
        if text:
            lists.setdefault(NO_LANG if lang is None else lang, []).append(word_list(text))
    for lang, rows in lists.items():
        yield lang, list(chain.from_iterable((*row, END) for row in rows))


def word_counts(df: DataFrame, text: str, lang: str) -> DataFrame:
    """Rows (lang, word, n) of all words."""
    def make():
        from collections import Counter

        counts: dict[str, Counter] = {}

        def flush():
            nonlocal counts
            made = [[], [], []]
            for name, words in counts.items():
                words.pop(END, None)
                made[0] += [name] * len(words)
                made[1] += [w.decode() for w in words]
                made[2] += words.values()
            counts = {}
            return made

        def add(texts, langs):
            for name, words in by_lang(texts, langs):
                counts.setdefault(name, Counter()).update(words)
            return flush() if sum(map(len, counts.values())) > CACHED else None

        return add, flush

    schema = df.select(F.lit("").alias("lang"), F.lit("").alias("word"), F.lit(0).cast("long").alias("n")).schema
    found = gather(df, [text, lang], [(f.name, f.dataType) for f in schema], make)
    return found.groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Lexicon:
    """Numbers of words, from 1, by language; read from one file."""

    def __init__(self, data: bytes):
        head, _, rest = data.partition(b"\n")
        spec = json.loads(head)
        self.complete, self.langs, sizes = spec["complete"], spec["langs"], spec["sizes"]
        cut = spec["bytes"]
        self.words = rest[:cut].split(b"\n") if cut else []
        self.counts = np.frombuffer(rest, np.int64, len(self.words), cut)
        self.starts = np.cumsum([0, *sizes])
        self.bits = max(1, len(self.words).bit_length())

    @staticmethod
    def file(rows: list[tuple[str, str, int]], complete: bool) -> bytes:
        rows = sorted(rows)
        langs = sorted({r[0] for r in rows})
        sizes = {name: 0 for name in langs}
        for name, _, _ in rows:
            sizes[name] += 1
        words = b"\n".join(w.encode() for _, w, _ in rows)
        head = json.dumps({"complete": complete, "langs": langs, "sizes": [sizes[x] for x in langs], "bytes": len(words)})
        return head.encode() + b"\n" + words + np.array([n for *_, n in rows], np.int64).tobytes()

    def numbers(self) -> dict[str, dict[bytes, int]]:
        return {name: dict(zip(self.words[a:b], range(a + 1, b + 1)))
                for name, a, b in zip(self.langs, self.starts.tolist(), self.starts[1:].tolist())}


def lexicon(counted: DataFrame, least: int, limit: int) -> bytes:
    """The file of the most frequent words; all words that occur ``least`` times if they are no more than ``limit``."""
    often = counted.filter(F.col("n") >= least)
    complete = often.count() <= limit
    if not complete:
        # a histogram finds the count that leaves at most ``limit`` words; which ones they are changes no result
        step, left, above = F.floor(F.log2("n") * 32), limit, None
        for r in often.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # 32 rows a doubling
            left -= r["count"]
            if left < 0:
                break
            above = r["step"]
        often = often.filter(step >= above) if above is not None else often.limit(0)
    table = often.toArrow()
    return Lexicon.file(list(zip(*(table.column(c).to_pylist() for c in ("lang", "word", "n")))), complete)


GRAMS = "range int, filter binary, lang string, words array<string>, n bigint"


def gram_counts(df: DataFrame, text: str, lang: str, name: str, ranges: int) -> DataFrame:
    """Filters of each task's phrases by range; phrases with a word that has no number as words."""
    schema = df.sparkSession.createDataFrame([], GRAMS).schema
    bits = ranges.bit_length() - 1

    def make():
        from collections import Counter as Plain

        from tabloom.llm.quotient import Counter, pack

        with open(local_path(name), "rb") as f:
            known = Lexicon(f.read())
        numbers, width = known.numbers(), known.bits
        low = 3 * width - bits  # bits of a key within its range
        counter = Counter(3 * width, BUFFER)
        other: dict[tuple, int] = Plain()

        def filters():
            keys, counts = counter.take()
            own = (keys >> np.uint64(low)).astype(np.int64)
            at = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
            inner = keys & np.uint64(2**low - 1)
            cuts = list(zip(at.tolist(), [*at[1:].tolist(), len(own)]))
            packed = [pack(inner[a:b], counts[a:b], low) for a, b in cuts]
            return [own[at].tolist(), packed, *([None] * len(cuts) for _ in range(3))]

        def plain():
            nonlocal other
            made = [[None] * len(other), [None] * len(other), [k[0] for k in other],
                    [[w.decode() for w in k[1:]] for k in other], list(other.values())]
            other = Plain()
            return made

        def add(texts, langs):
            full = False
            for name_, words in by_lang(texts, langs):
                ids = np.fromiter(map(numbers.get(name_, {}).get, words, repeat(0)), np.int64, len(words))
                two = (ids[:-1] > 0) & (ids[1:] > 0)
                three = two[:-1] & two[1:]
                pairs = (ids[:-1] << 2 * width) | (ids[1:] << width)
                triples = pairs[:-1][three] | ids[2:][three]
                full = counter.add(np.concatenate([pairs[two], triples])) or full
                if not known.complete:
                    for i in np.flatnonzero(ids == 0).tolist():
                        if words[i] == END:
                            continue
                        for size in (2, 3):
                            for a in range(max(0, i - size + 1), min(i, len(words) - size) + 1):
                                phrase = words[a:a + size]
                                # counted at its first word without a number
                                if END not in phrase and (ids[a:i] > 0).all():
                                    other[(name_, *phrase)] += 1
            made = filters() if full else None
            if len(other) > CACHED:
                rest = plain()
                made = [x + y for x, y in zip(made, rest)] if made else rest
            return made

        def finish():
            return [x + y for x, y in zip(filters(), plain())]

        return add, finish

    return gather(df, [text, lang], [(f.name, f.dataType) for f in schema], make)


def merged(filters: DataFrame, name: str, ranges: int, least: int) -> DataFrame:
    """Phrases that occur ``least`` times, from all tasks' filters; a range is merged at a time."""
    bits = ranges.bit_length() - 1
    parts = min(ranges, max(int(filters.sparkSession.conf.get("spark.sql.shuffle.partitions")), ranges // 64))
    dealt = filters.repartition(parts, "range").sortWithinPartitions("range")
    schema = "lang string, words array<string>, n bigint, first bigint, last bigint"

    def run(batches):
        from tabloom.llm.quotient import Permutation, merge, unpack

        with open(local_path(name), "rb") as f:
            known = Lexicon(f.read())
        width, permutation = known.bits, Permutation(3 * known.bits)
        low, mask = np.uint64(3 * width - bits), (1 << width) - 1

        def rows(number, held):
            keys, counts = merge(held)
            often = counts >= least
            whole = permutation.unmix(keys[often] | (np.uint64(number) << low)).astype(np.int64)
            ids = [(whole >> shift) & mask for shift in (2 * width, width, 0)]
            if not len(whole):
                return
            words = [[known.words[i - 1].decode() for i in row if i] for row in zip(*(x.tolist() for x in ids))]
            langs = np.searchsorted(known.starts, ids[0], "left") - 1
            last = np.where(ids[2] > 0, ids[2], ids[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([known.langs[i] for i in langs.tolist()]), pa.array(words, pa.list_(pa.string())),
                 pa.array(counts[often]), pa.array(known.counts[ids[0] - 1]), pa.array(known.counts[last - 1])],
                names=["lang", "words", "n", "first", "last"])

        current, held, waiting = None, [], 0
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if number != current and held:
                    yield from rows(current, held)
                    held, waiting = [], 0
                current = number
                held.append(unpack(data.as_py()))
                waiting += len(held[-1][0])
                if waiting > max(RANGE, 2 * len(held[0][0])) and len(held) > 1:
                    held, waiting = [merge(held)], 0
        if held:
            yield from rows(current, held)

    return dealt.mapInArrow(run, schema)


def exact(c: Column) -> Column:
    return c.cast("decimal(15,0)")


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE * a * a / (left * right)), exact for counts below 10 ** 15."""
    return F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * (exact(a) * exact(a)), exact(left) * exact(right))


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int | None = TOP,
                 limit: int = LEXICON, ranges: int | None = None) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score), the best ``top`` of each language or all.

    Words are runs without space and tab, in lower case (A-Z), of pieces between
    ``.,;:!?`` and line ends. ``a`` counts the phrase, ``l`` and ``r`` its two
    parts at the cut with the lowest score, ``n`` all words of the language. A
    candidate inside a longer one with half of its occurrences is dropped. Null
    texts have no words, a null language is ``und``; repeated rows count again;
    no rows give no rows. Ties of score go to the larger ``a``, then to the
    phrase that sorts first by bytes.
    """
    spark = df.sparkSession
    source = df.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    path = scratch(spark, "phrases")
    word_counts(source, "text", "lang").write.parquet(f"{path}/words")
    counted = spark.read.parquet(f"{path}/words")
    totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # a row a language
    data = lexicon(counted, least, limit)
    known, name = Lexicon(data), publish(spark, "phrase-lexicon", data)
    if ranges is None:
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        wanted = max(2 * sum(totals.values()) // RANGE, 8 * tasks)
        ranges = min(RANGES, 2 ** max(0, 3 * known.bits - 8), 2 ** (wanted - 1).bit_length())

    grams = gram_counts(source, "text", "lang", name, ranges)
    if known.complete:
        merged(grams.select("range", "filter"), name, ranges, least).write.parquet(f"{path}/grams")
    else:
        grams.write.parquet(f"{path}/parts")
        parts = spark.read.parquet(f"{path}/parts")
        merged(parts.filter("range IS NOT NULL").select("range", "filter"), name, ranges, least).write.parquet(f"{path}/grams")
        rare = parts.filter("range IS NULL").groupBy("lang", "words").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
        often = counted.filter(F.col("n") >= least)
        for place, out in ((1, "first"), (-1, "last")):
            ends = often.select("lang", F.col("word").alias("__end"), F.col("n").alias(out))
            rare = skew_join(rare.withColumn("__end", F.element_at("words", place)), ends, ["lang", "__end"]).drop("__end")
        rare.select("lang", "words", "n", "first", "last").write.mode("append").parquet(f"{path}/grams")

    phrases = spark.read.parquet(f"{path}/grams").select(
        "lang", F.array_join("words", " ").alias("phrase"), F.size("words").alias("size"), F.col("n").alias("a"), "first", "last",
        F.array_join(F.slice("words", 1, F.size("words") - 1), " ").alias("head"),
        F.array_join(F.slice("words", 2, F.size("words") - 1), " ").alias("tail"))
    two, three = phrases.filter("size = 2"), phrases.filter("size = 3")
    inner = two.select("lang", F.col("phrase").alias("head"), F.col("a").alias("n_head"))
    three = skew_join(three.select("lang", "phrase", "a", "first", "last", "head", "tail"), inner, ["lang", "head"])
    three = skew_join(three, inner.withColumnsRenamed({"head": "tail", "n_head": "n_tail"}), ["lang", "tail"])
    three.write.parquet(f"{path}/three")
    three = spark.read.parquet(f"{path}/three")

    a = F.col("a")
    early, late = score(a, F.col("first"), F.col("n_tail")), score(a, F.col("n_head"), F.col("last"))
    at_first = early <= late
    scored = three.select("lang", "phrase", "a", F.when(at_first, F.col("first")).otherwise(F.col("n_head")).alias("l"),
                          F.when(at_first, F.col("n_tail")).otherwise(F.col("last")).alias("r"), F.least(early, late).alias("score"))
    longer = three.select("lang", F.explode(F.array("head", "tail")).alias("phrase"), "a").groupBy("lang", "phrase").agg(
        F.max("a").alias("longer"))
    pairs = two.join(longer, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (100 * F.col("longer") < SHARE * a))
    both = scored.unionByName(pairs.select("lang", "phrase", "a", F.col("first").alias("l"), F.col("last").alias("r"),
                                           score(a, F.col("first"), F.col("last")).alias("score")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = both if top is None else group_head(both, ["lang"], order, top)
    n = spark.createDataFrame(list(totals.items()), "lang string, n long")  # a row a language
    if top is None:
        return best.join(F.broadcast(n), "lang").select("lang", "phrase", "a", "l", "r", "n", "score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return best.withColumn("rank", rank).join(F.broadcast(n), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
