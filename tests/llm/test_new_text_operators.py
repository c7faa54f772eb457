"""Pieces, alignment and phrases against the libraries and brute force, and on nulls, empty, long and odd texts."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabloom.llm import bpe, lockstep, phrases, pieces, quotient

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LONG = "wort " * 4000 + "x" * 3000
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "The cat sat on the mat,\n\nand the  dog ran."), (4, "The cat sat on the mat,\n\nand the  dog ran."),
       (None, "a b"), (6, LONG), (7, "naïve café 東京 🙂 <s> <0x41> </s>▁▁ it's\x01 12½\x85 end\n"), (8, "\x00\n\x01")]


def table(spark, rows, extra=""):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in extra.split():
        df = df.withColumn(c, F.lit("mine"))
    return df


def mixes(seed, n, parts=("a", "b", "the", "ing", " ", "  ", "\n", "▁", "\x01", "\x00", "é", "東", "🙂", "<s>", "<0x41>", ".", "\t")):
    r = random.Random(seed)
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


# 11: pieces

def test_pieces_equal_the_library_and_decode(spark, library):
    df = table(spark, ODD + [(100 + i, t) for i, t in enumerate(mixes(1, 500))], "piece_ids other")
    codec = pieces.PieceCodec(spark, PIECES)
    out = codec.encode(df, decoded="back")
    assert out.columns == ["doc_id", "text", "other", "piece_ids", "back"]
    got = codec.decode(out, text="again").collect()
    assert len(got) == df.count()
    for r in got:
        want = library.encode(r.text or "")
        assert list(r.piece_ids) == want and r.back == library.decode(want) == r.again


def test_pieces_over_code_points_and_any_ids(library):
    with open(PIECES, "rb") as f:
        encoder = pieces.PieceEncoder(pieces.PieceVocabulary(f.read()))
    r = random.Random(3)
    points = [*range(1, 0x3000, 3), *range(0x3000, 0xD800, 31), *range(0xE000, 0x11000, 31), *range(0x11000, 0x110000, 997)]
    texts = [f"x{chr(p)} {chr(p)}y" for p in points] + mixes(2, 4000)
    flat, ends = encoder.encode(texts)
    for t, a, b in zip(texts, ends, ends[1:]):
        assert flat[a:b].tolist() == library.encode(t), t
    for _ in range(4000):
        ids = [r.choice([r.randint(0, 300), r.randint(0, 31_999)]) for _ in range(r.randint(0, 6))]
        assert encoder.vocabulary.decode(ids) == library.decode(ids)


def test_pieces_check_stops_on_other_ids():
    with open(PIECES, "rb") as f:
        vocabulary = pieces.PieceVocabulary(f.read())
    vocabulary.loss = {p: s for p, s in vocabulary.loss.items() if p != "▁the"}
    with pytest.raises(RuntimeError):
        pieces.PieceEncoder(vocabulary).encode(["on the mat"])
    flat, _ = pieces.PieceEncoder(vocabulary, check=False).encode(["on the mat"])
    assert len(flat) > 3


def test_pieces_without_rows(spark):
    assert pieces.PieceCodec(spark, PIECES).encode(table(spark, []), decoded="back").count() == 0


# 12: alignment

def brute_alignment(texts, library):
    """By the libraries, sets of ends and plain counting."""
    tokenizer = Tokenizer.from_file(BYTES)
    tokenizer.encode_special_tokens = True
    with open(BYTES, "rb") as f:
        raw = bpe.Vocabulary(f.read()).bytes_of
    piece = [bytes([int(p[3:5], 16)]) if library.is_byte(i) else p.replace("▁", " ").encode()
             for i in range(library.get_piece_size()) for p in [library.id_to_piece(i)]]
    rows, counts = [], Counter()
    for t in texts:
        a, b = tokenizer.encode(" " + t, add_special_tokens=False).ids if t else [], library.encode(t or "")
        want = (" " + (t or "")).encode()
        if not t or b"".join(raw[i] for i in a) != want or b"".join(piece[i] for i in b) != want:
            rows.append((0, 0, 0, "", []))
            continue
        ends_a = [sum(len(raw[i]) for i in a[:k + 1]) for k in range(len(a))] if len(a) < 300 else list(running(len(raw[i]) for i in a))
        ends_b = list(running(len(piece[i]) for i in b))
        groups, links, at_a, at_b = [], [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            to_a, to_b = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append(f"{','.join(map(str, a[at_a:to_a]))}|{','.join(map(str, b[at_b:to_b]))}")
            links.append((a[to_a - 1], b[to_b - 1]))
            at_a, at_b = to_a, to_b
        counts.update(links)
        rows.append((len(a), len(b), len(groups), ";".join(groups), links))
    most = {b: max(n for (_, x), n in counts.items() if x == b) for b in {b for _, b in counts}}
    return [(n_a, n_b, n, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), text)
            for n_a, n_b, n, text, links in rows]


def running(lengths):
    total = 0
    for n in lengths:
        total += n
        yield total


ALIGNED = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


@pytest.mark.parametrize("limit", [lockstep.PAIRS, 0])
def test_alignment_by_brute_force(spark, library, limit):
    texts = [t for _, t in ODD if t != LONG] + ["wort " * 300, "x" * 900] + mixes(5, 150, ("a", "The ", "ing", " ", "  ", "\n", "▁", "é", "東", "🙂", "<s>", "<|endoftext|>", "123", ".", "\t"))
    df = table(spark, list(enumerate(texts)), "links n_best other").repartition(3)
    got = lockstep.weigh(lockstep.align(df, BYTES, PIECES), limit)
    assert set(got.columns) == {"doc_id", "text", "other", *ALIGNED}
    rows = {r.doc_id: tuple(r[c] for c in ALIGNED) for r in got.collect()}
    assert [rows[i] for i in range(len(texts))] == brute_alignment(texts, library)
    assert len({rows[i] for i, t in enumerate(texts) if t == ODD[3][1]}) == 1  # repeated rows agree


def test_lanes_do_not_change_the_cuts():
    r = random.Random(4)
    for _ in range(200):
        ends_a, ends_b, texts, at = [], [], [0], 0
        for _ in range(r.randint(0, 5)):
            size = r.randint(1, 60)
            a, b = ({size, *r.sample(range(1, size + 1), r.randint(0, size))} for _ in "ab")
            ends_a += [at + x for x in sorted(a)]
            ends_b += [at + x for x in sorted(b)]
            at += size
            texts.append(len(ends_a))
        common = set(ends_a) & set(ends_b)
        for lane in (1, 3, 1000):
            cut_a, cut_b = lockstep.common_ends(np.array(ends_a, np.int64), np.array(ends_b, np.int64), np.array(texts), lane)
            assert {e for e, c in zip(ends_a, cut_a) if c} == common == {e for e, c in zip(ends_b, cut_b) if c}


def test_alignment_of_long_texts_and_no_rows(spark):
    got = lockstep.weigh(lockstep.align(table(spark, [(1, LONG), (1, LONG)]), BYTES, PIECES)).collect()
    assert len(got) == 2 and got[0] == got[1] and got[0].n_links == got[0].n_groups > 4000
    assert lockstep.weigh(lockstep.align(table(spark, []), BYTES, PIECES)).count() == 0


# 13: phrases

def brute_phrases(rows, least, top):
    words, grams = Counter(), Counter()
    for text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            found = re.findall("[^ \t]+", piece)
            words.update(("und" if lang is None else lang, w) for w in found)
            for k in (2, 3):
                grams.update(("und" if lang is None else lang, *found[i:i + k]) for i in range(len(found) - k + 1))
    f = {**{k: n for k, n in words.items()}, **grams}
    often = {g: n for g, n in grams.items() if n >= least}
    out = {}
    for (lang, *g), a in often.items():
        if any(100 * n >= 50 * a and len(h) > len(g) + 1 and h[0] == lang and any(list(h[i:i + len(g)]) == g for i in range(1, len(h)))
               for h, n in often.items()):
            continue
        cuts = [(1_000_000 * a * a // (f[(lang, *g[:k])] * f[(lang, *g[k:])]), k) for k in range(1, len(g))]
        s, k = min(cuts)
        out.setdefault(lang, []).append((-s, -a, " ".join(g).encode(), f[(lang, *g[:k])], f[(lang, *g[k:])]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, sum(n for (x, _), n in words.items() if x == lang), -s)
                  for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


def phrase_rows(seed, n):
    r = random.Random(seed)
    parts = ["new", "York", "city", "the", "NEW", "é", "É", "of", "x\xa0y", "a", "b"]
    seps = [" "] * 12 + ["  ", "\t", ", ", ". ", "\n", "\r", "\x0b", "\x1c", "; "]
    made = [("".join(r.choice(parts) + r.choice(seps) for _ in range(r.randint(0, 40))), r.choice(["en", "de", None, "und"])) for _ in range(n)]
    return [*made, (None, "en"), ("", None), ("new york city " * 300, "en"), (" , ", "only marks"), *made[:5]]


NAMES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("limit, least, top, ranges", [(phrases.LEXICON, 3, 7, None), (phrases.LEXICON, 10, 2000, 1), (4, 3, 2000, 2), (0, 4, 30, None)])
def test_phrases_by_brute_force(spark, limit, least, top, ranges):
    rows = phrase_rows(limit % 7, 120)
    df = spark.createDataFrame(rows, "text string, lang string").withColumn("phrase", F.lit("mine")).withColumn("n", F.lit(1)).repartition(4)
    got = phrases.collocations(df, least=least, top=top, limit=limit, ranges=ranges)
    assert got.columns == NAMES
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows, least, top)


def test_phrases_without_rows(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    r = random.Random(8)
    rows = [(a, r.randint(a, 10**13), r.randint(a, 10**13)) for a in (r.randint(10, 10**12) for _ in range(300))]
    df = spark.createDataFrame(rows, "a long, l long, r long").withColumn("s", phrases.score(F.col("a"), F.col("l"), F.col("r")))
    assert all(x.s == 1_000_000 * x.a**2 // (x.l * x.r) for x in df.collect())


def test_filters_lose_nothing():
    r = np.random.default_rng(6)
    for bits in (1, 3, 8, 17, 33, 60, 63):
        mix = quotient.Permutation(bits)
        keys = r.integers(0, 2**bits, 3000, dtype=np.uint64)
        assert (mix.unmix(mix.mix(keys)) == keys).all()
        assert len(np.unique(mix.mix(np.unique(keys)))) == len(np.unique(keys))
        counter, want = quotient.Counter(bits, 500), Counter()
        parts = []
        for chunk in np.array_split(keys[r.integers(0, 400, 5000)], 13):
            want.update(chunk.tolist())
            if counter.add(chunk):
                parts.append(quotient.pack(*counter.take(), bits))
        parts.append(quotient.pack(*counter.take(), bits))
        parts.append(quotient.pack(np.zeros(0, np.uint64), np.zeros(0, np.int64), bits))
        slots, counts = quotient.merge([quotient.unpack(p) for p in parts])
        assert (slots[1:] > slots[:-1]).all()
        assert dict(zip(mix.unmix(slots).tolist(), counts.tolist())) == want
    one = quotient.unpack(quotient.pack(np.array([5], np.uint64), np.array([10**15]), 20))
    assert one[0].tolist() == [5] and one[1].tolist() == [10**15]


def test_phrases_equal_their_sql(spark, data):
    import duckdb

    from tabloom.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    got = sorted(tuple(r[c] for c in NAMES) for r in QUERIES["op13_phrases"](spark, data).collect())
    assert got == sorted(con.execute(f"SELECT {', '.join(NAMES)} FROM ({ORACLES['op13_phrases']})").fetchall()) and got
