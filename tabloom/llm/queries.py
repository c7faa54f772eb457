"""The registered queries of these operators, each over its whole table, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.archive import archived
from tabloom.llm.bpe import BpeCodec
from tabloom.llm.host_paths import main_text
from tabloom.llm.language import LanguageId, remainder
from tabloom.llm.line_crf import QualityClassifier
from tabloom.llm.lockstep import align, weigh
from tabloom.llm.phrases import collocations
from tabloom.llm.pieces import PieceCodec
from tabloom.llm.pigeonhole import leak_rows
from tabloom.llm.pii import BASE, PiiFinder, written
from tabloom.llm.quality import QualityRules, measure
from tabloom.llm.simhash import near_duplicates
from tabloom.llm.token_counts import token_counts
from tabloom.session import checkpoint

VOCABULARY = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def vocabulary_path() -> str:
    return public_tokenizers.path(VOCABULARY)


def pieces_path() -> str:
    return public_tokenizers.path(PIECES)


def load(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def digests(coded: DataFrame, ids: str) -> DataFrame:
    """Number and hash of the ids, hash of the decoded text."""
    return coded.select(
        "doc_id", F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col(ids).cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    return digests(BpeCodec.fit(docs, vocabulary_path()).encode(docs, decoded="decoded"), "token_ids")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = checkpoint(measure(load(spark, sf_dir, "documents", "doc_id", "text")).drop("text"))
    return QualityRules.fit_measured(measured).judge(measured).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("posterior", 6).alias("posterior"), "votes")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    return token_counts(docs, vocabulary_path()).select("doc_id", "n_words", "n_tokens")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    labels = load(spark, sf_dir, "labels", "doc_id", "quality")
    held_out = remainder(F.col("doc_id"), 3) == 1
    known = labels.filter(~held_out & F.col("quality").isin(0, 1))
    taught = docs.join(QualityClassifier.sample(known, "doc_id"), "doc_id").select("text", "quality")
    found = QualityClassifier.fit(taught).predict(docs)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages", "page_id", "url", "html")
    return archived(spark, pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages", "page_id", "url", "html")
    return main_text(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(load(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = LanguageId.fit(docs.filter(~held_out).select("text", "lang"))
    found = model.predict(docs.select("doc_id", "text"))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    found = leak_rows(docs, load(spark, sf_dir, "benchmark", "item_id", "text"), ["doc_id"])
    return found.withColumnsRenamed({"start": "start_at", "end": "end_at"})


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    found = PiiFinder.fit(docs).spans(docs)
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    counts = [F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in BASE]  # noqa: B023
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"),
                        written(F.col("spans")).alias("spans"))


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    return digests(PieceCodec(spark, pieces_path()).encode(docs, decoded="decoded"), "piece_ids")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    aligned = align(docs, vocabulary_path(), pieces_path())
    hashed = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return weigh(aligned.select("doc_id", "n_a", "n_b", "n_groups", hashed.alias("groups_sha256"), "links")).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(load(spark, sf_dir, "documents", "text", "lang"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_quality_rules": op2_quality_rules,
    "op3_token_counts": op3_token_counts,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_warc": op5_warc,
    "op6_html_text": op6_html_text,
    "op7_simhash": op7_simhash,
    "op8_language": op8_language,
    "op9_decontaminate": op9_decontaminate,
    "op10_pii": op10_pii,
    "op11_pieces": op11_pieces,
    "op12_alignment": op12_alignment,
    "op13_phrases": op13_phrases,
}

# SQL that repeats a result from the given tables alone.
ORACLES: dict[str, str] = {
    "op5_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
        o AS (SELECT d, n, max(page_id) AS original FROM p WHERE n >= 1000 GROUP BY d, n)
        SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest,
               CASE WHEN original IS NULL OR original = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN original <> page_id THEN original END AS refers_to
        FROM p LEFT JOIN o USING (d, n)""",
    "op13_phrases": r"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, coalesce(text, '') AS text FROM documents),
        p AS (SELECT lang, unnest(string_split_regex(
                  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
        w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
        g AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
        f1 AS (SELECT lang, w[i] AS a1, count(*) AS f FROM g GROUP BY ALL),
        f2 AS (SELECT lang, w[i] AS a1, w[i + 1] AS a2, count(*) AS f FROM g WHERE i + 1 <= len(w) GROUP BY ALL HAVING count(*) >= 10),
        f3 AS (SELECT lang, w[i] AS a1, w[i + 1] AS a2, w[i + 2] AS a3, count(*) AS f
               FROM g WHERE i + 2 <= len(w) GROUP BY ALL HAVING count(*) >= 10),
        n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
        c AS (SELECT f2.lang, f2.a1 || ' ' || f2.a2 AS phrase, f2.f AS a, x.f AS l1, y.f AS r1, NULL::BIGINT AS l2, NULL::BIGINT AS r2
              FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.a1 = f2.a1 JOIN f1 y ON y.lang = f2.lang AND y.a1 = f2.a2
              WHERE NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND f3.a1 = f2.a1 AND f3.a2 = f2.a2 AND 100 * f3.f >= 50 * f2.f)
                AND NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND f3.a2 = f2.a1 AND f3.a3 = f2.a2 AND 100 * f3.f >= 50 * f2.f)
              UNION ALL
              SELECT f3.lang, f3.a1 || ' ' || f3.a2 || ' ' || f3.a3, f3.f, x.f, t.f, h.f, y.f
              FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.a1 = f3.a1 JOIN f1 y ON y.lang = f3.lang AND y.a1 = f3.a3
              JOIN f2 h ON h.lang = f3.lang AND h.a1 = f3.a1 AND h.a2 = f3.a2
              JOIN f2 t ON t.lang = f3.lang AND t.a1 = f3.a2 AND t.a2 = f3.a3),
        s AS (SELECT *, (1000000::HUGEINT * a * a) // (l1::HUGEINT * r1) AS s1, (1000000::HUGEINT * a * a) // (l2::HUGEINT * r2) AS s2 FROM c),
        b AS (SELECT lang, phrase, a, CASE WHEN s2 < s1 THEN l2 ELSE l1 END AS l, CASE WHEN s2 < s1 THEN r2 ELSE r1 END AS r,
                     least(s1, coalesce(s2, s1)) AS score FROM s),
        k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM b)
        SELECT k.lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n.n, score::BIGINT AS score
        FROM k JOIN n ON n.lang = k.lang WHERE rank <= 2000""",
}
