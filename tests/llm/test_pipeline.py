"""The corpus job on a small table with planted cases, stage by stage."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tabloom.llm import pigeonhole, queries

def clean(i, n=60):
    """Prose of invented words among function words, other in each row."""
    r = random.Random(i)
    word = lambda: "".join(r.choice(["ka", "lo", "mi", "ter", "sun", "ble"]) for _ in range(r.randint(1, 3)))
    words = [r.choice(["the", "of", "and", "to", "in", "was"]) if k % 3 == 0 else word() for k in range(n)]
    return " ".join(w + "." if k % 9 == 8 or k == n - 1 else w for k, w in enumerate(words))


ITEM = "Which of the old rivers in the north of the land was the first to be used for the trade in salt and in wood?"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = [(i, clean(i)) for i in range(20)] + [(30, clean(3)), (31, clean(3)), (5, clean(5)), (40, None), (41, ""),
            (42, " ".join(w + "***" for w in clean(7).split())), (43, clean(43) + ITEM + " " + clean(44)),
            (44, clean(45) + " mail to some.one@mail.example.com today")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "mine") for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, posterior string")
    path = str(tmp_path_factory.mktemp("corpus"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_take_effect_and_keep_clean_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        path = f"{folder}/{name}"
        out.write.parquet(path)
        if name != "encode":
            assert out.columns == docs.columns
        docs = spark.read.parquet(path)
        left.append(sorted(r.doc_id for r in docs.collect()))
    good = list(range(20))
    assert left[0] == sorted([*good, 5, 30, 31, 43, 44])
    assert left[1] == [*good, 43, 44]
    assert left[2] == left[3] == left[4] == [*good, 44]
    rows = {r.doc_id: r for r in docs.collect()}
    assert "[EMAIL]" in rows[44].text and rows[44].n_chars == len(rows[44].text) and rows[3].text == clean(3)
    library = Tokenizer.from_file(public_tokenizers.path(queries.VOCABULARY))
    assert all(list(r.token_ids) == library.encode(r.text, add_special_tokens=False).ids for r in rows.values())


def test_run_equals_the_stages_and_takes_an_empty_table(spark, folder, tmp_path):
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, folder).collect()) == [*range(20), 44]
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_have_the_columns_of_their_contracts(spark, data):
    want = {
        "op1_bpe": "doc_id n_tokens ids_sha256 decoded_sha256", "op2_quality_rules":
        "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op4_quality_classifier": "doc_id held_out score predicted",
        "op5_warc": "page_id payload_bytes payload_digest record_type refers_to", "op6_html_text": "page_id url text n_chars",
        "op7_simhash": "doc_id fingerprint component_id", "op8_language": "doc_id held_out lang_pred score",
        "op10_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans"}
    for name, columns in want.items():
        df = queries.QUERIES[name](spark, data)
        assert set(columns.split()) <= set(df.columns), name
        table = "pages" if "page_id" in columns else "documents"
        assert df.count() == spark.read.parquet(f"{data}/{table}.parquet").count(), name


def test_registered_leaks_equal_a_plain_search(spark, data):
    items = [(r.item_id, pigeonhole.normal(r.text)) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    docs = {r.doc_id: pigeonhole.normal(r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    exact = {(d, i) for d, t in docs.items() for i, p in items if p in t}
    found = queries.op9_decontaminate(spark, data).filter(F.col("distance") == 0).collect()
    assert {(r.doc_id, r.item_id) for r in found} == exact


def test_held_out_accuracy(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang")
    found = queries.op8_language(spark, data).filter("held_out").join(docs, "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in found) >= 0.95 * len(found)
    labels = spark.read.parquet(f"{data}/labels.parquet")
    found = queries.op4_quality_classifier(spark, data).filter("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in found) >= 0.9 * len(found)
