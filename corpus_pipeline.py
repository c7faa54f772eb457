"""The corpus job: documents in, clean documents with their token ids out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next one's ``docs``. Rows leave a stage only by its
decision; the kept ones stay whole, extra columns included.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.arrow import own
from tabloom.llm.bpe import BpeCodec
from tabloom.llm.pigeonhole import leaks
from tabloom.llm.pii import PiiFinder
from tabloom.llm.quality import QualityRules
from tabloom.llm.queries import vocabulary_path
from tabloom.llm.simhash import keep_one
from tabloom.session import shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and that the weighted votes find good. Null and empty texts go."""
    return QualityRules.fit(docs).keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash neighbours: the one with the smallest id."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    mark = "__leaks"
    found = leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), hits=mark)
    return found.filter(F.size(mark) == 0).select(*own(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with [KIND] in place of personal data and n_chars counted anew."""
    hidden = PiiFinder.fit(docs).redact(docs)
    return hidden.withColumn("n_chars", F.char_length("text").cast("long")).select(*own(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids and the number of them."""
    coded = BpeCodec.fit(docs, vocabulary_path()).encode(docs)
    return coded.withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate),
          ("personal_data", personal_data), ("encode", encode)]

# Votes, fitted accuracies, balls of fingerprints and merges have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each returns is written to the shared folder."""
    folder = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
