"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

1. language ID: rows without a recognised language go. 2. SimHash near-duplicates: one row of each group stays. 3. benchmark
decontamination: rows that hold a benchmark passage go. 4. PII: personal data and terms that disclose it are replaced.
5. SentencePiece: each text as ids, and read back from them.

Stages 1 to 4 return the columns of documents, extra ones included, and keep the other rows as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termini.llm import decontaminate, language, pieces, pii, simhash
from termini.llm.common import clear, delete, fresh_path, made, table
from termini.llm.queries import PIECE_MODEL, tokenizer_path


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.accepted(docs, language.trained(docs))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def sanitise_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encoded(docs, tokenizer_path(PIECE_MODEL))


STAGES = [
    ("language_id", keep_known_languages),
    ("simhash_dedup", keep_one_of_each_group),
    ("decontamination", drop_benchmark_leaks),
    ("pii", sanitise_personal_data),
    ("sentencepiece", encode_pieces),
]

ORACLE_SQL = None  # a trained network and hashes are beyond SQL: tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        path, since = fresh_path(spark, f"stage-{name}"), made()
        stage(spark, docs, sf_dir).write.parquet(path)
        clear(spark, since)  # what the stage stored on its way
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
