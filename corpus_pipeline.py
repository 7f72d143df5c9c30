"""A corpus pipeline in five stages; each is written as Parquet and read again as the next one's documents.

Language ID (documents without a known language go), exact dedup, n-gram Jaccard join (one document of each group
stays), mixing sources to target weights (a row for each pass that takes words of a document), and byte-level BPE
encoding and decoding.

Defined results: a null text, or one without a letter, has no language and goes in the first stage; of rows that repeat even the id
one stays in the second; of equal texts the longest original stays, then the least id; of linked documents the least id stays,
and a row with a null id links with nothing; a document that the mix takes in two passes is there twice, with equal columns; an
empty table gives an empty result; texts of any length pass whole; further columns of documents, whatever their names, are carried
up to the last stage and never read.

Executors give back the free pages of their heaps before each stage, so what one stage's shuffles filled is there for the next one's workers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from latticework.llm import byte_codec, exact_dedup, language_id, mixing, ngram_join
from latticework.llm.common import crc_mod, discard_path, scratch_path, shrink_heaps


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shrink_heaps(spark)
    return language_id.keep_known(docs, language_id.fit(docs, crc_mod("doc_id", 4) != 2))


def one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shrink_heaps(spark)
    return exact_dedup.exact_dedup(docs)


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shrink_heaps(spark)
    return ngram_join.near_dedup(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shrink_heaps(spark)
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shrink_heaps(spark)
    return byte_codec.byte_encode(docs)


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", one_of_equal),
    ("ngram_jaccard_join", one_of_similar),
    ("source_mixing", mixed),
    ("byte_bpe", encoded),
]

#: Language ID and the tokenizer are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents of ``sf_dir``. A stage's documents are deleted when the next ones are written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard_path(spark, before)
        before = path
    return docs
