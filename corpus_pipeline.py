"""Corpus pipeline: quality rules, near duplicates, personal data, mixing and encoding, each stage on all that is left.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.

In every stage null and empty texts, texts of any length, repeated rows and rows with equal or null ids, empty tables and
further columns have the result that the stage's operator states: the rules reject texts without words, one row of each
id and group stays after near duplicates (rows without an id all stay), personal data is replaced in every row, rows of one
id and source are mixed together, and every row is encoded.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabletrust.llm import jaccard, mixing, pieces, pii, quality
from tabletrust.llm.common import discard, read, shared_dir

#: Nine tenths of what is left, by domain and language; a leaf is used twice at most.
MIX = mixing.Mix(domain={"web": 40, "books": 35, "forums": 25}, lang={"en": 50, "de": 20, "fr": 20, "es": 10}, budget_permille=900, max_epochs=2, seed=11)
PII_KEY = b"tabletrust surrogate key"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject."""
    return quality.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates."""
    return jaccard.survivors(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates; n_chars follows the new text."""
    made = pii.replaced(docs, PII_KEY)
    return made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents to target weights; one that is used twice comes twice."""
    return mixing.mixed(docs, MIX)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids of the text's pieces and their number."""
    coded = pieces.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("personal data", personal_data),
    ("mixing to target weights", mixing_weights),
    ("SentencePiece encoding", piece_ids),
]

#: Compression ratios, surrogates and piece ids aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/tabletrust-pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        discard(spark)  # what the stage itself wrote
    return docs
