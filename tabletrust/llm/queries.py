"""Registered queries of the text operators: one per operator, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabletrust.llm import html, jaccard, languages, lexical, mixing, pieces, pii, quality, rules, sketches, tokenbin, urls, whitening
from tabletrust.llm.common import fold, read

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.round_trip(docs, PIECE_MODEL).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sketches.fingerprints(read(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_chars", "edited_sha256", sketches.as_text(F.col("sketch")).alias("fingerprint"), sketches.as_text(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(read(spark, sf_dir, "documents"))


#: Half of the corpus's tokens: domains and languages by weight, sources of a language alike.
MIX = mixing.Mix(domain={"web": 40, "books": 35, "forums": 25}, lang={"en": 50, "de": 20, "fr": 20, "es": 10}, budget_permille=500, max_epochs=2, seed=7)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.chosen(read(spark, sf_dir, "documents"), MIX)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filtered(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(read(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = languages.learn(docs.where(fold(F.col("doc_id")) != 2))
    return languages.predict(docs, model).select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score", "mix")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels").where(fold(F.col("doc_id")) != 2)
    scored = rules.scored(docs, rules.fit(docs, labels, "quality"))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


#: The key of the surrogates; a deployment passes its own.
PII_KEY = b"tabletrust surrogate key"


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replaced(docs, PII_KEY, count="n_entities")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=50)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = whitening.whitened(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", components=8)
    return made.withColumn("deviation", F.col("deviation").try_cast("long"))


BYTE_MODEL = public_tokenizers.path("byte_bpe_50k.json")
#: Ends each document.
END_ID = 2


def op13_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tokenbin.new_folder(spark)
    tokenbin.write(read(spark, sf_dir, "documents"), folder, BYTE_MODEL, END_ID)
    return tokenbin.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op11_lexical_search": op11_lexical_search, "op12_whitening": op12_whitening, "op13_token_binary": op13_token_binary, "op1_ngram_jaccard_join": op1_ngram_jaccard_join, "op9_pii": op9_pii, "op7_quality_rules": op7_quality_rules, "op8_language_id": op8_language_id, "op10_quality_classifier": op10_quality_classifier, "op4_mixing": op4_mixing, "op5_html_extraction": op5_html_extraction, "op6_url_filter": op6_url_filter, "op3_fingerprints": op3_fingerprints, "op2_sentencepiece": op2_sentencepiece}
ORACLE_SQL = {"op4_mixing": mixing.oracle(MIX), "op11_lexical_search": lexical.oracle(50)}
