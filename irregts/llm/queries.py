"""Queries over whole tables, one per operator, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from irregts.llm import bpe, decontaminate, fim, langid, language_model, lexical, preference, quality, rules, sharding, simhash, tokenfiles, vptree
from irregts.llm.common import id_crc32, small_batches
from irregts.session import scratch_path


#: Vocabulary file of the token queries; the operators take its path.
VOCABULARY = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(_table(spark, sf_dir, "documents"), id_crc32() % 5 == 1)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop(
        "text_key"
    )


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token_files")
    tokenfiles.write_token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), path)
    return tokenfiles.read_documents(spark, path)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    held_out = id_crc32() % 5 == 0
    model = langid.learn(documents.filter(~held_out))
    small_batches(spark)
    guess = documents.select("doc_id", held_out.alias("held_out"), langid.prediction(model).alias("guess"))
    return guess.select("doc_id", "held_out", "guess.*")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"), sharding.topology(8))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, factor=1.0)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).drop("text_key", "root")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return quality.score_documents(documents, _table(spark, sf_dir, "labels"), id_crc32() % 3 == 1)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path(VOCABULARY)
    return bpe.digests(bpe.encode(documents, path, decoded=True))


def op10_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.format_preferences(_table(spark, sf_dir, "conversations"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.digests(_table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.transform(_table(spark, sf_dir, "documents")))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=50)


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_model, op2_decontamination, op3_token_files, op4_language, op5_sharding, op6_neighbours, op7_simhash, op8_quality, op9_bpe,
        op10_preferences, op11_quality_rules, op12_fill_in_middle, op13_lexical_search,
    )
}
