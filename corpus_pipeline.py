"""The corpus pipeline: each stage is one operator of ``irregts.llm`` over what its predecessor kept.

1. quality: the classifier learns from ``labels``; documents that score below one half go.
2. language: documents without a language, or with a weak guess, go.
3. near_duplicates: one document of each component stays; links are SimHash fingerprints of
   three-word shingles that differ in at most three bits.
4. decontamination: documents that share a window with ``benchmark`` go.
5. tokens: per document the digests of its BPE ids and of what they decode to.

All but the last return the columns they are given. An empty table passes through; null texts
have no language and go there at the latest.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from irregts.llm import bpe, decontaminate, langid, quality, simhash
from irregts.llm.common import id_crc32
from irregts.session import materialise

Stage = tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]

#: Least quality score; least share of a text's n-grams that its language must hold.
LEAST_QUALITY, LEAST_LANGUAGE = 0.5, 0.3
VOCABULARY = "byte_bpe_50k.json"


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.learn(docs.filter(id_crc32() % 3 != 1), labels)
    return quality.with_quality(docs, model, LEAST_QUALITY)


def _language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.learn(docs.filter(id_crc32() % 5 != 0))
    return langid.with_language(docs, model, LEAST_LANGUAGE)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    return bpe.digests(bpe.encode(docs.select("doc_id", "text"), path, decoded=True))


STAGES: list[Stage] = [
    ("quality", _quality),
    ("language", _language),
    ("near_duplicates", _near_duplicates),
    ("decontamination", _decontamination),
    ("tokens", _tokens),
]

#: The stages learn models and link texts, which SQL cannot express; tests compare them with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
