"""Corpus pipeline: quality classifier, language ID, SimHash near-dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. The
first four return documents (their columns, fewer or repeated rows), the last one pieces of
packed sequences. Stages store what they read more than once in the shared folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from farandole.llm import langid, mixing, packing, quality, simhash
from farandole.llm.common import stored, table

#: Documents below this quality score go.
LEAST_QUALITY = 0.5
#: So do documents without a language, or with a lower score for it.
LEAST_LANGUAGE = 0.5


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "labels"), LEAST_QUALITY)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.identified(docs, LEAST_LANGUAGE)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.without_near_duplicates(docs)


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.with_crc(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("near_duplicates", one_of_each_group),
    ("mixing", target_mix),
    ("packing", packed),
]

#: Fitted models and tokenizers decide: SQL can't express it, so the tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
