"""A training-data pipeline over `documents`: each stage gets what the one before kept, all but the last return the columns of documents.

1. quality_rules: documents that fail the base rule or a certified cutoff go.
2. near_dedup: of each class of near duplicates the first document stays.
3. secret_scan: secrets are replaced by the name of their kind.
4. source_mixing: documents are drawn so that the domains' expected tokens meet the targets.
5. sentencepiece: token ids of the whole texts, and whether they decode to the text again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm import mixing, near_dedup, quality_rules, secret_scan, sentencepiece_fst
from rasterloom.llm.common import cut, table


#: Shares of the expected tokens. All are above zero, as soft posteriors give every domain some tokens, and near enough to what the stages before leave that clean documents need not go.
MIX = {"clean": 0.96, "low": 0.01, "toxic": 0.03}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_rates(docs, table(spark, sf_dir, "labels"), MIX)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.add_ids(docs)


STAGES = [
    ("quality_rules", quality),
    ("minhash_near_dedup", dedup),
    ("secret_scans", secrets),
    ("source_mixing", mix),
    ("sentencepiece", tokens),
]

#: Signatures, the classifier and the tokenizer have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
