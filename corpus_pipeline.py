"""Corpus pipeline: the documents through five operators, each stage written and read again.

Language ID drops what it rejects; SimHash groups keep one document each; personal data is replaced
in the texts; sources are mixed to their targets, in whole documents; the texts are encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lifelog.llm import copies, language, mixture, pii, sentencepiece
from lifelog.llm.common import documents
from lifelog.staging import stage

STAGES = [
    ("language", language.identified_documents),
    ("simhash", copies.distinct_documents),
    ("pii", pii.redacted_documents),
    ("mixture", mixture.mixed_documents),
    ("sentencepiece", sentencepiece.encoded_documents),
]

#: Trained models and tokenisation are beyond SQL; tests/llm holds the brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
