"""A training-corpus pipeline over `documents`: toxic documents go, one document of each
near-duplicate group stays, contaminated documents go, secrets are masked, texts become tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docuflux.llm import bpe, decontam, jaccard_join, secrets, toxicity
from docuflux.llm.common import Workspace, table
from docuflux.llm.queries import TOKENIZER


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates_removed(docs, k=5, num=80, den=100)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.without_secrets(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encoded(docs, TOKENIZER, keep_ids=True)


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("secrets", secret_scan),
    ("bpe", tokens),
]
#: The network of the first stage is no matter for SQL; see tests/llm for the brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read again."""
    ws, docs = Workspace(spark, "pipeline"), table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = ws.save(stage(spark, docs, sf_dir), name)
        if i:
            ws.drop(STAGES[i - 1][0])
    return docs
