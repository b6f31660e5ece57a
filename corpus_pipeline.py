"""A corpus pipeline of five stages over ``documents``.

Each stage takes what its predecessor kept, is written as Parquet and reread:
quality rules drop what they reject, near-duplicate groups keep their first
document, documents that contain a benchmark item go, live-looking secrets are
masked, and the rest is mixed by source to target weights.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from varve.llm import decontaminate, mixing, quality_rules, secrets, simhash_dedup
from varve.llm.durable import discard, shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("mixing", mixture),
]

#: SQL has no SimHash over XXH64; tests hold the pipeline against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over ``documents``.

    What passes between them lies in ``folder``, by default the one that the
    cluster's executors share.  A stage's table goes once the next one is written;
    the last is kept, as the returned rows are read from it.
    """
    home = f"{folder or shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{k}")
        docs = spark.read.parquet(f"{home}/{k}")
        if last:
            discard(spark, last)
        last = f"{home}/{k}"
    return STAGES[-1][1](spark, docs, sf_dir)
