"""One query for each operator, over its whole table, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.llm import alignment, chat, decontaminate, importance, knn_quality, langid, licenses, mixing, oracle, packing, quality_rules, secrets, simhash_dedup, substring


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_rules.apply_rules(docs).select("doc_id", *cols)


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = mixing.draws(_table(spark, sf_dir, "documents"))
    return df.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.judged(_table(spark, sf_dir, "documents")))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return knn_quality.score(docs, knn_quality.fit(docs, _table(spark, sf_dir, "labels")))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(_table(spark, sf_dir, "conversations"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(_table(spark, sf_dir, "documents"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    gains = importance.target_gains(docs, _table(spark, sf_dir, "benchmark"))
    return importance.ranked(docs, gains).select("doc_id", "n_features", "weight", "score", "rank")


def _tokenizer(name: str) -> str:
    """The place of a public vocabulary file, the same on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return alignment.aligned(docs, _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))


_ALL = (
    op1_language_id,
    op2_decontaminate,
    op3_licenses,
    op4_quality_rules,
    op5_mix,
    op6_near_duplicates,
    op7_chat,
    op8_secrets,
    op9_quality_classifier,
    op10_substrings,
    op11_importance,
    op12_packing,
    op13_alignment,
)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict:
    return {"op4_quality_rules": oracle.op4(), "op5_mix": oracle.op5(), "op7_chat": oracle.op7(), "op8_secrets": oracle.op8(), "op11_importance": oracle.op11()}
