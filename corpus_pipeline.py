"""The corpus pipeline: quality rules, three kinds of dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of ``documents``; a text that changes brings its ``n_chars``
along. ``run`` applies them in order, each to what its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm import line_dedup, packing, quality_rules, simhash, substring_dedup
from tillscope.llm.queries import tokenizer_path
from tillscope.llm.registry import table
from tillscope.session import scratch_path

# Learned statistics and fingerprints are not expressible in SQL.
ORACLE_SQL = None


def _with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base test or the learned rules."""
    labelled = quality_rules.labelled_statistics(docs, table(spark, sf_dir, "labels"))
    judged = quality_rules.judge(docs, quality_rules.learn_rules(labelled))
    return judged.where("kept").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take lines out of a text that an earlier document holds."""
    kept = line_dedup.dedup_lines(docs)
    changed = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return _with_text(kept.withColumn("text", changed), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash component: the one with the smallest id."""
    return simhash.keep_representatives(docs, width=3)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take passages out of a text that an earlier document holds."""
    return _with_text(substring_dedup.remove_spans(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the remaining texts into token sequences."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", filter_quality),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
