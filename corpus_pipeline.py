"""The corpus pipeline: documents without toxic texts, repeated lines, near copies and benchmark leaks, packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratagraph.llm import common, decontaminate, line_dedup, ngram_join, packing, toxicity

STAGES = [
    ("toxicity", lambda spark, docs, sf_dir: toxicity.drop_toxic(docs, common.read_table(spark, sf_dir, "labels"))),
    ("line_dedup", lambda spark, docs, sf_dir: line_dedup.line_dedup(docs)),
    ("near_copies", lambda spark, docs, sf_dir: ngram_join.drop_near_copies(docs)),
    ("decontaminate", lambda spark, docs, sf_dir: decontaminate.drop_contaminated(docs, common.read_table(spark, sf_dir, "benchmark"))),
    ("packing", lambda spark, docs, sf_dir: packing.pack_documents(docs)),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), name)
    return docs
