"""The corpus pipeline: from raw documents to packed sequences.

Each stage works on the Parquet table that its predecessor has written, in
the shared folder of the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vitrine.llm import stages
from vitrine.llm.common import table
from vitrine.session import ensure_checkpoint_dir, scratch_path

STAGES = [
    ("quality_rules", stages.quality_rules),
    ("ngram_jaccard_join", stages.near_duplicates),
    ("suffix_array_dedup", stages.repeated_passages),
    ("secret_scans", stages.secret_scan),
    ("packing", stages.pack_documents),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents`` after all stages."""
    ensure_checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
