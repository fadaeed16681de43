"""Training-corpus pipeline over ``documents``: quality, lines, near-duplicates, benchmark, mixture.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet in the cluster's shared folder and read again as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm import stages
from pulsegrid.session import durable

STAGES = [
    ("quality classifier", stages.quality),
    ("line dedup", stages.lines),
    ("near dedup", stages.near_duplicates),
    ("decontamination", stages.benchmark),
    ("mixing", stages.mixture),
]

#: SQL cannot express a trained classifier; tests compare the run with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
