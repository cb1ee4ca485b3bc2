"""Documents to training windows: five stages, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import stages
from quillon.llm.shared import settle, table

STAGES = [
    ("quality classifier", stages.quality),
    ("near-duplicates", stages.near_duplicates),
    ("repeated passages", stages.repeated_passages),
    ("benchmark decontamination", stages.decontamination),
    ("packing", stages.packing),
]
#: No stage but the last two can be said in SQL; tests hold each against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs, f"stage-{i}")
    return docs
