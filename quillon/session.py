"""The settings that results depend on."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def prepare(spark: SparkSession) -> SparkSession:
    """Session zone UTC, small Arrow batches, and this package importable in Python workers that a checkout alone serves."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # rows can be long texts: small batches keep both ends of the exchange with Python small
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder for ``name`` in the one that ``spark.checkpoint.dir`` names; only where that is unset (tests on one machine) in a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='quillon-')}"
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage in the folder that ``spark.checkpoint.dir`` names.

    Only where that is unset (tests on one machine) a temporary folder is set.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillon-"))
    return df.checkpoint()


def settled(df: DataFrame, name: str = "settled") -> DataFrame:
    """``df`` written to a fresh folder and read again: a cut of the lineage after which Spark knows the size.

    A checkpoint keeps the size that was estimated for its plan, and for a join that is the product of both sides: in a loop of joins
    the number's digits double with each round until they fill the driver's memory.
    """
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
