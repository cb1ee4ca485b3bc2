"""Pinned inputs: are the files of a cohort's entries those that two manifests name?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Why an entry can't be used, the first that holds.
MISMATCHES = ("first_pin_missing", "second_pin_missing", "pins_differ", "file_missing", "digest_differs", "rows_differ")


def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``file, sha256, bytes, rows``: each file below ``path`` read once for its digest and, as text (gzip too), once for its lines. A file is one task's, as its digest is of all its bytes."""
    whole = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    known = whole.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))
    lines = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"))
    return known.join(lines.groupBy("file").agg(F.count(F.lit(1)).alias("rows")), "file", "left").select("file", "sha256", "bytes", F.coalesce("rows", F.lit(0)).alias("rows"))


def check_pins(entries: DataFrame, one: DataFrame, two: DataFrame, files: DataFrame, kept: Column | None = None) -> DataFrame:
    """``entry, file, reason``: each kept entry with why it can't be used, null if it can.

    ``entries``: ``entry`` and what ``kept`` reads; ``one``: ``entry, file, sha256, rows``; ``two``: ``entry, sha256`` of the same file as another
    manifest pins it; ``files``: ``file, sha256, rows`` as they are. An entry or a pin that is named twice counts once if both say the same, else its pins differ.
    """
    used = (entries if kept is None else entries.where(kept)).select("entry").distinct()
    first = one.groupBy("entry").agg(F.min("file").alias("file"), F.min("sha256").alias("__a"), F.max("sha256").alias("__a2"), F.min("rows").alias("__n"), F.max("rows").alias("__n2"), F.lit(True).alias("__one"))
    second = two.groupBy("entry").agg(F.min("sha256").alias("__b"), F.max("sha256").alias("__b2"), F.lit(True).alias("__two"))
    met = used.join(first, "entry", "left").join(second, "entry", "left").join(files.select("file", F.col("sha256").alias("__sha"), F.col("rows").alias("__rows"), F.lit(True).alias("__there")), "file", "left")
    same = F.col("__a").eqNullSafe(F.col("__a2")) & F.col("__b").eqNullSafe(F.col("__b2")) & F.col("__n").eqNullSafe(F.col("__n2")) & F.col("__a").eqNullSafe(F.col("__b"))
    tests = (F.col("__one").isNull(), F.col("__two").isNull(), ~same, F.col("__there").isNull(), ~F.col("__sha").eqNullSafe(F.col("__a")), F.col("__n").isNotNull() & ~F.col("__rows").eqNullSafe(F.col("__n")))
    return met.select("entry", "file", F.coalesce(*[F.when(test, name) for name, test in zip(MISMATCHES, tests, strict=True)]).alias("reason"))
