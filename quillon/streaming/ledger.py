"""The ledger and the outcomes as streams."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import cost, shadow


def distinct_events(events: DataFrame, delay: str = "1 hour", key: str = "event_id", at: str = "ts") -> DataFrame:
    """Events without repeats of a key within ``delay``; state older than that is dropped."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def windowed_usage(events: DataFrame, width: str = "1 hour", delay: str = "1 hour", at: str = "ts") -> DataFrame:
    """Rows and tokens by window and model; rows later than ``delay`` are left out, as in any watermark."""
    grouped = events.withWatermark(at, delay).groupBy(F.window(at, width), "model")
    return grouped.agg(F.count(F.lit(1)).alias("records"), *[F.sum(t).alias(t) for t in ("input_tokens", "output_tokens")]).select("window.start", "window.end", "model", "records", "input_tokens", "output_tokens")


#: Buckets of a new index of ids; a ledger keeps the number it was begun with.
BUCKETS = 64
_INDEX = "id string, batch string"


def id_index(spark: SparkSession, path: str, buckets: int = BUCKETS) -> DataFrame:
    """``id, batch`` of every row of the ledger at ``path``, bucketed by id and apart from the rows, which lie by day.

    A join by id reads the index bucket by bucket without a shuffle of it.
    """
    name = _index_table(spark, path, buckets)
    spark.catalog.refreshTable(name)
    return spark.table(name)


def _index_table(spark: SparkSession, path: str, buckets: int) -> str:
    home = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/ids")  # the folder may be in any store that Spark reads
    files = home.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    begun = [x.getPath().getName() for x in files.listStatus(home)] if files.exists(home) else []
    sizes = sorted(int(n.removeprefix("buckets-")) for n in begun if n.startswith("buckets-"))
    n = sizes[0] if sizes else buckets
    name = f"ledger_ids_{hashlib.sha256(path.encode()).hexdigest()[:16]}_{n}"
    spark.sql(f"create table if not exists {name} ({_INDEX}) using parquet clustered by (id) into {n} buckets location '{path}/ids/buckets-{n}'")
    return name


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the ledger at ``path``; a filter of ``day`` reads only those days."""
    return spark.read.parquet(f"{path}/rows").drop("batch")


def append_batch(rows: DataFrame, path: str, batch: str, buckets: int = BUCKETS) -> DataFrame:
    """Write the ledger rows that ``path`` lacks, under the name of their batch; what was written.

    An id is one over all days: rows whose id another batch has are duplicates, of rows of one id
    the first by ``ts`` and content counts. A batch that is run again writes what it wrote before, in the same
    place, wherever it stopped. One writer at a time, as for any ledger.
    """
    spark = rows.sparkSession
    have = id_index(spark, path, buckets).where(F.col("batch") != batch)
    new = cost.append_new(have, rows).withColumn("day", F.to_date("ts"))
    new.write.mode("overwrite").partitionBy("day").parquet(f"{path}/rows/batch={batch}")
    written = spark.read.schema(new.schema).parquet(f"{path}/rows/batch={batch}")
    table = _index_table(spark, path, buckets)
    written.select("id", F.lit(batch).alias("batch")).write.mode("append").format("parquet").bucketBy(int(table.rsplit("_", 1)[1]), "id").option("path", f"{path}/ids/buckets-{table.rsplit('_', 1)[1]}").saveAsTable(table)
    return written


def append_to_ledger(events: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Append what is there as ledger rows whose id the ledger at ``path`` lacks; a batch that is run again adds nothing.

    See ``append_batch``. Streams with other checkpoints may follow one another on the same ledger.
    """
    writer = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def write(batch: DataFrame, n: int) -> None:
        append_batch(cost.to_ledger(batch), path, f"{writer}-{n}", buckets)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def maturation_counts(scores: DataFrame, outcomes: DataFrame, labels: DataFrame, horizon_days: int, as_of) -> DataFrame:
    """One row: scored merges that have an outcome, are due, still pend, and that are due but can't be labelled."""
    have = outcomes.where(F.col("horizon_days") == horizon_days).select("repo", "merge_sha", F.lit(True).alias("__have")).distinct()
    due = F.col("merged_at") + F.expr(f"interval {horizon_days} days") <= F.lit(as_of)
    met = scores.join(have, ["repo", "merge_sha"], "left").join(labels.select("repo", "merge_sha", F.lit(True).alias("__label")).distinct(), ["repo", "merge_sha"], "left")
    open_ = F.col("__have").isNull()
    return met.agg(F.count_if(~open_).alias("done"), F.count_if(open_ & due).alias("due"), F.count_if(open_ & ~due).alias("pending"), F.count_if(open_ & due & F.col("__label").isNull()).alias("unlabellable"))


def scan_again(cached: DataFrame, fresh: DataFrame, changes: DataFrame, as_of) -> DataFrame:
    """Labels after an incremental scan: matured cached ones stay as they are, immature or missing ones are taken from ``fresh``; fails if over a tenth of those failed.

    ``cached, fresh``: ``pr, horizon_days, label``; ``changes``: ``pr, merged_at`` (seconds); ``as_of`` in seconds.
    """
    mature_ = cached.join(changes, "pr").where(F.col("merged_at") + F.col("horizon_days") * 86_400 <= as_of).select("pr", "horizon_days", "label")
    rest = fresh.join(mature_.select("pr", "horizon_days"), ["pr", "horizon_days"], "left_anti").select("pr", "horizon_days", "label")
    n = rest.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label").isNull()).alias("failed"))
    told = F.when(F.col("failed") * 10 > F.col("n"), F.raise_error(F.lit("over a tenth of the labels failed")).cast("boolean")).otherwise(True)
    return mature_.union(rest).crossJoin(n.select(told.alias("__ok"))).where("__ok").drop("__ok")


def mature(scores: DataFrame, outcomes: DataFrame, labels: DataFrame, horizon_days: int, as_of) -> DataFrame:
    """New outcome rows: scored merges that are due at ``as_of`` and lack one, with ``survived`` from ``labels`` (null if unlabelled)."""
    due = shadow.due_outcomes(scores, outcomes, horizon_days, as_of).where("matured")
    found = due.join(labels.select("repo", "merge_sha", "survived"), ["repo", "merge_sha"], "left")
    return found.select("repo", "merge_sha", F.lit(horizon_days).alias("horizon_days"), F.lit(as_of).cast("timestamp").alias("labelled_at"), "survived")
