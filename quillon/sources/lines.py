"""Sources of text lines: objects in JSON, agent transcripts, ledger lines, zero-context diffs.

Bad lines are never dropped silently: every line gets a ``state``, and ``line_counts`` tells how many have which.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import cost

#: Fixed value: longer lines are not parsed.
LONGEST_LINE = 4 << 20
LEDGER_VERSION = 1

_USAGE = "struct<input_tokens: string, output_tokens: string, cache_read_input_tokens: string, cache_creation_input_tokens: string>"
_TRANSCRIPT = f"type string, uuid string, requestId string, sessionId string, timestamp string, isSidechain boolean, costUSD double, message struct<id: string, model: string, usage: {_USAGE}>"
_LEDGER = "v long, id string, c string, ts long, taskId string, model string, harness string, backend string, source string, pricingBasis string, amountMicros long, currency string, inputTokens long, outputTokens long, cacheReadTokens long, cacheWriteTokens long, coverage string"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, value`` of all non-blank lines below ``path``; a carriage return at the end goes."""
    lines = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"\r$", "").alias("value")).where(F.trim("value") != "")


def with_state(lines: DataFrame, longest: int = LONGEST_LINE) -> DataFrame:
    """``state``: ok, oversized_line or malformed_line (no JSON, or no object)."""
    parsed = F.try_parse_json("value")
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    return lines.withColumn("state", F.when(F.length("value") > longest, "oversized_line").when(is_object, "ok").otherwise("malformed_line"))


def line_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def _counter(x: str) -> Column:
    """A whole number of at least 0, else null."""
    return F.when(F.col(x).rlike(r"^\d{1,15}$"), F.col(x).cast("long"))


def transcript_usage(lines: DataFrame) -> DataFrame:
    """Usage rows of assistants: only the named fields survive, so no free text does.

    The key is message and request, else message, else uuid; counters that are no whole numbers are null and
    make ``state`` invalid_usage_value, rows without usage get missing_usage.
    """
    rows = with_state(lines).where("state = 'ok'").select("file", F.from_json("value", _TRANSCRIPT).alias("r")).where("r.type = 'assistant'")
    u = "r.message.usage"
    names = {"input_tokens": "input_tokens", "output_tokens": "output_tokens", "cache_read_tokens": "cache_read_input_tokens", "cache_write_tokens": "cache_creation_input_tokens"}
    invalid = F.lit(False)
    for n in names.values():
        invalid = invalid | (F.col(f"{u}.{n}").isNotNull() & _counter(f"{u}.{n}").isNull())
    key = F.coalesce(F.when(F.col("r.requestId").isNotNull(), F.concat_ws(".", "r.message.id", "r.requestId")), "r.message.id", "r.uuid")
    return rows.select(
        "file", F.when(F.col("r.message.id").isNull(), F.coalesce("r.uuid", "r.requestId")).otherwise(key).alias("event_key"), F.col("r.sessionId").alias("session_id"), F.col("r.message.model").alias("model"),
        F.try_to_timestamp("r.timestamp").alias("observed_at"), *[_counter(f"{u}.{n}").alias(c) for c, n in names.items()], F.col("r.costUSD").alias("actual_cost_usd"),
        F.when(F.col(u).isNull(), "missing_usage").when(invalid, "invalid_usage_value").otherwise("ok").alias("state"),
    )


#: Fixed value: the most rows and bytes that one ledger may have.
MOST_RECORDS, MOST_BYTES = 1_000_000, 64 << 20


def ledger_lines(lines: DataFrame, order: str | None = None) -> DataFrame:
    """Ledger rows with ``state``: ok, corrupt, unsupported_version or duplicate, and the ``reason`` of a corrupt one.

    A row must have exactly the known keys, fields that the contract takes, and the checksum of its other fields. Of one id the first
    counts, by file and by ``order`` (a line number; without one, by the text of the line).
    """
    read = with_state(lines).withColumn("r", F.from_json("value", _LEDGER))
    row = {k: F.col(f"r.{k}") for k in cost.SIGNED}
    version = F.get_json_object("value", "$.v").try_cast("long")
    keys = F.array_sort(F.json_object_keys("value"))
    exact = F.coalesce(keys == F.array(*[F.lit(k) for k in sorted([*cost.SIGNED, "c"])]), F.lit(False))
    fields = exact & (F.size(cost.ledger_errors(row)) == 0) & F.coalesce(row["id"].rlike("^[a-f0-9]{32}$") & F.col("r.c").rlike("^[a-f0-9]{16}$") & (row["currency"] == "USD"), F.lit(False))
    reason = (
        F.when(F.col("state") != "ok", "malformed").when(version > LEDGER_VERSION, "unsupported_version").when(~F.coalesce((version == 1) & fields, F.lit(False)), "invalid_record")
        .when(cost.ledger_checksum(row) != F.col("r.c"), "checksum")
    )
    stated = read.withColumn("reason", reason)
    place = F.row_number().over(Window.partitionBy(F.coalesce(F.when(F.col("reason").isNull(), F.col("r.id")), F.sha2("value", 256)), F.col("reason").isNull()).orderBy("file", order or "value"))
    state = F.when(F.col("reason") == "unsupported_version", "unsupported_version").when(F.col("reason").isNotNull(), "corrupt").when(F.col("__n") > 1, "duplicate").otherwise("ok")
    return stated.withColumn("__n", place).select("file", "r.*", state.alias("state"), "reason")


def ledger_within_limits(lines: DataFrame, most: int = MOST_RECORDS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``file, records, bytes``; fails for a file beyond a limit."""
    agg = lines.groupBy("file").agg(F.count(F.lit(1)).alias("records"), F.sum(F.octet_length("value") + 1).alias("bytes"))
    fails = F.raise_error(F.concat(F.lit("the ledger is too large: "), F.col("file"))).cast("long")
    return agg.withColumn("records", F.when((F.col("records") <= most) & (F.col("bytes") <= most_bytes), F.col("records")).otherwise(fails))


def diff_hunks(lines: DataFrame, by: str = "diff", order: str = "line_no") -> DataFrame:
    """``by, old_path, new_path, old_start, old_end, new_start, new_end`` of zero-context diffs given line by line.

    Ranges are whole lines from 1, both ends included; a side of no lines is null, as is the path /dev/null.
    """
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)

    def path(mark: str) -> Column:
        found = F.when(F.col("value").startswith(f"{mark} "), F.regexp_replace("value", rf"^{mark.replace('+', '[+]')} (?:[ab]/)?", ""))
        last = F.last(found, ignorenulls=True).over(w)
        return F.when(last != "/dev/null", last)

    header = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    rows = lines.select(by, order, "value", path("---").alias("old_path"), path("+++").alias("new_path")).where(F.col("value").rlike(header))

    def number(i: int) -> Column:
        return F.nullif(F.regexp_extract("value", header, i), F.lit("")).cast("long")

    def span(start: int, name: str) -> list[Column]:
        n = F.coalesce(number(start + 1), F.lit(1))
        return [F.when(n > 0, number(start)).alias(f"{name}_start"), F.when(n > 0, number(start) + n - 1).alias(f"{name}_end")]

    return rows.select(by, "old_path", "new_path", *span(1, "old"), *span(3, "new"))
