"""Session files and their like, line by line with line numbers: transcripts of counters, usage records, name-status rows, sheets.

A session file is read whole by one task, so that its lines keep their order; files beyond a size are counted and not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import text as T
from . import lines as L

#: Bytes of a file and lines of it that are read at most.
LARGEST_FILE, MOST_LINES = 256 << 20, 500_000
COUNTERS = {"input_tokens": "input_tokens", "output_tokens": "output_tokens", "cache_read_tokens": "cached_input_tokens", "cache_write_tokens": "cache_write_input_tokens", "reasoning_tokens": "reasoning_output_tokens"}


def numbered_lines(spark: SparkSession, path: str, most: int = MOST_LINES, largest: int = LARGEST_FILE) -> DataFrame:
    """``file, line_no, value, state``: non-blank lines; a line beyond ``most`` makes one row truncated_input, a file beyond ``largest`` bytes one row oversized_file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    small = files.where(F.col("length") <= largest).select(F.col("path").alias("file"), F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("at", "raw"))
    rows = small.select("file", (F.col("at") + 1).alias("line_no"), F.regexp_replace("raw", r"\r$", "").alias("value")).where(F.trim("value") != "")
    kept = L.with_state(rows.where(F.col("line_no") <= most)).select("file", "line_no", "value", "state")
    cut = rows.where(F.col("line_no") == most + 1).select("file", "line_no", F.lit(None).cast("string").alias("value"), F.lit("truncated_input").alias("state"))
    large = files.where(F.col("length") > largest).select(F.col("path").alias("file"), F.lit(0).alias("line_no"), F.lit(None).cast("string").alias("value"), F.lit("oversized_file").alias("state"))
    return kept.union(cut).union(large)


_COUNTS = "struct<input_tokens: string, output_tokens: string, cached_input_tokens: string, cache_write_input_tokens: string, reasoning_output_tokens: string>"
_ROLLOUT = f"type string, timestamp string, payload struct<type: string, id: string, session_id: string, cli_version: string, turn_id: string, model: string, thread_settings: struct<service_tier: string>, info: struct<last_token_usage: {_COUNTS}, total_token_usage: {_COUNTS}>>"


def rollout_observations(lines: DataFrame) -> DataFrame:
    """Token counts of rollouts with the state they were made in, one row each.

    The session and version of a file are the first that it tells; a turn's id holds until the next turn, also if that has none, its model and tier until another is
    told. ``state`` is ok, missing_usage, or invalid_usage_value where a counter that is there is no whole number.
    """
    read = lines.where("state = 'ok'").select("file", "line_no", F.from_json("value", _ROLLOUT).alias("r"))
    p, kind, inner = "r.payload", F.col("r.type"), F.col("r.payload.type")
    before = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def last(test: Column, value: Column) -> Column:
        return F.last(F.when(test, value), ignorenulls=True).over(before)

    meta, turn = kind == "session_meta", kind == "turn_context"
    tier = F.when(F.col(f"{p}.thread_settings.service_tier").rlike("^[a-z][a-z0-9_-]{0,31}$"), F.col(f"{p}.thread_settings.service_tier"))
    stated = read.select(
        "file", "line_no", "r", kind.alias("kind"), inner.alias("inner"),
        F.first(F.when(meta, F.coalesce(X.id_or_null(F.col(f"{p}.id")), X.id_or_null(F.col(f"{p}.session_id")))), ignorenulls=True).over(whole).alias("session_id"),
        F.first(F.when(meta, X.version_or_null(F.col(f"{p}.cli_version"))), ignorenulls=True).over(whole).alias("harness_version"),
        last(turn, F.struct(X.id_or_null(F.col(f"{p}.turn_id")).alias("id"))).alias("turn"), F.coalesce(last(turn, X.model_or_null(F.col(f"{p}.model"))), F.lit("unknown")).alias("model"),
        last((kind == "event_msg") & (inner == "thread_settings_applied"), tier).alias("service_tier"),
    ).where("kind = 'event_msg' and inner = 'token_count'")

    def counts(side: str) -> Column:
        made = F.struct(*[X.count_or_null(F.col(f"{p}.info.{side}.{n}")).alias(c) for c, n in COUNTERS.items()])
        return F.when(F.col(f"{p}.info.{side}").isNotNull(), made)

    delta, total = counts("last_token_usage"), counts("total_token_usage")
    wrong = F.lit(False)
    for side in ("last_token_usage", "total_token_usage"):
        for n in COUNTERS.values():
            wrong = wrong | F.coalesce(F.col(f"{p}.info.{side}.{n}").isNotNull() & X.count_or_null(F.col(f"{p}.info.{side}.{n}")).isNull(), F.lit(False))
    return stated.select(
        "file", "line_no", "session_id", "harness_version", F.col("turn.id").alias("turn_id"), "model", "service_tier", F.try_to_timestamp("r.timestamp").alias("observed_at"), delta.alias("delta"), total.alias("cumulative"),
        F.when(delta.isNull() & total.isNull(), "missing_usage").when(wrong, "invalid_usage_value").otherwise("ok").alias("state"),
    )


def rollout_usage(observations: DataFrame, sessions: Sequence[str], start, end) -> DataFrame:
    """Usage rows of a task from rollouts, the last row of each event; ``reason`` tells why a row is dropped, null for those that count.

    A count without a delta is the step of the running totals of its file (all start anew if one fell). Cached tokens are taken out of the input once. The ``n``-th count of a turn
    is ``turn.n``, one outside any turn ``session.tcN``. Rows on a tier that isn't the default are unpriced.
    """
    some = observations.where("state <> 'missing_usage'")
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    prior = {c: F.last(F.col(f"cumulative.{c}"), ignorenulls=True).over(w) for c in COUNTERS}
    with_prior = some.select("*", *[e.alias(f"__{c}") for c, e in prior.items()])
    reset = F.lit(False)
    for c in COUNTERS:
        reset = reset | F.coalesce(F.col(f"cumulative.{c}") < F.col(f"__{c}"), F.lit(False))
    step = {c: F.when(reset, F.col(f"cumulative.{c}")).otherwise(F.col(f"cumulative.{c}") - F.coalesce(F.col(f"__{c}"), F.lit(0))) for c in COUNTERS}
    used = {c: F.when(F.col("delta").isNotNull(), F.col(f"delta.{c}")).otherwise(step[c]) for c in COUNTERS}
    flat = with_prior.select("file", "line_no", "session_id", "harness_version", "turn_id", "model", "service_tier", "observed_at", "state", reset.alias("counter_reset"), *[e.alias(c) for c, e in used.items()])
    cut = X.cache_exceeds_input(F.col("input_tokens"), F.col("cache_read_tokens"), F.col("cache_write_tokens"))
    disjoint = flat.withColumn("cache_exceeds_input", cut).withColumn("input_tokens", X.subtract_cached(F.col("input_tokens"), F.col("cache_read_tokens"), F.col("cache_write_tokens")))
    nth = F.row_number().over(Window.partitionBy("file", "turn_id").orderBy("line_no"))
    own_turn = F.coalesce("turn_id", F.concat_ws(".", "session_id", F.concat(F.lit("tc"), nth.cast("string"))))
    named = disjoint.withColumn("event_id", F.when(F.col("turn_id").isNull() | (nth == 1), own_turn).otherwise(F.concat_ws(".", "turn_id", nth.cast("string")))).withColumn("turn_id", own_turn)
    reason = (
        F.when(F.col("session_id").isNull(), "missing_session_id").when(~F.col("session_id").isin(*sessions), "session_not_in_boundary").when(F.col("observed_at").isNull(), "missing_timestamp")
        .when(~F.col("observed_at").between(F.lit(start), F.lit(end)), "outside_time_window")
    )
    told = named.withColumn("reason", reason).withColumn("unpriced", F.coalesce(F.col("service_tier") != "default", F.lit(False)))
    later = F.row_number().over(Window.partitionBy(F.when(F.col("reason").isNull(), F.col("event_id")).otherwise(F.concat_ws("|", "file", "line_no"))).orderBy(F.desc("file"), F.desc("line_no")))
    return told.withColumn("__n", later).withColumn("reason", F.when(F.col("reason").isNull() & (F.col("__n") > 1), "duplicate_row").otherwise(F.col("reason"))).drop("__n", "file", "line_no")


def record_usage(records: DataFrame, task_id: str, sessions: Sequence[str], start, end, allowed: Sequence[str]) -> DataFrame:
    """Records of a task with the ``allowed`` columns and the ``reason`` why one is dropped, null for those that count; the window has both its ends."""
    at = F.try_to_timestamp(F.col("observed_at").cast("string"))
    reason = (
        F.when(F.coalesce(F.col("event_id"), F.lit("")) == "", "invalid_record").when(~F.col("task_id").eqNullSafe(F.lit(task_id)), "foreign_task")
        .when(~F.coalesce(F.col("session_id").isin(*sessions), F.lit(False)), "session_not_in_boundary").when(at.isNull(), "missing_timestamp").when(~at.between(F.lit(start), F.lit(end)), "outside_time_window")
    )
    return records.select(*[c for c in records.columns if c in allowed], reason.alias("reason"))


def boundary_errors(task_id, sessions, started, ended, version=1) -> list[str]:
    """What is wrong with a task's boundary; empty if it can be used."""
    import re

    def fits(x) -> bool:
        return isinstance(x, str) and re.fullmatch(X.ID[1:-1], x) is not None

    checks = {"boundary_version": version == 1, "task_id": fits(task_id), "session_ids": bool(sessions) and all(map(fits, sessions or [])), "window": started is not None and ended is not None and started <= ended}
    return [name for name, ok in checks.items() if not ok]


def provider_usage(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """``payloads`` with the five counters of a provider's usage JSON, whichever of three shapes it has; what is missing or malformed is null.

    Prompts that include cached tokens lose them once; reasoning tokens are told, never added.
    """
    shape = (
        "prompt_tokens string, completion_tokens string, prompt_tokens_details struct<cached_tokens: string>, completion_tokens_details struct<reasoning_tokens: string>, input_tokens string, output_tokens string, "
        "cache_creation_input_tokens string, cache_read_input_tokens string, cached_input_tokens string, cache_write_input_tokens string, reasoning_output_tokens string"
    )
    u = F.from_json(column, shape)

    def n(path: str) -> Column:
        out = u
        for part in path.split("."):
            out = out[part]
        return X.count_or_null(out)

    chat = F.get_json_object(column, "$.prompt_tokens").isNotNull() | F.get_json_object(column, "$.completion_tokens").isNotNull()
    inclusive = F.get_json_object(column, "$.cached_input_tokens").isNotNull() | F.get_json_object(column, "$.reasoning_output_tokens").isNotNull()
    given = F.when(chat, X.subtract_cached(n("prompt_tokens"), n("prompt_tokens_details.cached_tokens"))).when(inclusive, X.subtract_cached(n("input_tokens"), n("cached_input_tokens"), n("cache_write_input_tokens"))).otherwise(n("input_tokens"))
    return payloads.withColumns({
        "input_tokens": given, "output_tokens": F.when(chat, n("completion_tokens")).otherwise(n("output_tokens")),
        "cache_read_tokens": F.when(chat, n("prompt_tokens_details.cached_tokens")).when(inclusive, n("cached_input_tokens")).otherwise(n("cache_read_input_tokens")),
        "cache_write_tokens": F.when(chat, None).when(inclusive, n("cache_write_input_tokens")).otherwise(n("cache_creation_input_tokens")),
        "reasoning_tokens": F.when(chat, n("completion_tokens_details.reasoning_tokens")).when(inclusive, n("reasoning_output_tokens")),
    })


def transcript_totals(lines: DataFrame, after=None) -> DataFrame:
    """``file, input_tokens, output_tokens, cache_write_tokens, cache_read_tokens, turns``: sums over turns strictly after a time; what is no number above 0 counts 0, turns of nothing don't count."""
    usage = "struct<input_tokens: string, output_tokens: string, cache_creation_input_tokens: string, cache_read_input_tokens: string>"
    read = lines.where("state = 'ok'").select("file", F.from_json("value", f"timestamp string, usage {usage}, message struct<usage: {usage}>").alias("r"))
    if after is not None:
        read = read.where(F.try_to_timestamp("r.timestamp") > F.lit(after))
    u = F.coalesce("r.message.usage", "r.usage")
    names = {"input_tokens": "input_tokens", "output_tokens": "output_tokens", "cache_write_tokens": "cache_creation_input_tokens", "cache_read_tokens": "cache_read_input_tokens"}
    each = read.select("file", *[F.coalesce(F.greatest(u[n].try_cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c, n in names.items()])
    some = each.where(" + ".join(names) + " > 0")
    return some.groupBy("file").agg(*[F.sum(c).cast("long").alias(c) for c in names], F.count(F.lit(1)).alias("turns"))


def aider_summary(lines: DataFrame, by: str = "file", order: str = "line_no") -> DataFrame:
    """``by``, the last model, sums of tokens (null if no line has any) and the last cost of the session."""
    told = lines.select(by, order, T.aider_line(F.col("value")).alias("a"))
    sums = [F.sum(f"a.{c}").alias(c) for c in ("input_tokens", "output_tokens", "cache_write_tokens", "cache_read_tokens")]
    return told.groupBy(by).agg(F.max_by("a.model", F.when(F.col("a.model").isNotNull(), F.col(order))).alias("model"), *sums, F.max_by("a.session_cost_usd", F.when(F.col("a.session_cost_usd").isNotNull(), F.col(order))).alias("session_cost_usd"))


def name_status(lines: DataFrame) -> DataFrame:
    """``lines`` as ``status, path, previous_path``: of renames and copies the letter alone and the path after; rows without both are left out."""
    part = F.split("value", "\t")
    status = F.substring(F.trim(F.get(part, F.lit(0))), 1, 1)
    moved = status.isin("R", "C")
    rest = [c for c in lines.columns if c != "value"]
    out = lines.select(*rest, status.alias("status"), F.when(moved, F.get(part, F.lit(2))).otherwise(F.get(part, F.lit(1))).alias("path"), F.when(moved, F.get(part, F.lit(1))).alias("previous_path"))
    return out.where("status <> '' and coalesce(path, '') <> ''")


def raw_numstat(raw: DataFrame, numstat: DataFrame, keys: Sequence[str] = ("diff",)) -> DataFrame:
    """Facts of a diff's files: object ids and status of the raw side with line counts of the other; a binary file counts 0."""
    counted = numstat.select(*keys, "path", *[F.coalesce(F.when(F.col(c) != "-", F.col(c).try_cast("long")), F.lit(0)).alias(c) for c in ("added", "deleted")])
    return raw.select(*keys, "path", "old_oid", "new_oid", F.substring("status", 1, 1).alias("status")).join(counted, [*keys, "path"], "left").na.fill(0, ["added", "deleted"])


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A CSV sheet with a header, quoted cells with commas, quotes and line ends in them; rows of blank cells are left out."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    return rows.where(F.length(F.concat_ws("", *[F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in rows.columns])) > 0)


def pinned(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """``file, sha256, ok`` for each file of a manifest (``file`` a name, ``sha256``): is it there with these bytes?"""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("found"))
    return manifest.join(files, "file", "left").select("file", "sha256", F.coalesce(F.col("found") == F.col("sha256"), F.lit(False)).alias("ok"))


def read_gzip_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of gzip files of any number of members, with their state."""
    return L.with_state(L.read_lines(spark, path))


def validated(lines: DataFrame, schema: str, rules: dict[str, Column]) -> DataFrame:
    """JSON lines parsed to ``r`` with ``broken``: names of rules that don't hold (malformed if the line is no object); rules see the parsed struct as ``r``."""
    read = lines.withColumn("r", F.from_json("value", schema))
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))
    return read.withColumn("broken", F.when(F.col("state") != "ok", F.array(F.lit("malformed"))).otherwise(broken))


def unchanged_state(state: DataFrame, header: dict[str, str], ancestors: DataFrame) -> bool:
    """May cached rows be used again? All header fields must be equal and the last commit seen an ancestor; ``state`` has one row at most."""
    row = state.limit(1).collect()
    if not row or any(row[0][k] != v for k, v in header.items()):
        return False
    return bool(ancestors.where(F.col("sha") == row[0]["last_seen_sha"]).limit(1).count())


def runnable(repos: DataFrame, only: Sequence[str] = ()) -> DataFrame:
    """Cohort entries that a run takes: kept, pending an exception or unmeasured, and among ``only`` if given."""
    kept = repos.where(F.col("status").isin("kept", "pending_exception", "unmeasured"))
    return kept.where(F.col("repo").isin(*only)) if only else kept
