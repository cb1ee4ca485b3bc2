"""Task cost: replay resolution, counters to deltas, segments, totals, and the ledger."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..session import checkpointed
from . import pricing

SOURCES = ("provider_reported", "local_estimate", "none")
LEDGER_TOKENS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")


def first_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def last_wins_first_position(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row of each key, with ``position`` of the first."""
    w = Window.partitionBy(*keys)
    ranked = rows.withColumn("position", F.min(order).over(w)).withColumn("__n", F.row_number().over(w.orderBy(F.desc(order))))
    return ranked.where("__n = 1").drop("__n")


def resolve_replays(events: DataFrame, task: str = "task_id", event: str = "event_id", replay_of: str = "replay_of", order: str = "ordinal") -> DataFrame:
    """First row of each event, without events that a kept one replays.

    A target that isn't there changes nothing. Chains drop all but their last. ``replay_cycles``
    tells of cycles, which this leaves without any row.
    """
    kept = first_wins(events, [task, event], [order])
    superseded = kept.where(F.col(replay_of).isNotNull()).select(F.col(task), F.col(replay_of).alias(event)).distinct()
    return kept.join(superseded, [task, event], "left_anti")


def replay_cycles(events: DataFrame, task: str = "task_id", event: str = "event_id", replay_of: str = "replay_of", order: str = "ordinal") -> DataFrame:
    """Events on a cycle of replays: those from which doubling the steps never leaves the chain."""
    edges = first_wins(events, [task, event], [order]).where(F.col(replay_of).isNotNull()).select(task, event, F.col(replay_of).alias("to"))
    edges = checkpointed(edges.join(edges.select(task, F.col(event).alias("to")), [task, "to"], "left_semi").select(task, event, "to"))
    left, steps = edges.count(), 1
    # a chain that ends loses its edges as the steps double; on a cycle none is lost. A cycle has no more events than are left
    while left and steps <= left:
        right = edges.select(F.col(task).alias("__t"), F.col(event).alias("__e"), F.col("to").alias("__to"))
        edges = checkpointed(edges.join(right, (F.col(task) == F.col("__t")) & (F.col("to") == F.col("__e"))).select(task, event, F.col("__to").alias("to")))
        left, steps = edges.count(), steps * 2
    return edges.select(task, event)


def _last_before(x: Column, kind: Column, w) -> Column:
    return F.last(F.when(kind == "cumulative", x), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))


def cumulative_to_delta(events: DataFrame, fields: Sequence[str], session: Sequence[str], order: Sequence[str], kind: str = "usage_kind") -> DataFrame:
    """Each cumulative field as its step from the last known value before it.

    A null stays null and leaves the last value standing; a step back counts 0, sets ``backward``
    and becomes the new last value. Delta rows pass as they are and never move it.
    """
    w = Window.partitionBy(*session).orderBy(*order)
    out = events.select("*", *[_last_before(F.col(f), F.col(kind), w).alias(f"__{f}") for f in fields])
    cumulative = F.col(kind) == "cumulative"
    back = F.lit(False)
    for f in fields:
        back = back | F.coalesce(F.col(f) < F.col(f"__{f}"), F.lit(False))
    steps = {f: F.when(~cumulative, F.col(f)).when(F.col(f).isNull(), None).when(F.col(f"__{f}").isNull(), F.col(f)).otherwise(F.greatest(F.col(f) - F.col(f"__{f}"), F.lit(0).cast(events.schema[f].dataType))) for f in fields}
    return out.select(*[c for c in events.columns if c not in fields], *[e.alias(f) for f, e in steps.items()], (cumulative & back).alias("backward"))


def tracker_delta(rows: DataFrame, fields: Sequence[str], session: Sequence[str], order: Sequence[str]) -> DataFrame:
    """As ``cumulative_to_delta`` with the other rule: if any field steps back, all start anew and the totals are the step."""
    w = Window.partitionBy(*session).orderBy(*order)
    before = {f: F.lag(F.coalesce(F.col(f), F.lit(0))).over(w) for f in fields}
    out = rows.select("*", *[e.alias(f"__{f}") for f, e in before.items()])
    reset = F.lit(False)
    for f in fields:
        reset = reset | F.coalesce(F.coalesce(F.col(f), F.lit(0)) < F.col(f"__{f}"), F.lit(False))
    steps = [F.when(reset, F.coalesce(F.col(f), F.lit(0))).otherwise(F.coalesce(F.col(f), F.lit(0)) - F.coalesce(F.col(f"__{f}"), F.lit(0))).alias(f) for f in fields]
    return out.select(*[c for c in rows.columns if c not in fields], *steps, reset.alias("reset"))


def model_segments(observations: DataFrame, tokens: Sequence[str], task: str = "task_id", model: str = "model", order: Sequence[str] = ("ts", "session_id", "sequence", "event_id"), turn: str = "turn_id") -> DataFrame:
    """Runs of one model in canonical order: rows, distinct turns and null-preserving sums."""
    w = Window.partitionBy(task).orderBy(*order)
    new = F.coalesce(F.col(model) != F.lag(model).over(w), F.lit(True)).cast("long")
    island = observations.withColumn("__new", new).withColumn("segment", F.sum("__new").over(w))
    return island.groupBy(task, "segment", model).agg(F.count(F.lit(1)).alias("observations"), F.count_distinct(turn).alias("turns"), *[F.sum(t).alias(t) for t in tokens])


def cost_totals(observations: DataFrame, keys: Sequence[str], tokens: Sequence[str]) -> DataFrame:
    """Totals of effective observations by ``keys``: sums that keep nulls, strict and lower-bound cost, and promoted states.

    Costs are whole micro-dollars in ``actual_micros`` and ``estimated_micros``.
    """
    resolved = F.coalesce("actual_micros", "estimated_micros")
    source = F.when(F.col("actual_micros").isNotNull(), "provider_reported").when(F.col("estimated_micros").isNotNull(), "local_estimate").otherwise("none")
    return observations.groupBy(*keys).agg(
        *[F.sum(t).alias(t) for t in tokens],
        X.strict_sum(resolved).alias("total_micros"),
        F.sum(resolved).alias("lower_bound_micros"),
        X.promote_source(source).alias("cost_source"),
        X.promote_coverage(F.col("coverage")).alias("coverage"),
        X.promote_single(F.col("cost_basis"), "unknown").alias("cost_basis"),
        F.count_distinct("session_id").alias("sessions"),
        F.count_distinct("session_id", "turn_id").alias("turns"),
        F.count_distinct("model").alias("models"),
        F.count(F.lit(1)).alias("observations"),
    )


# What a ledger row may hold, and its fields but the checksum.
TASK_ID, BACKEND = r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$", r"^[A-Za-z0-9][A-Za-z0-9._:@/-]{0,127}$"
SECRET_LIKE, ADDRESS = r"(?i)^(sk(-ant)?-|AKIA|acct[_-])", r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
BASES, COVERAGES = ("metered", "token_equivalent", "unpriced"), ("complete", "partial")
HARNESSES = ("claude-code", "codex", "native", "pi", "unknown")
SIGNED = {
    "v": "v", "id": "id", "ts": "ts", "taskId": "task_id", "model": "model", "harness": "harness", "backend": "backend", "source": "source", "pricingBasis": "pricing_basis", "amountMicros": "amount_micros",
    "currency": "currency", "inputTokens": "input_tokens", "outputTokens": "output_tokens", "cacheReadTokens": "cache_read_tokens", "cacheWriteTokens": "cache_write_tokens", "coverage": "coverage",
}


def ledger_json(row: dict[str, Column]) -> Column:
    """A ledger row as JSON with sorted keys and its nulls; what its checksum is taken of."""
    return F.to_json(F.struct(*[row[k].alias(k) for k in sorted(row)]), {"ignoreNullFields": "false"})


def ledger_checksum(row: dict[str, Column]) -> Column:
    return F.substring(F.sha2(ledger_json(row), 256), 1, 16)


def to_ledger(events: DataFrame) -> DataFrame:
    """Events as ledger rows: counters that are unknown count 0 and make the row partial.

    ``id`` is of task, source and event as a JSON array, ``c`` the checksum of all other fields. A
    backend that isn't given is the price table, else what precedes a slash in the model.
    """
    basis = F.when(F.col("actual_micros").isNotNull(), "metered").when(F.col("estimated_micros").isNotNull(), "token_equivalent").otherwise("unpriced")
    known = F.lit(True)
    for t in LEDGER_TOKENS:
        known = known & F.col(t).isNotNull()
    prefix = F.when(F.instr("model", "/") > 1, F.substring_index("model", "/", 1)).otherwise("unknown")
    backend = F.coalesce(*[F.col(c) for c in ("backend", "price_table") if c in events.columns], prefix)
    made = events.select(
        F.lit(1).alias("v"), X.json_id([F.col("task_id"), F.col("source"), F.col("event_id")], 32).alias("id"), "ts", F.col("task_id").cast("string").alias("task_id"), "model", "harness", backend.alias("backend"), "source",
        basis.alias("pricing_basis"), F.coalesce("actual_micros", "estimated_micros").alias("amount_micros"), F.lit("USD").alias("currency"),
        *[F.coalesce(F.col(t), F.lit(0)).alias(t) for t in LEDGER_TOKENS], F.when(known, "complete").otherwise("partial").alias("coverage"),
    )
    signed = {k: F.unix_millis(F.col(c).cast("timestamp")) if c == "ts" else F.col(c) for k, c in SIGNED.items()}
    return made.withColumn("c", ledger_checksum(signed)).withColumn("task_id", F.col("task_id").cast(events.schema["task_id"].dataType))


def safe_label(x: Column, pattern: str) -> Column:
    """Does it fit the pattern, without double dots or slashes, and look like neither a secret nor an address?"""
    return F.coalesce(x.rlike(pattern) & ~x.contains("..") & ~x.contains("//") & ~x.rlike(SECRET_LIKE) & ~x.rlike(ADDRESS), F.lit(False))


def ledger_errors(row: dict[str, Column]) -> Column:
    """Names of the fields of a ledger row that break a rule, in fixed order; empty for a valid one."""

    def count(x: Column) -> Column:
        return F.coalesce((x >= 0) & (x <= X.SAFE_INTEGER), F.lit(False))

    def one_of(x: Column, names) -> Column:
        return F.coalesce(x.isin(*names), F.lit(False))

    amount, unpriced = row["amountMicros"], row["pricingBasis"] == "unpriced"
    rules = {
        "taskId": safe_label(row["taskId"].cast("string"), TASK_ID), "model": safe_label(row["model"], X.MODEL), "backend": safe_label(row["backend"], BACKEND), "harness": one_of(row["harness"], HARNESSES), "source": one_of(row["source"], SOURCES),
        "pricingBasis": one_of(row["pricingBasis"], BASES), "amountMicros": F.coalesce(unpriced, F.lit(False)).eqNullSafe(amount.isNull()) & (amount.isNull() | count(amount)),
        **{c: count(row[c]) for c in ("ts", "inputTokens", "outputTokens", "cacheReadTokens", "cacheWriteTokens")}, "coverage": one_of(row["coverage"], COVERAGES),
    }
    return F.array_compact(F.array(*[F.when(~ok, name) for name, ok in rules.items()]))


# Steps from one version of a ledger row to the next; none yet.
MIGRATIONS: dict[int, Callable[[Column], Column]] = {}


def migrated(row: Column, version: Column, target: int = 1, steps: dict[int, Callable[[Column], Column]] | None = None) -> Column:
    """``row`` (a struct with ``v``) taken from its version to ``target`` step by step; null where a step is missing or the version is beyond it."""
    steps = MIGRATIONS if steps is None else steps
    out = F.when(version == target, row)
    for first in range(target - 1, 0, -1):
        if not all(v in steps for v in range(first, target)):
            break
        made = row
        for v in range(first, target):
            made = steps[v](made).withField("v", F.lit(v + 1))
        out = out.when(version == first, made)
    return out


def append_new(ledger: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows that are not in the ledger yet, the first of each id by time and checksum: what an idempotent append writes."""
    first = rows.groupBy("id").agg(F.min_by(F.struct(*rows.columns), F.struct("ts", "c")).alias("row")).select("row.*")
    return first.join(ledger.select("id"), "id", "left_anti")


def ledger_filter(ledger: DataFrame, task_id=None, start=None, end=None) -> DataFrame:
    """Task equality and a half-open time range; each may be left out."""
    if start is not None and end is not None and not start < end:
        raise ValueError("from must be before to")
    for given, test in ((task_id, F.col("task_id") == F.lit(task_id)), (start, F.col("ts") >= F.lit(start)), (end, F.col("ts") < F.lit(end))):
        ledger = ledger if given is None else ledger.where(test)
    return ledger


def _ledger_measures() -> list[Column]:
    partial = (F.col("coverage") == "partial") | (F.col("pricing_basis") == "unpriced")

    def amount(basis: str, *more: Column) -> Column:
        test = F.col("pricing_basis") == basis
        for m in more:
            test = test & m
        return X.safe_sum(F.when(test, F.col("amount_micros")))

    out = [F.count(F.lit(1)).alias("records"), amount("metered").alias("metered_micros"), amount("token_equivalent").alias("token_equivalent_micros"), F.count_if(F.col("pricing_basis") == "unpriced").alias("unpriced")]
    out += [X.safe_sum(F.col(t)).alias(t) for t in LEDGER_TOKENS]
    out += [F.when(F.count(F.lit(1)) == 0, "none").when(F.max(partial), "partial").otherwise("complete").alias("coverage")]
    for s in SOURCES:
        own = F.col("source") == s
        out += [F.count_if(own).alias(f"{s}_records"), amount("metered", own).alias(f"{s}_metered_micros")]
    return out


def ledger_totals(ledger: DataFrame) -> DataFrame:
    """One row; every source has its columns, with 0 where it has no record."""
    return ledger.agg(*_ledger_measures())


def ledger_query(ledger: DataFrame, keys: Sequence[str], task_id=None, start=None, end=None) -> DataFrame:
    """Grand total (``level`` 0, keys null) and groups (``level`` 1) in one pass."""
    allowed = {"model", "harness", "backend", "source"}
    if not keys or len(set(keys)) < len(keys) or not set(keys) <= allowed:
        raise ValueError(f"group by distinct keys of {sorted(allowed)}")
    rows = ledger_filter(ledger, task_id, start, end)
    level = F.when(F.grouping_id() == 0, 1).otherwise(0).alias("level")
    return rows.groupingSets([[F.col(k) for k in keys], []], *[F.col(k) for k in keys]).agg(level, *_ledger_measures())


def task_summary(ledger: DataFrame) -> DataFrame:
    """For each task its total and its parts by model, harness, backend and source, from one pass."""
    parts = ("model", "harness", "backend", "source")
    sets = [[F.col("task_id"), F.col(p)] for p in parts] + [[F.col("task_id")]]
    which = F.coalesce(*[F.when(F.grouping(p) == 0, p) for p in parts], F.lit("total")).alias("part")
    grouped = ledger.groupingSets(sets, F.col("task_id"), *[F.col(p) for p in parts])
    measured = grouped.agg(which, *_ledger_measures())
    return measured.select("task_id", "part", F.coalesce(*parts).alias("value"), *[c for c in measured.columns if c not in ("task_id", "part", *parts)])


def price(usage: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """Usage with ``pico_usd`` and ``priced_micros``: exact whole-number pricing of input and output, half up.

    The normalized id is looked up first, then the id without its snapshot; without a price, or
    with an unknown counter, the amount is null. ``prices`` as ``pricing`` tells; they are looked up by an ordinary join.
    """
    found = pricing.with_price(usage, prices, model)
    total = pricing.pico_usd(F.col("input_tokens"), F.col("price.input_rate")) + pricing.pico_usd(F.col("output_tokens"), F.col("price.output_rate"))
    known = F.col("price").isNotNull() & F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull()
    priced = found.withColumn("pico_usd", F.when(known, total.cast("decimal(38,0)")))
    return priced.withColumn("priced_micros", pricing.pico_to_micros(F.col("pico_usd"))).drop("price")


def difference(current: Column, previous: Column) -> Column:
    """One field's step: null if unknown, all of it without a value before, 0 if it fell."""
    return F.when(current.isNotNull(), F.when(previous.isNull(), current).otherwise(F.greatest(current - previous, F.lit(0).cast("long"))))


# Canonical order of events.
CANONICAL_ORDER = ("ts", "session_id", "sequence", "event_id")


def assign_sequence(rows: DataFrame, session: str = "session_id", at: str = "ts", order: str = "ordinal") -> DataFrame:
    """``sequence`` from 1 in each session by time, rows of one time in their given order."""
    return rows.withColumn("sequence", F.row_number().over(Window.partitionBy(session).orderBy(at, order)))


def contributing(events: DataFrame, summaries: DataFrame) -> DataFrame:
    """Events that a summary of their task names in its ``event_ids``."""
    named = summaries.select("task_id", F.explode("event_ids").alias("event_id"))
    return events.join(named, ["task_id", "event_id"], "left_semi")


def merge_breakdowns(parts: DataFrame, keys: Sequence[str], tokens: Sequence[str]) -> DataFrame:
    """Breakdowns of engines merged by ``keys``: strict totals, lower bounds of charges and estimates, sums and promoted states."""
    return parts.groupBy(*keys).agg(
        X.strict_sum(F.col("total_micros")).alias("total_micros"), F.sum("actual_micros").alias("actual_micros"), F.sum("estimated_micros").alias("estimated_micros"),
        *[F.sum(t).alias(t) for t in tokens], F.sum("events").alias("events"), F.sum("turns").alias("turns"),
        X.promote_source(F.col("cost_source")).alias("cost_source"), X.promote_coverage(F.col("coverage")).alias("coverage"),
    )


# Codes of a cost report in its order; those that only inform and those that are errors; two that are renamed.
DIAGNOSTICS = (
    "missing_token_usage", "invalid_token_usage", "unpriced_model", "mixed_coverage", "provider_reported_cost", "no_pricing_data", "no_priced_sessions", "stale_pricing_revision", "replay_dropped",
    "cumulative_backward_jump", "subscription_basis_no_charge", "oversized_line", "truncated_input", "missing_session_id", "session_not_in_boundary", "foreign_task", "missing_timestamp", "outside_time_window",
    "missing_usage", "invalid_usage_value", "duplicate_row", "cumulative_counter_reset", "codex_cache_exceeds_input", "unpriced_service_tier", "oversized_file", "invalid_usage", "duplicate_event",
    "session_file_unreadable", "malformed_record", "no_usage_captured", "collection_failed", "aggregation_failed", "ledger_flush_failed",
)
INFORMING = ("provider_reported_cost", "replay_dropped", "subscription_basis_no_charge", "duplicate_event", "duplicate_row", "outside_time_window", "session_not_in_boundary", "foreign_task")
FAILING = ("collection_failed", "aggregation_failed", "ledger_flush_failed")
RENAMED = {"unreadable_file": "session_file_unreadable", "malformed_line": "malformed_record", "invalid_record": "malformed_record"}


def report_diagnostics(counts: DataFrame, key: str = "task_id") -> DataFrame:
    """``key, place, code, level, count`` of codes that occur, in the report's order; codes it doesn't know are left out."""
    renamed = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in RENAMED.items() for x in kv]), F.col("code")), F.col("code"))
    place = F.array_position(F.array(*[F.lit(c) for c in DIAGNOSTICS]), F.col("code"))
    total = counts.select(key, renamed.alias("code"), "count").where("count > 0").groupBy(key, "code").agg(F.sum("count").alias("count"))
    level = F.when(F.col("code").isin(*INFORMING), "info").when(F.col("code").isin(*FAILING), "error").otherwise("warn")
    return total.where(place > 0).select(key, place.cast("int").alias("place"), "code", level.alias("level"), "count")


def cost_report(events: DataFrame, tokens: Sequence[str] = LEDGER_TOKENS) -> DataFrame:
    """One row a task from its contributing events: totals, provenance and how much of it was priced.

    ``events`` as for ``cost_totals`` with ``cost_source, usage_coverage, pricing_revision, price_table``.
    Unpriced models are those of events that have usage and no cost; revisions and tables are sorted.
    """
    resolved = F.coalesce("actual_micros", "estimated_micros")
    priced = F.col("cost_source") != "none"
    unknown = ~priced & (F.col("usage_coverage") != "unavailable")
    return events.groupBy("task_id").agg(
        X.strict_sum(resolved).alias("total_micros"), F.sum("actual_micros").alias("actual_micros"), F.sum("estimated_micros").alias("estimated_micros"), *[F.sum(t).alias(t) for t in tokens],
        F.count(F.lit(1)).alias("events"), F.count_distinct("session_id", "turn_id").alias("turns"), X.promote_source(F.col("cost_source")).alias("cost_source"),
        F.array_sort(F.collect_set("pricing_revision")).alias("revisions"), F.max("pricing_revision").alias("revision"), F.array_sort(F.collect_set("price_table")).alias("price_tables"),
        F.count_if(priced).alias("priced_events"), F.count_if(~priced).alias("unpriced_events"), F.array_sort(F.collect_set(F.when(unknown, F.col("model")))).alias("unknown_models"),
    )


def or_unavailable(tasks: DataFrame, report: DataFrame) -> DataFrame:
    """Every task with its report, or with nulls and the coverage unavailable."""
    joined = tasks.select("task_id").join(report, "task_id", "left")
    return joined.withColumn("status", F.when(F.col("events").isNull(), "unavailable").when(F.col("unpriced_events") > 0, "partial").otherwise("complete"))


def stage_total(stages: DataFrame, key: str = "task_id", cost: str = "cost_usd") -> DataFrame:
    """The sum of a task's stages to a billionth, null unless every stage is known."""
    return stages.groupBy(key).agg(X.round_usd(X.strict_sum(F.col(cost).cast("decimal(28,9)")).cast("double")).alias("stage_total_usd"), F.count(F.lit(1)).alias("stages"))
