"""Logs of a task's attempts, folded task by task: which launches are current, which writes count, and what went stale.

A log row: ``task_id, ordinal, record_type`` (attempt, control, evidence, derived), ``key`` (attempt, write or derived id), ``kind, parent_id, slot`` (stage of a stage attempt, role of an
arm), ``retry_of, run_id, stage_id, outcome, evidence_kind, version, supersedes, inputs`` (array of attempt, evidence kind and version). Order matters, so one task's log is folded
in one place; a task's log is some hundred rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARENTS = {"arm": "pair", "run": "arm", "stage_attempt": "run"}


class _Tree:
    """Attempts of one task; the latest launch in each slot is the current one."""

    def __init__(self, task):
        self.task, self.of, self.latest = str(task), {}, {}

    def slot(self, r) -> tuple:
        top = r.kind == "pair" or r.kind == "run" and r.parent_id == self.task
        return ("execution",) if top else (r.parent_id, r.kind, r.slot if r.kind in ("arm", "stage_attempt") else "")

    def current(self, key) -> bool:
        while key in self.of and self.latest[self.of[key]["slot"]] == key:
            if self.of[key]["parent"] == self.task:
                return True
            key = self.of[key]["parent"]
        return False

    def refusal(self, r) -> str | None:
        if r.key in self.of:
            return "id_reused"
        if not (r.parent_id == self.task and r.kind in ("pair", "run")):
            parent = self.of.get(r.parent_id)
            if parent is None:
                return "unknown_parent"
            if parent["kind"] != PARENTS.get(r.kind):
                return "parent_mismatch"
        if r.retry_of is not None:
            first = self.of.get(r.retry_of)
            if first is None or (first["kind"], first["slot"]) != (r.kind, self.slot(r)):
                return "retry_target_invalid"
            if first["outcome"] == "succeeded":
                return "retry_of_succeeded"
        return None

    def add(self, r) -> None:
        slot = self.slot(r)
        self.latest[slot] = r.key
        self.of[r.key] = {"kind": r.kind, "parent": r.parent_id, "slot": slot, "outcome": None}

    def resolve(self, r) -> tuple:
        """The run and the attempt that a write names, and whether its ids contradict what is known."""
        run = self.of.get(r.run_id)
        stage = self.of.get(r.stage_id) if r.stage_id is not None else None
        clash = run is not None and run["kind"] != "run" or stage is not None and (stage["kind"], stage["parent"]) != ("stage_attempt", r.run_id)
        return run, (run if r.stage_id is None else stage), clash

    def control(self, r) -> str | None:
        run, target, clash = self.resolve(r)
        if clash:
            return "ref_mismatch"
        if run is None or target is None:
            return "unknown_attempt"
        if not self.current(r.run_id):
            return "stale_run"
        if r.stage_id is not None and not self.current(r.stage_id):
            return "stale_stage_attempt"
        if run["outcome"] is not None or target["outcome"] is not None:
            return "settled"
        if r.outcome is not None:
            target["outcome"] = r.outcome
        return None


def _fold(log: pd.DataFrame) -> tuple[list[tuple], _Tree, dict]:
    rows = log.sort_values("ordinal", kind="stable").astype(object).where(log.notna(), None)
    tree, writes, versions, derived, out = _Tree(rows["task_id"].iloc[0]), set(), {}, set(), []
    for r in rows.itertuples(index=False):
        decision, reasons = "accepted", []
        if r.record_type == "attempt":
            if why := tree.refusal(r):
                decision, reasons = "rejected", [why]
            else:
                tree.add(r)
        elif r.record_type == "derived":
            decision = "duplicate" if r.key in derived else "accepted"
            derived.add(r.key)
        elif r.key in writes:
            decision = "duplicate"
        else:
            writes.add(r.key)
            if r.record_type == "control":
                if why := tree.control(r):
                    decision, reasons = "rejected", [why]
            else:
                _, target, clash = tree.resolve(r)
                at = (r.stage_id or r.run_id, r.evidence_kind)
                if clash:
                    decision, reasons = "rejected", ["ref_mismatch"]
                else:
                    reasons = [*["undeclared_attempt"] * (target is None), *["evidence_version_not_newer"] * (at in versions and r.version <= versions[at])]
                    versions[at] = max(versions.get(at, r.version), r.version)
        out.append((r.task_id, int(r.ordinal), r.key, decision, reasons))
    return out, tree, versions


def decisions(log: DataFrame) -> DataFrame:
    """``task_id, ordinal, key, decision, reasons`` of every log row."""
    kind = log.schema["task_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_fold(pdf)[0], columns=["task_id", "ordinal", "key", "decision", "reasons"])

    return log.groupBy("task_id").applyInPandas(run, f"task_id {kind}, ordinal long, key string, decision string, reasons array<string>")


def attempts(log: DataFrame) -> DataFrame:
    """``task_id, key, kind, parent_id, current, outcome`` of every declared attempt."""
    kind = log.schema["task_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, tree, _ = _fold(pdf)
        rows = [(pdf["task_id"].iloc[0], k, x["kind"], x["parent"], tree.current(k), x["outcome"]) for k, x in tree.of.items()]
        return pd.DataFrame(rows, columns=["task_id", "key", "kind", "parent_id", "current", "outcome"])

    return log.groupBy("task_id").applyInPandas(run, f"task_id {kind}, key string, kind string, parent_id string, current boolean, outcome string")


def derived_status(log: DataFrame) -> DataFrame:
    """``task_id, key, status``: superseded by another, stale if an input has newer evidence that was accepted, else current."""
    made = log.where("record_type = 'derived'").groupBy("task_id", "key").agg(F.min_by("inputs", "ordinal").alias("inputs"), F.min_by("supersedes", "ordinal").alias("supersedes"))
    over = made.where("supersedes is not null").select("task_id", F.col("supersedes").alias("key"), F.lit(True).alias("__over")).distinct()
    accepted = log.where("record_type = 'evidence'").join(decisions(log).where("decision = 'accepted'").select("task_id", "ordinal"), ["task_id", "ordinal"])
    newest = accepted.groupBy("task_id", F.coalesce("stage_id", "run_id").alias("attempt"), "evidence_kind").agg(F.max("version").alias("latest"))
    used = made.select("task_id", "key", F.explode("inputs").alias("i")).select("task_id", "key", F.col("i.attempt").alias("attempt"), F.col("i.evidence_kind").alias("evidence_kind"), F.col("i.version").alias("version"))
    stale = used.join(newest, ["task_id", "attempt", "evidence_kind"]).where("latest > version").select("task_id", "key", F.lit(True).alias("__stale")).distinct()
    met = made.join(over, ["task_id", "key"], "left").join(stale, ["task_id", "key"], "left")
    return met.select("task_id", "key", F.when(F.col("__over"), "superseded").when(F.col("__stale"), "stale").otherwise("current").alias("status"))


def code_identity(base_sha: Column, entries: Column) -> Column:
    """For each entry of a candidate the base, the heads before it in order, and its own: ``array<struct<base_sha, predecessors, head_sha>>``."""
    heads = F.transform(entries, lambda e: e["head_sha"])
    return F.transform(entries, lambda e, i: F.struct(base_sha.alias("base_sha"), F.slice(heads, F.lit(1), i).alias("predecessors"), e["head_sha"].alias("head_sha")))


def funnel(signals: DataFrame) -> DataFrame:
    """``installation, install, <stages>``: when each stage was first seen, once an installation; install is at the latest the first signal of all."""
    first = signals.groupBy("installation", "stage").agg(F.min("at").alias("at"))
    start = first.groupBy("installation").agg(F.min("at").alias("install"))
    route = first.where("stage = 'first_route'").select("installation", F.col("at").alias("first_route"))
    return start.join(route, "installation", "left").withColumn("seconds_to_first_route", F.unix_timestamp("first_route") - F.unix_timestamp("install"))


def queue_decisions(events: DataFrame) -> DataFrame:
    """``event_id, ordinal, decision, reasons`` of queue events: repeats, conflicts, candidates used twice or unknown, and decisions that read what wasn't there yet.

    ``events``: ``event_id, ordinal, event_type, body`` (canonical JSON), ``candidate_id, observed_at, context array<string>, context_as_of``. The first body of an id counts: the same again is
    a duplicate, another a conflict. A candidate is prepared once, before it is named. A recovery decision may read only events observed by its time whose id and candidate were accepted.
    """
    by_id = Window.partitionBy("event_id").orderBy("ordinal")
    placed = events.withColumns({"__n": F.row_number().over(by_id), "__first": F.first("body").over(by_id)})
    again = placed.where("__n > 1").select("event_id", "ordinal", F.when(F.col("body") == F.col("__first"), "duplicate").otherwise("rejected").alias("decision"), F.when(F.col("body") == F.col("__first"), F.array().cast("array<string>")).otherwise(F.array(F.lit("event_id_conflict"))).alias("reasons"))
    own = placed.where("__n = 1")
    by_candidate = Window.partitionBy("candidate_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    prepared = F.coalesce(F.max(F.col("event_type") == "candidate_prepared").over(by_candidate), F.lit(False)) & F.col("candidate_id").isNotNull()
    judged = own.withColumn("__why", F.when(F.col("event_type") == "candidate_prepared", F.when(prepared, "candidate_id_reused")).when(F.col("candidate_id").isNotNull() & ~prepared, "unknown_candidate"))
    read = judged.where("event_type = 'recovery_decision'").select("event_id", F.col("ordinal").alias("__at"), "context_as_of", F.explode("context").alias("__id"))
    seen = judged.where("__why is null").select(F.col("event_id").alias("__id"), F.col("observed_at").alias("__seen"), F.col("ordinal").alias("__before"))
    met = read.join(seen, "__id", "left")
    leaks = met.where("__seen is null or __seen > context_as_of or __before > __at").select("event_id", F.lit(True).alias("__leak")).distinct()
    reasons = F.array_compact(F.array(F.col("__why"), F.when(F.col("__leak"), "context_leak")))
    first = judged.join(leaks, "event_id", "left").select("event_id", "ordinal", F.when(F.size(reasons) > 0, "rejected").otherwise("accepted").alias("decision"), reasons.alias("reasons"))
    return first.union(again)
