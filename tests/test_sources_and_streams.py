"""Lines, transcripts, ledger lines, diffs; streams that run again add nothing."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import functions as F

from quillon.operators import cost
from quillon.sources import lines as L
from quillon.streaming import ledger as S
from quillon.streaming import tracker as T


def _frame(spark, values):
    return spark.createDataFrame([("f", v) for v in values], "file string, value string")


def test_states_of_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\r\n\n[1]\n{bad\n{"b": "' + "x" * 50 + '"}\n')
    found = L.with_state(L.read_lines(spark, str(tmp_path)), longest=40)
    assert {r["state"]: r["n"] for r in L.line_counts(found).collect()} == {"ok": 1, "malformed_line": 2, "oversized_line": 1}


def test_transcripts_keep_no_free_text(spark):
    def line(**more):
        return json.dumps({"type": "assistant", "uuid": "u1", "sessionId": "s", "timestamp": "2026-01-01T00:00:00Z", "secret": "SENTINEL", **more})

    usage = {"input_tokens": 5, "output_tokens": -1}
    rows = L.transcript_usage(_frame(spark, [line(requestId="r", message={"id": "m", "model": "x", "content": "SENTINEL", "usage": usage}), line(message={"model": "x"}), '{"type": "user"}'])).orderBy("event_key").collect()
    assert [(r["event_key"], r["state"], r["input_tokens"], r["output_tokens"]) for r in rows] == [("m.r", "invalid_usage_value", 5, None), ("u1", "missing_usage", None, None)]
    assert "SENTINEL" not in str(rows)


def test_diff_hunks(spark):
    text = ["--- a/x.py", "+++ b/y.py", "@@ -3,2 +3 @@", "@@ -9,0 +10,4 @@ def f", "--- /dev/null", "+++ b/new", "@@ -0,0 +1,2 @@"]
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(text)], "diff int, line_no int, value string")
    found = {tuple(r)[1:] for r in L.diff_hunks(rows).collect()}
    assert found == {(None, "new", None, None, 1, 2), ("x.py", "y.py", 3, 4, 3, 3), ("x.py", "y.py", None, None, 10, 13)}


EVENTS = "event_id long, task_id long, ts timestamp, model string, harness string, backend string, source string, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long, actual_micros long, estimated_micros long"


def _events(spark, ids):
    at = datetime.datetime(2026, 1, 1, tzinfo=datetime.timezone.utc)
    return spark.createDataFrame([(i, 1, at, "m", "h", "b", "none", i, None, 0, 0, i, None) for i in ids], EVENTS)


def test_ledger_append_is_idempotent(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "ledger")
    for i, ids in enumerate(([1, 2, 2], [2, 3])):
        _events(spark, ids).write.mode("append").parquet(source)
        for again in range(2):  # a new checkpoint reads everything once more
            S.append_to_ledger(spark.readStream.schema(EVENTS).parquet(source), path, str(tmp_path / f"c{i}{again}")).awaitTermination()
        assert S.read_ledger(spark, path).count() == 2 + i


def test_ledger_ids_are_one_over_all_days(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = cost.to_ledger(_events(spark, range(40)))
    later = rows.withColumn("ts", F.col("ts") + F.expr("interval 3 days"))
    assert S.append_batch(rows.where("input_tokens < 20"), path, "a", buckets=4).count() == 20
    # the same ids on another day are duplicates, also within a batch
    assert S.append_batch(later.union(rows), path, "b", buckets=4).count() == 20
    have = S.read_ledger(spark, path)
    assert (have.count(), have.select("id").distinct().count(), have.where("day = '2026-01-04'").count()) == (40, 40, 0)
    # a batch that is run again after it was written, in part or in whole, writes the same
    before = sorted(map(str, have.collect()))
    S.append_batch(later.union(rows), path, "b", buckets=4)
    assert sorted(map(str, S.read_ledger(spark, path).collect())) == before


def test_ledger_index_is_not_shuffled(spark, tmp_path):
    path = str(tmp_path / "ledger")
    S.append_batch(cost.to_ledger(_events(spark, range(40))), path, "a", buckets=4)
    index = S.id_index(spark, path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = cost.append_new(index, cost.to_ledger(_events(spark, range(9))))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    batch, ledger = plan[: plan.rindex("ExistingRDD")], plan[plan.rindex("ExistingRDD") :]
    assert "SortMergeJoin" in batch and "Exchange" in batch
    assert "Bucketed: true" in ledger and "Exchange" not in ledger


def test_windows_and_distinct_events(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    _events(spark, [1, 2, 2, 3]).write.parquet(source)
    one = S.distinct_events(spark.readStream.schema(EVENTS).parquet(source))
    one.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]
    assert [r["records"] for r in S.windowed_usage(_events(spark, [1, 2, 3])).collect()] == [3]


def test_outcomes_mature_once(spark):
    at = datetime.datetime(2026, 1, 1, tzinfo=datetime.timezone.utc)
    scores = spark.createDataFrame([("r", "a", at), ("r", "b", at + datetime.timedelta(days=20)), ("r", "c", at)], "repo string, merge_sha string, merged_at timestamp")
    none = spark.createDataFrame([], "repo string, merge_sha string, horizon_days int, labelled_at timestamp, survived boolean")
    labels = spark.createDataFrame([("r", "a", True), ("r", "b", False)], "repo string, merge_sha string, survived boolean")
    new = S.mature(scores, none, labels, 30, at + datetime.timedelta(days=40))
    assert {(r["merge_sha"], r["survived"]) for r in new.collect()} == {("a", True), ("c", None)}
    assert S.mature(scores, new, labels, 30, at + datetime.timedelta(days=40)).count() == 0


def test_replay_cycles_are_found(spark):
    rows = spark.createDataFrame([(1, 1, 1, 2), (1, 2, 2, 1), (1, 3, 3, None), (1, 4, 4, 3)], "task_id long, event_id long, ordinal long, replay_of long")
    assert {r["event_id"] for r in cost.replay_cycles(rows).collect()} == {1, 2}
    assert [r["event_id"] for r in cost.resolve_replays(rows).collect()] == [4]


RECORD = "task_id string, event_id string, ordinal long, harness string, session_id string, turn_id string, sequence long, model string, usage_kind string, replay_of string, input_tokens long, actual_micros long, ts timestamp"


def _record(i, task="t", event=None, ordinal=None, replay=None, tokens=1, kind="delta", sequence=None, harness="pi", minute=0):
    at = datetime.datetime(2026, 1, 1, 0, minute, tzinfo=datetime.timezone.utc)
    return (task, event or f"e{i}", ordinal if ordinal is not None else i, harness, "s", None, sequence if sequence is not None else i, "m", kind, replay, tokens, 5, at)


def _tracked(spark, home, *batches, stop_after=None, idle=None):
    """Each batch a file; with ``stop_after`` the stream ends after so many and is started again on its checkpoint."""
    for n, rows in enumerate(batches):
        T.with_defaults(spark.createDataFrame(rows, RECORD)).coalesce(1).write.mode("append").parquet(f"{home}/in")
        if stop_after is not None and n + 1 in stop_after:
            stream = spark.readStream.schema(T.with_defaults(spark.createDataFrame(rows, RECORD)).schema).option("maxFilesPerTrigger", 1).parquet(f"{home}/in")
            T.run_tracker(stream, f"{home}/out", f"{home}/c", idle).awaitTermination()
    return spark.read.parquet(f"{home}/out")


def test_tracker_goes_on_from_its_checkpoint(spark, tmp_path):
    batches = [
        [_record(1, tokens=10, kind="cumulative"), _record(2, tokens=25, kind="cumulative"), _record(3, task="u")],
        # late: it belongs between the first two; again from another harness; replays the first
        [_record(4, tokens=12, kind="cumulative", sequence=1, event="e1b"), _record(5, event="e2", harness="native"), _record(6, task="u", replay="e3", tokens=None)],
        [_record(7, tokens=30, kind="cumulative"), _record(8, replay="e2", tokens=2), _record(9, task="u", event="e9", replay="e10")],
        [_record(10, task="u", event="e10", replay="e9")],
    ]
    out = _tracked(spark, tmp_path, *batches, stop_after=(2, 4))
    last = {(r["task_id"], r["harness"]): r for r in T.latest_snapshots(out).collect()}
    # 10, then 12 and 30 in steps, and 2; the record of 25 is replayed
    assert (last["t", "pi"]["input_tokens"], last["t", "pi"]["observations"]) == (10 + 2 + 18 + 2, 4)
    assert ("t", "native") not in last
    assert last["u", "pi"]["status"] == "aggregation_failed"
    assert {(r["task_id"], r["accepted"], r["duplicate"]) for r in T.record_results(out).collect()} == {("t", 5, 1), ("u", 4, 0)}
    rows = T.with_defaults(spark.createDataFrame([x for b in batches for x in b], RECORD)).where("task_id = 't'")
    rest = T.task_cost_at_rest(rows.withColumn("turn_id", F.col("event_id"))).collect()
    assert [{c: r[c] for c in r.__fields__} for r in rest] == [{c: last["t", "pi"][c] for c in rest[0].__fields__}]


def test_tracker_fills_in_ids_and_sequences(spark, tmp_path):
    none = [(None if c in ("event_id", "sequence") else x) for c, x in zip([f.split()[0] for f in RECORD.split(", ")], _record(1), strict=True)]
    out = _tracked(spark, tmp_path, [_record(0, event="t.e1"), tuple(none), (*none[:2], 5, *none[3:])], stop_after=(1,))
    assert sorted((r["event_id"], r["sequence"], r["status"]) for r in out.where("kind = 'result'").collect()) == [("t.e1", 0, "accepted"), ("t.e2", 1, "accepted"), ("t.e3", 2, "accepted")]


def test_tracker_rejects_and_closes(spark, tmp_path):
    rows = [_record(1, tokens=-1), _record(2, harness="unheard"), _record(3)]
    out = _tracked(spark, tmp_path, rows, [_record(4, task="v", minute=50)], [_record(5, task="v", minute=51)], stop_after=(3,), idle="10 minutes")
    assert [(r["task_id"], r["observations"]) for r in out.where("kind = 'closed'").collect()] == [("t", 1)]
    assert {r["event_id"]: r["reason"] is None for r in out.where("kind = 'result'").collect()} == {"e1": False, "e2": False, "e3": True, "e4": True, "e5": True}
