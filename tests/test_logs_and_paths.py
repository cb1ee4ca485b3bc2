"""Sessions, ledgers, attempt logs, sinks, forward survival and candidate detection on small fixtures against plain Python or stated results."""

from __future__ import annotations

import datetime
import gzip
import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import exprs as X
from quillon.functions.canonical import canonical_json
from quillon.operators import attempts, citations, cost, evidence, features, forward, population, pricing
from quillon.plans import cost_queries
from quillon.sinks import files
from quillon.sources import lines as L
from quillon.sources import sessions

UTC = datetime.timezone.utc
AT = datetime.datetime(2026, 1, 1, tzinfo=UTC)


def line(kind, payload, minute=0):
    return json.dumps({"type": kind, "timestamp": (AT + datetime.timedelta(minutes=minute)).isoformat().replace("+00:00", "Z"), "payload": payload})


def counts(delta=None, total=None):
    one = lambda x: None if x is None else {"input_tokens": x[0], "output_tokens": x[1], "cached_input_tokens": x[2], "cache_write_input_tokens": 0, "reasoning_output_tokens": 0}
    return {"type": "token_count", "info": {"last_token_usage": one(delta), "total_token_usage": one(total)}}


def test_rollouts_carry_their_state(spark, tmp_path):
    rows = [
        line("session_meta", {"id": "s1", "cli_version": "1.0"}), line("turn_context", {"turn_id": "t1", "model": "m1"}), line("event_msg", counts(total=(10, 1, 4)), 1), line("event_msg", counts(total=(30, 3, 6)), 2),
        line("turn_context", {"model": None}), line("event_msg", {"type": "thread_settings_applied", "thread_settings": {"service_tier": "flex"}}), line("event_msg", counts(total=(5, 1, 9)), 3), line("event_msg", counts(delta=(7, 2, 0), total=(12, 3, 9)), 4),
        line("event_msg", {"type": "token_count", "info": None}, 5), line("event_msg", counts(delta=(-1, 2, 0)), 6), "{broken", line("event_msg", counts(delta=(1, 1, 0)), 600),
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(rows) + "\n")
    seen = sessions.rollout_observations(sessions.numbered_lines(spark, str(tmp_path)))
    told = [(r["turn_id"], r["model"], r["service_tier"], r["state"], r["session_id"]) for r in seen.orderBy("line_no").collect()]
    assert told == [("t1", "m1", None, "ok", "s1")] * 2 + [(None, "m1", "flex", "ok", "s1")] * 2 + [(None, "m1", "flex", "missing_usage", "s1"), (None, "m1", "flex", "invalid_usage_value", "s1"), (None, "m1", "flex", "ok", "s1")]
    used = sessions.rollout_usage(seen, ["s1"], AT, AT + datetime.timedelta(hours=1)).collect()
    found = {r["event_id"]: (r["input_tokens"], r["output_tokens"], r["cache_read_tokens"], r["counter_reset"], r["unpriced"], r["reason"]) for r in used}
    assert found == {
        "t1": (6, 1, 4, False, False, None), "t1.2": (18, 2, 2, False, False, None), "s1.tc1": (0, 1, 9, True, True, None), "s1.tc2": (7, 2, 0, False, True, None), "s1.tc3": (None, 2, 0, False, True, None), "s1.tc4": (1, 1, 0, False, True, "outside_time_window"),
    }


def test_lines_beyond_a_limit_are_told(spark, tmp_path):
    (tmp_path / "a").write_text('{"a": 1}\n\n{"b": 2}\n{"c": 3}\n')
    (tmp_path / "b").write_text("x" * 100)
    found = sessions.numbered_lines(spark, str(tmp_path), most=3, largest=50).collect()
    assert sorted((r["line_no"], r["state"]) for r in found) == [(0, "oversized_file"), (1, "ok"), (3, "ok"), (4, "truncated_input")]


def test_records_say_why_they_are_dropped(spark):
    rows = [("e1", "t", "s", "2026-01-01T00:30:00Z", "secret"), ("", "t", "s", "2026-01-01T00:30:00Z", "x"), ("e3", "u", "s", "2026-01-01T00:30:00Z", "x"), ("e4", "t", "z", "2026-01-01T00:30:00Z", "x"), ("e5", "t", "s", "soon", "x"), ("e6", "t", "s", "2026-01-01T02:00:00Z", "x"), ("e7", "t", "s", "2026-01-01T01:00:00Z", "x")]
    frame = spark.createDataFrame(rows, "event_id string, task_id string, session_id string, observed_at string, note string")
    out = sessions.record_usage(frame, "t", ["s"], AT, AT + datetime.timedelta(hours=1), ["event_id", "session_id"])
    assert out.columns == ["event_id", "session_id", "reason"]
    assert [r["reason"] for r in out.collect()] == [None, "invalid_record", "foreign_task", "session_not_in_boundary", "missing_timestamp", "outside_time_window", None]
    assert sessions.boundary_errors("t", ["s"], 1, 2) == [] and sessions.boundary_errors("t t", [], 2, 1, 3) == ["boundary_version", "task_id", "session_ids", "window"]


def test_transcript_totals_and_aider(spark, tmp_path):
    rows = [json.dumps({"timestamp": "2026-01-01T00:00:00Z", "message": {"usage": {"input_tokens": 5}}}), json.dumps({"timestamp": "2026-01-01T01:00:00Z", "usage": {"input_tokens": 7, "output_tokens": -3, "cache_read_input_tokens": 2}}), json.dumps({"timestamp": "2026-01-01T02:00:00Z", "usage": {"input_tokens": 0}}), "{torn"]
    (tmp_path / "a").write_text("\n".join(rows))
    lines = sessions.numbered_lines(spark, str(tmp_path))
    assert [tuple(r)[1:] for r in sessions.transcript_totals(lines, AT).collect()] == [(7, 0, 0, 2, 1)]
    assert [tuple(r)[1:] for r in sessions.transcript_totals(lines).collect()] == [(12, 0, 0, 2, 2)]
    out = spark.createDataFrame([("f", i, v) for i, v in enumerate(["Model: m1", "Tokens: 1k sent, 2 received. Cost: $0.1 message, $0.2 session.", "Model: m2 with x", "Tokens: 3 sent, 4 received.", "Cost: $0.1 message, $0.5 session."])], "file string, line_no int, value string")
    r = sessions.aider_summary(out).first()
    assert (r["model"], r["input_tokens"], r["output_tokens"], r["session_cost_usd"]) == ("m2", 1003, 6, 0.5)


def test_name_status_sheets_and_pins(spark, tmp_path):
    rows = spark.createDataFrame([(1, "M\ta.c"), (1, "R100\told.c\tnew.c"), (1, ""), (1, "C85\ta\tb"), (1, "D\t")], "diff int, value string")
    assert [tuple(r) for r in sessions.name_status(rows).collect()] == [(1, "M", "a.c", None), (1, "R", "new.c", "old.c"), (1, "C", "b", "a")]
    (tmp_path / "s.csv").write_text('item_id,notes\n1,"a, ""b""\nc"\n," "\n2,\n')
    assert [tuple(r) for r in sessions.read_sheet(spark, str(tmp_path / "s.csv")).collect()] == [("1", 'a, "b"\nc'), ("2", None)]
    two = gzip.compress(b'{"a": 1}\n') + gzip.compress(b'{"a": 2}\n[3]\n')
    (tmp_path / "x.jsonl.gz").write_bytes(two)
    assert sorted(r["state"] for r in sessions.read_gzip_lines(spark, str(tmp_path / "x.jsonl.gz")).collect()) == ["malformed_line", "ok", "ok"]
    pins = spark.createDataFrame([("x.jsonl.gz", hashlib.sha256(two).hexdigest()), ("s.csv", "0"), ("gone", "0")], "file string, sha256 string")
    assert {r["file"]: r["ok"] for r in sessions.pinned(spark, str(tmp_path / "*"), pins).collect()} == {"x.jsonl.gz": True, "s.csv": False, "gone": False}
    lines = L.with_state(spark.createDataFrame([("f", '{"n": 1}'), ("f", '{"n": -1}'), ("f", "x")], "file string, value string"))
    assert [r["broken"] for r in sessions.validated(lines, "n long", {"positive": F.col("r.n") > 0}).collect()] == [[], ["positive"], ["malformed"]]


def test_ledger_lines_are_checked(spark):
    events = spark.createDataFrame([(f"e{i}", "t", AT, "m", "codex", "b", "none", i, 1, 0, 0, i, None) for i in range(3)], "event_id string, task_id string, ts timestamp, model string, harness string, backend string, source string, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long, actual_micros long, estimated_micros long")
    rows = cost.to_ledger(events)
    signed = {k: F.unix_millis("ts") if c == "ts" else F.col(c) for k, c in cost.SIGNED.items()}
    good = [r[0] for r in rows.select(cost.ledger_json(signed | {"c": F.col("c")})).collect()]
    one = json.loads(good[0])
    plain = json.dumps({k: v for k, v in one.items() if k != "c"}, sort_keys=True, separators=(",", ":"))
    assert one["c"] == hashlib.sha256(plain.encode()).hexdigest()[:16] and one["id"] == hashlib.sha256(b'["t","none","e0"]').hexdigest()[:32]
    bad = [json.dumps({**one, "model": "other"}), json.dumps({**one, "extra": 1}), json.dumps({**one, "v": 2}), "{torn", json.dumps({**one, "inputTokens": -1})]
    lines = spark.createDataFrame([("f", i, v) for i, v in enumerate([*good, good[0], *bad])], "file string, line_no int, value string")
    found = [(r["state"], r["reason"]) for r in L.ledger_lines(lines, "line_no").collect()]
    assert sorted(found, key=str) == sorted([("ok", None)] * 3 + [("duplicate", None), ("corrupt", "checksum"), ("corrupt", "invalid_record"), ("unsupported_version", "unsupported_version"), ("corrupt", "malformed"), ("corrupt", "invalid_record")], key=str)
    assert L.ledger_within_limits(lines).collect()[0]["records"] == 9
    with pytest.raises(Exception, match="too large"):
        L.ledger_within_limits(lines, most=3).collect()


def test_migrations_go_step_by_step(spark):
    frame = spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "v int, n int")
    steps = {1: lambda r: r.withField("n", r["n"] + 10), 2: lambda r: r.withField("n", r["n"] * 2)}
    out = frame.select(cost.migrated(F.struct("v", "n"), F.col("v"), 3, steps).alias("r")).select("r.*").collect()
    assert [tuple(r) for r in out] == [(3, 30), (3, 10), (3, 5)]
    assert [r[0] for r in frame.select(cost.migrated(F.struct("v", "n"), F.col("v"), 3, {2: steps[2]})["n"]).collect()] == [None, 10, 5]


FIELDS = "task_id ordinal record_type key kind parent_id slot retry_of run_id stage_id outcome evidence_kind version supersedes inputs".split()
LOG = "task_id string, ordinal long, record_type string, key string, kind string, parent_id string, slot string, retry_of string, run_id string, stage_id string, outcome string, evidence_kind string, version long, supersedes string, inputs array<struct<attempt: string, evidence_kind: string, version: long>>"


def test_attempt_log(spark):
    def row(i, record, key, **more):
        cells = {"task_id": "T", "ordinal": i, "record_type": record, "key": key} | more
        return tuple(cells.get(n) for n in FIELDS)

    rows = [
        row(0, "attempt", "r1", kind="run", parent_id="T"), row(1, "attempt", "a", kind="stage_attempt", parent_id="r1", slot="plan"), row(2, "attempt", "a", kind="stage_attempt", parent_id="r1", slot="plan"), row(3, "attempt", "x", kind="arm", parent_id="r1"),
        row(4, "control", "w1", run_id="r1", stage_id="a", outcome="failed"), row(5, "control", "w1", run_id="r1"), row(6, "control", "w2", run_id="r1", stage_id="a", outcome="succeeded"), row(7, "attempt", "b", kind="stage_attempt", parent_id="r1", slot="plan", retry_of="a"),
        row(8, "control", "w3", run_id="r1", stage_id="a"), row(9, "evidence", "e1", run_id="r1", evidence_kind="diff", version=2), row(10, "evidence", "e2", run_id="r1", evidence_kind="diff", version=1), row(11, "evidence", "e3", run_id="zz", evidence_kind="diff", version=1),
        row(12, "derived", "d1", inputs=[("r1", "diff", 1)]), row(13, "derived", "d2", inputs=[("r1", "diff", 2)]), row(14, "derived", "d3", supersedes="d2", inputs=[]), row(15, "attempt", "r2", kind="run", parent_id="T"), row(16, "control", "w4", run_id="r1"), row(17, "control", "w5", run_id="nobody"), row(18, "derived", "d1", inputs=[]),
    ]
    log = spark.createDataFrame(rows, LOG)
    found = {r["ordinal"]: (r["decision"], list(r["reasons"])) for r in attempts.decisions(log).collect()}
    wanted = {2: "id_reused", 3: "parent_mismatch", 6: "settled", 8: "stale_stage_attempt", 16: "stale_run", 17: "unknown_attempt"}
    for i in range(19):
        if i in wanted:
            assert found[i] == ("rejected", [wanted[i]]), i
    assert found[5][0] == found[18][0] == "duplicate" and found[10] == ("accepted", ["evidence_version_not_newer"]) and found[11] == ("accepted", ["undeclared_attempt"])
    state = {r["key"]: (r["current"], r["outcome"]) for r in attempts.attempts(log).collect()}
    assert state == {"r1": (False, None), "a": (False, "failed"), "b": (False, None), "r2": (True, None)}
    assert {r["key"]: r["status"] for r in attempts.derived_status(log).collect()} == {"d1": "stale", "d2": "superseded", "d3": "current"}


def test_forward_survival_matches_plain_python(spark):
    rng = np.random.default_rng(6)
    hunks, later, moves, blobs, wanted = [], [], [], [], {}
    for pr in range(25):
        n, alive, touched, all_back = 0, 0, False, True
        for f in range(int(rng.integers(1, 4))):
            path, fate, back = f"p{f}", str(rng.choice(["stay", "gone", "moved"])), bool(rng.random() < 0.3)
            back = back and fate != "gone"
            terminal = {"stay": path, "gone": None, "moved": "m/" + path}[fate]
            if fate != "stay":
                moves.append((pr, "D" if fate == "gone" else "R", path if fate == "gone" else terminal, None if fate == "gone" else path))
            blobs += [(pr, "parent", path, "old"), (pr, "merge", path, "new")]
            if terminal:
                blobs.append((pr, "terminal", terminal, "old" if back else "other"))
            over = [(int(a), int(a + b)) for a, b in zip(rng.integers(1, 60, 2), rng.integers(0, 9, 2), strict=True)]
            later += [(pr, path, a, z) for a, z in over]
            all_back = all_back and back
            for h in range(int(rng.integers(1, 3))):
                a, b = int(rng.integers(1, 30)) + 30 * h, int(rng.integers(0, 8))
                if rng.random() < 0.3:
                    hunks.append((pr, path, path, a, a + b, None, None))
                    gone = b + 1 if back else 0
                else:
                    hunks.append((pr, path, path, None, None, a, a + b))
                    gone = b + 1 if fate == "gone" else sum(max(0, min(a + b, z) - max(a, s) + 1) for s, z in over)
                n, alive, touched = n + b + 1, alive + b + 1 - gone, touched or gone > 0
        wanted[pr] = (n, alive, all_back, touched)
    out = forward.forward(
        spark.createDataFrame(hunks, "pr int, path string, old_path string, old_start long, old_end long, new_start long, new_end long"), spark.createDataFrame(later, "pr int, path string, old_start long, old_end long"),
        spark.createDataFrame(moves, "pr int, status string, path string, previous_path string"), spark.createDataFrame(blobs, "pr int, side string, path string, blob string"),
    )
    assert {r["pr"]: (r["lines"], r["surviving"], r["reverted"], r["range_followup"]) for r in out.collect()} == wanted


def test_candidates_from_texts(spark):
    day = lambda n: AT + datetime.timedelta(days=n)
    originals = spark.createDataFrame([("o/r", 1, "Add cache", day(0)), ("o/r", 2, "Add parser", day(1)), ("o/r", 3, 'Revert "x"', day(1)), ("o/r", 4, "Other", day(2))], "repo string, pr long, title string, merged_at timestamp")
    owners = spark.createDataFrame([("o/r", "abcdef1" + "0" * 33, 1), ("o/r", "fedcba9" + "0" * 33, 2)], "repo string, sha string, pr long")
    rows = [
        ("o/r", "f1", 11, 'Revert "Add cache (#1)"', "This reverts commit abcdef1.\ndue to failing tests", [], "ann", [], day(3)), ("o/r", "f2", 12, "Fix parser", "crash introduced by #2", [], "ann", [70], day(4)), ("o/r", "f3", 13, "Revert x", "Reverts o/r#3", [], "ann", [], day(5)),
        ("o/r", "f4", 14, "Tidy", "see #2 and #1", [], "ann", [71], day(5)), ("o/r", "f5", 15, "fix: y", "", [], "dependabot[bot]", [72], day(6)), ("o/r", "f6", 2, "Fix", "broken by #2", [], "ann", [], day(7)), ("o/r", "f7", 17, "Fix", "broken since #4", [], "ann", [], day(90)), ("o/r", "f8", 18, 'Revert "Add parser (#2)"', "", [], "ann", [], day(6)),
    ]
    events = spark.createDataFrame(rows, "repo string, event string, pr long, title string, body string, labels array<string>, author_login string, closing_issues array<long>, fixed_at timestamp")
    issues = spark.createDataFrame([("o/r", 70, None, ["regression"]), ("o/r", 71, None, []), ("o/r", 72, "Bug", [])], "repo string, issue long, type string, labels array<string>")
    cited = spark.createDataFrame([("o/r", 70, 2, day(2)), ("o/r", 71, 1, day(1)), ("o/r", 72, 4, day(3)), ("o/r", 70, 4, day(1))], "repo string, issue long, pr long, cited_at timestamp")
    blamed = spark.createDataFrame([("f5", 1, 7, False), ("f4", 2, 3, False)], "event string, pr long, lines long, too_large boolean")
    found = {(r["fix"], r["pr"], r["proxy"]): (r["exclusion"], list(r["evidence"])) for r in citations.detect_candidates(events, originals, owners, issues, cited, blamed).collect()}
    assert set(found) == {("f1", 1, "revert"), ("f2", 2, "repair_reference"), ("f2", 2, "regression_issue"), ("f3", 3, "revert"), ("f5", 4, "repair_reference"), ("f5", 1, "szz"), ("f8", 2, "revert")}
    assert found["f1", 1, "revert"][0] is None and found["f3", 3, "revert"][0] == "revert_of_revert" and found["f5", 4, "repair_reference"][0] == "dependency_bot"
    assert found["f2", 2, "repair_reference"][1] == ["cites_original_pr 2", "closes_issue_citing_original 70"]


def test_sinks(spark, tmp_path):
    frame = spark.createDataFrame([(2, None, [("b", 1)]), (1, "x", [])], "n int, a string, z array<struct<q: string, b: int>>")
    files.write_lines(frame, str(tmp_path / "l"), ["n"], gzip=True)
    assert [r["value"] for r in spark.read.text(str(tmp_path / "l")).collect()] == ['{"a":"x","n":1,"z":[]}', '{"a":null,"n":2,"z":[{"b":1,"q":"b"}]}']
    with pytest.raises(ValueError, match="valid"):
        files.append_lines(frame, str(tmp_path / "m"), F.col("a").isNotNull())
    assert not (tmp_path / "m").exists()
    files.append_lines(frame, str(tmp_path / "m"), F.col("n") > 0)
    files.append_lines(frame, str(tmp_path / "m"), F.col("n") > 0)
    assert spark.read.text(str(tmp_path / "m")).count() == 4
    assert files.markdown_table(frame.select("n", "a").orderBy("n")) == "| n | a |\n| --- | --- |\n| 1 | x |\n| 2 |  |\n"
    assert files.run_manifest({"a": 1}, [{"path": "x"}])["run_id"] == files.run_manifest({"a": 1}, [])["run_id"] != files.run_manifest({"a": 2}, [])["run_id"]
    items = spark.createDataFrame([("i1", "u1"), ("i2", "u2")], "item_id string, pr_url string")
    sheet = files.label_sheet(items, spark.createDataFrame([("i1", "f2"), ("i1", "f1"), ("i1", "f1")], "item_id string, fix_url string"), spark.createDataFrame([("i2", "r")], "item_id string, related_url string"))
    files.write_sheet(sheet, str(tmp_path / "s"))
    back = {r["item_id"]: (r["candidate_fixes"], r["related_prs"]) for r in sessions.read_sheet(spark, str(tmp_path / "s")).collect()}
    assert back == {"i1": ("f1 f2", None), "i2": (None, "r")}
    files.write_state(frame.select("n"), str(tmp_path / "st"), {"version": "1"}, "abc")
    state = spark.read.parquet(str(tmp_path / "st/header"))
    seen = spark.createDataFrame([("abc",)], "sha string")
    assert sessions.unchanged_state(state, {"version": "1"}, seen) and not sessions.unchanged_state(state, {"version": "2"}, seen) and not sessions.unchanged_state(state, {"version": "1"}, seen.limit(0))
    with pytest.raises(ValueError, match="forbidden"):
        files.report_payload(frame, ["q"])


def test_samples_gold_rows_and_shuffles(spark):
    rows = [{"item_id": f"i{i}"} for i in range(5)]
    mixed = population.with_gold_rows(rows, [{"item_id": "g1"}, {"item_id": "g2"}], "seed")
    assert len(mixed) == 7 and [r for r in mixed if r["item_id"].startswith("i")] == rows
    with pytest.raises(ValueError, match="already"):
        population.with_gold_rows(rows, [{"item_id": "i1"}], "seed")
    rest, gold = population.split_gold(spark.createDataFrame(mixed), spark.createDataFrame([("g1",)], "item_id string"))
    assert rest.count() == 6 and [r["item_id"] for r in gold.collect()] == ["g1"]
    frame = spark.createDataFrame([("a", i) for i in range(8)], "g string, n int")
    order = [r["n"] for r in population.shuffled(frame, "s", "l", "g", "n").orderBy("place").collect()]
    items, counter = list(range(8)), 0
    for i in range(7, 0, -1):
        j = int(int.from_bytes(hashlib.sha256(f"s:l:{counter}".encode()).digest()[:4], "big") / 2**32 * (i + 1))
        items[i], items[j], counter = items[j], items[i], counter + 1
    assert order == items
    units = spark.createDataFrame([(str(i), "x") for i in range(40)], "item_id string, stratum string")
    first = population.audited(units, "s", {"x": 0.1})
    more = population.extended_audit(first, "s", {"x": 0.3})
    assert first.where("audit").count() == 4 and more.where("audit").count() == 12
    with pytest.raises(Exception, match="would drop"):
        population.extended_audit(more, "s", {"x": 0.1}).collect()


def test_features_are_declared_and_dated(spark):
    assert features.column_errors(["a.x", "a.x", "b.y", "a.survived"], ["a.x", "a.z"], ["a"]) == [("a.x", "duplicate"), ("b.y", "namespace"), ("b.y", "undeclared"), ("a.survived", "leaks"), ("a.survived", "undeclared"), ("a.z", "missing")]
    rows = spark.createDataFrame([(1, AT, AT), (1, AT + datetime.timedelta(1), AT), (1, None, AT)], "pr int, at timestamp, as_of timestamp")
    assert [tuple(r) for r in features.late_evidence(rows).collect()] == [(1, 1, 1)]
    one = spark.createDataFrame([(1, 2.0)], "pr long, f double")
    assert [tuple(r) for r in evidence.feature_rows({"a": one}, ["g", "f"]).collect()] == [(1, None, 2.0)]
    with pytest.raises(ValueError, match="not declared"):
        evidence.feature_rows({"a": one}, ["g"])
    assert evidence.manifest_errors([{"name": "a.x", "category": "c", "as_of_source": "git"}, {"name": "a.x", "category": "d"}], ["a"], ["c"], "1", "1") == [("a.x", "duplicate"), ("a.x", "category"), ("a.x", "as_of_source")]
    code = spark.createDataFrame([(1, "a.py", "M", "if x: pass", "if x:\n  for y in z: pass"), (1, "b.md", "M", None, None), (2, "c.ts", "M", None, "x"), (3, "n.go", "A", None, "if a {}")], "pr int, path string, status string, old_source string, new_source string")
    assert {r["pr"]: r["complexity_delta"] for r in evidence.complexity_delta(code).collect()} == {1: 1, 2: None, 3: 2}
    base = spark.createDataFrame([(1, AT, [1]), (2, AT, [2])], "pr int, captured_at timestamp, reviews array<int>")
    laid = spark.createDataFrame([(1, AT - datetime.timedelta(1), [9])], "pr int, captured_at timestamp, reviews array<int>")
    assert {r["pr"]: (r["reviews"], r["captured_at"]) for r in evidence.with_timelines(base, laid, ["reviews"]).collect()} == {1: ([9], (AT - datetime.timedelta(1)).replace(tzinfo=None)), 2: (None, None)}


def test_overrides_are_checked(spark):
    schema = "model string, input_rate double, output_rate double, write_multiplier double, read_multiplier double, price_table string, as_of string"
    for rows, said in (([("a", 1.0, 1.0, None, None, None, None), ("openai/A", 1.0, 1.0, None, None, None, None)], "duplicate"), ([("a", -1.0, 1.0, None, None, None, None)], "input_rate"), ([(" ", 1.0, 1.0, None, None, None, None)], "bad model")):
        with pytest.raises(Exception, match=said):
            pricing.override_index(spark.createDataFrame(rows, schema)).collect()
    lines = {r["model"]: (r["line"], r["hash"]) for r in pricing.price_export(cost_queries._prices(spark)).collect()}
    assert all(hashlib.sha256(text.encode()).hexdigest() == h for text, h in lines.values()) and json.loads(lines["alpha"][0])["input_rate"] == 3.0


def test_streams_count_and_scan_again(spark):
    from quillon.streaming import ledger as S

    scores = spark.createDataFrame([("r", x, AT + datetime.timedelta(days=d)) for x, d in (("a", 0), ("b", 0), ("c", 0), ("d", 30))], "repo string, merge_sha string, merged_at timestamp")
    outcomes = spark.createDataFrame([("r", "a", 30)], "repo string, merge_sha string, horizon_days int")
    labels = spark.createDataFrame([("r", "b", True)], "repo string, merge_sha string, survived boolean")
    assert tuple(S.maturation_counts(scores, outcomes, labels, 30, AT + datetime.timedelta(days=40)).first()) == (1, 2, 1, 1)
    changes = spark.createDataFrame([(i, 0) for i in range(12)], "pr int, merged_at long")
    cached = spark.createDataFrame([(0, 14, "old"), (1, 60, "young")], "pr int, horizon_days int, label string")
    fresh = spark.createDataFrame([(0, 14, "new"), (1, 60, "new")] + [(i, 14, "new") for i in range(2, 12)], "pr int, horizon_days int, label string")
    found = {(r["pr"], r["horizon_days"]): r["label"] for r in S.scan_again(cached, fresh, changes, 20 * 86_400).collect()}
    assert found[0, 14] == "old" and found[1, 60] == "new" and len(found) == 12
    with pytest.raises(Exception, match="tenth"):
        S.scan_again(cached, fresh.withColumn("label", F.when(F.col("pr") > 8, None).otherwise(F.col("label"))), changes, 20 * 86_400).collect()


def test_canonical_json_sorts_at_every_depth(spark):
    frame = spark.range(1).select(F.struct(F.lit(1).alias("z"), F.struct(F.lit(2).alias("y"), F.lit(None).cast("string").alias("b")).alias("a")).alias("v"), F.lit("k").alias("c"))
    assert frame.select(canonical_json(frame)).first()[0] == '{"c":"k","v":{"a":{"b":null,"y":2},"z":1}}'
    labels = spark.createDataFrame([(1, "u", "s", "kept")], "pr int, pr_url string, merge_sha string, outcome string")
    assert forward.project_label(labels).columns == ["pr", "outcome", "label_hash"]


def test_scorers_of_the_caller(spark):
    from quillon.operators import shadow

    frame = spark.createDataFrame([(1, 2.0, 3.0), (2, 0.1, 0.1)], "pr int, a double, b double")
    out = shadow.score_with(frame, "own", "1", lambda f: f["a"] * f["b"], ["a", "b"], 1.0)
    assert {r["pr"]: (round(r["score"], 6), r["would_flag"], r["scorer_id"]) for r in out.collect()} == {1: (6.0, False, "own"), 2: (0.01, True, "own")}


def test_query_bounds_are_checked(spark):
    ledger = cost.to_ledger(spark.createDataFrame([("e", "t", AT, "m", "codex", "b", "none", 1, 1, 0, 0, 1, None)], "event_id string, task_id string, ts timestamp, model string, harness string, backend string, source string, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long, actual_micros long, estimated_micros long"))
    for keys, start, end in ((["model", "model"], None, None), (["task_id"], None, None), ([], None, None), (["model"], AT, AT)):
        with pytest.raises(ValueError):
            cost.ledger_query(ledger, keys, start=start, end=end)
    assert cost.ledger_query(ledger, ["model"], start=AT, end=AT + datetime.timedelta(1)).count() == 2
    assert spark.range(1).select(X.round_usd(F.lit(0.1234567895))).first()[0] == 0.12345679
