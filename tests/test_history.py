"""Histories as tables against plain walks over random ones: prefix scans, lines, what holds what, windows, and which change a commit landed."""

from __future__ import annotations

import random

import pytest

from quillon.operators import features, history
from quillon.operators.scans import prefix_scan


def test_prefix_scans_over_many_blocks(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.choice([None, rng.randrange(100)])) for k in ("a", "b", None) for i in range(400 if k == "a" else 7)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "k string, i int, x long").repartition(3)
    for own in (True, False):
        found = prefix_scan(frame, ["k"], ["i"], {"least": ("min", "x"), "most": ("max", "x"), "total": ("sum", "x"), "known": ("last", "x")}, own).collect()
        assert len(found) == len(rows)
        for r in found:
            before = [x for k, i, x in sorted(rows, key=lambda t: t[1]) if k == r["k"] and (i < r["i"] or own and i == r["i"]) and x is not None]
            assert (r["least"], r["most"], r["total"], r["known"]) == ((min(before), max(before), sum(before), before[-1]) if before else (None,) * 4)
    assert prefix_scan(frame.limit(0), ["k"], ["i"], {"n": ("sum", "x")}).count() == 0


def _random_history(rng, n):
    """Commits by number, parents of lower numbers, several of them; the first parent is near."""
    commits = {}
    for i in range(n):
        first = [] if i == 0 or rng.random() < 0.02 else [max(0, i - rng.choice([1, 1, 1, 2, 4]))]
        more = [rng.randrange(i)] if i > 2 and first and rng.random() < 0.25 else []
        commits[i] = first + [p for p in more if p not in first]
    return commits


def _held(commits, head):
    seen, stack = set(), [head]
    while stack:
        c = stack.pop()
        if c not in seen:
            seen.add(c)
            stack += commits.get(c, [])
    return seen


def _frame(spark, commits):
    return spark.createDataFrame([("r", f"c{i}", [f"c{p}" for p in ps]) for i, ps in commits.items()], "repo string, sha string, parents array<string>")


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_and_ancestors_of_random_histories(spark, seed):
    rng = random.Random(seed)
    commits = _random_history(rng, 90)
    frame = _frame(spark, commits)
    tip = 89
    line, at = [], tip
    while at is not None:
        line.append(at)
        at = commits[at][0] if commits[at] else None
    line.reverse()
    found = history.first_parent_line(frame, spark.createDataFrame([("r", f"c{tip}"), ("none", "c1")], "repo string, sha string"))
    assert {r["sha"]: r["position"] for r in found.collect()} == {f"c{c}": p for p, c in enumerate(line)}
    index = history.landing_index(frame, found)
    holds = {c: _held(commits, c) for c in commits}
    for r in index.collect():
        c = int(r["sha"][1:])
        landing = next((p for p, x in enumerate(line) if c in holds[x]), None)
        base = max((p for p, x in enumerate(line) if x in holds[c]), default=None)
        assert (r["landing"], r["base"]) == (landing, base)
    pairs = [("r", f"c{rng.randrange(92)}", f"c{rng.randrange(92)}", k) for k in range(400)]
    told = history.is_ancestor(spark.createDataFrame(pairs, "repo string, sha string, head string, k int"), index, frame).collect()
    assert len(told) == len(pairs)
    for r in told:
        a, h = int(r["sha"][1:]), int(r["head"][1:])
        assert r["held"] == (a in commits and h in commits and a in holds[h])


def test_history_knows_its_ancestors(spark):
    commits = spark.createDataFrame([("r", "d", ["c", "x"]), ("r", "c", ["b"]), ("r", "b", ["a"]), ("r", "a", []), ("r", "x", []), ("r", "z", ["y"]), ("r", "y", [])], "repo string, sha string, parents array<string>")
    line = history.first_parent_line(commits, spark.createDataFrame([("r", "d")], "repo string, sha string"))
    pairs = spark.createDataFrame([("r", c, "d") for c in "abcdxyz"], "repo string, sha string, head string")
    on = history.is_ancestor(pairs, history.landing_index(commits, line), commits)
    assert {r["sha"] for r in on.where("held").collect()} == set("abcdx")
    assert {r["sha"]: r["position"] for r in history.landing_positions(line, spark.createDataFrame([("d", "c"), ("c", "b"), ("b", "a"), ("d", "x"), ("z", "y")], "sha string, parent string")).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3, "x": 3}


def test_windows_keep_the_newest_and_reset_lost_cursors(spark):
    commits = spark.createDataFrame([("r", f"c{i}", [f"c{i - 1}"] if i else [], 100 + i, "s") for i in range(10)] + [("r", "s", ["c4"], 0, "s"), ("r", "gone", ["c2"], 0, "s")], "repo string, sha string, parents array<string>, ct long, subject string")
    commits = commits.union(spark.createDataFrame([("r", "m", ["c9", "s"], 120, "s")], commits.schema))
    line = history.first_parent_line(commits, spark.createDataFrame([("r", "m")], "repo string, sha string"))
    index = history.landing_index(commits, line)

    def window(cursor, most=None, since=0, until=999):
        asked = spark.createDataFrame([("r", since, until, cursor, most)], "repo string, since long, until long, cursor string, most long")
        rows = history.merge_window(commits, line, index, asked).orderBy("position").collect()
        return [r["merge_sha"] for r in rows], {r["cursor_reset"] for r in rows}

    assert window("c7") == (["c8", "c9", "m"], {False})
    assert window("s") == (["c5", "c6", "c7", "c8", "c9", "m"], {False})
    assert window("gone", most=2) == (["c9", "m"], {True}) and window("unheard", most=1) == (["m"], {True})
    assert window(None, since=103, until=105) == (["c3", "c4", "c5"], {False}) and window(None, most=0) == ([], set())
    with pytest.raises(ValueError, match="before"):
        window(None, since=2, until=1)


def _mapped(line, changes, rollups):
    """The mapping as one loop over the line: (sha, parents, numbers) of each commit, oldest first."""
    records, used, mapped, by_pr = {}, set(), set(), {c[0]: c for c in changes}
    for i, (sha, parents, numbers) in enumerate(line):
        via = [pr for pr, merge, _ in changes if merge == sha]
        candidates = list(dict.fromkeys(via + [n for n in numbers if n in by_pr]))
        if sha in rollups:
            mapped.add(sha)
            used.update(candidates)
            for member, pr in rollups[sha]:
                if pr in by_pr and pr not in used:
                    used.add(pr)
                    records[pr] = [member, 1, "rollup", False, []]
            continue
        new = [pr for pr in candidates if pr not in used]
        if not new:
            for pr in (again := [pr for pr in candidates if pr in records]):
                records[pr][4].append(sha)
            if again:
                mapped.add(sha)
            continue
        mapped.add(sha)
        for pr in new:
            used.add(pr)
            first = i
            if len(new) == 1 and len(parents) < 2 and pr in via:
                while i - first + 1 < by_pr[pr][2] and first and line[first - 1][0] not in mapped and not line[first - 1][2]:
                    first -= 1
                    mapped.add(line[first][0])
            n = i - first + 1
            records[pr] = [sha, n, "number_ref" if pr not in via else "merge_commit" if len(parents) > 1 else "rebase" if n > 1 else "squash", len(new) > 1, []]
    return records, mapped


@pytest.mark.parametrize("seed", range(2))
def test_mapping_of_random_lines(spark, seed):
    rng = random.Random(seed)
    n, members = 60, 0
    rows, line, rollups = [], [], {}
    for i in range(n):
        numbers = rng.choice([[], [], [], [rng.randrange(1, 30)], [rng.randrange(1, 30), rng.randrange(30, 40)]])
        subject = "Merge " + " ".join(f"#{x}" for x in numbers) if len(numbers) > 1 else f"Fix (#{numbers[0]})" if numbers else "none"
        parents = [f"c{i - 1}"] if i else []
        if i > 3 and rng.random() < 0.3:
            before, chain = parents[0], []
            for _ in range(rng.randrange(3)):
                pr = rng.randrange(1, 45)
                rows.append(("r", f"m{members}", [before], f"Rollup merge of #{pr} - a:b", ""))
                chain.append((f"m{members}", pr))
                before, members = f"m{members}", members + 1
            parents.append(before if chain else "elsewhere")
            if chain:
                rollups[f"c{i}"] = chain
        rows.append(("r", f"c{i}", parents, subject, ""))
        line.append((f"c{i}", parents, list(dict.fromkeys(numbers))))
    changes = [(pr, rng.choice([None, f"c{rng.randrange(n)}"]), rng.randrange(1, 5)) for pr in range(1, 45) if rng.random() < 0.9]
    records, mapped = _mapped(line, changes, rollups)
    commits = spark.createDataFrame(rows, "repo string, sha string, parents array<string>, subject string, body string")
    positions = history.first_parent_line(commits, spark.createDataFrame([("r", f"c{n - 1}")], "repo string, sha string"))
    found, fates = history.map_changes(commits, positions, spark.createDataFrame([("r", *c) for c in changes], "repo string, pr long, merge_sha string, member_commits int"))
    assert {r["pr"]: [r["merge_sha"], r["member_commits"], r["landed_by"], r["batched"], r["relanded"]] for r in found.collect()} == records
    assert {r["sha"] for r in fates.where("state <> 'unmapped'").collect()} == mapped


def test_landing_times_run_over_blocks(spark):
    line = spark.createDataFrame([("r", i, (i * 37) % 50) for i in range(300)], "repo string, position int, ct int")
    rows = {r["position"]: r["landed"] for r in features.landing_times(line).collect()}
    assert rows == {i: max((j * 37) % 50 for j in range(i + 1)) for i in range(300)}
