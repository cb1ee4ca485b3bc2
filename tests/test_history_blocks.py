"""Histories whose rows lie in many blocks, and plans whose estimated sizes stay small numbers."""

from __future__ import annotations

import random

import pytest

from quillon.operators import history

COMMITS = "repo string, sha string, parents array<string>, seq int"


def _size_bits(df) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())).bit_length()


@pytest.mark.parametrize("near", [None, "seq"])
def test_lines_over_many_blocks(spark, near):
    rng = random.Random(3)
    rows, lines = [], {}
    for repo, n in (("a", 400), ("b", 7)):
        at, line = None, []
        for i in range(n):
            line.append(i)
            rows.append((repo, f"c{i}", [f"c{at}"] if at is not None else ["beyond"] if repo == "b" else [], rng.randrange(n) if i % 3 == 0 else i))
            rows.append((repo, f"side{i}", [f"c{i}", "elsewhere"], i))
            at = i
        lines[repo] = line
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, COMMITS).repartition(23)
    tips = spark.createDataFrame([("a", "c399"), ("b", "c6"), ("none", "c1")], "repo string, sha string")
    found = history.first_parent_line(frame, tips, near)
    assert sorted((r["repo"], r["sha"], r["position"]) for r in found.collect()) == sorted((repo, f"c{i}", i) for repo, line in lines.items() for i in line)
    # each step was a join of two tables of the last: estimates as products of sizes grow beyond any number
    assert _size_bits(found) < 1000


def test_ways_out_of_a_block():
    assert history._ways_out(["r"] * 4, ["a", "b", "c", "x"], ["b", "c", "out", None]) == (["out", "out", "out", None], [3, 2, 1, 1])
    assert history._ways_out(["r", "s"], ["a", "b"], ["b", None]) == (["b", None], [1, 1])
    with pytest.raises(ValueError, match="circle"):
        history._ways_out(["r", "r"], ["a", "b"], ["b", "a"])


def test_long_side_branches_have_plain_sizes(spark):
    rows = [("r", f"c{i}", [f"c{i - 1}"] if i else [], i) for i in range(3)] + [("r", f"s{i}", [f"s{i - 1}" if i else "c0"], 3 + i) for i in range(14)]
    commits = spark.createDataFrame([*rows, ("r", "m", ["c2", "s13"], 99)], COMMITS)
    line = history.first_parent_line(commits, spark.createDataFrame([("r", "m")], "repo string, sha string"))
    index = history.landing_index(commits, line)
    assert {(r["landing"], r["base"]) for r in index.where("position is null").collect()} == {(3, 0)}
    assert _size_bits(index) < 1000
