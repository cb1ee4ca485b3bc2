"""The suspicion audit: areas against all pairs, and models that find a planted leak."""

from __future__ import annotations

import datetime
import random

from quillon.operators import suspicion

DAY = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
SCHEMA = "row_id long, repo string, as_of timestamp, y int, noise double, leak double, word string"


def _rows(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        y = int(rng.random() < 0.4)
        out.append((i, f"r{i % 6}", DAY + datetime.timedelta(days=i % 200), y, rng.random() if i % 9 else None, float(y if rng.random() < 0.95 else 1 - y) if i % 10 else None, rng.choice(["a", "b", None])))
    return out


def test_areas_equal_all_pairs(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.randrange(2), rng.choice([None, 0.0, 1.0, 2.5, 2.5])) for _ in range(200)] + [("c", 1, 1.0), ("d", 0, None)]
    found = {r["k"]: r["area"] for r in suspicion.areas(spark.createDataFrame(rows, "k string, y int, x double").repartition(4), ["k"]).collect()}
    for k in "abc":
        one, none = ([x for g, y, x in rows if g == k and y == label and x is not None] for label in (1, 0))
        wanted = sum((a > b) + (a == b) / 2 for a in one for b in none) / (len(one) * len(none)) if one and none else None
        assert found[k] is None if wanted is None else abs(found[k] - wanted) < 1e-12
    assert "d" not in found


def test_scan_flags_the_leak(spark):
    frame = spark.createDataFrame(_rows(600), SCHEMA)
    found = {r["name"]: r for r in suspicion.suspicion_scan(frame, ["noise", "leak"], ["word"], "2024-05-01").collect()}
    assert found["leak"]["flags"] == ["high_single_feature_auc", "high_within_repo_auc"] and found["noise"]["flags"] == [] and found["word"]["flags"] == []
    assert found["leak"]["non_null"] == 540 and 0.4 < found["noise"]["recent_period_auc"] < 0.6


def test_models_find_the_leak(spark):
    frame = spark.createDataFrame(_rows(600), SCHEMA)
    known, blind = ({r["split"]: r for r in suspicion.model_audit(frame, numbers, ["word"], "2024-05-01", folds=2, rounds=3).collect()} for numbers in (["noise", "leak"], ["noise"]))
    for split in ("temporal", "repo_grouped"):
        assert known[split]["auc"] > 0.85 and blind[split]["auc"] < 0.65 and known[split]["pr_auc"] > blind[split]["pr_auc"]
    assert known["repo_grouped"]["rows"] == 600 and known["temporal"]["rows"] < 300
    assert suspicion.model_audit(frame.limit(0), ["noise"], [], "2024-05-01", folds=2, rounds=1).count() == 0
