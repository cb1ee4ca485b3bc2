"""The bootstrap against a serial generator, and the pick of a definition."""

from __future__ import annotations

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from quillon.operators import bootstrap as boot
from quillon.operators import calibration
from quillon.operators import calibration_run as R


def numbers(seed, n):
    a, out = seed, []
    for _ in range(n):
        a = (a + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((a ^ a >> 15) * (a | 1)) & 0xFFFFFFFF
        t ^= (t + ((t ^ t >> 7) * (t | 61) & 0xFFFFFFFF)) & 0xFFFFFFFF
        out.append(((t ^ t >> 14) & 0xFFFFFFFF) / 4294967296)
    return out


@pytest.mark.parametrize("seed", [0, 123, 2**32 - 1])
def test_numbers_are_those_of_the_serial_generator(spark, seed):
    rows = boot.random_at(spark.range(1, 400), F.lit(seed), F.col("id"), "u").orderBy("id").collect()
    assert [r["u"] for r in rows] == numbers(seed, 399)


def serial(rows, estimator, seed, resamples):
    rows = sorted(rows, key=lambda r: r[1])
    cells = {}
    for r in rows:
        cells.setdefault(r[2], []).append(r)
    draw = iter(numbers(int(hashlib.sha256(f"{seed}\0bootstrap".encode()).hexdigest()[:8], 16), resamples * len(rows)))
    values = []
    for _ in range(resamples):
        again = [c[math.floor(next(draw) * len(c))] for c in cells.values() for _ in c]
        if (v := estimator(again)) is not None:
            values.append(v)
    values.sort()
    at = lambda q: math.floor(values[min(len(values) - 1, math.floor(q * len(values)))] * 1e4 + 0.5) / 1e4
    return (at(0.025), at(0.975)) if values else (None, None)


def test_bootstrap_equals_the_serial_order(spark):
    rows = [("g", i, "b" if i in (0, 5, 9) else "a", i % 3 == 0, 1.0 + i % 4) for i in range(40)] + [("h", 7, "x", True, 1.0), ("i", 1, "x", False, 0.0)]
    frame = spark.createDataFrame(rows, "group string, ordinal int, cell string, yes boolean, w double").repartition(3)
    share = F.when(F.sum("w") > 0, F.sum(F.when(F.col("yes"), F.col("w")).otherwise(0.0)) / F.sum("w"))
    plain = lambda rs: sum(r[4] for r in rs if r[3]) / sum(r[4] for r in rs) if sum(r[4] for r in rs) > 0 else None
    found = {r["group"]: r for r in boot.bootstrap(frame, share, "s", resamples=2000).collect()}
    for g in "gh":
        assert (found[g]["ci_low"], found[g]["ci_high"]) == serial([r for r in rows if r[0] == g], plain, "s", 2000)
    assert found["g"]["ci_low"] < found["g"]["estimate"] < found["g"]["ci_high"] and found["g"]["n"] == 40
    assert (found["i"]["estimate"], found["i"]["ci_low"], found["i"]["n"]) == (None, None, 1)
    assert boot.bootstrap(frame.limit(0), share, "s").count() == 0


def test_bootstrap_takes_any_aggregate(spark):
    frame = spark.createDataFrame([("g", i, "a", float(i * i)) for i in range(11)], "group string, ordinal int, cell string, x double")
    middle = lambda rs: sorted(r[3] for r in rs)[len(rs) // 2]
    found = boot.bootstrap(frame, F.expr("percentile(x, 0.5)"), "s", resamples=300).first()
    assert (found["ci_low"], found["ci_high"]) == serial([("g", i, "a", float(i * i)) for i in range(11)], middle, "s", 300)


def _estimates(spark, rows):
    return spark.createDataFrame([("definition", name, place, may, measure, value) for name, place, may, p, r in rows for measure, value in (("precision", p), ("recall", r))], "scope string, name string, place int, may_pick boolean, measure string, estimate double")


def test_the_pick_is_precise_first_and_the_earlier_of_equals(spark):
    plan = R.Plan(precision_floor=0.7)
    rows = [("a", 0, True, 0.69, 0.9), ("b", 1, True, 0.7, 0.5), ("c", 2, True, 0.9, 0.5), ("d", 3, False, 1.0, 1.0), ("e", 4, True, 0.8, None), ("f", 5, True, None, 1.0)]
    found = _estimates(spark, rows)
    assert R.picked(found, plan).first()["definition"] == "b"
    assert R.picked(found, plan, _estimates(spark, [("b", 1, True, 0.6, 1.0), ("c", 2, True, 0.7, 0.0), ("a", 0, True, 1.0, 1.0)])).first()["definition"] == "c"
    assert R.picked(found.limit(0), plan).first()["definition"] is None


def test_weighted_rates(spark):
    rows = spark.createDataFrame([(1, "yes", True), (3, "no", True)], "weight long, verdict string, positive boolean")
    rates = calibration.weighted_rates(rows).first()
    assert (rates["precision"], rates["recall"]) == (0.25, 1.0)
