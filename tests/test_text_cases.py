"""Each case of the text rules, filled with values of one order, gives just what it states."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillon.operators import redaction
from quillon.plans import text_queries as Q
from quillon.sources import sessions

VALUES = {"k": "12", "c": "7", "p": "urgent", "h": "9e107d9d37", "y": "2024-01-01", "e": "1704067200000"}


def fill(v):
    if isinstance(v, list):
        return [fill(x) for x in v]
    if not isinstance(v, str):
        return v
    number = isinstance(v, Q.N)
    for name, value in VALUES.items():
        v = v.replace("{" + name + "}", value)
    return float(v) if number else v


@pytest.mark.parametrize("name", sorted(Q.CASES))
def test_case(spark, name):
    schema, names, results, rows = Q.CASES[name]
    df = spark.createDataFrame([(i, *map(fill, given)) for i, (given, _) in enumerate(rows)], f"i long, {schema}")
    if name == "provider_usage":
        df = sessions.provider_usage(df)
    if name == "redaction":
        df = df.withColumn("r", redaction.redact(F.col("text"), Q.SALT, known_names=["Acme Corp"]))
    found = df.orderBy("i").select(*results(df)).collect()
    assert [tuple(r) for r in found] == [tuple(map(fill, r)) for _, r in rows]
    assert found[0].__fields__ == names
