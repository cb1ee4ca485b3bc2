"""Exact prefix scans over ordered rows that are spread over all tasks, however many rows one key has."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

#: How a scan's parts are taken together: over rows, and of what was before with what is within.
WAYS = {
    "min": (F.min, lambda before, within: F.least(before, within)),
    "max": (F.max, lambda before, within: F.greatest(before, within)),
    "sum": (F.sum, lambda before, within: F.when(before.isNotNull() & within.isNotNull(), before + within).otherwise(F.coalesce(before, within))),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda before, within: F.coalesce(within, before)),
}


def prefix_scan(rows: DataFrame, keys: list[str], order: list[str], scans: dict[str, tuple[str, Column | str]], own: bool = True) -> DataFrame:
    """``rows`` with each of ``scans`` (name to way and column): min, max, sum or last known value over a key's rows up to this one, in ``order``.

    Without ``own`` the row itself is left out. ``order`` must tell a key's rows apart, or rows of one
    place have no defined order. Rows are cut into blocks by ranges of key and order; a window runs
    within a block, the blocks' totals (a row a key and block) are scanned by key, and both are taken together: no task
    holds a key's rows, only a block of them. Nulls are passed over; a prefix of nulls gives null.
    """
    inside = {f"__{name}": F.col(c) if isinstance(c, str) else c for name, (_, c) in scans.items()}
    # the ranges are drawn from a sample: once they are there, they must stay
    block = checkpointed(rows.withColumns(inside).repartitionByRange(*keys, *order).withColumn("__block", F.spark_partition_id()))
    totals = block.groupBy(*keys, "__block").agg(*[(F.max_by(f"__{n}", F.when(F.col(f"__{n}").isNotNull(), F.struct(*order))) if way == "last" else WAYS[way][0](f"__{n}")).alias(f"__{n}") for n, (way, _) in scans.items()])
    past = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__block").alias("__at"), *[WAYS[way][0](F.col(f"__{n}")).over(past).alias(f"__b{n}") for n, (way, _) in scans.items()])
    w = Window.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    within = block.withColumns({f"__w{n}": WAYS[way][0](F.col(f"__{n}")).over(w) for n, (way, _) in scans.items()})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], F.col("__block") == F.col("__at"))
    met = within.join(before, same, "left")
    return met.select(*rows.columns, *[WAYS[way][1](F.col(f"__b{n}"), F.col(f"__w{n}")).alias(n) for n, (way, _) in scans.items()])
