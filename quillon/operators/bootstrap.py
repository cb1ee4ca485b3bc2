"""A seeded bootstrap whose draws are looked up by their number, so that every replicate is reckoned apart from all others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..session import checkpointed

_MASK = 0xFFFFFFFF
#: Fixed value: what the generator adds to its state for each number.
_STEP = 0x6D2B79F5


def _times(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of numbers below 2^32, without a step beyond 64."""
    low, high = b.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(b, 16)
    return (a * low + F.shiftleft((a * high).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_MASK))


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_MASK))


def random_at(rows: DataFrame, seed: Column, k: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the ``k``-th number (from 1) of the mulberry32 generator of ``seed``, in [0, 1). Its state is the seed plus so many steps.

    Each step is a column of its own, as the next reads it several times.
    """
    s, t = F.col("__s"), F.col("__t")
    made = rows.withColumn("__s", _low(_low(seed.cast("long")) + _times(_low(k.cast("long")), F.lit(_STEP).cast("long"))))
    made = made.withColumn("__t", _times(s.bitwiseXOR(F.shiftrightunsigned(s, 15)), s.bitwiseOR(F.lit(1))))
    made = made.withColumn("__s", _times(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61))))
    made = made.withColumn("__t", t.bitwiseXOR(_low(t + s)))
    return made.withColumn(name, t.bitwiseXOR(F.shiftrightunsigned(t, 14)).cast("double") / F.lit(4294967296.0)).drop("__s", "__t")


def seed_of(*parts: Column) -> Column:
    """The generator's seed for a text of ``parts`` (joined by a zero byte): the first eight hex digits of its SHA-256."""
    return F.conv(F.substring(X.sha_id([*parts, F.lit("bootstrap")]), 1, 8), 16, 10).cast("long")


def bootstrap(rows: DataFrame, estimator: Column, seed: str | Column, by: str = "group", resamples: int = 2000) -> DataFrame:
    """``by, estimate, ci_low, ci_high, n``: an estimate of each group and its 95 % percentile interval.

    ``rows``: ``by, cell, ordinal`` and what ``estimator`` reads, any aggregate over rows (a grouped pandas UDF too); null is no
    estimate. Rows are drawn anew within each cell, as many as it has, cells in the order of their first
    rows; draw i of replicate b is number b * n + i of the generator, which ``random_at`` gives at once. So a
    replicate is a group of its own, and no task holds all of a group's replicates or draws. The interval is
    the value at floor(q * values) of the sorted estimates of replicates that have one. ``ordinal`` must tell the rows of a group apart.
    """
    rows = checkpointed(rows)  # read three times
    cells = rows.groupBy(by, "cell").agg(F.count(F.lit(1)).alias("__size"), F.min("ordinal").alias("__first"))
    order = Window.partitionBy(by).orderBy("__first")  # a row a cell
    offset = F.coalesce(F.sum("__size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sized = cells.withColumn("__offset", offset).withColumn("__n", F.sum("__size").over(Window.partitionBy(by))).drop("__first")
    placed = rows.withColumn("__i", F.row_number().over(Window.partitionBy(by, "cell").orderBy("ordinal")) - 1)
    slots = placed.select(by, "cell", "__i").join(sized, [by, "cell"]).withColumn("__seed", seed_of(F.lit(seed) if isinstance(seed, str) else seed))
    draws = slots.withColumn("__b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(resamples - 1).cast("long"))))
    number = F.col("__b") * F.col("__n") + F.col("__offset") + F.col("__i") + 1
    picked = random_at(draws, F.col("__seed"), number, "__u").select(by, "cell", "__b", F.floor(F.col("__u") * F.col("__size")).cast("int").alias("__i"))
    replicates = picked.join(placed, [by, "cell", "__i"]).groupBy(by, "__b").agg(estimator.alias("__v"))
    # as many values as there are replicates
    values = replicates.where("__v is not null").groupBy(by).agg(F.array_sort(F.collect_list("__v")).alias("__values"))
    point = rows.groupBy(by).agg(estimator.alias("__point"), F.count(F.lit(1)).alias("n"))

    def at(q: float) -> Column:
        size = F.size("__values")
        return F.when(F.col("__point").isNotNull() & (size > 0), X.round4(F.get("__values", F.least(size - 1, F.floor(F.lit(q) * size).cast("int")))))

    return point.join(values, by, "left").select(by, X.round4(F.col("__point")).alias("estimate"), at(0.025).alias("ci_low"), at(0.975).alias("ci_high"), "n")
