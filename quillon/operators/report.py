"""Descriptive report cells: risk ratios of buckets, quartiles, areas under the curve, suppression."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X


def quartile_cuts(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Nearest-rank quartiles: the value at ceil(q n)."""
    q = [F.expr(f"percentile_disc({x}) within group (order by `{value}`)").cast(rows.schema[value].dataType).alias(f"q{i}") for i, x in enumerate((0.25, 0.5, 0.75), 1)]
    return rows.where(F.col(value).isNotNull()).groupBy(*by).agg(*q)


def bucket_risk(rows: DataFrame, by: list[str], bucket: str, event: str) -> DataFrame:
    """Each bucket's rate of ``event`` against that of all other buckets; rows without a bucket don't count."""
    kept = rows.where(F.col(bucket).isNotNull())
    own = kept.groupBy(*by, bucket).agg(F.count_if(event).alias("k"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by)
    both = own.withColumns({"k_other": F.sum("k").over(w) - F.col("k"), "n_other": F.sum("n").over(w) - F.col("n")})
    low, high = X.wilson(F.col("k"), F.col("n"))
    ratio, r_low, r_high = X.katz(F.col("k"), F.col("n"), F.col("k_other"), F.col("n_other"))
    return both.select(*by, bucket, "k", "n", "k_other", "n_other", low.alias("rate_low"), high.alias("rate_high"), ratio.alias("ratio"), r_low.alias("ratio_low"), r_high.alias("ratio_high"))


def suppress(cells: DataFrame, floor: int = 20, coverage_floor: float = 0.6) -> DataFrame:
    """Cells below the floor, or of a section whose coverage is too low, lose value and interval and get reasons in fixed order."""
    few, thin = F.col("n") < floor, F.coalesce(F.col("coverage") < coverage_floor, F.lit(False))
    reasons = F.filter(F.array(F.when(few, "n_below_floor"), F.when(thin, "coverage_below_floor")), lambda r: r.isNotNull())
    hidden = few | thin
    shown = cells.withColumns({"suppressed": hidden, "reasons": reasons, **{c: F.when(~hidden, F.col(c)) for c in ("value", "ci_low", "ci_high")}})
    return shown


def section_status(cells: DataFrame, section: str = "section") -> DataFrame:
    """A section shows as long as one of its cells does."""
    return cells.groupBy(section).agg(F.when(F.min("suppressed"), "suppressed").otherwise("shown").alias("status"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"))


def macro_micro(counts: DataFrame) -> DataFrame:
    """The mean of the groups' rates and the rate of their sums."""
    return counts.agg(X.round4(F.avg(F.col("k") / F.col("n"))).alias("macro"), X.round4(F.sum("k") / F.sum("n")).alias("micro"))


def area_under_curve(rows: DataFrame, by: list[str], value: str, label: str) -> DataFrame:
    """Mann-Whitney: rank sums with ties averaged, counted by distinct value before any ranking."""
    counted = rows.where(F.col(value).isNotNull() & F.col(label).isNotNull()).groupBy(*by, value).agg(F.count_if(label).alias("p"), F.count_if(~F.col(label)).alias("q"))
    w = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    before = counted.withColumn("below", F.coalesce(F.sum("q").over(w), F.lit(0)))
    agg = before.groupBy(*by).agg(F.sum(F.col("p") * (2 * F.col("below") + F.col("q"))).alias("u2"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return agg.select(*by, F.col("p").alias("positives"), F.col("q").alias("negatives"), F.when((F.col("p") > 0) & (F.col("q") > 0), X.round4(F.col("u2") / (2 * F.col("p") * F.col("q")))).alias("auc"))
