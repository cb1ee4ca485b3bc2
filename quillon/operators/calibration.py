"""Seeded draws, agreement of raters and weighted rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X


def seeded_rank(rows: DataFrame, seed: str, key: str, by: list[str], name: str = "rank") -> DataFrame:
    """Place of each row in its group, by the SHA-256 of seed and key."""
    w = Window.partitionBy(*by).orderBy("__h", key)
    return rows.withColumn("__h", X.sha_id([F.lit(seed), F.col(key)])).withColumn(name, F.row_number().over(w)).drop("__h")


def round_robin_draw(units: DataFrame, seed: str, allocation: int) -> DataFrame:
    """Of each stratum ``allocation`` units: repositories in seeded order take turns with their units in seeded order."""
    ranked = seeded_rank(units, seed, "unit", ["stratum", "repo"], "turn").withColumn("__repo", X.sha_id([F.lit(seed), F.col("repo")]))
    w = Window.partitionBy("stratum").orderBy("turn", "__repo", "unit")
    return ranked.withColumn("place", F.row_number().over(w)).where(F.col("place") <= allocation).drop("__repo")


def stratified_sample(rows: DataFrame, seed: str, key: str, by: list[str], n: int) -> DataFrame:
    """The first ``n`` of each cell in hash order, with the cell's population and sample."""
    ranked = seeded_rank(rows, seed, key, by).withColumn("population", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    return ranked.where(F.col("rank") <= n).withColumn("sampled", F.least("population", F.lit(n)))


def tercile_bands(rows: DataFrame, size: str, key: str) -> DataFrame:
    """Band 0, 1 or 2 by size: cuts at floor(n / 3) and floor(2 n / 3) of the rows in order of size and key.

    Sizes are counted first, so that no task orders a whole repository: only rows of one size are ordered by their key.
    """
    counted = rows.groupBy("repo", F.col(size).alias("__size")).agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy("repo")
    before = counted.withColumn("__before", F.sum("__c").over(w.orderBy("__size")) - F.col("__c")).withColumn("__n", F.sum("__c").over(w)).drop("__c")
    placed = rows.withColumn("__size", F.col(size)).join(before, ["repo", "__size"])
    at = placed.withColumn("__i", F.col("__before") + F.row_number().over(Window.partitionBy("repo", "__size").orderBy(key)) - 1)
    return at.withColumn("band", F.expr("if(__i < __n div 3, 0, if(__i < 2 * __n div 3, 1, 2))")).select(*rows.columns, "band")


def kappa(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Cohen's kappa of ``x`` and ``y``, a row for each group of ``by``; null if chance agrees always."""
    by = by or []
    cells = pairs.groupBy(*by, "x", "y").agg(F.count(F.lit(1)).alias("c"))
    n = cells.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("c")).otherwise(0)).alias("agree"))
    one = cells.groupBy(*by, F.col("x").alias("v")).agg(F.sum("c").alias("a"))
    two = cells.groupBy(*by, F.col("y").alias("v")).agg(F.sum("c").alias("b"))
    both = one.join(two, [*by, "v"]).groupBy(*by).agg(F.sum(F.col("a") * F.col("b")).alias("ab"))
    met = n.join(both, by, "left") if by else n.join(both, F.lit(True), "left")
    po, pe = F.col("agree") / F.col("n"), F.coalesce("ab", F.lit(0)) / (F.col("n") * F.col("n"))
    return met.select(*by, F.col("n").alias("pairs"), F.when(F.col("n") > 0, F.when(pe != 1, X.round4((po - pe) / (1 - pe)))).alias("kappa"))


def kappa_per_code(pairs: DataFrame, codes: list[str], floor: float) -> DataFrame:
    """One-against-rest kappa of each code, with the verdict."""
    each = pairs.withColumn("code", F.explode(F.array(*[F.lit(c) for c in codes]))).withColumns({"__x": F.col("x") == F.col("code"), "__y": F.col("y") == F.col("code")})
    used = each.groupBy("code").agg(F.count_if(F.col("__x") | F.col("__y")).alias("used"))
    one = kappa(each.select("code", F.col("__x").alias("x"), F.col("__y").alias("y")), ["code"]).drop("pairs")
    value = F.when(F.col("used") > 0, F.col("kappa"))
    verdict = F.when(F.col("used") == 0, "not_observed").when(F.col("kappa").isNull(), "undefined").when(F.col("kappa") >= floor, "pass").otherwise("below_floor")
    return used.join(one, "code", "left").select("code", "used", value.alias("kappa"), verdict.alias("verdict"))


def weighted_rates(rows: DataFrame) -> DataFrame:
    """Weighted precision and recall of ``positive`` against ``verdict`` yes; rows count by their whole-number ``weight``."""
    w, yes, positive = F.col("weight"), F.col("verdict") == "yes", F.col("positive")

    def total(test) -> object:
        return F.sum(F.when(test, w).otherwise(0))

    agg = rows.agg(total(positive & yes).alias("both"), total(positive).alias("positive"), total(yes).alias("yes"))
    return agg.select(X.ratio4(F.col("both"), F.col("positive")).alias("precision"), X.ratio4(F.col("both"), F.col("yes")).alias("recall"))
