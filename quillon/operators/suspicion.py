"""Which features know too much: each one's area under the curve, within repositories and by period, what its nulls tell, and models with and without some of them.

``rows``: ``row_id, repo, as_of`` (a time), ``y`` (0 or 1) and a column a feature.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..session import checkpointed
from .scans import prefix_scan

# From which area, and from which swing of the share of nulls, a feature is suspicious.
SUSPICIOUS_AREA, NULL_SWING = 0.75, 0.2


def areas(rows: DataFrame, keys: Sequence[str], y: str = "y", x: str = "x") -> DataFrame:
    """``keys, area, positives``: the area under the curve of ``x`` for ``y`` by ``keys``, ties counted half; null unless both classes are there. Rows without ``x`` are left out.

    Values are counted first; how many negatives lie below each is a prefix scan, so no task holds a key's values.
    """
    keys = list(keys)
    counted = rows.where(F.col(x).isNotNull()).groupBy(*keys, F.col(x).alias("__x")).agg(F.sum(F.col(y)).cast("long").alias("__p"), F.count(F.lit(1)).alias("__c"))
    below = prefix_scan(counted.withColumn("__n", F.col("__c") - F.col("__p")), keys, ["__x"], {"__below": ("sum", "__n")}, own=False)
    met = below.groupBy(*keys).agg(F.sum(F.col("__p") * (F.coalesce("__below", F.lit(0)) * 2 + F.col("__n"))).alias("__twice"), F.sum("__p").alias("positives"), F.sum("__n").alias("__n"))
    return met.select(*keys, F.when((F.col("positives") > 0) & (F.col("__n") > 0), F.col("__twice") / (2.0 * F.col("positives") * F.col("__n"))).alias("area"), "positives")


def by_feature(rows: DataFrame, numbers: Sequence[str], categories: Sequence[str], recent_from: str) -> DataFrame:
    """``name, row_id, repo, quarter, recent, y, x``: a row a feature and row; a category counts by its share of positives."""
    own = ["row_id", "repo", F.concat(F.date_format("as_of", "yyyy"), F.lit("-Q"), F.quarter("as_of").cast("string")).alias("quarter"), (F.col("as_of") >= F.lit(recent_from).cast("timestamp")).cast("int").alias("recent"), F.col("y").cast("int").alias("y")]
    cells = [F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("number"), F.lit(None).cast("string").alias("word")) for n in numbers]
    cells += [F.struct(F.lit(n).alias("name"), F.lit(None).cast("double").alias("number"), F.col(n).cast("string").alias("word")) for n in categories]
    long = rows.select(*own, F.explode(F.array(*cells)).alias("c")).select("c.name", "row_id", "repo", "quarter", "recent", "y", "c.number", "c.word")
    rates = long.where("word is not null").groupBy("name", "word").agg(F.avg("y").alias("__rate"))
    return long.join(rates, ["name", "word"], "left").select("name", "row_id", "repo", "quarter", "recent", "y", F.coalesce("number", "__rate").alias("x"))


def _oriented(area: Column) -> Column:
    return F.greatest(area, 1 - area)


def suspicion_scan(rows: DataFrame, numbers: Sequence[str], categories: Sequence[str], recent_from: str) -> DataFrame:
    """``name, non_null, auc, within_repo_auc, null_indicator_auc, recent_period_auc, null_rate_swing, flags``, a row a feature.

    Within repositories areas are averaged by their positives. Flags: an area of 0.75 or more either way (of the feature, within repositories, of
    its nulls), and a share of nulls that swings by over 0.2 between quarters.
    """
    long = checkpointed(by_feature(rows, numbers, categories, recent_from))
    pooled = areas(long, ["name"]).select("name", F.col("area").alias("auc"))
    inside = areas(long, ["name", "repo"]).where("area is not null").groupBy("name").agg((F.sum(F.col("area") * F.col("positives")) / F.sum("positives")).alias("within_repo_auc"))
    nulls = areas(long.withColumn("x", F.col("x").isNull().cast("double")), ["name"]).select("name", F.col("area").alias("null_indicator_auc"))
    period = areas(long, ["name"], y="recent").select("name", F.col("area").alias("recent_period_auc"))
    rates = long.groupBy("name", "quarter").agg(X.round4(F.avg(F.col("x").isNull().cast("double"))).alias("__rate"))
    swing = rates.groupBy("name").agg((F.max("__rate") - F.min("__rate")).alias("null_rate_swing"))
    counts = long.groupBy("name").agg(F.count("x").alias("non_null"))
    met = reduce(lambda a, b: a.join(b, "name", "left"), [counts, pooled, inside, nulls, period, swing])
    rules = {"high_single_feature_auc": "auc", "high_within_repo_auc": "within_repo_auc", "null_indicator_predicts_label": "null_indicator_auc"}
    flags = F.array_compact(F.array(*[F.when(_oriented(F.col(c)) >= SUSPICIOUS_AREA, name) for name, c in rules.items()], F.when(F.col("null_rate_swing") > NULL_SWING, "null_rate_tracks_time")))
    return met.select("name", "non_null", *[X.round4(F.col(c)).alias(c) for c in ("auc", "within_repo_auc", "null_indicator_auc", "recent_period_auc", "null_rate_swing")], flags.alias("flags"))


def model_audit(rows: DataFrame, numbers: Sequence[str], categories: Sequence[str], recent_from: str, folds: int = 4, rounds: int = 20, seed: int = 0) -> DataFrame:
    """``split, auc, pr_auc, rows, positives`` of boosted trees: learned before ``recent_from`` and held against later rows (temporal), and over folds of whole repositories (repo_grouped).

    Categories are one column a value, from the values that are there; a null is 0 with an indicator of its own. A split without both classes has no row.
    """
    values = {c: sorted(r[0] for r in rows.where(F.col(c).isNotNull()).select(c).distinct().collect()) for c in categories}  # closed lists: a few words each
    columns = {n: F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in numbers} | {f"{n}?": F.col(n).isNull().cast("double") for n in [*numbers, *categories]}
    columns |= {f"{c}={v}": F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)) for c, vs in values.items() for v in vs}
    names = {f"f{i}": x for i, x in enumerate(columns.values())}
    made = rows.select(F.col("y").cast("double").alias("label"), (F.col("as_of") >= F.lit(recent_from).cast("timestamp")).alias("recent"), F.pmod(F.xxhash64("repo"), F.lit(folds)).alias("fold"), *[x.alias(n) for n, x in names.items()])
    ready = checkpointed(VectorAssembler(inputCols=list(names), outputCol="features").transform(made).select("label", "recent", "fold", "features"))

    def scored(train: DataFrame, test: DataFrame) -> DataFrame | None:
        if train.select("label").distinct().count() < 2 or not test.limit(1).count():
            return None
        return GBTClassifier(maxIter=rounds, maxDepth=3, seed=seed).fit(train).transform(test).select("label", "rawPrediction")

    splits = {"temporal": [scored(ready.where("not recent"), ready.where("recent"))], "repo_grouped": [scored(ready.where(F.col("fold") != i), ready.where(F.col("fold") == i)) for i in range(folds)]}
    out = []
    for name, parts in splits.items():
        parts = [p for p in parts if p is not None]
        if not parts:
            continue
        every = checkpointed(reduce(DataFrame.union, parts))
        n = every.agg(F.count(F.lit(1)), F.sum("label")).first()
        if 0 < n[1] < n[0]:
            out.append((name, *[float(BinaryClassificationEvaluator(metricName=m).evaluate(every)) for m in ("areaUnderROC", "areaUnderPR")], n[0], int(n[1])))
    return rows.sparkSession.createDataFrame(out, "split string, auc double, pr_auc double, rows long, positives long")
