"""Scores of merges, outcomes that mature later, and how the two compare."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X


def unscored(merges: DataFrame, scores: DataFrame) -> DataFrame:
    """Merges without a score yet: what an idempotent run scores."""
    return merges.join(scores.select("repo", "merge_sha"), ["repo", "merge_sha"], "left_anti")


def score_with(merges: DataFrame, scorer_id: str, scorer_version: str, score: Callable[[pd.DataFrame], pd.Series], features: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Merges with the score that a caller's function gives batches of their features, and whether it lies below the threshold."""

    @F.pandas_udf("double")
    def run(frame: pd.DataFrame) -> pd.Series:
        return score(frame)

    scored = merges.withColumn("score", run(F.struct(*features)))
    return scored.withColumns({"scorer_id": F.lit(scorer_id), "scorer_version": F.lit(scorer_version), "threshold": F.lit(threshold), "would_flag": F.col("score") < threshold})


def due_outcomes(scores: DataFrame, outcomes: DataFrame, horizon_days: int, as_of) -> DataFrame:
    """Scored merges that lack an outcome at the horizon, with ``matured``: is it due at ``as_of``?"""
    have = outcomes.where(F.col("horizon_days") == horizon_days).select("repo", "merge_sha")
    matured = F.col("merged_at") + F.expr(f"interval {horizon_days} days") <= F.lit(as_of)
    return scores.join(have, ["repo", "merge_sha"], "left_anti").withColumn("matured", matured)


def with_outcomes(scores: DataFrame, outcomes: DataFrame, horizon_days: int) -> DataFrame:
    """Scores with ``has_outcome, survived``; the last outcome row of a key counts, of rows of one ordinal a survived one, then a known one."""
    own = outcomes.where(F.col("horizon_days") == horizon_days)
    last = own.groupBy("repo", "merge_sha").agg(F.max_by(F.struct(F.lit(True).alias("has_outcome"), "survived"), F.struct("ordinal", "survived")).alias("o"))
    return scores.join(last, ["repo", "merge_sha"], "left").select(*scores.columns, F.coalesce("o.has_outcome", F.lit(False)).alias("has_outcome"), "o.survived")


def _rates(n: str = "n_scored") -> list:
    return [
        X.ratio4(F.col("n_flagged"), F.col(n)).alias("would_flag_rate"),
        X.ratio4(F.col("flagged_not_survived"), F.col("flagged_matured")).alias("precision"),
        X.ratio4(F.col("flagged_survived"), F.col("n_survived")).alias("false_positive_rate"),
    ]


def _counts(flagged) -> list:
    known = F.col("survived").isNotNull()
    return [
        F.count_if(flagged).alias("n_flagged"), F.count_if(flagged & known).alias("flagged_matured"), F.count_if(flagged & ~F.col("survived")).alias("flagged_not_survived"),
        F.count_if(flagged & F.col("survived")).alias("flagged_survived"), F.count_if(F.col("survived")).alias("n_survived"),
    ]


def report(joined: DataFrame) -> DataFrame:
    """Metrics by repository at the threshold of its last score; the most frequent scorer, of ties the first seen."""
    last = joined.groupBy("repo").agg(F.max_by("threshold", "ordinal").alias("__threshold"))
    rows = joined.join(last, "repo")
    flagged = F.col("score") < F.col("__threshold")
    matured = F.count_if(F.col("survived").isNotNull()).alias("n_matured")
    unlabelled = F.count_if(F.col("has_outcome") & F.col("survived").isNull()).alias("n_unlabelled")
    main = rows.groupBy("repo").agg(F.count(F.lit(1)).alias("n_scored"), matured, unlabelled, *_counts(flagged))
    used = rows.groupBy("repo", "scorer_id").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first"))
    top = used.groupBy("repo").agg(F.max_by("scorer_id", F.struct("n", -F.col("first"))).alias("scorer_id"), (F.count(F.lit(1)) > 1).alias("scorer_mixed"))
    rates = main.select("repo", "n_scored", "n_matured", "n_unlabelled", "n_flagged", *_rates(), X.ratio4(F.col("n_survived"), F.col("n_matured")).alias("base_survival_rate"))
    return rates.join(top, "repo")


def threshold_sweep(joined: DataFrame, steps: int = 19) -> DataFrame:
    """The metrics at 0.05, 0.10, ...: scores are counted between thresholds first, and those counts are summed below each."""
    at = F.expr(f"transform(sequence(1, {steps}), i -> floor(i * 0.05D * 10000 + 0.5) / 10000D)")
    # a score is flagged at every threshold above it: those after the first ``reached``
    reached = F.size(F.filter(at, lambda t: t <= F.col("score")))
    known = F.col("survived").isNotNull()
    cells = joined.groupBy("repo", reached.alias("reached")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(known).alias("m"), F.count_if(~F.col("survived")).alias("gone"), F.count_if(F.col("survived")).alias("stands"),
    )
    each = cells.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    below = F.col("reached") < F.col("i")

    def total(c: str) -> Column:
        return F.coalesce(F.sum(F.when(below, F.col(c))), F.lit(0))

    counted = each.groupBy("repo", "i").agg(
        F.sum("n").alias("n_scored"), total("n").alias("n_flagged"), total("m").alias("flagged_matured"), total("gone").alias("flagged_not_survived"), total("stands").alias("flagged_survived"), F.sum("stands").alias("n_survived"),
    )
    return counted.select("repo", F.element_at(at, F.col("i")).alias("threshold"), F.col("n_flagged").alias("would_flag_count"), *_rates())
