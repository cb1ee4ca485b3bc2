"""Populations and samples for hand labelling, their audit and gold rows, and the tallies that a gate reads."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import exprs as X

# Admitted proxies from the surest.
PRIORITY = ("revert", "repair_reference", "regression_issue", "szz")
VERDICTS = ("yes", "no", "unclear")


def classify_population(rows: DataFrame, candidates: DataFrame, horizon_days: int, strong_lines: int) -> DataFrame:
    """``pr, stratum, n_candidates``: each labelled change in its stratum at the horizon; unlabelled ones are left out.

    ``rows``: ``pr, horizon_days, corrective, repair_pair_ids``; ``candidates``: ``pr, candidate_id, proxy, lag_seconds, blamed_lines``. A corrective change is in
    the stratum of its surest accepted proxy, szz ones by their blamed lines; others are rejected if they have candidates, else negative.
    """
    near = candidates.where(F.col("lag_seconds") <= horizon_days * 86_400).groupBy("pr").agg(F.collect_list(F.struct("candidate_id", "proxy", F.coalesce("blamed_lines", F.lit(0)).alias("lines"))).alias("all"))
    own = rows.where((F.col("horizon_days") == horizon_days) & F.col("corrective").isNotNull()).join(near, "pr", "left")
    accepted = F.filter(F.coalesce("all", F.array().cast(own.schema["all"].dataType)), lambda c: F.array_contains("repair_pair_ids", c["candidate_id"]))
    lines = F.coalesce(F.array_max(F.transform(F.filter("accepted", lambda c: c["proxy"] == "szz"), lambda c: c["lines"])), F.lit(0))
    top = F.get(F.filter(F.array(*[F.lit(p) for p in PRIORITY]), lambda p: F.exists("accepted", lambda c: c["proxy"] == p)), F.lit(0))
    corrective = F.when(top == "szz", F.when(lines >= strong_lines, "szz_strong").otherwise("szz_weak")).otherwise(top)
    n = F.coalesce(F.size("all"), F.lit(0))
    stratum = F.when(F.col("corrective"), corrective).when(n > 0, "rejected").otherwise("negative")
    return own.withColumn("accepted", accepted).select("pr", stratum.alias("stratum"), F.greatest(n, F.lit(0)).alias("n_candidates"))


def definition_variants(candidates: DataFrame, strong_lines: int) -> DataFrame:
    """``pr, variant, positive``: is a change corrective under each definition? ``candidates``: accepted ones, ``pr, proxy, blamed_lines, revert_reason``."""
    strong = (F.col("proxy") != "szz") | (F.coalesce("blamed_lines", F.lit(0)) >= strong_lines)
    public = (F.col("proxy") != "revert") | ~F.coalesce(F.col("revert_reason") == "internal_build", F.lit(False))
    rules = {
        "all": F.lit(True), "high_precision": F.col("proxy").isin("revert", "repair_reference"), "szz_strong": strong, "no_internal_build": public,
        "szz_strong+no_internal_build": strong & public, "defect_repair": F.col("proxy").isin("repair_reference", "regression_issue"),
    }
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), keep.alias("keep")) for n, keep in rules.items()])).alias("v")
    return candidates.select("pr", each).groupBy("pr", "v.variant").agg(F.max("v.keep").alias("positive"))


def both_labelled(items: DataFrame, one: DataFrame, two: DataFrame, field: str) -> DataFrame:
    """``item_id, x, y``: items that both labellers filled in for a field."""
    a = one.where(F.trim(F.col(field)) != "").select("item_id", F.lower(F.trim(F.col(field))).alias("x"))
    b = two.where(F.trim(F.col(field)) != "").select("item_id", F.lower(F.trim(F.col(field))).alias("y"))
    return items.select("item_id").join(a, "item_id").join(b, "item_id")


def sanity_flags(rates: DataFrame, notes: DataFrame, low: float = 0.01, high: float = 0.25) -> DataFrame:
    """``repo, code, action, note``: repositories whose rate is degenerate or churning, each with the first note of its code."""
    code = F.when(F.col("rate") < low, "degenerate_rate").when(F.col("rate") > high, "churn_rate")
    first = notes.groupBy("repo", "code").agg(F.min(F.struct("ordinal", "action", "note")).alias("n"))
    return rates.where(F.col("rate").isNotNull()).select("repo", code.alias("code")).where("code is not null").join(first, ["repo", "code"], "left").select("repo", "code", "n.action", "n.note")


def audited(items: DataFrame, seed: str, shares: dict[str, float]) -> DataFrame:
    """``items`` with ``audit``: of each stratum the first ceil(n * share) in seeded order, so that a larger share audits a superset."""
    share = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in shares.items() for x in kv]), F.col("stratum")), F.lit(0.0))
    ranked = items.withColumn("__h", X.sha_id([F.lit(seed), F.lit("audit"), F.col("item_id")])).withColumn("__n", F.row_number().over(Window.partitionBy("stratum").orderBy("__h", "item_id")))
    return ranked.withColumn("audit", F.col("__n") <= F.ceil(F.count(F.lit(1)).over(Window.partitionBy("stratum")) * share - 1e-9)).drop("__h", "__n")


def extended_audit(items: DataFrame, seed: str, shares: dict[str, float]) -> DataFrame:
    """``audited`` under a later plan; fails if an item that was audited no longer would be."""
    again = audited(items.withColumnRenamed("audit", "__was"), seed, shares)
    dropped = F.raise_error(F.concat(F.lit("the new plan would drop an audited item: "), F.col("item_id").cast("string"))).cast("boolean")
    return again.withColumn("audit", F.when(F.col("__was") & ~F.col("audit"), dropped).otherwise(F.col("audit"))).drop("__was")


def shuffled(rows: DataFrame, seed: str, label: str, by: str, order: str) -> DataFrame:
    """``rows`` with ``place``: a seeded Fisher-Yates shuffle of each group; a group is a list to be worked off by hand and small."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        places = list(range(len(pdf)))
        for n, i in enumerate(range(len(pdf) - 1, 0, -1)):
            j = int(int.from_bytes(hashlib.sha256(f"{seed}:{label}:{n}".encode()).digest()[:4], "big") / 2**32 * (i + 1))
            places[i], places[j] = places[j], places[i]
        return pdf.iloc[places].assign(place=range(len(pdf)))

    return rows.groupBy(by).applyInPandas(run, StructType([*rows.schema.fields, StructField("place", LongType())]))


def with_gold_rows(sheet: list[dict], gold: list[dict], seed: str) -> list[dict]:
    """A sheet's rows with hidden gold rows put in one after the other at seeded places; refuses ids that are there already."""
    rows = list(sheet)
    for g in gold:
        if any(r["item_id"] == g["item_id"] for r in rows):
            raise ValueError(f"{g['item_id']}: already in the sheet")
        at = int(hashlib.sha256(f"{seed}\0gold\0{g['item_id']}".encode()).hexdigest()[:8], 16) % (len(rows) + 1)
        rows.insert(at, g)
    return rows


def split_gold(sheet: DataFrame, gold: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rest of a sheet and its gold rows."""
    return sheet.join(gold.select("item_id"), "item_id", "left_anti"), sheet.join(gold.select("item_id"), "item_id", "left_semi")


def gold_score(sheet: DataFrame, gold: DataFrame, pass_share: float) -> DataFrame:
    """One row: items, right and unlabelled ones, what is needed, and whether exclusion codes of right "no" verdicts on items with fixes match.

    ``gold``: ``item_id, expected, expected_exclusion, n_fixes``; ``sheet``: ``item_id, corrective, exclusion_code``.
    """
    met = gold.join(sheet, "item_id", "left").withColumn("got", F.lower(F.trim(F.coalesce("corrective", F.lit("")))))
    right = F.col("got") == F.col("expected")
    excluding = right & (F.col("got") == "no") & (F.col("n_fixes") > 0)
    agg = met.agg(F.count(F.lit(1)).alias("items"), F.count_if(right).alias("correct"), F.count_if(~F.col("got").isin(*VERDICTS)).alias("unlabelled"), F.count_if(excluding).alias("exclusion_of"), F.count_if(excluding & (F.lower(F.trim("exclusion_code")) == F.col("expected_exclusion"))).alias("exclusion_matched"))
    return agg.withColumn("min_correct", F.ceil(F.col("items") * pass_share - 1e-9)).withColumn("passed", F.col("correct") >= F.col("min_correct"))


def gate(repos: DataFrame, degenerate: float = 0.97, least: int = 10) -> DataFrame:
    """One row over repositories of enough changes: macro (mean of rates) and micro (rate of sums) marker coverage, and what base rates call for.

    ``repos``: ``repo, qualifies, eligible, marked, at_floor, survived_rate``.
    """
    q = repos.where("qualifies")
    agg = q.agg(
        F.count(F.lit(1)).alias("qualifying"), F.count_if("at_floor").alias("at_marker_floor"), F.avg(F.col("marked") / F.col("eligible")).alias("macro"), F.sum("marked").alias("__m"), F.sum("eligible").alias("__e"), F.min("survived_rate").alias("__least"),
    )
    call = F.when(F.col("qualifying") < least, "insufficient_repos").when(F.col("__least") > degenerate, "degenerate_by_program_rule").otherwise("nondegenerate_base_rates")
    return agg.select("qualifying", "at_marker_floor", X.round4(F.col("macro")).alias("macro"), F.when(F.col("__e") > 0, X.round4(F.col("__m") / F.col("__e"))).alias("micro"), call.alias("label_call"))


def label_cross_tabs(labels: DataFrame) -> DataFrame:
    """By horizon: outcomes, who undid, and followups known by links only, by ranges only, and by both; ``labels``: ``horizon_days, report_outcome, undone_by, reason_codes``."""
    link, lines = F.array_contains("reason_codes", "linked_issue_or_pr"), F.array_contains("reason_codes", "line_range_followup")
    outcome, by = F.col("report_outcome"), F.col("undone_by")
    return labels.groupBy("horizon_days").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(outcome.isNull()).alias("missing"), *[F.count_if(outcome == o).alias(o) for o in ("survived", "followup", "substantially_rewritten", "reverted")],
        *[F.count_if(by == a).alias(f"undone_by_{a}") for a in ("human", "agent")], F.count_if(link & ~lines).alias("only_linked"), F.count_if(lines & ~link).alias("only_range"), F.count_if(link & lines).alias("both"),
    )


def unmapped_audit(unmapped: DataFrame, most: int = 50, by: str = "repo") -> DataFrame:
    """A systematic sample of at most about ``most`` unmapped commits of each repository in their order: how many belong to a change after all, and the share of direct pushes."""
    w = Window.partitionBy(by)
    placed = unmapped.withColumn("__i", F.row_number().over(w.orderBy("position")) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    step = F.greatest(F.lit(1), F.floor(F.col("__n") / most))
    drawn = placed.where(F.pmod(F.col("__i"), step) == 0)
    n, mapped = F.count(F.lit(1)), F.count_if("has_change")
    return drawn.groupBy(by).agg(n.alias("sampled"), mapped.alias("missed"), X.round4((n - mapped) / n).alias("direct_push_share"), F.max("__n").alias("unmapped"))


def report_rows(rows: DataFrame, at: str = "merged_at", key: str = "pr") -> DataFrame:
    """In the report's order: by merge, then number."""
    return rows.orderBy(at, key)


def newest(rows: DataFrame, n: int, order: str = "position") -> DataFrame:
    """The last ``n`` rows by ``order``."""
    return rows.orderBy(F.desc(order)).limit(n)


def outcome_shares(rows: DataFrame, outcome: str = "outcome", by: Sequence[str] = ("horizon_days",)) -> DataFrame:
    """``by, outcome, n, of, value, ci_low, ci_high``: the share of each outcome among labelled rows, with its interval."""
    known = rows.where(F.col(outcome).isNotNull())
    counted = known.groupBy(*by, F.col(outcome).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    total = counted.withColumn("of", F.sum("n").over(Window.partitionBy(*by)))
    low, high = X.wilson(F.col("n"), F.col("of"))
    return total.select(*by, "outcome", "n", "of", X.round4(F.col("n") / F.col("of")).alias("value"), low.alias("ci_low"), high.alias("ci_high"))


def related_changes(changes: DataFrame, files: DataFrame, fixes: DataFrame, horizon_days: int, most_files: int = 50, most: int = 15) -> DataFrame:
    """``pr, related, rank``: the earliest ``most`` later changes within the horizon that touch a change's first ``most_files`` files and aren't its known fixes.

    ``changes``: ``repo, pr, merged_at`` (seconds), ``files``: ``repo, pr, path``. Files meet in buckets of time as long as the horizon, two for each change.
    """
    span = horizon_days * 86_400
    own = files.withColumn("__n", F.row_number().over(Window.partitionBy("repo", "pr").orderBy("path"))).where(F.col("__n") <= most_files).drop("__n").join(changes, ["repo", "pr"])
    bucket = F.floor(F.col("merged_at") / span)
    early = own.select("repo", "path", "pr", "merged_at", F.explode(F.array(bucket, bucket + 1)).alias("bucket"))
    late = files.join(changes, ["repo", "pr"]).select("repo", "path", F.col("pr").alias("related"), F.col("merged_at").alias("at"), bucket.alias("bucket"))
    met = early.join(late, ["repo", "path", "bucket"]).where((F.col("at") > F.col("merged_at")) & (F.col("at") <= F.col("merged_at") + span) & (F.col("related") != F.col("pr")))
    other = met.select("repo", "pr", "related", "at").distinct().join(fixes.select("pr", F.col("fix").alias("related")), ["pr", "related"], "left_anti")
    return other.withColumn("rank", F.row_number().over(Window.partitionBy("repo", "pr").orderBy("at", "related"))).where(F.col("rank") <= most).select("repo", "pr", "related", "rank")


def cohort_probe(changes: DataFrame, slices: Sequence[tuple[str, str, str]], thresholds: dict[str, float]) -> DataFrame:
    """By repository and slice of time: merged, unmerged and reverting changes, their shares to three places, and whether all thresholds hold.

    ``changes``: ``repo, created_at, merged, title``; ``slices``: (name, from, until), half open.
    """
    name = F.coalesce(*[F.when((F.col("created_at") >= F.lit(a).cast("timestamp")) & (F.col("created_at") < F.lit(z).cast("timestamp")), n) for n, a, z in slices])
    reverting = F.col("title").rlike(r"(?i)^\s*revert\b")
    agg = changes.withColumn("slice", name).where("slice is not null").groupBy("repo", "slice").agg(F.count(F.lit(1)).alias("changes"), F.count_if("merged").alias("merged"), F.count_if(F.col("merged") & reverting).alias("reverts"))
    shares = agg.withColumns({"merged_share": X.round_half_up(F.col("merged") / F.col("changes"), 3), "revert_share": F.when(F.col("merged") > 0, X.round_half_up(F.col("reverts") / F.col("merged"), 3))})
    holds: Column = F.lit(True)
    for column, least in thresholds.items():
        holds = holds & F.coalesce(F.col(column) >= least, F.lit(False))
    return shares.withColumn("passes", holds)
