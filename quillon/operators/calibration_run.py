"""Scoring of a labelled sample: how precise proxies and definitions are, how much they catch, which definition is picked, and whose labels count.

``items``: ``item_id, ordinal, repo, stratum, proxies`` (an array), ``candidates`` (an array of ``proxy, status, blamed_lines, revert_reason,
exclusion_code``), ``audit``; ``cells``: ``repo, stratum, population``; a sheet: ``item_id, verdict, cause_code, exclusion_code``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import calibration
from .bootstrap import bootstrap
from .population import PRIORITY, VERDICTS

# Strata of a sample in their order.
STRATA = ("revert", "repair_reference", "regression_issue", "szz_strong", "szz_weak", "rejected", "negative")


@dataclass(frozen=True)
class Plan:
    """What was settled before labelling."""

    kappa_floor: float = 0.6
    precision_floor: float = 0.6
    strong_lines: int = 3
    pick_needs_human_precision: bool = True
    default_definition: str = "cr-0.1.0"


def definitions(plan: Plan) -> list[tuple[str, bool, object]]:
    """Name, may it be picked, and which accepted candidates count; in the order in which ties are settled."""
    def strong(c: Column) -> Column:
        return (c["proxy"] != "szz") | (F.coalesce(c["blamed_lines"], F.lit(0)) >= plan.strong_lines)

    def public(c: Column) -> Column:
        return (c["proxy"] != "revert") | ~F.coalesce(c["revert_reason"] == "internal_build", F.lit(False))

    szz = f"szz_min_{plan.strong_lines}"
    return [
        (plan.default_definition, True, lambda c: F.lit(True)), ("high_precision", True, lambda c: c["proxy"].isin("revert", "repair_reference")), (szz, True, strong), ("no_internal_build", True, public),
        (f"{szz}+no_internal_build", True, lambda c: strong(c) & public(c)), ("defect_repair", False, lambda c: c["proxy"].isin("repair_reference", "regression_issue")),
    ]


def decided(items: DataFrame, cells: DataFrame, sheet: DataFrame) -> DataFrame:
    """Items that a sheet says yes or no to, each with ``weight``: its cell's population over the cell's decided items."""
    met = items.join(sheet.where(F.col("verdict").isin("yes", "no")), "item_id")
    n = met.groupBy("repo", "stratum").agg(F.count(F.lit(1)).alias("__n"))
    sized = n.join(cells.select("repo", "stratum", "population"), ["repo", "stratum"], "left").select("repo", "stratum", (F.coalesce("population", F.lit(0)) / F.col("__n")).alias("weight"))
    return met.join(sized, ["repo", "stratum"])


def strata_table(items: DataFrame, sheet: DataFrame) -> DataFrame:
    """``stratum, sampled, yes, no, unclear, unlabelled, yes_rate, ci_low, ci_high``, a row for every stratum in order of ``place``."""
    met = items.join(sheet.select("item_id", "verdict"), "item_id", "left").groupBy("stratum").agg(F.count(F.lit(1)).alias("sampled"), *[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS], F.count_if(F.col("verdict").isNull()).alias("unlabelled"))
    names = F.array(*[F.lit(s) for s in STRATA])
    every = items.sparkSession.range(1).select(F.posexplode(names).alias("place", "stratum"))
    full = every.join(met, "stratum", "left").select("place", "stratum", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("sampled", *VERDICTS, "unlabelled")])
    low, high = X.wilson(F.col("yes"), F.col("yes") + F.col("no"))
    return full.select("*", X.ratio4(F.col("yes"), F.col("yes") + F.col("no")).alias("yes_rate"), low.alias("ci_low"), high.alias("ci_high"))


def estimates(items: DataFrame, cells: DataFrame, sheet: DataFrame, plan: Plan, seed: str, resamples: int = 2000) -> DataFrame:
    """``scope, name, place, may_pick, measure, estimate, ci_low, ci_high, n``: precision and recall of each proxy, definition and repository.

    Precision: the weighted share of yes among items that are positive; recall: of yes items, the share that is positive. ``n``: decided items that it rests on.
    """
    rows = decided(items, cells, sheet)
    counted = F.filter("candidates", lambda c: (c["status"] == "accepted") & F.array_contains("proxies", c["proxy"]))
    tests = [("proxy", p, i, True, F.array_contains("proxies", p), F.lit(True)) for i, p in enumerate(PRIORITY)]
    tests += [("definition", name, i, pick, F.exists(counted, keep), F.lit(True)) for i, (name, pick, keep) in enumerate(definitions(plan))]
    one = [F.struct(F.lit(scope).alias("scope"), F.lit(name).alias("name"), F.lit(i).alias("place"), F.lit(pick).alias("may_pick"), positive.alias("positive")) for scope, name, i, pick, positive, _ in tests]
    own = F.struct(F.lit("repo").alias("scope"), F.col("repo").alias("name"), F.lit(0).alias("place"), F.lit(True).alias("may_pick"), (F.size("proxies") > 0).alias("positive"))
    each = rows.select("ordinal", "repo", "stratum", "weight", (F.col("verdict") == "yes").alias("yes"), F.explode(F.array(*one, own)).alias("t")).select("ordinal", F.concat_ws("\0", "repo", "stratum").alias("cell"), "weight", "yes", "t.*")
    both = each.withColumn("measure", F.explode(F.array(F.lit("precision"), F.lit("recall"))))
    relevant = F.when(F.col("measure") == "precision", F.col("positive")).otherwise(F.col("yes"))
    tag = F.create_map(*[F.lit(x) for kv in {"proxy": "", "definition": "d", "repo": "r"}.items() for x in kv])[F.col("scope")]
    key = F.concat(tag, F.substring("measure", 1, 1), F.lit(":"), F.col("name"))
    ready = both.select(key.alias("key"), "cell", "ordinal", F.when(relevant, F.col("weight")).otherwise(0.0).alias("den"), F.when(relevant & F.col("positive") & F.col("yes"), F.col("weight")).otherwise(0.0).alias("num"), relevant.alias("relevant"), "scope", "name", "place", "may_pick", "measure")
    share = F.when(F.sum("den") > 0, F.sum("num") / F.sum("den"))
    found = bootstrap(ready.select("key", "cell", "ordinal", "den", "num"), share, F.concat_ws("\0", F.lit(seed), F.col("key")), "key", resamples).drop("n")
    about = ready.groupBy("key", "scope", "name", "place", "may_pick", "measure").agg(F.count_if("relevant").alias("n"))
    return about.join(found, "key").select("scope", "name", "place", "may_pick", "measure", "estimate", "ci_low", "ci_high", "n")


def picked(found: DataFrame, plan: Plan, also: DataFrame | None = None) -> DataFrame:
    """One row, ``definition``: of those that may be picked and whose precision is at the floor (in ``also`` too) the one of the highest recall, the earlier of equals; null if none qualifies."""
    def precise(estimated: DataFrame) -> DataFrame:
        return estimated.where((F.col("scope") == "definition") & (F.col("measure") == "precision") & F.col("may_pick") & (F.col("estimate") >= plan.precision_floor)).select("name", "place")

    ok = precise(found)
    if also is not None:
        ok = ok.join(precise(also).select("name"), "name", "left_semi")
    recall = found.where("scope = 'definition' and measure = 'recall'").select("name", F.coalesce("estimate", F.lit(0.0)).alias("recall"))
    return ok.join(recall, "name").agg(F.max_by("name", F.struct("recall", -F.col("place"))).alias("definition"))


def rejections(items: DataFrame, sheet: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the rejected stratum: how many a person judged corrective after all; and of those judged not, automatic code against human code."""
    met = items.where("stratum = 'rejected'").join(sheet, "item_id")
    n = met.agg(F.count_if(F.col("verdict") == "yes").alias("yes"), F.count_if(F.col("verdict").isin("yes", "no")).alias("decided"))
    low, high = X.wilson(F.col("yes"), F.col("decided"))
    wrong = n.select("yes", "decided", X.ratio4(F.col("yes"), F.col("decided")).alias("rate"), low.alias("ci_low"), high.alias("ci_high"))
    auto = F.explode(F.array_distinct(F.transform("candidates", lambda c: F.coalesce(c["exclusion_code"], F.lit("(accepted)")))))
    codes = met.where("verdict = 'no'").select(auto.alias("automatic"), F.coalesce("exclusion_code", F.lit("(none)")).alias("human")).groupBy("automatic", "human").agg(F.count(F.lit(1)).alias("n"))
    return wrong, codes


def linkage_errors(items: DataFrame, sheet: DataFrame) -> DataFrame:
    """``proxy, no, linkage_error, rate``: of a proxy's items that a person said no to, those whose link was wrong."""
    met = items.join(sheet.where("verdict = 'no'"), "item_id").select(F.explode("proxies").alias("proxy"), (F.col("exclusion_code") == "linkage_error").alias("wrong"))
    n = met.groupBy("proxy").agg(F.count(F.lit(1)).alias("no"), F.count_if("wrong").alias("linkage_error"))
    every = items.sparkSession.range(1).select(F.explode(F.array(*[F.lit(p) for p in PRIORITY])).alias("proxy"))
    full = every.join(n, "proxy", "left").select("proxy", F.coalesce("no", F.lit(0)).alias("no"), F.coalesce("linkage_error", F.lit(0)).alias("linkage_error"))
    return full.select("*", X.ratio4(F.col("linkage_error"), F.col("no")).alias("rate"))


def causes(items: DataFrame, cells: DataFrame, sheet: DataFrame) -> DataFrame:
    """``cause_code, raw, weighted_share`` of yes items."""
    rows = decided(items, cells, sheet).where("verdict = 'yes'").groupBy("cause_code").agg(F.count(F.lit(1)).alias("raw"), F.sum("weight").alias("__w"))
    return rows.select("cause_code", "raw", X.round4(F.col("__w") / F.sum("__w").over(Window.partitionBy())).alias("weighted_share"))  # a row a cause


def agreement(items: DataFrame, one: DataFrame, two: DataFrame) -> DataFrame:
    """``field, pairs, kappa`` of two sheets over the items that both labelled: verdict, cause, and of two noes the exclusion."""
    def side(sheet: DataFrame, name: str) -> DataFrame:
        exclusion = F.when(F.col("verdict") == "no", F.coalesce("exclusion_code", F.lit("(none)")))
        return sheet.select("item_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), v.alias(name)) for f, v in (("corrective", F.col("verdict")), ("cause_code", F.col("cause_code")), ("exclusion_code", exclusion))])).alias("s")).select("item_id", "s.*")

    pairs = items.select("item_id").join(side(one, "x"), "item_id").join(side(two, "y"), ["item_id", "field"]).where("x is not null and y is not null")
    return calibration.kappa(pairs, ["field"])


def score_calibration(items: DataFrame, cells: DataFrame, sheet: DataFrame, other: DataFrame, plan: Plan, seed: str, resamples: int = 2000) -> dict[str, DataFrame]:
    """A frame for each table of the report, from one sheet and its agreement with another."""
    found = estimates(items, cells, sheet, plan, seed, resamples)
    wrong, codes = rejections(items, sheet)
    names = F.row_number().over(Window.partitionBy().orderBy(X.sha_id([F.lit(seed), F.lit("pseudonym"), F.col("repo")])))  # a row a repository
    repos = items.groupBy("repo").agg(F.count(F.lit(1)).alias("sampled")).select("repo", F.concat(F.lit("R"), names).alias("pseudonym"), "sampled")
    seen = decided(items, cells, sheet).select("repo", "stratum").distinct()
    counts = items.join(sheet.select("item_id", "verdict"), "item_id", "left").agg(F.count(F.lit(1)).alias("items"), F.count("verdict").alias("labelled"), F.count_if(F.col("verdict").isNull()).alias("unlabelled"), F.count_if(F.col("verdict") == "unclear").alias("unclear"))
    missed = cells.join(seen, ["repo", "stratum"], "left_anti").agg(F.coalesce(F.sum("population"), F.lit(0)).alias("unrepresented_population"))
    return {
        "counts": counts.join(missed), "strata": strata_table(items, sheet), "estimates": found, "chosen": picked(found, plan), "repos": repos, "wrongly_rejected": wrong, "rejected_by_code": codes,
        "linkage_error": linkage_errors(items, sheet), "causes": causes(items, cells, sheet), "agreement": agreement(items, sheet, other),
    }


def score_run(items: DataFrame, cells: DataFrame, model: DataFrame, second: DataFrame, human: DataFrame, plan: Plan, seed: str, resamples: int = 2000) -> tuple[dict[str, DataFrame], dict[str, DataFrame], DataFrame]:
    """The tables by the model's labels, those by a person's labels of the audited items, and one row of what follows.

    Model labels stand in for a person's if both agree on the verdict at the floor of kappa; else the person's are primary. If
    they stand in and the plan asks for it, the pick must be precise by both. ``gate_definition`` (the pick, else the default) is held against the person's labels.
    """
    by_model = score_calibration(items, cells, model, second, plan, seed, resamples)
    audited = items.where("audit")
    by_person = score_calibration(audited, cells, human, model, plan, seed, resamples)
    stands = by_person["agreement"].where("field = 'corrective'").agg(F.coalesce(F.max(F.col("kappa") >= plan.kappa_floor), F.lit(False)).alias("models_stand_in"))
    both = picked(by_model["estimates"], plan, by_person["estimates"]) if plan.pick_needs_human_precision else by_model["chosen"]
    rule = "primary_and_human" if plan.pick_needs_human_precision else "primary"
    # one row each
    met = reduce(lambda a, b: a.join(b), [stands, both.withColumnRenamed("definition", "__both"), by_person["chosen"].withColumnRenamed("definition", "__person")])
    run = met.select(
        "models_stand_in", F.when(F.col("models_stand_in"), "model").otherwise("human").alias("primary"), F.when(F.col("models_stand_in"), F.col("__both")).otherwise(F.col("__person")).alias("chosen_definition"), F.when(F.col("models_stand_in"), rule).otherwise("primary").alias("pick_rule")
    ).withColumn("gate_definition", F.coalesce("chosen_definition", F.lit(plan.default_definition)))
    precision = by_person["estimates"].where("scope = 'definition' and measure = 'precision'").select(F.col("name").alias("gate_definition"), F.col("estimate").alias("gate_precision"), F.col("n").alias("gate_items"))
    return by_model, by_person, run.join(precision, "gate_definition", "left").select("models_stand_in", "primary", "chosen_definition", "pick_rule", "gate_definition", "gate_precision", "gate_items")
