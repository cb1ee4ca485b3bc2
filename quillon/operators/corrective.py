"""Which later change repaired which earlier one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X

DAY = 86_400
# Admitted proxies in contract order, and the order of confidence.
PROXIES = ("revert", "repair_reference", "regression_issue", "szz")
CONFIDENCE = ("low", "medium", "high")


def candidates(originals: DataFrame, fixes: DataFrame, most_days: int = 60) -> DataFrame:
    """Fix events of an original with a lag of one second to ``most_days``; one row for each original, fix and proxy.

    ``fixes`` has an ``ordinal``: evidence of repeats is merged in that order, each piece once, and the
    first exclusion that isn't null stands.
    """
    lag = F.unix_timestamp("fixed_at") - F.unix_timestamp("merged_at")
    met = originals.join(fixes, "pr").withColumn("lag_seconds", lag).where(F.col("lag_seconds").between(1, most_days * DAY))
    first = met.groupBy("pr", "fix", "proxy", "evidence").agg(F.min("lag_seconds").alias("lag_seconds"), F.min("ordinal").alias("ordinal"), F.min(F.when(F.col("exclusion").isNotNull(), F.struct("ordinal", "exclusion"))).alias("excluded"))
    grouped = first.groupBy("pr", "fix", "proxy").agg(
        F.min("lag_seconds").alias("lag_seconds"), F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "evidence"))), lambda x: x["evidence"]).alias("evidence"), F.min("excluded")["exclusion"].alias("exclusion"),
    )
    return grouped.select(X.sha_id([F.col("pr"), F.col("fix"), F.col("proxy")]).alias("candidate_id"), "*", F.when(F.col("exclusion").isNull(), "accepted").otherwise("rejected").alias("status"))


def corrective_labels(changes: DataFrame, pairs: DataFrame, horizons: tuple[int, ...] = (14, 30, 60)) -> DataFrame:
    """For each change and horizon: was it repaired in (merge, merge + horizon]?

    Null without a base label; else confidence is the highest of its pairs, reasons are their
    proxies in contract order, and ids are sorted and distinct. Pairs are gathered once a change,
    with their lags, and every horizon is read off them.
    """
    rank = F.array_position(F.array(*[F.lit(c) for c in CONFIDENCE]), F.col("confidence"))
    admitted = pairs.where(F.col("proxy").isin(*PROXIES) & (F.col("lag_seconds") > 0)).select("pr", F.struct("candidate_id", "proxy", rank.cast("int").alias("rank"), "lag_seconds").alias("pair"))
    each = changes.select("pr", "has_label").join(admitted.groupBy("pr").agg(F.collect_list("pair").alias("pairs")), "pr", "left")
    rows = each.withColumn("horizon_days", F.explode(F.array(*[F.lit(h) for h in horizons])))
    own = rows.withColumn("own", F.filter(F.coalesce("pairs", F.array().cast(each.schema["pairs"].dataType)), lambda p: p["lag_seconds"] <= F.col("horizon_days") * DAY))
    ordered = F.filter(F.array(*[F.lit(p) for p in PROXIES]), lambda p: F.exists("own", lambda x: x["proxy"] == p))
    known, n = F.col("has_label"), F.size("own")
    top = F.array_max(F.transform("own", lambda p: p["rank"]))
    return own.select(
        "pr", "horizon_days", F.when(known, n > 0).alias("corrective"), F.when(known & (n > 0), F.element_at(F.array(*[F.lit(c) for c in CONFIDENCE]), top)).alias("confidence"),
        F.when(~known, F.array(F.lit("base_label_missing"))).when(n == 0, F.array(F.lit("no_accepted_fix"))).otherwise(ordered).alias("reason_codes"),
        F.when(known, F.array_sort(F.array_distinct(F.transform("own", lambda p: p["candidate_id"])))).otherwise(F.array().cast("array<string>")).alias("repair_pair_ids"),
    )


def corrective_summary(candidates: DataFrame, originals: DataFrame) -> DataFrame:
    """``measure, name, n``: candidates by proxy and status, by exclusion, and originals with an accepted fix, in all and as a share of ten thousand."""
    by = candidates.select(F.explode(F.array(F.struct(F.lit("proxy_status").alias("measure"), F.concat_ws(":", "proxy", "status").alias("name")), F.struct(F.lit("exclusion").alias("measure"), F.col("exclusion").alias("name")))).alias("m")).where("m.name is not null")
    counted = by.groupBy("m.measure", "m.name").agg(F.count(F.lit(1)).alias("n"))
    fixed = candidates.where("status = 'accepted'").agg(F.count_distinct("pr").alias("n")).crossJoin(originals.agg(F.count(F.lit(1)).alias("all")))
    share = F.when(F.col("all") > 0, F.floor(F.col("n") * 10000 / F.col("all") + 0.5)).cast("long")
    told = fixed.select(F.explode(F.array(F.struct(F.lit("originals").alias("measure"), F.lit("with_fix").alias("name"), F.col("n")), F.struct(F.lit("originals").alias("measure"), F.lit("share_e4").alias("name"), share.alias("n")))).alias("m"))
    return counted.union(told.select("m.*"))


def corpus_summary(labels: DataFrame) -> DataFrame:
    """Counts of true, false and unknown by repository and horizon, with rate and Wilson interval."""
    true, false = F.count_if("corrective"), F.count_if(~F.col("corrective"))
    counted = labels.groupBy("repo", "horizon_days").agg(F.count(F.lit(1)).alias("n_rows"), true.alias("n_true"), false.alias("n_false"), F.count_if(F.col("corrective").isNull()).alias("n_unknown"))
    known = F.col("n_true") + F.col("n_false")
    low, high = X.wilson(F.col("n_true"), known)
    return counted.select("*", F.when(known > 0, X.round4(F.col("n_true") / known)).alias("rate"), low.alias("ci_low"), high.alias("ci_high"))


def convention_spread(repos: DataFrame) -> DataFrame:
    """For each convention the repositories with the least and the largest rate; ties go to the smaller name."""
    first = F.struct("rate", "repo")
    last = F.struct(-F.col("rate"), "repo")
    kept = repos.where(F.col("rate").isNotNull())
    agg = kept.groupBy("convention").agg(F.count(F.lit(1)).alias("repos"), F.min("rate").alias("least"), F.max("rate").alias("largest"), F.min(first).alias("a"), F.min(last).alias("z"))
    return agg.select("convention", "repos", "least", F.col("a.repo").alias("least_repo"), "largest", F.col("z.repo").alias("largest_repo"))


def owner_of_prefix(prefixes: DataFrame, commits: DataFrame, digits: int = 7) -> DataFrame:
    """The commit that a SHA's beginning names; null if several or none do."""
    one = prefixes.withColumn("__key", F.substring("prefix", 1, digits))
    two = commits.select("sha", F.substring("sha", 1, digits).alias("__key"))
    met = one.join(two, "__key").where(F.col("sha").startswith(F.col("prefix")))
    found = met.groupBy("prefix").agg(F.when(F.count_distinct("sha") == 1, F.max("sha")).alias("sha"))
    return prefixes.select("prefix").distinct().join(found, "prefix", "left")


def issue_originals(citations: DataFrame, most: int = 3) -> DataFrame:
    """Originals that an issue cites after their merge; an issue with more than ``most`` names none."""
    later = citations.where("cited_at > merged_at").groupBy("issue").agg(F.array_sort(F.collect_set("pr")).alias("prs"))
    return later.where(F.size("prs") <= most)
