"""Landings, citations, survival paths, evidence and populations over every row of orders, lineitem, events and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attempts, attribution, citations, contracts, evidence, forward, population
from . import bindings as B
from .change_queries import COMMITS, _epoch, _wilson

# orders as commits of one line, oldest first, whose subjects name changes in five ways; every order is a change too
_SUBJECT = "case o_orderkey % 5 when 0 then concat('Merge #', cast(o_orderkey as {text}), ' #', cast(o_orderkey + 1 as {text})) when 1 then concat('Fix (#', cast(o_orderkey as {text}), ')') when 2 then 'no number' when 3 then concat('Auto merge of #', cast(o_orderkey - 3 as {text}), ' - a:b') else 'squashed' end"
LINE = f"select 'o/r' as repo, o_orderkey as position, concat('c', cast(o_orderkey as {{text}})) as sha, {_SUBJECT} as subject, case when o_orderkey % 7 = 0 then concat('Pull Request resolved: https://github.com/o/r/pull/', cast(o_orderkey + 2 as {{text}})) else '' end as body from orders"
LANDED = "select 'o/r' as repo, o_orderkey as pr, case when o_orderkey % 2 = 0 then concat('c', cast(o_orderkey as {text})) end as merge_sha from orders"


def _landed(s: SparkSession, d: str) -> DataFrame:
    return citations.landed_changes(B.project(s, d, LINE), B.project(s, d, LANDED)).drop("repo")


def _owners(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    sha = lambda x: F.concat(F.lit("c"), x.cast("string"))
    # every order is a change; what landed elsewhere owns nothing
    changes = B.read(s, d, "orders").select(
        F.lit("o/r").alias("repo"), k.alias("pr"), sha(k).alias("merge_sha"), sha(k - 10).alias("base_sha"), (k % 3).alias("member_commits"), F.when((k % 50 == 0) | (k % 10 != 0), F.lit("elsewhere")).alias("landed_sha"), F.when(k % 40 == 0, F.array(sha(k + 10))).alias("relanded"),
    )
    return citations.landing_index(changes, B.project(s, d, LINE).select("repo", "sha", "position")).drop("repo")


def _events_of_fixes(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = B.read(s, d, "orders")
    base = [F.lit("o/r").alias("repo"), F.concat(F.lit("c"), k.cast("string")).alias("sha")]
    fixes = rows.where("o_orderkey % 2 = 0").select(*base, k.alias("pr"), F.lit("fix").alias("title"), F.lit("b").alias("body"), F.col("o_orderdate").alias("at"))
    reverts = rows.where("o_orderkey % 3 = 0").select(*base, F.lit("Revert").alias("subject"), F.lit("why").alias("body"), F.col("o_orderdate").alias("at"))
    return citations.fix_events(fixes, reverts).select("sha", "pr", "title", "body")


#: lineitem as hunks of the order: every third a deletion.
HUNKS = "select distinct l_orderkey as pr, concat('f', cast(l_linenumber as {text})) as path, l_suppkey as first, l_suppkey + cast(l_quantity as bigint) as last, l_suppkey % 3 = 0 as deleted from lineitem"


def _hunks(s: SparkSession, d: str) -> DataFrame:
    rows = B.project(s, d, HUNKS)
    side = lambda c, when: F.when(F.col("deleted") if when else ~F.col("deleted"), F.col(c))
    return rows.select("pr", "path", F.col("path").alias("old_path"), side("first", True).alias("old_start"), side("last", True).alias("old_end"), side("first", False).alias("new_start"), side("last", False).alias("new_end"))


def _moves(s: SparkSession, d: str) -> DataFrame:
    rows = B.project(s, d, HUNKS).select("pr", "path").distinct()
    k = F.col("pr") + F.length("path") + F.substring("path", 2, 1).cast("long")
    return rows.where(k % 4 < 3).select("pr", F.when(k % 4 == 0, "D").when(k % 4 == 1, "R").otherwise("M").alias("status"), F.when(k % 4 == 1, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")).alias("path"), F.when(k % 4 == 1, F.col("path")).alias("previous_path"))


def _reverted(s: SparkSession, d: str) -> DataFrame:
    files = forward.substrate(_hunks(s, d))
    fates = forward.file_fates(files, _moves(s, d))
    at = lambda side, blob, path="path": files.join(fates, ["pr", "path"]).where(F.col(path).isNotNull()).select("pr", F.lit(side).alias("side"), F.col(path).alias("path"), blob.alias("blob"))
    old = F.concat(F.lit("o"), "path")
    k = F.col("pr") % 5
    blobs = at("parent", old).union(at("merge", F.when(k == 0, old).otherwise(F.lit("new")))).union(at("terminal", F.when(k <= 1, F.concat(F.lit("o"), F.regexp_replace("terminal_path", "^moved/", ""))).otherwise(F.lit("new")), "terminal_path"))
    return forward.reverted_files(files, fates, blobs.where("not (side = 'terminal' and pr % 7 = 0)"))


def _blamed(s: SparkSession, d: str) -> DataFrame:
    rows = B.read(s, d, "lineitem").select(F.col("l_orderkey").alias("fix"), F.concat(F.lit("f"), (F.col("l_linenumber") % 2).cast("string")).alias("path"), (F.col("l_suppkey") % 20).cast("long").alias("first"), (F.col("l_suppkey") % 20 + F.col("l_quantity") % 7).cast("long").alias("last"))
    lines = s.range(0, 30).withColumnRenamed("id", "line")
    fixes = rows.select("fix", "path").distinct()
    blame = fixes.join(F.broadcast(lines)).select("fix", "path", "line", F.concat(F.lit("c"), ((F.col("fix") + F.col("line")) % 6).cast("string")).alias("sha"), (F.col("line") % 9 == 0).alias("boundary"), F.when(F.col("line") % 8 == 0, "  ").otherwise("x").alias("text"))
    owners = s.createDataFrame([("c0", 100), ("c1", 101), ("c2", 100), ("c4", 104)], "sha string, pr long")
    return forward.blamed_originals(rows, blame, owners)


def _linked(s: SparkSession, d: str) -> DataFrame:
    each = B.read(s, d, "orders").select(F.col("o_orderkey").alias("pr"), F.unix_timestamp("o_orderdate").alias("merged_at"), F.explode(F.array(F.lit(14), F.lit(30))).alias("horizon_days"))
    refs = B.read(s, d, "lineitem").select(F.col("l_orderkey").alias("pr"), F.unix_timestamp("l_shipdate").alias("created_at"), (F.col("l_returnflag") != "N").alias("qualifies"))
    return forward.linked(each.withColumn("cutoff", F.col("merged_at") + F.col("horizon_days") * 86_400), refs)


def _survival(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    each = B.read(s, d, "orders").select(k, F.unix_timestamp("o_orderdate").alias("merged_at"), F.explode(F.array(F.lit(14), F.lit(60))).alias("horizon_days"))
    rows = each.select(
        k.alias("pr"), "horizon_days", "merged_at", F.when(k % 13 != 0, k % 11).alias("lines"), F.when(k % 17 != 0, F.lit("t")).alias("terminal_sha"), F.least(k % 11, k % 7).alias("surviving"), (k % 19 == 0).alias("reverted"), (k % 3 == 0).alias("range_followup"), (k % 5 == 0).alias("linked"), (k % 23 == 0).alias("redispatched"),
        (k % 29 == 0).alias("pre_merge_human_edit"), F.lit("human").alias("undone_by"),
    )
    out = forward.survival_labels(rows, F.lit(880_000_000))
    return out.select("pr", "horizon_days", "survived", "survival_ratio", "reverted", "followup", "undone_by", F.array_join("reason_codes", ",").alias("reason_codes"), "report_outcome")


def _files(s: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "R", "D").otherwise("M")
    path = F.concat(F.when(F.col("l_suppkey") % 4 == 0, "tests/").otherwise("src/"), F.col("l_partkey").cast("string"), F.lit(".py"))
    return B.read(s, d, "lineitem").select(F.col("l_orderkey").alias("pr"), path.alias("path"), status.alias("status"), F.when(F.col("l_suppkey") % 9 != 0, F.col("l_quantity").cast("long")).alias("added"), F.col("l_linenumber").cast("long").alias("deleted"))


def _checks(s: SparkSession, d: str) -> DataFrame:
    return B.read(s, d, "events").select(F.col("user_id").alias("pr"), F.when(F.col("event_id") % 3 == 0, "Unit Tests").otherwise("build").alias("name"), F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "click", "pass").otherwise("skipped").alias("state"), F.col("ts").alias("at"))


def _frames(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    one = B.read(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 7).alias("a"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("b"), F.lit(1).alias("c"))
    two = one.where("o_orderkey % 11 <> 0").withColumn("a", F.when(F.col("o_orderkey") % 3 == 0, F.col("a") + 1).otherwise(F.col("a"))).withColumn("b", F.when(F.col("o_orderkey") % 10 == 0, "x").otherwise(F.col("b")))
    return one, two


def _differing(s: SparkSession, d: str) -> DataFrame:
    return evidence.differing_columns(*_frames(s, d), ["o_orderkey"])


def _truncated(s: SparkSession, d: str) -> DataFrame:
    reviews = B.read(s, d, "events").groupBy(F.col("user_id").alias("pr")).agg(F.array_sort(F.collect_list(F.struct(F.col("ts").alias("at"), "event_type"))).alias("reviews"))
    as_of = F.expr("timestamp '2024-01-15 12:00:00'")
    later = evidence.with_later_activity(reviews, as_of, "reviews", {"event_type": F.lit("made up")})
    cut = evidence.truncated(later, as_of)
    return cut.select("pr", F.size("reviews").alias("n"), F.exists("reviews", lambda r: r["event_type"] == "made up").alias("leaks"))


def _strata(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = B.read(s, d, "orders").select(k, F.col("o_orderstatus").alias("repo"), (k % 10 == 0).alias("baseline"), (k % 4 == 0).alias("generic_bot"), *[(k % (i + 11) == 0).alias(n) for i, n in enumerate(attribution.SIGNALS)])
    return rows


def _population(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    cands = B.read(s, d, "lineitem").select(
        F.col("l_orderkey").alias("pr"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("candidate_id"), F.when(F.col("l_returnflag") == "R", "revert").when(F.col("l_returnflag") == "A", "regression_issue").otherwise("szz").alias("proxy"),
        (F.col("l_quantity") * 86_400).cast("long").alias("lag_seconds"), F.col("l_linenumber").alias("blamed_lines"),
    ).distinct()
    accepted = cands.where("lag_seconds <= 2592000 and blamed_lines % 2 = 1").groupBy("pr").agg(F.collect_list("candidate_id").alias("repair_pair_ids"))
    rows = B.read(s, d, "orders").select(k.alias("pr"), F.lit(30).alias("horizon_days")).join(accepted, "pr", "left")
    labelled = rows.withColumn("corrective", F.when(F.col("pr") % 9 != 0, F.col("repair_pair_ids").isNotNull())).withColumn("repair_pair_ids", F.coalesce("repair_pair_ids", F.array().cast("array<string>")))
    return population.classify_population(labelled, cands, 30, 4).select("pr", "stratum", "n_candidates")


def _variants(s: SparkSession, d: str) -> DataFrame:
    rows = B.read(s, d, "lineitem").select(F.col("l_orderkey").alias("pr"), F.when(F.col("l_returnflag") == "R", "revert").when(F.col("l_returnflag") == "A", "regression_issue").otherwise("szz").alias("proxy"), F.col("l_linenumber").alias("blamed_lines"), F.when(F.col("l_suppkey") % 2 == 0, "internal_build").alias("revert_reason"))
    return population.definition_variants(rows, 4)


def _gold(s: SparkSession, d: str) -> DataFrame:
    rows = B.read(s, d, "labels")
    gold = rows.select(F.col("doc_id").alias("item_id"), F.when(F.col("quality") == 1, "yes").otherwise("no").alias("expected"), F.lit("not_a_fix").alias("expected_exclusion"), (F.col("doc_id") % 3).alias("n_fixes"))
    sheet = rows.where("doc_id % 10 <> 0").select(F.col("doc_id").alias("item_id"), F.when(F.col("toxic") == 0, " Yes ").when(F.col("doc_id") % 7 == 0, "").otherwise("no").alias("corrective"), F.when(F.col("doc_id") % 2 == 0, "Not_a_fix").otherwise("other").alias("exclusion_code"))
    return population.gold_score(sheet, gold, 0.8)


def _gate(s: SparkSession, d: str) -> DataFrame:
    repos = B.read(s, d, "events").groupBy(F.col("user_id").alias("repo")).agg(F.count(F.lit(1)).alias("eligible"), F.count_if(F.col("event_type") == "click").alias("marked"), F.avg(F.when(F.col("value") > 20, 1.0).otherwise(0.0)).alias("survived_rate"))
    return population.gate(repos.withColumns({"qualifies": F.col("eligible") >= 8, "at_floor": F.col("marked") * 4 >= F.col("eligible")}))


def _tabs(s: SparkSession, d: str) -> DataFrame:
    labels = _survival(s, d).withColumn("reason_codes", F.split("reason_codes", ","))
    return population.label_cross_tabs(labels)


def _unmapped(s: SparkSession, d: str) -> DataFrame:
    rows = B.read(s, d, "orders").select(F.col("o_orderstatus").alias("repo"), F.col("o_orderkey").alias("position"), (F.col("o_orderkey") % 4 == 0).alias("has_change"))
    return population.unmapped_audit(rows, 50)


def _flags(s: SparkSession, d: str) -> DataFrame:
    rates = B.read(s, d, "events").groupBy(F.col("user_id").alias("repo")).agg(F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)).alias("rate"))
    notes = rates.select("repo").withColumn("code", F.when(F.col("repo") % 2 == 0, "churn_rate").otherwise("degenerate_rate")).select("repo", "code", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("ordinal"), F.lit("explained").alias("action")).withColumn("note", F.concat(F.lit("note "), F.col("ordinal").cast("string")))
    return population.sanity_flags(rates, notes)


def _related(s: SparkSession, d: str) -> DataFrame:
    changes = B.read(s, d, "orders").select(F.lit("r").alias("repo"), F.col("o_orderkey").alias("pr"), F.unix_timestamp("o_orderdate").alias("merged_at"))
    files = B.read(s, d, "lineitem").select(F.lit("r").alias("repo"), F.col("l_orderkey").alias("pr"), F.col("l_partkey").alias("path")).distinct()
    fixes = changes.where("pr % 3 = 0").select("pr", (F.col("pr") + 1).alias("fix"))
    return population.related_changes(changes, files, fixes, 200).drop("repo")


def _probe(s: SparkSession, d: str) -> DataFrame:
    rows = B.read(s, d, "orders").select(F.col("o_orderstatus").alias("repo"), F.col("o_orderdate").cast("timestamp").alias("created_at"), (F.col("o_orderkey") % 3 > 0).alias("merged"), F.when(F.col("o_orderkey") % 5 == 0, "Revert x").otherwise("reverting").alias("title"))
    return population.cohort_probe(rows, [("early", "1992-01-01", "1995-01-01"), ("late", "1995-01-01", "1997-01-01")], {"merged_share": 0.5, "revert_share": 0.2})


def _coverage(s: SparkSession, d: str) -> DataFrame:
    last = B.read(s, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last_event_at"), F.min(F.when(F.col("l_linenumber") > 2, F.col("l_shipdate"))).alias("ci_at"))
    return evidence.coverage_by_quarter(B.read(s, d, "orders").select(F.col("o_orderstatus").alias("repo"), F.col("o_orderdate").alias("merged_at"), "o_orderkey").join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left"))


def _swing(s: SparkSession, d: str) -> DataFrame:
    rows = B.read(s, d, "orders").select(F.col("o_orderdate").alias("merged_at"), F.when(F.col("o_orderkey") % 3 == 0, F.lit(1)).alias("a"), F.when(F.col("o_totalprice") > 100_000, F.lit(1)).alias("b"))
    return evidence.null_rate_swing(rows, ["a", "b"])


def _emails(s: SparkSession, d: str) -> DataFrame:
    commits = B.read(s, d, "events").select(F.col("user_id").alias("pr"), F.concat(F.lit("U"), (F.col("event_id") % 3).cast("string")).alias("login"), F.concat(F.col("event_type"), F.lit("@x")).alias("email"))
    changes = commits.select("pr").distinct().withColumn("author_login", F.when(F.col("pr") % 5 != 0, F.concat(F.lit("u"), (F.col("pr") % 4).cast("string"))))
    return evidence.author_emails(commits, changes).select("pr", F.array_join("emails", ",").alias("emails"))


def _identities(s: SparkSession, d: str) -> DataFrame:
    entries = B.read(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("head_sha")))).alias("entries"))
    each = entries.select("l_orderkey", F.posexplode(attempts.code_identity(F.lit("base"), F.col("entries"))).alias("i", "x"))
    return each.select("l_orderkey", "i", "x.base_sha", F.size("x.predecessors").alias("before"), "x.head_sha")


def _funnel(s: SparkSession, d: str) -> DataFrame:
    stage = F.when(F.col("event_type") == "click", "first_route").otherwise(F.col("event_type"))
    return attempts.funnel(B.read(s, d, "events").select(F.col("user_id").alias("installation"), stage.alias("stage"), F.col("ts").cast("timestamp").alias("at"))).select("installation", F.unix_timestamp("install").alias("install"), "seconds_to_first_route")


def _event_contract(s: SparkSession, d: str) -> DataFrame:
    """Events as valid cost events, each spoilt in the field that its id picks."""
    k = F.col("event_id") % 10
    spoil = lambda i, bad, good: F.when(k == i, bad).otherwise(good)
    ident = lambda n: F.col(n).cast("string")
    none = F.lit(None).cast("double")
    rows = B.read(s, d, "events").select(
        F.col("event_id").alias("key"), spoil(0, F.lit("a b"), ident("event_id")).alias("event_id"), ident("user_id").alias("task_id"), F.lit("s").alias("session_id"), F.lit("t").alias("turn_id"), spoil(1, F.lit(-1), F.lit(3)).alias("sequence"), spoil(2, ident("event_id"), F.lit(None).cast("string")).alias("replay_of_event_id"),
        F.lit(None).cast("string").alias("run_id"), spoil(3, F.lit("x"), F.lit(None).cast("string")).alias("stage_attempt_id"), spoil(4, F.lit("unheard"), F.lit("codex")).alias("harness"), F.lit("gpt-5").alias("observed_model"), F.lit("delta").alias("usage_kind"), *[F.lit(1).alias(t) for t in contracts.TOKENS],
        spoil(5, F.lit("partial"), F.lit("available")).alias("usage_coverage"), spoil(6, F.lit(0.5), none).alias("actual_cost_usd"), F.lit(0.25).alias("estimated_cost_usd"), spoil(6, F.lit("provider_reported"), spoil(7, F.lit("none"), F.lit("local_estimate"))).alias("cost_source"),
        spoil(6, F.lit("subscription"), F.lit("unknown")).alias("cost_basis"), spoil(8, F.lit("none"), F.lit("local_estimate")).alias("pricing_source"), spoil(9, F.lit("2024-02-30T00:00:00Z"), F.lit("2024-02-28T00:00:00Z")).alias("observed_at"),
    )
    return rows.select("key", F.array_join(contracts.broken(contracts.event_rules()), ",").alias("broken"))


def _score_contract(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 6
    rows = B.read(s, d, "orders").select(
        "o_orderkey", F.when(k == 0, "norepo").otherwise("o/r").alias("repo"), F.when(k == 1, 0).otherwise(F.col("o_orderkey") + 1).alias("pr_number"), F.when(k == 2, "ABC").otherwise(F.sha1(F.lit("x"))).alias("merge_sha"), F.when(k == 3, "soon").otherwise("2024-01-01T00:00:00Z").alias("merged_at"),
        F.lit("2024-01-01").alias("scored_at"), F.lit("b").alias("scorer_id"), F.lit("1").alias("scorer_version"), F.when(k == 4, 1.5).otherwise(0.2).alias("score"), F.lit(0.5).alias("threshold"), (k != 5).alias("would_flag"),
    )
    return rows.select("o_orderkey", F.array_join(contracts.broken(contracts.score_rules()), ",").alias("broken"))


def _pools(s: SparkSession, d: str) -> DataFrame:
    pool = lambda n: F.when(n == 0, None).when(n == 1, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    k = F.col("o_orderkey")
    rows = B.read(s, d, "orders").select("o_orderkey", pool(k % 3).alias("coder"), pool((k / 3).cast("long") % 3).alias("reviewer"), F.array(F.lit("a"), F.lit("c")).alias("available"))
    return contracts.role_pools(rows, ["coder", "reviewer"]).select("o_orderkey", "ranking")


QUERIES = {
    "event_contract": _event_contract, "score_contract": _score_contract, "role_pools": _pools,
    "landed_changes": _landed, "landing_owners": _owners, "fix_events": _events_of_fixes,
    "substrate": lambda s, d: forward.substrate(_hunks(s, d)).select("pr", "path", "lines", "hunks"),
    "file_fates": lambda s, d: forward.file_fates(forward.substrate(_hunks(s, d)), _moves(s, d)), "blob_identity": _reverted, "blame_counts": _blamed, "linked_references": _linked,
    "horizon_index": lambda s, d: forward.horizon_index(B.project(s, d, _epoch(COMMITS))).select("sha", "least_ct"),
    "survival_labels": _survival,
    "diff_shape": lambda s, d: evidence.diff_shape(_files(s, d)),
    "diff_statistics": lambda s, d: evidence.diff_statistics(_files(s, d).select("pr", "path"), _files(s, d).where("pr % 6 <> 0")),
    "test_pass_rate": lambda s, d: evidence.pass_rates(_checks(s, d), F.expr("timestamp '2024-01-20'")),
    "differing_columns": lambda s, d: _differing(s, d).select("o_orderkey", F.array_join("differing", ",").alias("differing")),
    "replay_tally": lambda s, d: evidence.replay_tally(_differing(s, d).withColumn("landing", F.col("o_orderkey") % 4)).withColumn("columns", F.array_join("columns", ",")),
    "column_agreement": lambda s, d: evidence.agreement_by_column(*_frames(s, d), ["o_orderkey"]),
    "truncated_evidence": _truncated, "coverage_by_quarter": _coverage, "null_rate_swing": _swing, "author_emails": _emails,
    "attribution_strata": lambda s, d: attribution.with_stratum(_strata(s, d)).select("o_orderkey", "positive", "stratum"),
    "attribution_summary": lambda s, d: attribution.attribution_summary(_strata(s, d), ["repo"]).select("repo", "eligible", "baseline_marked", "full_union", "added_unique", "bot_without_agent_evidence", "union_with_every_bot", "n_agent_branch", "added_agent_branch"),
    "population_strata": _population, "definition_variants": _variants, "gold_score": _gold, "phase_gate": _gate, "label_cross_tabs": _tabs, "unmapped_audit": _unmapped, "sanity_flags": _flags,
    "label_pairs": lambda s, d: population.both_labelled(B.read(s, d, "labels").select(F.col("doc_id").alias("item_id")), B.read(s, d, "labels").select(F.col("doc_id").alias("item_id"), F.col("quality").cast("string").alias("f")), B.read(s, d, "labels").where("doc_id % 3 = 0").select(F.col("doc_id").alias("item_id"), F.col("toxic").cast("string").alias("f")), "f"),
    "audit_flags": lambda s, d: population.audited(B.read(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("item_id"), F.col("o_orderstatus").alias("stratum")), "seed", {"F": 0.25, "O": 0.1}),
    "features_with_labels": lambda s, d: evidence.joined_once(B.read(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), B.read(s, d, "orders").where("o_totalprice > 50000").select("o_orderkey", "o_orderstatus", "o_orderpriority"), ["o_orderkey"], ["o_orderstatus"]),
    "related_changes": _related, "cohort_probe": _probe,
    "outcome_shares": lambda s, d: population.outcome_shares(_survival(s, d), "report_outcome").select("horizon_days", "outcome", "n", "of", "value", "ci_low", "ci_high"),
    "newest_changes": lambda s, d: population.newest(B.read(s, d, "orders").select(F.col("o_orderkey").alias("position")), 100),
    "code_identities": _identities, "onboarding_funnel": _funnel,
}

_SURV = """k as (select o_orderkey as k, epoch(o_orderdate)::bigint as m, h from orders, unnest([14, 60]) u(h)), v as (select *, k % 13 <> 0 as readable, k % 11 as lines, least(k % 11, k % 7) as s, k % 19 = 0 as rev, k % 3 = 0 as rf, k % 5 = 0 as li, k % 23 = 0 as re, k % 29 = 0 as ed from k),
w as (select *, case when m + h * 86400 > 880000000 then 'missing_horizon' when not readable then 'inaccessible_history' when lines = 0 then 'insufficient_line_range_substrate' when k % 17 = 0 then 'inaccessible_history' end as missing, s / lines::double as ratio from v),
lab as (select k as pr, h as horizon_days, missing, case when missing is null then not (rev or rf or li or re or ed) end as survived, case when missing is null then ratio end as survival_ratio, case when missing is null then rev end as reverted, case when missing is null then rf or li or re or ed end as followup,
  case when missing is null and (rf or rev or ed) then 'human' end as undone_by, coalesce(missing, nullif(concat_ws(',', case when rev then 'exact_revert' end, case when rf then 'line_range_followup' end, case when li then 'linked_issue_or_pr' end, case when ed then 'pre_merge_human_edit' end, case when re then 'task_redispatch' end,
  case when not rev and ratio < 0.5 then 'substantial_rewrite' end), ''), 'no_evidence') as reason_codes, case when missing is null then case when rev then 'reverted' when ratio < 0.5 then 'substantially_rewritten' when rf or li or re or ed then 'followup' else 'survived' end end as report_outcome from w)"""
_F = """f as (select l_orderkey as pr, case when l_suppkey % 4 = 0 then 'tests/' else 'src/' end || l_partkey || '.py' as path, case l_returnflag when 'A' then 'A' when 'R' then 'D' else 'M' end as status, case when l_suppkey % 9 <> 0 then l_quantity::bigint end as added, l_linenumber::bigint as deleted, l_suppkey from lineitem)"""
_ST = "st as (select o_orderkey, o_orderstatus as repo, o_orderkey % 10 = 0 as baseline, o_orderkey % 4 = 0 as bot, o_orderkey % 12 = 0 as branch, o_orderkey % 10 = 0 or " + " or ".join(f"o_orderkey % {i + 11} = 0" for i in range(8)) + " as positive from orders)"
_H = f"h as ({B.duck_sql(HUNKS)}), fl as (select pr, path, sum(last - first + 1)::bigint as lines, count(*) as hunks, (pr + length(path) + cast(substr(path, 2, 1) as bigint)) % 4 as q from h group by pr, path)"
_CD = """cd as (select distinct l_orderkey as pr, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as id, case l_returnflag when 'R' then 'revert' when 'A' then 'regression_issue' else 'szz' end as proxy, (l_quantity * 86400)::bigint as lag, l_linenumber as lines from lineitem)"""

SQL = {
    "event_contract": "select event_id as key, ['event_id', 'sequence', 'replay_of_event_id', 'stage_attempt_id', 'harness', 'usage_coverage', 'actual_cost_usd', 'cost_source', 'pricing_source', 'observed_at'][event_id % 10 + 1] as broken from events",
    "score_contract": "select o_orderkey, ['repo', 'pr_number', 'merge_sha', 'merged_at', 'score,would_flag', 'would_flag'][o_orderkey % 6 + 1] as broken from orders",
    "role_pools": "select o_orderkey, case (o_orderkey % 3 = 1)::int + (o_orderkey // 3 % 3 = 1)::int when 0 then 'ranking' when 2 then 'non_ranking' else 'partially_ranking' end as ranking from orders",
    "landed_changes": f"""with c as ({B.duck_sql(LINE)}), p as ({B.duck_sql(LANDED)}), n as (select position, sha, unnest(case position % 5 when 0 then [position, position + 1] when 1 then [position] when 3 then [position - 3] else []::bigint[] end || case when position % 7 = 0 then [position + 2] else []::bigint[] end) as pr from c),
  m as (select c.position, c.sha, p.pr from c join p on c.sha = p.merge_sha union select n.position, n.sha, n.pr from n join p on n.pr = p.pr and n.pr > 0), f as (select pr, arg_min(sha, position) as sha, min(position) as position, count(*) - 1 as relanded from m group by pr)
  select pr, sha, position, relanded, count(*) over (partition by sha) > 1 as batched from f""",
    "landing_owners": """with o as (select o_orderkey as k from orders), c as (select k from o where k % 10 = 0 and k % 50 <> 0), w as (select 'c' || k as sha, k as pr from c union all select 'c' || (k + 10), k from c where k % 40 = 0
  union all select 'c' || o.k, c.k from c join o on o.k > c.k - 10 and o.k < c.k where c.k % 3 = 2 and c.k - 10 in (select k from o)) select sha, min(pr) as pr from w group by sha having count(distinct pr) = 1""",
    "fix_events": "select 'c' || o_orderkey as sha, case when o_orderkey % 2 = 0 then o_orderkey end as pr, case when o_orderkey % 2 = 0 then 'fix' else 'Revert' end as title, case when o_orderkey % 6 = 0 then 'b' || chr(10) || 'Revert' || chr(10) || 'why' when o_orderkey % 2 = 0 then 'b' else 'why' end as body from orders where o_orderkey % 2 = 0 or o_orderkey % 3 = 0",
    "substrate": f"with {_H} select pr, path, lines, hunks from fl",
    "file_fates": f"with {_H} select pr, path, case q when 0 then null when 1 then 'moved/' || path else path end as terminal_path from fl",
    "blob_identity": f"with {_H} select pr, path, case when pr % 5 = 0 then false when pr % 7 = 0 or q = 0 then false else pr % 5 = 1 end as reverted from fl",
    "blame_counts": """with r as (select distinct l_orderkey as fix, l_linenumber % 2 as path, unnest(range(cast(l_suppkey % 20 as bigint), cast(l_suppkey % 20 + l_quantity % 7 as bigint) + 1)) as line from lineitem)
  select fix, case when (fix + line) % 6 in (0, 2) then 100 when (fix + line) % 6 = 1 then 101 else 104 end::bigint as pr, count(*) as lines from r where line < 30 and line % 9 <> 0 and line % 8 <> 0 and (fix + line) % 6 in (0, 1, 2, 4) group by 1, 2""",
    "linked_references": "select distinct o_orderkey as pr, h as horizon_days from orders, unnest([14, 30]) u(h) where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag <> 'N' and l_shipdate > o_orderdate and epoch(l_shipdate) <= epoch(o_orderdate) + h * 86400)",
    "horizon_index": f"with c as ({COMMITS}) select sha, min(ct) over (partition by repo order by position rows unbounded preceding) as least_ct from c",
    "survival_labels": f"with {_SURV} select * exclude (missing) from lab",
    "diff_shape": f"with {_F} select pr, count(distinct path) as files, sum(coalesce(added, 0))::bigint as added, sum(deleted)::bigint as deleted, sum(coalesce(added, 0) + deleted)::bigint as loc, bool_or(l_suppkey % 4 = 0) as tests_changed, count(*) filter (status = 'A') as new_files from f group by pr",
    "diff_statistics": f"with {_F} select pr, count(distinct path) as files, case when pr % 6 <> 0 then sum(coalesce(added, 0) + deleted)::bigint end as loc, pr % 6 = 0 as diff_uncertain from f group by pr",
    "test_pass_rate": "with e as (select user_id as pr, count(*) filter (event_id % 3 = 0 and event_type = 'click') as g, count(*) filter (event_id % 3 = 0 and event_type in ('click', 'error')) as n from events where ts <= timestamp '2024-01-20' group by 1) select pr, case when n > 0 then floor(g / n::double * 10000 + 0.5) / 10000 end as test_pass_rate from e",
    "differing_columns": "select o_orderkey, case when o_orderkey % 11 = 0 then 'a,b,c' else concat_ws(',', case when o_orderkey % 3 = 0 then 'a' end, case when o_orderkey % 10 = 0 then 'b' end) end as differing from orders",
    "replay_tally": """with x as (select o_orderkey % 4 as landing, o_orderkey % 11 = 0 as g, o_orderkey % 3 = 0 as a, o_orderkey % 10 = 0 as b from orders) select landing, count(*) as replayed, count(*) filter (not g and not a and not b) as identical,
  concat_ws(',', case when bool_or(g or a) then 'a' end, case when bool_or(g or b) then 'b' end, case when bool_or(g) then 'c' end) as columns from x group by landing""",
    "column_agreement": "with x as (select * from orders where o_orderkey % 11 <> 0) select 'a' as name, count(*) as compared, count(*) filter (o_orderkey % 3 <> 0) as agree from x union all select 'b', count(*), count(*) filter (o_orderkey % 10 <> 0) from x union all select 'c', count(*), count(*) from x",
    "truncated_evidence": "select user_id as pr, (count(*) filter (ts <= timestamp '2024-01-15 12:00:00'))::int as n, false as leaks from events group by 1",
    "coverage_by_quarter": """with l as (select l_orderkey, max(l_shipdate) as last_at, min(case when l_linenumber > 2 then l_shipdate end) as ci_at from lineitem group by 1) select o_orderstatus as repo, year(o_orderdate) || 'Q' || quarter(o_orderdate) as quarter, count(*) as changes, count(ci_at) as with_ci,
  count(*) filter (ci_at <= o_orderdate) as ci_at_merge, count(*) filter (last_at > o_orderdate) as events_after from orders left join l on o_orderkey = l_orderkey group by 1, 2""",
    "null_rate_swing": """with q as (select year(o_orderdate) || 'Q' || quarter(o_orderdate) as q, count(*) filter (o_orderkey % 3 <> 0) / count(*)::double as a, count(*) filter (o_totalprice <= 100000) / count(*)::double as b from orders group by 1), u as (select 'a' as name, a as r from q union all select 'b', b from q)
  select name, floor(min(r) * 10000 + 0.5) / 10000 as least, floor(max(r) * 10000 + 0.5) / 10000 as most, floor((max(r) - min(r)) * 10000 + 0.5) / 10000 as swing from u group by name""",
    "author_emails": "select user_id as pr, string_agg(distinct event_type || '@x', ',' order by event_type || '@x') filter (user_id % 5 <> 0 and event_id % 3 = user_id % 4) as emails from events group by 1",
    "attribution_strata": f"with {_ST} select o_orderkey, positive, case when baseline then 'baseline_positive' when positive then 'added_positive' when bot then 'bot_without_agent_evidence' else 'unmarked' end as stratum from st",
    "attribution_summary": f"""with {_ST} select repo, count(*) as eligible, count(*) filter (baseline) as baseline_marked, count(*) filter (positive) as full_union, count(*) filter (positive and not baseline) as added_unique, count(*) filter (bot and not positive) as bot_without_agent_evidence,
  count(*) filter (positive or bot) as union_with_every_bot, count(*) filter (branch) as n_agent_branch, count(*) filter (branch and not baseline) as added_agent_branch from st group by repo""",
    "population_strata": f"""with {_CD}, n as (select pr, count(*)::int as n from cd where lag <= 2592000 group by pr), a as (select pr, bool_or(proxy = 'revert') as r, bool_or(proxy = 'regression_issue') as g, max(lines) filter (proxy = 'szz') as z from cd where lag <= 2592000 and lines % 2 = 1 group by pr)
  select o_orderkey as pr, case when a.pr is null then case when n.n is null then 'negative' else 'rejected' end when r then 'revert' when g then 'regression_issue' when z >= 4 then 'szz_strong' else 'szz_weak' end as stratum, coalesce(n.n, 0) as n_candidates from orders left join a on a.pr = o_orderkey left join n on n.pr = o_orderkey where o_orderkey % 9 <> 0""",
    "definition_variants": """with c as (select l_orderkey as pr, l_returnflag as f, l_linenumber >= 4 as strong, l_suppkey % 2 = 0 as internal from lineitem), v as (select pr, unnest(['all', 'high_precision', 'szz_strong', 'no_internal_build', 'szz_strong+no_internal_build', 'defect_repair']) as variant,
  unnest([true, f = 'R', f <> 'N' or strong, f <> 'R' or not internal, (f <> 'N' or strong) and (f <> 'R' or not internal), f = 'A']) as keep from c) select pr, variant, bool_or(keep) as positive from v group by pr, variant""",
    "gold_score": """with x as (select doc_id, case when quality = 1 then 'yes' else 'no' end as e, case when doc_id % 10 = 0 then '' when toxic = 0 then 'yes' when doc_id % 7 = 0 then '' else 'no' end as g from labels), s as (select count(*) as items, count(*) filter (e = g) as correct, count(*) filter (g = '') as unlabelled,
  count(*) filter (e = g and g = 'no' and doc_id % 3 > 0) as exclusion_of, count(*) filter (e = g and g = 'no' and doc_id % 3 > 0 and doc_id % 2 = 0) as exclusion_matched from x) select *, ceil(items * 0.8e0 - 1e-9)::bigint as min_correct, correct >= ceil(items * 0.8e0 - 1e-9) as passed from s""",
    "phase_gate": """with r as (select user_id, count(*) as n, count(*) filter (event_type = 'click') as m, avg(case when value > 20 then 1.0e0 else 0.0e0 end) as s from events group by 1 having count(*) >= 8) select count(*) as qualifying, count(*) filter (m * 4 >= n) as at_marker_floor, floor(avg(m / n::double) * 10000 + 0.5) / 10000 as macro,
  floor(sum(m) / sum(n)::double * 10000 + 0.5) / 10000 as micro, case when count(*) < 10 then 'insufficient_repos' when min(s) > 0.97 then 'degenerate_by_program_rule' else 'nondegenerate_base_rates' end as label_call from r""",
    "label_cross_tabs": f"""with {_SURV}, t as (select *, contains(reason_codes, 'linked_issue') as l, contains(reason_codes, 'line_range_followup') as r from lab) select horizon_days, count(*) as rows, count(*) filter (report_outcome is null) as missing, """ + ", ".join(f"count(*) filter (report_outcome = '{o}') as {o}" for o in ("survived", "followup", "substantially_rewritten", "reverted")) + """,
  count(*) filter (undone_by = 'human') as undone_by_human, 0 as undone_by_agent, count(*) filter (l and not r) as only_linked, count(*) filter (r and not l) as only_range, count(*) filter (l and r) as both from t group by 1""",
    "unmapped_audit": """with p as (select o_orderstatus as repo, o_orderkey as k, row_number() over (partition by o_orderstatus order by o_orderkey) - 1 as i, count(*) over (partition by o_orderstatus) as n from orders) select repo, count(*) as sampled, count(*) filter (k % 4 = 0) as missed,
  floor(count(*) filter (k % 4 <> 0) / count(*)::double * 10000 + 0.5) / 10000 as direct_push_share, max(n) as unmapped from p where i % greatest(1, n // 50) = 0 group by repo""",
    "sanity_flags": """with r as (select user_id as repo, avg(case when event_type = 'error' then 1.0e0 else 0.0e0 end) as rate from events group by 1), f as (select repo, case when rate < 0.01 then 'degenerate_rate' when rate > 0.25 then 'churn_rate' end as code from r)
  select repo, code, case when (code = 'churn_rate') = (repo % 2 = 0) then 'explained' end as action, case when (code = 'churn_rate') = (repo % 2 = 0) then 'note 1' end as note from f where code is not null""",
    "label_pairs": "select doc_id as item_id, quality::varchar as x, toxic::varchar as y from labels where doc_id % 3 = 0",
    "audit_flags": "with o as (select o_orderkey::varchar as item_id, o_orderstatus as stratum from orders), r as (select *, row_number() over (partition by stratum order by sha256(concat('seed', chr(0), 'audit', chr(0), item_id)), item_id) as i, count(*) over (partition by stratum) as n from o) select item_id, stratum, i <= ceil(n * case stratum when 'F' then 0.25e0 when 'O' then 0.1e0 else 0 end - 1e-9) as audit from r",
    "features_with_labels": "select o_orderkey, o_orderstatus, o_totalprice, o_orderpriority from orders where o_totalprice > 50000",
    "related_changes": """with c as (select o_orderkey as pr, epoch(o_orderdate)::bigint as m from orders), f as (select distinct l_orderkey as pr, l_partkey as path from lineitem), x as (select distinct a.pr, b.pr as related, d.m as t from f a join c on a.pr = c.pr join f b on a.path = b.path and b.pr <> a.pr join c d on d.pr = b.pr and d.m > c.m and d.m <= c.m + 17280000
  where not (a.pr % 3 = 0 and b.pr = a.pr + 1)) select pr, related, row_number() over (partition by pr order by t, related)::int as rank from x qualify rank <= 15""",
    "cohort_probe": """with r as (select o_orderstatus as repo, case when o_orderdate < date '1995-01-01' then 'early' when o_orderdate < date '1997-01-01' then 'late' end as slice, o_orderkey % 3 > 0 as m, o_orderkey % 5 = 0 as v from orders where o_orderdate >= date '1992-01-01'), a as (select repo, slice, count(*) as changes, count(*) filter (m) as merged, count(*) filter (m and v) as reverts from r where slice is not null group by all),
  s as (select *, floor(merged / changes::double * 1000 + 0.5) / 1000 as merged_share, case when merged > 0 then floor(reverts / merged::double * 1000 + 0.5) / 1000 end as revert_share from a) select *, merged_share >= 0.5 and coalesce(revert_share >= 0.2, false) as passes from s""",
    "outcome_shares": f"""with {_SURV}, a as (select horizon_days, report_outcome as outcome, count(*) as n from lab where report_outcome is not null group by all), b as (select *, sum(n) over (partition by horizon_days)::bigint as o from a) select horizon_days, outcome, n, o as "of", floor(n / o::double * 10000 + 0.5) / 10000 as "value", {_wilson('n', 'o')} from b""",
    "newest_changes": "select o_orderkey as position from orders order by 1 desc limit 100",
    "code_identities": "with h as (select l_orderkey, concat_ws('-', l_linenumber, l_partkey, l_suppkey, l_extendedprice) as head_sha from lineitem) select l_orderkey, (row_number() over (partition by l_orderkey order by head_sha) - 1)::int as i, 'base' as base_sha, (row_number() over (partition by l_orderkey order by head_sha) - 1)::int as before, head_sha from h",
    "onboarding_funnel": "select user_id as installation, floor(epoch(min(ts)))::bigint as install, floor(epoch(min(ts) filter (event_type = 'click')))::bigint - floor(epoch(min(ts)))::bigint as seconds_to_first_route from events group by 1",
}
