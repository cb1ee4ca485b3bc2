"""Survival, repair and merge-time feature queries over orders, lineitem, events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import attempts, corrective, features, history, survival
from . import bindings as B


def _changes(s: SparkSession, d: str) -> DataFrame:
    return B.project(s, d, B.CHANGES)


def _candidates(s: SparkSession, d: str) -> DataFrame:
    return corrective.candidates(_changes(s, d).select("pr", "merged_at"), B.project(s, d, B.FIXES))


def _pairs(s: SparkSession, d: str) -> DataFrame:
    confidence = F.when(F.col("lag_seconds") > 30 * survival.DAY, "low").when(F.col("lag_seconds") > 10 * survival.DAY, "medium").otherwise("high")
    return _candidates(s, d).where("status = 'accepted'").withColumn("confidence", confidence)


def _corrective(s: SparkSession, d: str) -> DataFrame:
    return corrective.corrective_labels(_changes(s, d).select("pr", "has_label"), _pairs(s, d))


def _summary(s: SparkSession, d: str) -> DataFrame:
    return corrective.corpus_summary(_corrective(s, d).join(_changes(s, d).select("pr", "repo"), "pr"))


def _spread(s: SparkSession, d: str) -> DataFrame:
    rates = _corrective(s, d).where("horizon_days = 60").join(_changes(s, d).select("pr", "repo", "convention"), "pr").groupBy("convention", "repo")
    return corrective.convention_spread(rates.agg(X.round4(F.count_if("corrective") / F.count("corrective")).alias("rate")))


#: events as commits of a line, newest first; times are put out of order.
COMMITS = "select cast(event_id % 4 as bigint) as repo, -event_id as position, event_id as sha, cast(floor(epoch(ts)) as bigint) - (event_id * 7919) % 200000 as ct, user_id as author, event_type from events"
CUTOFFS = "select distinct event_id % 4 as repo, 1704067200 + (event_id % 60) * 40000 as cutoff from events"


def _epoch(text: str) -> str:
    return text.replace("cast(floor(epoch(ts)) as bigint)", "unix_timestamp(ts)")


def _terminal(s: SparkSession, d: str) -> DataFrame:
    return survival.horizon_terminal(B.project(s, d, _epoch(COMMITS)), B.project(s, d, CUTOFFS))


REDISPATCH = "select event_id as pr, ts as merged_at, user_id % 40 as a, event_id % 50 as b from events"


def _redispatch(s: SparkSession, d: str) -> DataFrame:
    rows = B.project(s, d, REDISPATCH).select("pr", "merged_at", (F.col("merged_at") + F.expr("interval 6 hours")).alias("cutoff"), F.array("a", F.col("b") + 1000).alias("keys"))
    return survival.redispatched(rows)


#: Paths of a few dozen rows each at every size; a range is known by all its columns.
RANGES = "select distinct concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as bigint)) as id, l_partkey as path, l_suppkey * 3 as first, l_suppkey * 3 + cast(l_quantity as bigint) as last from lineitem"
HUNKS = "select l_partkey as path, l_suppkey * 3 + 7 as first, l_suppkey * 3 + 7 + cast(l_quantity as bigint) * 2 as last from lineitem"


def _overlap(s: SparkSession, d: str) -> DataFrame:
    return survival.covered_lines(B.project(s, d, RANGES), B.project(s, d, HUNKS))


VOTES = "select user_id as pr, case when event_type = 'click' then 'human' when event_type = 'error' and user_id % 3 = 0 then 'agent' else 'automation' end as actor from events"
LABELS = """
select o_orderkey as pr, c_mktsegment as repo, h as horizon_days, o_orderkey % 29 = 0 as reverted, o_orderkey % 13 = 0 as followup,
  case when o_orderkey % 31 = 0 then null else (o_orderkey % 10) / 10.0e0 end as ratio, o_orderkey % 5 <> 0 as survived
from orders join customer on o_custkey = c_custkey cross join (select 14 as h union all select 30 union all select 60) hs
"""


def _labels(s: SparkSession, d: str) -> DataFrame:
    each = _changes(s, d).select(F.col("pr").alias("o_orderkey"), "repo", F.explode(F.array(F.lit(14), F.lit(30), F.lit(60))).alias("horizon_days"))
    k = F.col("o_orderkey")
    return each.select(k.alias("pr"), "repo", "horizon_days", X.report_outcome(k % 5 != 0, F.when(k % 31 != 0, (k % 10) / 10.0), k % 29 == 0, k % 13 == 0).alias("outcome"))


def _lines(s: SparkSession, d: str, later: bool) -> DataFrame:
    rows = B.read(s, d, "lineitem").where(F.col("l_linenumber") > 3 if later else F.col("l_linenumber") <= 3)
    return rows.select(F.col("l_orderkey").alias("pr"), (F.col("l_suppkey") % 2).alias("file"), F.concat(F.lit(" "), F.col("l_returnflag"), F.lit(" ")).alias("line"))


LABEL_EVENTS = "select user_id as pr, ts as at, event_id as ordinal, case when event_id % 2 = 0 then 'labeled' else 'unlabeled' end as action, case when user_id % 25 = 0 and event_id % 50 = 0 then null else event_type end as label, timestamp '2024-01-15 12:00:00' as as_of from events"
REVIEWS = "select user_id as pr, ts as at, case when event_type = 'click' then 'approved' when event_type = 'error' then 'changes_requested' else 'commented' end as state, event_id % 9 as author, timestamp '2024-01-15 12:00:00' as as_of, timestamp '2024-01-01 00:00:00' as opened_at from events"
RENAMES = "select user_id as pr, ts as at, event_type as new_title, concat('was ', event_type) as old_title from events where event_type = 'signup'"


def _titles(s: SparkSession, d: str) -> DataFrame:
    prs = B.read(s, d, "events").select(F.col("user_id").alias("pr")).distinct().select("pr", F.lit("now").alias("title"), F.expr("timestamp '2024-01-15 12:00:00'").alias("as_of"))
    return features.text_at(prs, B.project(s, d, RENAMES))


def _history(s: SparkSession, d: str) -> DataFrame:
    line = features.landing_times(B.project(s, d, _epoch(COMMITS)).withColumn("position", -F.col("position"))).withColumn("path", F.expr("sha div 30"))
    postings = line.select("path", "position", "landed", F.col("sha").alias("commit"), "author", (F.col("event_type") == "error").alias("is_fix"))
    changes = line.select(F.col("sha").alias("pr"), F.col("position").alias("base_position"), F.col("landed").alias("base_landed"), F.array("path", F.col("path") - 1).alias("files"))
    return features.file_history(changes, postings, days=5)


def _landing(s: SparkSession, d: str) -> DataFrame:
    # orders as commits: every tenth on the line, the others side branches of up to nine commits
    rows = B.read(s, d, "orders").select(F.col("o_orderkey").cast("long").alias("sha")).distinct()
    side = rows.where("sha % 10 <> 0")
    parents = side.select(F.expr("sha - sha % 10 + 10").alias("sha"), F.col("sha").alias("parent")).union(side.select("sha", (F.col("sha") - 1).alias("parent")).join(rows.select(F.col("sha").alias("parent")), "parent", "left_semi").select("sha", "parent"))
    return history.landing_positions(rows.where("sha % 10 = 0").select("sha", F.expr("sha div 10").alias("position")), parents)


AS_OF = "timestamp '2024-01-15 12:00:00'"


def _reviews_at(s: SparkSession, d: str) -> DataFrame:
    rows = B.read(s, d, "events")
    reviews = rows.select(F.col("user_id").alias("pr"), F.col("event_id").alias("review_id"), F.when(F.col("event_id") % 3 == 0, "dismissed").otherwise("approved").alias("state"), F.col("ts").alias("submitted_at"), F.lit("a").alias("author"), F.expr(AS_OF).alias("as_of"))
    gone = rows.select(F.col("event_id").alias("review_id"), (F.col("ts") + F.expr("interval 5 days")).alias("at"), F.when(F.col("event_id") % 3 == 0, "approved").alias("previous_state")).where("previous_state is not null")
    return features.reviews_at(reviews, gone).select("pr", "review_id", "state")


def _bodies(s: SparkSession, d: str) -> DataFrame:
    rows = B.read(s, d, "events")
    prs = rows.select(F.col("user_id").alias("pr")).distinct().select("pr", F.lit("now").alias("body"), F.expr(AS_OF).alias("as_of"))
    edits = rows.where("event_type = 'signup'").select(F.col("user_id").alias("pr"), F.col("ts").alias("at"), F.concat(F.lit("edit "), F.col("event_id").cast("string")).alias("body"))
    return features.body_at(prs, edits)


def _queue(s: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    rows = B.read(s, d, "events").select(
        F.concat(F.lit("q"), F.floor(k / 2).cast("string")).alias("event_id"), k.alias("ordinal"), F.when(k % 4 == 0, "candidate_prepared").when(k % 4 == 2, "recovery_decision").otherwise("merged").alias("event_type"),
        F.when(k % 6 < 2, "same").otherwise(F.concat(F.lit("b"), k.cast("string"))).alias("body"), F.when(k % 4 == 0, (k % 12).cast("string")).alias("candidate_id"), k.alias("observed_at"), F.array(F.concat(F.lit("q"), F.floor((k - k % 5) / 2).cast("string"))).alias("context"), (k - 2).alias("context_as_of"),
    )
    return attempts.queue_decisions(rows).select("event_id", "ordinal", "decision", F.array_join("reasons", ",").alias("reasons"))


QUERIES = {
    "review_states": _reviews_at,
    "body_asof": _bodies,
    "queue_decisions": _queue,
    "corrective_summary": lambda s, d: corrective.corrective_summary(_candidates(s, d), _changes(s, d)),
    "corrective_candidates": lambda s, d: _candidates(s, d).select("candidate_id", "pr", "fix", "proxy", "lag_seconds", F.concat_ws(",", "evidence").alias("evidence"), "exclusion", "status"),
    "corrective_by_horizon": lambda s, d: _corrective(s, d).select("pr", "horizon_days", "corrective", "confidence", F.concat_ws(",", "reason_codes").alias("reason_codes"), F.size("repair_pair_ids").alias("n_pairs")),
    "corpus_summary": _summary,
    "convention_spread": _spread,
    "horizon_terminal": _terminal,
    "redispatch": _redispatch,
    "range_overlap": _overlap,
    "undoer_vote": lambda s, d: survival.undoer(B.project(s, d, VOTES)),
    "base_rates": lambda s, d: survival.base_rates(_labels(s, d)),
    "latest_wins": lambda s, d: survival.latest(B.read(s, d, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], "ts", "event_id"),
    "multiset_survival": lambda s, d: survival.line_survival(_lines(s, d, False), _lines(s, d, True)),
    "label_state_asof": lambda s, d: features.labels_at(B.project(s, d, LABEL_EVENTS)).select("pr", F.when(F.col("labels").isNotNull(), F.concat_ws(",", "labels")).alias("labels")),
    "title_asof": _titles,
    "process_features": lambda s, d: features.process_features(B.project(s, d, REVIEWS)),
    "history_window": _history,
    "landing_positions": _landing,
    "issue_originals": lambda s, d: corrective.issue_originals(_changes(s, d).select("pr", "merged_at").join(B.read(s, d, "lineitem").select(F.col("l_orderkey").alias("pr"), F.col("l_partkey").alias("issue"), F.col("l_shipdate").alias("cited_at")), "pr"), most=40).select("issue", F.size("prs").alias("n")),
    "prefix_lookup": lambda s, d: corrective.owner_of_prefix(B.read(s, d, "customer").select(F.substring(F.sha2(F.col("c_custkey").cast("string"), 256), 1, 4).alias("prefix")), B.read(s, d, "customer").select(F.sha2(F.col("c_custkey").cast("string"), 256).alias("sha")), digits=3),
}

_C = f"""with changes as ({B.CHANGES}), fixes as ({B.duck_sql(B.FIXES)}), met as (select changes.pr, merged_at, fix, proxy, confidence, evidence, exclusion, (epoch(fixed_at) - epoch(merged_at))::bigint as lag_seconds from changes join fixes on changes.pr = fixes.pr),
cand as (select pr, fix, proxy, min(lag_seconds) as lag_seconds, string_agg(distinct evidence, ',' order by evidence) as evidence, min(exclusion) as exclusion from met where lag_seconds between 1 and 5184000 group by pr, fix, proxy),
cands as (select sha256(concat(cast(pr as varchar), chr(0), fix, chr(0), proxy)) as candidate_id, *, case when exclusion is null then 'accepted' else 'rejected' end as status from cand),
pairs as (select *, case when lag_seconds > 2592000 then 1 when lag_seconds > 864000 then 2 else 3 end as rank from cands where status = 'accepted'),
hs(h) as (values (14), (30), (60)), agg as (select c.pr, c.repo, c.convention, h as horizon_days, bool_or(has_label) as known, count(p.pr) as n, max(rank) as rank,
  concat_ws(',', max(case when proxy = 'revert' then 'revert' end), max(case when proxy = 'repair_reference' then 'repair_reference' end), max(case when proxy = 'regression_issue' then 'regression_issue' end), max(case when proxy = 'szz' then 'szz' end)) as reasons
  from changes c cross join hs left join pairs p on c.pr = p.pr and p.lag_seconds <= h * 86400 group by c.pr, c.repo, c.convention, h),
cor as (select *, case when known then n > 0 end as corrective from agg)"""


def _wilson(k: str, n: str) -> str:
    r4 = "floor((least(1.0e0, greatest(0.0e0, {x})) + 2.220446049250313e-16) * 10000 + 0.5) / 10000"
    p = f"({k} / ({n})::double)"
    den = f"(1 + 3.841458881296e0 / ({n}))"
    center = f"(({p} + 3.841458881296e0 / (2 * ({n}))) / {den})"
    half = f"(1.959964e0 * sqrt(({p} * (1 - {p}) + 3.841458881296e0 / (4 * ({n}))) / ({n})) / {den})"
    at = r4.format(x=p)
    return f"case when ({n}) > 0 then least({r4.format(x=f'{center} - {half}')}, {at}) end as ci_low, case when ({n}) > 0 then greatest({r4.format(x=f'{center} + {half}')}, {at}) end as ci_high"


SQL = {
    "review_states": f"select user_id as pr, event_id as review_id, case when event_id % 3 = 0 and ts + interval 5 day <= {AS_OF} then 'dismissed' else 'approved' end as state from events where ts <= {AS_OF}",
    "body_asof": f"""with p as (select distinct user_id as pr from events), a as (select user_id as pr, count(*) as n, arg_max(event_id, ts) filter (ts <= {AS_OF}) as e from events where event_type = 'signup' group by 1)
  select p.pr, case when a.n is null then 'now' when e is not null then 'edit ' || e end as body from p left join a on a.pr = p.pr""",
    "queue_decisions": """with q as (select event_id // 2 as q, event_id as o, case when event_id % 6 < 2 then 'same' else 'b' || event_id end as body, event_id % 4 = 0 as prep, event_id % 4 = 2 as rec, case when event_id % 4 = 0 then event_id % 12 end as c, (event_id - event_id % 5) // 2 as ctx from events),
  n as (select *, row_number() over (partition by q order by o) as n, first_value(body) over (partition by q order by o) as f from q), j as (select *, prep and row_number() over (partition by prep, c order by o) > 1 as reused from n where n = 1),
  w as (select j.*, j.rec and (s.o is null or s.reused or s.o > j.o - 2) as leak from j left join j s on s.q = j.ctx)
  select 'q' || q as event_id, o as ordinal, case when reused or leak then 'rejected' else 'accepted' end as decision, concat_ws(',', case when reused then 'candidate_id_reused' end, case when leak then 'context_leak' end) as reasons from w
  union all select 'q' || q, o, case when body = f then 'duplicate' else 'rejected' end, case when body = f then '' else 'event_id_conflict' end from n where n > 1""",
    "corrective_summary": f"""{_C}, a as (select count(distinct pr) filter (status = 'accepted') as n, (select count(*) from changes) as total from cands) select 'proxy_status' as measure, proxy || ':' || status as name, count(*) as n from cands group by all
  union all select 'exclusion', exclusion, count(*) from cands where exclusion is not null group by all union all select 'originals', 'with_fix', n from a union all select 'originals', 'share_e4', floor(n * 10000 / total + 0.5)::bigint from a""",
    "landing_positions": """with o as (select distinct o_orderkey::bigint as sha from orders) select sha, case when sha % 10 = 0 then sha // 10 else sha // 10 + 1 end::bigint as position from o
  where sha % 10 = 0 or sha - sha % 10 + 10 in (select sha from o)""",
    "history_window": f"""with c0 as ({COMMITS}), c as (select *, max(ct) over (partition by repo order by -position rows unbounded preceding) as landed, sha // 30 as path from c0),
  p as (select sha as pr, -position as bp, landed as bl, unnest([sha // 30, sha // 30 - 1]) as path from c)
  select p.pr, count(distinct c.sha) as commits, count(distinct c.author) as authors, count(distinct case when c.event_type = 'error' then c.sha end) as fixes
  from p left join c on c.path = p.path and -c.position <= p.bp and c.landed > p.bl - 432000 and c.landed <= p.bl group by p.pr""",
    "undoer_vote": f"with v as ({VOTES}) select pr, case when count(distinct actor) filter (actor in ('human', 'agent')) = 1 then max(actor) filter (actor in ('human', 'agent')) end as undone_by from v group by pr",
    "range_overlap": f"""with r as ({RANGES}), h as ({HUNKS})
  select r.id, r.path, coalesce(sum(case when h.path is not null then least(r.last, h.last) - greatest(r.first, h.first) + 1 end), 0)::bigint as covered from r left join h on r.path = h.path and r.first <= h.last and h.first <= r.last group by r.id, r.path""",
    "corrective_candidates": f"{_C} select candidate_id, pr, fix, proxy, lag_seconds, evidence, exclusion, status from cands",
    "corrective_by_horizon": f"""{_C} select pr, horizon_days, corrective, case when known and n > 0 then case rank when 1 then 'low' when 2 then 'medium' else 'high' end end as confidence,
  case when not known then 'base_label_missing' when n = 0 then 'no_accepted_fix' else reasons end as reason_codes, case when known then n else 0 end::int as n_pairs from cor""",
    "corpus_summary": f"""{_C}, s as (select repo, horizon_days, count(*) as n_rows, count(*) filter (corrective) as n_true, count(*) filter (not corrective) as n_false, count(*) filter (corrective is null) as n_unknown from cor group by repo, horizon_days)
  select *, case when n_true + n_false > 0 then floor(n_true / (n_true + n_false)::double * 10000 + 0.5) / 10000 end as rate, {_wilson('n_true', 'n_true + n_false')} from s""",
    "convention_spread": f"""{_C}, r as (select convention, repo, floor(count(*) filter (corrective) / count(corrective)::double * 10000 + 0.5) / 10000 as rate from cor where horizon_days = 60 group by convention, repo)
  select convention, count(*) as repos, min(rate) as least, (array_agg(repo order by rate, repo))[1] as least_repo, max(rate) as largest, (array_agg(repo order by rate desc, repo))[1] as largest_repo from r where rate is not null group by convention""",
    "horizon_terminal": f"with c as ({COMMITS}), k as ({CUTOFFS}) select k.repo, k.cutoff, arg_min(c.sha, c.position) as sha, min(c.position) as position from k left join c on c.repo = k.repo and c.ct <= k.cutoff group by k.repo, k.cutoff",
    "redispatch": f"with r as ({REDISPATCH}), e as (select pr, merged_at, a as k from r union all select pr, merged_at, b + 1000 from r) select distinct x.pr from e x join e y on x.k = y.k and x.pr <> y.pr and y.merged_at > x.merged_at and y.merged_at <= x.merged_at + interval 6 hour",
    "base_rates": f"""with l as ({LABELS}), o as (select repo, horizon_days, case when ratio is null then null when reverted then 'reverted' when ratio < 0.5 then 'substantially_rewritten' when followup then 'followup' else 'survived' end as outcome from l)
  select repo, horizon_days, count(*) as n_rows, count(*) filter (outcome is null) as missing, count(*) filter (outcome = 'survived') as survived, count(*) filter (outcome = 'followup') as followup,
  count(*) filter (outcome = 'substantially_rewritten') as substantially_rewritten, count(*) filter (outcome = 'reverted') as reverted, count(*) filter (outcome = 'survived') / count(outcome)::double as survival_rate from o group by repo, horizon_days""",
    "latest_wins": "select user_id, event_type, ts, event_id, value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1",
    "multiset_survival": """with l as (select l_orderkey as pr, l_suppkey % 2 as file, l_returnflag as line, l_linenumber > 3 as later from lineitem),
  a as (select pr, file, line, count(*) as added from l where not later group by all), b as (select pr, file, line, count(*) as removed from l where later group by all)
  select a.pr, sum(added)::bigint as lines, sum(least(added, coalesce(removed, 0)))::bigint as undone, 1 - sum(least(added, coalesce(removed, 0))) / sum(added)::double as line_survival from a left join b on a.pr = b.pr and a.file = b.file and a.line = b.line group by a.pr""",
    "label_state_asof": f"""with e as ({LABEL_EVENTS}), s as (select * from e where "at" <= as_of), l as (select pr, label, arg_max(action, ordinal) as action from s where label is not null group by pr, label),
  g as (select pr, string_agg(label, ',' order by label) as labels from l where action = 'labeled' group by pr), u as (select pr, bool_or(label is null) as unnamed from s group by pr)
  select p.pr, case when coalesce(unnamed, false) then null else coalesce(labels, '') end as labels from (select distinct pr from e) p left join g on g.pr = p.pr left join u on u.pr = p.pr""",
    "title_asof": f"""with r as ({RENAMES}), p as (select distinct user_id as pr from events), a as (select pr, arg_max(new_title, "at") filter ("at" <= timestamp '2024-01-15 12:00:00') as n, arg_min(old_title, "at") as o from r group by pr)
  select p.pr, coalesce(n, o, 'now') as title from p left join a on a.pr = p.pr""",
    "process_features": f"""with r as ({REVIEWS}) select pr, count(*) filter ("at" <= as_of) as reviews, count(*) filter ("at" <= as_of and state = 'approved') as approvals, count(*) filter ("at" <= as_of and state = 'changes_requested') as change_requests,
  count(distinct author) filter ("at" <= as_of) as reviewers, count(distinct date_trunc('hour', "at")) filter ("at" <= as_of) as review_rounds, floor((epoch_us(min("at") filter ("at" <= as_of)) - epoch_us(min(opened_at))) / 3.6e9 * 10000 + 0.5) / 10000 as hours_to_first_review from r group by pr""",
    "issue_originals": "select l_partkey as issue, count(distinct o_orderkey)::int as n from orders join customer on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey where l_shipdate > o_orderdate group by l_partkey having count(distinct o_orderkey) <= 40",
    "prefix_lookup": "with s as (select sha256(cast(c_custkey as varchar)) as sha from customer) select substr(sha, 1, 4) as prefix, case when count(*) = 1 then max(sha) end as sha from s group by 1",
}
