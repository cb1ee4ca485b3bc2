"""Shadow scoring, report and calibration queries."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import calibration, report, shadow
from . import bindings as B
from .change_queries import _wilson


def _joined(s: SparkSession, d: str) -> DataFrame:
    return shadow.with_outcomes(B.project(s, d, B.SCORES), B.project(s, d, B.OUTCOMES), 30)


FEATURES = """
select o_orderkey as pr, cast(o_totalprice / 100 as bigint) as loc, o_custkey % 70 as files, o_orderkey % 3 = 0 as tests, o_orderkey % 7 = 0 as uncertain, case when o_orderkey % 5 = 0 then null else o_orderkey % 30 end as type_errors,
  o_orderkey % 60 as lint_errors, case when o_orderkey % 4 = 0 then null else o_orderkey % 9 <> 0 end as build_ok, o_orderkey % 80 - 20 as complexity, o_orderkey % 8 as requests, o_orderkey % 12 as rounds from orders
"""


def _scores(s: SparkSession, d: str) -> DataFrame:
    names = ("loc", "files", "tests", "uncertain", "type_errors", "lint_errors", "build_ok", "complexity", "requests", "rounds")
    return B.project(s, d, FEATURES.replace("cast(o_totalprice / 100 as bigint)", "cast(floor(o_totalprice / 100) as bigint)")).select("pr", X.round4(X.baseline_score(*[F.col(c) for c in names])).alias("score"))


RISK = "select o_orderstatus as horizon, o_orderpriority as bucket, o_orderkey % 11 = 0 as reworked, o_totalprice as size from orders"


def _quartiles(s: SparkSession, d: str) -> DataFrame:
    rows = B.project(s, d, RISK)
    cuts = report.quartile_cuts(rows, ["horizon"], "size")
    return rows.join(cuts, "horizon").groupBy("horizon", X.quartile_of(F.col("size"), F.col("q1"), F.col("q2"), F.col("q3")).alias("quartile")).agg(F.count(F.lit(1)).alias("n"), F.min("q2").alias("median"))


def _cells(s: SparkSession, d: str) -> DataFrame:
    rows = B.read(s, d, "events").groupBy((F.col("user_id") % 6).alias("section"), F.col("event_type").alias("cell"), (F.col("event_id") % 12).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 20).alias("k"))
    low, high = X.wilson(F.col("k"), F.col("n"))
    made = rows.select(F.col("section"), "cell", "part", "n", F.when(F.col("section") == 2, 0.4).otherwise(0.9).alias("coverage"), X.round4(F.col("k") / F.col("n")).alias("value"), low.alias("ci_low"), high.alias("ci_high"))
    return report.suppress(made)


def _weights(s: SparkSession, d: str) -> DataFrame:
    return B.read(s, d, "labels").select((F.col("doc_id") % 5 + 1).alias("weight"), F.when(F.col("quality") == 1, "yes").otherwise("no").alias("verdict"), (F.col("toxic") == 0).alias("positive"))


UNITS = "select cast(o_orderkey as {text}) as unit, c_mktsegment as repo, o_orderstatus as stratum, o_totalprice as size from orders join customer on o_custkey = c_custkey"


def _units(s: SparkSession, d: str) -> DataFrame:
    return B.project(s, d, UNITS)


def _due(s: SparkSession, d: str) -> DataFrame:
    due = shadow.due_outcomes(B.project(s, d, B.SCORES), B.project(s, d, B.OUTCOMES).where("ordinal % 3 = 0"), 30, datetime.datetime(1997, 1, 1, tzinfo=datetime.timezone.utc))
    return due.groupBy("repo", "matured").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "shadow_report": lambda s, d: shadow.report(_joined(s, d)),
    "threshold_sweep": lambda s, d: shadow.threshold_sweep(_joined(s, d)),
    "baseline_scores": _scores,
    "pending_anti_join": _due,
    "unscored": lambda s, d: shadow.unscored(B.project(s, d, B.SCORES).select("repo", "merge_sha", "merged_at"), B.project(s, d, B.SCORES).where("merge_sha % 3 = 0")),
    "risk_ratio": lambda s, d: report.bucket_risk(B.project(s, d, RISK), ["horizon"], "bucket", "reworked"),
    "quartile_buckets": _quartiles,
    "suppression": lambda s, d: _cells(s, d).withColumn("reasons", F.concat_ws(",", "reasons")),
    "section_status": lambda s, d: report.section_status(_cells(s, d)).withColumn("reasons", F.concat_ws(",", "reasons")),
    "macro_micro": lambda s, d: report.macro_micro(B.read(s, d, "events").groupBy("user_id").agg(F.count_if(F.col("value") > 20).alias("k"), F.count(F.lit(1)).alias("n"))),
    "auc": lambda s, d: report.area_under_curve(B.read(s, d, "lineitem").select("l_returnflag", "l_quantity", (F.col("l_linestatus") == "O").alias("late")), ["l_returnflag"], "l_quantity", "late"),
    "kappa": lambda s, d: calibration.kappa(B.project(s, d, B.RATERS)),
    "kappa_per_code": lambda s, d: calibration.kappa_per_code(B.project(s, d, B.RATERS), ["0", "1", "2"], 0.6),
    "weighted_pr": lambda s, d: calibration.weighted_rates(_weights(s, d)),
    "seeded_draw": lambda s, d: calibration.round_robin_draw(_units(s, d), "seed-1", 25).select("stratum", "repo", "unit", "turn", "place"),
    "hash_sample": lambda s, d: calibration.stratified_sample(_units(s, d), "seed-2", "unit", ["repo", "stratum"], 7).select("repo", "stratum", "unit", "rank", "population", "sampled"),
    "tercile_bands": lambda s, d: calibration.tercile_bands(_units(s, d), "size", "unit").select("unit", "band"),
    "canonical_hash": lambda s, d: B.read(s, d, "orders").select("o_orderkey", X.sha_id([F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderpriority")]).alias("id")),
    "task_family": lambda s, d: B.read(s, d, "part").select("p_partkey", X.task_family(F.concat_ws(" ", F.lit("fix the"), F.when(F.col("p_size") % 3 == 0, "broken").otherwise("docs"), F.when(F.col("p_size") % 5 == 0, "tests"))).alias("family")),
    "bucketizers": lambda s, d: B.read(s, d, "part").select("p_partkey", X.repository_scale(F.col("p_size") * 200).alias("scale"), X.files_bucket(F.col("p_size")).alias("files")),
}

_S = f"with scores as ({B.duck_sql(B.SCORES)}), o as (select repo, merge_sha, survived from ({B.OUTCOMES}) qualify row_number() over (partition by repo, merge_sha order by ordinal desc, survived desc nulls last) = 1), j as (select scores.*, o.merge_sha is not null as has_outcome, o.survived from scores left join o on o.repo = scores.repo and o.merge_sha = scores.merge_sha)"


def _r4(n: str, d: str) -> str:
    return f"case when ({d}) <> 0 then floor(({n}) / ({d})::double * 10000 + 0.5) / 10000 end"


def _flag(t: str) -> str:
    return f"count(*) filter (score < {t}) as n_flagged, count(*) filter (score < {t} and survived is not null) as fm, count(*) filter (score < {t} and not survived) as fn, count(*) filter (score < {t} and survived) as fs, count(*) filter (survived) as sv"


_RATES = f"{_r4('n_flagged', 'n_scored')} as would_flag_rate, {_r4('fn', 'fm')} as \"precision\", {_r4('fs', 'sv')} as false_positive_rate"
_CELLS = """with c as (select user_id % 6 as section, event_type as cell, event_id % 12 as part, count(*) as n, count(*) filter (value > 20) as k from events group by all),
d as (select section, cell, part, n, case when section = 2 then 0.4e0 else 0.9e0 end as coverage, floor(k / n::double * 10000 + 0.5) / 10000 as v, {w} from c)""".format(w=_wilson("k", "n"))
_U = f"with u as ({B.duck_sql(UNITS)})"

SQL = {
    "shadow_report": f"""{_S}, t as (select *, arg_max(threshold, ordinal) over (partition by repo) as th from j), m as (select repo, count(*) as n_scored, count(survived) as n_matured, count(*) filter (has_outcome and survived is null) as n_unlabelled, {_flag('th')} from t group by repo),
  c as (select repo, scorer_id, count(*) as n, min(ordinal) as f from j group by repo, scorer_id), x as (select repo, (array_agg(scorer_id order by n desc, f))[1] as scorer_id, count(*) > 1 as scorer_mixed from c group by repo)
  select m.repo, n_scored, n_matured, n_unlabelled, n_flagged, {_RATES}, {_r4('sv', 'n_matured')} as base_survival_rate, scorer_id, scorer_mixed from m join x on m.repo = x.repo""",
    "threshold_sweep": f"{_S}, a as (select floor(i * 0.05e0 * 10000 + 0.5) / 10000e0 as threshold from range(1, 20) r(i)), m as (select repo, threshold, count(*) as n_scored, {_flag('a.threshold').replace('a.threshold', 'thr')} from (select j.* exclude (threshold), a.threshold, a.threshold as thr from j cross join a) group by repo, threshold) select repo, threshold, n_flagged as would_flag_count, {_RATES} from m",
    "baseline_scores": f"""with f as ({FEATURES.replace('cast(o_totalprice / 100 as bigint)', 'cast(floor(o_totalprice / 100) as bigint)')}), z as (select pr, 2.0e0 - log2(1 + loc) * 0.35e0 / log2(2001) * 4 - least(files, 50) * 0.25e0 / 50 * 4 + case when tests then 0.4e0 else 0 end - case when uncertain then 0.5e0 else 0 end
  - least(coalesce(type_errors, 0), 20) * 0.3e0 / 20 - least(lint_errors, 50) * 0.3e0 / 50 - case when not build_ok then 0.6e0 else 0 end - greatest(least(complexity, 50), 0) * 0.2e0 / 50 - least(requests, 5) * 0.15e0 - least(rounds, 10) * 0.05e0 as z from f)
  select pr, floor(floor(1 / (1 + exp(-z)) * 1000000 + 0.5) / 1000000 * 10000 + 0.5) / 10000 as score from z""",
    "pending_anti_join": f"with scores as ({B.duck_sql(B.SCORES)}), o as ({B.OUTCOMES}) select repo, merged_at + interval 30 day <= timestamp '1997-01-01' as matured, count(*) as n from scores where not exists (select 1 from o where o.ordinal % 3 = 0 and o.repo = scores.repo and o.merge_sha = scores.merge_sha) group by 1, 2",
    "unscored": f"with scores as ({B.duck_sql(B.SCORES)}) select repo, merge_sha, merged_at from scores where merge_sha % 3 <> 0",
    "risk_ratio": f"""with r as ({RISK}), g as (select horizon, bucket, count(*) filter (reworked) as k, count(*) as n from r group by all), b as (select *, sum(k) over (partition by horizon)::bigint - k as k_other, sum(n) over (partition by horizon)::bigint - n as n_other from g),
  h as (select *, case when k = 0 or k = n or k_other = 0 or k_other = n_other then 0.5e0 else 0.0e0 end as e from b), q as (select *, k + e as a, n - k + e as bb, k_other + e as c, n_other - k_other + e as d from h),
  v as (select *, (a / (a + bb)) / (c / (c + d)) as rr, 1.959964e0 * sqrt(1 / a - 1 / (a + bb) + 1 / c - 1 / (c + d)) as sp from q),
  w as (select *, floor((rr + 2.220446049250313e-16) * 10000 + 0.5) / 10000 as ra, floor((exp(ln(rr) - sp) + 2.220446049250313e-16) * 10000 + 0.5) / 10000 as rl, floor((exp(ln(rr) + sp) + 2.220446049250313e-16) * 10000 + 0.5) / 10000 as rh, {_wilson('k', 'n')} from v)
  select horizon, bucket, k, n, k_other, n_other, ci_low as rate_low, ci_high as rate_high, case when n_other > 0 then ra end as ratio, case when n_other > 0 then least(ra, rl) end as ratio_low, case when n_other > 0 then greatest(ra, rh) end as ratio_high from w""",
    "quartile_buckets": f"""with r as ({RISK}), o as (select *, row_number() over (partition by horizon order by size) as i, count(*) over (partition by horizon) as n from r),
  c as (select horizon, max(size) filter (i = ceil(0.25 * n)) as q1, max(size) filter (i = ceil(0.5 * n)) as q2, max(size) filter (i = ceil(0.75 * n)) as q3 from o group by horizon)
  select r.horizon, case when size <= q1 then 'q1' when size <= q2 then 'q2' when size <= q3 then 'q3' else 'q4' end as quartile, count(*) as n, min(q2) as median from r join c on r.horizon = c.horizon group by 1, 2""",
    "suppression": f"""{_CELLS} select section, cell, part, n, coverage, case when not (n < 20 or coverage < 0.6) then v end as "value", case when not (n < 20 or coverage < 0.6) then ci_low end as ci_low, case when not (n < 20 or coverage < 0.6) then ci_high end as ci_high,
  n < 20 or coverage < 0.6 as suppressed, concat_ws(',', case when n < 20 then 'n_below_floor' end, case when coverage < 0.6 then 'coverage_below_floor' end) as reasons from d""",
    "section_status": f"""{_CELLS} select section, case when bool_and(n < 20 or coverage < 0.6) then 'suppressed' else 'shown' end as status, concat_ws(',', case when bool_or(coverage < 0.6) then 'coverage_below_floor' end, case when bool_or(n < 20) then 'n_below_floor' end) as reasons from d group by section""",
    "macro_micro": "with c as (select user_id, count(*) filter (value > 20) as k, count(*) as n from events group by 1) select floor(avg(k / n::double) * 10000 + 0.5) / 10000 as macro, floor(sum(k) / sum(n)::double * 10000 + 0.5) / 10000 as micro from c",
    "auc": """with c as (select l_returnflag, l_quantity, count(*) filter (l_linestatus = 'O') as p, count(*) filter (l_linestatus <> 'O') as q from lineitem group by all), b as (select *, coalesce(sum(q) over (partition by l_returnflag order by l_quantity rows between unbounded preceding and 1 preceding), 0) as below from c),
  a as (select l_returnflag, sum(p * (2 * below + q)) as u, sum(p)::bigint as positives, sum(q)::bigint as negatives from b group by 1)
  select l_returnflag, positives, negatives, case when positives > 0 and negatives > 0 then floor(u / (2 * positives * negatives)::double * 10000 + 0.5) / 10000 end as auc from a""",
    "kappa": f"with p as ({B.duck_sql(B.RATERS)}), n as (select count(*)::bigint as n, count(*) filter (x = y)::bigint as g from p), e as (select sum(a * b)::bigint as ab from (select x, count(*) as a from p group by 1) i join (select y, count(*) as b from p group by 1) k on i.x = k.y) select n as pairs, floor((g / n::double - ab / (n * n)::double) / (1 - ab / (n * n)::double) * 10000 + 0.5) / 10000 as kappa from n, e",
    "kappa_per_code": f"""with p as ({B.duck_sql(B.RATERS)}), k(code) as (values ('0'), ('1'), ('2')), q as (select code, x = code as x, y = code as y from p cross join k), m as (select code, count(*) as n, count(*) filter (x or y) as used, count(*) filter (x = y) as g,
  count(*) filter (x) as x1, count(*) filter (y) as y1 from q group by code), v as (select *, (x1 * y1 + (n - x1) * (n - y1)) / (n * n)::double as pe, g / n::double as po from m), r as (select code, used, case when used > 0 and pe <> 1 then floor((po - pe) / (1 - pe) * 10000 + 0.5) / 10000 end as kappa from v)
  select code, used, kappa, case when used = 0 then 'not_observed' when kappa is null then 'undefined' when kappa >= 0.6 then 'pass' else 'below_floor' end as verdict from r""",
    "weighted_pr": f"with w as (select doc_id % 5 + 1 as w, quality = 1 as yes, toxic = 0 as pos from labels), s as (select coalesce(sum(w) filter (yes and pos), 0) as b, coalesce(sum(w) filter (pos), 0) as p, coalesce(sum(w) filter (yes), 0) as y from w) select {_r4('b', 'p')} as \"precision\", {_r4('b', 'y')} as recall from s",
    "seeded_draw": f"{_U}, t as (select *, row_number() over (partition by stratum, repo order by sha256(concat('seed-1', chr(0), unit)), unit) as turn from u) select stratum, repo, unit, turn, row_number() over (partition by stratum order by turn, sha256(concat('seed-1', chr(0), repo)), unit) as place from t qualify place <= 25",
    "hash_sample": f"{_U} select repo, stratum, unit, row_number() over (partition by repo, stratum order by sha256(concat('seed-2', chr(0), unit)), unit) as rank, count(*) over (partition by repo, stratum) as population, least(count(*) over (partition by repo, stratum), 7) as sampled from u qualify rank <= 7",
    "tercile_bands": f"{_U} select unit, case when i < n // 3 then 0 when i < 2 * n // 3 then 1 else 2 end as band from (select unit, row_number() over (partition by repo order by size, unit) - 1 as i, count(*) over (partition by repo) as n from u)",
    "canonical_hash": "select o_orderkey, sha256(concat(cast(o_orderkey as varchar), chr(0), cast(o_custkey as varchar), chr(0), o_orderpriority)) as id from orders",
    "task_family": "select p_partkey, case when p_size % 5 = 0 then 'mixed' when p_size % 3 = 0 then 'bugfix' else 'docs' end as family from part",
    "bucketizers": "select p_partkey, case when p_size * 200 < 100 then 'small' when p_size * 200 < 1000 then 'medium' when p_size * 200 < 10000 then 'large' else 'xlarge' end as scale, case when p_size <= 1 then '1' when p_size <= 5 then '2-5' when p_size <= 15 then '6-15' else '16+' end as files from part",
}
