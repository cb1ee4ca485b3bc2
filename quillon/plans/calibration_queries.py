"""Labels as a sample that two models and a person labelled: how well proxies and definitions do, and what is picked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calibration_run as R
from ..session import checkpointed
from . import bindings as B

SEED, RESAMPLES = "s1", 200
PLAN = R.Plan(kappa_floor=0.3, precision_floor=0.2, strong_lines=3)
#: One row a label: the repository is the document's language; what else an item needs follows from its number.
ITEMS = "select doc_id as k, coalesce(lang, 'und') as repo, quality, toxic from labels join documents using (doc_id)"


def _items(s: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    name = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), (i + 1).cast("int"))
    one = F.struct(name(R.PRIORITY, k % 4).alias("proxy"), F.when(k % 5 == 0, "rejected").otherwise("accepted").alias("status"), (k % 6).cast("int").alias("blamed_lines"), F.when(k % 8 == 0, "internal_build").alias("revert_reason"), F.when(k % 5 == 0, name(("bot", "docs", "bump"), k % 3)).alias("exclusion_code"))
    two = F.struct(F.lit("szz").alias("proxy"), F.lit("accepted").alias("status"), (k % 4).cast("int").alias("blamed_lines"), F.lit(None).cast("string").alias("revert_reason"), F.lit(None).cast("string").alias("exclusion_code"))
    stratum = name(R.STRATA, k % 7)
    candidates = F.when(k % 7 == 6, F.array_remove(F.array(one), one)).when(k % 2 == 0, F.array(one)).otherwise(F.array(one, two))
    rows = B.project(s, d, ITEMS).distinct().select("k", k.cast("string").alias("item_id"), k.alias("ordinal"), "repo", stratum.alias("stratum"), candidates.alias("candidates"), (k % 3 == 0).alias("audit"), "quality", "toxic")
    accepted = F.filter("candidates", lambda c: c["status"] == "accepted")
    return rows.withColumn("proxies", F.array_distinct(F.transform(accepted, lambda c: c["proxy"])))


def _sheet(items: DataFrame, flipped: int, missing: int) -> DataFrame:
    k, good = F.col("k"), (F.col("quality") == 1) & (F.col("toxic") == 0)
    yes = F.when(k % flipped == 0, ~good).otherwise(good)
    verdict = F.when(k % 11 == 0, "unclear").when(yes, "yes").otherwise("no")
    rows = items.where(k % missing != 0).select("item_id", "k", verdict.alias("verdict"))
    cause = F.when(F.col("verdict") == "yes", F.concat(F.lit("cause_"), (k % 3).cast("string"))).when(F.col("verdict") == "no", "not_rework").otherwise("unclear")
    exclusion = F.when((F.col("verdict") == "no") & (k % 4 > 0), F.when(k % 4 == 1, "linkage_error").otherwise("other"))
    return rows.select("item_id", "verdict", cause.alias("cause_code"), exclusion.alias("exclusion_code"))


def _inputs(s: SparkSession, d: str) -> tuple[DataFrame, ...]:
    items = checkpointed(_items(s, d))
    cells = items.groupBy("repo", "stratum").agg((F.count(F.lit(1)) * 10 + F.length("repo")).alias("population"))
    return items, cells, *(checkpointed(_sheet(items, *x)) for x in ((17, 13), (9, 19), (10, 23)))


def _estimates(s: SparkSession, d: str) -> DataFrame:
    items, cells, model, _, _ = _inputs(s, d)
    return R.estimates(items, cells, model, PLAN, SEED, RESAMPLES)


def _of(table: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        items, cells, model, second, _ = _inputs(s, d)
        return R.score_calibration(items, cells, model, second, PLAN, SEED, RESAMPLES)[table]

    return run


def _run(s: SparkSession, d: str) -> DataFrame:
    items, cells, model, second, human = _inputs(s, d)
    return R.score_run(items, cells, model, second, human, PLAN, SEED, RESAMPLES)[2]


QUERIES = {
    "calibration_estimates": _estimates, "calibration_counts": _of("counts"), "calibration_strata": _of("strata"), "calibration_rejected": _of("wrongly_rejected"), "calibration_rejected_codes": _of("rejected_by_code"),
    "calibration_linkage": _of("linkage_error"), "calibration_causes": _of("causes"), "calibration_agreement": _of("agreement"), "calibration_run": _run,
}

_STRATA = "['revert', 'repair_reference', 'regression_issue', 'szz_strong', 'szz_weak', 'rejected', 'negative']"
_R4 = "floor(({x}) * 10000 + 0.5) / 10000"


def _sheet_sql(name: str, flipped: int, missing: int) -> str:
    return f"""{name} as (select k, verdict, case verdict when 'yes' then 'cause_' || (k % 3) when 'no' then 'not_rework' else 'unclear' end as cause, case when verdict = 'no' and k % 4 > 0 then case when k % 4 = 1 then 'linkage_error' else 'other' end end as exclusion
   from (select k, case when k % 11 = 0 then 'unclear' when (quality = 1 and toxic = 0) <> (k % {flipped} = 0) then 'yes' else 'no' end as verdict from it where k % {missing} <> 0))"""


_IT = f"""it as (select *, {_STRATA}[k % 7 + 1] as stratum, ['revert', 'repair_reference', 'regression_issue', 'szz'][k % 4 + 1] as p1, k % 7 <> 6 as has1, k % 5 <> 0 as ok1, k % 7 <> 6 and k % 2 = 1 as has2 from (select distinct * from ({ITEMS}))),
 cells as (select repo, stratum, count(*) * 10 + length(repo) as population from it group by repo, stratum), {_sheet_sql('m', 17, 13)}, {_sheet_sql('b', 9, 19)}, {_sheet_sql('h', 10, 23)}"""


def _wilson(k: str, n: str) -> str:
    from .change_queries import _wilson as wilson

    return wilson(k, n)


def _scored(name: str, sheet: str, where: str) -> str:
    """Estimates of each test from a sheet, before the bootstrap: a row a decided item and test."""
    one, two = "has1 and ok1", "has2"
    keep = {
        "cr-0.1.0": f"({one} or {two})", "high_precision": f"({one} and p1 in ('revert', 'repair_reference'))", "szz_min_3": f"({one} and (p1 <> 'szz' or k % 6 >= 3) or {two} and k % 4 >= 3)", "no_internal_build": f"({one} and (p1 <> 'revert' or k % 8 <> 0) or {two})",
        "szz_min_3+no_internal_build": f"({one} and (p1 <> 'szz' or k % 6 >= 3) and (p1 <> 'revert' or k % 8 <> 0) or {two} and k % 4 >= 3)", "defect_repair": f"({one} and p1 in ('repair_reference', 'regression_issue'))",
    }
    tests = [("proxy", p, i, True, f"({one} and p1 = '{p}'" + (f" or {two})" if p == "szz" else ")")) for i, p in enumerate(R.PRIORITY)]
    tests += [("definition", n, i, n != "defect_repair", t) for i, (n, t) in enumerate(keep.items())]
    every = " union all ".join(f"select *, '{scope}' as scope, '{n}' as name, {i} as place, {str(pick).lower()} as may_pick, {t} as pos from {name}_w" for scope, n, i, pick, t in tests)
    every += f" union all select *, 'repo', repo, 0, true, ({one} or {two}) from {name}_w"
    return f"""{name}_d as (select it.*, verdict = 'yes' as yes from it join {sheet} using (k) where verdict in ('yes', 'no') and {where}), {name}_w as (select {name}_d.*, population / count(*) over (partition by repo, stratum)::double as w from {name}_d join cells using (repo, stratum)),
 {name}_e as (select *, case scope when 'definition' then 'd' when 'repo' then 'r' else '' end || measure[1] || ':' || name as key, case when measure = 'precision' then pos else yes end as rel, row_number() over (partition by scope, name, measure, repo, stratum order by k) - 1 as i,
   count(*) over (partition by scope, name, measure, repo, stratum) as size, count(*) over (partition by scope, name, measure) as n, min(k) over (partition by scope, name, measure, repo, stratum) as first from ({every}), (select unnest(['precision', 'recall']) as measure)),
 {name}_p as (select scope, name, place, may_pick, measure, key, {_R4.format(x="sum(case when rel and pos and yes then w else 0 end) / nullif(sum(case when rel then w else 0 end), 0)")} as estimate, count(*) filter (rel) as n from {name}_e group by all)"""


_BOOT = f""" m_o as (select *, n_before as off from m_e join (select key, repo, stratum, coalesce(sum(c) over (partition by key order by f rows between unbounded preceding and 1 preceding), 0)::bigint as n_before from (select key, repo, stratum, count(*) as c, min(k) as f from m_e group by all)) using (key, repo, stratum)),
 g0 as (select key, repo, stratum, b, size, (('0x' || substr(sha256('{SEED}' || chr(0) || key || chr(0) || 'bootstrap'), 1, 8))::bigint + (b * n + off + i + 1) * 1831565813) & 4294967295 as s from m_o, (select unnest(range({RESAMPLES})) as b)),
 g1 as (select *, ((xor(s, s >> 15)::hugeint * (s | 1)::hugeint) & 4294967295::hugeint)::bigint as t from g0),
 g2 as (select *, xor(t, (t + ((xor(t, t >> 7)::hugeint * (t | 61)::hugeint) & 4294967295::hugeint)::bigint) & 4294967295) as v from g1),
 g3 as (select key, repo, stratum, b, floor(xor(v, v >> 14) / 4294967296.0e0 * size)::bigint as i from g2),
 rv as (select key, b, sum(case when rel and pos and yes then w else 0 end) / nullif(sum(case when rel then w else 0 end), 0) as v from g3 join m_e using (key, repo, stratum, i) group by all),
 ci as (select key, list(v order by v) as vs from rv where v is not null group by 1)"""


def _pick(frm: str, also: str = "") -> str:
    return f"(select p.name from {frm}_p p join {frm}_p r on r.scope = p.scope and r.name = p.name and r.measure = 'recall' {also} where p.scope = 'definition' and p.measure = 'precision' and p.may_pick and p.estimate >= {PLAN.precision_floor} order by coalesce(r.estimate, 0) desc, p.place limit 1)"


def _kappa(x: str, y: str, where: str = "true") -> str:
    each = " union all ".join(f"select '{field}' as field, x.{c} as a, y.{c} as b from it join {x} x using (k) join {y} y using (k) where {where}" for field, c in (("corrective", "verdict"), ("cause_code", "cause")))
    each += f" union all select 'exclusion_code', coalesce(x.exclusion, '(none)'), coalesce(y.exclusion, '(none)') from it join {x} x using (k) join {y} y using (k) where x.verdict = 'no' and y.verdict = 'no' and {where}"
    return f"""pr as ({each}), po as (select field, count(*) as pairs, count(*) filter (a = b) / count(*)::double as po from pr group by 1),
 pe as (select field, sum(na * nb) / max(n * n)::double as pe from (select field, a, count(*) as na from pr group by 1, 2) u join (select field, b, count(*) as nb from pr group by 1, 2) v using (field) join (select field, count(*) as n from pr group by 1) w using (field) where a = b group by 1),
 kp as (select field, pairs, case when coalesce(pe, 0) <> 1 then {_R4.format(x='(po - coalesce(pe, 0)) / (1 - coalesce(pe, 0))')} end as kappa from po left join pe using (field))"""


SQL = {
    "calibration_estimates": f"with {_IT}, {_scored('m', 'm', 'true')}, {_BOOT} select scope, name, place, may_pick, measure, estimate, case when estimate is not null then {_R4.format(x='vs[least(len(vs) - 1, floor(0.025e0 * len(vs))::bigint) + 1]')} end as ci_low, case when estimate is not null then {_R4.format(x='vs[least(len(vs) - 1, floor(0.975e0 * len(vs))::bigint) + 1]')} end as ci_high, n from m_p left join ci using (key)",
    "calibration_counts": f"""with {_IT} select count(*) as items, count(verdict) as labelled, count(*) - count(verdict) as unlabelled, count(*) filter (verdict = 'unclear') as unclear,
  (select coalesce(sum(population), 0)::bigint from cells c where not exists (select 1 from it join m using (k) where verdict in ('yes', 'no') and it.repo = c.repo and it.stratum = c.stratum)) as unrepresented_population from it left join m using (k)""",
    "calibration_strata": f"""with {_IT}, s as (select unnest(range(7)) as place), n as (select k % 7 as place, count(*) as sampled, count(*) filter (verdict = 'yes') as yes, count(*) filter (verdict = 'no') as no, count(*) filter (verdict = 'unclear') as unclear, count(*) filter (verdict is null) as unlabelled from it left join m using (k) group by 1),
  f as (select place, {_STRATA}[place + 1] as stratum, coalesce(sampled, 0) as sampled, coalesce(yes, 0) as yes, coalesce(no, 0) as no, coalesce(unclear, 0) as unclear, coalesce(unlabelled, 0) as unlabelled from s left join n using (place))
  select *, case when yes + no > 0 then {_R4.format(x='yes / (yes + no)::double')} end as yes_rate, {_wilson('yes', '(yes + no)')} from f""",
    "calibration_rejected": f"with {_IT}, n as (select count(*) filter (verdict = 'yes') as yes, count(*) filter (verdict in ('yes', 'no')) as decided from it join m using (k) where stratum = 'rejected') select yes, decided, case when decided > 0 then {_R4.format(x='yes / decided::double')} end as rate, {_wilson('yes', 'decided')} from n",
    "calibration_rejected_codes": f"""with {_IT}, r as (select it.*, coalesce(exclusion, '(none)') as human from it join m using (k) where stratum = 'rejected' and verdict = 'no'),
  c as (select k, human, case when ok1 then '(accepted)' else ['bot', 'docs', 'bump'][k % 3 + 1] end as automatic from r union select k, human, '(accepted)' from r where has2) select automatic, human, count(*) as n from c group by all""",
    "calibration_linkage": f"""with {_IT}, c as (select k, p1 as proxy from it where has1 and ok1 union select k, 'szz' from it where has2), p as (select unnest(['revert', 'repair_reference', 'regression_issue', 'szz']) as proxy),
  n as (select proxy, count(*) as no, count(*) filter (exclusion = 'linkage_error') as linkage_error from c join m using (k) where verdict = 'no' group by 1), f as (select proxy, coalesce(no, 0) as no, coalesce(linkage_error, 0) as linkage_error from p left join n using (proxy))
  select *, case when no > 0 then {_R4.format(x='linkage_error / no::double')} end as rate from f""",
    "calibration_causes": f"with {_IT}, {_scored('m', 'm', 'true')}, y as (select cause as cause_code, count(*) as raw, sum(w) as s from m_w join m using (k) where yes group by 1) select cause_code, raw, {_R4.format(x='s / sum(s) over ()')} as weighted_share from y",
    "calibration_agreement": f"with {_IT}, {_kappa('m', 'b')} select field, pairs, kappa from kp",
    "calibration_run": f"""with {_IT}, {_scored('m', 'm', 'true')}, {_scored('u', 'h', 'k % 3 = 0')}, {_kappa('h', 'm', 'k % 3 = 0')}, s as (select coalesce(max(kappa >= {PLAN.kappa_floor}) filter (field = 'corrective'), false) as stands from kp),
  c as (select stands, case when stands then {_pick('m', f"join u_p q on q.scope = p.scope and q.name = p.name and q.measure = 'precision' and q.estimate >= {PLAN.precision_floor}")} else {_pick('u')} end as d from s)
  select stands as models_stand_in, case when stands then 'model' else 'human' end as primary, d as chosen_definition, case when stands then 'primary_and_human' else 'primary' end as pick_rule, coalesce(d, 'cr-0.1.0') as gate_definition, estimate as gate_precision, n as gate_items
  from c left join u_p on u_p.scope = 'definition' and u_p.measure = 'precision' and u_p.name = coalesce(d, 'cr-0.1.0')""",
}
