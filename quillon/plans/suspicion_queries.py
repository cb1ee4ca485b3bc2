"""Orders as rows with features, one of which knows the label and one of whose nulls follow the calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import suspicion
from . import bindings as B

ROWS = """
select o_orderkey as row_id, c_mktsegment as repo, o_orderdate as as_of, case when (o_totalprice > 250000 and o_custkey % 3 = 0) or o_orderstatus = 'P' then 1 else 0 end as y, case when o_custkey % 7 > 0 then o_totalprice end as price,
  case when o_custkey % 11 = 0 then 1 - case when (o_totalprice > 250000 and o_custkey % 3 = 0) or o_orderstatus = 'P' then 1 else 0 end else case when (o_totalprice > 250000 and o_custkey % 3 = 0) or o_orderstatus = 'P' then 1 else 0 end end as leak,
  case when o_orderdate < timestamp '1994-01-01' then null else o_custkey % 13 end as late, case when o_custkey % 5 > 0 then o_orderpriority end as priority, o_orderstatus as status
from orders join customer on o_custkey = c_custkey
"""
NUMBERS, CATEGORIES, RECENT = ["price", "leak", "late"], ["priority", "status"], "1996-01-01"


def _scan(s: SparkSession, d: str) -> DataFrame:
    found = suspicion.suspicion_scan(B.project(s, d, ROWS), NUMBERS, CATEGORIES, RECENT)
    return found.withColumn("flags", F.array_join("flags", ","))


QUERIES = {"suspicion_scan": _scan}

_R4 = "floor({} * 10000 + 0.5) / 10000"


def _area(name: str, keys: str, label: str, value: str, test: str) -> str:
    return f"""{name} as (select {keys}, case when max(p) > 0 and max(p) < max(n) then (sum(r) - max(p) * (max(p) + 1) / 2.0e0) / (max(p) * (max(n) - max(p))) end as area, max(p) as p from (
   select {keys}, case when {label} = 1 then rank() over (partition by {keys} order by {value}) + (count(*) over (partition by {keys}, {value}) - 1) / 2.0e0 end as r, sum({label}) over (partition by {keys}) as p, count(*) over (partition by {keys}) as n from l where {test}) group by {keys})"""


SQL = {
    "suspicion_scan": f"""with rows_ as ({ROWS}), l0 as (unpivot (select row_id, repo, as_of, y, price::double as price, leak::double as leak, late::double as late, avg(y) over (partition by priority) as priority, avg(y) over (partition by status) as status, priority is null as no_priority from rows_) on price, leak, late, priority, status into name name value x),
 every as (select row_id, repo, as_of, y, name, priority is null as no_priority from rows_, (select unnest(['price', 'leak', 'late', 'priority', 'status']) as name)),
 l as (select e.name, e.repo, e.y, (e.as_of >= timestamp '{RECENT}')::int as recent, year(e.as_of) || '-Q' || quarter(e.as_of) as q, case when e.name = 'priority' and e.no_priority then null else x end as x from every e left join l0 on l0.row_id = e.row_id and l0.name = e.name),
 {_area('a', 'name', 'y', 'x', 'x is not null')}, {_area('w', 'name, repo', 'y', 'x', 'x is not null')}, {_area('u', 'name', 'y', '(x is null)', 'true')}, {_area('t', 'name', 'recent', 'x', 'x is not null')},
 wi as (select name, sum(area * p) / sum(p) as area from w where area is not null group by 1), sw as (select name, max(r) - min(r) as s from (select name, q, {_R4.format('avg((x is null)::int)')} as r from l group by 1, 2) group by 1),
 m as (select c.name, c.n, a.area as a, wi.area as w, u.area as u, t.area as t, s from (select name, count(x) as n from l group by 1) c left join a using (name) left join wi using (name) left join u using (name) left join t using (name) left join sw using (name))
 select name, n as non_null, {_R4.format('a')} as auc, {_R4.format('w')} as within_repo_auc, {_R4.format('u')} as null_indicator_auc, {_R4.format('t')} as recent_period_auc, {_R4.format('s')} as null_rate_swing,
   concat_ws(',', case when greatest(a, 1 - a) >= 0.75 then 'high_single_feature_auc' end, case when greatest(w, 1 - w) >= 0.75 then 'high_within_repo_auc' end, case when greatest(u, 1 - u) >= 0.75 then 'null_indicator_predicts_label' end, case when s > 0.2 then 'null_rate_tracks_time' end) as flags from m""",
}
