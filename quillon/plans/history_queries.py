"""Orders as commits: histories of a repository a market segment, their windows, and which change each commit landed.

Of each ten orders of a segment six are on the first-parent line (0 to 5) and four are a side branch that leaves
it after the sixth (6 to 9). The next line commit merges the branch, but for every third block; of those it
merges every other is a rollup whose branch are its members. Subjects name changes in several ways.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history
from ..operators.scans import prefix_scan
from ..session import settled
from . import bindings as B

# i: the order's place in its segment, from 10 on; b: its block; k: its place in the block
INDEXED = """
select c_mktsegment as repo, o_orderdate as at, 9 + row_number() over (partition by c_mktsegment order by o_orderkey) as i from orders join customer on o_custkey = c_custkey
"""


# the same, but the place is counted over all tasks and not by a window over a segment
ORDERS = "select c_mktsegment as repo, o_orderdate as at, o_orderkey as key from orders join customer on o_custkey = c_custkey"


def _indexed(s: SparkSession, d: str) -> DataFrame:
    counted = prefix_scan(B.project(s, d, ORDERS), ["repo"], ["key"], {"n": ("sum", F.lit(1).cast("long"))})
    return _placed(counted.select("repo", "at", (9 + F.col("n")).alias("i")))


def _placed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"b": F.expr("i div 10"), "k": F.expr("i % 10")})


def _sha(i) -> F.Column:
    return F.concat(F.lit("c"), i.cast("string"))


def commits(s: SparkSession, d: str) -> DataFrame:
    i, b, k = F.col("i"), F.col("b"), F.col("k")
    first = F.when(i == 10, None).when(k == 0, _sha(i - 5)).otherwise(_sha(i - 1))
    second = F.when((k == 0) & ((b - 1) % 3 != 2) & (b > 1), _sha(i - 1))
    n = i.cast("string")
    merge = F.when((b - 1) % 3 == 1, F.concat(F.lit("Rollup of changes (#"), n, F.lit(")"))).when((b - 1) % 3 == 0, F.concat(F.lit("Merge pull request #"), n, F.lit(" from x/y"))).otherwise(F.concat(F.lit("Merge #"), n, F.lit(" #"), (i + 1).cast("string")))
    line = F.when(k == 0, merge).when(k == 1, F.concat(F.lit("Fix it (#"), n, F.lit(")"))).when(k == 5, F.concat(F.lit("Auto merge of #"), (i - 4).cast("string"), F.lit(" - a:b"))).when(k == 3, "Revert that").otherwise("no number")
    side = F.when(b % 3 == 1, F.concat(F.lit("Rollup merge of #"), n, F.lit(" - a:b"))).otherwise("wip")
    body = F.when(i % 7 == 0, F.concat(F.lit("Pull Request resolved: https://github.com/"), F.col("repo"), F.lit("/pull/"), (i + 2).cast("string"))).otherwise("")
    return _indexed(s, d).select("repo", "i", _sha(i).alias("sha"), F.array_compact(F.array(first, second)).alias("parents"), F.unix_timestamp("at").alias("ct"), F.when(k <= 5, line).otherwise(side).alias("subject"), body.alias("body"))


def _line(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = settled(commits(s, d), "commits")
    tips = _placed(rows).where("k <= 5").groupBy("repo").agg(_sha(F.max("i")).alias("sha"))
    return rows, settled(history.first_parent_line(rows, tips, near="i"), "line")


def _index(s: SparkSession, d: str) -> DataFrame:
    rows, line = _line(s, d)
    return history.landing_index(rows, line)


def _ancestors(s: SparkSession, d: str) -> DataFrame:
    rows, line = _line(s, d)
    i = F.col("i")
    pairs = rows.select("repo", "i", "sha", _sha(i + i % 31 - 8).alias("head"))
    return history.is_ancestor(pairs, settled(history.landing_index(rows, line)), rows).select("repo", "i", "held")


def _windows(s: SparkSession, d: str) -> DataFrame:
    rows, line = _line(s, d)
    # a cursor of another kind for each: none, on the line, on a landed branch, on one that never landed, unknown; the block in the middle of which the cursor lies: of the kind that it needs
    middle = rows.groupBy("repo").agg(F.expr("(max(i) div 60) * 3").alias("m"))
    cursor = F.when(F.col("repo") == "BUILDING", _sha(F.col("m") * 10 + 3)).when(F.col("repo") == "FURNITURE", _sha(F.col("m") * 10 + 7)).when(F.col("repo") == "HOUSEHOLD", _sha((F.col("m") + 2) * 10 + 8)).when(F.col("repo") == "MACHINERY", "gone")
    asked = middle.select("repo", F.lit(700_000_000).alias("since"), F.lit(880_000_000).alias("until"), cursor.alias("cursor"), F.when(F.col("repo").isin("AUTOMOBILE", "BUILDING"), F.lit(100)).alias("most"))
    found = history.merge_window(rows, line, history.landing_index(rows, line), asked)
    return found.drop("subject")


def _changes(rows: DataFrame) -> DataFrame:
    i, k = F.col("i"), F.col("k")
    merged = F.when(k.isin(1, 4) | (i % 20 == 0), _sha(i))
    return _placed(rows).where("i % 13 <> 5").select("repo", i.alias("pr"), merged.alias("merge_sha"), F.when(k == 4, 2 + F.col("b") % 3).otherwise(1).alias("member_commits"))


def _mapping(s: SparkSession, d: str) -> DataFrame:
    rows, line = _line(s, d)
    records, _ = history.map_changes(rows, line, _changes(rows))
    return records.select(*[c for c in records.columns if c != "relanded"], F.concat_ws(",", "relanded").alias("relanded"))


def _stats(s: SparkSession, d: str) -> DataFrame:
    rows, line = _line(s, d)
    records, fates = history.map_changes(rows, line, _changes(rows))
    return history.mapping_stats(records, fates, rows, history.rollup_members(rows, line))


QUERIES = {
    "first_parent_line": lambda s, d: _line(s, d)[1],
    "landing_index": _index,
    "ancestor_tests": _ancestors,
    "merge_windows": _windows,
    "rollup_members": lambda s, d: history.rollup_members(*_line(s, d)),
    "change_mapping": _mapping,
    "mapping_stats": _stats,
}

_I = f"""ix as (select *, i // 10 as b, i % 10 as k from ({INDEXED})),
 cm as (select repo, i, b, k, 'c' || i as sha, case when i = 10 then null when k = 0 then i - 5 else i - 1 end as p1, case when k = 0 and (b - 1) % 3 <> 2 and b > 1 then i - 1 end as p2, epoch("at")::bigint as ct from ix),
 tp as (select repo, max(i) as tip from ix where k <= 5 group by 1)"""
_LINE = f"""with recursive {_I}, walk as (select repo, tip as i, 0 as d from tp union all select w.repo, c.p1, w.d + 1 from walk w join cm c on c.repo = w.repo and c.i = w.i where c.p1 is not null),
 ln as (select repo, i, (max(d) over (partition by repo) - d)::bigint as position from walk)"""
# each change goes to its first commit; a rebase claims back to the last commit that is somebody's or names a change. Tests hold the operator against one loop over the line
_FOLD = f"""{_LINE}, ch as (select repo, i as pr, case when k in (1, 4) or i % 20 = 0 then i end as merged, case when k = 4 then 2 + b % 3 else 1 end as wanted from ix where i % 13 <> 5),
 nm as (select l.repo, l.position, c.i, c.p1, c.p2 is not null as is_merge, case when c.k = 0 and (c.b - 1) % 3 = 2 then [c.i, c.i + 1] when c.k in (0, 1) then [c.i] when c.k = 5 then [c.i - 4] else [] end || case when c.i % 7 = 0 then [c.i + 2] else [] end as numbers,
   case when c.p2 is not null and (c.b - 1) % 3 = 1 then [c.i - 4, c.i - 3, c.i - 2, c.i - 1] end as members from ln l join cm c on c.repo = l.repo and c.i = l.i),
 c0 as (select n.repo, n.position, n.i, ch.pr, true as via from nm n join ch on ch.repo = n.repo and ch.merged = n.i union all select n.repo, n.position, n.i, n.pr, false from (select repo, position, i, unnest(numbers) as pr from nm) n semi join ch on ch.repo = n.repo and ch.pr = n.pr),
 cd as (select repo, position, i, pr, bool_or(via) as via from c0 group by all),
 ev as (select cd.*, case when members is not null then 0 else 1 end as kind, -1 as o from cd join nm using (repo, position) union all select n.repo, n.position, n.i, n.pr, false, 2, n.pr from (select repo, position, i, unnest(members) as pr from nm) n semi join ch on ch.repo = n.repo and ch.pr = n.pr),
 wn as (select * from ev qualify row_number() over (partition by repo, pr order by position, o) = 1),
 ld as (select repo, position, count(*) as landed from wn where kind = 1 group by all),
 ag as (select cd.repo, cd.pr, cd.position, cd.i from cd join nm using (repo, position) anti join ld on ld.repo = cd.repo and ld.position = cd.position where members is null),
 re as (select ag.* from ag join wn using (repo, pr) where wn.kind > 0 and ag.position > wn.position),
 st as (select n.*, landed, case when members is not null then 'rollup' when landed is not null then 'landed' when exists (select 1 from re where re.repo = n.repo and re.position = n.position) then 'relanded' end as state from nm n left join ld using (repo, position)),
 sp as (select *, max(case when state is not null or len(numbers) > 0 then position end) over (partition by repo order by position rows between unbounded preceding and 1 preceding) as stop from st),
 rc as (select w.repo, w.pr, w.position, w.i, w.kind, w.via, s.is_merge, s.landed, case when w.kind = 1 and via and not is_merge and landed = 1 and wanted > 1 then least(w.position - coalesce(stop + 1, 0), wanted - 1) else 0 end::bigint as claimed from wn w join sp s using (repo, position) join ch using (repo, pr) where w.kind > 0),
 rl as (select repo, pr, string_agg('c' || i, ',' order by position) as relanded from re group by all),
 records as (select r.repo, r.pr, r.position, 'c' || r.i as landed_sha, case when kind = 2 then 'c' || r.pr else 'c' || r.i end as merge_sha, coalesce('c' || case when kind = 2 then m.p1 else l.p1 end, '{history.EMPTY_TREE}') as base_sha,
   r.claimed + 1 as member_commits, case when kind = 2 then 'rollup' when not via then 'number_ref' when r.is_merge then 'merge_commit' when claimed > 0 then 'rebase' else 'squash' end as landed_by, kind = 1 and landed > 1 as batched, coalesce(relanded, '') as relanded
  from rc r left join rl using (repo, pr) left join nm l on l.repo = r.repo and l.position = r.position - r.claimed left join cm m on m.repo = r.repo and m.i = r.pr)"""
_ON = f"""{_LINE}, pos as (select c.*, l.position, m.tip, case when c.k > 5 and c.b % 3 <> 2 and 10 * (c.b + 1) <= m.tip then 6 * c.b end as lands, case when c.k > 5 then 6 * (c.b - 1) + 5 end as leaves from cm c left join ln l using (repo, i) join tp m using (repo)),
 ind as (select repo, i, sha, position, coalesce(position, lands) as landing, coalesce(position, leaves) as base from pos)"""

SQL = {
    "first_parent_line": f"{_LINE} select repo, 'c' || i as sha, position from ln",
    "landing_index": f"{_ON} select repo, sha, position, landing, base from ind",
    "ancestor_tests": f"""with {_I} select a.repo, a.i, coalesce(case when h.i = a.i then true when h.k <= 5 then case when a.k <= 5 then a.i <= h.i else a.b % 3 <> 2 and 10 * (a.b + 1) <= h.i end
   when a.k <= 5 then a.i <= 10 * h.b + 5 when a.b = h.b then a.i <= h.i else a.b < h.b and a.b % 3 <> 2 end, false) as held
  from cm a left join cm h on h.repo = a.repo and h.i = a.i + a.i % 31 - 8""",
    "merge_windows": f"""{_ON}, md as (select repo, (max(i) // 60) * 3 as m from ix group by 1),
 cu as (select repo, case repo when 'BUILDING' then m * 10 + 3 when 'FURNITURE' then m * 10 + 7 when 'HOUSEHOLD' then (m + 2) * 10 + 8 when 'MACHINERY' then -1 end as cursor from md),
 kn as (select cu.repo, cursor, landing, base, cursor is not null and landing is null as reset from cu left join ind on ind.repo = cu.repo and ind.i = cu.cursor)
 select c.repo, l.position, c.sha as merge_sha, coalesce('c' || p1, '{history.EMPTY_TREE}') as parent_sha, ct as merged_at, coalesce('c' || p2, c.sha) as head_sha, reset as cursor_reset from cm c join ln l using (repo, i) join kn using (repo)
 where ct between 700000000 and 880000000 and (cursor is null or reset or l.position > base) qualify repo not in ('AUTOMOBILE', 'BUILDING') or row_number() over (partition by c.repo order by l.position desc) <= 100""",
    "rollup_members": f"{_LINE} select c.repo, c.sha as landing_sha, j as ordinal, 'c' || (c.i - 4 + j) as sha, 'c' || (c.i - 5 + j) as parent_sha, c.i - 4 + j as pr from cm c join ln using (repo, i), (select unnest(range(4)) as j) where c.p2 is not null and (c.b - 1) % 3 = 1",
    "change_mapping": f"{_FOLD} select * from records",
    "mapping_stats": f"""{_FOLD}, cl as (select r.repo, unnest(range(r.position - r.claimed, r.position)) as position from rc r where claimed > 0), ft as (select d.repo, d.i, case when cl.position is not null then 'claimed' else coalesce(d.state, 'unmapped') end as state from st d left join cl using (repo, position)),
 a as (select repo, count(*) as first_parent_commits, count(*) filter (state <> 'unmapped') as mapped_commits, count(*) filter (state = 'relanded') as relanded_commits, count(*) filter (state = 'rollup') as rollup_prs, count(*) filter (state = 'unmapped' and i % 10 = 3) as unmapped_reverts from ft group by 1),
 r as (select repo, count(*) as prs, count(distinct landed_sha) filter (batched) as batched_commits, count(*) filter (landed_by = 'rebase') as rebase_prs, count(*) filter (landed_by = 'number_ref') as number_ref_prs, count(*) filter (landed_by = 'rollup') as rollup_member_prs from records group by 1),
 m as (select repo, sum(len(members))::bigint as n from nm group by 1)
 select a.*, floor(mapped_commits / first_parent_commits * 10000 + 0.5) / 10000 as mapped_share, r.* exclude (repo), coalesce(n, 0) - rollup_member_prs as rollup_members_unresolved from a join r using (repo) left join m using (repo)""",
}
