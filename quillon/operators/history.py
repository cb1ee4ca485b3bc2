"""Commit histories as tables: the first-parent line, windows over it, what holds what, and which change each commit landed.

``commits``: ``repo, sha, parents`` (an array, first parent first) and what a function names besides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import settled
from .scans import prefix_scan

#: Fixed value: the tree of no files, the parent of a commit that has none.
EMPTY_TREE = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"
#: Small tables of steps that are taken up into one after so many.
RUNS = 16
#: Rows of a block, within which a task follows chains in memory.
BLOCK = 100_000


def chain(starts: DataFrame, steps: DataFrame) -> DataFrame:
    """``repo, start, sha, distance``: all that is reached from each start by following ``steps`` (``repo, sha, to``; one step a sha), itself first.

    Pointer doubling: a table of leaps is kept for each power of two, and from the longest down each
    takes what was reached one leap further, so rounds grow with the logarithm of the longest chain.
    ``starts``: ``repo, sha``. A step may have a length ``n`` (else 1). Steps must not run in a circle.
    """
    n = F.col("n") if "n" in steps.columns else F.lit(1)
    leaps = [settled(steps.where("to is not null").select("repo", "sha", "to", n.cast("long").alias("n")), "leaps")]
    while True:
        last = leaps[-1]
        further = last.select("repo", F.col("sha").alias("to"), F.col("to").alias("__to"), F.col("n").alias("__n"))
        longer = settled(last.join(further, ["repo", "to"]).select("repo", "sha", F.col("__to").alias("to"), (F.col("n") + F.col("__n")).alias("n")), "leaps")
        if longer.isEmpty():
            break
        leaps.append(longer)
    reached = settled(starts.select("repo", F.col("sha").alias("start"), "sha", F.lit(0).cast("long").alias("distance")).distinct(), "reached")
    for leap in reversed(leaps):
        on = reached.join(leap, ["repo", "sha"]).select("repo", "start", F.col("to").alias("sha"), (F.col("distance") + F.col("n")).alias("distance"))
        reached = settled(reached.union(on), "reached")
    return reached


def _ways_out(repos: list[str], shas: list[str], parents: list[str | None]) -> tuple[list[str | None], list[int]]:
    """Of each row of a block the first commit down its chain that has no row there (none: the chain ends) and how many steps away it is."""
    places = list(zip(repos, shas, strict=True))
    step = dict(zip(places, parents, strict=True))
    told: dict[tuple[str, str], tuple[str | None, int]] = {}
    for place in places:
        path, at = [], place
        while at in step and at not in told:
            if len(path) > len(step):
                raise ValueError("first parents run in a circle")
            path.append(at)
            at = (at[0], step[at])
        to, n = told.get(at, (at[1], 0))
        for passed in reversed(path):
            told[passed] = (to, n := n + 1)
    return [told[p][0] for p in places], [told[p][1] for p in places]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one task in blocks of ``BLOCK``, each row with its block and the way out of it."""
    of_task = uuid.uuid4().hex

    def blocks(rows: pa.Table, k: int) -> Iterator[pa.RecordBatch]:
        out, n = _ways_out(*[rows[c].to_pylist() for c in ("repo", "sha", "to")])
        told = {"block": pa.array([f"{of_task}-{k}"] * len(rows)), "out": pa.array(out, pa.string()), "n": pa.array(n, pa.int64())}
        yield from pa.table({**{c: rows[c] for c in rows.column_names}, **told}).to_batches()

    kept, k = [], 0
    for batch in batches:
        kept.append(batch)
        if sum(b.num_rows for b in kept) >= BLOCK:
            yield from blocks(pa.Table.from_batches(kept), k)
            kept, k = [], k + 1
    if kept:
        yield from blocks(pa.Table.from_batches(kept), k)


def _walked(block: pa.Table) -> pa.Table:
    """All that is reached within a block from those of its rows that have a distance."""
    repos, shas, parents, distances = (block[c].to_pylist() for c in ("repo", "sha", "to", "distance"))
    step = dict(zip(zip(repos, shas, strict=True), parents, strict=True))
    found: dict[str, list] = {"repo": [], "sha": [], "distance": []}
    for repo, sha, distance in zip(repos, shas, distances, strict=True):
        while distance is not None and (repo, sha) in step:
            for name, x in zip(found, (repo, sha, distance), strict=True):
                found[name].append(x)
            sha, distance = step[repo, sha], distance + 1
    return pa.table(found, schema=pa.schema([("repo", pa.string()), ("sha", pa.string()), ("distance", pa.int64())]))


def first_parent_line(commits: DataFrame, tips: DataFrame, near: str | None = None) -> DataFrame:
    """``repo, sha, position``: each repository's first-parent line, its oldest commit at position 0. ``tips``: ``repo, sha``, one a repository.

    The oldest is the last whose row is there: what lies beyond a cut in the history isn't on the line. A tip without a row is no line.

    Rows are cut into blocks, by ``near`` (a column along which parents lie close, such as a log's order or the time) or as they lie. Within a
    block chains are followed in one pass, so ``chain`` only has to go from block to block; a block is then walked
    from where the line enters it. What ``near`` says changes the time alone: if all parents lie in other blocks, ``chain`` goes over all commits.
    """
    known = commits.select("repo", "sha", F.try_element_at("parents", F.lit(1)).alias("to"), *([near] if near else []))
    lying = known.repartitionByRange("repo", near).sortWithinPartitions("repo", near).drop(near) if near else known
    rows = settled(lying.mapInArrow(_contracted, "repo string, sha string, to string, block string, out string, n long"), "blocks")
    outs = rows.where("out is not null").select("repo", F.col("out").alias("sha")).distinct()
    entered = rows.join(outs.union(tips.select("repo", "sha")).distinct(), ["repo", "sha"], "left_semi").select("repo", "sha", F.col("out").alias("to"), "n")
    entries = settled(entered, "entries")
    steps = entries.join(entries.select("repo", F.col("sha").alias("to")), ["repo", "to"], "left_semi").select("repo", "sha", "to", "n")
    reached = chain(tips.join(entries.select("repo", "sha"), ["repo", "sha"], "left_semi"), steps).select("repo", "sha", "distance")
    blocks = rows.join(reached, ["repo", "sha"], "left").select("repo", "sha", "to", "block", "distance")
    on = settled(blocks.groupBy("block").applyInArrow(_walked, "repo string, sha string, distance long"), "line")
    depth = on.groupBy("repo").agg(F.max("distance").alias("__most"))
    return on.join(depth, "repo").select("repo", "sha", (F.col("__most") - F.col("distance")).alias("position"))


def _spread(seed: DataFrame, edges: DataFrame, value: str, best: Callable[[Column], Column], better: Callable[[Column, Column], Column]) -> DataFrame:
    """``repo, sha, value``: the best value that reaches each node over ``edges`` (``repo, sha, to``) from ``seed``, the seed's own included.

    Only what got a better value goes on. Improvements stay in tables of their own, a few of which are then
    taken up into one, so a round costs what it changes.
    """
    known, runs = settled(seed.groupBy("repo", "sha").agg(best(F.col(value)).alias(value))), []
    front = known
    while True:
        came = front.join(edges, ["repo", "sha"]).groupBy("repo", F.col("to").alias("sha")).agg(best(F.col(value)).alias(value))
        have = known
        for run in runs:
            have = have.union(run)
        had = have.join(came.select("repo", "sha"), ["repo", "sha"], "left_semi").groupBy("repo", "sha").agg(best(F.col(value)).alias("__had"))
        front = settled(came.join(had, ["repo", "sha"], "left").where(F.col("__had").isNull() | better(F.col(value), F.col("__had"))).select("repo", "sha", value))
        if front.isEmpty():
            return have.groupBy("repo", "sha").agg(best(F.col(value)).alias(value))
        runs.append(front)
        if len(runs) == RUNS:
            known, runs = settled(have.union(front).groupBy("repo", "sha").agg(best(F.col(value)).alias(value))), []


def landing_index(commits: DataFrame, line: DataFrame) -> DataFrame:
    """``repo, sha, position, landing, base`` of every commit: where it is on the line (else null), the first position of the line whose history holds it (null: none), and the last position that its own history holds (null: none).

    ``line``: ``repo, sha, position``. Commits of the line are known at once; a walk runs over side
    branches only, so its rounds are as many as the longest of them has commits.
    """
    edges = commits.select("repo", "sha", F.explode("parents").alias("to")).distinct()
    at = line.select("repo", "sha", "position")
    parent_on = edges.join(at.select("repo", F.col("sha").alias("to"), F.col("position").alias("__to")), ["repo", "to"], "left")
    both = settled(parent_on.join(at, ["repo", "sha"], "left").select("repo", "sha", "to", "position", "__to"))
    side = both.where("position is null and __to is null").select("repo", "sha", "to")
    entered = both.where("position is not null and __to is null").select("repo", F.col("to").alias("sha"), F.col("position").alias("landing"))
    left = both.where("position is null and __to is not null").select("repo", "sha", F.col("__to").alias("base"))
    landing = _spread(entered, side, "landing", F.min, lambda new, old: new < old)
    base = _spread(left, side.select("repo", F.col("to").alias("sha"), F.col("sha").alias("to")), "base", F.max, lambda new, old: new > old)
    met = commits.select("repo", "sha").distinct().join(at, ["repo", "sha"], "left").join(landing, ["repo", "sha"], "left").join(base, ["repo", "sha"], "left")
    return met.select("repo", "sha", "position", F.coalesce("position", "landing").alias("landing"), F.coalesce("position", "base").alias("base"))


def landing_positions(line: DataFrame, parents: DataFrame) -> DataFrame:
    """``sha, position``: for each commit that the line's history holds the first position that does. ``line``: ``sha, position``; ``parents``: ``sha, parent``."""
    one = F.lit("").alias("repo")
    at = line.select(one, "sha", "position")
    commits = parents.groupBy("sha").agg(F.collect_set("parent").alias("parents")).select(one, "sha", "parents")
    every = commits.union(line.select(one, "sha", F.array().cast(commits.schema["parents"].dataType).alias("parents")).join(commits.select("sha"), "sha", "left_anti").select("repo", "sha", "parents"))
    ends = parents.select(one, F.col("parent").alias("sha")).join(every.select("sha"), "sha", "left_anti").distinct().select("repo", "sha", F.array().cast(commits.schema["parents"].dataType).alias("parents"))
    return landing_index(every.union(ends), at).where("landing is not null").select("sha", F.col("landing").alias("position"))


def is_ancestor(pairs: DataFrame, index: DataFrame, commits: DataFrame) -> DataFrame:
    """``pairs`` (``repo, sha, head`` and more) with ``held``: does the history of ``head`` hold ``sha``? A row in, a row out; commits without a row are in no history.

    By ``landing_index`` two positions are compared; only where both are of side branches and positions
    leave it open, a walk goes back from the head through its side branch.
    """
    at = index.select("repo", "sha", F.col("position").alias("__p"), F.col("landing").alias("__l"), F.lit(True).alias("__known"))
    of_head = index.select("repo", F.col("sha").alias("head"), F.col("position").alias("__hp"), F.col("landing").alias("__hl"), F.col("base").alias("__hb"), F.lit(True).alias("__head"))
    met = pairs.join(at, ["repo", "sha"], "left").join(of_head, ["repo", "head"], "left")
    known = F.coalesce(F.col("__known") & F.col("__head"), F.lit(False))
    below = F.coalesce(F.col("__l") <= F.col("__hb"), F.lit(False))
    above = F.col("__hp").isNotNull() | F.col("__p").isNotNull() | F.coalesce(F.col("__l") > F.col("__hl"), F.lit(False)) | (F.col("__l").isNull() & F.col("__hl").isNotNull())
    told = F.when(~known, False).when(F.col("sha") == F.col("head"), True).when(below, True).when(above, False)
    decided = met.withColumn("__told", told)
    wanted = settled(decided.where("__told is null").select("repo", "head", "sha").distinct())
    found = wanted.limit(0)
    if not wanted.isEmpty():
        side = index.where("position is null").select("repo", "sha")
        edges = settled(commits.select("repo", "sha", F.explode("parents").alias("to")).join(side.select("repo", F.col("sha").alias("to")), ["repo", "to"], "left_semi").select("repo", "sha", "to").distinct())
        front = seen = settled(wanted.select("repo", "head", F.col("head").alias("sha")).distinct())
        while not front.isEmpty():
            front = settled(front.join(edges, ["repo", "sha"]).select("repo", "head", F.col("to").alias("sha")).distinct().join(seen, ["repo", "head", "sha"], "left_anti"))
            seen = seen.union(front)
        found = wanted.join(seen, ["repo", "head", "sha"], "left_semi")
    walked = found.select("repo", "head", "sha", F.lit(True).alias("__walked"))
    return decided.join(walked, ["repo", "head", "sha"], "left").select(*pairs.columns, F.coalesce("__told", "__walked", F.lit(False)).alias("held"))


def merge_window(commits: DataFrame, line: DataFrame, index: DataFrame, windows: DataFrame) -> DataFrame:
    """``repo, position, merge_sha, parent_sha, merged_at, pr, head_sha, cursor_reset``: the commits of the line within each repository's window.

    ``commits``: ``repo, sha, parents, ct`` (seconds), ``subject``; ``windows``: ``repo, since, until`` (seconds, both included), ``cursor, most``.
    With a cursor those that its history doesn't hold; a cursor that is not in the history of the line's tip, or has no row, is
    reset and counts as none. Of what is left the newest ``most`` stay (null: all; below zero: none).
    """
    if windows.where("since > until").limit(1).count():
        raise ValueError("a window ends before it begins")
    seen = index.select("repo", F.col("sha").alias("cursor"), F.col("landing").alias("__landing"), F.col("base").alias("__base"))
    asked = windows.join(seen, ["repo", "cursor"], "left").withColumn("cursor_reset", F.col("cursor").isNotNull() & F.col("__landing").isNull())
    met = line.join(commits, ["repo", "sha"]).join(asked, "repo").where((F.col("ct") >= F.col("since")) & (F.col("ct") <= F.col("until")))
    # of the line a cursor's history holds all up to its base
    new = met.where(F.col("cursor").isNull() | F.col("cursor_reset") | F.col("__base").isNull() | (F.col("position") > F.col("__base")))
    counted = prefix_scan(new.withColumn("__back", -F.col("position")), ["repo"], ["__back"], {"__n": ("sum", F.lit(1).cast("long"))})
    kept = counted.where(F.col("most").isNull() | (F.col("__n") <= F.col("most")))
    parent = [F.try_element_at("parents", F.lit(i)) for i in (1, 2)]
    return kept.select("repo", "position", F.col("sha").alias("merge_sha"), F.coalesce(parent[0], F.lit(EMPTY_TREE)).alias("parent_sha"), F.col("ct").alias("merged_at"), "subject", F.coalesce(parent[1], F.col("sha")).alias("head_sha"), "cursor_reset")


# Fixed value: how a member of a rollup, and the rollup's own chain, is told.
ROLLUP = r"^Rollup merge of #(\d+)\b"


def rollup_members(commits: DataFrame, line: DataFrame) -> DataFrame:
    """``repo, landing_sha, ordinal, sha, parent_sha, pr``: members of each rollup that landed on the line, oldest first from 0.

    From the second parent of a commit of the line on, first parents are followed as long as their subjects say that they are members.
    """
    number = T.group_of(F.trim("subject"), ROLLUP).cast("long")
    members = commits.select("repo", "sha", F.try_element_at("parents", F.lit(1)).alias("parent_sha"), number.alias("pr")).where("pr is not null and parent_sha is not null")
    steps = members.join(members.select("repo", F.col("sha").alias("parent_sha")), ["repo", "parent_sha"], "left_semi").select("repo", "sha", F.col("parent_sha").alias("to"))
    merges = line.select("repo", "sha").join(commits, ["repo", "sha"]).select("repo", F.col("sha").alias("landing_sha"), F.try_element_at("parents", F.lit(2)).alias("sha"))
    first = settled(merges.join(members.select("repo", "sha"), ["repo", "sha"], "left_semi"))
    reached = chain(first.select("repo", "sha"), steps)
    most = reached.groupBy("repo", "start").agg(F.max("distance").alias("__most"))
    of = reached.join(most, ["repo", "start"]).join(first.select("repo", "landing_sha", F.col("sha").alias("start")), ["repo", "start"])
    return of.join(members, ["repo", "sha"]).select("repo", "landing_sha", (F.col("__most") - F.col("distance")).alias("ordinal"), "sha", "parent_sha", "pr")


def map_changes(commits: DataFrame, line: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Which commit of the line landed which change: records, and the line's commits with what became of them.

    ``commits``: ``repo, sha, parents, subject, body``; ``line``: ``repo, sha, position``; ``changes``: ``repo, pr, merge_sha, member_commits``.
    A commit's candidates are changes whose merge it is and changes its text names. In the order of the line each change goes to
    the first commit that has it: the members of a rollup count in place of the rollup itself, whose own candidates are used up without a record. A
    commit all of whose candidates have records already lands them again. A change of several commits that came as a rebase (its
    merge is no merge commit and lands nothing else) claims the commits just before that name no change and are nobody's.

    Records: ``repo, pr, position, landed_sha, merge_sha, base_sha, member_commits, landed_by, batched, relanded`` (SHAs, oldest first).
    Commits: ``repo, sha, position, state``: landed, rollup, relanded, claimed or unmapped.
    """
    facts = line.select("repo", "sha", "position").join(commits.select("repo", "sha", "parents", "subject", "body"), ["repo", "sha"])
    numbers = T.corpus_pr_numbers(F.col("subject"), F.col("body"), F.col("repo"))
    rows = settled(facts.select("repo", "sha", "position", F.try_element_at("parents", F.lit(1)).alias("parent"), (F.size("parents") > 1).alias("is_merge"), numbers.alias("numbers")))
    known = changes.select("repo", "pr", "merge_sha", "member_commits")
    by_sha = rows.join(known.select("repo", F.col("merge_sha").alias("sha"), "pr"), ["repo", "sha"]).select("repo", "position", "sha", "pr", F.lit(True).alias("via_sha"))
    named = rows.select("repo", "position", "sha", F.explode("numbers").alias("pr"), F.lit(False).alias("via_sha")).join(known.select("repo", "pr"), ["repo", "pr"], "left_semi").select("repo", "position", "sha", "pr", "via_sha")
    candidates = by_sha.union(named).groupBy("repo", "position", "sha", "pr").agg(F.max("via_sha").alias("via_sha"))
    members = settled(rollup_members(commits, line))
    rollups = members.select("repo", F.col("landing_sha").alias("sha")).distinct()
    marked = candidates.join(rollups.withColumn("in_rollup", F.lit(True)), ["repo", "sha"], "left").select("repo", "pr", "position", "sha", "via_sha", F.coalesce("in_rollup", F.lit(False)).alias("in_rollup"))
    # a rollup's own candidates come before its members
    claims = marked.select("repo", "pr", "position", F.lit(-1).cast("long").alias("ordinal"), "sha", "via_sha", F.when(F.col("in_rollup"), "used").otherwise("commit").alias("kind"), F.lit(None).cast("string").alias("member_sha"), F.lit(None).cast("string").alias("member_parent"))
    own = members.join(rows.select("repo", F.col("sha").alias("landing_sha"), "position"), ["repo", "landing_sha"]).join(known.select("repo", "pr"), ["repo", "pr"], "left_semi")
    claims = claims.union(own.select("repo", "pr", "position", "ordinal", F.col("landing_sha").alias("sha"), F.lit(False), F.lit("rollup"), F.col("sha"), F.col("parent_sha")))
    won = settled(claims.groupBy("repo", "pr").agg(F.min(F.struct("position", "ordinal", "sha", "via_sha", "kind", "member_sha", "member_parent")).alias("w")).select("repo", "pr", "w.*").where("kind <> 'used'"))
    landed = won.where("kind = 'commit'").groupBy("repo", "sha").agg(F.count(F.lit(1)).alias("landed"))
    again = marked.where("not in_rollup").join(landed, ["repo", "sha"], "left_anti").select("repo", "pr", "position", "sha").join(won.select("repo", "pr", F.col("position").alias("__at")), ["repo", "pr"]).where("position > __at")
    relanded = again.groupBy("repo", "pr").agg(F.array_sort(F.collect_list(F.struct("position", "sha"))).alias("r")).select("repo", "pr", F.col("r.sha").alias("relanded"))
    state = F.when(F.col("__rollup"), "rollup").when(F.col("landed").isNotNull(), "landed").when(F.col("__again"), "relanded")
    direct = rows.join(landed, ["repo", "sha"], "left").join(rollups.withColumn("__rollup", F.lit(True)), ["repo", "sha"], "left").join(again.select("repo", "sha", F.lit(True).alias("__again")).distinct(), ["repo", "sha"], "left").withColumn("state", state)
    # the last commit before that a rebase can't claim: a walk back ends there, so claims never meet
    ordered = direct.withColumn("index", F.col("position")).select("repo", "sha", "position", "parent", "is_merge", "landed", "state", "numbers")
    stop = F.when(F.col("state").isNotNull() | (F.size("numbers") > 0), F.col("position"))
    reach = settled(prefix_scan(ordered, ["repo"], ["position"], {"stop": ("last", stop)}, own=False))
    at_commit = won.where("kind = 'commit'").join(reach.select("repo", "sha", "is_merge", "landed", "stop"), ["repo", "sha"]).join(known.select("repo", "pr", F.col("member_commits").alias("__wanted")), ["repo", "pr"])
    least = line.groupBy("repo").agg(F.min("position").alias("__least"))
    free = F.col("position") - F.coalesce(F.col("stop") + 1, F.col("__least"))
    rebased = F.col("via_sha") & ~F.col("is_merge") & (F.col("landed") == 1) & (F.col("__wanted") > 1)
    claimed = F.when(rebased, F.least(free, F.col("__wanted") - 1)).otherwise(0)
    sized = at_commit.join(least, "repo").withColumn("claimed", claimed.cast("long")).withColumn("__first", F.col("position") - F.col("claimed"))
    based = sized.join(reach.select("repo", F.col("position").alias("__first"), F.col("parent").alias("base_sha")), ["repo", "__first"])
    by = F.when(~F.col("via_sha"), "number_ref").when(F.col("is_merge"), "merge_commit").when(F.col("claimed") > 0, "rebase").otherwise("squash")
    of_commit = based.select("repo", "pr", "position", F.col("sha").alias("landed_sha"), F.col("sha").alias("merge_sha"), F.coalesce("base_sha", F.lit(EMPTY_TREE)).alias("base_sha"), (F.col("claimed") + 1).alias("member_commits"), by.alias("landed_by"), (F.col("landed") > 1).alias("batched"))
    of_rollup = won.where("kind = 'rollup'").select("repo", "pr", "position", "sha", "member_sha", "member_parent", F.lit(1).cast("long"), F.lit("rollup"), F.lit(False))
    none = F.array().cast("array<string>")
    records = of_commit.union(of_rollup).join(relanded, ["repo", "pr"], "left").withColumn("relanded", F.coalesce("relanded", none))
    taken = sized.where("claimed > 0").select("repo", F.explode(F.expr("sequence(__first, position - 1)")).alias("position"), F.lit(True).alias("__claimed"))
    fates = reach.join(taken, ["repo", "position"], "left").select("repo", "sha", "position", F.coalesce("state", F.when(F.col("__claimed"), "claimed"), F.lit("unmapped")).alias("state"))
    return records, fates


def mapping_stats(records: DataFrame, fates: DataFrame, commits: DataFrame, members: DataFrame) -> DataFrame:
    """A row a repository: commits of the line, how many were mapped and how, and what kinds of records there are."""
    reverts = commits.where(F.trim("subject").rlike(r"(?i)^revert\b")).select("repo", "sha", F.lit(True).alias("__revert"))
    of_line = fates.join(reverts, ["repo", "sha"], "left").groupBy("repo").agg(
        F.count(F.lit(1)).alias("first_parent_commits"), F.count_if(F.col("state") != "unmapped").alias("mapped_commits"), F.count_if(F.col("state") == "relanded").alias("relanded_commits"), F.count_if(F.col("state") == "rollup").alias("rollup_prs"),
        F.count_if((F.col("state") == "unmapped") & F.coalesce("__revert", F.lit(False))).alias("unmapped_reverts"),
    )
    of_records = records.groupBy("repo").agg(
        F.count(F.lit(1)).alias("prs"), F.count_distinct(F.when(F.col("batched"), F.col("landed_sha"))).alias("batched_commits"), *[F.count_if(F.col("landed_by") == by).alias(f"{name}_prs") for by, name in (("rebase", "rebase"), ("number_ref", "number_ref"), ("rollup", "rollup_member"))],
    )
    of_members = members.groupBy("repo").agg(F.count(F.lit(1)).alias("__members"))
    met = of_line.join(of_records, "repo", "left").join(of_members, "repo", "left")
    counts = [c for c in of_records.columns if c != "repo"]
    share = F.when(F.col("first_parent_commits") > 0, F.floor(F.col("mapped_commits") / F.col("first_parent_commits") * 10_000 + 0.5) / 10_000)
    return met.select("repo", *[c for c in of_line.columns if c != "repo"], share.alias("mapped_share"), *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], (F.coalesce("__members", F.lit(0)) - F.coalesce("rollup_member_prs", F.lit(0))).alias("rollup_members_unresolved"))
