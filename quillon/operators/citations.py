"""From commits and texts to changes: which commit landed which change, what a fix cites, and the candidate links of repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import corrective

#: Issues that cite more originals are trackers, not reports.
MOST_CITED = 3


def candidate_numbers(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """``repo, position, sha, pr``: changes that a commit may have landed, by their merge SHA or by the numbers its text names, each once."""
    known = changes.select("repo", "pr")
    by_sha = commits.join(changes.select("repo", F.col("merge_sha").alias("sha"), "pr"), ["repo", "sha"]).select("repo", "position", "sha", "pr")
    named = commits.select("repo", "position", "sha", F.explode(T.corpus_pr_numbers(F.col("subject"), F.col("body"), F.col("repo"))).alias("pr"))
    by_number = named.join(known, ["repo", "pr"]).select("repo", "position", "sha", "pr")
    return by_sha.union(by_number).distinct()


def landed_changes(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """``repo, pr, sha, position, batched, relanded``: the first commit of the line that may have landed a change keeps it.

    ``position`` counts from the oldest. ``batched``: the commit landed several; ``relanded``: how many later commits name the change again.
    """
    met = candidate_numbers(commits, changes)
    first = met.groupBy("repo", "pr").agg(F.min(F.struct("position", "sha")).alias("at"), (F.count(F.lit(1)) - 1).alias("relanded")).select("repo", "pr", "at.*", "relanded")
    shared = first.groupBy("repo", "sha").agg((F.count(F.lit(1)) > 1).alias("batched"))
    return first.join(shared, ["repo", "sha"]).select("repo", "pr", "sha", "position", "batched", "relanded")


def landing_index(changes: DataFrame, line: DataFrame) -> DataFrame:
    """``repo, sha, pr`` of commits that exactly one change owns.

    A change owns its merge commit, the commits that landed it again (``relanded`` an array), and, if it came as several commits, those of the line
    between its base and its merge. Members of a rollup own nothing. Positions meet in cells, so that the range join stays an equality join.
    """
    own = changes.where(F.col("landed_sha").isNull() | (F.col("landed_sha") == F.col("merge_sha")))
    direct = own.select("repo", F.explode(F.concat(F.array("merge_sha"), F.coalesce("relanded", F.array().cast("array<string>")))).alias("sha"), "pr")
    at = line.select("repo", "sha", "position")
    several = own.where("member_commits > 1").select("repo", "pr", "base_sha", "merge_sha")
    ends = several.join(at.select("repo", F.col("sha").alias("base_sha"), F.col("position").alias("first")), ["repo", "base_sha"]).join(at.select("repo", F.col("sha").alias("merge_sha"), F.col("position").alias("last")), ["repo", "merge_sha"])
    spans = ends.where("last > first + 1").select("repo", "pr", "first", "last", F.explode(F.expr("sequence(first div 64, last div 64)")).alias("cell"))
    members = spans.join(at.withColumn("cell", F.expr("position div 64")), ["repo", "cell"]).where("position > first and position < last").select("repo", "sha", "pr")
    owners = direct.union(members).where("sha is not null").groupBy("repo", "sha").agg(F.count_distinct("pr").alias("n"), F.min("pr").alias("pr"))
    return owners.where("n = 1").select("repo", "sha", "pr")


def fix_events(fixes: DataFrame, reverts: DataFrame) -> DataFrame:
    """Fixing changes with the texts of revert commits of their merge added, and the reverts that no change landed as events of their own.

    ``fixes``: ``repo, pr, sha, title, body, at``; ``reverts``: ``repo, sha, subject, body, at``.
    """
    told = reverts.select("repo", "sha", F.concat_ws("\n", "subject", "body").alias("__more"))
    joined = fixes.join(told, ["repo", "sha"], "left").withColumn("body", F.concat_ws("\n", "body", "__more")).select("repo", "pr", "sha", "title", "body", "at")
    alone = reverts.join(fixes.select("repo", "sha"), ["repo", "sha"], "left_anti").select("repo", F.lit(None).cast(fixes.schema["pr"].dataType).alias("pr"), "sha", F.col("subject").alias("title"), "body", "at")
    return joined.union(alone)


def citations(events: DataFrame, originals: DataFrame, owners: DataFrame) -> DataFrame:
    """``event, pr, kind, ref, regression``: what the texts of events cite, as changes of the same repository.

    Numbers meet ``originals(repo, pr)``; SHAs and their beginnings meet ``owners(repo, sha, pr)`` by their first seven digits, and one
    that names several changes names none. ``regression``: does the text before it say that something broke?
    """
    texts = events.select("repo", "event", F.concat_ws("\n", "title", "body").alias("text"))
    numbers = texts.select("repo", "event", F.explode(T.cited_numbers(F.col("text"), F.col("repo"))).alias("c")).select("repo", "event", F.col("c.n").alias("pr"), "c.before")
    by_number = numbers.join(originals.select("repo", "pr"), ["repo", "pr"]).select("event", "pr", F.lit("cites_original_pr").alias("kind"), F.col("pr").cast("string").alias("ref"), "before")
    tokens = texts.select("repo", "event", F.explode(T.sha_tokens(F.col("text"))).alias("c")).select("repo", "event", "c.token", "c.before", F.substring("c.token", 1, 7).alias("start"))
    met = tokens.join(owners.select("repo", "sha", "pr", F.substring("sha", 1, 7).alias("start")), ["repo", "start"]).where(F.col("sha").startswith(F.col("token")))
    named = met.groupBy("event", "token", "before").agg(F.count_distinct("pr").alias("n"), F.min("pr").alias("pr"), F.min("sha").alias("ref")).where("n = 1")
    by_sha = named.select("event", "pr", F.lit("cites_original_sha").alias("kind"), "ref", "before")
    return by_number.union(by_sha).select("event", "pr", "kind", "ref", T.in_regression_wording(F.col("before")).alias("regression"))


def revert_targets(events: DataFrame, originals: DataFrame, owners: DataFrame) -> DataFrame:
    """``event, pr, kind, ref``: what a revert undoes, by the surest of four readings.

    The commits it says it reverts and the changes that it names so; without those, SHAs in its text; without those, numbers in the quoted title.
    """
    body = F.concat_ws("\n", "title", "body")
    said = events.select("repo", "event", F.explode(F.expr(r"regexp_extract_all(concat_ws('\n', title, body), '(?im)^\\s*this reverts commit ([0-9a-f]{7,40})', 1)")).alias("token")).withColumn("start", F.substring("token", 1, 7))
    own = owners.select("repo", "sha", "pr", F.substring("sha", 1, 7).alias("start"))

    def by_sha(tokens: DataFrame) -> DataFrame:
        met = tokens.join(own, ["repo", "start"]).where(F.col("sha").startswith(F.col("token"))).groupBy("event", "token").agg(F.count_distinct("pr").alias("n"), F.min("pr").alias("pr"), F.min("sha").alias("ref"))
        return met.where("n = 1").select("event", "pr", F.lit("revert_message").alias("kind"), "ref")

    pattern = F.concat(F.lit(r"(?im)^\s*(?:reverts? \Q"), F.col("repo"), F.lit(r"\E#|reverted https://github\.com/\Q"), F.col("repo"), F.lit(r"\E/pull/)(\d+)"))
    named = events.select("repo", "event", F.explode(F.call_function("regexp_extract_all", body, pattern, F.lit(1))).alias("n")).select("repo", "event", F.col("n").cast("long").alias("pr"))
    known = originals.select("repo", "pr")

    def by_number(numbers: DataFrame) -> DataFrame:
        return numbers.join(known, ["repo", "pr"]).select("event", "pr", F.lit("reverts_pr_reference").alias("kind"), F.col("pr").cast("string").alias("ref"))

    loose = events.select("repo", "event", F.explode(T.sha_tokens(body)).alias("c")).select("repo", "event", "c.token", F.substring("c.token", 1, 7).alias("start"))
    quoted = events.select("repo", "event", T.group_of(F.col("title"), r"(?i)^\s*(?:\[[^\]]*\]\s*)?revert\s+\"(.*)\"").alias("q")).where("q is not null")
    titled = quoted.select("repo", "event", F.explode(T.cited_numbers(F.col("q"), F.col("repo"))).alias("c")).select("repo", "event", F.col("c.n").alias("pr"))
    levels = [by_sha(said).withColumn("level", F.lit(1)), by_number(named).withColumn("level", F.lit(1)), by_sha(loose).withColumn("level", F.lit(2)), by_number(titled).withColumn("level", F.lit(3))]
    every = levels[0].union(levels[1]).union(levels[2]).union(levels[3])
    best = every.withColumn("least", F.min("level").over(Window.partitionBy("event"))).where("level = least")
    return best.groupBy("event", "pr").agg(F.min(F.struct("kind", "ref")).alias("k")).select("event", "pr", "k.*")


def detect_candidates(events: DataFrame, originals: DataFrame, owners: DataFrame, issues: DataFrame, cited: DataFrame, blamed: DataFrame | None = None) -> DataFrame:
    """Candidate links of originals with later fixes, from texts, closed issues and blamed lines, as ``corrective.candidates`` gives them.

    ``events``: ``repo, event, pr, title, body, labels, author_login, closing_issues, fixed_at``; ``originals``: ``repo, pr, title, merged_at``;
    ``issues``: ``repo, issue, type, labels``; ``cited``: ``repo, issue, pr, cited_at``, issues that mention a change; ``blamed``: ``event, pr, lines, too_large``.

    A revert links what it undoes. Else a citation in regression wording, or a closed issue that reported the original after its merge if the change is
    shaped like a fix, is a repair reference; a closed issue with a regression label is a regression issue; blamed lines of the fix of a bug issue are szz.
    An issue that reports more than three originals reports none. A change doesn't repair itself.
    """
    e = events.withColumns({"is_revert": T.is_revert(F.col("title"), F.col("body")), "common": T.common_exclusion(F.col("author_login"), F.col("title"), F.col("body"))})
    shaped = T.is_fix_subject(F.col("title")) | F.exists("labels", lambda x: x.rlike(T.FIX_LABEL))
    links = []
    targets = revert_targets(e.where("is_revert"), originals, owners).join(e.select("event", "common", F.col("body").alias("__body"), F.col("title").alias("__title")), "event")
    of_revert = originals.select("pr", T.coalesced_match(F.col("title"), T.REVERT_TITLE).alias("undoes_revert"))
    why = F.when(F.col("undoes_revert"), "revert_of_revert").otherwise(F.coalesce("common", T.revert_exclusion(F.col("__title"), F.col("__body"))))
    links.append(targets.join(of_revert, "pr").select("event", "pr", F.lit("revert").alias("proxy"), F.concat_ws(" ", "kind", "ref").alias("evidence"), why.alias("exclusion")))
    others = e.where("not is_revert")
    spoken = citations(others, originals, owners).where("regression").join(others.select("event", "common"), "event")
    links.append(spoken.select("event", "pr", F.lit("repair_reference").alias("proxy"), F.concat_ws(" ", "kind", "ref").alias("evidence"), F.col("common").alias("exclusion")))
    reports = cited.join(originals.select("repo", "pr", "merged_at"), ["repo", "pr"]).where("cited_at > merged_at").groupBy("repo", "issue").agg(F.collect_set("pr").alias("prs")).where(F.size("prs") <= MOST_CITED)
    closed = others.select("repo", "event", "common", shaped.alias("shaped"), F.explode("closing_issues").alias("issue"))
    reported = closed.join(reports, ["repo", "issue"]).select("repo", "issue", "event", "common", "shaped", F.explode("prs").alias("pr"))
    closes = F.concat_ws(" ", F.lit("closes_issue_citing_original"), "issue")
    links.append(reported.where("shaped").select("event", "pr", F.lit("repair_reference").alias("proxy"), closes.alias("evidence"), F.col("common").alias("exclusion")))
    labelled = issues.select("repo", "issue", F.size(T.regression_labels(F.col("labels"))).alias("regressions"), T.is_bug_issue(F.col("type"), F.col("labels")).alias("is_bug"))
    links.append(reported.join(labelled.where("regressions > 0"), ["repo", "issue"]).select("event", "pr", F.lit("regression_issue").alias("proxy"), closes.alias("evidence"), F.col("common").alias("exclusion")))
    if blamed is not None:
        bugs = closed.join(labelled.where("is_bug"), ["repo", "issue"]).select("event", "common").distinct()
        large = F.coalesce("common", F.when(F.col("too_large"), "fix_too_large"))
        links.append(blamed.join(bugs, "event").select("event", "pr", F.lit("szz").alias("proxy"), F.concat_ws(" ", F.lit("blamed_lines"), "lines").alias("evidence"), large.alias("exclusion")))
    every = links[0]
    for more in links[1:]:
        every = every.union(more)
    fixes = every.join(events.select("event", F.col("pr").alias("own_pr"), "fixed_at"), "event").where("own_pr is null or own_pr <> pr")
    ordered = fixes.select("pr", F.col("event").alias("fix"), "fixed_at", "proxy", "evidence", "exclusion", F.row_number().over(Window.partitionBy("event", "pr", "proxy").orderBy("evidence")).alias("ordinal"))
    return corrective.candidates(originals.select("pr", "merged_at"), ordered)
