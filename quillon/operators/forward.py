"""What became of a change's lines by a later commit: the lines it is about, their fate, and the label they give.

``hunks``: ``pr, path, old_path, old_start, old_end, new_start, new_end`` of the change itself, whole lines from 1, a side of no lines null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.canonical import canonical_json
from . import survival
from .scans import prefix_scan

DAY = survival.DAY
# Reasons of a label in their order, and below which share of lines a change counts as rewritten.
REASONS = ("exact_revert", "line_range_followup", "linked_issue_or_pr", "pre_merge_human_edit", "task_redispatch", "substantial_rewrite", "no_evidence")
REWRITTEN = 0.5


def substrate(hunks: DataFrame) -> DataFrame:
    """``pr, path, old_path, lines, hunks``: the lines of each file, new ones where there are some, else the deleted ones."""
    new, old = F.col("new_end") - F.col("new_start") + 1, F.col("old_end") - F.col("old_start") + 1
    return hunks.groupBy("pr", "path").agg(F.min("old_path").alias("old_path"), F.sum(F.coalesce(new, old, F.lit(0))).cast("long").alias("lines"), F.count(F.lit(1)).alias("hunks"))


def file_fates(files: DataFrame, moves: DataFrame) -> DataFrame:
    """``pr, path, terminal_path``: where each file is at the terminal commit; null if it was deleted, the same path if nothing tells of it.

    ``moves``: ``pr, status, path, previous_path`` between merge and terminal, as name-status rows.
    """
    told = moves.select("pr", F.coalesce("previous_path", "path").alias("path"), "status", F.col("path").alias("to")).groupBy("pr", "path").agg(F.max_by("to", "status").alias("to"), F.max("status").alias("status"))
    fate = F.when(F.col("status") == "D", None).otherwise(F.coalesce("to", "path"))
    return files.select("pr", "path").distinct().join(told, ["pr", "path"], "left").select("pr", "path", fate.alias("terminal_path"))


def reverted_files(files: DataFrame, fates: DataFrame, blobs: DataFrame) -> DataFrame:
    """``pr, path, reverted``: is the file at the terminal what it was before the change, and did the change alter it?

    ``blobs``: ``pr, side, path, blob`` with side parent, merge or terminal; a path without a row has no blob, and none equals none.
    """

    def at(side: str, path: str) -> DataFrame:
        return blobs.where(F.col("side") == side).select("pr", F.col("path").alias(path), F.col("blob").alias(side))

    met = files.join(fates, ["pr", "path"]).join(at("parent", "old_path"), ["pr", "old_path"], "left").join(at("merge", "path"), ["pr", "path"], "left").join(at("terminal", "terminal_path"), ["pr", "terminal_path"], "left")
    return met.select("pr", "path", (~F.col("parent").eqNullSafe(F.col("merge")) & F.col("terminal").eqNullSafe(F.col("parent"))).alias("reverted"))


def forward(hunks: DataFrame, later: DataFrame, moves: DataFrame, blobs: DataFrame) -> DataFrame:
    """``pr, lines, surviving, survival_ratio, reverted, range_followup``: how many of a change's lines stand at the terminal commit.

    ``later``: ``pr, path, old_start, old_end``, the lines that changes from merge to terminal touch. Lines that were added count as undone where they are touched
    or their file is gone; a deletion stands unless its file was restored. ``reverted``: all files were restored.
    """
    files = substrate(hunks)
    fates = file_fates(files, moves)
    restored = reverted_files(files, fates, blobs)
    named = hunks.withColumn("id", F.concat_ws("|", F.col("pr").cast("string"), "path", "new_start", "new_end", "old_start", "old_end"))
    ranges = named.where("new_start is not null").select("id", F.concat_ws("|", F.col("pr").cast("string"), "path").alias("path"), F.col("new_start").alias("first"), F.col("new_end").alias("last")).distinct()
    touched = later.where("old_start is not null").select(F.concat_ws("|", F.col("pr").cast("string"), "path").alias("path"), F.col("old_start").alias("first"), F.col("old_end").alias("last"))
    covered = survival.covered_lines(ranges, touched).select("id", "covered")
    each = named.join(covered, "id", "left").join(fates, ["pr", "path"]).join(restored, ["pr", "path"])
    new, old = F.col("new_end") - F.col("new_start") + 1, F.col("old_end") - F.col("old_start") + 1
    gone = F.when(F.col("new_start").isNotNull(), F.when(F.col("terminal_path").isNull(), new).otherwise(F.coalesce("covered", F.lit(0)))).otherwise(F.when(F.col("reverted"), old).otherwise(0))
    lines = F.coalesce(new, old, F.lit(0))
    agg = each.select("pr", lines.alias("lines"), gone.alias("gone"), "reverted").groupBy("pr").agg(F.sum("lines").cast("long").alias("lines"), F.sum(F.col("lines") - F.col("gone")).cast("long").alias("surviving"), F.min("reverted").alias("reverted"), F.max(F.col("gone") > 0).alias("range_followup"))
    return agg.select("pr", "lines", "surviving", F.when(F.col("lines") > 0, F.col("surviving") / F.col("lines")).alias("survival_ratio"), "reverted", "range_followup")


def linked(changes: DataFrame, references: DataFrame) -> DataFrame:
    """Changes that a qualifying reference mentions after the merge and not after ``cutoff``; ``references``: ``pr, created_at, qualifies``."""
    met = references.where("qualifies").select(F.col("pr").alias("__pr"), "created_at")
    return changes.join(met, (F.col("pr") == F.col("__pr")) & (F.col("created_at") > F.col("merged_at")) & (F.col("created_at") <= F.col("cutoff")), "left_semi").select("pr", "horizon_days")


def horizon_index(commits: DataFrame, repo: str = "repo") -> DataFrame:
    """The least commit time from the tip down to each position."""
    return prefix_scan(commits, [repo], ["position"], {"least_ct": ("min", "ct")})


def survival_labels(rows: DataFrame, as_of: Column) -> DataFrame:
    """Labels of changes at horizons from what is known of each: outcome, or all-null with one typed reason.

    ``rows``: ``pr, horizon_days, merged_at`` (seconds), ``lines`` (null if the diff can't be read), ``terminal_sha, surviving, reverted, range_followup`` (null if the
    analysis failed), ``linked, redispatched, pre_merge_human_edit, undone_by``.
    """
    missing = (
        F.when(F.col("merged_at") + F.col("horizon_days") * DAY > as_of, "missing_horizon").when(F.col("lines").isNull(), "inaccessible_history")
        .when(F.col("lines") == 0, "insufficient_line_range_substrate").when(F.col("terminal_sha").isNull() | F.col("surviving").isNull(), "inaccessible_history")
    )
    known = F.col("missing").isNull()
    ratio = F.col("surviving") / F.col("lines")
    edited = F.coalesce("pre_merge_human_edit", F.lit(False))
    followup = F.col("range_followup") | F.coalesce("linked", F.lit(False)) | F.coalesce("redispatched", F.lit(False)) | edited
    rewritten = ~F.col("reverted") & (ratio < REWRITTEN)
    found = dict(zip(REASONS, (F.col("reverted"), F.col("range_followup"), F.coalesce("linked", F.lit(False)), edited, F.coalesce("redispatched", F.lit(False)), rewritten), strict=False))
    codes = F.array_compact(F.array(*[F.when(test, code) for code, test in found.items()]))
    survived = ~(F.col("reverted") | followup)
    undone = F.when(F.col("range_followup") | F.col("reverted") | edited, F.col("undone_by"))
    out = rows.withColumn("missing", missing)
    return out.select(
        "pr", "horizon_days", F.when(known, survived).alias("survived"), F.when(known, ratio).alias("survival_ratio"), F.when(known, F.col("reverted")).alias("reverted"), F.when(known, followup).alias("followup"),
        F.when(known, undone).alias("undone_by"), F.when(known, F.when(F.size(codes) == 0, F.array(F.lit("no_evidence"))).otherwise(codes)).otherwise(F.array("missing")).alias("reason_codes"),
        F.when(known, X.report_outcome(survived, ratio, F.col("reverted"), followup)).alias("report_outcome"),
    )


def project_label(labels: DataFrame) -> DataFrame:
    """Labels as a report may show them: without ranges, SHAs and addresses, with a hash of the whole."""
    hidden = [c for c in labels.columns if c in ("line_ranges", "pr_url") or c.endswith("_sha")]
    return labels.withColumn("label_hash", F.sha2(canonical_json(labels), 256)).drop(*hidden)


def blamed_originals(ranges: DataFrame, blame: DataFrame, owners: DataFrame) -> DataFrame:
    """``fix, pr, lines``: lines that a fix deletes or changes, by the original that landed them.

    ``ranges``: ``fix, path, first, last`` before the fix; ``blame``: ``fix, path, line, sha, boundary, text``; ``owners``: ``sha, pr``. A line counts once;
    blank lines, lines at the boundary of the history and those of commits that no single change owns don't count.
    """
    lines = ranges.select("fix", "path", F.explode(F.sequence("first", "last")).alias("line")).distinct()
    told = blame.where(~F.col("boundary") & (F.trim("text") != "")).select("fix", "path", "line", "sha")
    return lines.join(told, ["fix", "path", "line"]).join(owners, "sha").groupBy("fix", "pr").agg(F.count(F.lit(1)).alias("lines"))
