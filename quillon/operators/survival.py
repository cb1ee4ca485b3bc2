"""Did a merged change survive? Horizons, terminals, line overlap, votes and base rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scans import prefix_scan

DAY = 86_400
#: Lines that share a cell of the overlap join.
CELL = 64


def horizon_terminal(commits: DataFrame, cutoffs: DataFrame, repo: str = "repo") -> DataFrame:
    """For each cutoff the first commit, from the tip, whose time is not after it; null if there is none.

    Commit times need not fall along the walk. Only commits that lower the running minimum can be an answer; along those times fall, so the
    answer is the latest of them that is not after the cutoff: two prefix scans, which spread one repository over all tasks, and no join of commits with cutoffs.
    """
    past = prefix_scan(commits, [repo], ["position"], {"__least": ("min", "ct")}, own=False)
    lower = past.where(F.col("__least").isNull() | (F.col("ct") < F.col("__least")))
    known = lower.select(repo, F.col("ct").alias("t"), F.lit(0).alias("kind"), F.struct("sha", "position").alias("c"))
    asked = cutoffs.select(repo, F.col("cutoff").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast(known.schema["c"].dataType).alias("c")).distinct()
    found = prefix_scan(known.union(asked), [repo], ["t", "kind"], {"found": ("last", "c")})
    return found.where("kind = 1").select(repo, F.col("t").alias("cutoff"), "found.sha", "found.position")


def redispatched(changes: DataFrame, keys: str = "keys") -> DataFrame:
    """Changes with another change of a shared key merged in (merge, cutoff]: the next time of the key tells."""
    each = changes.select("pr", F.unix_micros(F.col("merged_at").cast("timestamp")).alias("at"), F.unix_micros(F.col("cutoff").cast("timestamp")).alias("until"), F.explode(keys).alias("key"))
    times = each.groupBy("key", "at").agg(F.count_distinct("pr").alias("n"))
    following = times.withColumn("next", F.lead("at").over(Window.partitionBy("key").orderBy("at"))).select("key", "at", "next")
    return each.join(following, ["key", "at"]).where("next <= until").select("pr").distinct()


def covered_lines(ranges: DataFrame, hunks: DataFrame, cell: int = CELL) -> DataFrame:
    """``covered`` for each ``id, path, first, last`` of ``ranges``: lines that hunks of its path overlap, hunk by hunk.

    Both sides are laid out in cells of lines and meet by (path, cell), which keeps the join an
    equality join; a pair counts in its first shared cell alone.
    """
    own = ranges.withColumn("__cell", F.explode(F.expr(f"sequence(first div {cell}, last div {cell})")))
    over = hunks.select(F.col("path").alias("__path"), F.col("first").alias("__first"), F.col("last").alias("__last")).withColumn("__at", F.explode(F.expr(f"sequence(__first div {cell}, __last div {cell})")))
    met = own.join(over, (F.col("path") == F.col("__path")) & (F.col("__cell") == F.col("__at")))
    start, end = F.greatest("first", "__first"), F.least("last", "__last")
    once = met.where((end >= start) & (F.col("__cell") == F.expr(f"greatest(first, __first) div {cell}")))
    total = once.groupBy("id", "path").agg(F.sum(end - start + 1).alias("covered"))
    return ranges.select("id", "path").distinct().join(total, ["id", "path"], "left").select("id", "path", F.coalesce("covered", F.lit(0)).alias("covered"))


def undoer(votes: DataFrame) -> DataFrame:
    """The one actor that votes name, human or agent; null for both or neither. Automation has no vote."""
    kept = F.when(F.col("actor").isin("human", "agent"), F.col("actor"))
    return votes.groupBy("pr").agg(F.when(F.count_distinct(kept) == 1, F.max(kept)).alias("undone_by"))


def base_rates(labels: DataFrame) -> DataFrame:
    """Rows, missing and the four outcomes by repository and horizon; the survival rate is over labelled rows."""
    outcome = F.col("outcome")
    n = F.count(outcome)
    named = [F.count_if(outcome == o).alias(o) for o in ("survived", "followup", "substantially_rewritten", "reverted")]
    return labels.groupBy("repo", "horizon_days").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(outcome.isNull()).alias("missing"), *named, F.when(n > 0, F.count_if(outcome == "survived") / n).alias("survival_rate"))


def latest(labels: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The latest row of each key; of rows of one time that of the greatest ``tie``."""
    w = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc(tie))
    return labels.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def line_survival(original: DataFrame, later: DataFrame) -> DataFrame:
    """``1 - sum(min(added, removed)) / added`` over the multisets of trimmed, non-blank lines of each file."""

    def counted(lines: DataFrame, name: str) -> DataFrame:
        trimmed = lines.withColumn("line", F.trim("line")).where("line <> ''")
        return trimmed.groupBy("pr", "file", "line").agg(F.count(F.lit(1)).alias(name))

    met = counted(original, "added").join(counted(later, "removed"), ["pr", "file", "line"], "left")
    gone = F.sum(F.least("added", F.coalesce("removed", F.lit(0))))
    return met.groupBy("pr").agg(F.sum("added").alias("lines"), gone.alias("undone"), (1 - gone / F.sum("added")).alias("line_survival"))
