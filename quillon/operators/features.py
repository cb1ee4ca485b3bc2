"""What was known of a change at its merge."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from .scans import prefix_scan


def labels_at(events: DataFrame, key: str = "pr") -> DataFrame:
    """Labels that stand at ``as_of``: those whose last event till then adds them; null if an event without a name precedes."""
    seen = events.where("at <= as_of")
    last = seen.where(F.col("label").isNotNull()).groupBy(key, "label").agg(F.max_by("action", F.struct("at", "ordinal")).alias("action"))
    standing = last.where("action = 'labeled'").groupBy(key).agg(F.array_sort(F.collect_list("label")).alias("labels"))
    unnamed = seen.groupBy(key).agg(F.max(F.col("label").isNull()).alias("__unnamed"))
    joined = events.select(key).distinct().join(standing, key, "left").join(unnamed, key, "left")
    return joined.select(key, F.when(F.coalesce("__unnamed", F.lit(False)), None).otherwise(F.coalesce("labels", F.array().cast("array<string>"))).alias("labels"))


def text_at(changes: DataFrame, renames: DataFrame, key: str = "pr") -> DataFrame:
    """A title as of a time: the last rename's new title till then, else the first rename's old one, else the title now."""
    met = changes.join(renames, key, "left")
    past = F.col("at") <= F.col("as_of")
    agg = met.groupBy(key).agg(F.max_by("new_title", F.when(past, F.col("at"))).alias("__new"), F.max(F.when(past, F.col("at"))).alias("__past"), F.min_by("old_title", "at").alias("__old"), F.max("title").alias("title"))
    return agg.select(key, F.when(F.col("__past").isNotNull(), F.col("__new")).otherwise(F.coalesce("__old", "title")).alias("title"))


def body_at(changes: DataFrame, edits: DataFrame, key: str = "pr") -> DataFrame:
    """``key, body``: the last edit till ``as_of``; without any edit the body as it is, empty for none; null if that version is gone."""
    met = changes.join(edits.select(key, F.col("at").alias("__at"), F.col("body").alias("__body")), key, "left")
    past = F.col("__at") <= F.col("as_of")
    agg = met.groupBy(key).agg(F.max_by("__body", F.when(past, F.col("__at"))).alias("__then"), F.max(F.when(past, F.col("__at"))).alias("__past"), F.count("__at").alias("__n"), F.first("body").alias("__now"))
    return agg.select(key, F.when(F.col("__n") == 0, F.coalesce("__now", F.lit(""))).when(F.col("__past").isNotNull(), F.col("__then")).alias("body"))


def reviews_at(reviews: DataFrame, dismissals: DataFrame) -> DataFrame:
    """Reviews submitted till ``as_of``, each in the state it held then: a later dismissal doesn't count yet.

    ``reviews``: ``pr, review_id, state, submitted_at, author, as_of``; ``dismissals``: ``review_id, at, previous_state``.
    """
    first = dismissals.groupBy("review_id").agg(F.max(F.struct("at", "previous_state")).alias("d"))
    met = reviews.where(F.col("submitted_at") <= F.col("as_of")).join(first, "review_id", "left")
    return met.select("pr", "review_id", F.when(F.col("d.at") > F.col("as_of"), F.coalesce("d.previous_state", "state")).otherwise(F.col("state")).alias("state"), "submitted_at", "author")


def process_features(reviews: DataFrame, key: str = "pr") -> DataFrame:
    """Reviews till ``as_of``: count, approvals, change requests, reviewers, distinct hours and hours till the first."""
    seen = F.col("at") <= F.col("as_of")
    hours = (F.unix_micros(F.min(F.when(seen, F.col("at"))).cast("timestamp")) - F.unix_micros(F.min("opened_at").cast("timestamp"))) / 3.6e9
    return reviews.groupBy(key).agg(
        F.count_if(seen).alias("reviews"), F.count_if(seen & (F.col("state") == "approved")).alias("approvals"), F.count_if(seen & (F.col("state") == "changes_requested")).alias("change_requests"),
        F.count_distinct(F.when(seen, F.col("author"))).alias("reviewers"), F.count_distinct(F.when(seen, F.date_trunc("hour", "at"))).alias("review_rounds"), X.round4(hours).alias("hours_to_first_review"),
    )


def landing_times(line: DataFrame, repo: str = "repo") -> DataFrame:
    """The running maximum of commit times along the line, oldest first: the time by which a position had landed."""
    return prefix_scan(line, [repo], ["position"], {"landed": ("max", "ct")})


def file_history(changes: DataFrame, postings: DataFrame, days: int = 90) -> DataFrame:
    """Distinct commits, authors and fixes on a change's files that landed in the ``days`` before its base, at or below the base's position."""
    # files meet in buckets of time as long as the window, of which a change sees two: a file of a long history is many keys
    span = days * 86_400
    bucket = F.floor(F.col("base_landed") / span)
    own = changes.select("pr", "base_position", "base_landed", F.explode("files").alias("path")).withColumn("bucket", F.explode(F.array(bucket - 1, bucket)))
    met = own.join(postings.withColumn("bucket", F.floor(F.col("landed") / span)), ["path", "bucket"]).where((F.col("position") <= F.col("base_position")) & (F.col("landed") > F.col("base_landed") - span) & (F.col("landed") <= F.col("base_landed")))
    # a commit once, however many of the files it touched; then only authors are counted apart
    once = met.groupBy("pr", "commit").agg(F.min("author").alias("author"), F.max("is_fix").alias("is_fix"))
    agg = once.groupBy("pr").agg(F.count(F.lit(1)).alias("commits"), F.count_distinct("author").alias("authors"), F.count_if("is_fix").alias("fixes"))
    return changes.select("pr").join(agg, "pr", "left").select("pr", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("commits", "authors", "fixes")])


#: Names that tell of what happened after a merge.
LEAKS = ("survived", "survival", "reverted", "outcome", "followup", "corrective", "repair", "undone", "horizon", "label_hash")


def column_errors(columns: Iterable[str], declared: Iterable[str], namespaces: Iterable[str], leaks: Iterable[str] = LEAKS) -> list[tuple[str, str]]:
    """(column, error) for columns that are undeclared, outside the namespaces, doubled or that tell of the future, and for declared ones that lack."""
    columns, declared, out, seen = list(columns), set(declared), [], set()
    for c in columns:
        segments = c.replace(".", "_").split("_")
        if c in seen:
            out.append((c, "duplicate"))
        seen.add(c)
        if any(x in segments or x == c for x in leaks):
            out.append((c, "leaks"))
        if c.split(".")[0] not in set(namespaces):
            out.append((c, "namespace"))
        if c not in declared:
            out.append((c, "undeclared"))
    return out + [(c, "missing") for c in sorted(declared - seen)]


def late_evidence(events: DataFrame) -> DataFrame:
    """Events after ``as_of`` and events without a time, by change."""
    return events.groupBy("pr").agg(F.count_if(F.col("at") > F.col("as_of")).alias("late"), F.count_if(F.col("at").isNull()).alias("undated"))
