"""Evidence of a change as it stood at its merge, and the features that diffs, checks and commits give."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions import exprs as X
from ..functions import text as T


def truncated(evidence: DataFrame, as_of: Column, at: str = "at") -> DataFrame:
    """Every array of structs with a time ``at`` without what is later than ``as_of``; elements without a time stay."""
    kept = {}
    for f in evidence.schema.fields:
        if isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StructType) and at in f.dataType.elementType.names:
            kept[f.name] = F.filter(F.col(f.name), lambda e: e[at].isNull() | (e[at] <= as_of))
    return evidence.withColumns(kept)


def with_later_activity(evidence: DataFrame, as_of: Column, column: str, fields: dict[str, Column], at: str = "at") -> DataFrame:
    """``column`` with one made-up element an hour after ``as_of``: what truncation must take away again."""
    kind = evidence.schema[column].dataType
    made = F.struct(*[(as_of + F.expr("interval 1 hour") if n == at else fields.get(n, F.lit(None))).cast(kind.elementType[n].dataType).alias(n) for n in kind.elementType.names])
    return evidence.withColumn(column, F.array_append(F.coalesce(F.col(column), F.array().cast(kind)), made))


def with_timelines(evidence: DataFrame, timelines: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Evidence with the timeline's arrays laid over; all of it null where no timeline was captured, captured when the older of the two was."""
    laid = timelines.select("pr", F.lit(True).alias("__have"), F.col("captured_at").alias("__at"), *[F.col(c).alias(f"__{c}") for c in columns])
    met = evidence.join(laid, "pr", "left")
    have = F.col("__have").isNotNull()
    given = {c: F.when(have, F.col(f"__{c}") if c in columns else F.least("captured_at", "__at") if c == "captured_at" else F.col(c)) for c in evidence.columns if c != "pr"}
    return met.select("pr", *[e.alias(c) for c, e in given.items()], *[F.when(have, F.col(f"__{c}")).alias(c) for c in columns if c not in evidence.columns])


def pass_rates(checks: DataFrame, as_of: Column | None = None) -> DataFrame:
    """``pr, test_pass_rate``: passed of all that passed or failed among checks named for tests; null if there are none."""
    rows = checks if as_of is None else checks.where(F.col("at") <= as_of)
    test, good, bad = F.col("name").rlike(r"(?i)test|spec"), F.col("state") == "pass", F.col("state") == "fail"
    n = F.count_if(test & (good | bad))
    return rows.groupBy("pr").agg(F.when(n > 0, X.round4(F.count_if(test & good) / n)).alias("test_pass_rate"))


def diff_shape(files: DataFrame) -> DataFrame:
    """A row a change: files, lines added, deleted and in all, tests among them and new files; ``files``: ``pr, path, status, added, deleted``, nulls of binary files count 0."""
    added, deleted = F.coalesce("added", F.lit(0)), F.coalesce("deleted", F.lit(0))
    return files.groupBy("pr").agg(
        F.count_distinct("path").alias("files"), F.sum(added).cast("long").alias("added"), F.sum(deleted).cast("long").alias("deleted"), F.sum(added + deleted).cast("long").alias("loc"),
        F.max(T.is_test_file(F.col("path"))).alias("tests_changed"), F.count_if(F.col("status") == "A").alias("new_files"),
    )


def diff_statistics(names: DataFrame, numstat: DataFrame) -> DataFrame:
    """``pr, files, loc, diff_uncertain``: uncertain if a change has changed names but no line counts."""
    counted = numstat.groupBy("pr").agg(F.sum(F.coalesce("added", F.lit(0)) + F.coalesce("deleted", F.lit(0))).cast("long").alias("loc"), F.count(F.lit(1)).alias("n"))
    return names.groupBy("pr").agg(F.count_distinct("path").alias("files")).join(counted, "pr", "left").select("pr", "files", "loc", F.col("n").isNull().alias("diff_uncertain"))


def complexity_delta(files: DataFrame, longest: int = 1 << 20) -> DataFrame:
    """``pr, complexity_delta``: new less old over files whose complexity is counted; pairs with a long side are passed over; null if a source that should be there lacks.

    ``files``: ``pr, path, status, old_source, new_source``; an added file has no old, a deleted one no new source.
    """
    ext = F.regexp_extract("path", r"(\.[A-Za-z]+)$", 1)
    rows = files.where(ext.isin(*T.CODE_EXTENSIONS) & (F.length(F.coalesce("old_source", F.lit(""))) <= longest) & (F.length(F.coalesce("new_source", F.lit(""))) <= longest))
    lacks = ((F.col("status") != "A") & F.col("old_source").isNull()) | ((F.col("status") != "D") & F.col("new_source").isNull())
    delta = F.coalesce(T.file_complexity(F.col("new_source"), ext), F.lit(0)) - F.coalesce(T.file_complexity(F.col("old_source"), ext), F.lit(0))
    summed = rows.groupBy("pr").agg(F.when(~F.max(lacks), F.sum(delta)).cast("long").alias("complexity_delta"))
    return files.select("pr").distinct().join(summed, "pr", "left")


def author_emails(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """``pr, emails``: distinct addresses of a change's commits whose login is the author's; null without any."""
    own = commits.join(changes.select("pr", "author_login"), "pr").where(F.lower("login") == F.lower("author_login"))
    found = own.groupBy("pr").agg(F.array_sort(F.collect_set("email")).alias("emails"))
    return changes.select("pr").join(found, "pr", "left").select("pr", F.when(F.size("emails") > 0, F.col("emails")).alias("emails"))


def differing_columns(one: DataFrame, two: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, differing``: names of columns in which two frames differ, sorted; a row that one lacks differs in all of them."""
    names = sorted(c for c in one.columns if c not in keys)
    a = one.select(*keys, F.struct(*names).alias("__a"))
    b = two.select(*keys, F.struct(*names).alias("__b"))
    differ = [F.when(~F.to_json(F.struct(F.col(f"__a.{c}"))).eqNullSafe(F.to_json(F.struct(F.col(f"__b.{c}")))) | F.col("__a").isNull() | F.col("__b").isNull(), F.lit(c)) for c in names]
    return a.join(b, list(keys), "full").select(*keys, F.array_compact(F.array(*differ)).alias("differing"))


def replay_tally(differences: DataFrame, by: str = "landing") -> DataFrame:
    """For each landing type how many replays were the same, and which columns differed how often."""
    return differences.groupBy(by).agg(F.count(F.lit(1)).alias("replayed"), F.count_if(F.size("differing") == 0).alias("identical"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("differing")))).alias("columns"))


def agreement_by_column(one: DataFrame, two: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``name, compared, agree`` for each column over the rows that both frames have."""
    names = sorted(c for c in one.columns if c not in keys)
    met = one.select(*keys, *[F.col(c).alias(f"a_{c}") for c in names]).join(two.select(*keys, *[F.col(c).alias(f"b_{c}") for c in names]), list(keys))
    told = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")).alias("same")) for c in names])).alias("x")
    return met.select(told).groupBy("x.name").agg(F.count(F.lit(1)).alias("compared"), F.count_if("x.same").alias("agree"))


def coverage_by_quarter(changes: DataFrame) -> DataFrame:
    """Counts by repository and quarter of the merge: checks there, usable at the merge, and events strictly later than it.

    ``changes``: ``repo, merged_at, ci_at, last_event_at``.
    """
    return changes.groupBy("repo", X.quarter(F.col("merged_at")).alias("quarter")).agg(
        F.count(F.lit(1)).alias("changes"), F.count("ci_at").alias("with_ci"), F.count_if(F.col("ci_at") <= F.col("merged_at")).alias("ci_at_merge"), F.count_if(F.col("last_event_at") > F.col("merged_at")).alias("events_after"),
    )


def null_rate_swing(rows: DataFrame, columns: Sequence[str], at: str = "merged_at") -> DataFrame:
    """``name, least, most, swing``: how far the share of nulls of each column moves between quarters."""
    told = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).isNull().alias("lacks")) for c in columns])).alias("x")
    each = rows.select(X.quarter(F.col(at)).alias("quarter"), told).groupBy("quarter", "x.name").agg((F.count_if("x.lacks") / F.count(F.lit(1))).alias("rate"))
    return each.groupBy("name").agg(X.round4(F.min("rate")).alias("least"), X.round4(F.max("rate")).alias("most"), X.round4(F.max("rate") - F.min("rate")).alias("swing"))


def feature_rows(frames: dict[str, DataFrame], declared: Sequence[str], key: str = "pr") -> DataFrame:
    """One row a key with all ``declared`` columns in their order, null where no frame has them; a column that isn't declared is refused."""
    extra = sorted({c for f in frames.values() for c in f.columns if c != key} - set(declared))
    if extra:
        raise ValueError(f"columns that are not declared: {extra}")
    keys = None
    for f in frames.values():
        keys = f.select(key) if keys is None else keys.union(f.select(key))
    out = keys.distinct()
    for f in frames.values():
        out = out.join(f, key, "left")
    return out.select(key, *[F.col(c) if c in out.columns else F.lit(None).cast("double").alias(c) for c in declared])


def manifest_errors(entries: Sequence[dict], namespaces: Sequence[str], categories: Sequence[str], version: str, wanted_version: str) -> list[tuple[str, str]]:
    """(column, error) for a feature manifest: wrong version, doubled names, unknown namespaces or categories, no source for as-of."""
    out = [] if version == wanted_version else [("", "version")]
    seen = set()
    for e in entries:
        name = e.get("name", "")
        checks = [("duplicate", name in seen), ("namespace", name.split(".")[0] not in namespaces), ("category", e.get("category") not in categories), ("as_of_source", not e.get("as_of_source"))]
        out += [(name, code) for code, wrong in checks if wrong]
        seen.add(name)
    return out


def file_sets(original: Column, fix: Column, existing: Column) -> Column:
    """A struct of sorted paths: those of the fix alone, of the original alone, and of the fix that were there before it."""

    def ordered(x: Column) -> Column:
        return F.array_sort(F.array_distinct(x))

    return F.struct(ordered(F.array_except(fix, original)).alias("fix_only"), ordered(F.array_except(original, fix)).alias("original_only"), ordered(F.array_intersect(fix, existing)).alias("fix_preexisting"))


def joined_once(features: DataFrame, labels: DataFrame, keys: Sequence[str], same: Sequence[str] = ()) -> DataFrame:
    """Features with the label of their key; fails if a key repeats on a side or a column of ``same`` differs between them."""

    def once(df: DataFrame, side: str) -> DataFrame:
        named = F.concat(F.lit(f"a key repeats among the {side}: "), F.concat_ws(", ", *keys))
        n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).select(*keys, F.when(F.col("__n") > 1, F.raise_error(named).cast("int")).otherwise(1).alias(f"__{side}"))
        return df.join(n, list(keys))

    met = once(features, "features").join(once(labels.withColumnsRenamed({c: f"__{c}" for c in same}), "labels"), list(keys))
    ok = (F.col("__features") == 1) & (F.col("__labels") == 1)
    for c in same:
        differs = F.raise_error(F.concat(F.lit(f"{c} differs for "), F.concat_ws(", ", *keys))).cast("boolean")
        ok = ok & F.when(F.col(c).eqNullSafe(F.col(f"__{c}")), True).otherwise(differs)
    return met.where(ok).drop("__features", "__labels", *[f"__{c}" for c in same])
