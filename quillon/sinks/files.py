"""Lines of canonical JSON, validated appends, sheets for labellers, tables in Markdown, run manifests and scan state."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import canonical_json


def canonical_lines(df: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """``value``: each row as JSON with sorted keys and its nulls, in the given order."""
    rows = df.orderBy(*order) if order else df
    return rows.select(canonical_json(df).alias("value"))


def write_lines(df: DataFrame, path: str, order: Sequence[str] = (), gzip: bool = False, mode: str = "errorifexists") -> None:
    """Canonical lines as text files; the committer leaves none half written."""
    out = canonical_lines(df, order).write.mode(mode)
    (out.option("compression", "gzip") if gzip else out).text(path)


def append_lines(df: DataFrame, path: str, valid: Column) -> None:
    """Append rows as lines; fails, writing none, if a row isn't valid."""
    bad = df.where(~F.coalesce(valid, F.lit(False))).limit(1).count()
    if bad:
        raise ValueError("a row to append isn't valid")
    write_lines(df, path, mode="append")


def label_sheet(items: DataFrame, fixes: DataFrame, related: DataFrame) -> DataFrame:
    """A blind sheet: item, address, its distinct fixes and related changes joined by spaces, and empty cells to fill in."""

    def joined(rows: DataFrame, column: str, name: str) -> DataFrame:
        return rows.groupBy("item_id").agg(F.concat_ws(" ", F.array_sort(F.collect_set(column))).alias(name))

    met = items.select("item_id", "pr_url").join(joined(fixes, "fix_url", "candidate_fixes"), "item_id", "left").join(joined(related, "related_url", "related_prs"), "item_id", "left")
    return met.select("item_id", "pr_url", *[F.coalesce(c, F.lit("")).alias(c) for c in ("candidate_fixes", "related_prs")], *[F.lit("").alias(c) for c in ("corrective", "cause_code", "exclusion_code", "notes")])


def write_sheet(sheet: DataFrame, path: str) -> None:
    sheet.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A small frame as a Markdown table; fails for one of more rows than ``most``."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for a table")

    def cell(v) -> str:
        return "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")

    lines = [df.columns, ["---"] * len(df.columns), *[[cell(v) for v in r] for r in rows]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines) + "\n"


def run_manifest(inputs: dict, outputs: Sequence[dict]) -> dict:
    """A manifest whose ``run_id`` is the hash of its inputs alone, so that the same inputs give the same id at any time."""
    text = json.dumps(inputs, sort_keys=True, separators=(",", ":"))
    return {"run_id": hashlib.sha256(text.encode()).hexdigest()[:16], "inputs": inputs, "outputs": sorted(outputs, key=lambda o: o["path"])}


def manifest_of(files: DataFrame) -> DataFrame:
    """``run_id, files, rows`` of a frame of parts ``path, sha256, rows``: content-addressed over paths and hashes in order."""
    listed = files.agg(F.array_sort(F.collect_list(F.struct("path", "sha256"))).alias("all"), F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"))
    return listed.select(F.substring(F.sha2(F.to_json("all"), 256), 1, 16).alias("run_id"), "files", "rows")


def write_state(rows: DataFrame, path: str, header: dict[str, str], last_seen_sha: str) -> None:
    """Rows first, then the header that makes them count: a run that dies in between leaves the old header, which no longer fits."""
    spark: SparkSession = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    values = [*header.values(), last_seen_sha]
    one = spark.range(1).select(*[F.lit(v).alias(k) for k, v in zip([*header, "last_seen_sha"], values, strict=True)])
    one.coalesce(1).write.mode("overwrite").parquet(f"{path}/header")


def report_payload(report: DataFrame, forbidden: Sequence[str]) -> DataFrame:
    """``body``: one row as canonical JSON; fails if a forbidden name is among its fields at any depth."""

    def names(kind) -> list[str]:
        own = getattr(kind, "fields", None)
        inner = getattr(kind, "elementType", None)
        return [n for f in own or [] for n in (f.name, *names(f.dataType))] + (names(inner) if inner is not None else [])

    found = sorted(set(names(report.schema)) & set(forbidden))
    if found:
        raise ValueError(f"forbidden fields: {found}")
    return report.select(canonical_json(report).alias("body"))
