"""Column functions: rounding, intervals, lattices, buckets, scores, text predicates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959964
#: The largest whole number that a double holds exactly.
SAFE_INTEGER = 2**53 - 1


def round_half_up(x: Column, digits: int) -> Column:
    """``floor(x * 10^d + 0.5) / 10^d``: halves go up, also below zero."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5).cast("double") / scale


def round4(x: Column) -> Column:
    return round_half_up(x, 4)


def round4_epsilon(x: Column) -> Column:
    """As ``round4``, with the double's epsilon added first."""
    return round4(x + F.lit(2.0**-52))


def ratio4(n: Column, d: Column) -> Column:
    """``n / d`` to four places; null, not zero, without a denominator."""
    return F.when(d != 0, round4(n.cast("double") / d))


def strict_sum(x: Column) -> Column:
    """Null unless there are rows and none is null."""
    return F.when((F.count(F.lit(1)) > 0) & (F.count(F.lit(1)) == F.count(x)), F.sum(x))


def safe_sum(x: Column) -> Column:
    """A sum that fails beyond the whole numbers that a double holds."""
    total = F.coalesce(F.sum(x), F.lit(0))
    return F.when(F.abs(total) <= SAFE_INTEGER, total).otherwise(F.raise_error(F.lit("total exceeds the safe integer range")).cast("long"))


def promote_source(sources: Column) -> Column:
    """One of none, provider_reported, local_estimate, mixed for a group."""
    provider = F.max(sources.isin("provider_reported", "mixed"))
    estimate = F.max(sources.isin("local_estimate", "mixed"))
    return F.when(provider & estimate, "mixed").when(provider, "provider_reported").when(estimate, "local_estimate").otherwise("none")


def promote_coverage(coverage: Column) -> Column:
    """A confirmed zero is no gap."""
    return F.when(F.min(coverage == "unavailable"), "unavailable").when(F.min(coverage == "known_zero"), "known_zero").when(F.min(coverage.isin("complete", "known_zero")), "complete").otherwise("partial")


def promote_availability(values: Column) -> Column:
    """One of unavailable, known_zero, available, partial for a group; unavailable for none."""
    return F.when(F.coalesce(F.min(values == "unavailable"), F.lit(True)), "unavailable").when(F.min(values == "known_zero"), "known_zero").when(F.min(values.isin("available", "known_zero")), "available").otherwise("partial")


def promote_single(values: Column, mixed: str, ignore: str | None = None) -> Column:
    """The one distinct value of a group, ``ignore`` (or ``mixed``) if there is none, else ``mixed``."""
    kept = values if ignore is None else F.when(values != ignore, values)
    return F.when(F.count_distinct(kept) == 1, F.max(kept)).when(F.count(kept) == 0, ignore if ignore is not None else mixed).otherwise(mixed)


def usage_availability(fields: Sequence[Column]) -> Column:
    nulls = reduce(lambda a, b: a + b, [x.isNull().cast("int") for x in fields])
    zero = reduce(lambda a, b: a & b, [F.coalesce(x == 0, F.lit(False)) for x in fields])
    return F.when(nulls == len(fields), "unavailable").when(nulls > 0, "partial").when(zero, "known_zero").otherwise("available")


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper bound, clamped to [0, 1], to four places and around the share; null for no observations."""
    share = k.cast("double") / n
    den = 1 + F.lit(z * z) / n
    center = (share + F.lit(z * z) / (2 * n)) / den
    half = F.lit(z) * F.sqrt((share * (1 - share) + F.lit(z * z) / (4 * n)) / n) / den
    at = round4_epsilon(share)
    low = F.least(round4_epsilon(F.greatest(F.lit(0.0), F.least(F.lit(1.0), center - half))), at)
    high = F.greatest(round4_epsilon(F.greatest(F.lit(0.0), F.least(F.lit(1.0), center + half))), at)
    return F.when(n > 0, low), F.when(n > 0, high)


def katz(k1: Column, n1: Column, k2: Column, n2: Column, z: float = Z95) -> tuple[Column, Column, Column]:
    """Risk ratio and its log interval; half is added to all four cells if one of them is empty."""
    empty = (k1 == 0) | (n1 == k1) | (k2 == 0) | (n2 == k2)
    add = F.when(empty, 0.5).otherwise(0.0)
    a, b, c, d = k1 + add, n1 - k1 + add, k2 + add, n2 - k2 + add
    ratio = (a / (a + b)) / (c / (c + d))
    spread = F.lit(z) * F.sqrt(1 / a - 1 / (a + b) + 1 / c - 1 / (c + d))
    at = round4_epsilon(ratio)
    low = F.least(at, round4_epsilon(F.exp(F.log(ratio) - spread)))
    high = F.greatest(at, round4_epsilon(F.exp(F.log(ratio) + spread)))
    some = (n1 > 0) & (n2 > 0)
    return F.when(some, at), F.when(some, low), F.when(some, high)


def quartile_of(value: Column, q1: Column, q2: Column, q3: Column) -> Column:
    """Ties stay in the lower quartile."""
    return F.when(value <= q1, "q1").when(value <= q2, "q2").when(value <= q3, "q3").when(value.isNotNull(), "q4")


def report_outcome(survived: Column, ratio: Column, reverted: Column, followup: Column, threshold: float = 0.5) -> Column:
    known = survived.isNotNull() & ratio.isNotNull() & reverted.isNotNull() & followup.isNotNull()
    return F.when(known, F.when(reverted, "reverted").when(ratio < threshold, "substantially_rewritten").when(followup, "followup").otherwise("survived"))


def repository_scale(files: Column) -> Column:
    return F.when(files >= 0, F.when(files < 100, "small").when(files < 1000, "medium").when(files < 10000, "large").otherwise("xlarge"))


def files_bucket(files: Column) -> Column:
    return F.when(files >= 0, F.when(files <= 1, "1").when(files <= 5, "2-5").when(files <= 15, "6-15").otherwise("16+"))


def description_bucket(text: Column) -> Column:
    tokens = F.ceil(F.length(text) / 4)
    return F.when(tokens < 50, "short").when(tokens < 200, "medium").when(tokens.isNotNull(), "long")


def dominant_key(counts: Column) -> Column:
    """The key of the largest count of a map; of equal counts the smallest key."""
    entries = F.transform(F.map_entries(counts), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("key")))
    return F.array_min(entries)["key"]


# Weights of the baseline scorer.
BASELINE = {
    "base": 2.0, "loc": 0.35, "loc_full": 2000, "files": 0.25, "files_full": 50, "tests": 0.4, "uncertain": 0.5, "type_errors": 0.3, "type_errors_full": 20,
    "lint_errors": 0.3, "lint_errors_full": 50, "build_fails": 0.6, "complexity": 0.2, "complexity_full": 50, "requests": 0.15, "requests_full": 5, "rounds": 0.05, "rounds_full": 10,
}


def baseline_score(loc: Column, files: Column, tests: Column, uncertain: Column, type_errors: Column, lint_errors: Column, build_ok: Column, complexity: Column, change_requests: Column, review_rounds: Column) -> Column:
    """Logistic of saturating penalties, to six places; a null feature costs nothing."""
    w = BASELINE

    def capped(x: Column, full: int) -> Column:
        return F.least(F.coalesce(x, F.lit(0)), F.lit(full))

    z = (
        F.lit(w["base"])
        - F.log2(1 + F.coalesce(loc, F.lit(0))) * w["loc"] / F.log2(F.lit(1 + w["loc_full"])) * 4
        - capped(files, w["files_full"]) * w["files"] / w["files_full"] * 4
        + F.when(tests, w["tests"]).otherwise(0.0)
        - F.when(uncertain, w["uncertain"]).otherwise(0.0)
        - capped(type_errors, w["type_errors_full"]) * w["type_errors"] / w["type_errors_full"]
        - capped(lint_errors, w["lint_errors_full"]) * w["lint_errors"] / w["lint_errors_full"]
        - F.when(~build_ok, w["build_fails"]).otherwise(0.0)
        - F.greatest(capped(complexity, w["complexity_full"]), F.lit(0)) * w["complexity"] / w["complexity_full"]
        - capped(change_requests, w["requests_full"]) * w["requests"]
        - capped(review_rounds, w["rounds_full"]) * w["rounds"]
    )
    return round_half_up(1 / (1 + F.exp(-z)), 6)


def any_match(text: Column, patterns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])


# Keywords of the task families.
FAMILY_PATTERNS = {
    "migration": [r"\bmigrat(?:e|ion|ing)\b", r"\balembic\b", r"\bbackfill\b"],
    "infra": [r"\binfra(?:structure)?\b", r"\bci\b", r"\bdeploy(?:ment)?\b", r"\bterraform\b"],
    "docs": [r"\bdocs?\b", r"\breadme\b", r"\bdocumentation\b"],
    "test": [r"\btests?\b", r"\bvitest\b", r"\bjest\b", r"\bcypress\b"],
    "refactor": [r"\brefactor\b", r"\brename\b", r"\brestructure\b", r"\bcleanup\b"],
    "feature": [r"\bfeature\b", r"\bimplement\b", r"\badd support\b", r"\bsupport\b", r"\benable\b"],
    "bugfix": [r"\bbug\b", r"\bregression\b", r"\bbroken\b", r"\bfailing\b", r"\bfix(?:e[sd])?\b.{0,24}\b(?:bug|regression|failure|crash|timeout)\b"],
}
INVESTIGATION_PATTERNS = [r"\binvestigat(?:e|ion)\b", r"\banaly[sz]e\b", r"\bdebug\b"]


def task_family(text: Column) -> Column:
    """One family's keywords: that family; several families': mixed; none: investigation or chore."""
    hits = {family: any_match(text, [f"(?i){p}" for p in patterns]) for family, patterns in FAMILY_PATTERNS.items()}
    n = reduce(lambda a, b: a + b, [h.cast("int") for h in hits.values()])
    one = reduce(lambda acc, item: acc.when(item[1], item[0]), hits.items(), F.when(n > 1, "mixed"))
    return one.when(any_match(text, [f"(?i){p}" for p in INVESTIGATION_PATTERNS]), "investigation").when(text.isNotNull(), "chore")


# Prefixes that look like trackers but name standards, advisories or encodings.
NOT_TRACKERS = ("CVE", "CWE", "GHSA", "PEP", "RFC", "ISO", "UTF", "SHA", "MD", "HTTP", "TLS", "SSL", "ECMA", "ES", "IEEE", "POSIX", "UCS", "WCAG", "FIPS", "NIST")


def issue_keys(text: Column) -> Column:
    """Distinct tracker keys such as AB-12; prefixes that name standards are no keys."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Z][A-Z0-9]+-\d+)\b"), F.lit(1)))
    return F.filter(found, lambda k: ~F.split(k, "-")[0].isin(*NOT_TRACKERS))


def pr_number(subject: Column) -> Column:
    """The number of a merge subject or of a trailing ``(#n)``; null without one."""
    found = F.coalesce(F.nullif(F.regexp_extract(subject, r"(?i)merge pull request #(\d+)\b", 1), F.lit("")), F.nullif(F.regexp_extract(subject, r"\(#(\d+)\)\s*$", 1), F.lit("")))
    return found.cast("long")


def revert_acknowledgements(text: Column) -> Column:
    """Distinct numbers after "reverts" or "intentionally reverts"; none of a null text."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)\b(?:reverts|intentionally reverts)\s+#(\d+)\b"), F.lit(1))
    return F.transform(F.array_distinct(found), lambda x: x.cast("long"))


# Provider prefixes that go, other names of models, and the family whose dots become dashes.
PROVIDERS = ("openrouter", "litellm", "openai", "anthropic", "google", "gemini", "deepseek", "meta-llama", "meta", "mistralai", "moonshotai", "qwen", "x-ai", "z-ai")
MODEL_ALIASES = {"kimi-k3-1-pro": "kimi-k3.1-pro", "qwen-3-coder": "qwen3-coder", "llama-3.3-70b": "llama-3.3-70b-instruct", "mistral-large-2": "mistral-large-2407"}


def normalize_model(model: Column) -> Column:
    """Lower case, up to five known provider prefixes off, dots to dashes for one family, other names resolved.

    Unknown prefixes stay, so that ids of other vendors don't meet known ones.
    """
    routed = F.regexp_replace(F.lower(F.regexp_replace(model, r"^\s+|\s+$", "")), "^openrouter:", "")
    bare = F.regexp_replace(routed, "^(?:(?:" + "|".join(PROVIDERS) + ")/){1,5}", "")
    dashed = F.when(bare.startswith("claude-"), F.translate(bare, ".", "-")).otherwise(bare)
    names = F.create_map(*[F.lit(x) for kv in MODEL_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, dashed), dashed)


def without_snapshot(model: Column) -> Column:
    """A normalized id without its date, or without -001 for one family."""
    compact, dated = F.regexp_replace(model, r"-\d{8}$", ""), F.regexp_replace(model, r"-\d{4}-\d{2}-\d{2}$", "")
    return F.when(compact != model, compact).when(dated != model, dated).when(model.startswith("gemini-"), F.regexp_replace(model, "-001$", "")).otherwise(model)


def sha_id(parts: Sequence[Column], digits: int = 64) -> Column:
    """Hex SHA-256 of the parts with a NUL between them; none of them may be null, as null and nothing would be one."""
    return F.substring(F.sha2(F.concat_ws("\0", *[p.cast("string") for p in parts]), 256), 1, digits)


def json_id(parts: Sequence[Column], digits: int) -> Column:
    """The first hex digits of the SHA-256 of the parts as a JSON array of strings; a null is written as null."""
    written = F.to_json(F.array(*[p.cast("string") for p in parts]), {"ignoreNullFields": "false"})
    return F.substring(F.sha2(written, 256), 1, digits)


def micros(usd: Column) -> Column:
    return F.floor(usd * 1e6 + 0.5).cast("long")


def subtract_cached(prompt: Column, *cached: Column) -> Column:
    """Input tokens of providers whose prompt count includes cached ones; never below zero, and unknown if the prompt is."""
    return F.when(prompt.isNotNull(), F.greatest(F.lit(0), reduce(lambda a, b: a - F.coalesce(b, F.lit(0)), cached, prompt)))


def cache_exceeds_input(prompt: Column, *cached: Column) -> Column:
    """Was the subtraction cut at zero?"""
    return F.coalesce(reduce(lambda a, b: a + F.coalesce(b, F.lit(0)), cached, F.lit(0)) > prompt, F.lit(False))


def count_or_null(x: Column) -> Column:
    """A whole number of at least 0, as text or number; else null."""
    return F.when(x.cast("string").rlike(r"^\d{1,15}(?:\.0+)?$"), x.cast("string").try_cast("double").cast("long"))


def usd_or_null(x: Column) -> Column:
    """A finite amount of at least 0, else null."""
    n = x.try_cast("double")
    return F.when((n >= 0) & ~F.isnan(n) & (n < float("inf")), n)


# Ids, models and versions that the contract takes.
ID, MODEL, VERSION = r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$", r"^[A-Za-z0-9][A-Za-z0-9._:/+-]{0,127}$", r"^[A-Za-z0-9][A-Za-z0-9._+-]{0,63}$"


def id_or_null(x: Column) -> Column:
    return F.when(x.rlike(ID), x)


def model_or_null(x: Column) -> Column:
    return F.when(x.rlike(MODEL) & ~x.contains("..") & ~x.contains("//"), x)


def version_or_null(x: Column) -> Column:
    return F.when(x.rlike(VERSION), x)


def bound_millis(x: Column) -> Column:
    """A bound of a window as milliseconds: whole milliseconds or an ISO time as text; null for anything else or below zero."""
    at = F.when(x.rlike(r"^\d{1,16}$"), x.try_cast("long")).when(x.rlike(r"^\d{4}-\d{2}-\d{2}"), F.unix_millis(F.try_to_timestamp(x)))
    return F.when((at >= 0) & (at <= SAFE_INTEGER), at)


def quarter(at: Column) -> Column:
    """Such as 2024Q1."""
    return F.concat(F.year(at).cast("string"), F.lit("Q"), F.quarter(at).cast("string"))


def round_usd(x: Column) -> Column:
    """To a billionth of a dollar, halves up."""
    return round_half_up(x, 9)


# Bounds of cost in dollars and of time in seconds.
LOW_COST, MEDIUM_COST, FAST, MEDIUM_TIME = 1, 5, 300, 1800


def outcome_labels(cost: Column, budget: Column, seconds: Column, succeeded: Column) -> Column:
    """A struct of labels: budget, cost, time and success; unknown where what they need is null."""
    budget_label = F.when(budget.isNull() | cost.isNull(), "unknown").when(cost <= budget, "under_budget").otherwise("over_budget")
    cost_label = F.when(cost.isNull(), "unknown").when(cost == 0, "free").when(cost < LOW_COST, "low").when(cost < MEDIUM_COST, "medium").otherwise("high")
    time_label = F.when(seconds.isNull(), "unknown").when(seconds < FAST, "fast").when(seconds < MEDIUM_TIME, "medium").otherwise("slow")
    success = F.when(F.coalesce(succeeded, F.lit(False)), "success").otherwise("failure")
    return F.struct(budget_label.alias("budget_label"), cost_label.alias("cost_label"), time_label.alias("time_label"), success.alias("success_label"))
