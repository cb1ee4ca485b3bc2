"""Which agent tool worked on a change: markers in accounts, branches, commits and bodies, and what they add up to.

Absence proves nothing: without a marker a change is unmarked, not a person's. Identities match as whole names.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

_BOT = r"(?:\[bot\])?"
# Whole names and addresses of tools.
IDENTITIES = (
    ("claude", r"(?i)^(?:claude\[bot\]|claude\s+(?:code|opus|sonnet|haiku|fable|\d)[\w.\s-]*(?:\([^)]*\))?)$", r"(?i)^(?:noreply|claude)@anthropic\.com$"),
    ("copilot", rf"(?i)^(?:github )?copilot(?:-swe-agent|-autofix)?{_BOT}$", r"(?i)^(?:\d+\+)?copilot@users\.noreply\.github\.com$"),
    ("cursor", rf"(?i)^cursor(?:[ -]agent)?{_BOT}$", r"(?i)^cursoragent@cursor\.com$"),
    ("codex", rf"(?i)^(?:openai[ -])?codex{_BOT}$|^chatgpt-codex-connector{_BOT}$", r"(?i)^(?:codex|noreply)@openai\.com$"),
    ("devin", rf"(?i)^devin-ai-integration{_BOT}$|^devin ai$", r"(?i)devin-ai-integration"),
    ("gemini", rf"(?i)^(?:google[ -])?gemini(?:[ -](?:cli|code[ -]assist))?{_BOT}$", None),
    ("aider", r"(?i)^aider(?:\s*\([^)]*\))?$|\(aider\)$", r"(?i)^noreply@aider\.chat$"),
    ("openhands", rf"(?i)^openhands(?:-agent)?{_BOT}$", r"(?i)^openhands@all-hands\.dev$"),
    ("other", rf"(?i)^(?:ai|coding)[ _-]agent{_BOT}$", None),
)
TOOL_WORDS = "Claude Code|Claude|GitHub Copilot|Copilot|Cursor|OpenAI Codex|Codex|Gemini CLI|Gemini|Devin|Aider|aider|OpenHands"
FAMILY_OF = {
    "claude code": "claude", "claude": "claude", "github copilot": "copilot", "copilot": "copilot", "cursor": "cursor", "openai codex": "codex", "codex": "codex", "gemini cli": "gemini", "gemini": "gemini",
    "devin": "devin", "aider": "aider", "openhands": "openhands",
}
TOOLS = ("claude", "copilot", "cursor", "codex", "devin", "gemini", "aider", "openhands")
BRANCHES = {**{t: t for t in TOOLS}, "claude-code": "claude", "agent": "other"}
CO_AUTHOR = r"(?im)^[ \t]*co-authored-by:[ \t]*(.*?)[ \t]*<([^>]*)>"
ASSISTED = rf"(?im)^[ \t]*(?:assisted|generated|co-developed)-by:[ \t]*.*?\b({TOOL_WORDS})\b"
AUTHORSHIP = (
    r"(?m)(?<!\b(?:not|never|n't)[ \t]{1,9})(?<!\bnot[ \t]{1,9}been[ \t]{1,9})\b(?:[Cc]o-?[Aa]uthored|[Aa]uthored|[Bb]uilt|[Ww]ritten|[Ii]mplemented|[Dd]eveloped)[ \t]+(?:by|with|using|via)\b[ \t]+"
    rf"(?:the[ \t]+)?(?:[\w-]+[ \t]+){{0,3}}?\(?({TOOL_WORDS})\b"
)
FOOTER = r"(?im)^\W*(?:generated|created|written|authored|made)\s+(?:with|by|using)\W+(" + "|".join(FAMILY_OF) + r")\]?(?:\([^)\s]*\))?\W*$"
LINKS = {"claude": r"(?i)https://claude\.ai/code/session", "devin": r"(?i)https://app\.devin\.ai/sessions/", "codex": r"(?i)https://chatgpt\.com/codex/tasks/", "cursor": r"(?i)https://cursor\.com/(?:agents|background-agent)"}
MODEL_TAG = r"(?im)^[ \t]*model[ \t]*[=:][ \t]*((?:claude|gpt|gemini)-[\w.-]+|o[13](?:-[\w.-]+)?)[ \t]*$"
HARNESSES = ("aider", "claude-code", "codex", "openhands")
MODELS = ("claude-", "gpt-", "o1", "o3", "gemini-")



def _strings(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def identity_family(name: Column, email: Column) -> Column:
    """The tool that a name or address is, or whose word it has together with bot, agent or ai; null for people."""
    n, e = T.trimmed(F.coalesce(name, F.lit(""))), T.trimmed(F.coalesce(email, F.lit("")))
    whole = F.coalesce(*[F.when(n.rlike(by_name) | (e.rlike(by_email) if by_email else F.lit(False)), family) for family, by_name, by_email in IDENTITIES])

    def account(text: Column) -> Column:
        words = F.split(F.regexp_replace(F.lower(text), r"\[bot\]$", "-bot"), "[^a-z0-9]+")
        tool = F.get(F.filter(words, lambda w: w.isin(*TOOLS)), F.lit(0))
        return F.when(F.arrays_overlap(words, F.array(F.lit("bot"), F.lit("agent"), F.lit("ai"))), tool)

    return F.coalesce(whole, account(n), account(F.substring_index(e, "@", 1)))


def identity_model(name: Column) -> Column:
    """The model that a tool's name tells, as an id."""
    n = T.trimmed(F.coalesce(name, F.lit("")))
    told = F.coalesce(F.substring_index(T.group_of(n, r"(?i)^aider\s*\(([^)]+)\)"), "/", -1), F.when(n.rlike(r"(?i)^claude\s+\S"), F.regexp_replace(n, r"\([^)]*\)", "")))
    slug = F.regexp_replace(F.lower(T.trimmed(told)), r"[\s.]+", "-")
    return F.when((slug != "claude-code") & slug.rlike(r"^(?:claude-|gpt-|gemini-|o[13](?:-|$))"), slug)


def signature_families(text: Column) -> Column:
    """Tools that footers, session links, trailers and statements of authorship name, outside code, comments and quotes."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)```.*?(?:```|\z)", ""), r"(?s)<!--.*?-->", "")
    clean = F.regexp_replace(bare, r"(?m)^[ \t]*>.*$", "")

    def named(pattern: str) -> Column:
        return F.transform(T.all_groups(clean, pattern), lambda w: _lookup(FAMILY_OF, F.lower(w)))

    links = F.array(*[F.when(clean.rlike(link), family) for family, link in LINKS.items()])
    footer = F.array(_lookup(FAMILY_OF, F.lower(T.group_of(clean, FOOTER))))
    return F.array_distinct(F.array_compact(F.concat(footer, links, named(ASSISTED), named(AUTHORSHIP))))


def branch_family(head_ref: Column) -> Column:
    return F.when(head_ref.contains("/"), _lookup(BRANCHES, F.lower(F.substring_index(head_ref, "/", 1))))


def _co_authors(message: Column) -> Column:
    m = F.coalesce(message, F.lit(""))
    return F.arrays_zip(T.all_groups(m, CO_AUTHOR, 1).alias("name"), T.all_groups(m, CO_AUTHOR, 2).alias("email"))


def _model_family(model: Column) -> Column:
    return F.when(model.startswith("claude-"), "claude").when(model.startswith("gemini-"), "gemini").otherwise("other")


def _commit(c: Column) -> Column:
    """What one commit shows: families of author, co-authors, signatures and model tags, and models."""
    others = _co_authors(c["message"])
    tags = F.transform(T.all_groups(F.coalesce(c["message"], F.lit("")), MODEL_TAG), F.lower)
    return F.struct(
        _strings(identity_family(c["author_name"], c["author_email"])).alias("author"),
        F.array_compact(F.transform(others, lambda o: identity_family(o["name"], o["email"]))).alias("co"),
        F.concat(signature_families(c["message"]), F.transform(tags, _model_family)).alias("signed"),
        F.concat(
            _strings(F.when(identity_family(c["author_name"], c["author_email"]).isNotNull(), identity_model(c["author_name"]))),
            F.array_compact(F.transform(others, lambda o: F.when(identity_family(o["name"], o["email"]).isNotNull(), identity_model(o["name"])))), tags,
        ).alias("models"),
    )


def agent_markers(changes: DataFrame) -> DataFrame:
    """``changes`` with a struct ``markers``.

    ``author_login, author_type, head_ref, commits array<struct<message, author_name, author_email>>`` (null: could not be read), ``body,
    body_unavailable, landing_message``. ``present`` is null, not false, if nothing was found and something could not be read; ``family`` is the one
    tool, multiple, other or none; the landing commit marks a change but isn't among its commits.
    """
    login = F.coalesce("author_login", F.lit(""))
    is_bot = login.rlike(r"(?i)\[bot\]$") | (F.lower(F.coalesce("author_type", F.lit(""))) == "bot")
    account = F.when(is_bot, identity_family(F.concat(F.regexp_replace(login, r"(?i)\[bot\]$", ""), F.lit("[bot]")), F.lit("")))
    none = F.array().cast("array<string>")
    seen = changes.withColumns({
        "__account": account, "__branch": branch_family(F.col("head_ref")), "__commits": F.transform("commits", _commit), "__landing": F.transform(_co_authors(F.col("landing_message")), lambda o: F.struct(identity_family(o["name"], o["email"]).alias("family"), identity_model(o["name"]).alias("model"))),
        "__landed": signature_families(F.col("landing_message")), "__body": F.when(F.coalesce("body_unavailable", F.lit(False)), none).otherwise(signature_families(F.col("body"))),
    })

    def of_commits(*fields: str) -> Column:
        return F.coalesce(F.flatten(F.transform("__commits", lambda c: F.concat(*[c[f] for f in fields]))), none)

    landing = F.filter("__landing", lambda x: x["family"].isNotNull())
    marked = F.size(F.filter("__commits", lambda c: F.size(F.concat(c["author"], c["co"], c["signed"])) > 0))
    families = F.array_distinct(F.concat(_strings(F.col("__account"), F.col("__branch")), of_commits("author", "co", "signed"), F.transform(landing, lambda x: x["family"]), F.col("__landed"), F.col("__body")))
    models = F.array_distinct(F.concat(of_commits("models"), F.array_compact(F.transform(landing, lambda x: x["model"]))))
    specific = F.array_except("__families", F.array(F.lit("other")))
    unread = F.coalesce("body_unavailable", F.lit(False))
    known = F.col("commits").isNotNull()
    present = F.when(F.size("__families") > 0, True).when(known & ~unread, False)
    family = F.when(F.size(specific) > 1, "multiple").when(F.size(specific) == 1, F.get(specific, F.lit(0))).when(F.size("__families") > 0, "other").otherwise("none")
    on_landing = (F.size(landing) > 0) | (F.size("__landed") > 0)
    told = seen.withColumns({"__families": families, "__models": models})
    markers = F.struct(
        present.alias("present"), F.when(present.isNotNull(), family).alias("family"), F.when(known, F.when(F.size("commits") == 0, 0.0).otherwise(marked / F.size("commits"))).alias("marked_commit_share"),
        F.col("__models").alias("model_ids"), F.when(F.size("__models") == 1, F.get("__models", F.lit(0))).alias("exact_model"), F.col("__account").isNotNull().alias("by_account"), F.col("__branch").isNotNull().alias("by_branch"),
        F.when(on_landing | F.coalesce(marked > 0, F.lit(False)), True).when(known, False).alias("by_commit"), F.when(~unread, F.size("__body") > 0).alias("by_body"),
        ((F.size(of_commits("co")) > 0) | (F.size(landing) > 0)).alias("co_author"), ((F.size(of_commits("signed")) > 0) | (F.size("__landed") > 0) | (F.size("__body") > 0)).alias("signature"),
        F.coalesce(F.col("author_login").rlike(T.DEPENDENCY_BOT), F.lit(False)).alias("dependency_bot"),
    )
    return told.withColumn("markers", markers).drop("__account", "__branch", "__commits", "__landing", "__landed", "__body", "__families", "__models")


def recognized_model(model: Column) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [F.lower(model).startswith(m) for m in MODELS]), F.lit(False))


def attribution(changes: DataFrame, marker: str, bot_logins: Sequence[str] = (), own_bots: Sequence[str] = (), prefixes: Sequence[str] = (), own_prefixes: Sequence[str] = (), labels: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """``changes`` with agent, harness and model attributed; evidence that disagrees leaves an id unknown.

    ``changes`` as for ``agent_markers``, with ``labels, head_sha``. The metadata block that starts with ``marker`` counts as executed evidence if it names the coder's
    route and a known model and its head is this one or none. ``labels`` maps labels to a harness and model of theirs.
    """
    labels = labels or {}
    m = agent_markers(changes).withColumn("__meta", T.metadata_block(F.col("body"), marker))
    meta = {k: F.lower(F.try_element_at("__meta", F.lit(k))) for k in ("executedroute", "headsha", "model", "harness")}
    verified = F.coalesce((meta["executedroute"] == "coder") & recognized_model(meta["model"]) & (meta["headsha"].isNull() | (meta["headsha"] == F.lower("head_sha"))), F.lit(False))
    login = F.lower(F.coalesce("author_login", F.lit("")))
    configured = login.isin(*[x.lower() for x in (*bot_logins, *own_bots)]) if (*bot_logins, *own_bots) else F.lit(False)

    def starts(some: Sequence[str]) -> Column:
        return reduce(lambda a, b: a | b, [F.coalesce(F.col("head_ref").startswith(p), F.lit(False)) for p in some], F.lit(False))

    owned = starts(own_prefixes)
    by_prefix = starts(prefixes) | owned | branch_family(F.col("head_ref")).isNotNull()
    label = F.get(F.filter("labels", lambda x: x.isin(*labels)), F.lit(0)) if labels else F.lit(None).cast("string")

    def of_label(what: str) -> Column:
        known = {k: v[what].lower() for k, v in labels.items() if what in v}
        return _lookup(known, label) if known else F.lit(None).cast("string")

    methods = _strings(
        F.when(verified, "first_party_route_metadata"), F.when(configured, "owner_config").when(F.col("markers.by_account"), "bot_author"), F.when(F.col("markers.co_author"), "co_authored_by_trailer"),
        F.when(owned, "owner_config").when(by_prefix, "branch_prefix"), F.when(label.isNotNull(), "pr_label"), F.when(F.col("markers.signature"), "commit_signature"),
    )
    by_branch = branch_family(F.col("head_ref"))
    told = F.when(verified, _strings(meta["harness"])).otherwise(_strings(meta["harness"], of_label("harness"), F.when(by_branch == "claude", "claude-code").otherwise(by_branch)))
    harnesses = F.array_distinct(F.filter(told, lambda h: h.isin(*HARNESSES)))
    models = F.array_distinct(F.filter(F.when(verified, _strings(meta["model"])).otherwise(F.concat(_strings(of_label("model")), F.col("markers.model_ids"))), recognized_model))

    def one(ids: Column) -> Column:
        return F.when(F.size(ids) == 1, F.get(ids, F.lit(0)))

    model = one(models)
    return m.select(
        *changes.columns, "markers", F.when(F.size(methods) > 0, "agent").otherwise("unknown").alias("agent"), F.array_distinct(methods).alias("agent_methods"), one(harnesses).alias("harness"),
        F.when(one(harnesses).isNotNull(), F.when(verified, 1.0).otherwise(0.8)).alias("harness_confidence"), model.alias("exact_model"), F.when(model.isNotNull(), F.when(verified, 1.0).otherwise(0.5)).alias("model_confidence"),
        F.when(model.isNotNull(), F.when(verified, "first_party_executed").otherwise("heuristic")).alias("model_evidence"),
    )


SIGNALS = ("known_agent_account", "agent_branch", "agent_commit_or_landing", "agent_body", "explicit_agent_label", "bound_executed_route", "declared_harness_metadata", "owner_mapping")


def with_stratum(rows: DataFrame) -> DataFrame:
    """Rows of eight signals (``SIGNALS``), ``baseline`` and ``generic_bot`` with ``positive`` and the stratum they belong to."""
    positive = reduce(lambda a, b: a | b, [F.coalesce(F.col(s), F.lit(False)) for s in SIGNALS], F.coalesce("baseline", F.lit(False)))
    stratum = F.when(F.col("baseline"), "baseline_positive").when(positive, "added_positive").when(F.col("generic_bot"), "bot_without_agent_evidence").otherwise("unmarked")
    return rows.withColumn("positive", positive).withColumn("stratum", stratum)


def attribution_summary(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Marked changes at the baseline and with all signals, each signal's count and what it adds to the baseline (signals overlap)."""
    counts = [F.count_if(s).alias(f"n_{s}") for s in SIGNALS] + [F.count_if(F.col(s) & ~F.col("baseline")).alias(f"added_{s}") for s in SIGNALS]
    n, base, positive = F.count(F.lit(1)), F.count_if("baseline"), F.count_if("positive")
    return with_stratum(rows).groupBy(*by).agg(
        n.alias("eligible"), base.alias("baseline_marked"), positive.alias("full_union"), (positive - base).alias("added_unique"), F.when(n > 0, base / n).alias("baseline_rate"), F.when(n > 0, positive / n).alias("full_union_rate"),
        F.count_if("generic_bot").alias("generic_bot_authors"), F.count_if(F.col("generic_bot") & ~F.col("positive")).alias("bot_without_agent_evidence"), F.count_if(F.col("positive") | F.col("generic_bot")).alias("union_with_every_bot"), *counts,
    )
