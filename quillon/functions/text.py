"""What subjects, bodies, labels, logins and paths say: numbers, reverts, fixes, actors, signals."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import exprs as X


def trimmed(text: Column) -> Column:
    """Without blanks of any kind at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def group_of(text: Column, pattern: str, i: int = 1) -> Column:
    """A group of the first match; null without a match or if the group is empty."""
    return F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))


def all_groups(text: Column, pattern: str, i: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(i))


def corpus_pr_numbers(subject: Column, body: Column, repo: Column) -> Column:
    """Distinct numbers that a commit of the main line landed, first seen first.

    A batch names several; a merge, a bot's merge, a rollup or a squash one; and a trailer
    counts if it names this repository's own address.
    """
    s = trimmed(subject)
    one = F.coalesce(group_of(s, r"(?i)^merge pull request #(\d+)\b"), group_of(s, r"(?i)^(?:auto merge|rollup merge) of #(\d+)\b"), group_of(s, r"\(#(\d+)\)\s*$"))
    named = F.when(s.rlike(r"(?i)^merge(?:\s+#\d+)+\s*$"), all_groups(s, r"#(\d+)")).otherwise(F.array(one))
    pattern = F.concat(F.lit(r"(?im)^Pull Request resolved:\s*https://github\.com/\Q"), repo, F.lit(r"\E/pull/(\d+)\s*$"))
    trailer = F.call_function("regexp_extract", F.coalesce(body, F.lit("")), pattern, F.lit(1))
    numbers = F.transform(F.concat(named, F.array(F.nullif(trailer, F.lit("")))), lambda x: x.cast("long"))
    return F.array_distinct(F.filter(numbers, lambda x: x > 0))


def followup_reference(url: Column, author_type: Column, author_login: Column, base_ref: Column, repo: Column, branch: Column) -> Column:
    """Is it an issue or change of the same repository, by a person, and not into another branch? What is unknown doesn't exclude."""
    prefix = F.concat(F.lit("https://github.com/"), F.lower(repo), F.lit("/"))
    own = F.startswith(F.lower(url), prefix) & F.substr(F.lower(url), F.length(prefix) + 1).rlike(r"^(?:issues|pull)/\d+")
    bot = F.coalesce(author_type == "Bot", F.lit(False)) | F.coalesce(author_login.rlike(r"(?i)(?:\[bot\]|bot|robot)$"), F.lit(False))
    return F.coalesce(own & ~bot & (base_ref.isNull() | (base_ref == branch)), F.lit(False))


# Whole identities of agents, domains of their addresses, and names of automation.
AGENT_NAME = r"(?i)^(?:claude(?: code)?|codex|(?:github )?copilot|devin(?:-ai-integration)?|aider|cursor(?:-agent)?|openhands(?:-agent)?)(?:\[bot\])?$"
AGENT_EMAIL = r"(?i)@(?:anthropic|openai)\.com$|\bcopilot@users\.noreply\.github\.com$|devin-ai-integration"
AUTOMATION_NAME = r"(?i)\[bot\]$|(?:^|[\s_-])(?:bot|robot)$|mergebot$|^bors$"
CO_AUTHOR = r"(?im)^co-authored-by:\s*(.*?)\s*<([^>]*)>"


def commit_actor(author_name: Column, author_email: Column, body: Column) -> Column:
    """agent if the author or a co-author is one, else what the author is: automation or human."""

    def is_agent(name: Column, email: Column) -> Column:
        return F.coalesce(trimmed(name).rlike(AGENT_NAME), F.lit(False)) | F.coalesce(trimmed(email).rlike(AGENT_EMAIL), F.lit(False))

    body = F.coalesce(body, F.lit(""))
    others = F.arrays_zip(all_groups(body, CO_AUTHOR, 1).alias("name"), all_groups(body, CO_AUTHOR, 2).alias("email"))
    helped = F.exists(others, lambda o: is_agent(o["name"], o["email"]))
    automatic = F.coalesce(trimmed(author_name).rlike(AUTOMATION_NAME), F.lit(False))
    return F.when(is_agent(author_name, author_email) | helped, "agent").when(automatic, "automation").otherwise("human")


# How reverts, fixes, backports and the reasons of reverts are worded.
REVERT_TITLE = r"(?i)^\s*(?:\[[^\]]*\]\s*)?revert\b|\brevert(?:ed|s)?\s+\""
REVERTS_COMMIT, REVERTS_CHANGE = r"(?im)^\s*this reverts commit [0-9a-f]{7,40}", r"(?im)^\s*reverts [\w.-]+\/[\w.-]+#\d+"
REVERT_OF_REVERT = r"(?i)^\s*(?:\[[^\]]*\]\s*)?(?:revert\s+\"revert\b|re-?land\b|reapply\b|re-?apply\b)"
FIX_TITLE = r"(?i)^\s*(?:\[[^\]]*\]\s*)*(?:[\w.-]+(?:\([^)]*\))?!?:\s*)?(?:hot)?fix(?:e[sd])?\b|^\s*(?:\[[^\]]*\]\s*)*bug ?fix\b"
FIX_LABEL = r"(?i)\b(?:bug|regression|hotfix)\b|^fix$|^type: ?fix$|^kind\/(?:bug|regression)$"
BACKPORT = r"(?im)^\s*(?:\[[^\]]*\]\s*)*\[?(?:backport|cherry[- ]?pick)\b|\(cherry picked from commit [0-9a-f]{7,40}\)"
REVERT_REASON = r"(?i)\bdue to\b([^\n]*)"
NON_DEFECT = (
    r"(?i)merge conflict|conflicts? with|(?:to|in order to)(?: be able to)? (?:cleanly )?revert|dependen(?:cy|t) (?:of|on)|depends on|land ?race|stack (?:is )?in a (?:weird|bad|broken) state"
    r"|wait(?:ing)? for .{0,40}(?:confirm|approv|review)|before merging|needs? to (?:be )?land(?:ed)? internally"
)
AUTOREVERT = r"(?i)autorevert"
INTERNAL_BUILD = r"(?i)internal(?:ly)?\b|\bD\d{7,}\b|\bdiff\b.{0,30}\b(?:reverted|backed out)"
PUBLIC_CI = r"(?i)\b(?:ci|trunk|tests?|builds?|jobs?|lint|failures?|fail(?:s|ed|ing)?|break(?:s|ing)?|broke(?:n)?|red|flak\w*|timeouts?|timed out|segfaults?|crash\w*)\b|actions\/runs"
DEPENDENCY_BOT = r"(?i)^(?:dependabot(?:-preview)?|renovate(?:-bot)?|greenkeeper|pyup-bot|snyk-bot|depfu)(?:\[bot\])?$"
REGRESSION_BEFORE = r"(?i)\b(?:(?:regress(?:ion|ed)?|broke(?:n)?|breakage|bug|crash\w*|fail\w*)\s+(?:in|from|by|after|since|introduced|caused)|caused by|introduced (?:in|by))\b[^.\n]{0,25}$"


def is_revert(title: Column, body: Column) -> Column:
    body = F.coalesce(body, F.lit(""))
    return title.rlike(REVERT_TITLE) | body.rlike(REVERTS_COMMIT) | body.rlike(REVERTS_CHANGE)


def is_fix_subject(subject: Column) -> Column:
    return subject.rlike(FIX_TITLE)


def common_exclusion(author_login: Column, title: Column, body: Column) -> Column:
    """dependency_bot or backport, else null."""
    text = F.concat_ws("\n", title, F.coalesce(body, F.lit("")))
    return F.when(F.coalesce(author_login.rlike(DEPENDENCY_BOT), F.lit(False)), "dependency_bot").when(text.rlike(BACKPORT), "backport")


@dataclass(frozen=True)
class Systems:
    """Names by which a repository's reverts speak of its own systems: what syncs changes elsewhere, what builds them out of sight, and where public checks are shown."""

    sync: tuple[str, ...] = ()
    internal: tuple[str, ...] = ()
    public: tuple[str, ...] = ()


def _or_named(pattern: str, names: Sequence[str]) -> str:
    return "|".join([pattern, *map(re.escape, names)])


def revert_reason_class(body: Column, systems: Systems = Systems()) -> Column:
    """The class of the reason that a merge bot gives; unstated without one. ``systems``: names of the repository's own that count as well."""
    reason = group_of(body, REVERT_REASON)
    patterns = {"collateral": _or_named(NON_DEFECT, systems.sync), "autorevert": AUTOREVERT, "internal_build": _or_named(INTERNAL_BUILD, systems.internal), "public_ci": _or_named(PUBLIC_CI, systems.public)}
    stated = F.coalesce(*[F.when(reason.rlike(p), name) for name, p in patterns.items()], F.lit("other"))
    return F.when(reason.isNotNull(), stated).when(F.coalesce(body.rlike(AUTOREVERT), F.lit(False)), "autorevert").otherwise("unstated")


def revert_exclusion(title: Column, body: Column, systems: Systems = Systems()) -> Column:
    """revert_of_revert or revert_non_defect, else null."""
    return F.when(title.rlike(REVERT_OF_REVERT), "revert_of_revert").when(F.coalesce(group_of(body, REVERT_REASON).rlike(_or_named(NON_DEFECT, systems.sync)), F.lit(False)), "revert_non_defect")


# Labels of bugs and regressions, and look-alikes.
BUG_LABEL = r"(?i)^(?:(?:type|kind|t|c|issue|category)\s*[:/-]\s*)?bug$|^bug[- ]unreleased$|^potential bug$|^(?:(?:type|kind|c|i)\s*[:/-]\s*)?(?:crash|ice)$"
REGRESSION_LABEL = r"(?i)regress|^incident\b"
NOT_REGRESSION = r"(?i)\b(?:not|non)[- ]?(?:a[- ])?regression"


def regression_labels(labels: Column) -> Column:
    return F.filter(labels, lambda x: x.rlike(REGRESSION_LABEL) & ~x.rlike(NOT_REGRESSION))


def is_bug_issue(kind: Column, labels: Column) -> Column:
    return F.coalesce(kind == "Bug", F.lit(False)) | F.exists(labels, lambda x: x.rlike(BUG_LABEL)) | (F.size(regression_labels(labels)) > 0)


# Paths of tests, for features and for blame, and of generated files.
FEATURE_TEST_PATH = r"(?i)(^|/)(__tests__|tests?)/|(\.|-)(test|spec)\.[cm]?[jt]sx?$|_test\.(go|py)$"
BLAME_TEST_PATH = r"(?:^|/)(?:tests?|__tests__|spec|testing)/|(?:^|/)test_[^/]*$|[._-](?:test|spec)s?\.[^/]+$|_test\.go$|Tests?\.(?:java|kt|cs|swift)$"
GENERATED_PATH = (
    r"(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|Cargo\.lock|go\.(?:mod|sum)|poetry\.lock|uv\.lock|Pipfile\.lock|Gemfile\.lock|composer\.lock)$"
    r"|(?:^|/)(?:__snapshots__|__generated__|generated|openapi-gen|testdata|translations)/|\.(?:snap|pb\.go|pb\.cc|pb\.h|min\.js|png|jpe?g|gif|svg|ico)$|[._]generated\.[^/]+$"
)


def is_test_file(path: Column) -> Column:
    return path.rlike(FEATURE_TEST_PATH)


def is_blamable(path: Column) -> Column:
    """Neither a test nor generated."""
    return ~path.rlike(BLAME_TEST_PATH) & ~path.rlike(GENERATED_PATH)


def repo_path(path: Column) -> Column:
    """Slashes forward and single, none in front; null for paths that leave the repository."""
    p = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "^/+", ""), "/+", "/")
    return F.when((p != "") & (p != ".") & ~p.startswith("../") & ~p.contains("/../"), p)


def out_of_scope_files(paths: Column, files: Column, prefixes: Column) -> Column:
    """How many paths are neither among ``files`` nor below a prefix; null if no scope is given."""

    def outside(p: Column) -> Column:
        return ~F.array_contains(F.coalesce(files, F.array().cast("array<string>")), p) & ~F.exists(F.coalesce(prefixes, F.array().cast("array<string>")), lambda x: p.startswith(x))

    given = F.coalesce(F.size(files) > 0, F.lit(False)) | F.coalesce(F.size(prefixes) > 0, F.lit(False))
    return F.when(given, F.size(F.filter(F.transform(paths, repo_path), lambda p: p.isNotNull() & outside(p))))


# Wording that asks for depth.
DEEP = r"\binvestigat(?:e|ion)\b|\banaly[sz]e\b|\bdeep(?:ly)?\b|\broot cause\b|\bcompare\b"


def reasoning_depth(text: Column, given: Column | None = None) -> Column:
    """The given depth, else shallow below 40 characters, deep by its wording, else standard."""
    t = F.lower(trimmed(text))
    found = F.when((F.length(t) > 0) & (F.length(t) < 40), "shallow").when(t.rlike(DEEP), "deep").when(t.isNotNull(), "standard")
    return found if given is None else F.coalesce(given, found)


# Languages of file extensions.
LANGUAGES = {
    "c": "C", "cc": "C++", "cpp": "C++", "cs": "C#", "css": "CSS", "go": "Go", "h": "C/C++ Headers", "hpp": "C/C++ Headers", "html": "HTML", "java": "Java", "js": "JavaScript",
    "jsx": "JavaScript", "kt": "Kotlin", "kts": "Kotlin", "md": "Markdown", "mjs": "JavaScript", "php": "PHP", "py": "Python", "rb": "Ruby", "rs": "Rust", "sh": "Shell", "sql": "SQL",
    "swift": "Swift", "ts": "TypeScript", "tsx": "TypeScript", "yaml": "YAML", "yml": "YAML",
}


def language_signals(extension_counts: Column) -> Column:
    """Distinct languages of extensions that occur, sorted."""
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    used = F.map_keys(F.map_filter(extension_counts, lambda _, n: n > 0))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(used, lambda e: F.try_element_at(known, F.lower(F.regexp_replace(e, r"^\.", "")))))))


def framework_signals(categories: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(categories, trimmed), lambda x: x != "")))


def metadata_block(body: Column, marker: str) -> Column:
    """The ``key: value`` lines of the first comment that starts with ``marker``, as a map; null without such a comment.

    Keys are in lower case, one quote at either end of a value goes, and the last line of a key counts.
    """
    line = r"^\s*([A-Za-z][\w.-]{0,63})\s*:\s*(.{1,256})\s*$"
    block = F.regexp_extract(body, rf"(?is)<!--\s*{marker}\s*(.*?)\s*-->", 1)
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(line))

    def key(x: Column) -> Column:
        return F.lower(F.regexp_extract(x, line, 1))

    def value(x: Column) -> Column:
        return F.regexp_replace(trimmed(F.regexp_extract(x, line, 2)), r"^['\"]|['\"]$", "")

    keys = F.array_distinct(F.transform(lines, key))
    last = F.transform(keys, lambda k: value(F.element_at(F.filter(lines, lambda x: key(x) == k), -1)))
    return F.when(body.rlike(rf"(?is)<!--\s*{marker}\s*.*?\s*-->"), F.map_from_arrays(keys, last))


# How bodies disclose an agent's work, and the question of a template with what answers it.
DISCLOSURES = {
    "explicit_ai_generated_change": r"(?im)^\s*(?:This (?:is an? |(?:PR|pull request|change|diff|patch) (?:is|was) (?:an? )?))AI[- ](?:generated|authored|assisted)\b",
    "explicit_agent_authored": r"(?im)^\s*(?:[-*]\s*)?Agent[- ]authored\b",
    "explicit_named_agent_creator": r"(?im)^\s*Generated by Mintlify Agent[.!]?\s*$|^\s*This PR was created by the Inkeep Content Writer agent\b",
}
TOOLING_QUESTION = r"(?i)Was generative AI tooling used to co-author this PR\?([\s\S]{0,1000})"
TOOLING_YES, TOOLING_NAMES = r"(?im)^\s*-\s*\[x\]\s*Yes\b", r"(?i)\b(?:Cursor|Claude|Copilot|Codex|Aider|OpenHands|Gemini)\b"


def exploratory_disclosure(body: Column) -> Column:
    """Which explicit statement of an agent's work a body makes outside code and comments; null for none."""
    text = F.regexp_replace(F.regexp_replace(body, r"(?s)```.*?```", ""), r"(?s)<!--.*?-->", "")
    answer = group_of(text, TOOLING_QUESTION)
    stated = [F.when(text.rlike(pattern), kind) for kind, pattern in DISCLOSURES.items()]
    return F.coalesce(*stated, F.when(answer.rlike(TOOLING_YES) & answer.rlike(TOOLING_NAMES), "checked_airflow_ai_disclosure"))


def tsc_errors(output: Column) -> Column:
    return F.coalesce(F.regexp_count(output, F.lit(r"\berror TS\d+")), F.lit(0))


def eslint_errors(report: Column) -> Column:
    """The sum of ``errorCount`` over the entries of a JSON array; null for anything else."""
    entries = F.from_json(report, "array<struct<errorCount: double>>")
    total = F.aggregate(entries, F.lit(0.0), lambda n, e: n + F.coalesce(e["errorCount"], F.lit(0.0)))
    return F.when(trimmed(report).startswith("[") & F.try_parse_json(report).isNotNull(), total.cast("long"))


# Extensions whose complexity is counted, and their branch tokens.
HASH_COMMENTS = (".py", ".rb", ".sh", ".bash")
CODE_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".go", ".rs", ".java", ".rb", ".php", ".c", ".h", ".cpp", ".hpp", ".cs", ".swift", ".kt", ".sh", ".bash")
BRANCHES = (r"\bif\b", r"\belse\s+if\b", r"\belif\b", r"\bfor\b", r"\bwhile\b", r"\bcase\b", r"\bwhen\b", r"\bcatch\b", r"\bexcept\b", r"\brescue\b", r"\?[^:]", r"&&", r"\|\|")


def bare_code(source: Column, extension: Column) -> Column:
    """Source without comments and quoted strings; what opens first wins, and what never closes reaches to the end."""
    block, quoted = r"/\*(?s:.*?)(?:\*/|\z)", r"\"(?:[^\"\\]|\\(?s:.))*+(?:\"|\z)|'(?:[^'\\]|\\(?s:.))*+(?:'|\z)|`(?:[^`\\]|\\(?s:.))*+(?:`|\z)"
    triple = r"\"\"\"(?s:.*?)(?:\"\"\"|\z)|'''(?s:.*?)(?:'''|\z)"
    plain = F.regexp_replace(source, rf"//[^\n]*|{block}|{quoted}", "")
    python = F.regexp_replace(source, rf"#[^\n]*|{block}|{triple}|{quoted}", "")
    other = F.regexp_replace(source, rf"#[^\n]*|{block}|{quoted}", "")
    return F.when(extension == ".py", python).when(extension.isin(*HASH_COMMENTS), other).otherwise(plain)


def file_complexity(source: Column, extension: Column) -> Column:
    """One and the number of branch tokens in bare code; null for other extensions."""
    code = bare_code(source, extension)
    n = reduce(lambda a, b: a + b, [F.regexp_count(code, F.lit(p)) for p in BRANCHES])
    return F.when(extension.isin(*CODE_EXTENSIONS), 1 + n)


def cited_numbers(text: Column, repo: Column) -> Column:
    """Numbers that the text cites as this repository's own, with the text of up to 60 characters before each: ``array<struct<n, before>>``.

    ``#N`` counts where no word, slash, dot, hash or dash precedes it, ``owner/name#N`` and addresses only of this repository.
    """
    own = F.concat(F.lit(r"(?i)https://github\.com/\Q"), repo, F.lit(r"\E/(?:pull|issues)/\d+|\b\Q"), repo, F.lit(r"\E#\d+\b|(?:^|[^\w/.#-])#\d+\b"))
    return _with_before(text, own, lambda m: F.regexp_extract(m, r"(\d+)$", 1).cast("long"), "n", "bigint")


def sha_tokens(text: Column) -> Column:
    """Words of 7 to 40 hex digits with a letter among them, with the text before: ``array<struct<token, before>>``."""
    found = _with_before(text, F.lit(r"\b[0-9a-f]{7,40}\b"), lambda m: m, "token", "string")
    return F.filter(found, lambda x: x["token"].rlike("[a-f]"))


def _with_before(text: Column, pattern: Column, value: Callable[[Column], Column], name: str, kind: str) -> Column:
    """Matches in their order, each with the 60 characters before it at most."""
    matches = F.call_function("regexp_extract_all", text, pattern, F.lit(0))
    between = F.split(text, pattern)
    none = F.array().cast(f"array<struct<{name}: {kind}, before: string>>")

    def step(state: Column, i: Column) -> Column:
        at = state["at"] + F.length(F.get(between, i))
        found = F.struct(value(F.get(matches, i)).alias(name), F.substr(text, F.greatest(at - 60, F.lit(0)) + 1, F.least(at, F.lit(60))).alias("before"))
        return F.struct((at + F.length(F.get(matches, i))).alias("at"), F.array_append(state["out"], found).alias("out"))

    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    return F.when(F.size(matches) > 0, F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), start, step)["out"]).otherwise(none)


def in_regression_wording(before: Column) -> Column:
    """Does the text before a citation say that something broke?"""
    return before.rlike(REGRESSION_BEFORE)


# What is kept out of Aider's output lines.
ANSI = r"\x1b\[[0-9;]*[A-Za-z]"


def aider_line(line: Column) -> Column:
    """Tokens and costs of one line of Aider's output as a struct of nulls where it says nothing.

    ``model, input_tokens, output_tokens, cache_write_tokens, cache_read_tokens, session_cost_usd``.
    """
    clean = F.regexp_replace(line, ANSI, "")

    def count(label: str) -> Column:
        found = group_of(clean, rf"(?i)Tokens:\s*(?:.*?,\s+)?([\d.,]+\s*[km]?)\s+{label}\b")
        digits = F.regexp_replace(F.regexp_extract(found, r"^([\d.,]+)", 1), ",", "").try_cast("double")
        unit = F.lower(F.regexp_extract(found, r"([kKmM])\s*$", 1))
        return F.floor(digits * F.when(unit == "k", 1000).when(unit == "m", 1000000).otherwise(1) + 0.5).cast("long")

    return F.struct(
        group_of(clean, r"(?i)^\s*(?:Main model|Model):\s*(\S+)(?:\s+with\s+\S.*)?$").alias("model"), count("sent").alias("input_tokens"), count("received").alias("output_tokens"),
        count(r"cache\s+write").alias("cache_write_tokens"), count(r"cache\s+read").alias("cache_read_tokens"), group_of(clean, r"(?i)Cost:.*?\$([\d.]+)\s+session").try_cast("double").alias("session_cost_usd"),
    )


def coalesced_match(text: Column, pattern: str) -> Column:
    """Does the text match? A null one doesn't."""
    return F.coalesce(text.rlike(pattern), F.lit(False))


# Complexity of depths and of other words for it, types of task families, and languages that a descriptor names.
DEPTH_COMPLEXITY = {"shallow": 3, "standard": 5, "deep": 8}
COMPLEXITY = {"low": 3, "small": 3, "medium": 5, "moderate": 5, "high": 8, "large": 8, "very_high": 10, **DEPTH_COMPLEXITY}
TASK_TYPES = {"bugfix": "bugfix", "feature": "feature", "migration": "migration", "refactor": "refactor", "test": "tests", "docs": "docs", "infra": "infra", "chore": "infra", "mixed": "unknown", "investigation": "unknown"}
DESCRIBED = {"python": "python", "typescript": "typescript", "javascript": "javascript", "go": "go", "rust": "rust", "java": "java", "shell": "bash", "bash": "bash"}


def _of(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def complexity_number(x: Column) -> Column:
    """A finite number, or what a word for complexity stands for; null for anything else."""
    word = F.lower(trimmed(x))
    n = F.when(word.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?$"), word.try_cast("double"))
    return F.coalesce(_of(COMPLEXITY, word).cast("double"), n)


def task_descriptor(text: Column, files: Column, extension_counts: Column) -> Column:
    """A struct of task type, complexity, size of the repository and language; null where nothing tells of one."""
    said = F.when(trimmed(text) != "", trimmed(text))
    used = F.map_filter(extension_counts, lambda _, n: n > 0)
    label = F.get(language_signals(F.map_filter(used, lambda k, _: k == X.dominant_key(used))), F.lit(0))
    language = F.when(label.isNotNull(), F.coalesce(_of(DESCRIBED, F.lower(label)), F.lit("unknown")))
    return F.struct(_of(TASK_TYPES, X.task_family(said)).alias("task_type"), _of(DEPTH_COMPLEXITY, reasoning_depth(said)).alias("complexity"), X.repository_scale(files).alias("repo_size_bucket"), language.alias("language"))
