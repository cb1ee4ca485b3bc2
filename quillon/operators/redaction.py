"""Sensitive values in texts replaced by keyed placeholders, previews, and keyed hashes of payloads."""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.canonical import canonical_text, hmac_sha256

CATEGORIES = ("secret", "token", "credential", "email", "url", "hostname", "org", "id", "code", "log")
# Patterns by category, in the order in which they are applied.
PATTERNS = (
    ("secret", r"\bAKIA[0-9A-Z]{16}\b", 0), ("secret", r"\bsk-[A-Za-z0-9]{8,}\b", 0), ("secret", r"\bghp_[A-Za-z0-9]{36}\b", 0), ("secret", r"\bxoxb-[A-Za-z0-9-]+\b", 0), ("secret", r"\b[A-Za-z0-9+/]{40,}={0,2}\b", 0),
    ("token", r"\btok-[A-Za-z0-9]{8,}\b", 0), ("token", r"\bBearer [A-Za-z0-9._-]{10,}\b", 0), ("token", r"^Authorization:\s+[^\n]+$", re.M),
    ("credential", r"\bpassword[=: ]+\S+\b", re.I), ("credential", r"\bpasswd[=: ]+\S+\b", re.I), ("credential", r"\bapi[_-]?key[=: ]+\S+\b", re.I), ("credential", r"\bprivate[_-]?key[=: ]+\S+\b", re.I),
    ("email", r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", re.I), ("url", r"https?://[^\s\"']+", 0),
    ("hostname", r"\b[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)*\.[a-z]{2,63}\b", re.I),
)
CODE = (("code", r"```[\s\S]*?```", 0), ("code", r"(?:^|\n)(?: {4,}|\t).*(?:\n(?: {4,}|\t).*)*", 0))
LOG = (("log", r"^(?:\d{4}-\d{2}-\d{2}T[0-9:.+-]+Z?\s+.*|(?:ERROR|WARN|INFO|DEBUG|TRACE)\b.*)$", re.M),)
RESULT = "output string, redactions array<struct<category: string, placeholder: string, count: long>>, has_code boolean, has_logs boolean"


def placeholder(category: str, value: str, salt: str) -> str:
    """The category and eight hex digits of the value's keyed hash, in which case and outer blanks don't matter."""
    return f"{category.upper()}_{hmac.new(salt.encode(), value.lower().strip().encode(), hashlib.sha256).hexdigest()[:8]}"


def rules(known_names: Sequence[str] = (), custom: Sequence[tuple[str, str]] = (), mode: str = "conservative", without: Sequence[str] = ()) -> list[tuple[str, re.Pattern]]:
    """Compiled rules in order: fixed ones, known names from the longest, the caller's own (category, pattern), and in conservative mode code and logs."""
    names = [("org", rf"\b{re.escape(n)}\b", re.I) for n in sorted((n for n in known_names if n.strip()), key=len, reverse=True)]
    last = [*CODE, *LOG] if mode == "conservative" else []
    wanted = [*PATTERNS, *names, *[(c, p, 0) for c, p in custom], *last]
    return [(c, re.compile(p, flags | re.A)) for c, p, flags in wanted if c not in without]


def redact(text: Column, salt: str, **options) -> Column:
    """A struct: the text with placeholders, each placeholder's count, and whether code or logs are left in it. A null text gives null.

    One value has one placeholder, that of the rule that met it first.
    """
    if not salt.strip():
        raise ValueError("a salt that isn't blank is needed")
    wanted = rules(**options)
    left = [[re.compile(p, flags | re.A) for _, p, flags in kind] for kind in (CODE, LOG)]

    def one(value: str) -> tuple:
        given: dict[str, str] = {}
        counts: dict[str, tuple[str, int]] = {}

        def replaced(category: str):
            def give(m: re.Match) -> str:
                name = given.setdefault(m[0].lower().strip(), placeholder(category, m[0], salt))
                counts[name] = (counts.get(name, (category, 0))[0], counts.get(name, (category, 0))[1] + 1)
                return name

            return give

        for category, pattern in wanted:
            value = pattern.sub(replaced(category), value)
        return value, [(c, name, n) for name, (c, n) in counts.items()], any(p.search(value) for p in left[0]), any(p.search(value) for p in left[1])

    @F.pandas_udf(RESULT)
    def run(values: pd.Series) -> pd.DataFrame:
        rows = [(None, None, None, None) if v is None else one(v) for v in values]
        return pd.DataFrame(rows, columns=["output", "redactions", "has_code", "has_logs"])

    return run(text)


def summary(redacted: Column) -> Column:
    """Counts by category of a ``redact`` struct, as a map."""
    categories = F.array_distinct(F.transform(redacted["redactions"], lambda r: r["category"]))
    return F.map_from_arrays(categories, F.transform(categories, lambda c: F.aggregate(F.filter(redacted["redactions"], lambda r: r["category"] == c), F.lit(0).cast("long"), lambda n, r: n + r["count"])))


def payload_hash(payload: Column, salt: str) -> Column:
    """Hex HMAC-SHA256 of a JSON text with its keys sorted at every depth and numbers as JavaScript writes them; of any other text as it is."""
    return hmac_sha256(canonical_text(payload), salt)
