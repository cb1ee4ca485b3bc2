"""Quality and toxicity without labels: overlapping heuristics, EM, and a hashed linear scorer.

Labellers vote good, bad or nothing. Expectation-maximisation over the counts of all vote patterns
of the corpus estimates how often each labeller votes what on good and on bad documents, and with
that the posterior of each pattern. The posteriors of a bounded sample train a logistic scorer over
hashed words and votes, which then scores every whole text. There are two targets: prose against
junk, and abuse.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

BUCKETS = 1 << 18
#: About so many documents at most train the scorer (drawn by a hash of the text, or all if there are fewer).
SAMPLE_DOCS = 8192
LABELLED_DOCS = 16_384
#: Marks of abuse that are kept, the most frequent first.
MOST_MARKS = 10_000
#: The share of a mark's documents that are labelled, at least.
PURE = 0.95
#: Marks that a task counts before it sends them on.
FLUSH = 100_000
GOOD, NONE, BAD = 0, 1, 2

# Common words of four languages, insults, and signs that prose seldom has.
COMMON = frozenset(
    "the of and to in is that it was for on are as with his they at be this have from or by not but what all were we when your can said there an "
    "der die das und ist von den mit sich des auf für nicht ein eine als auch dem zu im es "
    "le la les de des et est un une que qui dans en du pour pas au sur ne se ce par "
    "el los las del y en por con para una su al lo como más pero sus se no".split()
)
CORE_INSULTS = frozenset("idiot idiots moron morons stupid loser losers scum pathetic worthless disgusting".split())
OTHER_INSULTS = frozenset("trash garbage clown clowns dumb fool fools imbecile jerk filth vermin creep degenerate retard bastard bitch whore slut cretin".split())
INSULTS = CORE_INSULTS | OTHER_INSULTS
SECOND_PERSON = frozenset("you your yours yourself you're du dich dir dein deine tu te toi ton ta vous votre usted ustedes ti tú".split())
SIGNS = "#$%&*@^~|<>{}=\\"
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_EDGES = bytes(32 if chr(c) in ".,!?;:\"'()[]" + SIGNS else c for c in range(256))


def _vote(value: float, good: float, bad: float) -> int:
    """Bad beyond ``bad``, good up to ``good``; the two may lie in either order."""
    if good < bad:
        return BAD if value > bad else GOOD if value <= good else NONE
    return BAD if value < bad else GOOD if value >= good else NONE


def marks_of(words: set[str]) -> set[str]:
    """The words, and their beginnings of three to eight characters with a sign for how many words have them: - one, = two, # four at least."""
    begun = Counter(w[:k] for w in words for k in range(3, min(8, len(w)) + 1))
    return words | {b + "-" for b in begun} | {b + sign for b, n in begun.items() for sign, least in (("=", 2), ("#", 4)) if n >= least}


def words_in(text: str) -> list[str]:
    """Words in lower case without signs at their edges."""
    return text.lower().encode("utf-8", "replace").translate(_EDGES).decode().split()


@lru_cache(8)
def _heads(learned: frozenset[str]) -> frozenset[str]:
    """The first three characters of the beginnings among ``learned``: few words need a closer look."""
    return frozenset(m[:3] for m in learned if m[-1] in "-=#")


def votes_of(text: str | None, learned: frozenset[str] = frozenset()) -> tuple[tuple[int, ...], tuple[int, ...], list[str]]:
    """Votes on prose, votes on abuse, and the words.

    ``learned``: words and beginnings of words that mark abuse, besides the fixed list.
    """
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = words_in(text)
    n = len(words)
    if not n:
        return (BAD,) * PROSE, (NONE,) * ABUSE, words
    letters = len(raw) - len(raw.translate(None, _LETTERS))
    upper = len(raw) - len(raw.translate(None, _UPPER))
    lines = [x for x in text.split("\n") if x]
    different = set(words)
    prose = (
        _vote(sum(map(text.count, SIGNS)) / n, 0.05, 0.2),
        _vote(upper / max(letters, 1), 0.2, 0.5) if letters > 20 else NONE,
        _vote(text.count("!") / n, 0.05, 0.3),
        _vote(sum(map(COMMON.__contains__, words)) / n, 0.05, 0.02) if n >= 30 else NONE,
        _vote(len(different) / n, 0.2, 0.12) if n >= 20 else NONE,
        _vote(sum(map(eq, words, words[1:])) / n, 0.1, 0.3) if n >= 5 else NONE,
        _vote(len(set(zip(words, words[1:], strict=False))) / n, 0.5, 0.3) if n >= 20 else NONE,
        _vote(len(raw) / n, 9, 13),
        _vote(n / len(text.split()), 0.9, 0.75),
        _vote(len(set(lines)) / len(lines), 0.7, 0.4) if len(lines) >= 5 else NONE,
        _vote(letters / max(len(raw), 1), 0.7, 0.6) if n >= 5 else NONE,
    )
    core = CORE_INSULTS.intersection(different)
    other = OTHER_INSULTS.intersection(different)
    named = learned.intersection(different)
    heads = _heads(learned)
    near = {w for w in different if w[:3] in heads} if learned else set()
    begun = near and not learned.isdisjoint(marks_of(near) - near)
    spoken = sum(map(SECOND_PERSON.__contains__, words)) / n
    # fixed lists, what labels teach in two ways, and how it speaks; each votes either way, as a labeller
    # that only ever votes bad says nothing
    abuse = (
        BAD if core else GOOD,
        BAD if other else GOOD,
        (BAD if named else GOOD) if learned else NONE,
        (BAD if begun else GOOD) if learned else NONE,
        _vote(spoken, 0.01, 0.05),
    )
    return prose, abuse, words


PROSE, ABUSE = 11, 5


def expect_maximise(patterns: Counter, rounds: int = 200) -> dict[tuple[int, ...], float]:
    """The posterior of bad for each vote pattern, from their counts.

    A labeller that doesn't vote says nothing. The start is the share of bad among the votes cast.
    """
    if not patterns:
        return {}
    rows = sorted(patterns)
    votes, n = np.array(rows), np.array([patterns[r] for r in rows], float)
    is_bad, is_good = (votes == BAD).astype(float), (votes == GOOD).astype(float)
    posterior = np.clip(is_bad.sum(1) / np.maximum(is_bad.sum(1) + is_good.sum(1), 1) * 2, 0.02, 0.98)
    for _ in range(rounds):
        weight = np.stack([(1 - posterior) * n, posterior * n])
        prior = (weight.sum(1) + 1) / (n.sum() + 2)
        # the share of bad votes of each labeller on good and on bad documents
        rate = (weight @ is_bad + [[0.1], [0.9]]) / (weight @ (is_bad + is_good) + 1)
        log = np.log(prior)[:, None] + np.log(rate) @ is_bad.T + np.log(1 - rate) @ is_good.T
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -60, 60)))
        done = np.abs(new - posterior).max() < 1e-9
        posterior = new
        if done:
            break
    return dict(zip(rows, posterior.tolist(), strict=True))


def features(prose: tuple, abuse: tuple, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values: the votes at 1, the different words at one over the root of their number."""
    marks = [f"prose {j} {v}".encode() for j, v in enumerate(prose)] + [f"abuse {j} {v}".encode() for j, v in enumerate(abuse)]
    different = sorted(set(words))
    at = np.array([zlib.crc32(x) for x in marks] + [zlib.crc32(w.encode("utf-8", "replace")) for w in different], np.int64) % BUCKETS
    value = np.full(len(at), 1 / np.sqrt(max(len(different), 1)), np.float32)
    value[: len(marks)] = 1
    return at, value


def fit(sample: list[tuple[np.ndarray, np.ndarray, float]], rounds: int = 8, rate: float = 0.3, decay: float = 1e-4) -> np.ndarray:
    """Logistic weights, a bias last, by Adagrad over the sample in its order."""
    weights, seen = np.zeros(BUCKETS + 1, np.float32), np.full(BUCKETS + 1, 1e-6, np.float32)
    for _ in range(rounds):
        for at, value, target in sample:
            z = float(weights[at] @ value) + float(weights[-1])
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
            grad = error * value + decay * weights[at]
            seen[at] += grad * grad
            weights[at] -= rate * grad / np.sqrt(seen[at])
            seen[-1] += error * error
            weights[-1] -= rate * error / np.sqrt(seen[-1])
    return weights


@dataclass(frozen=True)
class QualityModel:
    learned: frozenset
    prose: dict
    abuse: dict
    prose_weights: np.ndarray
    abuse_weights: np.ndarray


def _score(weights: np.ndarray, at: np.ndarray, value: np.ndarray) -> float:
    return float(1 / (1 + np.exp(-np.clip(float(weights[at] @ value) + float(weights[-1]), -30, 30))))


def learn_abuse(docs: DataFrame, labels: DataFrame, labelled_docs: int = LABELLED_DOCS, key: str = "doc_id", text: str = "text", label: str = "toxic") -> frozenset[str]:
    """Words and beginnings of words that hardly any documents but those labelled 1 have.

    From about ``labelled_docs`` labelled documents, drawn by a hash of the key. Of the documents with a mark ``PURE`` at
    least have the label, and so many that chance would hardly give one such mark in all.
    """
    labels = labels.where(F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias("label"))
    known = max(labels.count(), 1)
    drawn = labels.where(F.pmod(F.xxhash64(F.lit("labelled"), F.col(key)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, labelled_docs / known)))
    size = {r["label"]: r["count"] for r in drawn.groupBy((F.col("label") > 0).alias("label")).count().collect()}
    bad, good = size.get(True, 0), size.get(False, 0)
    if not bad or not good:
        return frozenset()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            marks = list(found[0].keys() | found[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(marks, pa.string()), *[pa.array([c[m] for m in marks], pa.int64()) for c in found]], names=["mark", "good", "bad"])
            found[0].clear()
            found[1].clear()
            return out

        for b in batches:
            for is_bad, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found[is_bad].update(marks_of({w for w in words_in(x.as_py() or "") if w.isalpha()}))
                if len(found[0]) + len(found[1]) > FLUSH:
                    yield flush()
        yield flush()

    # the drawn keys are about ``labelled_docs``, whatever the size of the corpus
    rows = docs.select(key, F.col(text).alias("text")).join(F.broadcast(drawn), key).select((F.col("label") > 0).cast("int").alias("label"), "text")
    counted = rows.mapInArrow(count, "mark string, good long, bad long").groupBy("mark").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    base, n = bad / (bad + good), F.col("bad") + F.col("good")
    share = F.col("bad") / n
    # the log of how much likelier the share is than the base rate
    told = F.col("bad") * F.log(share / base) + F.when(F.col("good") > 0, F.col("good") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    marks = counted.where((share >= PURE) & (told >= math.log(1e6)))
    return frozenset(r["mark"] for r in marks.orderBy(F.desc("bad"), "mark").limit(MOST_MARKS).collect())


def train(docs: DataFrame, labels: DataFrame | None = None, sample_docs: int = SAMPLE_DOCS, key: str = "doc_id", text: str = "text") -> QualityModel:
    """Vote patterns of all documents, then a scorer from about ``sample_docs`` of their different texts at most.

    ``labels(key, toxic)`` teaches one labeller the corpus's own words of abuse. The driver gets
    the patterns, at most 3 ** 11 and 3 ** 5, and the hashed words of the sample.
    """
    learned = learn_abuse(docs, labels, key=key, text=text) if labels is not None else frozenset()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in batches:
            for x in b.column(0):
                prose, abuse, _ = votes_of(x.as_py(), learned)
                found[0, prose] += 1
                found[1, abuse] += 1
        rows = list(found.items())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.int32()), pa.array(["".join(map(str, k[1])) for k, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["target", "votes", "n"])

    counted = docs.select(text).mapInArrow(count, "target int, votes string, n long").groupBy("target", "votes").agg(F.sum("n").alias("n")).collect()
    patterns = (Counter(), Counter())
    for r in counted:
        patterns[r["target"]][tuple(map(int, r["votes"]))] = r["n"]
    prose, abuse = map(expect_maximise, patterns)

    total = sum(patterns[0].values())
    # by the text, and of equal texts one: neither a hot key nor a hot text comes to the driver many times
    drawn = F.pmod(F.xxhash64(F.lit("sample"), F.coalesce(F.col(text), F.lit(""))), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample_docs / max(total, 1)))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                p, a, words = votes_of(x.as_py(), learned)
                rows.append((k, features(p, a, words)[0].astype("<i4").tobytes(), prose.get(p, 0.5), abuse.get(a, 0.5)))
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64())], names=["order", "at", "prose", "abuse"])

    rows = docs.where(drawn).select(F.xxhash64(F.lit("order"), F.coalesce(F.col(text), F.lit(""))).alias("order"), F.col(text).alias("text")).dropDuplicates(["order"]).mapInArrow(hashed, "order long, at binary, prose double, abuse double").collect()
    rows.sort(key=lambda r: (r["order"], bytes(r["at"])))
    marks = PROSE + ABUSE
    sample = []
    for r in rows:
        at = np.frombuffer(bytes(r["at"]), "<i4").astype(np.int64)
        value = np.full(len(at), 1 / np.sqrt(max(len(at) - marks, 1)), np.float32)
        value[:marks] = 1
        sample.append((at, value, r["prose"], r["abuse"]))
    return QualityModel(learned, prose, abuse, fit([(a, v, p) for a, v, p, _ in sample]), fit([(a, v, t) for a, v, _, t in sample]))


def score(docs: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text", carry_row: bool = False) -> DataFrame:
    """``key, quality, toxicity, posterior_quality, posterior_toxicity, keep``, a row a document.

    With ``carry_row`` all columns of ``docs`` come along as a struct ``row``.

    ``keep``: the scorer finds it more likely prose than junk and less likely abuse than not. A null or empty text
    has the votes of junk and goes. Keys may be null or repeat; other columns are not read; an
    empty table gives an empty result.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for b in batches:
            out = []
            for x in b.column(1):
                p, a, words = votes_of(x.as_py(), m.learned)
                at, value = features(p, a, words)
                junk, toxic = _score(m.prose_weights, at, value), _score(m.abuse_weights, at, value)
                out.append((1 - junk, toxic, 1 - m.prose.get(p, 0.5), m.abuse.get(a, 0.5), junk < 0.5 and toxic < 0.5 and bool(words)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.float64()) for c in cols[:4]], pa.array(cols[4], pa.bool_()), *b.columns[2:]], names=[key, "quality", "toxicity", "posterior_quality", "posterior_toxicity", "keep", *b.schema.names[2:]])

    rows = docs.select(F.col(key).alias(key), F.col(text).alias("text"), *[F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row") for _ in range(carry_row)])
    made = StructType([rows.schema[0], *[StructField(c, DoubleType()) for c in ("quality", "toxicity", "posterior_quality", "posterior_toxicity")], StructField("keep", BooleanType()), *rows.schema.fields[2:]])
    return rows.mapInArrow(run, made)
