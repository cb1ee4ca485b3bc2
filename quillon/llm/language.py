"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit a linear classifier over hashed three-byte
grams tells the languages with a one from those with a zero; its weights are log ratios of smoothed
gram frequencies, so training is one aggregation over all labelled texts. A text goes to the
codeword of least loss, each bit weighted by how well its classifier tells that language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
SMOOTHING = 0.5
#: Below this lead over the second language a prediction is flagged.
AMBIGUOUS = 0.2
_TO = bytes(32 if c < 128 and not chr(c).isalpha() else c for c in range(256))


def grams(text: str) -> np.ndarray:
    """Buckets of the three-byte grams of the lower-cased text; what isn't a letter counts as space."""
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_TO) + b" ", np.uint8).astype(np.uint32)
    x = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return (x * np.uint32(2654435761) >> np.uint32(17)).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """``n`` rows of +1 and -1: all splits in two for up to seven, else random rows far apart."""
    if n <= 7:
        cuts = np.arange(1, max(2, 1 << (n - 1)))
        return np.array([[1 if not i or not c >> (i - 1) & 1 else -1 for c in cuts] for i in range(n)])
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    tries = (rng.choice([-1, 1], (n, bits)) for _ in range(50))
    return max(tries, key=lambda m: int(((bits - m @ m.T) // 2 + bits * np.eye(n, dtype=int)).min()))


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    #: a row a bucket, a column a bit
    weights: np.ndarray
    #: a row a language, a column a bit: its classifier's usual margin, and its share in the loss
    usual: np.ndarray
    trust: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, confidence from 0 to 1, and whether the choice is ambiguous."""
        if not has_letter(text):
            return "und", 0.0, True
        if not self.languages:
            return "und", 0.0, True
        margin = self.weights[grams(text)].mean(0)
        z = self.code * margin / self.usual
        loss = (self.trust * np.log1p(np.exp(-4 * z))).sum(1)
        share = np.exp(4 * (loss.min() - loss))
        share /= share.sum()
        order = np.argsort(-share, kind="stable")
        lead = share[order[0]] - (share[order[1]] if len(order) > 1 else 0.0)
        return self.languages[order[0]], float(share[order[0]]), bool(lead < AMBIGUOUS)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """A model from all rows with a text and a language; the driver gets a count for each language and bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for b in batches:
            for language, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if has_letter(x := x.as_py()):
                    found.setdefault(language, np.zeros(BUCKETS, np.int64))
                    g = grams(x)
                    if len(g) > BUCKETS:
                        found[language] += np.bincount(g, minlength=BUCKETS)
                    else:
                        np.add.at(found[language], g, 1)
        for language, n in found.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(some), pa.string()), pa.array(some, pa.int64()), pa.array(n[some], pa.int64())], names=["lang", "bucket", "n"])

    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counted = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    found = {x: np.bincount(own["bucket"], own["n"], BUCKETS) for x, own in counted.groupby("lang")}
    languages = sorted(found)
    if not languages:
        none = np.zeros((0, 0))
        return LanguageModel([], none, none, none, none)
    share = np.array([(found[x] + SMOOTHING) / (found[x].sum() + SMOOTHING * BUCKETS) for x in languages])
    code = codewords(len(languages))
    weights = np.zeros((BUCKETS, code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        if (code[:, b] < 0).any():
            weights[:, b] = np.log(share[code[:, b] > 0].mean(0) / share[code[:, b] < 0].mean(0))
    usual = np.maximum(code * (share @ weights), 1e-6)
    return LanguageModel(languages, code, weights, usual, usual / usual.sum(1, keepdims=True))


def identify(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``key, <carry>, lang_pred, score, ambiguous``, a row a document.

    A null text or one without a letter is ``und`` with score 0, and so is every text if no
    labelled text was given. Ties go to the first language in order. Only the text is looked at;
    keys may be null or repeat; columns other than ``carry`` are dropped; an empty table stays empty.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shipped.value.predict(x.as_py()) for x in b.column(0)]
            cols = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.bool_())], names=[*b.schema.names[1:], "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col(text).alias("__text"), F.col(key).alias(key), *carry)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{kept}, lang_pred string, score double, ambiguous boolean")
