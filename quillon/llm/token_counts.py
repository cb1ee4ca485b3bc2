"""How many pieces a unigram tokenizer gives, without giving them.

An Aho-Corasick automaton over the vocabulary names the pieces that end at each character; a
Viterbi pass carries, for each place, the best score and the number of pieces of its path. Ties go
as in the library's tokenizer: of equal scores the piece that starts first stays. A character that
is no piece itself may be unknown, at ten below the least score; unknown characters in a row are one piece.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks the start of a word in the vocabulary.
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
KEPT, LONGEST_KEPT = 400_000, 48
_LOADED: dict[int, PieceCounter] = {}


class PieceCounter(dict):
    """Pieces of a word, remembered for the first ``KEPT`` short words: the common ones are among them."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece not in self.automaton:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY

    def __missing__(self, word: str) -> int:
        n = self.count(word)
        if len(self) < KEPT and len(word) <= LONGEST_KEPT:
            self[word] = n
        return n

    def count(self, word: str) -> int:
        size = len(word) + 1
        best: list[float | None] = [0.0] + [None] * (size - 1)
        count, unknown, end, single = [0] * size, [False] * size, 1, False

        def close(e: int) -> None:
            """Nothing more ends at ``e``: the unknown character is the last candidate."""
            if not single and (best[e] is None or best[e - 1] + self.unknown > best[e]):
                best[e], count[e], unknown[e] = best[e - 1] + self.unknown, count[e - 1] + (not unknown[e - 1]), True

        for last, (length, score) in self.automaton.iter(word):
            while end <= last:
                close(end)
                end, single = end + 1, False
            start = last + 1 - length
            single = single or length == 1
            made = score + best[start]
            if best[end] is None or made > best[end]:
                best[end], count[end], unknown[end] = made, count[start] + 1, False
        while end < size:
            close(end)
            end, single = end + 1, False
        return count[-1]

    def of_text(self, text: str | None) -> int:
        if not text:
            return 0
        marked = text.replace(" ", "\0" + SPACE) if "\0" not in text and SPACE not in text else None
        if marked is not None:
            words = marked.split("\0")
            words[0] = SPACE + words[0] if text[0] != " " else words[0]
            return sum(map(self.__getitem__, words)) if words[0] else sum(map(self.__getitem__, words[1:]))
        marked = text.replace(" ", SPACE)
        head, *rest = (marked if marked[0] == SPACE else SPACE + marked).split(SPACE)
        return sum(self[SPACE + w] for w in rest) if not head else 0


def _counter(vocabulary: list[tuple[str, float]]) -> PieceCounter:
    """One a worker process."""
    which = hash(tuple(vocabulary))
    if which not in _LOADED:
        _LOADED[which] = PieceCounter(vocabulary)
    return _LOADED[which]


def zipf_vocabulary(model_file: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a sentencepiece file with scores of a unigram law: the log of 1 / (rank + 10)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    pieces = [p for p in map(model.id_to_piece, ids) if SPACE not in p[1:]]
    return [(p, -math.log(rank + 10)) for rank, p in enumerate(pieces)]


def count_pieces(docs: DataFrame, vocabulary: list[tuple[str, float]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens``, a row a document.

    Words are what lies between spaces, each with a mark before it, and are tokenized by
    themselves; other white space is text. Null and empty texts have no pieces. Keys may be null
    or repeat; other columns are not read; an empty table gives an empty result.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shipped.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([counter.of_text(x.as_py()) for x in b.column(1)], pa.int64())], names=[key, "n_tokens"])

    rows = docs.select(F.col(key).alias(key), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, n_tokens long")
