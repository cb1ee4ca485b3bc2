"""Collocations: phrases whose words stand together more often than their parts' counts let expect.

Texts become shards of word ids. A shard's suffixes are sorted by prefix doubling in numpy, and the
intervals of the suffix array whose neighbours share n words are its phrases of n words with their counts.
Counts of shards are merged by key. Rare phrases, which are most of all, never move as such: a shard tells
how often it has each pair of words, as 32 bits of their hash a part, and hears which may be frequent
everywhere; then the same for longer phrases all of whose pairs may be; and only what may be frequent goes
on to the exact count, with its words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle, spread

#: Words of a shard, and bytes of text that are cut into words at once.
SHARD_WORDS, SLICE = 1 << 20, 1 << 18
#: What ends a piece, and what parts words within one.
PIECE_ENDS, WORD_ENDS = b".,;:!?\n\x0b\x0c\r", (b" ", b"\t")
#: No byte of UTF-8; it stands for the end of a piece.
_END = b"\xff"
_TABLE = bytes(_END[0] if b in PIECE_ENDS else b + 32 if 65 <= b <= 90 else b for b in range(256))


class _Ids(dict):
    """Word to id; new words are numbered on, over all languages of a shard. Id 0 is the end of a piece."""

    def __init__(self, lang: str, words: list[bytes], langs: list[str]):
        super().__init__({_END: 0})
        self.lang, self.words, self.langs = lang, words, langs

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        self.langs.append(self.lang)
        return n


def _slices(data: bytes, size: int) -> Iterator[bytes]:
    """Parts of some ``size`` bytes that cut no word."""
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            cut = min((p for p in (data.find(c, end) for c in (*WORD_ENDS, _END)) if p >= 0), default=len(data))
            end = cut + 1
        yield data[at:end]
        at = end


class Shard:
    """Words of texts as ids; a phrase belongs to the shard in which it ends, so the first ``lead`` words are but context."""

    def __init__(self, lead: list[tuple[str, bytes]] = ()):
        self.words, self.langs, self.lead = [_END], [""], len(lead)
        self.of: dict[str, _Ids] = {}
        self.ids = [np.array([self.lang(name)[word] for name, word in lead], np.int32)]
        self.size = len(lead)

    def lang(self, name: str) -> _Ids:
        if name not in self.of:
            self.of[name] = _Ids(name, self.words, self.langs)
        return self.of[name]

    def add(self, name: str, part: bytes) -> None:
        found = part.replace(_END, b" \xff ").split()
        self.ids.append(np.fromiter(map(self.lang(name).__getitem__, found), np.int32, len(found)))
        self.size += len(found)

    def last(self, name: str, n: int) -> list[tuple[str, bytes]]:
        ids = np.concatenate(self.ids)
        return [(name, self.words[i]) for i in ids[max(0, len(ids) - n) :].tolist()]


def shards_of(docs: DataFrame, longest: int, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``shard, lead, ids, words, langs``: texts (columns lang, text) as word ids, a row for some ``shard_words`` words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task that runs again gives the same numbers
        number, now = TaskContext.get().partitionId() << 32, Shard()

        def close() -> pa.RecordBatch:
            row = [number, now.lead, np.concatenate(now.ids).tobytes(), b" ".join(now.words), now.langs]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.string())), strict=True)], names=["shard", "lead", "ids", "words", "langs"])

        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for part in _slices(text.as_py().translate(_TABLE), min(SLICE, 4 * shard_words)):
                    now.add(name, part)
                    if now.size >= shard_words:
                        yield close()
                        number, now = number + 1, Shard(now.last(name, longest - 1))
                now.add(name, _END)
        if now.size:
            yield close()

    return docs.select("lang", "text").mapInArrow(cut, "shard long, lead int, ids binary, words binary, langs array<string>")


def suffix_order(ids: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``ids`` in the order of the ``longest`` ids from there on, by prefix doubling, and how many each shares with the place before (at most ``longest``)."""
    n = len(ids)
    rank, h, ranks = ids.astype(np.int64), 1, {}
    order = np.argsort(rank) if longest == 1 else rank
    while True:
        ranks[h] = np.r_[rank, np.full(longest, -1)]  # past the end nothing is equal but itself
        if h >= longest:
            break
        pair = rank * (n + 2) + np.r_[rank[h:], np.full(min(h, n), -1)] + 1
        order = np.argsort(pair)  # equal ones in any order: they are one interval
        x = pair[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[False, x[1:] != x[:-1]][:n])
        h *= 2
    shared = np.zeros(max(n - 1, 0), np.int64)
    a, b = order[:-1], order[1:]
    for h in sorted(ranks, reverse=True):
        p, q = np.minimum(a + shared, n), np.minimum(b + shared, n)
        x, y = ranks[h][p], ranks[h][q]
        shared += h * ((x == y) & (x >= 0) & (shared < longest))
    return order, np.minimum(np.r_[0, shared][:n], longest)


def phrase_counts(ids: np.ndarray, order: np.ndarray, shared: np.ndarray, n: int, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each phrase of ``n`` ids (none of them 0) stands, and how often it ends at a place of ``lead`` or more."""
    size = len(ids)
    if size < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    whole = np.zeros(size, bool)
    whole[: size - n + 1] = np.all([ids[i : size - n + 1 + i] != 0 for i in range(n)], axis=0) & (np.arange(n - 1, size) >= lead)
    starts = np.flatnonzero(shared < n)  # an interval for each start
    count = np.add.reduceat(whole[order].astype(np.int64), starts)
    # of an interval's places any in full stands for all: the first may be cut off by the end of the shard
    first = np.minimum.reduceat(np.where(whole[order], order, size), starts)
    return first[count > 0], count[count > 0]


def _word_hashes(words: list[bytes], langs: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(lang.encode() + b" " + w) for w, lang in zip(words, langs, strict=True)], np.uint64)


def _keys(hashes: np.ndarray, ids: np.ndarray, at: np.ndarray, n: int, parts: int) -> np.ndarray:
    """A part of the counting and 32 bits within it, for each phrase of ``n`` words that starts at ``at``."""
    h = hashes[ids[at]]
    for i in range(1, n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + hashes[ids[at + i]]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(30)
    return (h >> np.uint64(32)) % np.uint64(parts) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)


def _read(ids, words, langs) -> tuple[np.ndarray, list[bytes], list[str]]:
    return np.frombuffer(ids.as_buffer(), np.int32), words.as_py().split(b" "), langs.as_py()


def _known(told) -> np.ndarray:
    """Keys that a shard was told, sorted, with one more that is none."""
    return np.sort(np.concatenate([np.full(1, 2**64 - 1, np.uint64), *[np.frombuffer(x.as_buffer(), np.uint64) for x in told.values or ()]]))


def _within(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return known[np.searchsorted(known, keys)] == keys


def frequent_keys(shards: DataFrame, sizes: Sequence[int], least: int, parts: int) -> DataFrame:
    """``shard, keys``: for each shard the keys (packed) of its phrases of ``sizes`` words that may occur ``least`` times in all shards.

    A shard tells how often it has each key, up to ``least``, and is told which are frequent: both
    grow with its own words only. Different phrases of one key count together, which is but too many.
    """
    counter = np.dtype(np.uint8 if least < 256 else np.uint32)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, lead, *rest in zip(*b.columns, strict=True):
                ids, words, langs = _read(*rest)
                order, shared = suffix_order(ids, max(sizes))
                hashes, found = _word_hashes(words, langs), []
                for size in sizes:
                    p, n = phrase_counts(ids, order, shared, size, lead.as_py())
                    found.append((_keys(hashes, ids, p, size, parts), n))
                keys, n = (np.concatenate(x) for x in zip(*found, strict=True))
                by = np.argsort(keys, kind="stable")
                keys, n = keys[by], n[by]
                new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
                keys, n = keys[new], np.minimum(np.add.reduceat(n, new), least) if len(new) else n
                part = (keys >> np.uint64(32)).astype(np.int64)
                cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(part)]).tolist()
                value, n = keys.astype(np.uint32), n.astype(counter)
                cells = [(value[i:j].tobytes(), n[i:j].tobytes()) for i, j in zip(cut, [*cut[1:], len(keys)], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[cut].astype(np.int32)), pa.array([shard.as_py()] * len(cut), pa.int64()), pa.array([x for x, _ in cells], pa.binary()), pa.array([x for _, x in cells], pa.binary())],
                    names=["part", "shard", "keys", "counts"],
                )

    def count(group: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x.as_buffer(), np.uint32) for x in group.column("keys")]
        counts = np.concatenate([np.frombuffer(x.as_buffer(), counter) for x in group.column("counts")])
        every = np.concatenate(keys)
        by = np.argsort(every, kind="stable")
        x = every[by]
        new = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
        frequent = np.r_[x[new][np.add.reduceat(counts[by].astype(np.int64), new) >= least].astype(np.uint64), np.uint64(2**64 - 1)]
        part = np.uint64(group.column("part")[0].as_py()) << np.uint64(32)
        told = [(k[_within(frequent, k.astype(np.uint64))].astype(np.uint64) | part).tobytes() for k in keys]
        return pa.table({"shard": group.column("shard"), "keys": pa.array(told, pa.binary())})

    told = shards.select("shard", "lead", "ids", "words", "langs").mapInArrow(tell, "part int, shard long, keys binary, counts binary").groupBy("part").applyInArrow(count, "shard long, keys binary")
    # a shard's own keys come back to it: no more than it has words
    return told.where(F.octet_length("keys") > 0).groupBy("shard").agg(F.collect_list("keys").alias("keys"))


def words_of_frequent_pairs(shards: DataFrame, pairs: DataFrame, parts: int) -> DataFrame:
    """The shards with only words of frequent pairs, and an end after each that the next doesn't go with; ``once``: how often each word was there (packed)."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, told, lead, *rest in zip(*b.columns, strict=True):
                ids, words, langs = _read(*rest)
                lead = lead.as_py()
                keys = _keys(_word_hashes(words, langs), ids, np.arange(max(len(ids) - 1, 0)), 2, parts)
                pair = _within(_known(told), keys) & (ids[:-1] != 0) & (ids[1:] != 0)
                goes_on, comes_in = np.r_[pair, False][: len(ids)], np.r_[False, pair][: len(ids)]
                kept = np.flatnonzero(goes_on | comes_in)
                ends = ~goes_on[kept]
                place = np.repeat(kept, 1 + ends)
                left = ids[place].copy()
                left[np.cumsum(1 + ends)[ends] - 1] = 0
                once = np.bincount(ids[lead:], minlength=len(words))
                row = (shard.as_py(), int((place < lead).sum()), left.tobytes(), rest[1].as_py(), langs, once.astype(np.int64).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.binary()), strict=True)], names=["shard", "lead", "ids", "words", "langs", "once"])

    told = shards.join(pairs.hint("merge"), "shard", "left").select("shard", "keys", "lead", "ids", "words", "langs")
    return told.mapInArrow(keep, "shard long, lead int, ids binary, words binary, langs array<string>, once binary")


def frequent_phrases(docs: DataFrame, least: int, longest: int, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``lang, n, phrase, f``: phrases of 1 to ``longest`` words that occur ``least`` times; with n = 0 and an empty phrase all words of the language."""
    whole = settle(shards_of(docs, longest, shard_words), "shards")
    parts = spread(whole.select("ids"), 8 << 20)
    shards = settle(words_of_frequent_pairs(whole, frequent_keys(whole, [2], least, parts), parts), "frequent-pairs")
    longer = list(range(3, longest + 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for told, lead, once, *rest in zip(*b.columns, strict=True):
                ids, words, langs = _read(*rest)
                once, known, hashes = np.frombuffer(once.as_buffer(), np.int64), _known(told), _word_hashes(words, langs)
                by_lang: dict[str, int] = defaultdict(int)
                for name, n in zip(langs[1:], once[1:].tolist(), strict=True):
                    by_lang[name] += n
                rows = [(name, 0, "", n) for name, n in by_lang.items() if n]
                rows += [(name, 1, w.decode("utf-8", "replace"), n) for name, w, n in zip(langs[1:], words[1:], once[1:].tolist(), strict=True) if n]
                order, shared = suffix_order(ids, longest)
                for n in range(2, longest + 1):
                    at, counts = phrase_counts(ids, order, shared, n, lead.as_py())
                    if n > 2:
                        may = _within(known, _keys(hashes, ids, at, n, parts))
                        at, counts = at[may], counts[may]
                    grams = ids[at[:, None] + np.arange(n)].tolist() if len(at) else []
                    rows += [(langs[g[0]], n, b" ".join([words[i] for i in g]).decode("utf-8", "replace"), c) for g, c in zip(grams, counts.tolist(), strict=True)]
                for i in range(0, len(rows), 20_000):
                    cols = list(zip(*rows[i : i + 20_000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], names=["lang", "n", "phrase", "f"])

    told = shards.join(frequent_keys(shards, longer, least, parts).hint("merge"), "shard", "left") if longer else shards.withColumn("keys", F.array().cast("array<binary>"))
    counted = told.select("keys", "lead", "once", "ids", "words", "langs").mapInArrow(count, "lang string, n int, phrase string, f long").groupBy("lang", "n", "phrase").agg(F.sum("f").alias("f"))
    return settle(counted.where((F.col("n") == 0) | (F.col("f") >= least)), "phrases")


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2000, covered: int = 80, lang: str = "lang", text: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases of 2 to ``longest`` words.

    Texts are put into lower case (A-Z), cut into pieces at ``PIECE_ENDS`` and those into words at
    ``WORD_ENDS``. All is per language; a null language is ``und``, a null or empty text has no words. ``n``:
    all words; ``a``: how often the phrase occurs within pieces, overlaps included, at least ``least``. Of the
    ways to cut it in two that counts which gives the lowest floor(2000000 a / (l + r)) (of equal ones the
    earliest), ``l`` and ``r`` being the counts of its parts. Phrases within a longer one (of at least ``least``)
    that occurs ``covered`` percent as often are left out. Order: score, then ``a``, both falling, then the
    phrase's bytes. Documents need no key, repeated rows count each, other columns are not read. A text may be
    of any length: it is spread over shards. A table without phrases gives an empty result.
    """
    given = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text"))
    counts = frequent_phrases(given.where("octet_length(text) > 0"), least, longest, shard_words)
    phrases = counts.where("n >= 2").select("lang", "phrase", F.col("f").alias("a"), F.col("n").alias("size"), F.split("phrase", " ").alias("words"))
    part = counts.where("n >= 1")
    cut = phrases.withColumn("k", F.expr("explode(sequence(1, size - 1))"))
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.expr("slice(words, 1, k)"), " ").alias("first"), F.array_join(F.expr("slice(words, k + 1, size - k)"), " ").alias("rest"))
    cut = cut.join(part.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(part.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    wide = "cast({} as decimal(20, 0))"
    score = F.expr(f"({wide.format('a')} * 2000000) div ({wide.format('l')} + {wide.format('r')})")
    best = cut.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    within = phrases.where("size > 2").select("lang", "a", F.expr("explode(flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> array_join(slice(words, i, m), ' ')))))").alias("phrase"))
    longer = within.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(f"longer is null or {wide.format('longer')} * 100 < {wide.format('a')} * {covered}")
    total = counts.where("n = 0").select("lang", F.col("f").alias("n"))
    rows = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # the first of each of some groups of a language, then the first of those: no task sorts a whole language
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
