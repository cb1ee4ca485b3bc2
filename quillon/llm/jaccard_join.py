"""Documents whose sets of shingles are alike, by a join on parity sketches.

Each shingle flips one bit of a sketch, so two sketches differ in no more bits than their sets have
members that are not in both. Sizes are dealt into bands; for the similar pairs of a band, sketches have
one word of 64 bits more than members can differ, so at least one word is equal (pigeonhole): an equality
join on (band, place, word) misses no similar pair. Pairs that their sizes or whole sketches prove
to be unlike go, the rest are compared set by set.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import settle, spread
from .simhash import _batch, shingle_hashes, spanning_forest, words_of

#: Sizes of a band differ by this factor at most, or by what similar sets differ in if that is more.
BAND = 1.5
WORD = 64
#: Words of the folded sketch that goes along with each signature.
FOLD = 8


def most_apart(total, percent: int):
    """So many members at most are not in both of two similar sets that have ``total`` members together."""
    return total - 2 * (-(-percent * total // (100 + percent)))


class Bands:
    """Bands of set sizes; scheme b serves pairs whose smaller set is in band b."""

    def __init__(self, percent: int):
        self.percent = percent
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 1, int(edges[-1] * max(BAND, 100 / percent))))
        self.edges = np.array(edges)

    def of(self, size):
        return np.searchsorted(self.edges, size, "right") - 1

    def schemes(self, size: int) -> list[int]:
        """The band of the size, and the one below if that holds sizes of similar sets."""
        band = int(self.of(size))
        below = int(self.edges[band]) - 1
        return [band, band - 1] if band and self.percent * size <= 100 * below else [band]

    def words(self, scheme: int) -> int:
        """One more than the members in which similar sets of the scheme can differ."""
        least = int(self.edges[scheme + 1]) - 1
        total = least + 100 * least // self.percent
        return total * (100 - self.percent) // (100 + self.percent) + 1


def parity_words(shingles: np.ndarray, words: int) -> np.ndarray:
    """``words`` words of 64 bits; a bit is set if an odd number of the (different) shingles falls to it."""
    bit = ((shingles >> np.uint64(32)) % np.uint64(words)).astype(np.int64) * WORD + (shingles & np.uint64(WORD - 1)).astype(np.int64)
    return np.packbits(np.bincount(bit, minlength=words * WORD) & 1 == 1, bitorder="little").view("<u8")


def signatures(words: np.ndarray, scheme: int) -> np.ndarray:
    """A number for each word that tells scheme, place and word."""
    place = np.arange(len(words), dtype=np.uint64) + np.uint64(scheme << 40)
    x = words * np.uint64(0x9E3779B97F4A7C15) + place * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def may_be_similar(size_a: int, size_b: int, a: tuple, b: tuple, bands: Bands) -> bool:
    """Do sizes and sketches (of the own band and of the band below, as bytes) allow that the sets are similar?"""
    if size_a > size_b:
        size_a, size_b, a, b = size_b, size_a, b, a
    if 100 * size_a < bands.percent * size_b:
        return False
    one, other = a[0], b[0] if bands.of(size_a) == bands.of(size_b) else b[1]
    apart = int(np.bitwise_count(np.frombuffer(one, "<u8") ^ np.frombuffer(other, "<u8")).sum(dtype=np.int64))
    return apart <= most_apart(size_a + size_b, bands.percent)


def folded(words: np.ndarray) -> bytes:
    """The sketch whose bit is the parity of all bits ``FOLD`` words apart: it differs in no more bits than the sketch does."""
    full = np.zeros(-(-len(words) // FOLD) * FOLD, np.uint64)
    full[: len(words)] = words
    return np.bitwise_xor.reduce(full.reshape(-1, FOLD), axis=0).astype("<u8").tobytes()


class Near:
    """Do sizes and folded sketches allow that rows (signature, node, size, ..., folded sketch) are similar?"""

    def __init__(self, rows: np.ndarray, percent: int):
        self.sizes, self.sketch, self.percent, self.size = rows[:, 2], np.ascontiguousarray(rows[:, -FOLD:]).view(np.uint64), percent, len(rows)

    def __call__(self, i, rest: np.ndarray) -> np.ndarray:
        a, b = self.sizes[i], self.sizes[rest]
        may = 100 * np.minimum(a, b) >= self.percent * np.maximum(a, b)
        apart = np.bitwise_count(self.sketch[i] ^ self.sketch[rest]).sum(1, dtype=np.int64)
        return may & (apart <= most_apart(a + b, self.percent))


def _runs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of the first column start, and their sizes."""
    starts = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
    return starts, np.diff(np.r_[starts, len(rows)])


def forest_of_runs(rows: np.ndarray, percent: int) -> np.ndarray:
    """Pairs ``a < b`` of nodes that hang each run together as far as ``Near`` does: a run of n nodes gives n - 1 at most."""
    # one order for all runs, so that the nodes of several shared runs hang on the same ones
    rows = rows[np.lexsort((rows[:, 1].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15), rows[:, 0]))]
    starts, sizes = _runs(rows)
    near, out = Near(rows, percent), []
    two = starts[sizes == 2]
    out.append(np.column_stack([two, two + 1])[near(two, two + 1)])
    for at, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        out.append(np.array(spanning_forest(Near(rows[at : at + n], percent)), np.int64).reshape(-1, 2) + at)
    pairs = np.concatenate(out)
    return np.unique(np.sort(np.column_stack([rows[pairs[:, 0], 1], rows[pairs[:, 1], 1]]), axis=1), axis=0)


def crossing_pairs(rows: np.ndarray, percent: int) -> Iterator[np.ndarray]:
    """Pairs ``a < b`` of each run that ``Near`` allows and whose components (the fourth column) differ, in parts."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    starts, sizes = _runs(rows)
    mixed = np.minimum.reduceat(rows[:, 3], starts) != np.maximum.reduceat(rows[:, 3], starts)
    rows = rows[np.repeat(mixed, sizes)]
    near, at, step, held, n = Near(rows, percent), np.arange(len(rows)), 0, [], 0
    while len(at):
        step += 1
        at = at[at + step < len(rows)]
        other = at + step
        # by size within a run: beyond the first that is too large all are
        at = at[(rows[at, 0] == rows[other, 0]) & (100 * rows[at, 2] >= percent * rows[other, 2])]
        a = at[rows[at, 3] != rows[at + step, 3]]
        a = a[near(a, a + step)]
        held.append(np.sort(np.column_stack([rows[a, 1], rows[a + step, 1]]), axis=1))
        n += len(a)
        if n > 500_000:
            yield np.unique(np.concatenate(held), axis=0)
            held, n = [], 0
    if n:
        yield np.unique(np.concatenate(held), axis=0)


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Rows of long columns and, last, of folded sketches if there are any, in whole runs of the first column; the batches come sorted by it."""
    held: list[np.ndarray] = []
    for b in batches:
        rows = np.column_stack([np.frombuffer(b"".join(c.to_pylist()), "<i8").reshape(-1, FOLD) if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False) for c in b.columns])
        if not len(rows):
            continue
        cut = int(np.searchsorted(rows[:, 0], rows[-1, 0]))  # the last run may go on
        if cut:
            yield np.concatenate([*held, rows[:cut]])
            held = []
        held.append(rows[cut:])
    if held:
        yield np.concatenate(held)


def jaccard_groups(docs: DataFrame, shingle: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_shingles, component``, a row a document: groups of documents whose sets of shingles are alike.

    A document's set are its different runs of ``shingle`` words, A-Z in lower case; of fewer words all
    of them as one; without words or text it is empty. Two documents are linked if 100 times what both have is
    at least ``percent`` times what either has; an empty set is linked with nothing. Shingles are known
    by their 64-bit hash. ``component`` is the least key of all that a document reaches, itself included;
    null keys are passed over, and it is null if there is no other. Repeated rows stay, other columns
    are not read, an empty table gives an empty result.

    Equal sets are one node. Nodes that share a signature meet in sorted runs, twice, with folded sketches
    that tell most unlike ones apart: first only as many pairs as hang a run together, so that a group of n copies
    gives some n pairs and not all; then all whose components still differ. What is compared in a run grows with
    the square of its nodes that are not one component, in numpy; what leaves it are pairs that sketches allow.
    """
    bands = Bands(percent)
    worded = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    digest = F.md5(F.coalesce("text", F.lit(""))).alias("digest")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 128):
                b = big.slice(at, 128)
                sizes, marks, sketches, folds = [], [], ([], []), ([], [])
                for x in b.column(1):
                    shingles = np.unique(shingle_hashes(words_of(x.as_py()), shingle))
                    sizes.append(len(shingles))
                    marks.append(md5(shingles.tobytes()).digest())
                    made = [parity_words(shingles, bands.words(s)) for s in bands.schemes(len(shingles))] if len(shingles) else []
                    for i in (0, 1):
                        sketches[i].append(made[i].tobytes() if i < len(made) else None)
                        folds[i].append(folded(made[i]) if i < len(made) else None)
                mark = np.frombuffer(b"".join(marks), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(2), pa.array(sizes, pa.int64()), *[pa.array(np.ascontiguousarray(mark[:, i])) for i in (0, 1)], *[pa.array(x, pa.binary()) for x in (*sketches, *folds)]],
                    names=["key", "digest", "size", "set0", "set1", "own", "below", "own_fold", "below_fold"],
                )

    kind = worded.schema["key"].dataType.simpleString()
    rows = settle(worded.select("key", "text", digest).mapInArrow(describe, f"key {kind}, digest string, size long, set0 long, set1 long, own binary, below binary, own_fold binary, below_fold binary"), "sets-of-rows")
    made = rows.where("size > 0").groupBy("set0", "set1").agg(F.min("key").alias("least"), F.min(F.struct("digest", "size", "own", "below", "own_fold", "below_fold")).alias("x"))
    nodes = settle(made.select("set0", "set1", "least", "x.*").withColumn("node", F.monotonically_increasing_id()), "nodes")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A signature for each word; the node is doubled, plus one if the word is of the band below."""
        for big in batches:
            for at in range(0, big.num_rows, 256):
                b, sigs, nodes_of = big.slice(at, 256), [], []
                for node, size, own, below in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    for i, (scheme, words) in enumerate(zip(bands.schemes(size), (own, below), strict=False)):
                        sigs.append(signatures(np.frombuffer(words, "<u8"), scheme))
                        nodes_of.append(np.full(len(sigs[-1]), 2 * node + i))
                yield _batch(["sig", "node"], np.column_stack([np.concatenate(sigs).view(np.int64), np.concatenate(nodes_of)]))

    def shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _whole_runs(batches):
            new = np.r_[True, x[1:, 0] != x[:-1, 0]]
            yield _batch(["sig", "node"], x[~(new & np.r_[new[1:], True])])

    def hang_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _whole_runs(batches):
            yield _batch(["a", "b"], forest_of_runs(x, percent))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _whole_runs(batches):
            for pairs in crossing_pairs(x, percent):
                yield _batch(["a", "b"], pairs)

    def by_signature(df: DataFrame) -> DataFrame:
        return df.repartition(parts, "sig").sortWithinPartitions("sig")

    sketches = nodes.select("node", "size", "own", "below")
    parts = spread(sketches, 4 << 20)
    met = by_signature(sketches.mapInArrow(deal, "sig long, node long")).mapInArrow(shared_only, "sig long, node long")
    folds = nodes.select("node", "size", "own_fold", "below_fold").hint("merge")
    shared = settle(met.select("sig", F.expr("node & 1").alias("band"), F.expr("node >> 1").alias("node")).join(folds, "node").select("sig", "node", "size", F.when(F.col("band") == 0, F.col("own_fold")).otherwise(F.col("below_fold")).alias("fold")), "shared")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            may = [may_be_similar(m, n, (x, y), (v, w), bands) for m, x, y, n, v, w in zip(*(c.to_pylist() for c in b.columns[2:]), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(may, pa.bool_()))

    def candidates(pairs: DataFrame) -> DataFrame:
        a, b = (sketches.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("size", "own", "below")]).hint("merge") for x in ("a", "b"))
        met = pairs.distinct().join(a, "a").join(b, "b").where(f"100 * least(size_a, size_b) >= {percent} * greatest(size_a, size_b)")
        return settle(met.select("a", "b", "size_a", "own_a", "below_a", "size_b", "own_b", "below_b").mapInArrow(alike, "a long, b long"), "pairs")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 128):
                b = big.slice(at, 128)
                sets = [np.unique(shingle_hashes(words_of(x.as_py()), shingle)).tobytes() for x in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()

    # candidates grow with the corpus: the same joins at every size
    def sets_of(wanted: DataFrame) -> DataFrame:
        of_text = nodes.select("node", "digest").join(wanted.hint("merge"), "node", "left_semi")
        some = worded.select("text", digest).join(of_text.hint("merge"), "digest").dropDuplicates(["node"])
        return settle(some.select("node", "text").mapInArrow(shingled, "node long, shingles binary"), "sets")

    def links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        a, b = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"of_{x}")).hint("merge") for x in ("a", "b"))
        return pairs.join(a, "a").join(b, "b").select("a", "b", "of_a", "of_b").mapInArrow(verify, "a long, b long")

    near = candidates(by_signature(shared).mapInArrow(hang_together, "a long, b long"))
    sets = sets_of(ends(near))
    component = connected_components(links(near, sets))
    known = nodes.select("node").join(component.hint("merge"), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    placed = shared.join(known.hint("merge"), "node").select("sig", "node", "size", "root", "fold")
    rest = candidates(by_signature(placed).mapInArrow(others, "a long, b long"))
    new = ends(rest).join(sets.select("node").hint("merge"), "node", "left_anti")
    more = links(rest, sets.union(sets_of(new)))
    component = connected_components(more.union(component.select("node", "root")))

    member = nodes.select("set0", "set1", "node", "least").join(component.hint("merge"), "node", "left").select("set0", "set1", "least", F.coalesce("root", "node").alias("root"))
    head = member.groupBy("root").agg(F.min("least").alias("component"))
    named = member.join(head.hint("merge"), "root").select("set0", "set1", "component")
    found = rows.select("key", "size", "set0", "set1").join(named.hint("merge"), ["set0", "set1"], "left")
    return found.select("key", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("key")).alias("component"))
