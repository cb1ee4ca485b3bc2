"""SimHash fingerprints, links between near fingerprints, and near-duplicate groups of texts.

Fingerprints are linked by deletion-variant signatures: bits are cut into ``radius // 2 + 1``
segments, so of two fingerprints within ``radius`` one segment differs in at most one bit. Each
segment is indexed once for each of its bits with that bit left out; equal signatures meet in one
sorted run, and every link is verified over all bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import settle, spread

SEED = 42
_XXH64 = partial(xxhash.xxh64_intdigest, seed=SEED)


def words_of(text: str | None) -> list[bytes]:
    """Words of the text with A-Z in lower case; ``bytes.split`` cuts at space and 0x09-0x0D."""
    return (text or "").encode().lower().split()


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """XXH64 of each run of ``n`` words, repeats included; of all words if there are fewer; none of none."""
    if len(words) < n:
        return np.array([_XXH64(b" ".join(words))] if words else [], np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))
    return np.fromiter(map(_XXH64, runs), np.uint64, len(words) - n + 1)


def majority_bits(digests: np.ndarray) -> bytes:
    """A bit is set if it is in over half of the rows of ``digests`` (bytes, least bit first)."""
    width = digests.shape[1]
    total = np.zeros(8 * width, np.int64)
    for at in range(0, len(digests), 65536):
        total += np.unpackbits(digests[at : at + 65536], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * total > len(digests), bitorder="little").tobytes()


def shingle_fingerprint(text: str | None, n: int = 3) -> bytes:
    """64 bits over all shingles of ``n`` words."""
    return majority_bits(shingle_hashes(words_of(text), n).view(np.uint8).reshape(-1, 8))


def word_fingerprint(words: list[bytes]) -> bytes:
    """64 bits over the distinct words: a changed word moves few of them, whatever its place."""
    different = set(words)
    return majority_bits(np.fromiter(map(_XXH64, different), np.uint64, len(different)).view(np.uint8).reshape(-1, 8))


def fingerprints(docs: DataFrame, make, bits: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, digest, fp0[, fp1]``: the text's MD5 (of a null text: of no bytes) and the fingerprint's words of 64 bits."""
    names = [f"fp{i}" for i in range(bits // 64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = b"".join(make(x.as_py()) for x in b.column(1))
            cells = np.frombuffer(made, "<i8").reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *[pa.array(np.ascontiguousarray(cells[:, i])) for i in range(len(names))]], names=["key", "digest", *names])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("digest"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, digest string, {', '.join(f'{n} long' for n in names)}")


def spanning_forest(near) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a graph on ``near.size`` nodes; ``near(i, rest)`` tells which of ``rest`` touch ``i``."""
    rest, out = np.arange(near.size), []
    while len(rest):
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            i = front.pop()
            hit = near(i, rest)
            for j in rest[hit].tolist():
                out.append((i, j))
                front.append(j)
            rest = rest[~hit]
    return out


class _Hamming:
    def __init__(self, fps: np.ndarray, radius: int):
        self.fps, self.radius, self.size = fps, radius, len(fps)

    def __call__(self, i: int, rest: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.fps[rest] ^ self.fps[i]).sum(1, dtype=np.int64) <= self.radius


def _segments(bits: int, radius: int) -> list[tuple[int, int]]:
    n = radius // 2 + 1
    cuts = [bits * i // n for i in range(n + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def _field(fps: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Bits ``lo`` to ``hi`` (at most 64) of rows of 64-bit words."""
    word, shift, width = lo // 64, lo % 64, hi - lo
    out = fps[:, word] >> np.uint64(shift)
    if shift + width > 64:
        out = out | fps[:, word + 1] << np.uint64(64 - shift)
    return out & np.uint64((1 << width) - 1) if width < 64 else out


def near_links(fps: DataFrame, bits: int, radius: int) -> DataFrame:
    """Links ``a, b`` that join all fingerprints within ``radius`` bits, directly or over others.

    ``fps(node, fp0[, fp1])`` has each fingerprint once. Of each signature's run a spanning forest
    of its verified links is given, not all pairs, so a run of g fingerprints gives g - 1 rows at
    most. A run costs comparisons up to the square of its distinct fingerprints, in numpy; only
    their 64-bit words are in memory.
    """
    names = [f"fp{i}" for i in range(bits // 64)]
    cells = _segments(bits, radius)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 2048):
                b = big.slice(at, 2048)
                fp = np.column_stack([b.column(1 + i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(len(names))])
                sigs = []
                for s, (lo, hi) in enumerate(cells):
                    left_out = np.arange(hi - lo, dtype=np.uint64)
                    value = _field(fp, lo, hi)[:, None] & ~(np.uint64(1) << left_out)
                    sigs.append((value << np.uint64(12)) ^ (np.uint64(s << 6) | left_out) if hi - lo <= 52 else value * np.uint64(0x9E3779B97F4A7C15) + (np.uint64(s << 6) | left_out))
                sig = np.concatenate(sigs, axis=1).view(np.int64)
                times = sig.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(sig.reshape(-1)), *[pa.array(np.repeat(b.column(i).to_numpy(zero_copy_only=False), times)) for i in range(1 + len(names))]], names=["sig", "node", *names])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def links(rows: np.ndarray) -> pa.RecordBatch:
            """``rows``: whole runs, sorted; columns sig, node, fp0[, fp1]."""
            starts = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
            sizes = np.diff(np.r_[starts, len(rows)])
            node, fp = rows[:, 1], rows[:, 2:].view(np.uint64)
            two = starts[sizes == 2]
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]).sum(1, dtype=np.int64) <= radius]
            a, b = [node[two]], [node[two + 1]]
            for at, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                own = at + np.argsort(node[at : at + n])  # runs of the same nodes give the same links
                if found := spanning_forest(_Hamming(fp[own], radius)):
                    pairs = own[np.array(found)]
                    a.append(node[pairs[:, 0]])
                    b.append(node[pairs[:, 1]])
            pairs = np.unique(np.sort(np.column_stack([np.concatenate(a), np.concatenate(b)]), axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i])) for i in (0, 1)], names=["a", "b"])

        for b in batches:
            rows = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(2 + len(names))])
            if not len(rows):
                continue
            cut = int(np.searchsorted(rows[:, 0], rows[-1, 0]))  # the last run may go on
            if cut:
                yield links(np.concatenate([*held, rows[:cut]]))
                held = []
            held.append(rows[cut:])
        if held:
            yield links(np.concatenate(held))

    schema = ", ".join(f"{n} long" for n in names)
    signed = fps.select("node", *names).mapInArrow(sign, f"sig long, node long, {schema}")
    n = spread(fps, (32 << 20) // bits)
    return signed.repartition(n, "sig").sortWithinPartitions("sig").mapInArrow(meet, "a long, b long").distinct()


def simhash_groups(docs: DataFrame, shingle: int = 3, radius: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fp0, component``: documents whose 64-bit fingerprints are within ``radius`` bits, directly or over others.

    A null text counts as empty; texts without words have fingerprint zero and are linked like any
    other. ``component`` is the least key of the group (null keys are passed over; null if the
    group has no other). Repeated rows stay, equal texts have equal components, other columns are
    not read, and an empty table gives an empty result.
    """
    rows = settle(fingerprints(docs, partial(shingle_fingerprint, n=shingle), 64, key, text).drop("digest"), "fingerprints")
    nodes = rows.groupBy("fp0").agg(F.min("key").alias("least")).select(F.col("fp0").alias("node"), "fp0", "least")
    roots = connected_components(near_links(nodes, 64, radius))
    named = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    of_root = named.groupBy("root").agg(F.min("least").alias("component"))
    return rows.join(named.join(of_root, "root").select("node", "component"), rows["fp0"] == F.col("node")).select("key", "fp0", "component")


def fingerprint_pairs(texts: DataFrame, radius: int) -> DataFrame:
    """Pairs ``a < b`` of ``texts(node, fp0)``: of one fingerprint each with the least, of different ones within ``radius`` bits the links of the least."""
    least = texts.groupBy("fp0").agg(F.min("node").alias("node"))
    same = texts.join(least.withColumnRenamed("node", "a").hint("merge"), "fp0").where("a < node").select("a", F.col("node").alias("b"))
    return near_links(least, 64, radius).union(same)


#: Of one text in so many the shingles are counted, to tell common ones; which are told changes no result.
COUNTED = 32
#: So many common shingles at most are told to the tasks.
MOST_COMMON = 100_000


def least_overlap(total, similarity: float):
    """The shingles that two sets of ``total`` members together share if they are similar."""
    return np.ceil(similarity / (1 + similarity) * total - 1e-6)


def prefix_size(size: int, similarity: float) -> int:
    """So many of a set's shingles, first in any order that all sets follow, hold one of each similar set's."""
    return size - math.ceil(similarity * size - 1e-6) + 1


def _common_shingles(worded: DataFrame, text: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles in order, and how often each was counted."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(words_of(x.as_py()), shingle)) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))], names=["shingle"])

    drawn = worded.select(text).where(F.pmod(F.xxhash64(text), F.lit(COUNTED)) == 0).distinct()
    counted = drawn.mapInArrow(cut, "shingle long").groupBy("shingle").count().where("count > 2")
    found = counted.orderBy(F.desc("count"), "shingle").limit(MOST_COMMON).toArrow()
    value, n = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()
    order = np.argsort(value)
    return value[order], n[order]


def _prefix(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first of the (different) ``shingles`` in the order of all: rare ones, then common ones by their count."""
    value, n = common
    rank = np.zeros(len(shingles), np.int64)
    if len(value):
        place = np.minimum(np.searchsorted(value, shingles), len(value) - 1)
        rank = np.where(value[place] == shingles, n[place], 0)
    return shingles[np.lexsort((shingles, rank))[: prefix_size(len(shingles), similarity)]]


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Rows of long columns, in whole runs of the first column; the batches come sorted by it."""
    held: list[np.ndarray] = []
    for b in batches:
        rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
        if not len(rows):
            continue
        cut = int(np.searchsorted(rows[:, 0], rows[-1, 0]))  # the last run may go on
        if cut:
            yield np.concatenate([*held, rows[:cut]])
            held = []
        held.append(rows[cut:])
    if held:
        yield np.concatenate(held)


def _batch(names: list[str], rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, i])) for i in range(len(names))], names=names)


def _may_be_similar(size_a, at_a, size_b, at_b, similarity: float) -> np.ndarray:
    """Can sets be similar whose first shared shingle has these places in their order?"""
    return np.minimum(size_a - at_a, size_b - at_b) >= least_overlap(size_a + size_b, similarity)


#: Bits of the sketch that goes along with each shingle of a text.
FOLDED = 128


def folded(sketch: bytes) -> bytes:
    """The sketch of the residues by ``FOLDED``."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint8).reshape(-1, FOLDED // 8), axis=0).tobytes()


def most_apart(size_a, size_b, similarity: float):
    """So many members of two similar sets at most are not in both."""
    return size_a + size_b - 2 * least_overlap(size_a + size_b, similarity)


def parity_sketch(shingles: np.ndarray) -> bytes:
    """A bit for each residue of the shingles, set if an odd number has it; two to four bits a shingle, ``FOLDED`` at least."""
    bits = max(FOLDED, 1 << (2 * len(shingles) - 1).bit_length())
    return np.packbits(np.bincount((shingles % np.uint64(bits)).astype(np.int64), minlength=bits) & 1 == 1).tobytes()


def sketches_allow(size_a: int, size_b: int, a: bytes, b: bytes, similarity: float) -> bool:
    """Can the sets be similar? Sketches differ in no more bits than the sets have members that are not in both."""
    a, b = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    apart = int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum())
    return apart <= most_apart(size_a, size_b, similarity)


def run_pairs(rows: np.ndarray, similarity: float, reach: int | None = None) -> Iterator[np.ndarray]:
    """Pairs ``a < b`` of each run that can be similar and are of different components, in parts.

    ``rows``: shingle, node, size and place (in one number), component, and if given two words of the
    folded sketch. Within a run by size, a row meets those up to ``1 / similarity`` of its size, or the
    next ``reach`` rows only.
    """
    rows = rows[np.lexsort((rows[:, 1], rows[:, 2] >> 32, rows[:, 0]))]
    run, node, size, at, component = rows[:, 0], rows[:, 1], rows[:, 2] >> 32, rows[:, 2] & 0xFFFFFFFF, rows[:, 3]
    sketch = np.ascontiguousarray(rows[:, 4:]).view(np.uint64)  # of signed numbers the bits of the amount are counted
    row, step, held, n = np.arange(len(rows)), 0, [], 0
    while len(row) and (reach is None or step < reach):
        step += 1
        row = row[row + step < len(rows)]
        other = row + step
        row = row[(run[row] == run[other]) & (similarity * size[other] <= size[row] + 1e-6)]
        other = row + step
        hit = (component[row] != component[other]) & _may_be_similar(size[row], at[row], size[other], at[other], similarity)
        a, b = row[hit], other[hit]
        if sketch.shape[1] and len(a):
            may = np.bitwise_count(sketch[a] ^ sketch[b]).sum(1, dtype=np.int64) <= most_apart(size[a], size[b], similarity)
            a, b = a[may], b[may]
        held.append(np.sort(np.column_stack([node[a], node[b]]), axis=1))
        n += len(held[-1])
        if n > 500_000:
            yield np.unique(np.concatenate(held), axis=0)
            held, n = [], 0
    if n:
        yield np.unique(np.concatenate(held), axis=0)


def mixed_pairs(rows: np.ndarray, similarity: float) -> np.ndarray:
    """Pairs ``a < b`` of neighbours that can be similar, in an order of each run's own.

    A text has other neighbours in each of its runs, so that many near copies soon hang together.
    """
    order = rows[:, 1].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ rows[:, 0].view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    order = (order ^ order >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    rows = rows[np.lexsort((order >> np.uint64(16), rows[:, 0]))]
    a, b = rows[:-1], rows[1:]
    hit = (a[:, 0] == b[:, 0]) & _may_be_similar(a[:, 2] >> 32, a[:, 2] & 0xFFFFFFFF, b[:, 2] >> 32, b[:, 2] & 0xFFFFFFFF, similarity)
    return np.unique(np.sort(np.column_stack([a[hit, 1], b[hit, 1]]), axis=1), axis=0)


def near_duplicate_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, digest, group, first, n``: documents in groups of near copies; ``group`` is the least key of the group.

    Two texts are linked if their sets of ``shingle``-word shingles have a Jaccard similarity of at
    least ``similarity``, computed exactly; of such links none is missed. Equal texts are one candidate,
    known by their MD5, and rows of one key with different texts are apart. Texts without words and rows
    with a null key are in no group and don't appear. ``first``: is it the text that stands for its
    group, the least of its least key? ``n``: rows of this key and text, which appear once.

    Candidates are texts whose 64-bit fingerprints over distinct words are within ``radius`` bits; their
    links that hold make components. Similar texts may lie further apart, so an exact way follows for the
    rest: similar sets share one of their first shingles, in an order that puts rare ones first (a prefix
    filter). Texts meet by these in sorted runs, twice: beside the fingerprints only neighbours by size and
    in an order of each run's own, so that groups of many copies become one component; then all whose
    components still differ. Pairs that their sizes, places or sketches prove to be unlike go, the others
    are compared.
    """
    worded = docs.where(F.col(key).isNotNull() & F.col(text).rlike(r"[^\x20\x09-\x0D]")).select(F.col(key).alias("key"), F.col(text).alias("text"))
    digest = F.md5("text").alias("digest")
    common = _common_shingles(worded, "text", shingle)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints, sizes, prefixes, sketches, folds = [], [], [], [], []
            for x in b.column(1):
                own = words_of(x.as_py())
                shingles = np.unique(shingle_hashes(own, shingle))
                prints.append(word_fingerprint(own))
                sizes.append(len(shingles))
                prefixes.append(_prefix(shingles, common, similarity).astype("<u4").tobytes())  # 32 bits: a chance match is but a candidate
                sketches.append(parity_sketch(shingles))
                folds.append(folded(sketches[-1]))
            words = np.frombuffer(b"".join(folds), "<i8").reshape(-1, FOLDED // 64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.frombuffer(b"".join(prints), "<i8")), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.binary()), pa.array(sketches, pa.binary()), *[pa.array(np.ascontiguousarray(words[:, i])) for i in (0, 1)]], names=["key", "digest", "fp0", "size", "prefix", "sketch", "fold0", "fold1"])

    kind = worded.schema["key"].dataType.simpleString()
    rows = settle(worded.select("key", "text", digest).mapInArrow(describe, f"key {kind}, digest string, fp0 long, size long, prefix binary, sketch binary, fold0 long, fold1 long"), "fingerprints")
    made = rows.groupBy("digest").agg(F.min("key").alias("least"), *[F.first(c).alias(c) for c in ("fp0", "size", "prefix", "sketch", "fold0", "fold1")])
    texts = settle(made.withColumn("node", F.monotonically_increasing_id()), "texts")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 256):
                b = big.slice(at, 256)
                own = [np.frombuffer(x.as_buffer(), "<u4") for x in b.column(2)]
                times = np.array([len(x) for x in own], np.int64)
                place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                node, size = (np.repeat(b.column(i).to_numpy(zero_copy_only=False), times) for i in (0, 1))
                yield _batch(["shingle", "node", "place"], np.column_stack([np.concatenate(own).astype(np.int64), node, size << 32 | place]))

    def shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _whole_runs(batches):
            new = np.r_[True, x[1:, 0] != x[:-1, 0]]
            yield _batch(["shingle", "node", "place"], x[~(new & np.r_[new[1:], True])])

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _whole_runs(batches):
            yield _batch(["a", "b"], mixed_pairs(x, similarity))
            for pairs in run_pairs(np.column_stack([x, x[:, 1]]), similarity, reach=1):
                yield _batch(["a", "b"], pairs)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _whole_runs(batches):
            starts = np.flatnonzero(np.r_[True, x[1:, 0] != x[:-1, 0]])
            mixed = np.minimum.reduceat(x[:, 3], starts) != np.maximum.reduceat(x[:, 3], starts)
            for pairs in run_pairs(x[np.repeat(mixed, np.diff(np.r_[starts, len(x)]))], similarity):
                yield _batch(["a", "b"], pairs)

    def by_shingle(df: DataFrame, n: int) -> DataFrame:
        return df.repartition(n, "shingle").sortWithinPartitions("shingle")

    parts = spread(texts.select("node", "size", "prefix"), 8 << 20)
    shared = settle(by_shingle(texts.select("node", "size", "prefix").mapInArrow(deal, "shingle long, node long, place long"), parts).mapInArrow(shared_only, "shingle long, node long, place long"), "shared")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            may = [sketches_allow(*x, similarity) for x in zip(*(c.to_pylist() for c in b.columns[2:]), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(may, pa.bool_()))

    def candidates(pairs: DataFrame) -> DataFrame:
        a, b = (texts.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("sketch").alias(f"sketch_{x}")).hint("merge") for x in ("a", "b"))
        met = pairs.distinct().join(a, "a").join(b, "b").select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b")
        return settle(met.mapInArrow(alike, "a long, b long"), "pairs")

    near = candidates(fingerprint_pairs(texts.select("node", "fp0"), radius).union(by_shingle(shared, parts).mapInArrow(neighbours, "a long, b long")))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(words_of(x.as_py()), shingle)).tobytes() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            is_near = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                is_near.append(both >= similarity * (len(x) + len(y) - both) - 1e-6)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(is_near, pa.bool_()))

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()

    # candidates grow with the corpus: the same joins at every size
    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = texts.select("node", "digest", F.col("least").alias("key")).join(nodes.hint("merge"), "node", "left_semi")
        some = worded.select("key", "text", digest).join(wanted.hint("merge"), ["key", "digest"]).dropDuplicates(["key", "digest"])
        return settle(some.select("node", "text").mapInArrow(shingled, "node long, shingles binary"), "sets")

    def links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        a, b = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"of_{x}")).hint("merge") for x in ("a", "b"))
        return pairs.join(a, "a").join(b, "b").select("a", "b", "of_a", "of_b").mapInArrow(verify, "a long, b long")

    sets = sets_of(ends(near))
    component = connected_components(links(near, sets))
    known = texts.select("node", "fold0", "fold1").join(component.hint("merge"), "node", "left").select("node", F.coalesce("root", "node").alias("root"), "fold0", "fold1")
    placed = shared.join(known.hint("merge"), "node").select("shingle", "node", "place", "root", "fold0", "fold1")
    rest = candidates(by_shingle(placed, parts).mapInArrow(others, "a long, b long"))
    new = settle(ends(rest).join(sets.select("node").hint("merge"), "node", "left_anti"), "nodes")
    if new.limit(1).count():
        sets = sets.union(sets_of(new))
    more = settle(links(rest, sets), "links")
    if more.limit(1).count():
        component = connected_components(more.union(component.select("node", "root")))
    member = texts.select("node", "digest", "least").join(component.hint("merge"), "node", "left").select("digest", "least", F.coalesce("root", "node").alias("root"))
    head = member.groupBy("root").agg(F.min(F.struct("least", "digest")).alias("head"))
    named = member.join(head.hint("merge"), "root").select("digest", "head")
    counted = rows.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("n"))
    first = (F.col("key") == F.col("head.least")) & (F.col("digest") == F.col("head.digest"))
    return counted.join(named.hint("merge"), "digest").select("key", "digest", F.col("head.least").alias("group"), first.alias("first"), "n")
