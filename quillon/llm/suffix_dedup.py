"""Repeated byte strings: every string of ``length`` bytes stays where it first starts.

Suffixes are sorted blockwise with the help of a cover of sampled positions. The sample is
chosen by content: of each window of ``length`` bytes, the start of its least ``ANCHOR``-byte
hash (an anchor). Like a difference cover it has, for any two equal windows, a sample at the same
distance from both starts, but with about 2 samples in ``length - ANCHOR`` positions.

The windows of one anchor form a cell. Cells meet by anchor, one bucket of suffixes at a time:

1. equal cells: all but the first are repeats as a whole;
2. cells of one anchor that differ: the bucket's sampled suffixes are sorted and ranked once, and so
   are the bytes before them; a window is then known by the rank of its bytes before the sample and
   the rank of the sample's suffix at the depth that remains, so no window is compared bytewise;
3. an anchor of very many different cells isn't gathered: its windows are grouped by their hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .shared import settle, spread

ANCHOR = 21
_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
SLICE = 1 << 19
#: Cells that a task keeps before it sends them on.
FLUSH = 300_000
#: An anchor with more different cells than this in one flush, or ``hot_bucket`` in all, is not gathered.
HOT_IN_FLUSH = 8192


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0], have = 1, 1
    while have < n:
        step = np.uint64(pow(base, have, 2**64))
        more = min(have, n - have)
        out[have : have + more] = out[:more] * step
        have += more
    return out


_POWER: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _POWER or len(_POWER[base][0]) < n:
        _POWER[base] = _powers(base, n), _powers(pow(base, -1, 2**64), n)
    return _POWER[base]


class RangeHash:
    """Hashes of byte ranges of one buffer, equal for equal bytes wherever they are."""

    def __init__(self, data: np.ndarray, base: int):
        self.power, self.back = _power(base, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * self.power[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ h >> np.uint64(32)


def _anchor_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``ANCHOR`` bytes from each position on, by doubling."""
    base = _BASES[0]
    one = _BYTE[data]
    have, h, out, done = 1, one, None, 0
    for bit in range(ANCHOR.bit_length()):
        if ANCHOR >> bit & 1:
            if out is None:
                out = h
            else:
                n = len(h) - done
                out = out[:n] * np.uint64(pow(base, have, 2**64)) + h[done : done + n]
            done += have
        n = len(h) - have
        h = h[:n] * np.uint64(pow(base, have, 2**64)) + h[have:]
        have *= 2
    out = out[: len(data) - ANCHOR + 1]
    out = out ^ out >> np.uint64(31)
    return out * np.uint64(0x94D049BB133111EB)


def _window_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the place of its least, of equal ones the first: it hangs on the run alone."""
    at, have = np.arange(len(x), dtype=np.int32), 1
    while have < width:
        step = min(have, width - have)
        right = x[step:] < x[:-step]
        x, at = np.where(right, x[step:], x[:-step]), np.where(right, at[step:], at[:-step])
        have += step
    return at


@dataclass
class Cells:
    """Parallel arrays: document (its place in the slice), first and last window, anchor, hashes."""

    doc: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    at: np.ndarray
    anchor: np.ndarray
    content: np.ndarray


def cells_of(texts: list[bytes], length: int) -> Cells:
    """The cells of texts that together have at most ``SLICE`` bytes, or of one text."""
    starts = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.diff(starts)
    if not (sizes >= length).any():
        none = np.zeros(0, np.int64)
        return Cells(none, none, none, none, none.view(np.uint64), none.view(np.uint64))
    h = _anchor_hashes(data)
    least = _window_argmin(h, length - ANCHOR + 1)
    doc = np.repeat(np.arange(len(texts)), np.maximum(sizes - length + 1, 0))
    before = np.cumsum(np.maximum(sizes - length + 1, 0)) - np.maximum(sizes - length + 1, 0)
    p = np.arange(len(doc)) - before[doc] + starts[doc]
    at = least[p].astype(np.int64)
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])
    last = np.r_[new[1:] - 1, len(p) - 1]
    lo, hi, at, doc = p[new], p[last], at[new], doc[new]
    content = RangeHash(data, _BASES[1])(lo, hi + length)
    base = starts[doc]
    return Cells(doc, lo - base, hi - base, at - base, h[at], content)


def _slices(keys: list, texts: list[bytes]) -> Iterator[tuple[list, list[bytes]]]:
    k, t, size = [], [], 0
    for key, text in zip(keys, texts, strict=True):
        if t and size + len(text) > SLICE:
            yield k, t
            k, t, size = [], [], 0
        k.append(key)
        t.append(text)
        size += len(text)
    if t:
        yield k, t


def _pieces_in(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list, list[bytes]]]:
    for big in batches:
        for at in range(0, big.num_rows, 512):
            b = big.slice(at, 512)
            yield from _slices(b.column(0).to_pylist(), [x or b"" for x in b.column(column).to_pylist()])


#: Cells on their way: anchor, content, first and last window, anchor's place, key, 1 if known to be hot.
_CELL = np.dtype([("anchor", "<u8"), ("content", "<u8"), ("key", "<i8"), ("lo", "<u4"), ("more", "<u2"), ("at", "<u2"), ("hot", "u1")])
#: Ranges of bytes to remove.
_RANGE = np.dtype([("key", "<i8"), ("lo", "<u4"), ("hi", "<u4")])
_ROUTED = pa.schema([("part", pa.int32()), ("cells", pa.binary()), ("ranges", pa.binary()), ("hot", pa.binary())])
_BY_KEY = pa.schema([("part", pa.int32()), ("key", pa.int64()), ("ranges", pa.binary()), ("cells", pa.binary()), ("hot", pa.binary())])


def _merge(key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Maximal ranges a key, sorted."""
    out = np.zeros(0, _RANGE)
    if not len(key):
        return out
    order = np.lexsort((lo, key))
    key, lo, hi = key[order], lo[order].astype(np.int64), hi[order].astype(np.int64)
    group = np.cumsum(np.r_[False, key[1:] != key[:-1]])
    reach = np.maximum.accumulate(hi + group * (1 << 40)) - group * (1 << 40)
    new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (lo[1:] > reach[:-1])])
    out = np.zeros(len(new), _RANGE)
    out["key"], out["lo"], out["hi"] = key[new], lo[new], reach[np.r_[new[1:] - 1, len(key) - 1]]
    return out


def _firsts(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``cells`` by anchor, content, key and place; where each content starts; where each anchor starts."""
    cells = cells[np.lexsort((cells["lo"], cells["key"], cells["content"], cells["anchor"]))]
    bucket = np.r_[True, cells["anchor"][1:] != cells["anchor"][:-1]][: len(cells)]
    first = bucket | np.r_[True, cells["content"][1:] != cells["content"][:-1]][: len(cells)]
    return cells, first, bucket


def _part_of_key(key: np.ndarray, parts: int) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(_BASES[0]) >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def _route(parts: int, **arrays: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    """One row a part that gets anything: of each array, the elements sent there."""
    out = {"part": pa.array(np.arange(parts, dtype=np.int32))}
    some = np.zeros(parts, bool)
    for name, (x, to) in arrays.items():
        order = np.argsort(to, kind="stable")
        ends = np.searchsorted(to[order], np.arange(parts + 1))
        some |= np.diff(ends) > 0
        x = x[order]
        out[name] = pa.array([x[a:b].tobytes() if b > a else None for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())
    return pa.RecordBatch.from_pydict(out).filter(pa.array(some))


def _whole(group: pa.Table, name: str, kind: np.dtype) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *[np.frombuffer(x.as_buffer(), kind) for x in group.column(name) if x.is_valid]])


def _by_key(part: int, ranges: np.ndarray, cells: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
    """A row a key; the arrays needn't be sorted."""
    keys = np.unique(np.concatenate([ranges["key"], cells["key"], hot["key"]]))
    cut = []
    for x in (ranges, cells, hot):
        x = x[np.argsort(x["key"], kind="stable")]
        a, b = np.searchsorted(x["key"], keys), np.searchsorted(x["key"], keys, "right")
        cut.append(pa.array([x[i:j].tobytes() if j > i else None for i, j in zip(a.tolist(), b.tolist(), strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), part, np.int32)), pa.array(keys), *cut], schema=_BY_KEY)


def _lcp(a: np.ndarray) -> np.ndarray:
    """Common bytes of each row of a byte matrix with the row before it; 0 for the first."""
    if not len(a):
        return np.zeros(0, np.int64)
    differ = a[1:] != a[:-1]
    return np.r_[0, np.where(differ.any(1), differ.argmax(1), a.shape[1])]


def _ranked(bucket: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of the rows of ``side`` within buckets, and common bytes with the row before (-1: another bucket)."""
    order = np.lexsort((np.ascontiguousarray(side).view(f"S{side.shape[1]}").reshape(-1), bucket))
    depth = _lcp(side[order])
    depth[np.r_[True, bucket[order][1:] != bucket[order][:-1]][: len(order)]] = -1
    return order, depth


def repeats_in_buckets(bucket: np.ndarray, key: np.ndarray, lo: np.ndarray, at: np.ndarray, context: list[bytes], length: int) -> np.ndarray:
    """Ranges of the windows of differing cells whose bytes start earlier in another cell of the bucket.

    ``context``: the bytes from a cell's first window to the end of its last. Windows before the
    anchor by the same distance ``d`` are equal if ``d`` bytes before it and ``length - d`` from it on are.
    """
    n, width = len(key), length - ANCHOR + 1
    order = np.lexsort((lo, key))
    bucket, key, lo, at, context = bucket[order], key[order], lo[order], at[order], [context[i] for i in order.tolist()]
    left, right = np.zeros((n, width), np.uint8), np.zeros((n, length), np.uint8)
    size = np.array([len(x) for x in context])
    flat = np.frombuffer(b"".join(context), np.uint8)
    row = np.repeat(np.arange(n), size)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) - np.repeat(at, size)
    before = place < 0
    left[row[before], -place[before] - 1] = flat[before]
    right[row[~before], place[~before]] = flat[~before]
    (lo_order, lo_depth), (ro_order, ro_depth) = _ranked(bucket, left), _ranked(bucket, right)
    least, most = at - (size - length), at  # distances of the last and the first window
    far, near = np.full(n, -1), np.full(n, length)
    lname, rname = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(int(most.max()) + 1):
        here = np.flatnonzero((least <= d) & (d <= most))
        if len(here) < 2:
            continue
        lname[lo_order] = np.cumsum(lo_depth < d)
        rname[ro_order] = np.cumsum(ro_depth < length - d)
        name = lname[here] * (n + 1) + rname[here]
        repeat = np.ones(len(here), bool)
        repeat[np.unique(name, return_index=True)[1]] = False
        hit = here[repeat]
        far[hit] = np.maximum(far[hit], d)
        near[hit] = np.minimum(near[hit], d)
    hit = far >= 0
    start = lo[hit] + at[hit]
    return _merge(key[hit], start - far[hit], start - near[hit] + length)


def repeated_ranges(docs: DataFrame, length: int = 100, key: str = "doc_id", text: str = "text", hot_bucket: int = 200_000) -> DataFrame:
    """``key, ranges``: for each document with repeats its maximal (key, start, end) ranges of bytes, as packed binary.

    Matches never cross documents. A null text counts as empty; texts below ``length`` bytes and rows
    with a null key have no repeats. Keys are whole numbers and must tell the rows apart. Tasks hold
    the cells of a part, at 33 bytes each, or the bytes around the differing cells of a part. Cells are
    equal if the 64-bit hashes of their anchor and of their bytes both are.
    """
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text"))
    parts = spread(docs, 8 << 20)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            cells, first, bucket = _firsts(np.concatenate(held))
            again = cells[~first]
            ranges = _merge(again["key"], again["lo"], again["lo"] + again["more"] + length)
            cells, bucket = cells[first], np.flatnonzero(bucket[first])
            many = np.diff(np.r_[bucket, len(cells)])
            is_hot = np.repeat(many > HOT_IN_FLUSH, many)
            cells["hot"] = is_hot
            sent = ~is_hot
            sent[bucket] = True  # one of each bucket tells the others
            hot, cells = cells[~sent], cells[sent]
            return _route(parts, cells=(cells, (cells["anchor"] % np.uint64(parts)).astype(np.int64)), ranges=(ranges, _part_of_key(ranges["key"], parts)), hot=(hot, _part_of_key(hot["key"], parts)))

        for keys, texts in _pieces_in(batches, 1):
            c = cells_of(texts, length)
            x = np.zeros(len(c.lo), _CELL)
            x["anchor"], x["content"], x["key"] = c.anchor, c.content, np.array(keys, np.int64)[c.doc]
            x["lo"], x["more"], x["at"] = c.lo, c.hi - c.lo, c.at - c.lo
            held.append(x)
            size += len(x)
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def join(group: pa.Table) -> pa.Table:
        cells, first, bucket = _firsts(_whole(group, "cells", _CELL))
        group_of = np.cumsum(bucket) - 1
        is_hot = np.zeros(int(bucket.sum()), bool)
        np.logical_or.at(is_hot, group_of, cells["hot"] == 1)
        different = np.bincount(group_of[first], minlength=len(is_hot))
        is_hot |= different > hot_bucket
        again = cells[~first]
        ranges = np.concatenate([_whole(group, "ranges", _RANGE), _merge(again["key"], again["lo"], again["lo"] + again["more"] + length)])
        differ = first & (different > 1)[group_of] & ~is_hot[group_of]
        hot = np.concatenate([_whole(group, "hot", _CELL), cells[first & is_hot[group_of]]])
        differing = cells[differ]
        return pa.Table.from_batches([_route(parts, cells=(differing, _part_of_key(differing["key"], parts)), ranges=(ranges, _part_of_key(ranges["key"], parts)), hot=(hot, _part_of_key(hot["key"], parts)))])

    def by_document(group: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_by_key(group.column("part")[0].as_py(), _whole(group, "ranges", _RANGE), _whole(group, "cells", _CELL), _whole(group, "hot", _CELL))])

    routed = "part int, cells binary, ranges binary, hot binary"
    joined = rows.mapInArrow(cut, routed).groupBy("part").applyInArrow(join, routed)
    met = settle(joined.groupBy("part").applyInArrow(by_document, "part int, key long, ranges binary, cells binary, hot binary"), "cells")

    def surround(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each differing cell its bytes; of each window of hot cells its hashes."""
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            by: dict[int, list] = {}
            for c, x in held:
                by.setdefault(int(c["anchor"]) % parts, []).append((c, x))
            return pa.RecordBatch.from_pylist([{"part": p, "cells": np.array([c for c, _ in v], _CELL).tobytes(), "bytes": b"".join(x for _, x in v)} for p, v in by.items()], _AROUND)

        n = 0
        for big in batches:
            for at in range(0, big.num_rows, 256):
                b = big.slice(at, 256)
                for cells, text in zip(b.column(1), b.column(2), strict=True):
                    data = text.as_py()
                    for c in np.frombuffer(cells.as_buffer(), _CELL):
                        lo = int(c["lo"])
                        held.append((c, data[lo : lo + int(c["more"]) + length]))
                        n += 1
                    if n >= 50_000:
                        yield flush()
                        held, n = [], 0
        if held:
            yield flush()

    def resolve(group: pa.Table) -> pa.Table:
        cells = np.concatenate([np.frombuffer(x.as_buffer(), _CELL) for x in group.column("cells")])
        data = b"".join(x.as_py() for x in group.column("bytes"))
        ends = np.cumsum(cells["more"].astype(np.int64) + length)
        context = [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        found = repeats_in_buckets(cells["anchor"], cells["key"], cells["lo"].astype(np.int64), cells["at"].astype(np.int64), context, length)
        return pa.Table.from_batches([_route(parts, ranges=(found, _part_of_key(found["key"], parts)))])

    def merge(group: pa.Table) -> pa.Table:
        x = _whole(group, "ranges", _RANGE)
        merged = _merge(x["key"], x["lo"], x["hi"])
        none = np.zeros(0, _CELL)
        return pa.Table.from_batches([_by_key(0, merged, none, none).select(["key", "ranges"])])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 64):
                b = big.slice(at, 64)
                for k, cells, text in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                    data = np.frombuffer(text.as_buffer(), np.uint8)
                    c = np.frombuffer(cells.as_buffer(), _CELL)
                    p = np.concatenate([np.arange(x["lo"], int(x["lo"]) + int(x["more"]) + 1) for x in c]).astype(np.int64)
                    h = [RangeHash(data, base)(p, p + length).view(np.int64) for base in _BASES]
                    yield pa.RecordBatch.from_arrays([pa.array(h[0]), pa.array(h[1]), pa.array(np.full(len(p), k)), pa.array(p)], names=["h0", "h1", "key", "p"])

    def of_document(what: str) -> DataFrame:
        return met.where(f"{what} is not null").select("key", F.col(what).alias("cells")).join(rows, "key")

    around = of_document("cells").mapInArrow(surround, "part int, cells binary, bytes binary")
    resolved = around.groupBy("part").applyInArrow(resolve, "part int, ranges binary")
    found = met.where("ranges is not null").select("part", "ranges").union(resolved)
    if met.where("hot is not null").limit(1).count():
        each = settle(of_document("hot").mapInArrow(windows, "h0 long, h1 long, key long, p long"), "windows")
        least = each.groupBy("h0", "h1").agg(F.min(F.struct("key", "p")).alias("least"), F.count("*").alias("n")).where("n > 1").select("h0", "h1", "least")
        again = each.join(least, ["h0", "h1"]).where("struct(key, p) > least").select("key", F.col("p").alias("lo"))
        # a row for so many bytes of a document, however long it is
        spans = again.groupBy("key", F.expr("lo >> 16").alias("at")).agg(F.collect_list("lo").alias("lo")).select("key", "lo").mapInArrow(_as_ranges(length, parts), "part int, ranges binary")
        found = found.union(spans)
    return found.groupBy("part").applyInArrow(merge, "key long, ranges binary")


_AROUND = pa.schema([("part", pa.int32()), ("cells", pa.binary()), ("bytes", pa.binary())])


def _as_ranges(length: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.zeros(0, _RANGE)]
            for k, lo in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = np.array(lo, np.int64)
                found.append(_merge(np.full(len(at), k), at, at + length))
            x = np.concatenate(found)
            yield _route(parts, ranges=(x, _part_of_key(x["key"], parts)))

    return run


def _told_apart(rows: DataFrame) -> DataFrame:
    """``rows`` with ``__row``, unique and in the order of key and text; null for a null key. It is the key itself if no key repeats."""
    if not rows.where("key is not null").groupBy("key").count().where("count > 1").limit(1).count():
        return rows.withColumn("__row", F.col("key"))
    # equal rows are dealt apart by their place
    ordered = rows.withColumn("__place", F.monotonically_increasing_id()).orderBy("key", "text", "__place").drop("__place")
    return settle(ordered.withColumn("__row", F.when(F.col("key").isNotNull(), F.monotonically_increasing_id())), "numbered")


def remove_repeats(docs: DataFrame, length: int = 100, key: str = "doc_id", text: str = "text", hot_bucket: int = 200_000, carry: tuple[str, ...] = (), whole_characters: bool = False) -> DataFrame:
    """``key, kept, n_bytes, n_removed, n_spans, <carry>``, a row a document: ``kept`` are the bytes that stay.

    Every byte of a ``length``-byte string that also starts earlier, in a document of smaller key
    or before in the same one, goes; strings are judged on the input. Null texts count as empty;
    documents with a null key lose nothing. Rows of one key are apart, in the order of their texts, so
    of a repeated row one copy stays. Columns but those in ``carry`` are not read. An empty
    table gives an empty result. With ``whole_characters`` what is left of a UTF-8 character that was
    cut goes too, so that ``kept`` is text again; ``n_removed`` doesn't count such bytes.
    """
    rows = _told_apart(docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text"), *carry))
    found = repeated_ranges(rows, length, "__row", "text", hot_bucket).withColumnRenamed("key", "__row")
    made = StructType([StructField("key", LongType()), StructField("kept", BinaryType()), *[StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")], *[docs.schema[c] for c in carry]])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 256):
                b, out = big.slice(at, 256), []
                for text, ranges in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    data, gone, n = text or b"", 0, 0
                    n_bytes = len(data)
                    if ranges:
                        spans = np.frombuffer(ranges, _RANGE)
                        lo, hi = spans["lo"].tolist(), spans["hi"].tolist()
                        n, gone = len(lo), sum(hi) - sum(lo)
                        data = b"".join(data[i:j] for i, j in zip([0, *hi], [*lo, n_bytes], strict=True))
                        if whole_characters:
                            data = data.decode("utf-8", "ignore").encode()
                    out.append((data, n_bytes, gone, n))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.binary()), *[pa.array(x, pa.int64()) for x in cols[1:]], *b.columns[3:]], names=["key", "kept", "n_bytes", "n_removed", "n_spans", *carry])

    return rows.join(found, "__row", "left").select("key", "text", "ranges", *carry).mapInArrow(apply, made)
