"""Hard negatives: rows of another label that score almost as high with an anchor as rows of its own.

Vectors become whole numbers, so scores are exact. An orthogonal rotation onto the principal axes of
all vectors leaves products as they are but puts most of them into the leading components: a pair's
product so far, plus the product of what is left of both norms, plus a bound of the rounding, says what
the pair can reach at most. Pairs that can't reach what is wanted are dropped level by level; the rest are
scored by the products of the whole numbers.

Shards of rows meet blocks of anchors by equality, twice: first for the positives, then for the
negatives within the range that each positive's score gives.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle

#: Shares of the components after which pairs are dropped.
LEVELS = (0.125, 0.25, 0.5, 1.0)
#: Pairs go on one by one, and not as a block, once fewer than this share of them is left.
SPARSE = 0.1
#: Rows of a shard that meet a block of anchors at once; the first are few, to set the bars early.
TILES = (512, 4096)
LONG = np.iinfo(np.int64)


@dataclass
class Side:
    """Whole-number vectors, their rotated form and the norms of what is left after each level."""

    whole: np.ndarray
    turned: np.ndarray
    norm: np.ndarray
    left: list[np.ndarray]

    @classmethod
    def of(cls, whole: np.ndarray, rotation: np.ndarray) -> Side:
        with np.errstate(all="ignore"):
            turned = whole @ rotation
            left = [_norms(turned[:, at:]) for at in levels(whole.shape[1])]
        return cls(whole, turned, _norms(whole), left)

    def part(self, rows) -> Side:
        return Side(self.whole[rows], self.turned[rows], self.norm[rows], [x[rows] for x in self.left])


def levels(dim: int) -> list[int]:
    return sorted({max(1, round(dim * share)) for share in LEVELS}) if dim else []


def _norms(x: np.ndarray) -> np.ndarray:
    """Lengths of rows; scaled, so that squares don't overflow."""
    most = np.abs(x).max(1, initial=0.0)
    unit = np.where(most > 0, most, 1.0)
    with np.errstate(all="ignore"):
        return most * np.sqrt(((x / unit[:, None]) ** 2).sum(1))


def may_reach(a: Side, x: Side, low: np.ndarray, high: np.ndarray | None, bend: float) -> tuple[np.ndarray, np.ndarray]:
    """Places ``i, j`` of all pairs whose product can lie from ``low[i]`` to ``high[i]``; of others as few as the bounds tell.

    ``bend`` says by how much the rotation may fail to be orthogonal.
    """
    dim = a.whole.shape[1]
    # d products and sums in double precision for each of rotation, dot product and bound
    slack = 8 * dim * np.sqrt(dim) * np.finfo(float).eps + 4 * bend
    i = j = None
    done, score = 0, np.zeros((len(a.norm), len(x.norm)))
    with np.errstate(all="ignore"):
        for upto, of_a, of_x in zip(levels(dim), a.left, x.left, strict=True):
            if i is None:
                score += a.turned[:, done:upto] @ x.turned[:, done:upto].T
                reach = of_a[:, None] * of_x[None, :] * (1 + slack) + slack * a.norm[:, None] * x.norm[None, :]
                # a bar that isn't a number never drops a pair
                out = score + reach < low[:, None]
                if high is not None:
                    out |= score - reach > high[:, None]
                if upto == dim or out.mean() > 1 - SPARSE:
                    i, j = np.nonzero(~out)
                    score = score[i, j]
            else:
                score += pair_products(a.turned[:, done:upto], i, x.turned[:, done:upto], j)
                reach = of_a[i] * of_x[j] * (1 + slack) + slack * a.norm[i] * x.norm[j]
                out = score + reach < low[i]
                if high is not None:
                    out |= score - reach > high[i]
                i, j, score = i[~out], j[~out], score[~out]
            done = upto
    return (i, j) if i is not None else np.nonzero(np.ones_like(score, bool))


def pair_products(a: np.ndarray, i: np.ndarray, x: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows ``i`` of ``a`` and ``j`` of ``x``, a few MB at once."""
    out, step = np.zeros(len(i)), max(1, (1 << 19) // max(a.shape[1], 1))
    for at in range(0, len(i), step):
        out[at : at + step] = np.einsum("nd,nd->n", a[i[at : at + step]], x[j[at : at + step]])
    return out


def whole_products(a: Side, i: np.ndarray, x: Side, j: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers. Beyond 64 bits: the least or greatest long."""
    with np.errstate(all="ignore"):
        size = a.norm[i] * x.norm[j]
        small = size < 2.0**52  # then sums of any of the products are whole numbers that doubles hold
        if len(i) > SPARSE * len(a.norm) * len(x.norm):
            out = (a.whole @ x.whole.T)[i, j]
        else:
            out = pair_products(a.whole, i, x.whole, j)
        out = np.where(small, out, 0).astype(np.int64)
    for n in np.flatnonzero(~small).tolist():
        out[n] = min(max(sum(int(p) * int(q) for p, q in zip(a.whole[i[n]], x.whole[j[n]], strict=True)), LONG.min), LONG.max)
    return out


def firsts(group: np.ndarray, score: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Places of each group's first ``k`` by falling score, then key; in that order."""
    order = np.lexsort((key, ~score, group))
    g = group[order]
    new = np.flatnonzero(np.r_[True, g[1:] != g[:-1]][: len(g)])
    rank = np.arange(len(g)) - np.repeat(new, np.diff(np.r_[new, len(g)]))
    return order[rank < k]


class Best:
    """The first ``k`` of each group so far: score, and what goes with it."""

    def __init__(self, groups: int, k: int):
        self.groups, self.k = groups, k
        self.group, self.score, self.key = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, group: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        group, score, key = np.concatenate([self.group, group]), np.concatenate([self.score, score]), np.concatenate([self.key, key])
        kept = firsts(group, score, key, self.k)
        self.group, self.score, self.key = group[kept], score[kept], key[kept]

    def bars(self) -> np.ndarray:
        """The k-th score of each group that has as many, else minus infinity."""
        out = np.full(self.groups, -np.inf)
        count = np.bincount(self.group, minlength=self.groups)
        last = np.cumsum(count)[count >= self.k] - 1
        out[count >= self.k] = self.score[last]
        return out


def _below(bar: np.ndarray) -> np.ndarray:
    """Bars as doubles that are no higher than they were as whole numbers."""
    return np.where(np.isfinite(bar), bar - np.abs(bar) * 4e-16, bar)


def _tiles(n: int) -> Iterator[slice]:
    at = 0
    while at < n:
        step = TILES[0] if at == 0 else TILES[1]
        yield slice(at, min(at + step, n))
        at += step


def _packed(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _narrow(whole: np.ndarray) -> np.ndarray:
    """Whole numbers in the shortest kind that holds them."""
    most = np.abs(whole).max(initial=0)
    return whole.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.float64)


def _vectors(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), len(flat) // max(len(column), 1))


def rotations(rows: DataFrame) -> DataFrame:
    """``dim, rotation``: for each length of vectors the principal axes of their directions, over all rows, steepest first."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            dims = b.column(0).to_numpy()
            for dim in np.unique(dims).tolist():
                x = _vectors(b.column(1).filter(pa.array(dims == dim)))
                norm = _norms(x)
                x = x[np.isfinite(norm) & (norm > 0)] / norm[np.isfinite(norm) & (norm > 0), None]
                sums[dim] = sums.get(dim, 0) + x.T @ x
        for dim, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, dim, np.int32)), pa.array(np.arange(dim, dtype=np.int32)), pa.array(list(m), pa.list_(pa.float64()))], names=["dim", "at", "sums"])

    def add(group: pa.Table) -> pa.Table:
        total = _vectors(group.column("sums")).sum(0)
        return pa.table({"dim": group.column("dim")[:1], "at": group.column("at")[:1], "sums": pa.array([total], pa.list_(pa.float64()))})

    def turn(group: pa.Table) -> pa.Table:
        m = _vectors(group.column("sums"))[np.argsort(group.column("at").to_numpy())]
        axes = np.ascontiguousarray(np.linalg.eigh((m + m.T) / 2)[1][:, ::-1])
        return pa.table({"dim": group.column("dim")[:1], "rotation": pa.array([axes.tobytes()], pa.binary())})

    made = rows.where("dim > 0").select("dim", "v").mapInArrow(moments, "dim int, at int, sums array<double>")
    return made.groupBy("dim", "at").applyInArrow(add, "dim int, at int, sums array<double>").groupBy("dim").applyInArrow(turn, "dim int, rotation binary")


_STREAM = "dim int, shard long, block long, blob binary, rotation binary"


class Shard:
    """Rows of one shard, in the order of their labels."""

    def __init__(self, blob: bytes, rotation: np.ndarray):
        kept = np.load(io.BytesIO(blob))
        self.key, self.names = kept["key"], {x: n for n, x in enumerate(kept["names"].tolist())}
        self.label = kept["label"]
        self.side = Side.of(kept["whole"].astype(np.float64), rotation)

    def codes(self, labels: np.ndarray) -> np.ndarray:
        return np.array([self.names.get(x, -1) for x in labels.tolist()], np.int64)


def _scan(shards: DataFrame, blocks: DataFrame, count: int, find: Callable[[Shard, dict, Side, float], pa.RecordBatch], schema: str) -> DataFrame:
    """``find`` for each block of anchors with each shard of their length; a shard is taken up once."""
    names = [x.split()[0] for x in _STREAM.split(", ")]
    every = blocks.withColumn("shard", F.expr(f"explode(sequence(0L, {count - 1}L))")).select(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shard = rotation = None
        bend = 0.0
        for b in batches:
            for dim, s, block, blob, turned in zip(*b.columns, strict=True):
                if block.as_py() < 0:  # a shard comes before its blocks
                    at, dim = (dim.as_py(), s.as_py()), dim.as_py()
                    rotation = np.frombuffer(turned.as_buffer(), np.float64).reshape(dim, dim) if dim else np.zeros((0, 0))
                    bend = float(np.abs(rotation.T @ rotation - np.eye(dim)).sum())
                    shard = Shard(blob.as_py(), rotation)
                elif at == (dim.as_py(), s.as_py()):  # else the shard has no vector of this length
                    asked = dict(np.load(io.BytesIO(blob.as_py())))
                    yield find(shard, asked, Side.of(asked["whole"].astype(np.float64), rotation), bend)

    stream = shards.select(names).union(every).repartition(min(count, 20_000), "dim", "shard").sortWithinPartitions("dim", "shard", "block")
    return stream.mapInArrow(run, schema)


def hard_negatives(
    vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256,
    key: str = "vec_id", label: str = "label", vector: str = "embedding", shard_bytes: int = 16 << 20, block_rows: int = 256,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each anchor and each of its positives the hard negatives.

    A component x counts as floor(``scale`` * x) and a score is the whole-number inner product with the
    anchor; higher scores come first, ties by smaller key. An anchor's positives are its first ``positives``
    rows of the same label, its negatives for a positive of score p the first ``negatives`` rows of other
    labels whose score n has ``low`` * p <= 100 * n <= ``high`` * p. Fewer, if there are fewer: a negative p
    has none at 80 and 100.

    Rows take no part, as anchors or otherwise, if their key, label or vector is null or a component is
    null, not finite, or not finite times ``scale``. Rows of the anchor's own key are never its
    positives or negatives; repeated rows count once each, and a repeated anchor gives its rows again.
    Vectors meet those of their own length only; those of no or only zero components score 0.
    Scores beyond 64 bits count as the least or the greatest long. Of both tables only key, label and
    vector are read; without anchors or rows the result is empty.
    """
    spark = vectors.sparkSession
    scaled = F.transform(F.col(vector), lambda x: x.cast("double") * scale)
    finite = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def taken(df: DataFrame) -> DataFrame:
        usable = df.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False)))
        return usable.select(F.col(key).cast("long").alias("key"), F.col(label).cast("string").alias("label"), scaled.alias("v")).withColumn("dim", F.size("v"))

    rows, asked = settle(taken(vectors), "vectors"), settle(taken(anchors), "anchors")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    size, queries = rows.agg(F.sum(F.lit(8) * (F.col("dim") + 4))).first()[0], asked.count()
    if not size or not queries:
        return spark.createDataFrame([], schema)
    count, blocks = -(-size // shard_bytes), -(-queries // block_rows)
    turned = settle(rotations(rows), "rotations")
    cells = {"dim": pa.int32(), "shard": pa.int64(), "block": pa.int64(), "blob": pa.binary()}
    packed = "dim int, shard long, block long, blob binary"

    def build(group: pa.Table) -> pa.Table:
        whole = np.floor(_vectors(group.column("v")))
        names, code = np.unique(np.array(group.column("label").to_pylist()), return_inverse=True)
        by = np.lexsort((group.column("key").to_numpy(), code))
        blob = _packed(key=group.column("key").to_numpy()[by], label=code[by], names=names, whole=_narrow(whole[by]))
        return pa.table({c: pa.array([v], cells[c]) for c, v in zip(cells, (whole.shape[1], group.column("shard")[0].as_py(), -1, blob), strict=True)})

    # rows are dealt by their place, so that a label or vector of very many rows fills no shard
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(count)))
    built = dealt.groupBy("dim", "shard").applyInArrow(build, packed)
    shards = settle(built.join(turned, "dim", "left"), "shards")

    def pack(group: pa.Table) -> pa.Table:
        whole = np.floor(_vectors(group.column("v")))
        given = {"row": group.column("row").to_numpy(), "key": group.column("key").to_numpy(), "label": np.array(group.column("label").to_pylist()), "whole": _narrow(whole)}
        if "found" in group.column_names:
            found = group.column("found").combine_chunks()
            given["times"] = np.diff(found.offsets.to_numpy())
            given["positive"], given["score"] = (found.flatten().field(c).to_numpy() for c in ("positive", "score"))
            given["at"] = found.flatten().field("at").to_numpy()
        return pa.table({c: pa.array([v], cells[c]) for c, v in zip(cells, (whole.shape[1], None, group.column("block")[0].as_py(), _packed(**given)), strict=True)})

    def in_blocks(df: DataFrame, name: str) -> DataFrame:
        made = df.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "row"), F.lit(blocks))).groupBy("dim", "block").applyInArrow(pack, packed)
        return settle(made.withColumn("rotation", F.lit(None).cast("binary")), name)

    def positives_of(shard: Shard, given: dict, side: Side, bend: float) -> pa.RecordBatch:
        out = [np.zeros((0, 3), np.int64)]
        codes = shard.codes(given["label"])
        for code in np.unique(codes[codes >= 0]).tolist():
            who = np.flatnonzero(codes == code)
            lo, hi = np.searchsorted(shard.label, [code, code + 1])
            a, best = side.part(who), Best(len(who), positives)
            for tile in _tiles(hi - lo):
                at = slice(lo + tile.start, lo + tile.stop)
                x = shard.side.part(at)
                i, j = may_reach(a, x, _below(best.bars()), None, bend)
                other = given["key"][who[i]] != shard.key[at][j]
                i, j = i[other], j[other]
                best.add(i, whole_products(a, i, x, j), shard.key[at][j])
            out.append(np.column_stack([given["row"][who[best.group]], best.key, best.score]))
        found = np.concatenate(out)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, c])) for c in range(3)], names=["row", "positive", "score"])

    numbered = settle(asked.withColumn("row", F.monotonically_increasing_id()), "numbered")
    near = _scan(shards, in_blocks(numbered, "blocks"), count, positives_of, "row long, positive long, score long")
    ranked = near.withColumn("at", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "positive"))).where(F.col("at") <= positives)
    # a few rows an anchor, never more than ``positives``
    of_anchor = settle(ranked.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "positive", "score"))).alias("found")), "positives")

    def negatives_of(shard: Shard, given: dict, side: Side, bend: float) -> pa.RecordBatch:
        slots, times = int(given["times"].max()), given["times"]
        at_slot = np.arange(len(given["score"])) - np.repeat(np.cumsum(times) - times, times)
        least = np.full((len(times), slots), LONG.max)
        most, of = np.full((len(times), slots), LONG.min), np.zeros((len(times), slots), np.int64)
        owner = np.repeat(np.arange(len(times)), times)
        of[owner, at_slot] = np.arange(len(given["score"]))
        least[owner, at_slot] = [min(-(-low * p // 100), LONG.max) for p in given["score"].tolist()]
        most[owner, at_slot] = [max(high * p // 100, LONG.min) for p in given["score"].tolist()]
        codes, best = shard.codes(given["label"]), Best(len(times) * slots, negatives)
        for at in _tiles(len(shard.key)):
            x = shard.side.part(at)
            bars = np.maximum(best.bars().reshape(len(times), slots), least.astype(np.float64)).min(1)
            i, j = may_reach(side, x, _below(bars), -_below(-most.max(1).astype(np.float64)), bend)
            other = (codes[i] != shard.label[at][j]) & (given["key"][i] != shard.key[at][j])
            i, j = i[other], j[other]
            score = whole_products(side, i, x, j)
            for slot in range(slots):
                hit = (least[i, slot] <= score) & (score <= most[i, slot])
                best.add(i[hit] * slots + slot, score[hit], shard.key[at][j[hit]])
        i, slot = best.group // slots, best.group % slots
        hit = of[i, slot]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (given["row"][i], given["at"][hit], given["key"][i], given["positive"][hit], given["score"][hit], best.key, best.score)], names=_HARD.replace(" int", "").replace(" long", "").split(", "))

    asked_for = numbered.join(of_anchor, "row").select("row", "key", "label", "v", "dim", "found")
    hard = _scan(shards, in_blocks(asked_for, "with-positives"), count, negatives_of, _HARD)
    rank = F.row_number().over(Window.partitionBy("row", "at").orderBy(F.desc("negative_score"), "negative_id"))
    return hard.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


_HARD = "row long, at int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
