"""Nearest vectors by inner product with vantage-point trees, one a shard.

A tree node holds a vantage point v and, for each half, how near and how far its vectors are from v
and their largest norm N. A query q of length s is at least ``gap`` away from a half whose distances from v
don't include its own (the triangle inequality), and |q - x|^2 = s^2 + |x|^2 - 2 q.x then says that no product
there is above (s^2 + N^2 - gap^2) / 2. Products order vectors alike for every s, so s is the largest norm of
the node: all terms have the scale of the node's own vectors, and so has what is added for rounding.
A half whose bound is below the k-th product found is left out; ``factor`` stretches the gap. Factor 1
leaves out only what can't matter, and the search is exact.

Shards and blocks of queries meet by equality: a task takes up a shard's tree once and then searches it
for one block of queries after the other.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle

LEAF = 512
#: Products of unit queries err by this times the dimension and the norm at most, in whatever order they are summed.
ROUNDING = 8 * float(np.finfo(float).eps)
#: Products below this may lose digits, or all of them.
UNDERFLOW = 1e-300


def norms_of(x: np.ndarray) -> np.ndarray:
    """Lengths of rows; scaled by the largest component, so that squares neither overflow nor vanish."""
    most = np.abs(x).max(1, initial=0.0)
    unit = np.where(most > 0, most, 1.0)
    return most * np.sqrt(((x / unit[:, None]) ** 2).sum(1))


class VantageTree:
    """Rows of ``x`` in the order of the tree; nodes are ranges of rows."""

    #: Of each node: its range, its largest norm, its vantage point over that norm, and for each half its place among the nodes and its least and greatest distance.
    PARTS = ("lo", "hi", "norm", "vantage", "child", "least", "most")

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order, self.norms = np.arange(len(x)), norms_of(x)
        self.nodes: list[list] = []
        self._build(x, 0, len(x), leaf)
        self.x, self.norms = x[self.order], self.norms[self.order]

    def _build(self, x: np.ndarray, lo: int, hi: int, leaf: int) -> int:
        at, rows = len(self.nodes), self.order[lo:hi]
        norm = float(self.norms[rows].max(initial=0.0))
        self.nodes.append([lo, hi, norm, np.zeros(x.shape[1]), (-1, -1), (0.0, 0.0), (0.0, 0.0)])
        if hi - lo > leaf and norm > 0:
            scaled = x[rows] / norm
            # the point farthest from the range's first: deterministic, and near the border
            vantage = scaled[int(np.argmax(((scaled - scaled[0]) ** 2).sum(1)))]
            d = np.sqrt(((scaled - vantage) ** 2).sum(1))
            mid = (hi - lo) // 2
            split = np.argpartition(d, mid)
            self.order[lo:hi] = rows[split]
            halves = d[split[:mid]], d[split[mid:]]
            child = self._build(x, lo, lo + mid, leaf), self._build(x, lo + mid, hi, leaf)
            self.nodes[at][3:] = vantage, child, tuple(float(h.min()) for h in halves), tuple(float(h.max()) for h in halves)
        return at

    def packed(self) -> dict[str, np.ndarray]:
        return {"x": self.x, "norms": self.norms, "order": self.order, **{name: np.array([n[i] for n in self.nodes]) for i, name in enumerate(self.PARTS)}}

    @classmethod
    def unpacked(cls, kept) -> VantageTree:
        tree = cls.__new__(cls)
        tree.x, tree.norms, tree.order = kept["x"], kept["norms"], kept["order"]
        tree.nodes = list(zip(*(kept[name].tolist() if name != "vantage" else kept[name] for name in cls.PARTS), strict=True))
        return tree

    def search(self, q: np.ndarray, k: int, factor: float, row_key: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
        """For each query the rows (as given to the tree) that may be among its ``k`` nearest, without those whose key is its own."""
        length = norms_of(q)
        unit = q / length[:, None]
        err = ROUNDING * (q.shape[1] + 4)
        with np.errstate(over="ignore"):
            lost = UNDERFLOW / length
        # a lower bound of each query's k-th product so far
        kth = np.full((len(q), k), -np.inf)
        found: list[list[np.ndarray]] = [[] for _ in q]
        above: list[list[np.ndarray]] = [[] for _ in q]

        def leaf(lo: int, hi: int, who: np.ndarray) -> None:
            product, spare = unit[who] @ self.x[lo:hi].T, err * self.norms[None, lo:hi] + lost[who, None]
            product[own[who][:, None] == row_key[self.order[lo:hi]][None, :]] = -np.inf
            kth[who] = -np.partition(-np.concatenate([kth[who], product - spare], axis=1), k - 1, axis=1)[:, :k]
            most = product + spare
            for i, w in enumerate(who.tolist()):
                hit = np.flatnonzero((most[i] >= kth[w, k - 1]) & (most[i] > -np.inf))
                found[w].append(self.order[lo + hit])
                above[w].append(most[i, hit])

        def visit(node: int, who: np.ndarray) -> None:
            if not len(who):
                return
            lo, hi, norm, vantage, child, least, most = self.nodes[node]
            if child[0] < 0:
                return leaf(lo, hi, who)
            d = np.sqrt(np.maximum(1 - 2 * unit[who] @ vantage + (vantage**2).sum(), 0))
            near = d <= most[0]

            def may_have(half: int, rows: np.ndarray) -> np.ndarray:
                gap = np.maximum(np.maximum(least[half] - d[rows], d[rows] - most[half]) - 1e-7, 0) * factor
                share = self.nodes[child[half]][2] / norm
                bound = norm * (np.minimum((1 + share**2 - gap**2) / 2, share) + err)
                return bound + lost[who[rows]] >= kth[who[rows], k - 1]

            for first, rows in ((0, np.flatnonzero(near)), (1, np.flatnonzero(~near))):
                for half in (first, 1 - first):
                    visit(child[half], who[rows[may_have(half, rows)]])

        visit(0, np.arange(len(q)))
        out = []
        for w in range(len(q)):
            rows, most = np.concatenate(found[w] or [np.zeros(0, int)]), np.concatenate(above[w] or [np.zeros(0)])
            out.append(rows[most >= kth[w, k - 1]])
        return out


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


def usable(vector: str):
    """Not null, not empty, all components finite and some not zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0, key: str = "vec_id", vector: str = "embedding", shard_rows: int = 16_384, block_rows: int = 512) -> DataFrame:
    """``query_id, rank, key, score``: each query's ``k`` nearest vectors by inner product, without its own key.

    Scores are inner products of the vectors as given, in double precision; ties go to the smaller
    key, and repeated rows of one key count once each. Vectors that are null, empty, zero or hold a null or a
    number that isn't finite take no part, nor do rows with a null key; a query finds vectors of its own
    length only. Products beyond the range of doubles are infinite and tie in no stated order. With fewer candidates all are returned; without queries nothing is. Of ``queries`` and
    ``vectors`` only the key and the vector are read. ``factor`` above 1 leaves out more and may miss some.
    """
    spark = vectors.sparkSession
    of = [F.col(key).cast("long").alias("key"), F.col(vector).alias("v"), F.size(vector).alias("dim")]
    rows = settle(vectors.where(F.col(key).isNotNull() & usable(vector)).select(*of), "vectors")
    asked = settle(queries.where(F.col(key).isNotNull() & usable(vector)).select(*of), "queries")
    n = rows.count()
    schema = f"query_id long, rank int, {key} long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    shards = -(-n // shard_rows)
    blocks = max(1, -(-asked.count() // block_rows))
    streamed = "dim int, shard long, block long, tree binary, ids binary, q binary"
    names = [x.split()[0] for x in streamed.split(", ")]

    def one_row(group: pa.Table, **cells) -> pa.Table:
        kinds = {"dim": pa.int32(), "shard": pa.int64(), "block": pa.int64()}
        return pa.table({n: pa.array([cells.get(n)], kinds.get(n, pa.binary())) for n in names})

    def build(group: pa.Table) -> pa.Table:
        key_of, x = group.column("key").to_numpy(), _matrix(group.column("v"))
        by = np.argsort(key_of, kind="stable")
        key_of, x = key_of[by], x[by]
        kept = io.BytesIO()
        np.savez(kept, key=key_of, **VantageTree(x).packed())
        return one_row(group, dim=x.shape[1], shard=group.column("shard")[0].as_py(), block=-1, tree=kept.getvalue())

    # rows are dealt by their place, so that a key or vector of very many rows fills no shard
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    trees = settle(dealt.groupBy("dim", "shard").applyInArrow(build, streamed), "trees")

    def pack(group: pa.Table) -> pa.Table:
        x = _matrix(group.column("v"))
        return one_row(group, dim=x.shape[1], block=group.column("block")[0].as_py(), ids=group.column("key").to_numpy().tobytes(), q=x.tobytes())

    numbered = asked.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), F.monotonically_increasing_id()), F.lit(blocks)))
    packed = settle(numbered.groupBy("dim", "block").applyInArrow(pack, streamed), "blocks")
    every = packed.withColumn("shard", F.expr(f"explode(sequence(0L, {shards - 1}L))")).select(names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = tree = None
        for b in batches:
            for dim, shard, block, blob, ids, q in zip(*b.columns, strict=True):
                if block.as_py() < 0:  # a shard's tree comes before its blocks
                    at, kept = (dim.as_py(), shard.as_py()), np.load(io.BytesIO(blob.as_py()))
                    tree, key_of = VantageTree.unpacked(kept), kept["key"]
                    x = np.empty_like(tree.x)
                    x[tree.order] = tree.x
                    continue
                if at != (dim.as_py(), shard.as_py()):  # no vector of this length in the shard
                    continue
                query = np.frombuffer(ids.as_buffer(), np.int64)
                v = np.frombuffer(q.as_buffer(), np.float64).reshape(len(query), -1)
                out: list[tuple] = []
                for i, hits in enumerate(tree.search(v, min(k, len(key_of)), factor, key_of, query)):
                    score = (x[hits] * v[i]).sum(1)
                    best = np.lexsort((key_of[hits], -score))[:k]
                    out.extend(zip([int(query[i])] * len(best), key_of[hits][best].tolist(), score[best].tolist(), strict=True))
                cols = list(zip(*out, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "key", "score"])

    stream = trees.select(names).union(every).repartition(min(shards, 20_000), "dim", "shard").sortWithinPartitions("dim", "shard", "block")
    found = stream.mapInArrow(search, "query_id long, key long, score double")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key")))
    return best.where(F.col("rank") <= k).select("query_id", "rank", F.col("key").alias(key), "score")
