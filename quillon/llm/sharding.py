"""Records into shards of near equal size by sampled splitters, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sampled points for each range, as expected.
DRAWS_A_RANGE = 16
#: Ranges for each shard. A shard is uneven by about half a range at either end.
RANGES_A_SHARD = 128
#: Cells of the hashed group key for each range; ranges are cut between cells.
CELLS_A_RANGE = 64


def cell_bits(n_ranges: int) -> int:
    """Leading bits of the hashed group key that name a cell."""
    return max(16, (n_ranges * CELLS_A_RANGE - 1).bit_length())


def text_size(text: Column) -> Column:
    """UTF-8 bytes, none for null, and one for the record itself."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def splitters(rows: DataFrame, n: int, total: int, draws_a_range: int = DRAWS_A_RANGE) -> list[int]:
    """``n - 1`` cells at or after which a new range starts, from a sample weighted by size.

    A row is drawn ``size * draws / total`` times in the mean, its fraction by a hash of the row, so the
    same table gives the same splitters however it is partitioned. The draws of a cell are counted
    before they meet, and of all cells only those that hold a quantile come to the driver: at most
    ``n - 1``, which depends on the number of shards alone.
    """
    chance = (F.shiftrightunsigned(F.xxhash64(F.lit("splitter"), "group", "key"), 12) + 0.5) / float(1 << 52)
    drawn = rows.select("cell", F.floor(F.col("size") * (n * draws_a_range / total) + chance).alias("draws")).where("draws > 0")
    counted = drawn.groupBy("cell").agg(F.sum("draws").alias("draws"))
    # cells are ordered in blocks, each of which is summed before it is ordered
    blocks = counted.groupBy((F.col("cell") / 256).cast("long").alias("block")).agg(F.sum("draws").alias("of_block"))
    before = blocks.withColumn("before", F.sum("of_block").over(Window.orderBy("block")) - F.col("of_block"))
    placed = counted.withColumn("block", (F.col("cell") / 256).cast("long")).join(before, "block")
    up_to = F.col("before") + F.sum("draws").over(Window.partitionBy("block").orderBy("cell"))
    ranked = placed.select("cell", "draws", up_to.alias("up_to"))
    every = F.lit(counted.agg(F.sum("draws")).first()[0] or 0)
    # a quantile i * every / n falls on one of the cell's draws
    holds = ranked.where((every > 0) & (F.floor((F.col("up_to") - 1) * n / every) > F.floor((F.col("up_to") - F.col("draws") - 1) * n / every)))
    return sorted(r["cell"] for r in holds.select("cell").collect())


def _numbers(rows: DataFrame, columns: dict[str, list[int]]) -> DataFrame:
    """A small table of whole numbers, from one literal."""
    lines = ",".join(" ".join(map(str, v)) for v in zip(*columns.values(), strict=True))
    one = rows.sparkSession.range(1).select(F.explode(F.split(F.lit(lines), ",")).alias("line")).select(F.split("line", " ").alias("v"))
    return one.select(*[F.col("v")[i].cast("long").alias(c) for i, c in enumerate(columns)])


def shard_by_size(rows: DataFrame, n_shards: int, group: Column, size: Column, key: Column) -> DataFrame:
    """``rows`` with ``shard`` (from 0) and ``slot`` (gapless from 0 in each shard).

    Rows of equal ``group`` share a shard, unless the group alone outweighs a 32nd of a shard: such a
    group is dealt over several ranges by a hash of ``key``. Shards then differ from their mean
    by some hundredths of it at most. ``size`` must be positive; nulls in ``group`` and ``key``
    are values like any other; repeated rows get slots of their own; an empty table stays empty.
    Columns named ``group``, ``size``, ``key``, ``cell``, ``range`` and so on may be among those of
    ``rows``: they are kept apart.
    """
    payload = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")
    hashed = rows.select(payload, F.xxhash64(group).alias("group"), size.cast("long").alias("size"), F.xxhash64(key).alias("key"))
    n_ranges = n_shards * RANGES_A_SHARD
    bits = cell_bits(n_ranges)
    hashed = hashed.withColumn("cell", F.shiftrightunsigned("group", 64 - bits))
    keep = [f"row.`{c}`" for c in rows.columns]
    total = hashed.agg(F.sum("size")).first()[0]
    if not total:
        return hashed.select(*keep, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).limit(0)
    edges = sorted({0, *splitters(hashed, n_ranges, total), 1 << bits})
    spans = [(i, a, b - 1) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    named = _numbers(rows, {c: [x[i] for x in spans] for i, c in enumerate(("range", "first", "last"))})
    of_cell = named.selectExpr("range", "explode(sequence(first, last)) as cell")
    ranged = hashed.join(F.broadcast(of_cell), "cell")  # 2 ** bits rows, by the number of shards

    # exact sizes over all rows, at most one row a range
    full = {r["range"]: r["size"] for r in ranged.groupBy("range").agg(F.sum("size").alias("size")).collect()}
    overfull = [i for i, s in full.items() if s * 32 * n_shards > total]
    heavy = []
    if overfull:  # at most 32 * n_shards groups can be that heavy
        by_group = ranged.where(F.col("range").isin(overfull)).groupBy("group").agg(F.sum("size").alias("size"))
        heavy = [(r["group"], -(-r["size"] * n_ranges // total)) for r in by_group.where(F.col("size") * 32 * n_shards > total).collect()]
    if heavy:
        ranged = ranged.join(F.broadcast(_numbers(rows, {"group": [g for g, _ in heavy], "pieces": [p for _, p in heavy]})), "group", "left")
        piece = F.when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64(F.lit("piece"), "key"), F.col("pieces").cast("long")) + 1).otherwise(0)
    else:
        piece = F.lit(0)
    pieced = ranged.withColumn("owner", F.when(piece > 0, F.col("group")).otherwise(F.lit(0).cast("long"))).withColumn("piece", piece.cast("long"))

    # one row for each range and piece of a heavy group; both are bounded by the number of shards
    units = sorted(pieced.groupBy("range", "owner", "piece").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect())
    placed, before, counts = [], 0, [0] * n_shards
    for r in units:
        shard = min(n_shards - 1, (2 * before + r["size"]) * n_shards // (2 * total))
        placed.append((r["range"], r["owner"], r["piece"], shard, counts[shard]))
        before += r["size"]
        counts[shard] += r["n"]
    place = _numbers(rows, {c: [p[i] for p in placed] for i, c in enumerate(("range", "owner", "piece", "shard", "base"))})
    order = "row_number() over (partition by range, owner, piece order by group, key) - 1 + base"
    return pieced.join(F.broadcast(place), ["range", "owner", "piece"]).select(*keep, F.col("shard").cast("int").alias("shard"), F.expr(order).cast("long").alias("slot"))
