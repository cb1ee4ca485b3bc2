"""Benchmark passages in documents, in DataFrame operations only.

A window of a document is as long as an item. Windows without any of an item's shingles have
similarity zero to it, so windows are cut only where a document has one: that loses nothing. They are
fingerprinted by SimHash and looked up in a multi-index: a 64-bit fingerprint is cut into four blocks of 16
bits, and of two fingerprints within ``RADIUS`` bits one block differs by at most ``RADIUS // 4`` bits, so
the items' blocks are indexed with all changes of so many bits and windows of an item's length meet
them by equality. Every pair within the radius is then held against the exact similarity of
their shingles, each weighted by how often it occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import settle

SHINGLE = 5
RADIUS = 19
BLOCKS = 4
#: Item shingles are broadcast up to so many rows of 24 bytes; beyond that the join shuffles.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    """Hashes of the words: runs of letters and digits, in lower case."""
    cut = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(cut, lambda w: w != ""), lambda w: F.xxhash64(w))


def shingles(text: Column, n: int = SHINGLE) -> Column:
    """Hashes of all runs of ``n`` words; none of fewer words."""

    def of(hashed: Column) -> Column:
        def at(i: Column) -> Column:
            return F.xxhash64(*[F.get(hashed, i + j) for j in range(n)])

        return F.when(F.size(hashed) >= n, F.transform(F.sequence(F.lit(0), F.size(hashed) - n), at)).otherwise(F.array().cast("array<bigint>"))

    # the lambda's variable holds the words: as a plain column they would be cut anew for each shingle
    return F.get(F.transform(F.array(words(text)), of), 0)


def item_shingles(text: Column) -> Column:
    """All shingles of an item; one of all its words if it has fewer than ``SHINGLE``."""
    whole = F.coalesce(*[F.when(F.size(words(text)) == n, shingles(text, n)) for n in range(1, SHINGLE)])
    return F.coalesce(whole, shingles(text))


def _blocks_sql(hashes: str) -> Column:
    """The fingerprint as four blocks: a bit is set if it is in over half of the hashes."""
    one = "aggregate(sequence(0, 15), 0, (n, i) -> n + if(2 * aggregate({h}, 0, (m, x) -> m + cast(shiftright(x, i + {s}) & 1 as int)) > size({h}), shiftleft(1, i), 0))"
    return F.expr("array(" + ", ".join(one.format(h=hashes, s=16 * b) for b in range(BLOCKS)) + ")")


def _hamming(a: str, b: str) -> Column:
    return F.expr(" + ".join(f"bit_count({a}[{i}] ^ {b}[{i}])" for i in range(BLOCKS)))


def _similarity(a: str, b: str) -> Column:
    both = f"aggregate(array_intersect({a}, {b}), 0, (n, x) -> n + least(size(filter({a}, y -> y = x)), size(filter({b}, y -> y = x))))"
    return F.expr(f"{both} / (size({a}) + size({b}) - {both})")


#: Parts over which rows of one text are dealt before one of them is kept.
SALTS = 16


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = 0.8, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``key, item, start, n_words, distance, similarity``: the best window of each document for each item it holds.

    ``start`` counts the words before the window. An item of fewer than five words is one shingle and is
    found where its words stand in a row; one without words, or null, is never found, and a null or empty
    text holds nothing. Equal texts are examined once, windows of long texts one by one. Keys may be null
    or repeat; each row of ``docs`` with a passage gives a row for each item. Other columns are not read.
    Without documents or items the result is empty.
    """
    listed = items.select(F.col(item_key).alias("item"), F.size(words(F.col(item_text))).alias("n_words"), item_shingles(F.col(item_text)).alias("item_shingles"))
    listed = settle(listed.where("n_words > 0").select("item", "n_words", "item_shingles", _blocks_sql("item_shingles").alias("item_blocks")), "item-prints")
    probe = listed.select("item", "n_words", F.posexplode("item_shingles").alias("item_at", "shingle"))
    if probe.count() <= BROADCAST_ROWS:
        probe = F.broadcast(probe)

    texts = docs.select(F.md5(F.coalesce(F.col(text), F.lit(""))).alias("digest"), F.col(text).alias("text"))
    each = texts.select("digest", F.posexplode(shingles(F.col("text"))).alias("at", "shingle"))
    met_long = each.join(probe.where(F.col("n_words") >= SHINGLE), "shingle")
    hits = settle(met_long.select("digest", "n_words", F.greatest(F.col("at") - F.col("item_at"), F.lit(0)).alias("start")).distinct(), "hits")

    wanted = hits.groupBy("digest").agg(F.collect_list(F.struct("start", "n_words")).alias("windows"))
    # hits grow with the corpus and the index with the benchmark: both are joined by sorting, whatever Spark guesses of their size;
    # rows of one text are dealt over several tasks, where all but one go
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS))
    salted = wanted.select("digest", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")).alias("salt"))
    some = texts.withColumn("salt", salt).join(salted.hint("merge"), ["digest", "salt"], "left_semi").dropDuplicates(["digest", "salt"]).drop("salt")
    some = some.dropDuplicates(["digest"]).join(wanted.hint("merge"), "digest")
    cut = f"explode(transform(windows, w -> struct(w.start as start, w.n_words as n_words, slice(shingles, w.start + 1, w.n_words - {SHINGLE - 1}) as window))) as w"
    window = some.select("digest", "windows", shingles(F.col("text")).alias("shingles")).selectExpr("digest", cut).select("digest", "w.*").where(F.size("window") > 0)
    for n in sorted(r["n_words"] for r in listed.where(F.col("n_words") < SHINGLE).select("n_words").distinct().collect()):  # four lengths at most
        short = texts.select("digest", F.posexplode(shingles(F.col("text"), n)).alias("at", "shingle")).join(probe.where(F.col("n_words") == n).select("shingle").distinct(), "shingle")
        first = short.groupBy("digest", "shingle").agg(F.min("at").alias("start"))
        window = window.union(first.select("digest", "start", F.lit(n).alias("n_words"), F.array("shingle").alias("window")))
    window = settle(settle(window, "windows").select("*", _blocks_sql("window").alias("blocks")), "window-prints")

    changes = f"filter(sequence(0, 65535), x -> bit_count(x) <= {RADIUS // BLOCKS})"
    variant = listed.select("item", "n_words", F.posexplode("item_blocks").alias("block", "value")).select("item", "n_words", "block", F.expr(f"explode(transform({changes}, x -> value ^ x))").alias("value"))
    # only windows of an item's own length meet it
    looked_up = window.select("digest", "start", "n_words", F.posexplode("blocks").alias("block", "value")).join(variant.hint("merge"), ["n_words", "block", "value"])
    near = looked_up.select("digest", "start", "n_words", "item").distinct().join(listed, ["item", "n_words"]).join(window, ["digest", "start", "n_words"])
    near = near.withColumn("distance", _hamming("blocks", "item_blocks")).where(F.col("distance") <= RADIUS)
    near = near.withColumn("similarity", _similarity("window", "item_shingles")).where(F.col("similarity") >= similarity)
    best = near.groupBy("digest", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("before"), "n_words", (-F.col("distance")).alias("nearness"))).alias("best"))
    keyed = docs.select(F.col(key).alias("key"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("digest"))
    return keyed.join(best, "digest").select("key", "item", (-F.col("best.before")).alias("start"), "best.n_words", (-F.col("best.nearness")).alias("distance"), "best.similarity")
