"""The stages of ``corpus_pipeline``: each takes and gives documents, the last gives windows of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare
from . import bpe, decontamination as leaks, packing as packer, quality as judge, simhash, suffix_dedup
from .queries import vocabulary
from .shared import settle, table

#: Repeated strings of at least so many bytes go; fifty words of prose are some 250 bytes or more.
PASSAGE_BYTES = 200


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Junk and abuse go, and documents without words (null and empty texts among them); every row is judged by its own text.

    Repeated rows and rows of one or no doc_id share nothing; an empty table stays empty; all columns are kept.
    """
    prepare(spark)
    model = judge.train(docs, table(spark, sf_dir, "labels"))
    return judge.score(docs, model, carry_row=True).where("keep").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal or near texts one row of the least doc_id stays; those without an id or words all stay.

    Of a repeated row one copy stays, of rows alike in id and text the first by their other columns, rows of one doc_id with different texts are apart; an empty table stays empty; all columns are kept.
    """
    prepare(spark)
    groups = settle(simhash.near_duplicate_groups(docs), "groups")
    # as many rows as there are copies: the same join at every size
    marked = docs.withColumn("__digest", F.md5("text"))
    gone = groups.where("not first or n > 1").select(F.col("key").alias("doc_id"), F.col("digest").alias("__digest"))
    stay = marked.join(gone.hint("merge"), ["doc_id", "__digest"], "left_anti")
    repeated = groups.where("first and n > 1").select(F.col("key").alias("doc_id"), F.col("digest").alias("__digest"))
    if repeated.limit(1).count():
        # of rows alike in id and text the first by all that they hold, whichever task meets them
        whole = F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in stay.columns])
        of_copies = marked.join(repeated.hint("merge"), ["doc_id", "__digest"], "left_semi").select(stay.columns).groupBy("doc_id", "__digest")
        stay = stay.union(of_copies.agg(F.min_by(whole, F.to_json(whole)).alias("__whole")).select("__whole.*"))
    return stay.select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats of ``PASSAGE_BYTES`` bytes or more are cut out; a character cut in two goes whole.

    No row goes: a null text becomes an empty one, rows without a doc_id lose nothing, of a repeated row one copy stays whole. ``n_chars``
    follows the text if there is such a column; all other columns are kept; an empty table stays empty.
    """
    prepare(spark)
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    packed = docs.select("doc_id", "text", *[F.struct(*[F.col(f"`{c}`") for c in others]).alias("__rest") for _ in others[:1]])
    kept = suffix_dedup.remove_repeats(packed, PASSAGE_BYTES, carry=tuple(packed.columns[2:]), whole_characters=True)
    text = F.col("kept").cast("string")
    made = {"doc_id": F.col("key").cast(docs.schema["doc_id"].dataType), "text": text, "n_chars": F.length(text).cast("long")} | {c: F.col(f"__rest.`{c}`") for c in others}
    return kept.select(*[made[c].alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; every row is judged by its own text.

    Null and empty texts hold nothing and stay, as do all rows if there is no item with words; repeated rows share their text's fate, rows of one
    or no doc_id nothing else; an empty table stays empty; all columns are kept.
    """
    prepare(spark)
    marked = docs.withColumn("__digest", F.md5(F.coalesce("text", F.lit(""))))
    found = settle(leaks.contaminated(marked, table(spark, sf_dir, "benchmark"), key="__digest").select(F.col("key").alias("__digest")).distinct(), "leaks")
    return marked.join(found, "__digest", "left_anti").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of at most 2048 ids of what is left, a row for each piece.

    A null or empty text is its end id alone; repeated rows and rows of one or no doc_id are packed each by itself; an empty table gives no row.
    """
    prepare(spark)
    pieces = packer.pack(docs, bpe.tokenizer_text(vocabulary("byte_bpe_50k.json")), end_id=1, width=2048)
    return pieces.select(F.col("key").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("long").alias("length"), "ids", F.col("key_tokens").alias("doc_tokens"), "sequence_id", "offset")
