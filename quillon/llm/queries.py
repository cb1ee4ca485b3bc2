"""The queries of this subpackage, over the whole tables of a folder, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, decontamination, hard_negatives, jaccard_join, language, packing, quality, sharding, simhash, suffix_dedup, token_counts, token_output, vector_search
from .shared import settle, table, widened

#: Where the vocabulary files are; see ``vocabulary``.
VOCABULARY_DIR = os.environ.get("QUILLON_TOKENIZERS", "/opt/tokenizers")


def vocabulary(name: str) -> str:
    try:
        import public_tokenizers
    except ImportError:
        return os.path.join(VOCABULARY_DIR, name)
    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_pieces(widened(table(spark, sf_dir, "documents")), token_counts.zipf_vocabulary(vocabulary("piece_bpe_32k.model")))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = widened(table(spark, sf_dir, "documents"))
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    docs = widened(table(spark, sf_dir, "documents")).withColumn("held_out", held_out)
    model = language.train(docs.where(~F.col("held_out")))
    return language.identify(docs, model, carry=("held_out",))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(widened(table(spark, sf_dir, "documents")), shingle=3, radius=2)
    return groups.select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = settle(docs.select("doc_id", sharding.text_size(F.col("text")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash")), "sizes")
    placed = sharding.shard_by_size(rows, 8, F.col("text_hash"), F.col("size"), F.col("doc_id"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(widened(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return found.withColumnsRenamed({"key": "doc_id", "item": "item_id"})


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=100)
    return kept.select(F.col("key").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vector_search.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20, factor=1.0)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), bpe.tokenizer_text(vocabulary("byte_bpe_50k.json")), end_id=1, width=2048)
    return pieces.select(
        F.col("key").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"),
        F.col("key_tokens").alias("doc_tokens"), "sequence_id", "offset",
    )


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = token_output.write_token_files(widened(table(spark, sf_dir, "documents")), bpe.tokenizer_text(vocabulary("byte_bpe_50k.json")), end_id=0)
    return token_output.read_token_files(written).select(F.col("key").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.hard_negatives(moved, moved.where("vec_id % 100 = 0"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = jaccard_join.jaccard_groups(widened(table(spark, sf_dir, "documents")), shingle=3, percent=90)
    return groups.select(F.col("key").alias("doc_id"), F.col("n_shingles").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(widened(table(spark, sf_dir, "documents")), least=30, longest=4, top=2000, covered=80)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_token_counts": op1_token_counts, "op2_quality_classifier": op2_quality_classifier, "op3_language_id": op3_language_id, "op4_simhash_dedup": op4_simhash_dedup, "op5_vector_search": op5_vector_search, "op6_packing": op6_packing, "op7_sharding": op7_sharding, "op8_decontamination": op8_decontamination, "op9_suffix_dedup": op9_suffix_dedup, "op10_token_output": op10_token_output, "op11_hard_negatives": op11_hard_negatives, "op12_jaccard_join": op12_jaccard_join, "op13_collocations": op13_collocations}


HARD_NEGATIVES = """
with rows as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
    from embeddings where label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
scored as (
    select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::bigint as score
    from rows a join rows b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
),
positives as (select anchor_id, other_id as positive_id, score as positive_score from scored where same qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, other_id)::int as rank, other_id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id) where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, other_id) <= 5
"""

#: A-Z in lower case and nothing else.
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD_JOIN = f"""
with recursive cut as (select doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') as w from documents),
sets as (
    select doc_id, case when w is null or len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
        else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s from cut
),
each as (select doc_id, len(s) as n, unnest(s) as shingle from sets),
shared as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as n, any_value(b.n) as m, count(*) as in_both from each a join each b on a.shingle = b.shingle and a.doc_id < b.doc_id and 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n) group by 1, 2),
links as (select a, b from shared where 100 * in_both >= 90 * (n + m - in_both)),
either as (select a, b from links union select b, a from links),
reach as (select doc_id, doc_id as root from sets union select r.doc_id, e.b from reach r join either e on r.root = e.a and e.b < r.doc_id)
select doc_id, len(s) as n_shingles, root as component_id from sets join (select doc_id, min(root) as root from reach group by 1) using (doc_id)
"""

COLLOCATIONS = f"""
with pieces as (
    select row_number() over () as piece, lang, p from (
        select coalesce(lang, 'und') as lang, unnest(string_split_regex({LOWER}, '[.,;:!?\\x0A-\\x0D]')) as p from documents where text is not null)
),
cut as (select lang, regexp_extract_all(p, '[^\\x20\\x09]+') as w from pieces),
grams as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) as phrase from cut, (select unnest([1, 2, 3, 4]) as k)),
f as (select lang, k, phrase, count(*) as f from grams group by all),
totals as (select lang, sum(f)::bigint as n from f where k = 1 group by 1),
c as (select lang, k as size, phrase, f as a, string_split(phrase, ' ') as w from f where k > 1 and f >= 30),
cuts as (select lang, phrase, a, size, unnest(range(1, size)) as k, w from c),
scored as (
    select x.lang, x.phrase, x.a, x.k, l.f as l, r.f as r, ((2000000::hugeint * x.a) // (l.f::hugeint + r.f))::bigint as score
    from cuts x join f l on l.lang = x.lang and l.phrase = array_to_string(x.w[1 : x.k], ' ') and l.k = x.k
    join f r on r.lang = x.lang and r.phrase = array_to_string(x.w[x.k + 1 :], ' ') and r.k = x.size - x.k
),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_phrases as (select lang, a, array_to_string(w[i : i + m - 1], ' ') as phrase from c, (select unnest(range(1, 4)) as i), (select unnest([2, 3]) as m) where m < size and i + m - 1 <= size),
longer as (select lang, phrase, max(a) as longer from inner_phrases group by 1, 2)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from best left join longer using (lang, phrase) join totals using (lang) where longer is null or 100 * longer::hugeint < 80 * a::hugeint
qualify rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_hard_negatives": HARD_NEGATIVES, "op12_jaccard_join": JACCARD_JOIN, "op13_collocations": COLLOCATIONS}
