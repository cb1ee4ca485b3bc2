"""The ten operators against plain Python over whole small tables, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import bpe, components, decontamination, language, packing, quality, queries, sharding, simhash, suffix_dedup, token_counts, token_output, vector_search

TOKENS = "byte_bpe_50k.json"


def docs_of(spark, sf_dir):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def odd(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(k, t, "x", 1, "y") for k, t in rows], "doc_id long, text string, key string, n long, ids string")


ODD = [(1, None), (2, ""), (3, "  \n"), (4, "one"), (5, "the same words here again and more"), (6, "the same words here again and more"), (6, "the same words here again and more"), (None, "no key at all"), (7, "é" * 400), (8, "long words " * 4000), (9, "\U0001f600 smile")]


def libraries():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary(TOKENS))


def union_find(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# 1

def test_token_counts_match_the_library(spark, small):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = token_counts.zipf_vocabulary(queries.vocabulary("piece_bpe_32k.model"))
    unknown = min(s for _, s in vocabulary) - 1000
    library = Tokenizer(models.Unigram([("<none>", unknown), *vocabulary], unk_id=0))
    library.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always")
    theirs = {k: len(library.encode(t or "", add_special_tokens=False).ids) for k, t in docs_of(spark, small)}
    mine = {r["doc_id"]: r["n_tokens"] for r in queries.op1_token_counts(spark, small).collect()}
    assert mine.keys() == theirs.keys()
    assert sum(mine[k] != theirs[k] for k in mine) == 0


@given(st.text("abc", max_size=12))
@settings(max_examples=100, deadline=None)
def test_token_counts_take_the_best_path(word):
    vocabulary = [("a", -1.0), ("b", -2.0), ("ab", -2.5), ("ba", -3.5), ("aba", -3.7), ("bb", -3.9)]
    scores, unknown = dict(vocabulary), -3.9 - token_counts.UNKNOWN_PENALTY
    best = [(0.0, 0, False)] + [(-math.inf, 0, False)] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            piece = word[start:end]
            score = scores.get(piece, unknown if end - start == 1 else None)
            if score is not None and best[start][0] + score > best[end][0]:
                is_unknown = piece not in scores
                best[end] = (best[start][0] + score, best[start][1] + (not (is_unknown and best[start][2])), is_unknown)
    assert token_counts.PieceCounter(vocabulary).count(word) == best[-1][1]


# 2

def test_quality_agrees_with_labels(spark, medium):
    rows = queries.op2_quality_classifier(spark, medium).join(spark.read.parquet(f"{medium}/labels.parquet").withColumnsRenamed({"quality": "good", "toxic": "bad"}), "doc_id").collect()
    wanted = [r["good"] == 1 and r["bad"] == 0 for r in rows]
    kept = [r["keep"] for r in rows]
    assert len(rows) > 100
    assert sum(a == b for a, b in zip(wanted, kept, strict=True)) / len(rows) > 0.95
    toxic = [k for k, r in zip(kept, rows, strict=True) if r["bad"] == 1]
    assert sum(not k for k in toxic) >= 0.7 * len(toxic)
    assert sum(k for k, w in zip(kept, wanted, strict=True) if w) >= 0.99 * sum(wanted)


def test_expectation_maximisation_finds_accurate_labellers():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.3
    accuracy = (0.95, 0.9, 0.6)
    votes = Counter(tuple(int(quality.BAD if (b if rng.random() < a else not b) else quality.GOOD) for a in accuracy) for b in truth.tolist())
    posterior = quality.expect_maximise(votes)
    assert posterior[(2, 2, 0)] > 0.9 and posterior[(0, 0, 2)] < 0.1
    assert quality.expect_maximise(Counter()) == {}


# 3

def test_language_accuracy_on_held_out_documents(spark, medium):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{medium}/documents.parquet").collect()}
    rows = queries.op3_language_id(spark, medium).collect()
    assert {r["doc_id"] for r in rows} == set(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"] and truth[r["doc_id"]] and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_codewords_are_far_apart():
    for n in (2, 4, 7, 20):
        code = language.codewords(n)
        apart = [int((a != b).sum()) for i, a in enumerate(code) for b in code[:i]]
        assert min(apart) >= (1 if n == 2 else code.shape[1] // 4)


# 4

def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x, seed=42) for x in runs]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    root = union_find(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    least = {}
    for (k, _), r in zip(rows, root, strict=True):
        least[r] = min(least.get(r, k), k)
    return {k: (f"{p:016x}", least[r]) for (k, _), p, r in zip(rows, prints, root, strict=True)}


def test_simhash_groups_match_all_pairs(spark, small):
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op4_simhash_dedup(spark, small).collect()}
    assert found == plain_components(docs_of(spark, small))


def test_near_links_join_all_within_the_radius(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**63, 60)]
    prints = sorted({b ^ sum(1 << int(x) for x in rng.choice(64, int(n), replace=False)) for b in base for n in rng.integers(0, 6, 8)})
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    links = simhash.near_links(spark.createDataFrame([(s, s) for s in signed], "node long, fp0 long"), 64, 4).collect()
    at = {s: i for i, s in enumerate(signed)}
    mine = union_find(len(prints), [(at[r["a"]], at[r["b"]]) for r in links])
    assert mine == union_find(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])


def test_near_duplicates_match_exact_similarity(spark, small):
    rows = docs_of(spark, small)

    def shingles(text):
        w = simhash.words_of(text)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    rows = [(k, t) for k, t in rows if simhash.words_of(t)]
    sets = [shingles(t) for _, t in rows]
    root = union_find(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    wanted = Counter(Counter(root).values())
    found = Counter(Counter(r["group"] for r in simhash.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()).values())
    assert found == wanted


def test_components_of_a_chain_and_none(spark):
    found = components.connected_components(spark.createDataFrame([(i, i + 1) for i in range(40)] + [(99, 98), (5, 5), (None, 3)], "a long, b long"))
    assert {(r["node"], r["root"]) for r in found.collect()} == {(i, 0) for i in range(41)} | {(98, 98), (99, 98)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 5

def test_vector_search_is_exact(spark, small):
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    found = defaultdict(list)
    for r in queries.op5_vector_search(spark, small).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    x, keys = np.array([v for _, v in rows]), np.array([k for k, _ in rows])
    for k, v in rows:
        if k % 20 == 0:
            score = x @ v
            order = [i for i in np.lexsort((keys, -score)) if keys[i] != k][:20]
            assert [f[0] for f in found.pop(k)] == keys[order].tolist()
    assert not found


def test_vector_search_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0, 0.0]), (7, [0.5, 0.5]), (7, [0.5, 0.5]), (8, [])]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "vec_id long, embedding array<float>, score string")
    found = [tuple(r) for r in vector_search.nearest(frame, frame.where("vec_id in (1, 2, 3)"), k=5).orderBy("rank").collect()]
    assert [(f[0], f[2]) for f in found][:2] == [(1, 6), (1, 7)] and {f[0] for f in found} == {1}
    assert vector_search.nearest(frame.limit(0), frame).count() == 0


# 6 and 10

def test_packing_holds_every_id_once(spark, small):
    library, rows = libraries(), docs_of(spark, small)
    ids = {k: library.encode(t or "", add_special_tokens=False).ids + [1] for k, t in rows}
    pieces = queries.op6_packing(spark, small).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert by_doc.keys() == ids.keys()
    for k, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            cut = np.array(ids[k][p["start"] : p["start"] + p["length"]], "<u4")
            assert (p["start"], p["doc_tokens"], p["ids_crc32"]) == (at, len(ids[k]), zlib.crc32(cut.tobytes()))
            at += p["length"]
        assert at == len(ids[k])
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
    assert len(by_sequence) <= sum(map(len, ids.values())) / 2048 * 1.02 + 9


@given(st.lists(st.integers(1, 50), max_size=60))
@settings(max_examples=100, deadline=None)
def test_best_fit_takes_the_tightest_window(lengths):
    used, wanted = [], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [w for w, u in enumerate(used) if u + lengths[i] <= 50]
        w = max(fits, key=lambda w: used[w], default=None)
        if w is None:
            used.append(0)
            w = len(used) - 1
        wanted[i] = used[w]
        used[w] += lengths[i]
    places = packing.best_fit_decreasing(lengths, 50)
    assert [o for _, o in places] == wanted
    assert len({w for w, _ in places}) == len(used)


def test_token_files_round_trip(spark, small):
    library, start = libraries(), 0
    found = {r["doc_id"]: r for r in queries.op10_token_output(spark, small).collect()}
    rows = sorted(docs_of(spark, small))
    assert len(found) == len(rows)
    for k, t in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        assert (found[k]["start"], found[k]["n_tokens"], found[k]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=50))
@settings(max_examples=100, deadline=None)
def test_ranks_round_trip(ranks):
    x = np.array(ranks, "<u4")
    assert token_output.unpack_ranks(token_output.pack_ranks(x), len(x)).tolist() == ranks


@given(st.text(max_size=60) | st.text("ab .,'!\n\té1", max_size=60))
@settings(max_examples=300, deadline=None)
def test_encoder_equals_the_library(text):
    e = bpe.encoder(bpe.tokenizer_text(queries.vocabulary(TOKENS)))
    assert np.frombuffer(e.encode([text])[0], e.dtype).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


# 7

def test_shards_are_even_and_gapless(spark, medium):
    text = dict(docs_of(spark, medium))
    rows = queries.op7_sharding(spark, medium).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(text)
    shards = defaultdict(list)
    for r in rows:
        raw = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        shards[r["shard"]].append(r)
    assert set(shards) == set(range(8))
    assert all(sorted(r["slot"] for r in own) == list(range(len(own))) for own in shards.values())
    sizes = [sum(r["size"] for r in own) for own in shards.values()]
    assert max(sizes) - min(sizes) <= 0.05 * sum(sizes) / 8 + max(r["size"] for r in rows)
    of_text = defaultdict(list)
    for r in rows:
        of_text[text[r["doc_id"]]].append(r)
    # heavier groups may be dealt over several ranges
    light = [own for own in of_text.values() if sum(r["size"] for r in own) * 32 * 8 <= sum(sizes)]
    assert len(light) > 500 and any(len(own) > 1 for own in light)
    assert all(len({r["shard"] for r in own}) == 1 for own in light)


def test_a_heavy_group_is_split(spark):
    from pyspark.sql import functions as F

    frame = spark.range(3000).select(F.col("id").alias("key"), F.when(F.col("id") < 1500, "hot").otherwise(F.col("id").cast("string")).alias("group"), F.lit(10).alias("size"))
    placed = sharding.shard_by_size(frame, 4, F.col("group"), F.col("size"), F.col("key"))
    assert placed.columns == ["key", "group", "size", "shard", "slot"]
    n = Counter(r["shard"] for r in placed.collect())
    assert sum(n.values()) == 3000 and max(n.values()) < 1.15 * 750
    assert sharding.shard_by_size(frame.limit(0), 4, F.col("group"), F.col("size"), F.col("key")).count() == 0


# 8

def plain_words(text):
    return [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]


def plain_leaks(documents, items):
    def runs(words, n=5):
        return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]

    listed = {k: plain_words(t) for k, t in items}
    found = set()
    for k, t in documents:
        words = plain_words(t)
        for item, own in listed.items():
            if 0 < len(own) < 5 and tuple(own) in runs(words, len(own)):
                found.add((k, item))
        own = runs(words)
        where = defaultdict(set)
        for i, x in enumerate(own):
            where[x].add(i)
        for item, wanted in ((i, runs(w)) for i, w in listed.items()):
            starts = {max(0, at - j) for j, x in enumerate(wanted) for at in where.get(x, ())}
            for s in starts:
                a, b = Counter(own[s : s + len(wanted)]), Counter(wanted)
                both = sum((a & b).values())
                if both >= 0.8 * (a.total() + b.total() - both) - 1e-12:
                    found.add((k, item))
    return found


def test_decontamination_matches_all_windows(spark, small, medium):
    for d in (small, medium):
        items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
        found = {(r["doc_id"], r["item_id"]) for r in queries.op8_decontamination(spark, d).collect()}
        assert found == plain_leaks(docs_of(spark, d), items)


# 9

def plain_removals(rows, length=100):
    seen, gone = {}, {}
    for k, t in sorted(rows, key=lambda r: r[0]):
        data = (t or "").encode()
        mask = bytearray(len(data))
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if w in seen:
                mask[i : i + length] = b"\1" * length
            else:
                seen[w] = True
        spans = len(re.findall(rb"\x01+", bytes(mask)))
        gone[k] = (len(data), sum(mask), spans, hashlib.sha256(bytes(b for b, m in zip(data, mask, strict=True) if not m)).hexdigest())
    return gone


def test_suffix_dedup_matches_all_strings(spark, small):
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op9_suffix_dedup(spark, small).collect()}
    assert found == plain_removals(docs_of(spark, small))


@pytest.mark.parametrize("hot", [200_000, 2])
def test_suffix_dedup_of_hard_texts(spark, hot):
    rng = np.random.default_rng(5)
    passage = "".join(chr(97 + int(x)) for x in rng.integers(0, 26, 300))
    rows = [(i, "".join(chr(97 + int(x)) for x in rng.integers(0, 26, 60)) + passage[int(rng.integers(0, 150)) : int(rng.integers(150, 300))] + "q" * int(rng.integers(0, 300))) for i in range(30)]
    rows += [(100, None), (101, ""), (102, "ab" * 400), (103, "ab" * 300), (104, "é" * 99), (105, "é" * 300), (106, passage * 3)]
    kept = suffix_dedup.remove_repeats(odd(spark, rows), 100, hot_bucket=hot).collect()
    found = {r["key"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in kept}
    assert found == plain_removals(rows)


# edges of all

def test_odd_rows_and_empty_tables(spark):
    tokenizer = bpe.tokenizer_text(queries.vocabulary(TOKENS))
    vocabulary = [("▁the", -1.0), ("e", -2.0)]
    items = spark.createDataFrame([(1, "the same words here again and more"), (2, None), (None, "of fewer")], "item_id long, text string")
    runs = {
        "counts": lambda d: token_counts.count_pieces(d, vocabulary),
        "quality": lambda d: quality.score(d, quality.train(d), carry_row=True),
        "language": lambda d: language.identify(d, language.train(d, lang="key"), carry=("n",)),
        "simhash": lambda d: simhash.simhash_groups(d),
        "packing": lambda d: packing.pack(d, tokenizer, 1).where("start = 0"),
        "suffix": lambda d: suffix_dedup.remove_repeats(d),
        "tokens": lambda d: token_output.read_token_files(token_output.write_token_files(d, tokenizer, 0)),
    }
    frame = odd(spark, ODD)
    for name, run in runs.items():
        assert run(frame).count() == len(ODD), name
        assert run(frame.limit(0)).count() == 0, name
    leaks = decontamination.contaminated(frame, items)
    assert sorted((r["key"], r["item"]) for r in leaks.collect()) == [(5, 1), (6, 1), (6, 1)]
    assert decontamination.contaminated(frame, items.limit(0)).count() == 0
    groups = {(r["key"], r["group"]) for r in simhash.near_duplicate_groups(frame).collect()}
    assert {(5, 5), (6, 5), (4, 4), (8, 8)} <= groups and not {k for k, _ in groups} & {1, 2, 3, None}
    assert simhash.near_duplicate_groups(frame.limit(0)).count() == 0
