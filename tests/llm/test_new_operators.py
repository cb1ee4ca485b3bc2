"""Hard negatives, the Jaccard join and collocations against plain Python, with hot keys, ties, odd rows; mended searches and anchors."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from compare import connect, differ

from quillon.llm import collocations, hard_negatives, jaccard_join, queries, suffix_dedup, vector_search

LONG = 2**63


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, small, name):
    assert differ(queries.queries()[name](spark, small), connect(small), queries.oracle_sql()[name]) == ""


# 11

def mined(rows, anchors, low=80, high=100, k=5):
    whole = [(key, label, [math.floor(256 * x) for x in v]) for key, label, v in rows]
    out = []
    for key, label, v in (w for w in whole if w[0] in anchors):
        scored = sorted((-max(min(sum(a * b for a, b in zip(v, w, strict=True)), LONG - 1), -LONG), other, other_label) for other, other_label, w in whole if other != key and len(w) == len(v))
        for p, positive, _ in [t for t in scored if t[2] == label][:k]:
            hard = [t for t in scored if t[2] != label and low * -p <= 100 * -t[0] <= high * -p][:k]
            out += [(key, positive, n, t[1], -p, -t[0]) for n, t in enumerate(hard, 1)]
    return sorted(out)


def test_hard_negatives_equal_all_products(spark):
    rng = np.random.default_rng(3)
    rows = []
    for key in range(260):
        x = rng.normal(size=8) * np.array([4, 3, 1, 1, 0.1, 0.1, 0.01, 0.01])
        x = x * (1e7 if key % 50 == 0 else 1e9 if key % 51 == 0 else 1)
        rows.append((key, int(rng.integers(3)), (np.zeros(8) if key % 13 == 0 else np.full(8, 0.5) if key % 10 < 4 else x).tolist()))
    rows += [(key, 1 + key % 2, [1.0, 2.0]) for key in range(300, 312)]
    schema = "vec_id long, label int, embedding array<double>, score long, row int"
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], schema).repartition(4)
    odd = [(None, 1, [1.0] * 8), (900, None, [1.0] * 8), (901, 1, None), (902, 1, [math.nan] * 8), (903, 1, [1.0, None]), (904, 2, []), (910, 1, []), (920, 1, [math.inf] * 8)]
    frame = frame.union(spark.createDataFrame([(*r, 1, 2) for r in odd], schema))
    found = hard_negatives.hard_negatives(frame, frame.where("vec_id % 10 = 0"), shard_bytes=4000, block_rows=4)
    assert sorted(map(tuple, found.collect())) == mined(rows + [(904, 2, []), (910, 1, [])], {r[0] for r in rows if r[0] % 10 == 0} | {910})
    assert hard_negatives.hard_negatives(frame.limit(0), frame).count() == hard_negatives.hard_negatives(frame, frame.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, 1, [1.0]), (2, 1, [1.0]), (2, 1, [1.0]), (3, 2, [1.0]), (3, 2, [1.0])], "vec_id long, label int, embedding array<double>")
    assert sorted(tuple(r)[1:4] for r in hard_negatives.hard_negatives(twice, twice.where("vec_id = 1")).collect()) == [(2, 1, 3), (2, 1, 3), (2, 2, 3), (2, 2, 3)]


def test_bounds_never_drop_what_may_reach():
    rng = np.random.default_rng(4)
    whole = np.floor(rng.normal(size=(80, 16)) * 10.0 ** rng.integers(0, 12, size=(80, 1)))
    axes = np.linalg.qr(rng.normal(size=(16, 16)))[0]
    side = hard_negatives.Side.of(whole, axes)
    exact = np.array([[sum(int(p) * int(q) for p, q in zip(a, b, strict=True)) for b in whole] for a in whole], object)
    for at in (0, 20, 60):
        low = np.array([float(sorted(row)[at]) for row in exact])
        i, j = hard_negatives.may_reach(side, side, hard_negatives._below(low), None, float(np.abs(axes.T @ axes - np.eye(16)).sum()))
        kept = set(zip(i.tolist(), j.tolist(), strict=True))
        assert {(a, b) for a in range(80) for b in range(80) if exact[a][b] >= sorted(exact[a])[at]} <= kept


# 12

def alike(docs, shingle=3, percent=90):
    """key -> set size and least key reached, over all pairs."""
    sets = []
    for _, text in docs:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
        sets.append({" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else {" ".join(w)} if w else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(docs)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            root[find(j)] = find(i)
    least = {}
    for i, (key, _) in enumerate(docs):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return Counter((key, len(s), least.get(find(i)) if s else key) for i, ((key, _), s) in enumerate(zip(docs, sets, strict=True)))


@pytest.mark.parametrize("percent", [90, 60, 100])
def test_jaccard_groups_equal_all_pairs(spark, percent):
    rng = random.Random(percent)
    vocabulary = [f"w{i}" for i in range(300)]
    docs, key = [], 0
    for _ in range(14):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([2, 3, 4, 11, 12, 13, 30, 80, 400]))]
        for _ in range(rng.randrange(1, 14)):
            copy = list(base)
            for _ in range(rng.randrange(0, 2 + len(base) // 12)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append((key, " ".join(copy[: len(copy) - rng.randrange(3)])))
            key += 1
    docs += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "One"), (1004, "one"), (1005, "ONE two"), (1005, "one TWO"), (None, "one two"), (None, "lone row with no key"), (1006, "x " * 9000), (1007, "X " * 7000), (1008, "é" * 500)]
    frame = spark.createDataFrame([(k, t, 1, "n", 2) for k, t in docs], "doc_id long, text string, size int, node string, own int").repartition(3)
    found = jaccard_join.jaccard_groups(frame, percent=percent)
    assert Counter((r["key"], r["n_shingles"], r["component"]) for r in found.collect()) == alike(docs, percent=percent)
    assert jaccard_join.jaccard_groups(frame.limit(0)).count() == 0


def test_similar_sets_share_a_word():
    rng = np.random.default_rng(5)
    for percent in (60, 90, 97):
        bands = jaccard_join.Bands(percent)
        for size in (1, 2, 9, 10, 19, 50, 300, 2000):
            for _ in range(20):
                a = rng.integers(0, 2**63, size).astype(np.uint64)
                apart = int(rng.integers(0, max(1, size * (100 - percent) // 100) + 1))
                b = np.unique(np.r_[a[apart // 2 :], rng.integers(0, 2**63, apart - apart // 2).astype(np.uint64)])
                a = np.unique(a)
                both = len(np.intersect1d(a, b))
                if not len(b) or 100 * both < percent * (len(a) + len(b) - both):
                    continue
                scheme = int(bands.of(min(len(a), len(b))))
                assert scheme in bands.schemes(len(a)) and scheme in bands.schemes(len(b))
                x, y = (jaccard_join.parity_words(s, bands.words(scheme)) for s in (a, b))
                assert (x == y).any()
                most = jaccard_join.most_apart(len(a) + len(b), percent)
                assert np.bitwise_count(x ^ y).sum(dtype=np.int64) <= most
                x, y = (np.frombuffer(jaccard_join.folded(w), "<u8") for w in (x, y))
                assert np.bitwise_count(x ^ y).sum(dtype=np.int64) <= most


# 13

def phrases(docs, least, longest, top, covered):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, longest + 1):
                counts[lang].update(" ".join(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if a >= least and " " in p}
        kept = []
        for p, a in found.items():
            w = p.split(" ")
            if any(100 * b >= covered * a and f" {p} " in f" {q} " and q != p for q, b in found.items()):
                continue
            cuts = [(2_000_000 * a // (f[" ".join(w[:k])] + f[" ".join(w[k:])]), k, f[" ".join(w[:k])], f[" ".join(w[k:])]) for k in range(1, len(w))]
            score, _, left, right = min(cuts)
            kept.append((-score, -a, p.encode(), left, right))
        out += [(lang, n, p.decode(), -a, left, right, total[lang], -score) for n, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("longest", "words"), [(4, 1 << 20), (4, 40), (2, 1 << 20), (3, 25)])
def test_collocations_equal_plain_counts(spark, longest, words):
    rng = random.Random(words)
    vocabulary = ["a", "b", "C", "é", "dd", "x y", "q\x00", "-"]
    docs = [(rng.choice(["en", "fr", None, "und"]), "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "!?", "\x0b"]) for _ in range(rng.randrange(60)))) for _ in range(60)]
    docs += [("en", None), ("en", ""), ("xx", "..!\n"), ("en", "the hot pair " * 300), ("en", "a b c d " * 400)]
    frame = spark.createDataFrame([(lang, text, "n", 1, 2) for lang, text in docs], "lang string, text string, phrase string, n int, shard int").repartition(3)
    cut = collocations.shards_of(frame.selectExpr("coalesce(lang, 'und') as lang", "cast(text as binary) as text").where("text is not null"), longest, words)
    assert words > 100 or cut.count() > 3
    found = collocations.collocations(frame, least=5, longest=longest, top=20, shard_words=words)
    assert sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in found.collect()) == phrases(docs, 5, longest, 20, 80)
    assert collocations.collocations(frame.limit(0)).count() == 0


# 5

def test_one_long_vector_spoils_no_search(spark):
    rng = np.random.default_rng(6)
    for scale in (np.where(np.arange(900) == 5, 1e8, 1.0), 10.0 ** rng.uniform(-6, 10, 900), np.full(900, 1e-6), np.where(np.arange(900) < 3, 1e38, 1.0)):
        x = rng.normal(size=(900, 16)) * scale[:, None]
        x[40:60] = x[40]  # ties across leaves
        frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = defaultdict(list)
        for r in vector_search.nearest(frame, frame.where("vec_id % 9 = 0"), k=10, shard_rows=400, block_rows=32).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append(r["vec_id"])
        for q in range(0, 900, 9):
            score = (x * x[q]).sum(1)
            want = [i for i in np.lexsort((np.arange(900), -score)).tolist() if i != q][:10]
            assert got[q] == want


# 9

def test_anchors_hang_on_the_window_alone(monkeypatch):
    rng = np.random.default_rng(7)
    monkeypatch.setattr(suffix_dedup, "_anchor_hashes", lambda data: (suffix_dedup._BYTE[data][: len(data) - suffix_dedup.ANCHOR + 1] >> np.uint64(62)) << np.uint64(62))
    text = rng.integers(97, 123, 400).astype(np.uint8).tobytes()
    pieces = [text, rng.integers(97, 123, 9000).astype(np.uint8).tobytes() + text[100:350]]
    of = []
    for p in pieces:
        c = suffix_dedup.cells_of([p], 100)
        of.append({p[i : i + 100]: int(at) - i for lo, hi, at in zip(c.lo, c.hi, c.at, strict=True) for i in range(int(lo), int(hi) + 1)})
    shared = of[0].keys() & of[1].keys()
    assert len(shared) == 151 and all(of[0][w] == of[1][w] for w in shared)


def test_links_for_the_highest_bit_are_kept():
    from quillon.llm import simhash

    sketch = np.zeros((2, 2), np.uint64)
    sketch[1, 0] = np.uint64(1) << np.uint64(63) | np.uint64(1)
    rows = np.column_stack([np.full(2, 7), [1, 2], np.full(2, 100 << 32), [1, 2], sketch.view(np.int64)])
    assert [p.tolist() for p in simhash.run_pairs(rows, 0.8)] == [[[1, 2]]]


# 2

def test_quality_on_labels_it_did_not_learn_from(spark, medium):
    from pyspark.sql import functions as F

    from quillon.llm import quality

    docs, labels = (spark.read.parquet(f"{medium}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = quality.score(docs, quality.train(docs, labels.where(~held))).select("doc_id", "keep").join(labels.where(held), "doc_id").collect()
    clean = [r["keep"] for r in found if r["quality"] == 1 and not r["toxic"]]
    bad = [r["keep"] for r in found if r["quality"] == 0 or r["toxic"]]
    assert len(clean) > 40 and sum(clean) >= 0.98 * len(clean)
    assert len(bad) > 10 and sum(bad) <= 0.2 * len(bad)


# pipeline

def test_of_rows_alike_in_id_and_text_the_first_stays(spark, small):
    from quillon.llm import stages

    text = "one text of rather many words that is here more than once"
    rows = [(1, text, lang, source) for lang, source in (("b", "z"), ("a", "y"), ("a", "x"))] + [(2, "another text of its own with words enough", None, "w")]
    for order in (rows, rows[::-1]):
        found = stages.near_duplicates(spark, spark.createDataFrame(order, "doc_id long, text string, lang string, source string").repartition(3), small)
        assert sorted(tuple(r) for r in found.collect()) == [(1, text, "a", "x"), rows[-1]]
