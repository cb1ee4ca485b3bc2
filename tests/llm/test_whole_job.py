"""Cases in which an operator of this subpackage once did less than its whole job."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from test_llm_queries import union_find

from quillon.llm import bpe, decontamination, language, quality, queries, sharding, simhash, stages, suffix_dedup, vector_search


def shingle_sets(texts, n=5):
    words = [simhash.words_of(t) for t in texts]
    return [{tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or {tuple(w)} for w in words]


def all_pairs(rows, similarity=0.8):
    """The least key of each text's group, by comparison of all pairs."""
    sets = shingle_sets([t for _, t in rows])
    links = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9]
    root = union_find(len(rows), links)
    least: dict[int, int] = {}
    for (k, _), r in zip(rows, root, strict=True):
        least[r] = min(least.get(r, k), k)
    return {k: least[r] for (k, _), r in zip(rows, root, strict=True)}


def varied(rng, n=60):
    """Texts of 20 to 600 words, each with a copy that has a passage added, cut or edited; and texts that share a passage only."""
    words = [f"w{i}" for i in range(4000)]

    def prose(k):
        return [words[min(int(x), 3999)] for x in rng.zipf(1.3, k)]

    line, rows = prose(12), []
    for i in range(n):
        own = prose(int(rng.choice([20, 60, 100, 300, 600])))
        k = max(1, round(len(own) * float(rng.choice([0.1, 0.15, 0.2, 0.22, 0.25]))))
        near = {0: own + prose(k), 1: prose(k) + own, 2: own[: len(own) - k], 3: [w if rng.random() > 0.02 else "new" for w in own]}[i % 4]
        rows += [own, near, line + prose(15)]
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def test_no_near_link_is_missed(spark):
    rows = varied(np.random.default_rng(11))
    wanted = all_pairs(rows)
    assert sum(k != g for k, g in wanted.items()) > 25
    found = simhash.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["key"]: r["group"] for r in found} == wanted


def test_fingerprints_link_near_texts(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = [[f"w{x}" for x in rng.integers(0, 50_000, 300)] for _ in range(30)]
    # near copies, one word changed and another put elsewhere; then the same words in another order, with no shingle left
    near = [[*w[:100], "new", *w[101:150], *w[151:], w[150]] if i < 25 else w[::-1] for i, w in enumerate(words)]
    rows = [(2 * i + j, " ".join(w)) for i, own in enumerate(zip(words, near, strict=True)) for j, w in enumerate(own)]
    prints = [int.from_bytes(simhash.word_fingerprint(simhash.words_of(t)), "little", signed=True) for _, t in rows]
    apart = [[((prints[i] ^ prints[j]) & 2**64 - 1).bit_count() for j in range(i)] for i in range(len(rows))]
    pairs = simhash.fingerprint_pairs(spark.createDataFrame([(k, p) for (k, _), p in zip(rows, prints, strict=True)], "node long, fp0 long"), 5)
    mine = union_find(len(rows), [(r["a"], r["b"]) for r in pairs.collect()])
    assert mine == union_find(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if apart[i][j] <= 5])
    # fingerprints alone, without the shingles that texts meet by after them
    monkeypatch.setattr(simhash, "run_pairs", lambda *_, **__: iter(()))
    monkeypatch.setattr(simhash, "mixed_pairs", lambda rows, _: rows[:0, :2])
    found = {r["key"]: r["group"] for r in simhash.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    close = [k for k in range(0, 50, 2) if apart[k + 1][k] <= 5]
    assert len(close) > 20 and all(found[k + 1] == k for k in close)
    assert all(found[k] == k for k in (*range(0, 50, 2), *range(50, 60)))


def test_all_pairs_meet_that_can_be_similar():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 100).astype(np.uint64)
    sets = [np.unique(np.r_[rng.choice(base, int(rng.integers(85, 100)), replace=False), rng.integers(0, 2**63, int(rng.integers(0, 12))).astype(np.uint64)]) for _ in range(40)]
    for common in ((np.zeros(0, np.uint64), np.zeros(0, np.int64)), (np.sort(base[:70]), np.arange(70))):
        rows = [(int(x.view(np.int64)), i, len(s) << 32 | at, i) for i, s in enumerate(sets) for at, x in enumerate(simhash._prefix(s, common, 0.8))]
        met = {tuple(p) for part in simhash.run_pairs(np.array(rows, np.int64), 0.8) for p in part.tolist()}
        similar = {(i, j) for j in range(40) for i in range(j) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
        assert similar and similar <= met


def test_one_row_of_each_group_stays(spark):
    text, other = " ".join(f"a{i}" for i in range(80)), " ".join(f"b{i}" for i in range(80))
    rows = [(1, text), (1, text), (2, text + " more"), (2, other), (3, other + " end"), (None, text), (None, text), (4, None), (4, None), (5, "  "), (6, "x"), (6, "y")]
    kept = stages.near_duplicates(spark, spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    found = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert found == sorted([(1, text), (2, other), (None, text), (None, text), (4, None), (4, None), (5, "  "), (6, "x"), (6, "y")], key=str)


@pytest.mark.parametrize("hot", [200_000, 0])
def test_rows_of_one_key_are_apart_in_suffix_dedup(spark, hot):
    rng = np.random.default_rng(8)
    a, b, c = ("".join(chr(97 + int(x)) for x in rng.integers(0, 26, 300)) for _ in range(3))
    rows = [(1, a), (1, a), (2, b), (2, c), (3, "x" + a[:200] + "y"), (-4, c[100:250]), (5, "short"), (5, "short"), (None, a), (None, a)]
    kept = suffix_dedup.remove_repeats(spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string"), 100, hot_bucket=hot, carry=("lang",)).collect()
    found = Counter((r["key"], bytes(r["kept"]).decode(), r["n_removed"]) for r in kept)
    c_left = c[:100] + c[250:]
    assert found == Counter([(1, a, 0), (1, "", 300), (2, b, 0), (2, c_left, 150), (3, "xy", 200), (-4, c[100:250], 0), (5, "short", 0), (5, "short", 0), (None, a, 0), (None, a, 0)])


def test_decontamination_judges_each_row_by_its_own_text(spark, tmp_path):
    item = " ".join(f"q{i}" for i in range(30))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, "before " + item), (None, "clean text"), (7, item), (7, "another clean text of one id"), (8, None), (None, None), (9, item + " after")]
    clean = stages.decontamination(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    assert Counter(tuple(r) for r in clean.collect()) == Counter([(None, "clean text"), (7, "another clean text of one id"), (8, None), (None, None)])


def test_relaxed_search_has_measured_recall(spark, medium):
    frame = spark.read.parquet(f"{medium}/embeddings.parquet").limit(4000).select("vec_id", "embedding")
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in frame.collect()]
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in rows], "vec_id long, embedding array<double>")
    asked = frame.where("vec_id % 40 = 0")
    found: dict[float, dict[int, set]] = {}
    for factor in (1.0, 2.0):
        found[factor] = {}
        for r in vector_search.nearest(frame, asked, k=10, factor=factor, shard_rows=1000, block_rows=16).collect():
            found[factor].setdefault(r["query_id"], set()).add(r["vec_id"])
    x, keys = np.array([v for _, v in rows]), np.array([k for k, _ in rows])
    brute = {}
    for k, v in rows:
        if k % 40 == 0:
            brute[k] = {int(keys[i]) for i in [i for i in np.lexsort((keys, -(x @ v))) if keys[i] != k][:10]}
    assert found[1.0] == brute
    recall = sum(len(found[2.0][k] & brute[k]) for k in brute) / sum(map(len, brute.values()))
    assert recall >= 0.9


def test_search_of_mixed_lengths_and_hot_keys(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [1.0, 0.0, 0.0]), (4, [2.0, 0.0, 0.0]), (5, [1.0])] + [(9, [3.0, 3.0])] * 50
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = [tuple(r) for r in vector_search.nearest(frame, frame.where("vec_id < 9"), k=3, shard_rows=7, block_rows=2).orderBy("query_id", "rank").collect()]
    assert [(q, v) for q, _, v, _ in found] == [(1, 9), (1, 9), (1, 9), (2, 9), (2, 9), (2, 9), (3, 4), (4, 3)]
    own = vector_search.nearest(frame, frame.where("vec_id = 9").limit(1), k=3).orderBy("rank").collect()
    assert [r["vec_id"] for r in own] == [1, 2]


def test_short_items_are_found_word_by_word(spark):
    docs = spark.createDataFrame([(1, "Tell me: who wrote Hamlet, then?"), (2, "who wrote the play"), (3, None), (4, "Hamlet wrote who"), (5, "yes " * 3000 + "who wrote hamlet")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "who wrote Hamlet"), (8, None), (9, "..."), (10, "play")], "item_id long, text string")
    found = {(r["key"], r["item"], r["start"], r["n_words"]) for r in decontamination.contaminated(docs, items).collect()}
    assert found == {(1, 7, 2, 3), (5, 7, 3000, 3), (2, 10, 3, 1)}


def test_sharding_of_nulls_and_repeats(spark):
    from pyspark.sql import functions as F

    rows = [(None, None), (1, None), (1, None), (2, "a"), (2, "a"), (3, "b" * 5000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", sharding.text_size(F.col("text")))
    placed = sharding.shard_by_size(frame, 2, F.col("text"), F.col("size"), F.col("doc_id")).collect()
    assert len(placed) == len(rows)
    assert all(sorted(r["slot"] for r in placed if r["shard"] == s) == list(range(sum(r["shard"] == s for r in placed))) for s in (0, 1))


def test_many_shards_can_be_cut(spark):
    from pyspark.sql import functions as F

    frame = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit(3).alias("size"))
    n = Counter(r["shard"] for r in sharding.shard_by_size(frame, 600, F.col("doc_id"), F.col("size"), F.col("doc_id")).groupBy("shard").count().collect())
    assert len(n) == 600


def plain_em(patterns, rounds=200):
    """The same estimate, pattern by pattern and labeller by labeller."""
    rows = sorted(patterns)
    total = sum(patterns.values())
    post = []
    for r in rows:
        bad, cast = sum(v == quality.BAD for v in r), sum(v != quality.NONE for v in r)
        post.append(min(0.98, max(0.02, 2 * bad / max(cast, 1))))
    for _ in range(rounds):
        like = []
        for kind in (0, 1):
            w = [patterns[r] * (p if kind else 1 - p) for r, p in zip(rows, post, strict=True)]
            prior = (sum(w) + 1) / (total + 2)
            rates = []
            for j in range(len(rows[0])):
                bad = sum(x for x, r in zip(w, rows, strict=True) if r[j] == quality.BAD)
                cast = sum(x for x, r in zip(w, rows, strict=True) if r[j] != quality.NONE)
                rates.append((bad + (0.9 if kind else 0.1)) / (cast + 1))
            like.append([prior * np.prod([1 if v == quality.NONE else rates[j] if v == quality.BAD else 1 - rates[j] for j, v in enumerate(r)]) for r in rows])
        post = [b / (a + b) for a, b in zip(*like, strict=True)]
    return dict(zip(rows, post, strict=True))


def test_expectation_maximisation_matches_plain_python():
    rng = np.random.default_rng(4)
    patterns = Counter(tuple(int(x) for x in rng.choice([0, 1, 2], 3, p=[0.6, 0.1, 0.3])) for _ in range(500))
    mine, wanted = quality.expect_maximise(patterns), plain_em(patterns)
    assert all(abs(mine[k] - wanted[k]) < 1e-4 for k in wanted)


def test_language_of_texts_without_letters_and_ties(spark):
    frame = spark.createDataFrame([(1, "aaa bbb", "x"), (2, "ccc ddd", "y"), (3, "123 !!", None), (4, None, "x"), (5, "aaa", None), (6, "", "y"), (5, "aaa", None)], "doc_id long, text string, lang string")
    model = language.train(frame)
    found = Counter((r["doc_id"], r["lang_pred"]) for r in language.identify(frame, model).collect())
    assert found == Counter([(1, "x"), (2, "y"), (3, "und"), (4, "und"), (5, "x"), (5, "x"), (6, "und")])
    grams = {x: Counter(g for t, own in (("aaa bbb", "x"), ("ccc ddd", "y")) if own == x for g in language.grams(t).tolist()) for x in ("x", "y")}
    share = {x: {b: (n[b] + language.SMOOTHING) / (n.total() + language.SMOOTHING * language.BUCKETS) for b in set(grams["x"]) | set(grams["y"])} for x, n in grams.items()}
    at = model.code[:, 0].tolist().index(1)
    first, second = model.languages[at], model.languages[1 - at]
    for b in share["x"]:
        assert abs(model.weights[b, 0] - np.log(share[first][b] / share[second][b])) < 1e-4


def test_encoder_where_blanks_meet():
    e = bpe.encoder(bpe.tokenizer_text(queries.vocabulary("byte_bpe_50k.json")))
    for text in ("a\n \nb", " \n x", "foo \n \tbar", "\n a", "x  y", "a   b", "", " ", "a ", "x\0 y", "end. \r\nnext"):
        assert np.frombuffer(e.encode([text])[0], e.dtype).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


STAGED = "doc_id long, text string, lang string, source string, n_chars long, n long, key string"


@pytest.mark.parametrize("name", ["quality", "near_duplicates", "repeated_passages", "decontamination", "packing"])
def test_stages_take_odd_rows(spark, small, name):
    rows = [(1, None), (2, ""), (3, " \n "), (None, "no id"), (None, "no id"), (4, "same row"), (4, "same row"), (4, "another text"), (5, "long words and more of them " * 3000), (6, "é" * 500)]
    frame = spark.createDataFrame([(k, t, None, "s", 3, 1, "k") for k, t in rows], STAGED)
    out = getattr(stages, name)(spark, frame, small)
    if name != "packing":
        assert out.columns == frame.columns
        assert {r["doc_id"] for r in out.collect()} <= {k for k, _ in rows}
    if name in ("repeated_passages", "decontamination"):
        assert out.count() == len(rows)
    assert getattr(stages, name)(spark, frame.limit(0), small).count() == 0
    if name in ("repeated_passages", "decontamination"):
        bare = frame.select("doc_id", "text")
        assert getattr(stages, name)(spark, bare, small).columns == bare.columns
