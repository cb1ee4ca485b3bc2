"""Each stage of the pipeline against plain Python, on its own input."""

from __future__ import annotations

from collections import Counter

import numpy as np
from test_llm_queries import docs_of, libraries, plain_leaks, union_find

import corpus_pipeline
from quillon.llm import simhash, stages
from quillon.llm.shared import settle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    assert [f for _, f in corpus_pipeline.STAGES] == [stages.quality, stages.near_duplicates, stages.repeated_passages, stages.decontamination, stages.packing]
    kept = settle(stages.quality(spark, docs, medium), "t")
    assert kept.columns == COLUMNS and 0 < kept.count() < docs.count()

    before = [(r["doc_id"], r["text"]) for r in kept.collect()]
    one = settle(stages.near_duplicates(spark, kept, medium), "t")
    words = [simhash.words_of(t) for _, t in before]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)]) for w in words]
    links, place = [], {}
    for i, s in enumerate(sets):
        for x in s:
            for j in place.get(x, ()):
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    links.append((i, j))
            place.setdefault(x, []).append(i)
    root = union_find(len(before), links)
    # one text of each group stays, that of its least doc_id
    assert {r["doc_id"] for r in one.collect()} == {min(before[i][0] for i in own) for own in _groups(root)}

    cut = settle(stages.repeated_passages(spark, one, medium), "t")
    assert cut.columns == COLUMNS and cut.count() == one.count()
    seen: set[bytes] = set()
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    for k, t in sorted((r["doc_id"], r["text"]) for r in one.collect()):
        data, new, repeated = t.encode(), [], bytearray(len(t.encode()))
        for i in range(len(data) - stages.PASSAGE_BYTES + 1):
            w = data[i : i + stages.PASSAGE_BYTES]
            if w in seen:
                repeated[i : i + stages.PASSAGE_BYTES] = b"\1" * stages.PASSAGE_BYTES
            else:
                seen.add(w)
        assert texts[k] == bytes(b for b, m in zip(data, repeated, strict=True) if not m).decode("utf-8", "ignore"), new
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())

    clean = settle(stages.decontamination(spark, cut, medium), "t")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{medium}/benchmark.parquet").collect()]
    gone = {k for k, _ in plain_leaks(list(texts.items()), items)}
    assert {r["doc_id"] for r in clean.collect()} == set(texts) - gone

    pieces = stages.packing(spark, clean, medium).collect()
    library = libraries()
    wanted = Counter({r["doc_id"]: len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in clean.collect()})
    found: Counter = Counter()
    for p in pieces:
        found[p["doc_id"]] += p["length"]
        assert len(np.frombuffer(p["ids"], "<u4")) == p["length"]
    assert found == wanted


def _groups(root):
    by: dict[int, list[int]] = {}
    for i, r in enumerate(root):
        by.setdefault(r, []).append(i)
    return by.values()


def test_run_on_a_small_folder(spark, small):
    pieces = corpus_pipeline.run(spark, small)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(pieces.columns) and pieces.count() > 0
    assert {r["doc_id"] for r in pieces.collect()} <= {k for k, _ in docs_of(spark, small)}
