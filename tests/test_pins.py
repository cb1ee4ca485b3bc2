"""Pins against files as they are."""

from __future__ import annotations

import gzip
import hashlib

from quillon.sources import pins


def test_files_are_held_against_both_manifests(spark, tmp_path):
    data = {f"{n}.jsonl.gz": gzip.compress(("{}\n" * n).encode(), mtime=0) for n in (1, 2, 3)}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    files = pins.file_digests(spark, str(tmp_path), "*.gz")
    assert {(r["file"], r["sha256"], r["bytes"], r["rows"]) for r in files.collect()} == {(f, hashlib.sha256(c).hexdigest(), len(c), int(f[0])) for f, c in data.items()}
    sha = {f: hashlib.sha256(c).hexdigest() for f, c in data.items()}
    one = [("a", "1.jsonl.gz", sha["1.jsonl.gz"], 1), ("b", "2.jsonl.gz", sha["2.jsonl.gz"], 9), ("c", "3.jsonl.gz", "old", 3), ("d", "gone.gz", "x", None), ("e", "1.jsonl.gz", "y", 1), ("f", "1.jsonl.gz", "z", 1), ("f", "1.jsonl.gz", "w", 1)]
    two = [("a", sha["1.jsonl.gz"]), ("b", sha["2.jsonl.gz"]), ("c", "old"), ("d", "x"), ("f", "z"), ("g", "q")]
    entries = spark.createDataFrame([(e,) for e in "abcdefgh"], "entry string")
    found = pins.check_pins(entries, spark.createDataFrame(one, "entry string, file string, sha256 string, rows long"), spark.createDataFrame(two, "entry string, sha256 string"), files)
    wanted = {"a": None, "b": "rows_differ", "c": "digest_differs", "d": "file_missing", "e": "second_pin_missing", "f": "pins_differ", "g": "first_pin_missing", "h": "first_pin_missing"}
    assert {r["entry"]: r["reason"] for r in found.collect()} == wanted
