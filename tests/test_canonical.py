"""Canonical JSON against JavaScript's rules for numbers and escapes, and HMAC against the standard library."""

from __future__ import annotations

import hashlib
import hmac
import random
import struct

from pyspark.sql import functions as F

from quillon.functions import canonical as C

# Doubles and what JavaScript writes for them.
KNOWN = {
    1.0: "1", -1.0: "-1", 0.0: "0", -0.0: "0", 1e-7: "1e-7", 1e21: "1e+21", 1e20: "100000000000000000000", 123456789012345680000.0: "123456789012345680000", 1.5e-6: "0.0000015", 1e-6: "0.000001", 9.5e-7: "9.5e-7", 5e-324: "5e-324",
    1.7976931348623157e308: "1.7976931348623157e+308", 0.1: "0.1", 0.30000000000000004: "0.30000000000000004", 2e23: "2e+23", 1.2345e25: "1.2345e+25", 100.25: "100.25", 9007199254740993.0: "9007199254740992", 4.35: "4.35", -2.5e-9: "-2.5e-9",
}


def test_numbers_as_javascript_writes_them(spark):
    assert {x: C.number_text(x) for x in KNOWN} == KNOWN
    rng = random.Random(1)
    doubles = [*KNOWN, float("inf"), float("-inf"), float("nan"), 2.2250738585072014e-308, 2.0e-3, 1.0e23, 8.41e21, 9.5367431640625e-7, 2.98023223876953125e-8]
    doubles += [struct.unpack("<d", rng.getrandbits(64).to_bytes(8, "little"))[0] for _ in range(4000)] + [round(rng.uniform(-1e6, 1e6), rng.randrange(8)) for _ in range(2000)] + [float(10**k) for k in range(-30, 30)]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(doubles)], "i int, x double")
    found = {r["i"]: r["t"] for r in frame.select("i", C.number_json(F.col("x")).alias("t")).collect()}
    wrong = [(x, found[i], C.number_text(x)) for i, x in enumerate(doubles) if found[i] != C.number_text(x)]
    assert wrong == []
    assert frame.select(C.number_json(F.lit(None).cast("double"))).first()[0] is None


def test_whole_rows(spark):
    frame = spark.createDataFrame(
        [(1.0, None, {"b": 1e-7, "a": None}, [2.5, None], ('q"\\\n\x1f\x0b é \\u001F', {"z": 1, "é": 2}), True, 7), (None, "s", {}, [], None, None, None)],
        "n double, `a b` string, m map<string, double>, l array<double>, s struct<t: string, k: map<string, int>>, ok boolean, i long",
    )
    one, two = (r[0] for r in frame.select(C.canonical_json(frame)).collect())
    assert one == '{"a b":null,"i":7,"l":[2.5,null],"m":{"a":null,"b":1e-7},"n":1,"ok":true,"s":{"k":{"z":1,"é":2},"t":"q\\"\\\\\\n\\u001f\\u000b é \\\\u001F"}}'
    assert two == '{"a b":"s","i":null,"l":[],"m":{},"n":null,"ok":null,"s":null}'


def test_texts_and_their_hash(spark):
    texts = {'{"b": 1.0, "a": [1e21, {"d": 0.10, "c": null}]}': '{"a":[1e+21,{"c":null,"d":0.1}],"b":1}', "12345678901234567890": "12345678901234567000", "not json": "not json", '"é"': '"é"', "NaN": "NaN", "": ""}
    frame = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    for key in ("k", "a" * 100, ""):
        found = {r["t"]: (r["c"], r["h"]) for r in frame.select("t", C.canonical_text("t").alias("c"), C.hmac_sha256(C.canonical_text("t"), key).alias("h")).collect()}
        assert found.pop(None) == (None, None)
        assert found == {t: (c, hmac.new(key.encode(), c.encode(), hashlib.sha256).hexdigest()) for t, c in texts.items()}
