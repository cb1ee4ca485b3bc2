"""JSON as JavaScript writes it, with sorted keys: what hashes of records are taken of."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DecimalType, FractionalType, IntegralType, MapType, NullType, StringType, StructType

#: Control characters whose escape has a letter, which is written small.
_LETTERED = (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20))


def number_text(x: float) -> str:
    """A double as JavaScript writes it: the shortest decimal that reads back as it, plain from 1e-6 to below 1e21; null if it isn't finite."""
    if not math.isfinite(x):
        return "null"
    if x == 0:
        return "0"
    sign, digits, exponent = "-" if x < 0 else "", *f"{abs(x)!r}e0".split("e")[:2]
    whole, _, part = digits.partition(".")
    exponent = int(exponent) if "e" in repr(x) else 0
    every = whole + part
    point = len(whole) + exponent - (len(every) - len(every.lstrip("0")))
    every = every.strip("0")
    n = len(every)
    if n <= point <= 21:
        return sign + every + "0" * (point - n)
    if 0 < point <= 21:
        return sign + every[:point] + "." + every[point:]
    if -6 < point <= 0:
        return sign + "0." + "0" * -point + every
    mantissa = every[0] + ("." + every[1:] if n > 1 else "")
    return f"{sign}{mantissa}e{'+' if point > 0 else '-'}{abs(point - 1)}"


def number_json(x: Column) -> Column:
    """``number_text`` of a double column, without leaving the JVM; null for null.

    The JVM's text may have one digit more than is needed; whether fewer read back is tried.
    """
    text = F.abs(x).cast("string")
    whole, part = F.regexp_extract(text, r"^(\d+)", 1), F.regexp_extract(text, r"\.(\d+)", 1)
    exponent = F.coalesce(F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int"), F.lit(0))
    every = F.concat(whole, part)
    lead = F.length(every) - F.length(F.regexp_replace(every, "^0+", ""))
    digits = F.regexp_replace(every, "^0+|0+$", "")
    one = F.struct(digits.alias("d"), (F.length(whole) - lead + exponent).alias("p"), F.abs(x).alias("x"))

    def shorter(v: Column) -> Column:
        n, m = F.length(v["d"]), v["d"].try_cast("long")
        down = F.call_function("div", m, F.lit(10).cast("long"))
        first = F.when(m % 10 < 5, down).otherwise(down + 1)
        second = F.when(m % 10 < 5, down + 1).otherwise(down)

        def reads(c: Column) -> Column:
            return F.concat(c.cast("string"), F.lit("E"), (v["p"] - n + 1).cast("string")).try_cast("double") == v["x"]

        better = F.when(reads(first), first).when(reads(second), second)
        text = better.cast("string")
        return F.when((n > 1) & better.isNotNull(), F.struct(F.regexp_replace(text, "0+$", "").alias("d"), (v["p"] + F.length(text) - (n - 1)).alias("p"), v["x"].alias("x"))).otherwise(v)

    def written(v: Column) -> Column:
        d, p, n = v["d"], v["p"], F.length(v["d"])
        mantissa = F.concat(F.substring(d, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substr(d, F.lit(2)))).otherwise(""))
        return (
            F.when((n <= p) & (p <= 21), F.rpad(d, p, "0")).when((p > 0) & (p <= 21), F.concat(F.substr(d, F.lit(1), p), F.lit("."), F.substr(d, p + 1)))
            .when((p > -6) & (p <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), -p), d)).otherwise(F.concat(mantissa, F.when(p > 0, "e+").otherwise("e-"), F.abs(p - 1).cast("string")))
        )

    # a value bound once: each step reads it several times
    steps = F.transform(F.transform(F.array(one), shorter), written)
    signed = F.concat(F.when(x < 0, "-").otherwise(""), F.get(steps, F.lit(0)))
    return F.when(x.isNull(), None).when(F.isnan(x) | (F.abs(x) == float("inf")), "null").when(x == 0, "0").otherwise(signed)


def string_json(x: Column) -> Column:
    """A string column with quotes and JavaScript's escapes."""
    plain = F.to_json(F.array(x))
    plain = F.substr(plain, F.lit(2), F.length(plain) - 2)
    small = plain
    for code in _LETTERED:
        # an escape, and not the text of one: an even number of backslashes before it
        small = F.regexp_replace(small, rf"(?<!\\)((?:\\\\)*)\\u00{code:02X}", rf"$1\\u00{code:02x}")
    return F.when(x.rlike("[\\x0b\\x0e\\x0f\\x1a-\\x1f]"), small).otherwise(plain)


def value_json(x: Column, kind: DataType) -> Column:
    """A value of any kind as JSON; nulls are written out, keys of structs and maps are sorted."""
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        cells = [F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + ":"), value_json(x[f.name], f.dataType)) for f in fields]
        out = F.concat(F.lit("{"), F.concat_ws(",", *cells) if cells else F.lit(""), F.lit("}"))
    elif isinstance(kind, ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(x, lambda v: value_json(v, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, MapType):
        keys = F.array_sort(F.map_keys(x))
        out = F.concat(F.lit("{"), F.array_join(F.transform(keys, lambda k: F.concat(string_json(k.cast("string")), F.lit(":"), value_json(F.element_at(x, k), kind.valueType))), ","), F.lit("}"))
    elif isinstance(kind, NullType):
        return F.lit("null")
    elif isinstance(kind, StringType):
        out = string_json(x)
    elif isinstance(kind, (IntegralType, BooleanType)) or isinstance(kind, DecimalType) and kind.scale == 0:
        out = x.cast("string")
    elif isinstance(kind, (FractionalType, DecimalType)):
        out = number_json(x.cast("double"))
    else:  # times and bytes as Spark writes them
        one = F.to_json(F.array(x))
        out = F.substr(one, F.lit(2), F.length(one) - 2)
    return F.when(x.isNull(), "null").otherwise(out)


def canonical_json(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """The columns of ``df`` as JSON with sorted keys and with nulls written out; numbers and escapes as JavaScript writes them."""
    names = sorted(columns or df.columns)
    cells = [F.concat(F.lit(json.dumps(c, ensure_ascii=False) + ":"), value_json(F.col(f"`{c.replace('`', '``')}`"), df.schema[c].dataType)) for c in names]
    return F.concat(F.lit("{"), F.concat_ws(",", *cells) if cells else F.lit(""), F.lit("}"))


def sorted_text(text: str | None) -> str | None:
    """A JSON text with sorted keys at every depth and numbers as JavaScript writes them; any other text as it is."""

    def written(v) -> str:
        if isinstance(v, dict):
            return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{written(v[k])}" for k in sorted(v)) + "}"
        if isinstance(v, list):
            return "[" + ",".join(map(written, v)) + "]"
        return number_text(v) if isinstance(v, float) else json.dumps(v, ensure_ascii=False)

    try:
        return None if text is None else written(json.loads(text, parse_int=float, parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c))))
    except (ValueError, RecursionError):
        return text


@F.pandas_udf(StringType())
def canonical_text(texts: pd.Series) -> pd.Series:
    """``sorted_text`` of a column: JSON of any depth has no schema that built-in functions could follow."""
    return texts.map(sorted_text, na_action=None)


def hmac_sha256(message: Column, key: str) -> Column:
    """Hex HMAC-SHA256 of a text, by two of Spark's own digests over padded keys."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner = F.unhex(F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in raw)), message.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in raw)), inner), 256)
