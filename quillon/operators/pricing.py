"""Prices of token usage: which rates apply, exact and rounded amounts, host overrides, and what stands in for a price.

``prices`` has a row a model: ``model, price_table, input_rate, output_rate, cached_rate, cached_unpriced,
write_rate, write_unpriced, long_after, long_input_rate, long_output_rate, long_cached_rate``, in dollars for a
million tokens. A null cache rate is derived from the input rate for the tables in ``DERIVED``; with
``..._unpriced`` it is known to have none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.canonical import canonical_json

# Tables whose cache rates follow from the input rate, and by how much.
DERIVED = ("anthropic", "openai")
CACHE_WRITE, CACHE_READ = 1.25, 0.1
TOKENS = ("input_tokens", "output_tokens", "cache_write_tokens", "cache_read_tokens")
PRICE_COLUMNS = ("price_table", "input_rate", "output_rate", "cached_rate", "cached_unpriced", "write_rate", "write_unpriced", "long_after", "long_input_rate", "long_output_rate", "long_cached_rate")


def with_price(usage: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """``usage`` with a struct ``price``: that of the normalized id, else that of the id without its snapshot; null for none."""
    row = F.struct(*[F.col(c) for c in PRICE_COLUMNS])
    keyed = usage.withColumn("__id", X.normalize_model(F.col(model))).withColumn("__base", X.without_snapshot(F.col("__id")))
    exact = prices.select(F.col("model").alias("__id"), row.alias("__exact"))
    base = prices.select(F.col("model").alias("__base"), row.alias("__other"))
    return keyed.join(exact, "__id", "left").join(base, "__base", "left").withColumn("price", F.coalesce("__exact", "__other")).drop("__id", "__base", "__exact", "__other")


def applied_rates(price: Column, prompt_tokens: Column, request_scoped: Column) -> dict[str, Column]:
    """Input, output, cache read and cache write rates of one usage; null where tokens of a kind have no price.

    The rates for long prompts hold for a single request whose prompt exceeds the threshold; cache
    writes have none there.
    """
    long = F.coalesce(request_scoped & (prompt_tokens > price["long_after"]), F.lit(False))
    derived = price["price_table"].isin(*DERIVED)

    def cache(rate: Column, unpriced: Column, times: float) -> Column:
        return F.when(~F.coalesce(unpriced, F.lit(False)), F.coalesce(rate, F.when(derived, price["input_rate"] * times)))

    return {
        "input": F.when(long, price["long_input_rate"]).otherwise(price["input_rate"]),
        "output": F.when(long, price["long_output_rate"]).otherwise(price["output_rate"]),
        "read": F.when(long, price["long_cached_rate"]).otherwise(cache(price["cached_rate"], price["cached_unpriced"], CACHE_READ)),
        "write": F.when(~long, cache(price["write_rate"], price["write_unpriced"], CACHE_WRITE)),
    }


def table_cost(price: Column, usage: dict[str, Column], request_scoped: Column) -> Column:
    """Dollars to six places; null without a price, with a count below zero, or with cached tokens that have no rate.

    ``usage`` has the four counts of ``TOKENS``; an unknown one counts 0.
    """
    n = {k: F.coalesce(usage[k], F.lit(0)) for k in TOKENS}
    rate = applied_rates(price, n["input_tokens"] + n["cache_read_tokens"] + n["cache_write_tokens"], request_scoped)
    valid = reduce(lambda a, b: a & b, [x >= 0 for x in n.values()]) & price.isNotNull()
    priced = ~((n["cache_read_tokens"] > 0) & rate["read"].isNull()) & ~((n["cache_write_tokens"] > 0) & rate["write"].isNull())
    zero = F.lit(0.0)
    cost = (
        (n["input_tokens"] / 1e6) * rate["input"] + (n["cache_write_tokens"] / 1e6) * F.coalesce(rate["write"], zero)
        + (n["cache_read_tokens"] / 1e6) * F.coalesce(rate["read"], zero) + (n["output_tokens"] / 1e6) * rate["output"]
    )
    return F.when(valid & priced, X.round_half_up(cost, 6))


def pico_usd(tokens: Column, rate: Column) -> Column:
    """Exact price in billionths of a thousandth of a dollar: whole tokens times the rate rounded once."""
    whole = F.floor(rate * 1e6 + 0.5).cast("decimal(18,0)")
    return F.when((tokens >= 0) & (rate >= 0), tokens.cast("decimal(19,0)") * whole).otherwise(0).cast("decimal(38,0)")


def pico_to_micros(pico: Column) -> Column:
    return F.floor((pico + 500_000) / 1_000_000).cast("long")


def override_index(overrides: DataFrame) -> DataFrame:
    """``override_id`` (the normalized model) and ``override``, one row a model; fails for a bad rate or two rows of one model.

    ``overrides``: ``model, input_rate, output_rate, write_multiplier, read_multiplier, price_table, as_of``.
    """

    def bad(c: str, needed: bool) -> Column:
        wrong = F.isnan(c) | (F.col(c) < 0) | (F.col(c) == float("inf"))
        return F.col(c).isNull() | wrong if needed else F.coalesce(wrong, F.lit(False))

    checks = [("model", F.coalesce(F.trim("model"), F.lit("")) == ""), *[(c, bad(c, True)) for c in ("input_rate", "output_rate")], *[(c, bad(c, False)) for c in ("write_multiplier", "read_multiplier")]]
    key = X.normalize_model(F.col("model"))
    for c, wrong in checks:
        key = F.when(wrong, F.raise_error(F.concat(F.lit(f"price override: bad {c} for model "), F.coalesce("model", F.lit("null")))).cast("string")).otherwise(key)
    row = F.struct("input_rate", "output_rate", "write_multiplier", "read_multiplier", F.coalesce("price_table", F.lit("override")).alias("price_table"), "as_of")
    grouped = overrides.select(key.alias("id"), row.alias("override")).groupBy("id").agg(F.first("override").alias("override"), F.count(F.lit(1)).alias("n"))
    one = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("duplicate price override for model "), F.col("id"))).cast("string")).otherwise(F.col("id"))
    return grouped.select(one.alias("override_id"), "override")


def event_prices(events: DataFrame, prices: DataFrame, overrides: DataFrame, built_in_as_of: str, revision: str | None = None) -> DataFrame:
    """Events with ``actual_usd, estimated_usd, pricing_source, price_table, pricing_revision, cost_source, price_diagnostics``.

    An estimate that came with the event (``has_estimate``, even a null one) is taken as it is; else, if input and output are known,
    the host's override prices it, else the table. A charge that is negative or no number is dropped and noted.
    ``events``: ``model``, the four counts, ``actual_cost_usd, has_estimate, estimated_cost_usd, request_scoped``.
    """
    keyed = with_price(events, prices).withColumn("override_id", X.normalize_model(F.col("model"))).join(override_index(overrides), "override_id", "left")
    o, n = F.col("override"), {k: F.coalesce(F.col(k), F.lit(0)) for k in TOKENS}
    known = F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull()
    given, own = F.col("has_estimate"), ~F.col("has_estimate") & known
    no_rate = ((n["cache_write_tokens"] > 0) & o["write_multiplier"].isNull()) | ((n["cache_read_tokens"] > 0) & o["read_multiplier"].isNull())
    zero = F.lit(0.0)
    pico = (
        pico_usd(n["input_tokens"], o["input_rate"]) + pico_usd(n["output_tokens"], o["output_rate"])
        + pico_usd(n["cache_write_tokens"], o["input_rate"] * F.coalesce(o["write_multiplier"], zero)) + pico_usd(n["cache_read_tokens"], o["input_rate"] * F.coalesce(o["read_multiplier"], zero))
    )
    overridden = own & o.isNotNull()
    by_table = own & o.isNull()
    from_table = table_cost(F.col("price"), {k: F.col(k) for k in TOKENS}, F.coalesce("request_scoped", F.lit(False)))
    estimate = F.when(given, F.col("estimated_cost_usd")).when(overridden & ~no_rate, pico_to_micros(pico) / 1e6).when(by_table, from_table)
    actual = X.usd_or_null(F.col("actual_cost_usd"))
    note = F.when(overridden & no_rate, "no_pricing_data").when(by_table & F.col("price").isNull(), "unpriced_model").when(by_table & from_table.isNull(), "no_pricing_data")
    invalid = F.when(F.col("actual_cost_usd").isNotNull() & actual.isNull(), "invalid_token_usage")
    told = F.lit(revision)
    out = keyed.withColumns({
        "actual_usd": actual, "estimated_usd": estimate,
        "__table": F.when(given, "external").when(overridden, o["price_table"]).otherwise(F.col("price.price_table")),
        "__revision": F.when(given, told).when(overridden, F.coalesce(o["as_of"], told)).otherwise(F.coalesce(told, F.lit(built_in_as_of))),
        "price_diagnostics": F.array_compact(F.array(invalid, note)),
    })
    priced = F.col("estimated_usd").isNotNull()
    source = F.when(F.col("actual_usd").isNotNull(), "provider_reported").when(priced, "local_estimate").otherwise("none")
    return out.select(
        *events.columns, "actual_usd", "estimated_usd", F.when(priced, "local_estimate").otherwise("none").alias("pricing_source"), F.when(priced, F.col("__table")).alias("event_price_table"),
        F.when(priced, F.col("__revision")).alias("pricing_revision"), source.alias("cost_source"), "price_diagnostics",
    )


def sidecar_difference(cost: Column, session: Column, baseline_cost: Column, baseline_session: Column) -> Column:
    """What a session's running cost rose since the baseline, at least 0, to six places; null for another session or without a baseline."""
    same = baseline_session.isNull() | (session == baseline_session)
    known = F.coalesce(same, F.lit(False)) & (cost - baseline_cost).isNotNull()
    return F.when(known, X.round_half_up(F.greatest(cost - baseline_cost, F.lit(0.0)), 6))


def layered_cost(explicit: Column, by_tokens: Column, by_sidecar: Column, by_transcript: Column) -> Column:
    """The first that is known: a stated cost, a price of stated tokens, a sidecar's rise, a transcript's price."""
    return F.coalesce(X.usd_or_null(explicit), by_tokens, by_sidecar, by_transcript)


def price_export(prices: DataFrame) -> DataFrame:
    """``line, hash``: every price as JSON with sorted keys, and its SHA-256, by model; a drift is a row that only one of two exports has."""
    line = canonical_json(prices)
    return prices.select("model", line.alias("line")).withColumn("hash", F.sha2("line", 256))
