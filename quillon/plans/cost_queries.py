"""Cost and ledger queries over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import cost, pricing
from . import bindings as B

TOKENS = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens"]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.project(spark, sf_dir, B.EVENTS)


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost.to_ledger(_events(spark, sf_dir))


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost.cumulative_to_delta(_events(spark, sf_dir), ["input_tokens", "output_tokens", "actual_micros"], ["task_id", "session_id"], ["sequence", "event_id"])


#: One price of each kind: derived cache rates, a rate for long prompts, none for cache writes, none for cached tokens at all.
PRICES = [
    ("alpha", "anthropic", 3.0, 15.0, None, False, None, False, None, None, None, None), ("beta", "openai", 2.0, 8.0, 0.5, False, None, True, 60, 4.0, 12.0, 1.0),
    ("gamma", "google", 1.0, 4.0, None, False, None, False, None, None, None, None), ("delta", "openai", 1.25, 10.0, 0.125, False, None, False, 80, 2.5, 15.0, None),
]
_PRICE_SCHEMA = "model string, price_table string, input_rate double, output_rate double, cached_rate double, cached_unpriced boolean, write_rate double, write_unpriced boolean, long_after long, long_input_rate double, long_output_rate double, long_cached_rate double"
_MODEL = "case event_id % 5 when 0 then 'alpha' when 1 then 'beta' when 2 then 'gamma' when 3 then 'delta' else 'omega' end"


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).withColumn("model", F.concat(F.lit("OpenAI/"), F.initcap(F.expr(_MODEL)), F.when(F.col("event_id") % 2 == 0, "-20250101").otherwise("")))


def _prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, _PRICE_SCHEMA)


def _price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost.price(_priced(spark, sf_dir), _prices(spark)).select("event_id", F.col("pico_usd").cast("long").alias("pico_usd"), "priced_micros")


def _tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pricing.with_price(_priced(spark, sf_dir), _prices(spark))
    return found.select("event_id", "price.price_table", pricing.table_cost(F.col("price"), {t: F.col(t) for t in pricing.TOKENS}, F.col("event_id") % 3 == 0).alias("usd"))


def _override(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _priced(spark, sf_dir).withColumns({
        "actual_cost_usd": F.when(F.col("event_id") % 7 == 0, F.lit(-1.0)).when(F.col("event_id") % 7 == 1, F.lit(0.25)), "has_estimate": F.col("event_id") % 11 < 2, "estimated_cost_usd": F.when(F.col("event_id") % 11 == 0, F.lit(0.5)),
        "request_scoped": F.col("event_id") % 3 == 0,
    })
    overrides = spark.createDataFrame([("beta-20250101", 10.0, 20.0, 2.0, 0.5, None, "2025-02-02"), ("Alpha", 1.0, 2.0, None, None, "own", None)], "model string, input_rate double, output_rate double, write_multiplier double, read_multiplier double, price_table string, as_of string")
    out = pricing.event_prices(events, _prices(spark), overrides, "2025-01-01")
    return out.select("event_id", "actual_usd", "estimated_usd", "event_price_table", "pricing_revision", "cost_source", F.concat_ws(",", "price_diagnostics").alias("diagnostics"))


def _export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as models with a price each, written out."""
    size = F.col("p_size")
    rows = B.read(spark, sf_dir, "part").select(F.concat(F.lit("m-"), F.col("p_partkey").cast("string")).alias("model"), F.col("p_brand").alias("price_table"), (size * 0.5).alias("input_rate"), F.col("p_retailprice").alias("output_rate"), F.when(size % 3 == 0, size / 8).alias("cached_rate"), (size > 25).alias("cached_unpriced"), F.when(size % 2 == 0, size.cast("long") * 1000).alias("long_after"))
    return pricing.price_export(rows)


def _reportable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with what a report needs of each."""
    source = F.when(F.col("actual_micros").isNotNull(), "provider_reported").when(F.col("estimated_micros").isNotNull(), "local_estimate").otherwise("none")
    return _events(spark, sf_dir).withColumns({
        "cost_source": source, "usage_coverage": F.when(F.col("event_id") % 4 == 0, "unavailable").otherwise("available"), "pricing_revision": F.when(source != "none", F.concat(F.lit("r"), (F.col("event_id") % 3).cast("string"))),
        "price_table": F.when(source == "local_estimate", F.when(F.col("event_id") % 2 == 0, "openai").otherwise("anthropic")),
    })


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = cost.cost_report(_reportable(spark, sf_dir), ["input_tokens", "output_tokens"])
    tasks = _events(spark, sf_dir).select("task_id").union(spark.range(1).select(F.lit(-1).cast("long"))).distinct()
    full = cost.or_unavailable(tasks, made)
    return full.select("task_id", "status", "total_micros", "actual_micros", "estimated_micros", "input_tokens", "events", "turns", "cost_source", "revision", "priced_events", "unpriced_events", *[F.array_join(c, ",").alias(c) for c in ("revisions", "price_tables", "unknown_models")])


def _breakdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(F.col("actual_micros").isNotNull(), "provider_reported").when(F.col("estimated_micros").isNotNull(), "local_estimate").otherwise("none")
    parts = _events(spark, sf_dir).groupBy("task_id", "harness", "model").agg(
        X.strict_sum(F.coalesce("actual_micros", "estimated_micros")).alias("total_micros"), F.sum("actual_micros").alias("actual_micros"), F.sum("estimated_micros").alias("estimated_micros"), F.sum("input_tokens").alias("input_tokens"),
        F.count(F.lit(1)).alias("events"), F.count_distinct("turn_id").alias("turns"), X.promote_source(source).alias("cost_source"), X.promote_coverage(F.col("coverage")).alias("coverage"),
    )
    return cost.merge_breakdowns(parts, ["task_id", "harness"], ["input_tokens"])


def _diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("event_id") % 5 == 0, "malformed_line").when(F.col("event_id") % 5 == 1, "invalid_record").when(F.col("event_id") % 5 == 2, "duplicate_event").when(F.col("event_id") % 5 == 3, "not_a_code").otherwise("missing_token_usage")
    return cost.report_diagnostics(_events(spark, sf_dir).select("task_id", code.alias("code"), (F.col("event_id") % 2).alias("count")))


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows with every ninth field spoilt, and what the contract says of them."""
    rows = _ledger(spark, sf_dir)
    k = F.ascii("id") % 9
    spoilt = {k_: F.col(c) for k_, c in cost.SIGNED.items()} | {"ts": F.unix_millis(F.col("ts").cast("timestamp")), "taskId": F.col("task_id").cast("string")}
    spoilt["model"] = F.when(k == 0, F.lit("sk-secret")).otherwise(F.col("model"))
    spoilt["inputTokens"] = F.when(k == 1, F.lit(-1)).otherwise(F.col("input_tokens"))
    spoilt["amountMicros"] = F.when(k == 2, F.lit(None).cast("long")).otherwise(F.col("amount_micros"))
    spoilt["harness"] = F.when(k == 3, F.lit("unheard")).otherwise(F.col("harness"))
    return rows.select("id", F.concat_ws(",", cost.ledger_errors(spoilt)).alias("errors"))


QUERIES = {
    "ledger_totals": lambda s, d: cost.ledger_totals(_ledger(s, d)),
    "ledger_by_keys": lambda s, d: cost.ledger_query(_ledger(s, d), ["model", "source"], start=_time("2024-01-05"), end=_time("2024-01-20")),
    "task_summary_sets": lambda s, d: cost.task_summary(_ledger(s, d)),
    "ledger_rows": lambda s, d: _ledger(s, d),
    "dedup_first_wins": lambda s, d: cost.first_wins(B.read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"]),
    "dedup_last_wins": lambda s, d: cost.last_wins_first_position(_events(s, d).select("task_id", "model", "event_id", "ordinal", "input_tokens"), ["task_id", "model"], "ordinal"),
    "supersede_chain": lambda s, d: cost.resolve_replays(_events(s, d).select("task_id", "event_id", "ordinal", "replay_of").withColumns({"task_id": F.lit(0).cast("long")})),
    "cumulative_delta": lambda s, d: _steps(s, d).select("event_id", "input_tokens", "output_tokens", "actual_micros", "backward"),
    "cumulative_delta_reset_all": lambda s, d: cost.tracker_delta(_events(s, d).select("event_id", "session_id", "input_tokens", "output_tokens"), ["input_tokens", "output_tokens"], ["session_id"], ["event_id"]),
    "model_segments": lambda s, d: cost.model_segments(_events(s, d), ["input_tokens", "output_tokens"]),
    "task_cost": lambda s, d: cost.cost_totals(_steps(s, d), ["task_id", "harness"], ["input_tokens", "output_tokens"]),
    "task_cost_by_model": lambda s, d: cost.cost_totals(_steps(s, d), ["task_id", "model"], ["input_tokens", "output_tokens"]),
    "price_lookup": _price,
    "price_tiers": _tiers,
    "price_override": _override,
    "price_export": _export,
    "cost_report": _report,
    "breakdown_merge": _breakdowns,
    "report_diagnostics": _diagnostics,
    "ledger_validation": _checked,
    "sequence_numbers": lambda s, d: cost.assign_sequence(_events(s, d).select("event_id", "session_id", "ts", "ordinal")).select("event_id", F.col("sequence").cast("long").alias("sequence")),
    "stage_total": lambda s, d: cost.stage_total(B.read(s, d, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.when(F.col("l_linenumber") < 7, F.col("l_quantity") / 1000).alias("cost_usd"))),
    "contributing_events": lambda s, d: cost.contributing(_events(s, d).select("task_id", "event_id"), _events(s, d).where("event_id % 3 <> 0").groupBy("task_id").agg(F.collect_list("event_id").alias("event_ids"))),
    "single_difference": lambda s, d: _events(s, d).select("event_id", cost.difference(F.col("input_tokens"), F.col("output_tokens")).alias("step")),
    "availability_promotion": lambda s, d: _events(s, d).groupBy("task_id").agg(X.promote_availability(X.usage_availability([F.col("input_tokens"), F.col("cache_write_tokens")])).alias("availability")),
    "usage_availability": lambda s, d: _events(s, d).select("event_id", X.usage_availability([F.col(t) for t in TOKENS]).alias("availability")),
    "usage_mapping": lambda s, d: _events(s, d).select("event_id", X.subtract_cached(F.col("input_tokens"), F.col("cache_read_tokens"), F.col("cache_write_tokens")).alias("input_only")),
}


def _time(day: str):
    import datetime

    return datetime.datetime.fromisoformat(day + "T00:00:00+00:00")


_E = B.duck_sql(B.EVENTS)
_L = f"""with e as ({_E}), l0 as (
select 1 as v, substr(sha256(to_json([cast(task_id as varchar), source, cast(event_id as varchar)])::varchar), 1, 32) as id, ts, task_id, model, harness, backend, source,
  case when actual_micros is not null then 'metered' when estimated_micros is not null then 'token_equivalent' else 'unpriced' end as pricing_basis,
  coalesce(actual_micros, estimated_micros) as amount_micros, 'USD' as currency, coalesce(input_tokens, 0) as input_tokens, coalesce(output_tokens, 0) as output_tokens,
  coalesce(cache_read_tokens, 0) as cache_read_tokens, coalesce(cache_write_tokens, 0) as cache_write_tokens,
  case when input_tokens is null or output_tokens is null or cache_read_tokens is null or cache_write_tokens is null then 'partial' else 'complete' end as coverage
from e), ledger as (select *, substr(sha256(to_json({{'amountMicros': amount_micros, 'backend': backend, 'cacheReadTokens': cache_read_tokens, 'cacheWriteTokens': cache_write_tokens, 'coverage': coverage, 'currency': currency, 'harness': harness,
  'id': id, 'inputTokens': input_tokens, 'model': model, 'outputTokens': output_tokens, 'pricingBasis': pricing_basis, 'source': source, 'taskId': cast(task_id as varchar), 'ts': epoch_us(ts) // 1000, 'v': v}})::varchar), 1, 16) as c from l0)"""
_M = """count(*) as records, coalesce(sum(amount_micros) filter (pricing_basis = 'metered'), 0)::bigint as metered_micros,
  coalesce(sum(amount_micros) filter (pricing_basis = 'token_equivalent'), 0)::bigint as token_equivalent_micros, count(*) filter (pricing_basis = 'unpriced') as unpriced,
  coalesce(sum(input_tokens), 0)::bigint as input_tokens, coalesce(sum(output_tokens), 0)::bigint as output_tokens, coalesce(sum(cache_read_tokens), 0)::bigint as cache_read_tokens,
  coalesce(sum(cache_write_tokens), 0)::bigint as cache_write_tokens,
  case when count(*) = 0 then 'none' when bool_or(coverage = 'partial' or pricing_basis = 'unpriced') then 'partial' else 'complete' end as coverage,
""" + ",\n  ".join(f"count(*) filter (source = '{s}') as {s}_records, coalesce(sum(amount_micros) filter (pricing_basis = 'metered' and source = '{s}'), 0)::bigint as {s}_metered_micros" for s in cost.SOURCES)


def _delta(field: str) -> str:
    last = f"last_value(case when usage_kind = 'cumulative' then {field} end ignore nulls) over (partition by task_id, session_id order by sequence, event_id rows between unbounded preceding and 1 preceding)"
    return f"case when usage_kind <> 'cumulative' or {field} is null then {field} else greatest({field} - coalesce({last}, 0), 0) end as {field}, usage_kind = 'cumulative' and coalesce({field} < {last}, false) as back_{field}"


_D = f"""with e as ({_E}), d0 as (select * exclude (input_tokens, output_tokens, actual_micros), {_delta('input_tokens')}, {_delta('output_tokens')}, {_delta('actual_micros')} from e),
d as (select *, back_input_tokens or back_output_tokens or back_actual_micros as backward from d0)"""


def _totals_sql(key: str) -> str:
    return f"""{_D} select task_id, {key}, sum(input_tokens)::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens,
  case when count(*) = count(coalesce(actual_micros, estimated_micros)) then sum(coalesce(actual_micros, estimated_micros))::bigint end as total_micros,
  sum(coalesce(actual_micros, estimated_micros))::bigint as lower_bound_micros,
  case when bool_or(actual_micros is not null) and bool_or(actual_micros is null and estimated_micros is not null) then 'mixed' when bool_or(actual_micros is not null) then 'provider_reported'
    when bool_or(estimated_micros is not null) then 'local_estimate' else 'none' end as cost_source,
  case when bool_and(coverage = 'unavailable') then 'unavailable' when bool_and(coverage = 'known_zero') then 'known_zero' when bool_and(coverage in ('complete', 'known_zero')) then 'complete' else 'partial' end as coverage,
  case when count(distinct cost_basis) = 1 then max(cost_basis) else 'unknown' end as cost_basis,
  count(distinct session_id) as sessions, count(distinct (session_id, turn_id)) as turns, count(distinct model) as models, count(*) as observations from d group by task_id, {key}"""


_TIERS = f"""with e as ({_E}), u as (select *, {_MODEL} as m, event_id % 3 = 0 as one, coalesce(input_tokens, 0) as i, coalesce(output_tokens, 0) as n, coalesce(cache_write_tokens, 0) as w, coalesce(cache_read_tokens, 0) as r from e),
  x as (select *, one and (m = 'beta' and i + r + w > 60 or m = 'delta' and i + r + w > 80) as long from u),
  y as (select *, case m when 'alpha' then 3.0e0 when 'beta' then case when long then 4.0e0 else 2.0e0 end when 'gamma' then 1.0e0 when 'delta' then case when long then 2.5e0 else 1.25e0 end end as ri,
    case m when 'alpha' then 15.0e0 when 'beta' then case when long then 12.0e0 else 8.0e0 end when 'gamma' then 4.0e0 when 'delta' then case when long then 15.0e0 else 10.0e0 end end as ro,
    case m when 'alpha' then 3.0e0 * 0.1e0 when 'beta' then case when long then 1.0e0 else 0.5e0 end when 'delta' then case when not long then 0.125e0 end end as rr,
    case m when 'alpha' then 3.0e0 * 1.25e0 when 'delta' then case when not long then 1.25e0 * 1.25e0 end end as rw from x),
  p as (select *, case when m = 'omega' or (r > 0 and rr is null) or (w > 0 and rw is null) then null else floor(((i / 1e6) * ri + (w / 1e6) * coalesce(rw, 0) + (r / 1e6) * coalesce(rr, 0) + (n / 1e6) * ro) * 1e6 + 0.5) / 1e6 end as usd from y)"""

SQL = {
    "ledger_totals": f"{_L} select {_M} from ledger",
    "ledger_by_keys": f"{_L} select model, source, case when grouping(model) = 0 then 1 else 0 end as level, {_M} from ledger where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-20' group by grouping sets ((model, source), ())",
    "task_summary_sets": f"{_L} select task_id, case when grouping(model) = 0 then 'model' when grouping(harness) = 0 then 'harness' when grouping(backend) = 0 then 'backend' when grouping(source) = 0 then 'source' else 'total' end as part, "
    f"case when grouping(model) = 0 then model when grouping(harness) = 0 then harness when grouping(backend) = 0 then backend when grouping(source) = 0 then source end as \"value\", {_M} from ledger "
    "group by grouping sets ((task_id, model), (task_id, harness), (task_id, backend), (task_id, source), (task_id))",
    "ledger_rows": f"{_L} select * from ledger",
    "dedup_first_wins": "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_extendedprice) = 1",
    "dedup_last_wins": f"with e as ({_E}) select task_id, model, event_id, ordinal, input_tokens, min(ordinal) over (partition by task_id, model) as position from e qualify row_number() over (partition by task_id, model order by ordinal desc) = 1",
    "supersede_chain": f"with e as ({_E}) select 0::bigint as task_id, event_id, ordinal, replay_of from e where event_id not in (select replay_of from e where replay_of is not null)",
    "cumulative_delta": f"{_D} select event_id, input_tokens, output_tokens, actual_micros, backward from d",
    "cumulative_delta_reset_all": f"""with e as ({_E}), b as (select event_id, session_id, coalesce(input_tokens, 0) as i, coalesce(output_tokens, 0) as o, lag(coalesce(input_tokens, 0)) over w as pi, lag(coalesce(output_tokens, 0)) over w as po
  from e window w as (partition by session_id order by event_id)), r as (select *, coalesce(i < pi, false) or coalesce(o < po, false) as reset from b)
  select event_id, session_id, case when reset then i else i - coalesce(pi, 0) end as input_tokens, case when reset then o else o - coalesce(po, 0) end as output_tokens, reset from r""",
    "model_segments": f"""with e as ({_E}), f as (select *, case when model is distinct from lag(model) over w then 1 else 0 end as n from e window w as (partition by task_id order by ts, session_id, sequence, event_id)),
  g as (select *, sum(n) over (partition by task_id order by ts, session_id, sequence, event_id rows unbounded preceding)::bigint as segment from f)
  select task_id, segment, model, count(*) as observations, count(distinct turn_id) as turns, sum(input_tokens)::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens from g group by task_id, segment, model""",
    "task_cost": _totals_sql("harness"),
    "task_cost_by_model": _totals_sql("model"),
    "price_lookup": f"""with e as ({_E}), t as (select event_id, (input_tokens * case event_id % 5 when 0 then 3000000 when 1 then 2000000 when 2 then 1000000 when 3 then 1250000 end
  + output_tokens * case event_id % 5 when 0 then 15000000 when 1 then 8000000 when 2 then 4000000 when 3 then 10000000 end)::bigint as pico_usd from e)
  select event_id, pico_usd, ((pico_usd + 500000) // 1000000)::bigint as priced_micros from t""",
    "price_tiers": f"""{_TIERS} select event_id, case m when 'alpha' then 'anthropic' when 'gamma' then 'google' when 'omega' then null else 'openai' end as price_table, usd from p""",
    "price_override": f"""{_TIERS}, o as (select *, event_id % 11 < 2 as given, input_tokens is not null and output_tokens is not null as known, m = 'alpha' and event_id % 2 = 1 as oa, m = 'beta' and event_id % 2 = 0 as ob from p),
  q as (select *, case when event_id % 7 = 1 then 0.25e0 end as actual_usd, case when given then case when event_id % 11 = 0 then 0.5e0 end when not known then null
    when ob then ((i * 10000000 + n * 20000000 + w * 20000000 + r * 5000000 + 500000) // 1000000) / 1e6 when oa then case when w = 0 and r = 0 then ((i * 1000000 + n * 2000000 + 500000) // 1000000) / 1e6 end else usd end as est from o)
  select event_id, actual_usd, est::double as estimated_usd, case when est is not null then case when given then 'external' when ob then 'override' when oa then 'own' when m = 'alpha' then 'anthropic' when m = 'gamma' then 'google' else 'openai' end end as event_price_table,
    case when est is not null and not given then case when ob then '2025-02-02' when oa then null else '2025-01-01' end end as pricing_revision, case when actual_usd is not null then 'provider_reported' when est is not null then 'local_estimate' else 'none' end as cost_source,
    concat_ws(',', case when event_id % 7 = 0 then 'invalid_token_usage' end, case when not given and known and est is null then case when oa then 'no_pricing_data' when m = 'omega' then 'unpriced_model' else 'no_pricing_data' end end) as diagnostics from q""",
    "price_export": r"""with p as (select 'm-' || p_partkey as model, '{"cached_rate":' || coalesce(regexp_replace(cast(case when p_size % 3 = 0 then p_size / 8 end as varchar), '\.0$', ''), 'null') || ',"cached_unpriced":' || (p_size > 25) || ',"input_rate":' || regexp_replace(cast(p_size * 0.5e0 as varchar), '\.0$', '')
  || ',"long_after":' || coalesce(cast(case when p_size % 2 = 0 then p_size * 1000 end as varchar), 'null') || ',"model":"m-' || p_partkey || '","output_rate":' || regexp_replace(cast(p_retailprice as varchar), '\.0$', '') || ',"price_table":"' || p_brand || '"}' as line from part) select *, sha256(line) as hash from p""",
    "cost_report": f"""with e as ({_E}), f as (select *, case when actual_micros is not null then 'provider_reported' when estimated_micros is not null then 'local_estimate' else 'none' end as cs from e),
  g as (select *, case when cs <> 'none' then 'r' || (event_id % 3) end as rv, case when cs = 'local_estimate' then case when event_id % 2 = 0 then 'openai' else 'anthropic' end end as pt, case when cs = 'none' and event_id % 4 <> 0 then model end as um from f)
  select task_id, case when count(*) filter (cs = 'none') > 0 then 'partial' else 'complete' end as status, case when count(*) = count(coalesce(actual_micros, estimated_micros)) then sum(coalesce(actual_micros, estimated_micros))::bigint end as total_micros,
    sum(actual_micros)::bigint as actual_micros, sum(estimated_micros)::bigint as estimated_micros, sum(input_tokens)::bigint as input_tokens, count(*) as events, count(distinct (session_id, turn_id)) as turns,
    case when bool_or(cs = 'provider_reported') and bool_or(cs = 'local_estimate') then 'mixed' when bool_or(cs = 'provider_reported') then 'provider_reported' when bool_or(cs = 'local_estimate') then 'local_estimate' else 'none' end as cost_source,
    max(rv) as revision, count(*) filter (cs <> 'none') as priced_events, count(*) filter (cs = 'none') as unpriced_events, coalesce(string_agg(distinct rv, ',' order by rv), '') as revisions, coalesce(string_agg(distinct pt, ',' order by pt), '') as price_tables, coalesce(string_agg(distinct um, ',' order by um), '') as unknown_models
  from g group by task_id union all select -1, 'unavailable', null, null, null, null, null, null, null, null, null, null, null, null, null""",
    "breakdown_merge": f"""with e as ({_E}) select task_id, harness, case when count(*) = count(coalesce(actual_micros, estimated_micros)) then sum(coalesce(actual_micros, estimated_micros))::bigint end as total_micros, sum(actual_micros)::bigint as actual_micros,
    sum(estimated_micros)::bigint as estimated_micros, sum(input_tokens)::bigint as input_tokens, count(*) as events, count(distinct (model, turn_id)) as turns,
    case when bool_or(actual_micros is not null) and bool_or(actual_micros is null and estimated_micros is not null) then 'mixed' when bool_or(actual_micros is not null) then 'provider_reported' when bool_or(estimated_micros is not null) then 'local_estimate' else 'none' end as cost_source,
    case when bool_and(coverage = 'unavailable') then 'unavailable' when bool_and(coverage = 'known_zero') then 'known_zero' when bool_and(coverage in ('complete', 'known_zero')) then 'complete' else
      case when bool_or(coverage not in ('complete', 'known_zero')) then 'partial' end end as coverage from e group by task_id, harness""",
    "report_diagnostics": f"""with e as ({_E}), k as (select task_id, case event_id % 5 when 0 then 'malformed_record' when 1 then 'malformed_record' when 2 then 'duplicate_event' when 4 then 'missing_token_usage' end as code from e where event_id % 2 = 1)
  select task_id, case code when 'malformed_record' then 29 when 'duplicate_event' then 27 else 1 end as place, code, case code when 'duplicate_event' then 'info' else 'warn' end as level, count(*) as count from k where code is not null group by task_id, code""",
    "ledger_validation": f"{_L} select id, case ascii(id) % 9 when 0 then 'model' when 1 then 'inputTokens' when 2 then case when pricing_basis <> 'unpriced' then 'amountMicros' else '' end when 3 then 'harness' else '' end as errors from ledger",
    "sequence_numbers": f"with e as ({_E}) select event_id, row_number() over (partition by session_id order by ts, ordinal) as sequence from e",
    "stage_total": "select l_orderkey as task_id, case when count(*) = count(*) filter (l_linenumber < 7) then sum(cast(l_quantity / 1000 as decimal(28, 9)))::double end as stage_total_usd, count(*) as stages from lineitem group by l_orderkey",
    "contributing_events": f"with e as ({_E}) select task_id, event_id from e where event_id % 3 <> 0",
    "single_difference": f"with e as ({_E}) select event_id, case when input_tokens is null then null when output_tokens is null then input_tokens else greatest(input_tokens - output_tokens, 0) end as step from e",
    "availability_promotion": f"""with e as ({_E}), a as (select task_id, case when input_tokens is null and cache_write_tokens is null then 'unavailable' when input_tokens is null or cache_write_tokens is null then 'partial' when input_tokens = 0 and cache_write_tokens = 0 then 'known_zero' else 'available' end as v from e)
  select task_id, case when bool_and(v = 'unavailable') then 'unavailable' when bool_and(v = 'known_zero') then 'known_zero' when bool_and(v in ('available', 'known_zero')) then 'available' else 'partial' end as availability from a group by task_id""",
    "usage_availability": f"""with e as ({_E}) select event_id, case when input_tokens is null and output_tokens is null and cache_read_tokens is null and cache_write_tokens is null then 'unavailable'
  when input_tokens is null or output_tokens is null or cache_read_tokens is null or cache_write_tokens is null then 'partial'
  when input_tokens = 0 and output_tokens = 0 and cache_read_tokens = 0 and cache_write_tokens = 0 then 'known_zero' else 'available' end as availability from e""",
    "usage_mapping": f"with e as ({_E}) select event_id, case when input_tokens is null then null else greatest(0, input_tokens - coalesce(cache_read_tokens, 0) - coalesce(cache_write_tokens, 0)) end as input_only from e",
}
