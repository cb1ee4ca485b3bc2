"""The surveyed records as projections of the driver's tables, and the same text as SQL for the oracle.

Every projection is one SELECT that Spark and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare

#: events as cost events: a task a user, a model an event type, tokens from props, nulls derived from the id.
EVENTS = """
select event_id, event_id as ordinal, user_id as task_id, user_id * 10 + event_id % 3 as session_id, event_id % 7 as turn_id, event_id as sequence,
  event_type as model, case when event_id % 2 = 0 then 'pi' else 'native' end as harness, case when event_id % 5 < 2 then 'hosted' else 'local' end as backend,
  case when event_id % 3 = 0 then 'provider_reported' when event_id % 3 = 1 then 'local_estimate' else 'none' end as source, ts,
  case when event_id % 2 = 0 then 'cumulative' else 'delta' end as usage_kind,
  case when event_id % 11 = 0 then null else {k} end as input_tokens, case when event_id % 13 = 0 then null else ({k} * 7) % 100 end as output_tokens,
  {k} % 10 as cache_read_tokens, case when event_id % 17 = 0 then null else {k} % 4 end as cache_write_tokens,
  case when event_id % 3 = 0 then cast(floor(value * 1000000 + 0.5) as bigint) end as actual_micros,
  case when event_id % 3 = 1 then cast(floor(value * 500000 + 0.5) as bigint) end as estimated_micros,
  case when event_id % 19 = 0 then 'unavailable' when event_id % 7 = 0 then 'known_zero' when event_id % 5 = 0 then 'partial' else 'complete' end as coverage,
  case when event_type in ('click', 'view') then 'metered' else 'token_equivalent' end as cost_basis,
  case when event_id % 23 = 5 then event_id - 23 end as replay_of
from events
"""
SPARK_K = "cast(get_json_object(props, '$.k') as bigint)"
DUCK_K = "cast(json_extract_string(props, '$.k') as bigint)"

#: orders as merged changes, a repository a market segment of the customer.
CHANGES = """
select o_orderkey as pr, c_mktsegment as repo, o_orderdate as merged_at, o_orderkey % 17 <> 0 as has_label, o_totalprice as size, o_orderpriority as convention
from orders join customer on o_custkey = c_custkey
"""
#: lineitem as fixes of the order; (order, number) repeats, so the content makes the identity.
FIXES = """
select l_orderkey as pr, concat(cast(l_orderkey as {text}), '-', cast(l_linenumber as {text}), '-', cast(l_partkey as {text}), '-', cast(l_suppkey as {text})) as fix, l_shipdate as fixed_at,
  case when l_returnflag = 'R' then 'revert' when l_returnflag = 'A' then 'repair_reference' when l_linestatus = 'O' then 'szz' else 'regression_issue' end as proxy,
  case when l_quantity > 40 then 'high' when l_quantity > 20 then 'medium' else 'low' end as confidence,
  concat('line ', cast(l_linenumber as {text})) as evidence, case when l_quantity < 5 then 'too_small' end as exclusion, cast(l_extendedprice * 100 as bigint) as ordinal
from lineitem
"""
#: orders scored for their risk: the outcome is late or unknown for some.
SCORES = """
select c_mktsegment as repo, o_orderkey as merge_sha, o_orderkey as ordinal, o_orderdate as merged_at, (o_orderkey * 7919) % 1000 / 1000.0e0 as score,
  case when o_orderkey % 2 = 0 then 0.5e0 else 0.3e0 end as threshold, case when o_orderpriority like '1%' then 'baseline-v1' else 'baseline-v0' end as scorer_id
from orders join customer on o_custkey = c_custkey
"""
OUTCOMES = """
select c_mktsegment as repo, o_orderkey as merge_sha, 30 as horizon_days, l_linenumber * 1000000 + l_partkey as ordinal,
  case when l_returnflag = 'R' then false when l_returnflag = 'A' then true end as survived
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey where l_linenumber <= 2
"""
#: labels as two raters.
RATERS = "select doc_id, cast(quality as {text}) as x, cast(toxic as {text}) as y from labels"


def spark_sql(text: str) -> str:
    return text.replace("{k}", SPARK_K).replace("{text}", "string")


def duck_sql(text: str) -> str:
    return text.replace("{k}", DUCK_K).replace("{text}", "varchar")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one whose files give fewer tasks than there are cores (a file of one row group is one) is dealt over all of them. Filters and pruning still reach the scan."""
    rows = prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def project(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The projection over the folder's tables; the scan reads only the columns it names."""
    import re

    names = set(re.findall(r"\b(?:from|join) (\w+)", text))
    frames = {f"in_{n}": read(spark, sf_dir, n) for n in names}
    bound = re.sub(r"\b(from|join) (\w+)", lambda m: f"{m[1]} {{in_{m[2]}}}", spark_sql(text))
    return spark.sql(bound, **frames)
