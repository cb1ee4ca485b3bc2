"""Queries that run as streams over the events table, whole, in several batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import fresh_dir
from ..streaming import ledger, tracker
from . import bindings as B
from . import cost_queries


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as usage records: some replay the one before of their task, some come again later and from another harness, some are invalid."""
    events = spark.sql(
        """select *, case when event_id % 23 = 5 then lag(event_id) over (partition by task_id order by event_id) end as replays,
        case event_id % 3 when 0 then 'per_token_api' when 1 then 'subscription' else 'unknown' end as basis, case when event_id % 4 = 0 then 'own/2' end as contract from {e}""",
        e=B.project(spark, sf_dir, B.EVENTS),
    ).drop("replay_of", "cost_basis").withColumnsRenamed({"replays": "replay_of", "basis": "cost_basis"})
    again = events.where("event_id % 9 = 2").withColumns({"ordinal": F.col("ordinal") + 500, "input_tokens": F.lit(7).cast("long"), "harness": F.lit("pi")})
    invalid = events.where("event_id % 31 = 1").withColumns({"event_id": -F.col("event_id"), "input_tokens": F.lit(-1).cast("long")})
    return tracker.with_defaults(events.unionByName(again).unionByName(invalid))


def _in_parts(rows: DataFrame, column: str, parts: int, name: str) -> tuple[DataFrame, str]:
    """``rows`` written in ``parts`` one after the other by rising ``column``, as a stream of one file a batch; and a folder beside it."""
    spark = rows.sparkSession
    home = fresh_dir(spark, name)
    most = rows.agg(F.max(column)).first()[0] or 0
    for i in range(parts):
        part = F.least(F.floor(F.col(column) * parts / (most + 1)), F.lit(parts - 1))
        rows.where(part == i).coalesce(1).write.mode("append").parquet(f"{home}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{home}/in"), home


def _live(spark: SparkSession, sf_dir: str, parts: int = 4) -> DataFrame:
    """The records as they come in: a quarter by rising ordinal, then the next one, each tracked from where the last stopped. All tasks write and read each of them."""
    rows = _records(spark, sf_dir)
    home = fresh_dir(spark, "live")
    most = rows.agg(F.max("ordinal")).first()[0] or 0
    part = F.least(F.floor(F.col("ordinal") * parts / (most + 1)), F.lit(parts - 1)).cast("int")
    rows.withColumn("part", part).write.partitionBy("part").parquet(f"{home}/parts")
    staged = spark.read.schema(StructType([*rows.schema.fields, StructField("part", IntegerType())])).parquet(f"{home}/parts")
    for i in range(parts):
        staged.where(F.col("part") == i).drop("part").write.mode("append").parquet(f"{home}/in")
        tracker.run_tracker(spark.readStream.schema(rows.schema).parquet(f"{home}/in"), f"{home}/out", f"{home}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{home}/out")


def _appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The even events, then all of them two days later: what is there already stays as it is."""
    events = B.project(spark, sf_dir, B.EVENTS)
    rows = events.where("event_id % 2 = 0").withColumn("ordinal", F.lit(0).cast("long")).union(events.withColumns({"ts": F.col("ts") + F.expr("interval 2 days"), "ordinal": F.lit(1).cast("long")}))
    stream, home = _in_parts(rows, "ordinal", 2, "appended")
    ledger.append_to_ledger(stream, f"{home}/ledger", f"{home}/checkpoint", buckets=8).awaitTermination()
    return ledger.read_ledger(spark, f"{home}/ledger").select("id", "task_id", "ts", F.date_format("day", "yyyy-MM-dd").alias("day"))


QUERIES = {
    "live_task_cost": lambda s, d: tracker.latest_snapshots(_live(s, d)),
    "live_record_results": lambda s, d: tracker.record_results(_live(s, d)),
    "ledger_appended": _appended,
}

_E = B.duck_sql(B.EVENTS)
_FIELDS = (*tracker.TOKENS, *tracker.AMOUNTS)
_R = f"""with e as ({_E}), r as (select * replace (cast(task_id as varchar) as task_id), case when event_id % 23 = 5 then lag(event_id) over (partition by task_id order by event_id) end as target,
    case event_id % 3 when 0 then 'per_token_api' when 1 then 'subscription' else 'unknown' end as basis, case when event_id % 4 = 0 then 'own/2' else harness || '/1' end as contract from e)"""


def _step(field: str) -> str:
    last = f"last_value(case when usage_kind = 'cumulative' then {field} end ignore nulls) over (partition by task_id, harness, contract, session_id order by sequence rows between unbounded preceding and 1 preceding)"
    return f"case when usage_kind <> 'cumulative' or {field} is null then {field} else greatest({field} - coalesce({last}, 0), 0) end as {field}"


SQL = {
    "live_task_cost": f"""{_R}, kept as (select * from r x where not exists (select 1 from r y where y.task_id = x.task_id and y.harness = x.harness and y.contract = x.contract and y.target = x.event_id)),
  d as (select * exclude ({', '.join(_FIELDS)}), {', '.join(map(_step, _FIELDS))} from kept), p as (select *, coalesce(actual_micros, estimated_micros) as amount from d)
  select task_id, harness, contract, 'ok' as status, {', '.join(f'sum({t})::bigint as {t}' for t in tracker.TOKENS)}, case when count(*) = count(amount) then sum(amount)::bigint end as total_micros, sum(amount)::bigint as lower_bound_micros,
    case when bool_or(actual_micros is not null) and bool_or(actual_micros is null and estimated_micros is not null) then 'mixed' when bool_or(actual_micros is not null) then 'provider_reported' when bool_or(estimated_micros is not null) then 'local_estimate' else 'none' end as cost_source,
    case when bool_and(coverage = 'unavailable') then 'unavailable' when bool_and(coverage = 'known_zero') then 'known_zero' when bool_and(coverage in ('complete', 'known_zero')) then 'complete' else 'partial' end as coverage,
    case when count(distinct basis) = 1 then max(basis) else 'unknown' end as cost_basis, count(distinct session_id) as sessions, count(distinct (session_id, turn_id)) as turns, count(distinct model) as models, count(*) as observations
  from p group by task_id, harness, contract""",
    "live_record_results": f"{_R} select task_id, count(*) as accepted, count(*) filter (event_id % 9 = 2) as duplicate, count(*) filter (event_id % 31 = 1) as rejected from r group by task_id",
    "ledger_appended": f"""{cost_queries._L}, n as (select event_id, substr(sha256(to_json([cast(task_id as varchar), source, cast(event_id as varchar)])::varchar), 1, 32) as id, task_id, case when event_id % 2 = 0 then ts else ts + interval 2 days end as ts from e)
  select id, task_id, ts, strftime(ts, '%Y-%m-%d') as day from n""",
}
