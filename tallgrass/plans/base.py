"""Registry of queries, and the relations that they derive from the tables.

A query is a function (spark, sf_dir) -> DataFrame; its oracle is SQL over the
same tables. Derived relations are written twice, as select expressions and as
SQL common table expressions, and stand in for data that the tables lack.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.functions.schedule import epoch_ms

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *ctes: str):
    """Registers a query; ``ctes`` go before its SQL."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"query {name} is there already")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _wide(f(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            recursive = "recursive " if sql.startswith("recursive ") else ""
            body = sql.removeprefix("recursive ").lstrip()
            parts = [*ctes]
            if body.startswith(","):
                head = "with " + recursive + (", ".join(parts) + ", " if parts else "") + body[1:].lstrip()
            else:
                head = ("with " + recursive + ", ".join(parts) + " " if parts else "") + body
            ORACLES[name] = head
        return f

    return add


def _wide(df: DataFrame) -> DataFrame:
    """Counts and ranks as 64-bit numbers, as SQL engines give them."""
    narrow = [c for c, kind in df.dtypes if kind in ("int", "smallint", "tinyint")]
    return df.withColumns({c: F.col(c).cast("long") for c in narrow}) if narrow else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as messages of sessions."""
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id as session_id",
        "turn as seq",
        "role",
        "text as content",
        "concat('m', conv_id, '-', turn) as id",
        "concat('turn-', turn div 2) as turn_id",
        "case when role = 'system' then 'system' when role = 'user' then if(conv_id % 2 = 0, 'voice-user', 'text-user') "
        "when turn % 4 = 1 then 'agent-result' when conv_id % 2 = 0 then 'agent-presentation' else 'realtime-direct' end as source",
        "if(role = 'assistant', concat('t', conv_id, '-', (turn div 2) % 2), null) as task_id",
        "if(role = 'assistant' and turn % 4 = 3, array(concat('t', conv_id, '-', 0)), cast(array() as array<string>)) as task_ids",
        "conv_id * 1000000 + turn * 1000 as time_ms",
    )


MESSAGES = """msg as (select conv_id as session_id, turn as seq, role, text as content,
  concat('m', conv_id, '-', turn) as id, concat('turn-', turn // 2) as turn_id,
  case when role = 'system' then 'system' when role = 'user' then (case when conv_id % 2 = 0 then 'voice-user' else 'text-user' end)
  when turn % 4 = 1 then 'agent-result' when conv_id % 2 = 0 then 'agent-presentation' else 'realtime-direct' end as source,
  case when role = 'assistant' then concat('t', conv_id, '-', (turn // 2) % 2) end as task_id,
  case when role = 'assistant' and turn % 4 = 3 then [concat('t', conv_id, '-', 0)] else []::varchar[] end as task_ids,
  conv_id * 1000000 + turn * 1000 as time_ms from conversations)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client events of sources, in order of seq."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("source"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("e"), (F.col("event_id") % 37).cast("string")).alias("id"),
        F.col("event_type").alias("name"),
        epoch_ms(F.col("ts")).alias("time_ms"),
        F.col("value"),
        F.col("props"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


EVENTS = """ev as (select user_id as source, event_id as seq, concat('e', event_id % 37) as id, event_type as name,
  epoch_us(ts) // 1000 as time_ms, value, props, cast(json_extract_string(props, '$.k') as bigint) as k from events)"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as snapshots of tasks; a task has several."""
    return events(spark, sf_dir).selectExpr(
        "concat('t', source % 60) as id",
        "seq",
        "time_ms",
        "case name when 'click' then 'queued' when 'view' then 'running' when 'signup' then 'scheduled' "
        "when 'purchase' then 'completed' else if(k % 2 = 0, 'failed', 'delegated') end as status",
        "if(k % 10 = 0, 'system', 'user') as scope",
        "if(k % 4 = 0, 'reminder', 'work') as kind",
        "concat('o', source % 7) as owner_id",
        "concat('s', source % 11) as session_id",
        "time_ms - (k % 5) * 60000 as created_at",
        "if(name in ('view', 'error'), time_ms - 1000, null) as started_at",
        "if(name in ('purchase', 'error'), time_ms, null) as completed_at",
        "k * 100 as elapsed_ms",
        "case when k % 9 = 0 then 'pending' end as auth",
        "case when k % 8 = 0 then 'pending' end as request",
        "case when k % 16 = 0 then 'authorization' else 'choice' end as request_kind",
        "case when k % 3 = 0 then concat('d', k) end as delegate",
        "case when k % 2 = 0 then concat('ds', k) end as delegate_session",
        "case k % 4 when 0 then 'pending' when 1 then 'delivering' when 2 then 'delivered' else 'none' end as notification",
        "case when k % 6 = 0 then 'silent' else 'announce' end as policy",
        "k as priority",
        "case when k % 5 = 0 then concat('lane', k % 3) end as lane",
        "2 as lane_limit",
        "seq div 500 as pool",
    )


TASKS = """tk as (select concat('t', source % 60) as id, seq, time_ms,
  case name when 'click' then 'queued' when 'view' then 'running' when 'signup' then 'scheduled'
  when 'purchase' then 'completed' else (case when k % 2 = 0 then 'failed' else 'delegated' end) end as status,
  case when k % 10 = 0 then 'system' else 'user' end as scope, case when k % 4 = 0 then 'reminder' else 'work' end as kind,
  concat('o', source % 7) as owner_id, concat('s', source % 11) as session_id, time_ms - (k % 5) * 60000 as created_at,
  case when name in ('view', 'error') then time_ms - 1000 end as started_at,
  case when name in ('purchase', 'error') then time_ms end as completed_at, k * 100 as elapsed_ms,
  case when k % 9 = 0 then 'pending' end as auth, case when k % 8 = 0 then 'pending' end as request,
  case when k % 16 = 0 then 'authorization' else 'choice' end as request_kind,
  case when k % 3 = 0 then concat('d', k) end as delegate, case when k % 2 = 0 then concat('ds', k) end as delegate_session,
  case k % 4 when 0 then 'pending' when 1 then 'delivering' when 2 then 'delivered' else 'none' end as notification,
  case when k % 6 = 0 then 'silent' else 'announce' end as policy, k as priority,
  case when k % 5 = 0 then concat('lane', k % 3) end as lane, 2 as lane_limit, seq // 500 as pool from ev)"""

#: An instant near the end of the events, for rules that compare with the present.
NOW = 1_706_650_000_000


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest snapshot of each task id."""
    from tallgrass.operators.history import latest_tasks

    return latest_tasks(
        tasks(spark, sf_dir).withColumnRenamed("id", "task_id").withColumn("path", F.lit("")).withColumn("line", F.col("seq"))
    ).withColumnRenamed("task_id", "id").drop("path", "line")


LATEST = """lt as (select * from (select *, row_number() over (partition by id order by created_at desc, time_ms desc, seq desc) as rn
  from tk) where rn = 1)"""
