"""Queries over files that the engine writes and reads again."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallgrass.operators import ledger as L
from tallgrass.operators.shelf import read_cases
from tallgrass.plans.base import EVENTS, LATEST, TASKS, events, latest, query, table
from tallgrass.sources import journal as J
from tallgrass.sources import store
from tallgrass.sources.scratch import scratch
from tallgrass.streaming import processors as P


def _journals(spark, d):
    """A journal file per conversation, in a folder of its own; those of every
    seventh have a damaged line after the first."""
    rows = table(spark, d, "conversations")
    name = F.concat(F.lit("c"), "conv_id")
    line = F.to_json(
        F.struct(
            F.lit("v1").alias("schema"), name.alias("sessionId"), (F.col("turn") + 1).alias("seq"),
            F.lit("2026-01-01T00:00:00Z").alias("time"), F.concat("role", F.lit("/message")).alias("type"),
            F.struct(F.col("text").alias("content")).alias("payload"),
        )
    )
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"])
    head = F.concat(F.lit('{"schema":"v1","type":"session","version":1,"sessionId":"'), name, F.lit('"}'))
    bad = F.when(F.col("conv_id") % 7 == 0, F.array(F.lit('{"cut'))).otherwise(F.array().cast("array<string>"))
    whole = F.array_join(F.concat(F.array(head), bad, "lines"), "\n")
    root = scratch(spark, "journals")
    files = rows.groupBy("conv_id").agg(lines.alias("lines"))
    files = files.select(J.segment(F.concat(F.lit("o"), F.col("conv_id") % 3)).alias("owner"), J.segment(name).alias("session"), whole.alias("value"))
    files.write.partitionBy("owner", "session").text(root)
    return J.decode_journals(J.read_journals(spark, root, "part-*.txt"))


@query("journal_scan", "select conv_id, turn + 1 as seq, role, text as content from conversations where conv_id % 7 <> 0")
def journal_scan(spark, d):
    found, _ = _journals(spark, d)
    return found.select(
        F.substring("sessionId", 2, 20).cast("long").alias("conv_id"),
        "seq",
        F.substring_index("type", "/", 1).alias("role"),
        F.variant_get("payload", "$.content", "string").alias("content"),
    )


@query("journal_health", "select count(distinct conv_id) as files, count(distinct conv_id) filter (conv_id % 7 = 0) as damaged, 0 as torn_tails from conversations")
def journal_health(spark, d):
    return J.inspect(_journals(spark, d)[1])


@query("path_segments", """select doc_id, rtrim(translate(to_base64(encode(concat(source, '?', doc_id, '/', substr(text, 1, 30)))), '+/', '-_'), '=') as segment from documents""")
def path_segments(spark, d):
    name = F.concat("source", F.lit("?"), F.col("doc_id").cast("string"), F.lit("/"), F.substring("text", 1, 30))
    return table(spark, d, "documents").select("doc_id", J.segment(name).alias("segment"))


@query("journal_caps", """recursive , x as (select lpad(cast(doc_id as varchar), 9, '0') as path, length(text) as bytes, row_number() over (order by doc_id) as rn from documents),
 r as (select cast(0 as bigint) as rn, '' as path, cast(0 as bigint) as files, cast(0 as bigint) as used, false as fits union all
 select rn, path, case when ok then files + 1 else files end, case when ok then used + bytes else used end, ok from (select x.rn, x.path, x.bytes, r.files, r.used,
 r.files < 60 and r.used + x.bytes <= 100000 as ok from r join x on x.rn = r.rn + 1)) select path from r where fits""")
def journal_caps(spark, d):
    path = F.lpad(F.col("doc_id").cast("string"), 9, "0")
    return J.within_caps(table(spark, d, "documents").select(path.alias("path"), F.length("text").alias("bytes")), 60, 100_000)


@query("snapshot_load", "select id, seq, concat(status, '!') as status, priority % 5 = 0 as quarantined from lt", EVENTS, TASKS, LATEST)
def snapshot_load(spark, d):
    root = scratch(spark, "snapshots")
    rows = latest(spark, d).select("id", "seq", "status", "priority", F.lit(1).alias("schema_version"))
    store.save_snapshot(rows, root, 1)
    schema = F.when(F.col("priority") % 5 == 0, 1).otherwise(2)
    store.save_snapshot(rows.withColumn("status", F.concat("status", F.lit("!"))).withColumn("schema_version", schema), root, 2)
    good, bad = store.load_snapshot(spark, root, 2)
    both = good.withColumn("quarantined", F.lit(False)).unionByName(bad.withColumn("quarantined", F.lit(True)))
    return both.select("id", "seq", "status", "quarantined")


@query("snapshot_changes", "select id, case when priority % 3 = 0 then 'other' else status end as status from lt where priority % 3 = 0 or priority % 7 = 0", EVENTS, TASKS, LATEST)
def snapshot_changes(spark, d):
    rows = latest(spark, d).select("id", "status", "priority")
    after = rows.withColumn("status", F.when(F.col("priority") % 3 == 0, "other").otherwise(F.col("status")))
    return store.changed(rows.where("priority % 7 <> 0"), after, "id").select("id", "status")


@query("audit_log", "select source, seq, name, cast(k as bigint) as k from ev union all select source, seq, 'again', cast(k as bigint) from ev where k % 4 = 0", EVENTS)
def audit_log(spark, d):
    path = scratch(spark, "audit")
    rows = events(spark, d).select("source", "seq", "name", "k")
    store.append_audit(rows, path)
    store.append_audit(rows.where("k % 4 = 0").withColumn("name", F.lit("again")), path)
    return spark.read.schema(rows.schema).json(path)


@query("case_lines", """, x as (select seq // 1000 as file, seq, k, row_number() over (partition by seq // 1000 order by seq) as line from ev)
 select file, line, case when k % 7 <> 0 then seq end as case_id, k % 7 = 0 as refused from x where k % 11 <> 0""", EVENTS)
def case_lines(spark, d):
    line = F.when(F.col("k") % 11 == 0, " ").when(F.col("k") % 7 == 0, '{"id": ').otherwise(F.to_json(F.struct(F.col("seq").alias("id"))))
    rows = events(spark, d).select(F.expr("seq div 1000").alias("file"), "seq", line.alias("line"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"])
    root = scratch(spark, "cases")
    rows.groupBy("file").agg(F.array_join(listed, "\n").alias("value")).write.partitionBy("file").text(root)
    good, bad = read_cases(spark, root)
    file = F.regexp_extract("path", "file=([0-9]+)/", 1).cast("long").alias("file")
    good = good.select(file, "line", F.variant_get("case", "$.id", "long").alias("case_id"), F.lit(False).alias("refused"))
    return good.unionByName(bad.select(file, "line", F.lit(None).cast("long").alias("case_id"), F.lit(True).alias("refused")))


@query("log_tail_bytes", """, x as (select seq, concat('gateway.log.', seq % 6) as path, seq % 6 as age, concat('turn-', k % 4) as turn_id, time_ms, 40 + k as bytes from ev),
 y as (select *, row_number() over (partition by path order by seq) as line, sum(bytes) over (partition by path) as size,
 coalesce(sum(bytes) over (partition by path order by seq rows between unbounded preceding and 1 preceding), 0) as start from x)
 select path, line, time_ms from y where age < 5 and turn_id = 'turn-1' and (size <= 5000 or start > size - 5000) order by path, line limit 500""", EVENTS)
def log_tail_bytes(spark, d):
    w, before = "partition by path order by seq", "rows between unbounded preceding and 1 preceding"
    rows = events(spark, d).selectExpr(
        "seq", "concat('gateway.log.', seq % 6) as path", "-(seq % 6) as modified", "concat('turn-', k % 4) as turn_id", "time_ms", "40 + k as bytes"
    )
    rows = rows.selectExpr(
        "*", f"row_number() over ({w}) as line", "sum(bytes) over (partition by path) as size", f"coalesce(sum(bytes) over ({w} {before}), 0) as offset"
    )
    return store.tail_logs(rows, "turn-1", tail_bytes=5000).select("path", "line", "time_ms")


_KINDS = "', '".join((*L.PUBLIC_KINDS, "task.snapshot", "client.ready"))
_TYPED = f"""pe as (select seq, source, k, ['{_KINDS}'][k % 20 + 1] as type, case when k % 9 <> 0 then concat('t', source % 60) end as task_id,
 case when k % 10 = 0 then 'system' else 'user' end as scope from ev)"""
_PUBLIC = "type not in ('task.snapshot', 'client.ready') and task_id is not null and scope <> 'system'"


def _typed(spark, d):
    return events(spark, d).selectExpr(
        "seq", "source", f"element_at(array('{_KINDS}'), cast(k % 20 + 1 as int)) as type",
        "if(k % 9 <> 0, concat('t', source % 60), null) as task_id", "if(k % 10 = 0, 'system', 'user') as scope",
    )


@query("public_task_events", f"select seq, type, task_id from pe where {_PUBLIC}", EVENTS, _TYPED)
def public_task_events(spark, d):
    return L.public_events(_typed(spark, d)).select("seq", "type", "task_id")


def _stream(spark, d):
    """Events as a stream of files, and its schema."""
    path = scratch(spark, "events")
    rows = _typed(spark, d)
    rows.repartition(4, "source").write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path)


@query("event_stream", f"select seq, type, task_id from pe where {_PUBLIC}", EVENTS, _TYPED)
def event_stream(spark, d):
    out = scratch(spark, "published")
    shown = L.public_events(_stream(spark, d)).select("seq", "type", "task_id")
    writer = shown.writeStream.format("json").option("checkpointLocation", scratch(spark, "offsets"))
    writer.trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(shown.schema).json(out)


@query("coalesced_snapshots", "select seq, source from ev", EVENTS)
def coalesced_snapshots(spark, d):
    out = scratch(spark, "versions")
    sink = P.coalesced_sink(_stream(spark, d).select("seq", "source"), out, scratch(spark, "offsets"))
    try:
        sink.processAllAvailable()
    finally:
        sink.stop()
    return spark.read.parquet(out).select("seq", "source")
