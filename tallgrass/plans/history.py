"""Queries over conversations: windows, folds, joins and timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallgrass.operators import admission as A
from tallgrass.operators import history as H
from tallgrass.operators import web as W
from tallgrass.plans.base import EVENTS, MESSAGES, events, messages, query, table
from tallgrass.sources import journal as J



@query("history_last_n", """select conv_id, turn, role, text from (select *, row_number() over (partition by conv_id order by turn desc) rn
 from conversations where role <> 'system') where rn <= 3""")
def history_last_n(spark, d):
    rows = table(spark, d, "conversations").where("role <> 'system'")
    return H.last_n(rows, ["conv_id"], ["turn"], 3)


@query("history_ring", """, f as (select source, id, min(seq) as position, max(seq) as seq from ev group by 1, 2),
 r as (select *, row_number() over (partition by source order by position desc) rn from f)
 select r.source, r.id, r.position, r.seq, ev.value from r join ev on ev.seq = r.seq where rn <= 10""", EVENTS)
def history_ring(spark, d):
    return H.ring(events(spark, d), ["source"], "id", "seq", 10).select("source", "id", "position", "seq", "value")


@query("transcript_budget", """select conv_id, turn from (select *, row_number() over w as rn,
 sum(length(text)) over (partition by conv_id order by turn desc rows between unbounded preceding and current row) as used
 from conversations window w as (partition by conv_id order by turn desc)) where rn = 1 or used <= 800""")
def transcript_budget(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return H.char_budget(rows, ["conv_id"], "turn", "text", 800).select("conv_id", "turn")


@query("presented_results", """, shown as (select distinct session_id, unnest(list_concat(task_ids, [task_id])) as shown from msg
 where source = 'agent-presentation'), v as (select * from msg m where source in ('voice-user', 'text-user', 'realtime-direct', 'agent-presentation')
 or (source = 'agent-result' and task_id is not null and not exists (select 1 from shown s where s.session_id = m.session_id and s.shown = m.task_id)))
 select session_id, seq, source from (select *, row_number() over (partition by session_id order by seq desc) rn from v) where rn <= 40""", MESSAGES)
def presented_results(spark, d):
    return H.visible(messages(spark, d)).select("session_id", "seq", "source")


@query("latest_in_log", """, x as (select name, k, seq, time_ms, min(seq) over (partition by name, k) as position,
 row_number() over (partition by name, k order by seq desc) rn from ev) select name, k, seq, time_ms, position from x where rn = 1""", EVENTS)
def latest_in_log(spark, d):
    rows = events(spark, d).selectExpr("name as session_id", "k as task_id", "seq", "time_ms")
    return H.latest_in_log(rows).selectExpr("session_id as name", "task_id as k", "seq", "time_ms", "position")


_FOLD = """, x as (select source as session_id, k % 6 as message_id, seq, value, name, k from ev)
 select session_id, message_id, max(seq) as seq, min(seq) as position,
 arg_max(value, seq) filter (k % 2 = 0) as value, arg_max(name, seq) filter (k % 3 = 0) as name from x group by 1, 2"""


@query("message_fold", _FOLD, EVENTS)
def message_fold(spark, d):
    carried = F.map_filter(
        F.create_map(F.lit("value"), F.col("value").cast("string"), F.lit("name"), F.col("name")),
        lambda key, _: ((key == "value") & (F.col("k") % 2 == 0)) | ((key == "name") & (F.col("k") % 3 == 0)),
    )
    rows = events(spark, d).select("source", "seq", (F.col("k") % 6).alias("message_id"), carried.alias("payload"))
    out = H.fold_messages(rows.withColumnRenamed("source", "session_id"), ["value", "name"])
    return out.withColumn("value", F.col("value").cast("double"))


@query("project_reducer", """select source, count(*) as n, cast(sum(k) as bigint) as total, arg_max(name, seq) as last_name from ev group by 1""", EVENTS)
def project_reducer(spark, d):
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("total"), F.lit("").alias("last_name"))
    out = J.project(
        events(spark, d).select("source", "seq", "k", "name"), ["source"], "seq", start,
        lambda acc, e: F.struct((acc["n"] + 1).alias("n"), (acc["total"] + e["k"]).alias("total"), e["name"].alias("last_name")),
    )
    return out.select("source", "state.*")


@query("conversation_upsert", """select source as session_id, id, min(seq) as seq, arg_min(time_ms, seq) as created_at,
 arg_max(name, seq) as content, arg_max(k, seq) filter (k % 3 = 0) as cited from ev where id is not null group by 1, 2""", EVENTS)
def conversation_upsert(spark, d):
    rows = events(spark, d).select(
        F.col("source").alias("session_id"), "id", "seq", F.col("time_ms").alias("created_at"),
        F.concat(F.lit("  "), "name", F.lit(" ")).alias("content"), F.col("name").alias("source"),
        F.when(F.col("k") % 3 == 0, F.array("k")).otherwise(F.array().cast("array<bigint>")).alias("citations"),
    )
    out = H.upsert_conversation(rows)
    return out.select("session_id", "id", "seq", "created_at", "content", F.col("citations")[0].alias("cited"))


@query("history_merge", """, live as (select session_id, id, seq, content from msg where seq >= 2),
 old as (select session_id, id, seq, content from msg where seq <= 3 and trim(content) <> ''), b as (select *, 1 as l from live
 union all select *, 0 as l from old o where not exists (select 1 from live v where v.session_id = o.session_id and v.id = o.id))
 select session_id, id, seq from (select *, row_number() over (partition by session_id order by l desc, seq desc) rn from b) where rn <= 5""", MESSAGES)
def history_merge(spark, d):
    rows = messages(spark, d).select("session_id", "id", "seq", "content")
    return H.merge_history(rows.where("seq >= 2"), rows.where("seq <= 3"), 5).select("session_id", "id", "seq")


@query("turn_times", """select session_id, turn_id, min(time_ms) as time_ms from msg where time_ms > 0 group by 1, 2
 union all select session_id, turn_id, null from msg group by 1, 2 having max(time_ms) <= 0""", MESSAGES)
def turn_times(spark, d):
    return H.turn_times(messages(spark, d).select("session_id", "turn_id", "time_ms"))


_TIMELINE = """, m as (select session_id, turn_id, min(seq) as arrival, count(*) as messages, min(time_ms) as tm from msg where seq % 4 <> 2 group by 1, 2),
 t as (select session_id, turn_id, count(*) as tasks, min(time_ms) as tt from (select session_id, concat('turn-', (seq * 7) % 5) as turn_id, time_ms - 1500 as time_ms
 from msg where role = 'assistant') group by 1, 2),
 b as (select session_id, turn_id, arrival, messages, tasks, least(tm, tt) as time_ms from m full join t using (session_id, turn_id)),
 p as (select o.session_id, o.turn_id, min(x.arrival) as before from b o join b x on x.session_id = o.session_id and x.messages is not null
 and x.time_ms > o.time_ms where o.messages is null group by 1, 2)
 select b.session_id, b.turn_id, coalesce(messages, 0) as messages, coalesce(tasks, 0) as tasks, time_ms,
 row_number() over (partition by b.session_id order by coalesce(arrival, before, 4611686018427387904), case when messages is null then 0 else 1 end, time_ms, b.turn_id) as position
 from b left join p on p.session_id = b.session_id and p.turn_id = b.turn_id"""


@query("turn_timeline", _TIMELINE, MESSAGES)
def turn_timeline(spark, d):
    rows = messages(spark, d)
    jobs = rows.where("role = 'assistant'").selectExpr(
        "session_id", "concat('turn-', (seq * 7) % 5) as turn_id", "time_ms - 1500 as time_ms"
    )
    return H.turn_timeline(rows.where("seq % 4 <> 2"), jobs)


_KEY = "lower(regexp_replace(regexp_replace(content, '[\\x{09}-\\x{0D} ]+', ' ', 'g'), '(?:[\\p{P}\\p{S}]|[\\s\\x{0B}\\x{A0}])+', '', 'g'))"


@query("near_repeats", f""", x as (select session_id, role, seq, {_KEY} as key from msg),
 y as (select *, lag(key) over (partition by session_id, role order by seq) as before from x),
 g as (select *, list_distinct([substr(key, i, 2) for i in range(1, length(key))]) as a,
 list_distinct([substr(before, i, 2) for i in range(1, length(before))]) as b from y where before is not null)
 select session_id, role, seq, key = before or (length(key) >= 8 and length(before) >= 8
 and 3 * len(list_intersect(a, b)) >= least(len(a), len(b))) as same from g""", MESSAGES)
def near_repeats(spark, d):
    return H.near_repeats(messages(spark, d)).select("session_id", "role", "seq", "same")


@query("recovery_context", """select session_id, seq from msg m where turn_id <> 'turn-1' and not exists (select 1 from (
 select unnest(list_concat(m.task_ids, [m.task_id])) as t) where t in ('t3-0', 't4-0', 't5-1'))""", MESSAGES)
def recovery_context(spark, d):
    ids = spark.createDataFrame([("t3-0",), ("t4-0",), ("t5-1",)], "task_id string")
    turns = spark.createDataFrame([("turn-1",)], "turn_id string")
    return H.recovery_context(messages(spark, d), ids, turns).select("session_id", "seq")


@query("consecutive_distinct", """, x as (select source, seq, name, lag(name) over (partition by source order by seq) as b,
 row_number() over (partition by source order by seq) as i from ev), y as (select * from x where i = 1 or b is distinct from name)
 select source, seq, name from (select *, row_number() over (partition by source order by seq desc) rn from y) where rn <= 5""", EVENTS)
def consecutive_distinct(spark, d):
    return H.consecutive_distinct(events(spark, d).select("source", "seq", "name"), ["source"], "seq", "name", 5)


_RUNS = """, x as (select *, case when lag({by}) over (partition by source order by seq) is not distinct from {by}
 and row_number() over (partition by source order by seq) > 1 then 0 else 1 end as n from ev), y as (select *, sum(n) over (partition by source order by seq) as run from x)
 select source, cast(run as bigint) as run, {by} as {by_name}, count(*) as items, {more} from y group by 1, 2, 3"""


@query("run_length", _RUNS.format(by="name", by_name="name", more="round(sum(value), 2) as distance, string_agg(cast(k as varchar), ';' order by seq) as line"), EVENTS)
def run_length(spark, d):
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "k"))), lambda x: x["k"].cast("string")), ";")
    return H.runs(
        events(spark, d), ["source"], "seq", ["name"],
        [F.count(F.lit(1)).alias("items"), F.round(F.sum("value"), 2).alias("distance"), line.alias("line")],
    )


@query("run_length_audio", _RUNS.format(by="k % 2", by_name="rate", more="cast(sum(k) as bigint) as samples"), EVENTS)
def run_length_audio(spark, d):
    rows = events(spark, d).withColumn("rate", F.col("k") % 2)
    return H.runs(rows, ["source"], "seq", ["rate"], [F.count(F.lit(1)).alias("items"), F.sum("k").alias("samples")])


@query("context_patch", """select source, seq, last_value(case when k % 3 = 0 then name end ignore nulls) over w as topic,
 last_value(case when k % 4 = 0 then k end ignore nulls) over w as level from ev
 window w as (partition by source order by seq rows between unbounded preceding and current row)""", EVENTS)
def context_patch(spark, d):
    rows = events(spark, d).selectExpr(
        "source", "seq", "case when k % 3 = 0 then name end as topic", "case when k % 4 = 0 then k end as level"
    )
    return H.carry_forward(rows, ["source"], "seq", ["topic", "level"])


@query("event_offsets", "select source, seq, time_ms - min(time_ms) over (partition by source) as offset_ms from ev", EVENTS)
def event_offsets(spark, d):
    return H.offsets(events(spark, d).select("source", "seq", "time_ms"), ["source"], "time_ms").drop("time_ms")


@query("sequence_numbers", "select source, seq, row_number() over (partition by source order by time_ms, seq) as number from ev", EVENTS)
def sequence_numbers(spark, d):
    return H.numbered(events(spark, d).select("source", "seq", "time_ms"), ["source"], ["time_ms", "seq"]).drop("time_ms")


@query("keyset_page", "select seq, name, (select count(*) from ev where seq > 120) > 50 as has_more from ev where seq > 120 order by seq limit 50", EVENTS)
def keyset_page(spark, d):
    return H.page_after(events(spark, d).select("seq", "name"), "seq", 120, 50)


@query("replay_buffer", """select source, seq from (select source, seq, row_number() over (partition by source order by seq desc) rn from ev) where rn <= 20""", EVENTS)
def replay_buffer(spark, d):
    return H.last_n(events(spark, d).select("source", "seq"), ["source"], ["seq"], 20)


@query("transcript_ring", """, f as (select source as session, k % 30 as turn, min(seq) as position, max(seq) as seq from ev group by 1, 2)
 select session, turn, position, seq from (select *, row_number() over (partition by session order by position desc) rn from f) where rn <= 20""", EVENTS)
def transcript_ring(spark, d):
    rows = events(spark, d).selectExpr("source as session", "k % 30 as turn", "seq")
    return H.ring(rows, ["session"], "turn", "seq", 20)


@query("union_lists", """select session_id, id from msg where role = 'user' union all select session_id, id from msg""", MESSAGES)
def union_lists(spark, d):
    rows = messages(spark, d).select("session_id", "id", "role")
    return rows.where("role = 'user'").unionByName(rows).drop("role")


@query("union_inputs", """, x as (select source, k % 10 as ref, seq, 0 as side from ev where k % 2 = 0 union all
 select source, k % 10, seq, 1 from ev where k % 3 = 0) select source, ref, min(seq + side * 1000000000) as first_pos from x group by 1, 2""", EVENTS)
def union_inputs(spark, d):
    rows = events(spark, d)
    both = rows.where("k % 2 = 0").selectExpr("source", "k % 10 as ref", "seq as pos").unionByName(
        rows.where("k % 3 = 0").selectExpr("source", "k % 10 as ref", "seq + 1000000000 as pos")
    )
    return both.groupBy("source", "ref").agg(F.min("pos").alias("first_pos"))


@query("message_audio", """select m.session_id, m.seq, e.seq as event from msg m join ev e on e.source = m.session_id and e.k = m.seq
 where m.role = 'user' and e.name = 'click'""", MESSAGES, EVENTS)
def message_audio(spark, d):
    audio = events(spark, d).where("name = 'click'").selectExpr("source as session_id", "k as seq", "seq as event")
    return messages(spark, d).where("role = 'user'").select("session_id", "seq").join(audio, ["session_id", "seq"])


@query("journal_decode", "select conv_id, turn + 1 as seq, role, text as content, 'ok' as state from conversations")
def journal_decode(spark, d):
    rows = table(spark, d, "conversations")
    line = F.to_json(
        F.struct(
            F.lit("v1").alias("schema"), F.concat(F.lit("c"), "conv_id").alias("sessionId"), (F.col("turn") + 1).alias("seq"),
            F.lit("2026-01-01T00:00:00Z").alias("time"), F.concat("role", F.lit("/message")).alias("type"),
            F.struct(F.col("text").alias("content")).alias("payload"),
        )
    )
    head = F.concat(F.lit('{"schema":"v1","type":"session","version":1,"sessionId":"c'), F.col("conv_id").cast("string"), F.lit('"}'))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"])
    files = rows.groupBy("conv_id").agg(lines.alias("lines")).select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("path"),
        F.concat(head, F.lit("\n"), F.array_join("lines", "\n"), F.lit('\n{"torn')).cast("binary").alias("content"),
    )
    found, _ = J.decode_journals(files)
    return found.select(
        F.substring("sessionId", 2, 20).cast("long").alias("conv_id"),
        "seq",
        F.substring_index("type", "/", 1).alias("role"),
        F.variant_get("payload", "$.content", "string").alias("content"),
        F.lit("ok").alias("state"),
    )


_APPEND = """, j as (select source as session_id, id as event_id, seq from ev where seq % 2 = 0),
 dr as (select source as session_id, case when k % 5 = 0 then null else id end as event_id, seq as pos from ev where seq % 2 = 1),
 r as (select *, row_number() over (partition by session_id, event_id order by pos) rn from dr),
 f as (select r.* from r left join (select distinct session_id, event_id from j) x on x.session_id = r.session_id and x.event_id = r.event_id
 where r.event_id is null or (r.rn = 1 and x.event_id is null)),
 l as (select session_id, max(seq) as last from j group by 1)
 select f.session_id, f.event_id, f.pos, coalesce(last, 0) + row_number() over (partition by f.session_id order by pos) as seq
 from f left join l on l.session_id = f.session_id"""


@query("journal_append", _APPEND, EVENTS)
def journal_append(spark, d):
    rows = events(spark, d)
    held = rows.where("seq % 2 = 0").selectExpr("source as session_id", "id as event_id", "seq")
    drafts = rows.where("seq % 2 = 1").selectExpr("source as session_id", "if(k % 5 = 0, null, id) as event_id", "seq as pos")
    return J.append_events(held, drafts).select("session_id", "event_id", "pos", "seq")


@query("session_idle", """, x as (select *, case when lag(time_ms) over w is null or time_ms - lag(time_ms) over w >= 86400000 then 1 else 0 end as n
 from ev window w as (partition by source order by time_ms)), y as (select *, sum(n) over (partition by source order by time_ms) as session from x)
 select source, cast(session as bigint) as session, min(time_ms) as start_ms, max(time_ms) as end_ms, count(*) as events from y group by 1, 2""", EVENTS)
def session_idle(spark, d):
    return A.sessions(events(spark, d), "source", "time_ms", 86_400_000)


@query("latest_message_by_role", """select session_id, role, max(seq) as seq from msg group by 1, 2""", MESSAGES)
def latest_message_by_role(spark, d):
    return A.retain_latest(messages(spark, d), ["session_id", "role"], "seq").select("session_id", "role", "seq")


@query("citation_ordinals", """, x as (select p.page_id % 20 as turn_id, page_id as pos, regexp_replace(lower(url), '#.*$', '') as url from pages p),
 f as (select turn_id, url, min(pos) as pos from x group by 1, 2)
 select turn_id, url, pos, concat('source_', n) as citation_id from (select *, row_number() over (partition by turn_id order by pos, url) n from f) where n <= 16""")
def citation_ordinals(spark, d):
    rows = table(spark, d, "pages").select((F.col("page_id") % 20).alias("turn_id"), F.col("page_id").alias("pos"), F.lower("url").alias("url"))
    return W.cite_turn(rows)
