"""Queries over tasks derived from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallgrass.operators import admission as A
from tallgrass.operators import ledger as L
from tallgrass.plans.base import EVENTS, LATEST, NOW, TASKS, events, latest, query, tasks

CTES = (EVENTS, TASKS, LATEST)
ACTIVE = "status in ('scheduled', 'queued', 'running', 'delegated', 'finalizing', 'cancelling')"
TERMINAL = "status in ('completed', 'failed', 'cancelled')"


@query("latest_tasks", "select id, seq, status, created_at from lt", *CTES)
def latest_tasks(spark, d):
    return latest(spark, d).select("id", "seq", "status", "created_at")


@query("task_projection", f"""select id, seq, case when auth = 'pending' then 'auth_required' when request = 'pending' then
 (case when request_kind = 'authorization' then 'auth_required' else 'input_required' end)
 when status in ('scheduled', 'queued') then 'submitted' when {ACTIVE} then 'working' when {TERMINAL} then status else 'submitted' end as work_state,
 {ACTIVE} as active, {TERMINAL} as terminal, status in ('scheduled', 'queued', 'running', 'delegated', 'finalizing') as cancellable,
 case when started_at > 0 and {ACTIVE} then {NOW} - started_at else elapsed_ms end as elapsed_ms,
 case when status in ('scheduled', 'queued') then 'waiting' when status in ('running', 'delegated', 'finalizing') then 'running'
 when status = 'cancelling' then 'stopping' when status = 'completed' then 'done' when status = 'failed' then 'failed'
 when status = 'cancelled' then 'stopped' else 'waiting' end as phase,
 notification in ('none', 'delivered') as settled, {TERMINAL} and scope = 'user' and notification not in ('none', 'delivered') as needs_presentation from tk""", EVENTS, TASKS)
def task_projection(spark, d):
    s, c = F.col("status"), F.col
    return tasks(spark, d).select(
        "id", "seq",
        L.work_state(s, c("auth"), c("request"), c("request_kind")).alias("work_state"),
        L.is_active(s).alias("active"), L.is_terminal(s).alias("terminal"), L.is_cancellable(s).alias("cancellable"),
        L.elapsed(s, c("started_at"), c("elapsed_ms"), F.lit(NOW)).alias("elapsed_ms"),
        L.phase(s).alias("phase"), L.delivery_settled(c("notification")).alias("settled"),
        L.needs_presentation(s, c("scope"), c("notification")).alias("needs_presentation"),
    )


_ACTION = f"""case when status = 'scheduled' then 'reschedule' when kind = 'reminder' and status in ('queued', 'running') then 'reschedule'
 when status = 'cancelling' then 'cancel' when scope <> 'system' and status in ('delegated', 'finalizing') and coalesce(delegate, '') <> ''
 and coalesce(delegate_session, '') <> '' then 'reattach' when {ACTIVE} then 'fail' else 'restore' end"""


@query("task_recovery", f""", x as (select *, {_ACTION} as action from tk) select id, seq, action,
 case when scope = 'system' or policy = 'silent' then 'none' when action = 'fail' then 'pending'
 when action in ('reschedule', 'reattach', 'cancel') then 'none' when notification = 'delivering' then 'pending'
 else coalesce(notification, 'none') end as notification from x""", EVENTS, TASKS)
def task_recovery(spark, d):
    c = F.col
    acted = tasks(spark, d).withColumn(
        "action", L.recovery_action(c("status"), c("kind"), c("scope"), c("delegate"), c("delegate_session"))
    )
    told = L.recovered_notification(c("scope"), c("policy"), c("action"), c("notification"))
    return acted.select("id", "seq", "action", told.alias("notification"))


@query("task_list", f"""select id, created_at, status from lt where owner_id = 'o3' and scope = 'user' and ({ACTIVE}) = true
 order by created_at desc, id limit 50""", *CTES)
def task_list(spark, d):
    return L.task_list(latest(spark, d), "o3", None, True).select("id", "created_at", "status")


@query("task_cards", f"""select id, case when status = 'scheduled' then created_at + 60000 else created_at end as sort_ms from lt
 where {ACTIVE} or notification = 'pending'""", *CTES)
def task_cards(spark, d):
    rows = latest(spark, d).where(L.is_active(F.col("status")) | (F.col("notification") == "pending"))
    key = F.when(F.col("status") == "scheduled", F.col("created_at") + 60_000).otherwise(F.col("created_at"))
    return rows.select("id", key.alias("sort_ms")).orderBy(F.desc("sort_ms"))


_EDGES = " or ".join(f"(before = '{k}' and status in ({', '.join(repr(x) for x in v)}))" for k, v in L.EDGES.items())


@query("task_transitions", f""", x as (select id, seq, status, lag(status) over (partition by id order by seq) as before from tk)
 select id, seq, before, status, before = status or {_EDGES} as allowed from x where before is not null""", EVENTS, TASKS)
def task_transitions(spark, d):
    return L.transitions(tasks(spark, d), ["id"], "seq").select("id", "seq", "before", "status", "allowed")


@query("snapshot_reconcile", """, j as (select id, created_at, status from lt where priority % 3 <> 0),
 c as (select id, created_at + (priority % 2) * 1000 as created_at, 'stored' as status from lt where priority % 4 <> 0)
 select coalesce(j.id, c.id) as id, case when j.id is null or (c.id is not null and c.created_at > j.created_at) then c.created_at else j.created_at end as created_at,
 case when j.id is null or (c.id is not null and c.created_at > j.created_at) then c.status else j.status end as status,
 case when j.id is null or (c.id is not null and c.created_at > j.created_at) then 'compact' else 'journal' end as taken_from
 from j full join c on j.id = c.id""", *CTES)
def snapshot_reconcile(spark, d):
    rows = latest(spark, d)
    journal = rows.where("priority % 3 <> 0").select("id", "created_at", "status")
    compact = rows.where("priority % 4 <> 0").selectExpr("id", "created_at + (priority % 2) * 1000 as created_at", "'stored' as status")
    return L.reconcile(journal, compact)


@query("retention_cap", "select owner_id, seq from (select *, row_number() over (partition by owner_id order by time_ms desc, id) rn from tk) where rn <= 60", EVENTS, TASKS)
def retention_cap(spark, d):
    return L.newest(tasks(spark, d), "owner_id", "time_ms", "id", 60).select("owner_id", "seq")


@query("task_retention", f""", y as (select *, notification in ('pending', 'delivering') as waiting from tk where {TERMINAL} and completed_at is not null),
 z as (select * from y where {NOW} - completed_at <= case when waiting then 604800000 else 86400000 end),
 r as (select *, row_number() over (partition by owner_id order by completed_at desc, id) rn from z where not waiting)
 select seq, owner_id from r where rn <= 20 union all select seq, owner_id from z where waiting""", EVENTS, TASKS)
def task_retention(spark, d):
    return L.retained(tasks(spark, d), NOW, cap=20).select("seq", "owner_id")


@query("runnable_queue", "select id, priority, created_at from lt where status = 'queued'", *CTES)
def runnable_queue(spark, d):
    return L.runnable(latest(spark, d)).select("id", "priority", "created_at")


_QUOTA = """recursive , x as (select pool, concat(id, '-', seq) as id, owner_id as o, lane, lane_limit, row_number() over (partition by pool order by -priority, created_at, concat(id, '-', seq)) as rn from tk where status = 'queued'),
 r as (select pool, id, rn, true as admitted, [{'o': o, 'l': lane}] as a from x where rn = 1 union all
 select pool, id, rn, ok, case when ok then list_append(a, {'o': o, 'l': lane}) else a end from (select x.pool, x.id, x.rn, x.o, x.lane, r.a, len(r.a) < 4 and len(list_filter(r.a, lambda t: t.o = x.o)) < 2
 and (x.lane is null or len(list_filter(r.a, lambda t: t.l = x.lane)) < x.lane_limit) as ok from r join x on x.pool = r.pool and x.rn = r.rn + 1)) select pool, id, admitted from r"""


@query("quota_admission", _QUOTA, EVENTS, TASKS)
def quota_admission(spark, d):
    rows = tasks(spark, d).withColumn("id", F.concat("id", F.lit("-"), F.col("seq").cast("string")))
    return L.admitted(rows)


@query("idempotent_submissions", """, x as (select owner_id, scope, case when priority % 7 = 0 then null else concat('k', priority % 20) end as key, seq from tk)
 select owner_id, scope, key, seq from (select *, row_number() over (partition by owner_id, scope, key order by seq) rn from x) where key is null or rn = 1""", EVENTS, TASKS)
def idempotent_submissions(spark, d):
    rows = tasks(spark, d).selectExpr("owner_id", "scope", "if(priority % 7 = 0, null, concat('k', priority % 20)) as key", "seq")
    return L.idempotent(rows)


@query("delivery_leases", f""", x as (select id as task_id, seq, time_ms, case notification when 'delivering' then 'claim' when 'delivered' then 'deliver' else 'pending' end as action from tk),
 y as (select * from (select *, row_number() over (partition by task_id order by seq desc) rn from x) where rn = 1),
 z as (select task_id, case when action = 'deliver' then 'delivered' when action = 'claim' and {NOW} - time_ms < 60000 then 'delivering' else 'pending' end as state from y)
 select task_id, state, state = 'pending' as claimable from z""", EVENTS, TASKS)
def delivery_leases(spark, d):
    rows = tasks(spark, d).selectExpr(
        "id as task_id", "seq", "time_ms",
        "case notification when 'delivering' then 'claim' when 'delivered' then 'deliver' else 'pending' end as action",
    )
    return L.leases(rows, NOW)


@query("claim_requested", "select id, status from lt where notification = 'pending' and id in ('t1', 't2', 't3', 't5', 't8', 't13')", *CTES)
def claim_requested(spark, d):
    wanted = spark.createDataFrame([(f"t{i}",) for i in (1, 2, 3, 5, 8, 13)], "id string")
    return latest(spark, d).where("notification = 'pending'").join(wanted, "id", "left_semi").select("id", "status")


@query("artifact_merge", """select id as task_id, priority % 10 as artifact_id, min(seq) as pos, arg_max(status, seq) as content from tk group by 1, 2""", EVENTS, TASKS)
def artifact_merge(spark, d):
    rows = tasks(spark, d).selectExpr("id as task_id", "priority % 10 as artifact_id", "seq as pos", "status as content")
    return L.merge_artifacts(rows)


_BUDGET = """recursive , x as (select source, seq, k * 10 as bytes, row_number() over (partition by source order by seq) as rn from ev),
 r as (select source, rn, case when bytes <= 2000 then bytes else 0 end as used, case when bytes <= 2000 then 1 else 0 end as taken from x where rn = 1
 union all select x.source, x.rn, case when r.used + x.bytes <= 2000 then r.used + x.bytes else r.used end,
 r.taken + case when r.used + x.bytes <= 2000 then 1 else 0 end from r join x on x.source = r.source and x.rn = r.rn + 1)
 select source, cast(arg_max(used, rn) as bigint) as used, cast(arg_max(taken, rn) as bigint) as taken from r group by 1"""


@query("size_budget", _BUDGET, EVENTS)
def size_budget(spark, d):
    item = F.struct("seq", F.col("id"), (F.col("k") * 10).alias("bytes"))
    rows = events(spark, d).groupBy("source").agg(F.array_sort(F.collect_list(item)).alias("a"))
    kept = L.within_budget(F.transform("a", lambda x: F.struct(x["id"].alias("id"), x["bytes"].alias("bytes"))), 2000)
    return rows.select("source", kept.alias("b")).select("source", "b.used", F.size("b.ids").cast("long").alias("taken"))


_RING = """recursive , x as (select id as task_id, seq, {'a': concat('a', priority % 30), 'c': status} as e, row_number() over (partition by id order by seq) as rn from tk),
 r as (select task_id, rn, [e] as held from x where rn = 1 union all select x.task_id, x.rn, case when r.held[-1] = x.e then r.held
 else list_append(list_filter(r.held, lambda t: t.a <> x.e.a), x.e)[-20:] end from r join x on x.task_id = r.task_id and x.rn = r.rn + 1),
 f as (select *, row_number() over (partition by task_id order by rn desc) as b from r)
 select task_id, i as position, held[i].a as activity_id, held[i].c as content from f, range(1, 21) t(i) where b = 1 and i <= len(held)"""


@query("activity_ring", _RING, EVENTS, TASKS)
def activity_ring(spark, d):
    rows = tasks(spark, d).selectExpr("id as task_id", "seq", "concat('a', priority % 30) as activity_id", "status as content")
    return L.activity_ring(rows)


@query("shown_activity", """, x as (select id as task_id, seq as pos, case when priority % 2 = 0 then 'tool' else 'plan' end as kind,
 case when status = 'running' then 'running' when status = 'queued' then 'open' else 'closed' end as state from tk),
 y as (select *, case when kind = 'tool' and state = 'open' then 1 when kind = 'plan' and state = 'running' then 2 when kind = 'tool' then 3 else 4 end as rank from x)
 select task_id, pos, kind, state, cast(rank as bigint) as rank from (select *, row_number() over (partition by task_id order by rank, pos desc) rn from y) where rn = 1""", EVENTS, TASKS)
def shown_activity(spark, d):
    rows = tasks(spark, d).selectExpr(
        "id as task_id", "seq as pos", "if(priority % 2 = 0, 'tool', 'plan') as kind",
        "case when status = 'running' then 'running' when status = 'queued' then 'open' else 'closed' end as state",
    )
    return L.shown_activity(rows)


@query("overdue_reminders", f"""select owner_id, id, (row_number() over (partition by owner_id order by created_at, id) - 1) * 30000 as delay_ms from lt
 where status = 'scheduled' and created_at <= {NOW}""", *CTES)
def overdue_reminders(spark, d):
    rows = latest(spark, d).where("status = 'scheduled'").withColumnRenamed("created_at", "at")
    return L.overdue(rows, NOW).select("owner_id", "id", "delay_ms")


@query("next_due", "select owner_id, min(created_at) as due from tk where status = 'scheduled' and created_at > 1706000000000 group by 1", EVENTS, TASKS)
def next_due(spark, d):
    rows = tasks(spark, d).where("status = 'scheduled'").withColumnRenamed("created_at", "at")
    return L.next_due(rows, 1_706_000_000_000)


@query("next_progress", """select owner_id, arg_min(seq, time_ms + priority * 1000) as seq from tk where status = 'running' group by 1""", EVENTS, TASKS)
def next_progress(spark, d):
    rows = tasks(spark, d).where("status = 'running'")
    return rows.groupBy("owner_id").agg(F.min_by("seq", F.col("time_ms") + F.col("priority") * 1000).alias("seq"))


@query("status_list", "select id, substr(status, 1, 4) as status, created_at from lt order by created_at desc, id limit 20", *CTES)
def status_list(spark, d):
    return latest(spark, d).orderBy(F.desc("created_at"), "id").limit(20).select("id", F.substring("status", 1, 4).alias("status"), "created_at")


@query("endpoint_order", """select id, scope <> 'user' as internal, policy = 'silent' as silent from lt order by internal, silent, id""", *CTES)
def endpoint_order(spark, d):
    rows = latest(spark, d).select("id", (F.col("scope") != "user").alias("internal"), (F.col("policy") == "silent").alias("silent"))
    return rows.orderBy("internal", "silent", "id")


@query("permission_grants", f""", x as (select *, row_number() over (partition by session_id order by seq desc) rn from tk)
 select session_id, seq, policy as mode from x where rn = 1 and {NOW + 10_000_000} - time_ms < 21600000 order by time_ms desc, session_id limit 500""", EVENTS, TASKS)
def permission_grants(spark, d):
    return L.granted(tasks(spark, d), NOW + 10_000_000).selectExpr("session_id", "seq", "policy as mode")


@query("allowed_tasks", f""", dc as (select *, id as task_id, case priority % 4 when 0 then 'always' when 1 then 'reject' else 'task' end as decision from tk where priority % 3 = 0),
 se as (select *, row_number() over (partition by owner_id, session_id order by seq desc) as rn from dc where decision <> 'task'),
 m as (select owner_id, session_id, decision = 'always' as auto from se where rn = 1 and {NOW} - time_ms < 2592000000 order by time_ms desc, owner_id, session_id limit 60),
 g as (select owner_id, session_id, task_id, max(seq) as at, arg_max(decision, seq) <> 'reject' as grant_ from dc group by 1, 2, 3),
 e as (select owner_id, session_id, id as task_id, max(seq) as at from tk where {TERMINAL} or status = 'cancelling' group by 1, 2, 3),
 h as (select g.* from g left join e on e.owner_id = g.owner_id and e.session_id = g.session_id and e.task_id = g.task_id where e.at is null or e.at < g.at),
 q as (select owner_id, session_id, id as task_id, arg_max(status, seq) as status from tk group by 1, 2, 3)
 select q.owner_id, q.session_id, q.task_id, {ACTIVE} and status <> 'cancelling' and (coalesce(auto, false) or coalesce(grant_, false)) as allowed from q
 left join m on m.owner_id = q.owner_id and m.session_id = q.session_id left join h on h.owner_id = q.owner_id and h.session_id = q.session_id and h.task_id = q.task_id""", EVENTS, TASKS)
def allowed_tasks(spark, d):
    rows = tasks(spark, d).withColumnRenamed("id", "task_id")
    decision = F.when(F.col("priority") % 4 == 0, "always").when(F.col("priority") % 4 == 1, "reject").otherwise("task")
    decisions = rows.where("priority % 3 = 0").withColumn("decision", decision)
    last = rows.groupBy("owner_id", "session_id", "task_id").agg(F.max_by("status", "seq").alias("status"))
    asked = last.withColumn("active", F.expr(f"{ACTIVE} and status <> 'cancelling'")).drop("status")
    endings = rows.where(f"{TERMINAL} or status = 'cancelling'")
    out = L.allowed_tasks(decisions, endings, asked, NOW, ttl=30 * 86_400_000, cap=60)
    return out.select("owner_id", "session_id", "task_id", "allowed")


@query("public_events", """select seq, case status when 'queued' then 'task.accepted' when 'running' then 'task.started' when 'completed' then 'task.completed'
 when 'failed' then 'task.failed' else 'task.updated' end as event from tk where scope <> 'system'""", EVENTS, TASKS)
def public_events(spark, d):
    kinds = spark.createDataFrame(
        [("queued", "task.accepted"), ("running", "task.started"), ("completed", "task.completed"), ("failed", "task.failed")],
        "status string, event string",
    )
    rows = tasks(spark, d).where("scope <> 'system'").join(F.broadcast(kinds), "status", "left")
    return rows.select("seq", F.coalesce("event", F.lit("task.updated")).alias("event"))


@query("activity_snapshot", "select id, concat(status, '|', owner_id, '|', coalesce(lane, '-')) as activity from lt", *CTES)
def activity_snapshot(spark, d):
    snapshot = F.struct("status", "owner_id", "lane")
    rows = latest(spark, d).select("id", snapshot.alias("s"))
    return rows.select("id", F.concat_ws("|", "s.status", "s.owner_id", F.coalesce("s.lane", F.lit("-"))).alias("activity"))


@query("offline_notices", f""", p as (select id as task_id, time_ms from lt where notification = 'pending'),
 dl as (select id as task_id, time_ms from tk where notification = 'delivered')
 select task_id from p where {NOW + 150_000_000} - time_ms >= 5000 and not exists (select 1 from dl where dl.task_id = p.task_id and dl.time_ms >= p.time_ms)""", *CTES)
def offline_notices(spark, d):
    pending = latest(spark, d).where("notification = 'pending'").selectExpr("id as task_id", "time_ms")
    done = tasks(spark, d).where("notification = 'delivered'").selectExpr("id as task_id", "time_ms")
    return A.undelivered(pending, done, NOW + 150_000_000).select("task_id")


@query("recent_owners", "select owner_id, max(time_ms) as last_at from tk group by 1 order by 2 desc, 1 limit 5", EVENTS, TASKS)
def recent_owners(spark, d):
    from tallgrass.operators.evidence import recent_owners as rank

    return rank(tasks(spark, d).withColumnRenamed("time_ms", "at"), 5)
