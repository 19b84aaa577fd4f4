"""Queries over event streams: admission rules in batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallgrass.operators import admission as A
from tallgrass.plans.base import EVENTS, events, query

#: Rows of each key numbered in order, for recursion one row at a time.
STEPS = "x as (select *, row_number() over (partition by source order by seq) as rn from ev)"


@query("event_dedup", """recursive , u as (select source, id, seq, time_ms, row_number() over (partition by source, id order by seq) as rn from ev),
 r as (select source, id, seq, rn, time_ms as since, false as duplicate from u where rn = 1 union all
 select u.source, u.id, u.seq, u.rn, case when u.time_ms - r.since <= 86400000 then r.since else u.time_ms end, u.time_ms - r.since <= 86400000
 from r join u on u.source = r.source and u.id = r.id and u.rn = r.rn + 1) select source, seq, id, duplicate from r""", EVENTS)
def event_dedup(spark, d):
    return A.dedup_ttl(events(spark, d).select("source", "seq", "id", "time_ms"), ttl_ms=86_400_000)


@query("rate_limit", """recursive , x as (select source, name, seq, time_ms, row_number() over (partition by source, name order by seq) as rn from ev),
 r as (select source, name, seq, rn, time_ms as began, 1 as n from x where rn = 1 union all select x.source, x.name, x.seq, x.rn,
 case when x.time_ms - r.began >= 172800000 then x.time_ms else r.began end, case when x.time_ms - r.began >= 172800000 then 1 else r.n + 1 end
 from r join x on x.source = r.source and x.name = r.name and x.rn = r.rn + 1)
 select source, name, seq, cast(n as bigint) as count, n <= 2 as accepted from r""", EVENTS)
def rate_limit(spark, d):
    return A.rate_limit(events(spark, d).select("source", "name", "seq", "time_ms"), 172_800_000, 2)


@query("retain_latest", "select source, name, max(seq) as seq, arg_max(value, seq) as value from ev group by 1, 2", EVENTS)
def retain_latest(spark, d):
    return A.retain_latest(events(spark, d), ["source", "name"], "seq").select("source", "name", "seq", "value")


@query("frame_throttle", """recursive , x as (select source, seq, time_ms, time_ms - k * 3600000 as occurred_ms, row_number() over (partition by source order by seq) as rn from ev),
 r as (select source, seq, rn, occurred_ms as o, time_ms as t, 'accepted' as outcome from x where rn = 1 union all
 select x.source, x.seq, x.rn, case when x.occurred_ms < r.o or x.time_ms - r.t < 21600000 then r.o else x.occurred_ms end,
 case when x.occurred_ms < r.o or x.time_ms - r.t < 21600000 then r.t else x.time_ms end,
 case when x.occurred_ms < r.o then 'out_of_order' when x.time_ms - r.t < 21600000 then 'rate_limited' else 'accepted' end
 from r join x on x.source = r.source and x.rn = r.rn + 1) select source, seq, outcome from r""", EVENTS)
def frame_throttle(spark, d):
    rows = events(spark, d).selectExpr("source", "seq", "time_ms", "time_ms - k * 3600000 as occurred_ms")
    return A.throttle(rows, 21_600_000)


@query("generation_fence", """select source, seq, coalesce(k < max(k) over (partition by source order by seq rows between unbounded preceding and 1 preceding), false) as stale from ev""", EVENTS)
def generation_fence(spark, d):
    return A.fence(events(spark, d), "source", "seq", "k").select("source", "seq", "stale")


@query("first_completions", "select source, min(seq) as seq, id from ev group by source, id", EVENTS)
def first_completions(spark, d):
    return A.first_completions(events(spark, d).select("source", "seq", "id"))


@query("call_dedup", "select source, min(seq) as seq, cast(k as varchar) as id from ev group by source, k", EVENTS)
def call_dedup(spark, d):
    rows = events(spark, d).select("source", "seq", F.col("k").cast("string").alias("id"))
    return A.first_completions(rows, most=500)


@query("micro_batches", f"""recursive , {STEPS}, r as (select source, seq, rn, time_ms as first, name as kind, 1 as batch, 1 as place, k as chars from x where rn = 1 union all
 select x.source, x.seq, x.rn, case when c then x.time_ms else r.first end, x.name, case when c then r.batch + 1 else r.batch end,
 case when c then 1 else r.place + 1 end, case when c then x.k else r.chars + x.k end from (select r.*, x.time_ms - r.first > 86400000 or x.name <> r.kind or r.place >= 8
 or r.chars + x.k > 150 as c from r join x on x.source = r.source and x.rn = r.rn + 1) r join x on x.source = r.source and x.rn = r.rn + 1)
 select source, seq, cast(batch as bigint) as batch, cast(place as bigint) as place from r""", EVENTS)
def micro_batches(spark, d):
    rows = events(spark, d).selectExpr("source", "seq", "time_ms", "name as kind", "k as chars")
    return A.micro_batches(rows, window_ms=86_400_000, chars=150)


_GUARD = """recursive , x as (select source as turn, seq, time_ms, name as tool, concat(name, k) as sig, row_number() over (partition by source order by seq) as rn from ev),
 r as (select turn, seq, rn, time_ms as first, [tool] as tools, [sig] as seen, 'run' as verdict from x where rn = 1 union all
 select turn, seq, rn, first, case when v = 'run' then list_append(tools, tool) else tools end, case when v = 'run' then list_append(seen, sig) else seen end, v from (select x.turn, x.seq, x.rn, r.first, r.tools, r.seen, x.tool, x.sig,
 case when x.time_ms - r.first > 1728000000 then 'time' when len(r.tools) >= 12 then 'calls' when len(list_filter(r.tools, lambda t: t = x.tool)) >= 3 then 'tool'
 when list_contains(r.seen, x.sig) then 'repeat' else 'run' end as v from r join x on x.turn = r.turn and x.rn = r.rn + 1)) select turn, seq, verdict from r"""


@query("tool_guard", _GUARD, EVENTS)
def tool_guard(spark, d):
    rows = events(spark, d).selectExpr("source as turn", "seq", "time_ms", "name as tool", "concat(name, k) as signature")
    return A.tool_guard(rows, total_ms=20 * 86_400_000)


_TURNS = """recursive , x as (select k % 3 as generation, source as turn, seq, time_ms, name as tool, concat(name, k % 4) as sig,
 case when name = 'click' then 2 when name = 'error' then 1 when name = 'view' then 0 end as own, name = 'purchase' as handler,
 row_number() over (partition by source, k % 3 order by seq) as rn from ev),
 r as (select generation, turn, seq, rn, time_ms as first, [tool] as tools, [sig] as seen, 'run' as verdict from x where rn = 1 union all
 select generation, turn, seq, rn, first, case when v = 'run' then list_append(tools, tool) else tools end, case when v = 'run' then list_append(seen, sig) else seen end, v
 from (select x.generation, x.turn, x.seq, x.rn, r.first, r.tools, r.seen, x.tool, x.sig, case when x.time_ms - r.first > 1728000000 then 'time' when len(r.tools) >= 6 then 'calls'
 when x.own > 0 and len(list_filter(r.tools, lambda t: t = x.tool)) >= x.own then 'tool' when list_contains(r.seen, x.sig) and not x.handler then 'repeat' else 'run' end as v
 from r join x on x.turn = r.turn and x.generation = r.generation and x.rn = r.rn + 1)) select generation, turn, seq, verdict from r"""


@query("turn_guard", _TURNS, EVENTS)
def turn_guard(spark, d):
    rows = events(spark, d).selectExpr(
        "k % 3 as generation", "source as turn", "seq", "time_ms", "name as tool", "concat(name, k % 4) as signature",
        "case name when 'click' then 2 when 'error' then 1 when 'view' then 0 end as tool_limit", "if(name = 'purchase', 'handler', null) as repeats",
    )
    return A.turn_guard(rows, total_ms=20 * 86_400_000, most=6)


@query("debounce", f"""recursive , {STEPS}, r as (select source, seq, rn, k % 3 <> 0 as passed, case when k % 3 <> 0 then time_ms end as last from x where rn = 1 union all
 select x.source, x.seq, x.rn, x.k % 3 <> 0 and (r.last is null or x.time_ms - r.last >= 86400000),
 case when x.k % 3 <> 0 and (r.last is null or x.time_ms - r.last >= 86400000) then x.time_ms else r.last end
 from r join x on x.source = r.source and x.rn = r.rn + 1) select source as owner, seq, passed from r""", EVENTS)
def debounce(spark, d):
    return A.debounce(events(spark, d).selectExpr("source as owner", "seq", "time_ms", "k % 3 <> 0 as eligible"), 86_400_000)


@query("heartbeats", f"""recursive , {STEPS}, r as (select source, seq, rn, true as sent, time_ms as last, name as content from x where rn = 1 union all
 select x.source, x.seq, x.rn, x.name <> r.content or x.time_ms - r.last >= 259200000,
 case when x.name <> r.content or x.time_ms - r.last >= 259200000 then x.time_ms else r.last end, case when x.name <> r.content or x.time_ms - r.last >= 259200000 then x.name else r.content end
 from r join x on x.source = r.source and x.rn = r.rn + 1) select source as task, seq, sent from r""", EVENTS)
def heartbeats(spark, d):
    return A.heartbeats(events(spark, d).selectExpr("source as task", "seq", "time_ms", "name as content"), 259_200_000)


_BURSTS = f"""recursive , {STEPS}, r as (select source, seq, rn, time_ms, name, time_ms as first, 1 as burst from x where rn = 1 union all
 select x.source, x.seq, x.rn, x.time_ms, x.name, case when x.time_ms >= least(r.time_ms + 86400000, r.first + 259200000) then x.time_ms else r.first end,
 case when x.time_ms >= least(r.time_ms + 86400000, r.first + 259200000) then r.burst + 1 else r.burst end from r join x on x.source = r.source and x.rn = r.rn + 1)
 select source as task, min(time_ms) as first_ms, least(max(time_ms) + 86400000, min(time_ms) + 259200000) as due_ms, count(*) as updates, arg_max(name, seq) as content from r group by source, burst"""


@query("progress_bursts", _BURSTS, EVENTS)
def progress_bursts(spark, d):
    rows = events(spark, d).selectExpr("source as task", "seq", "time_ms", "name as content")
    return A.coalesced_progress(rows, 86_400_000, 3 * 86_400_000)


@query("hold_islands", """, x as (select source, time_ms, case when lag(time_ms) over w is null or time_ms >= lag(time_ms) over w + 43200000 then 1 else 0 end as n from ev
 window w as (partition by source order by time_ms)), y as (select *, sum(n) over (partition by source order by time_ms) as i from x)
 select source, min(time_ms) as since_ms, max(time_ms) + 43200000 as until_ms, count(*) as refreshes from y group by source, i""", EVENTS)
def hold_islands(spark, d):
    return A.hold_islands(events(spark, d), "source", "time_ms", 43_200_000)


@query("live_entries", """select source, max(time_ms) as last_ms from ev group by 1 having 1706600000000 - max(time_ms) < 172800000 order by 2 desc, 1 limit 50""", EVENTS)
def live_entries(spark, d):
    return A.live_entries(events(spark, d), "source", "time_ms", 1_706_600_000_000, 172_800_000, 50)


_LEASES = """recursive , x as (select source % 20 as owner, seq, concat('i', k % 4) as who, case name when 'error' then 'release' when 'purchase' then 'takeover' else 'claim' end as action,
 row_number() over (partition by source % 20 order by seq) as rn from ev),
 r as (select owner, seq, rn, action <> 'release' as granted, case when action <> 'release' then who end as holder, case when action <> 'release' then 1 else 0 end as generation from x where rn = 1 union all
 select owner, seq, rn, ok, case when action = 'release' then (case when ok then null else h end) when ok then who else h end, case when action <> 'release' and ok and h is distinct from who then g + 1 else g end
 from (select x.owner, x.seq, x.rn, x.who, x.action, r.holder as h, r.generation as g, case when x.action = 'release' then coalesce(r.holder = x.who, false) else r.holder is null or r.holder = x.who or x.action = 'takeover' end as ok
 from r join x on x.owner = r.owner and x.rn = r.rn + 1)) select owner, seq, granted, holder, cast(generation as bigint) as generation from r"""


@query("owner_leases", _LEASES, EVENTS)
def owner_leases(spark, d):
    rows = events(spark, d).selectExpr(
        "source % 20 as owner", "seq", "concat('i', k % 4) as instance",
        "case when name = 'error' then 'release' when name = 'purchase' then 'takeover' else 'claim' end as action",
    )
    return A.owner_lease(rows)


@query("document_versions", "select source, seq, row_number() over (partition by source order by seq) as version from ev where name = 'purchase'", EVENTS)
def document_versions(spark, d):
    return A.versions(events(spark, d).where("name = 'purchase'").select("source", "seq"), "source", "seq")


@query("client_state", """select source, seq, last_value(case when name = 'click' then k end ignore nulls) over w as focus,
 last_value(case name when 'signup' then 'on' when 'error' then 'off' end ignore nulls) over w as link from ev
 window w as (partition by source order by seq rows between unbounded preceding and current row)""", EVENTS)
def client_state(spark, d):
    c = F.col
    return A.client_state(
        events(spark, d),
        {"focus": F.when(c("name") == "click", c("k")), "link": F.when(c("name") == "signup", "on").when(c("name") == "error", "off")},
    )


@query("sleep_timer", """, x as (select source, time_ms, lead(time_ms) over (partition by source order by time_ms) as next from ev)
 select source, time_ms + 172800000 as sleeps_ms from x where next is null or next - time_ms >= 172800000""", EVENTS)
def sleep_timer(spark, d):
    done = A.sessions(events(spark, d), "source", "time_ms", 172_800_000)
    return done.select("source", (F.col("end_ms") + 172_800_000).alias("sleeps_ms"))
