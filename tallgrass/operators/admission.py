"""Event admission: repeats, rates, throttles, batches, fences and holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.operators.folds import Rule, fold


def dedup_rule(ttl_ms: int = 300_000, most: int = 1024) -> Rule:
    """Accepted and repeated events per source. An id is known for ``ttl_ms``
    from its first acceptance, the bound included; repeats don't renew it.
    The oldest ids over ``most`` are forgotten."""

    def step(s: dict, e: dict):
        seen, now = s["seen"], e["time_ms"]
        while seen and now - next(iter(seen.values())) > ttl_ms:
            del seen[next(iter(seen))]
        again = e["id"] in seen
        if not again:
            seen[e["id"]] = now
            if len(seen) > most:
                del seen[next(iter(seen))]
        return [(e["source"], e["seq"], e["id"], again)]

    return Rule(("source",), "source long, seq long, id string, duplicate boolean", lambda: {"seen": {}}, step)


def dedup_ttl(events: DataFrame, ttl_ms: int = 300_000, most: int = 1024) -> DataFrame:
    return fold(events, dedup_rule(ttl_ms, most))


def rate_rule(window_ms: int, most: int) -> Rule:
    """Per (source, name) windows that begin at their first event; rejected
    events count as well."""

    def step(s: dict, e: dict):
        if s["began"] is None or e["time_ms"] - s["began"] >= window_ms:
            s.update(began=e["time_ms"], n=0)
        s["n"] += 1
        return [(e["source"], e["name"], e["seq"], s["n"], s["n"] <= most)]

    schema = "source long, name string, seq long, count long, accepted boolean"
    return Rule(("source", "name"), schema, lambda: {"began": None, "n": 0}, step)


def rate_limit(events: DataFrame, window_ms: int, most: int) -> DataFrame:
    return fold(events, rate_rule(window_ms, most))


def retain_latest(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return events.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def throttle_rule(interval_ms: int = 1000) -> Rule:
    """Frames accepted per source: none older than the last accepted, none
    sooner than ``interval_ms`` after it; only acceptance moves both marks."""

    def step(s: dict, f: dict):
        if f["occurred_ms"] is not None and s["occurred"] is not None and f["occurred_ms"] < s["occurred"]:
            why = "out_of_order"
        elif s["accepted"] is not None and f["time_ms"] - s["accepted"] < interval_ms:
            why = "rate_limited"
        else:
            why = "accepted"
            s["accepted"] = f["time_ms"]
            if f["occurred_ms"] is not None:
                s["occurred"] = f["occurred_ms"]
        return [(f["source"], f["seq"], why)]

    schema = "source long, seq long, outcome string"
    return Rule(("source",), schema, lambda: {"occurred": None, "accepted": None}, step)


def throttle(frames: DataFrame, interval_ms: int = 1000) -> DataFrame:
    return fold(frames, throttle_rule(interval_ms))


def fence(events: DataFrame, key: str, order: str, generation: str) -> DataFrame:
    """Marks rows whose generation is below the highest seen before."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    highest = F.max(generation).over(w)
    return events.withColumn("stale", F.coalesce(F.col(generation) < highest, F.lit(False)))


def fence_rule() -> Rule:
    """Rows below the highest generation seen before."""

    def step(s: dict, e: dict):
        stale = s["highest"] is not None and e["generation"] < s["highest"]
        s["highest"] = e["generation"] if s["highest"] is None else max(s["highest"], e["generation"])
        return [(e["source"], e["seq"], stale)]

    return Rule(("source",), "source long, seq long, stale boolean", lambda: {"highest": None}, step)


def completion_rule(most: int = 100) -> Rule:
    """First completion of each id; the last ``most`` ids are remembered."""

    def step(s: dict, e: dict):
        if e["id"] in s["seen"]:
            return ()
        s["seen"][e["id"]] = 0
        if len(s["seen"]) > most:
            del s["seen"][next(iter(s["seen"]))]
        return [(e["source"], e["seq"], e["id"])]

    return Rule(("source",), "source long, seq long, id string", lambda: {"seen": {}}, step)


def first_completions(events: DataFrame, most: int = 100) -> DataFrame:
    return fold(events, completion_rule(most))


def batch_rule(window_ms: int = 120, most: int = 8, chars: int = 6000) -> Rule:
    """Batches of announcements: a batch ends ``window_ms`` after its first
    item, when the kind changes, or before it would pass its size; an item of
    any size starts one."""

    def step(b: dict, i: dict):
        size = i["chars"]
        if (
            b["first"] is None
            or i["time_ms"] - b["first"] > window_ms
            or i["kind"] != b["kind"]
            or b["items"] >= most
            or b["chars"] + size > chars
        ):
            b.update(n=b["n"] + 1, first=i["time_ms"], kind=i["kind"], items=0, chars=0)
        b["items"] += 1
        b["chars"] += size
        return [(i["source"], i["seq"], b["n"], b["items"])]

    start = {"n": 0, "first": None, "kind": None, "items": 0, "chars": 0}
    return Rule(("source",), "source long, seq long, batch long, place long", lambda: dict(start), step)


def micro_batches(items: DataFrame, window_ms: int = 120, most: int = 8, chars: int = 6000) -> DataFrame:
    return fold(items, batch_rule(window_ms, most, chars))


def guard_rule(total_ms: int = 30_000, most: int = 12, per_tool: int | None = 3, keys: tuple[str, ...] = ("turn",)) -> Rule:
    """Calls of a turn that may run: within its time, its number, the tool's
    number, and not an exact repeat; refused calls don't count.

    A column ``tool_limit`` names the tool's own number (none if null or not
    positive) instead of ``per_tool``; where a column ``repeats`` says
    'handler', the tool looks after repeats itself. A turn's generations are
    told apart by ``keys``."""

    def step(s: dict, c: dict):
        limit = c.get("tool_limit", per_tool)
        if s["first"] is None:
            s["first"] = c["time_ms"]
        if c["time_ms"] - s["first"] > total_ms:
            why = "time"
        elif len(s["seen"]) >= most:
            why = "calls"
        elif limit is not None and s["tools"].get(c["tool"], 0) >= limit > 0:
            why = "tool"
        elif c["signature"] in s["seen"] and c.get("repeats") != "handler":
            why = "repeat"
        else:
            why = "run"
            s["tools"][c["tool"]] = s["tools"].get(c["tool"], 0) + 1
            s["seen"].append(c["signature"])
        return [(*(c[k] for k in keys), c["seq"], why)]

    schema = "".join(f"{k} long, " for k in keys) + "seq long, verdict string"
    return Rule(keys, schema, lambda: {"first": None, "tools": {}, "seen": []}, step)


def tool_guard(calls: DataFrame, total_ms: int = 30_000, most: int = 12, per_tool: int = 3) -> DataFrame:
    return fold(calls, guard_rule(total_ms, most, per_tool))


def turn_guard(calls: DataFrame, total_ms: int = 30_000, most: int = 12) -> DataFrame:
    """``tool_guard`` by (generation, turn), each tool with its own limit."""
    return fold(calls, guard_rule(total_ms, most, None, ("generation", "turn")))


def debounce_rule(wait_ms: int = 30 * 60_000) -> Rule:
    """Events per owner that pass: the first, and those ``wait_ms`` or more
    after the last that passed; ``eligible`` events only."""

    def step(s: dict, e: dict):
        passed = bool(e["eligible"]) and (s["last"] is None or e["time_ms"] - s["last"] >= wait_ms)
        if passed:
            s["last"] = e["time_ms"]
        return [(e["owner"], e["seq"], passed)]

    return Rule(("owner",), "owner long, seq long, passed boolean", lambda: {"last": None}, step)


def debounce(events: DataFrame, wait_ms: int = 30 * 60_000) -> DataFrame:
    return fold(events, debounce_rule(wait_ms))


def heartbeat_rule(interval_ms: int = 1000) -> Rule:
    """Progress per task that is emitted: changed, or ``interval_ms`` old."""

    def step(s: dict, p: dict):
        send = s["sent"] is None or p["content"] != s["content"] or p["time_ms"] - s["sent"] >= interval_ms
        if send:
            s.update(sent=p["time_ms"], content=p["content"])
        return [(p["task"], p["seq"], send)]

    return Rule(("task",), "task long, seq long, sent boolean", lambda: {"sent": None, "content": None}, step)


def heartbeats(progress: DataFrame, interval_ms: int = 1000) -> DataFrame:
    return fold(progress, heartbeat_rule(interval_ms))


def burst_rule(quiet_ms: int, most_ms: int) -> Rule:
    """Bursts of progress per task, each told once by its latest content: a
    burst ends after a quiet period, or ``most_ms`` after it began."""

    def due(b: dict) -> int:
        return min(b["last"] + quiet_ms, b["first"] + most_ms)

    def told(b: dict):
        return [(b["task"], b["first"], due(b), b["n"], b["content"])] if b else []

    def step(b: dict, p: dict):
        done = []
        if b and p["time_ms"] >= due(b):
            done = told(b)
            b.clear()
        b.setdefault("first", p["time_ms"])
        b.update(task=p["task"], last=p["time_ms"], content=p["content"], n=b.get("n", 0) + 1)
        return done

    return Rule(("task",), "task long, first_ms long, due_ms long, updates long, content string", dict, step, told)


def coalesced_progress(progress: DataFrame, quiet_ms: int, most_ms: int) -> DataFrame:
    return fold(progress, burst_rule(quiet_ms, most_ms))


def sessions(events: DataFrame, key: str, time: str, ttl_ms: int) -> DataFrame:
    """Sessions that end by idleness: a gap of ``ttl_ms`` or more begins a new
    one, so two events exactly that far apart are in two sessions."""
    w = Window.partitionBy(key).orderBy(time)
    new = F.coalesce(F.col(time) - F.lag(time).over(w) >= ttl_ms, F.lit(True))
    marked = events.withColumn("_new", new.cast("int"))
    numbered = marked.withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(
        F.min(time).alias("start_ms"), F.max(time).alias("end_ms"), F.count(F.lit(1)).alias("events")
    )


def hold_islands(holds: DataFrame, key: str, time: str, ttl_ms: int) -> DataFrame:
    """Times during which some hold is alive; a refresh prolongs it and keeps
    its beginning."""
    w = Window.partitionBy(key).orderBy(time)
    new = F.coalesce(F.col(time) >= F.lag(time).over(w) + ttl_ms, F.lit(True))
    marked = holds.withColumn("_new", new.cast("int"))
    numbered = marked.withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "_i").agg(
        F.min(time).alias("since_ms"), (F.max(time) + ttl_ms).alias("until_ms"), F.count(F.lit(1)).alias("refreshes")
    ).drop("_i")


def live_entries(accesses: DataFrame, key: str, time: str, now: int, ttl_ms: int, most: int) -> DataFrame:
    """Entries not idle for ``ttl_ms`` or more; the most recently used stay."""
    last = accesses.groupBy(key).agg(F.max(time).alias("last_ms")).where(F.lit(now) - F.col("last_ms") < ttl_ms)
    return last.orderBy(F.desc("last_ms"), key).limit(most)


def owner_rule() -> Rule:
    """Exclusive lease per owner with a generation. A claim succeeds for the
    holder, where the holder is gone, or by takeover; a new holder raises the
    generation. Actions: claim, takeover, release."""

    def step(s: dict, c: dict):
        who, action = c["instance"], c["action"]
        if action == "release":
            ok = s["holder"] == who
            if ok:
                s["holder"] = None
        else:
            ok = s["holder"] in (None, who) or action == "takeover"
            if ok and s["holder"] != who:
                s.update(holder=who, generation=s["generation"] + 1)
        return [(c["owner"], c["seq"], ok, s["holder"], s["generation"])]

    schema = "owner long, seq long, granted boolean, holder string, generation long"
    return Rule(("owner",), schema, lambda: {"holder": None, "generation": 0}, step)


def owner_lease(claims: DataFrame) -> DataFrame:
    return fold(claims, owner_rule())


def lease_rule(ttl_ms: int = 60_000) -> Rule:
    """Delivery states of tasks; a claim lapses after its time to live.
    Actions: pending, claim, deliver, release."""

    def step(s: dict, a: dict):
        if s["state"] == "delivering" and a["time_ms"] - s["since"] >= ttl_ms:
            s["state"] = "pending"
        before, action = s["state"], a["action"]
        if action == "pending" and before == "none":
            s["state"] = "pending"
        elif action == "claim" and before == "pending":
            s.update(state="delivering", since=a["time_ms"])
        elif action == "deliver" and before == "delivering":
            s["state"] = "delivered"
        elif action == "release" and before == "delivering":
            s["state"] = "pending"
        return [(a["task_id"], a["seq"], s["state"], before != s["state"])]

    schema = "task_id string, seq long, state string, granted boolean"
    return Rule(("task_id",), schema, lambda: {"state": "none", "since": 0}, step)


def undelivered(pending: DataFrame, deliveries: DataFrame, now: int, delay_ms: int = 5000) -> DataFrame:
    """Tasks pending for ``delay_ms`` without a later delivery."""
    d = deliveries.select(F.col("task_id").alias("_t"), F.col("time_ms").alias("_d"))
    due = pending.where(F.lit(now) - F.col("time_ms") >= delay_ms)
    return due.join(d, (F.col("task_id") == F.col("_t")) & (F.col("_d") >= F.col("time_ms")), "left_anti")


def versions(changes: DataFrame, key: str, order: str) -> DataFrame:
    """Numbered versions of a state document."""
    return changes.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(order)))


def client_state(events: DataFrame, assigns: dict[str, Column]) -> DataFrame:
    """State after each event: every field's last assignment so far."""
    w = Window.partitionBy("source").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return events.select(
        "source", "seq", *[F.last(c, ignorenulls=True).over(w).alias(name) for name, c in assigns.items()]
    )
