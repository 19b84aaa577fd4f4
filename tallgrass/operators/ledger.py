"""Task ledger: states, projections, recovery, retention and delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.operators.folds import Rule, fold

ACTIVE = ("scheduled", "queued", "running", "delegated", "finalizing", "cancelling")
TERMINAL = ("completed", "failed", "cancelled")
CANCELLABLE = ("scheduled", "queued", "running", "delegated", "finalizing")
#: Allowed next states; staying in a state is always allowed.
EDGES = {
    "scheduled": ("queued", "failed", "cancelled"),
    "queued": ("running", "failed", "cancelled"),
    "running": ("delegated", "finalizing", "cancelling", "completed", "failed"),
    "delegated": ("finalizing", "cancelling", "completed", "failed"),
    "finalizing": ("cancelling", "completed", "failed"),
    "cancelling": ("cancelled", "failed"),
}
LEASE_MS, TASK_TTL_MS, AWAITING_TTL_MS = 60_000, 86_400_000, 7 * 86_400_000


def is_active(status: Column) -> Column:
    return status.isin(*ACTIVE)


def is_terminal(status: Column) -> Column:
    return status.isin(*TERMINAL)


def is_cancellable(status: Column) -> Column:
    return status.isin(*CANCELLABLE)


def work_state(status: Column, authorization: Column, request_status: Column, request_kind: Column) -> Column:
    """Public state; a pending authorization goes before a pending input."""
    return (
        F.when(authorization == "pending", "auth_required")
        .when(request_status == "pending", F.when(request_kind == "authorization", "auth_required").otherwise("input_required"))
        .when(status.isin("scheduled", "queued"), "submitted")
        .when(is_active(status), "working")
        .when(is_terminal(status), status)
        .otherwise("submitted")
    )


def scope_of(scope: Column) -> Column:
    return F.when(scope == "system", "system").otherwise("user")


def elapsed(status: Column, started: Column, stored: Column, now: Column) -> Column:
    return F.when((started > 0) & is_active(status), now - started).otherwise(stored)


def phase(status: Column) -> Column:
    """Card phase of a state."""
    return (
        F.when(status.isin("scheduled", "queued"), "waiting")
        .when(status.isin("running", "delegated", "finalizing"), "running")
        .when(status == "cancelling", "stopping")
        .when(status == "completed", "done")
        .when(status == "failed", "failed")
        .when(status == "cancelled", "stopped")
        .otherwise("waiting")
    )


def delivery_settled(notification: Column) -> Column:
    return F.coalesce(notification, F.lit("none")).isin("none", "delivered")


def needs_presentation(status: Column, scope: Column, notification: Column) -> Column:
    return is_terminal(status) & (scope_of(scope) == "user") & ~delivery_settled(notification)


def recovery_action(status: Column, kind: Column, scope: Column, delegate: Column, delegate_session: Column) -> Column:
    """What to do with a task that a restart finds in this state."""
    attached = F.coalesce(delegate, F.lit("")).cast("string") != ""
    attached = attached & (F.coalesce(delegate_session, F.lit("")).cast("string") != "")
    return (
        F.when(status == "scheduled", "reschedule")
        .when((kind == "reminder") & status.isin("queued", "running"), "reschedule")
        .when(status == "cancelling", "cancel")
        .when((scope_of(scope) == "user") & status.isin("delegated", "finalizing") & attached, "reattach")
        .when(is_active(status), "fail")
        .otherwise("restore")
    )


def recovered_notification(scope: Column, policy: Column, action: Column, notification: Column) -> Column:
    announces = (scope_of(scope) == "user") & (F.coalesce(policy, F.lit("announce")) != "silent")
    return (
        F.when(~announces, "none")
        .when(action == "fail", "pending")
        .when(action.isin("reschedule", "reattach", "cancel"), "none")
        .when(notification == "delivering", "pending")
        .otherwise(F.coalesce(notification, F.lit("none")))
    )


def task_list(tasks: DataFrame, owner: str, session: str | None, active: bool | None, limit: int = 50) -> DataFrame:
    out = tasks.where((F.col("owner_id") == owner) & (scope_of(F.col("scope")) == "user"))
    if session is not None:
        out = out.where(F.col("session_id") == session)
    if active is not None:
        out = out.where(is_active(F.col("status")) == active)
    return out.orderBy(F.desc("created_at"), "id").limit(limit)


def transitions(history: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each status change with whether the state machine allows it."""
    w = Window.partitionBy(*keys).orderBy(order)
    moved = history.withColumn("before", F.lag("status").over(w)).where("before is not null")
    allowed = F.col("before") == F.col("status")
    for state, nexts in EDGES.items():
        allowed = allowed | ((F.col("before") == state) & F.col("status").isin(*nexts))
    return moved.withColumn("allowed", allowed)


def reconcile(journal: DataFrame, compact: DataFrame) -> DataFrame:
    """Journal and compact snapshots by id; the later lifetime wins, and the
    journal wins ties."""
    j = journal.select(*[F.col(c).alias(f"j_{c}") for c in journal.columns])
    both = j.join(compact, j["j_id"] == compact["id"], "full")
    newer = F.col("j_id").isNull() | (F.coalesce("created_at", F.lit(0)) > F.coalesce("j_created_at", F.lit(0)))
    return both.select(
        F.coalesce("j_id", "id").alias("id"),
        *[
            F.when(newer & F.col("id").isNotNull(), F.col(c)).otherwise(F.col(f"j_{c}")).alias(c)
            for c in compact.columns
            if c != "id"
        ],
        F.when(newer & F.col("id").isNotNull(), "compact").otherwise("journal").alias("taken_from"),
    )


def newest(df: DataFrame, owner: str, order: str, tie: str, n: int) -> DataFrame:
    """The newest n rows of each owner."""
    w = Window.partitionBy(owner).orderBy(F.desc(order), tie)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def retained(tasks: DataFrame, now: int, cap: int = 100, ttl: int = TASK_TTL_MS, awaiting: int = AWAITING_TTL_MS) -> DataFrame:
    """Terminal tasks that stay: young enough, and the newest ``cap`` of each
    owner. A task that awaits delivery lives longer and is outside the cap."""
    waiting = F.col("notification").isin("pending", "delivering")
    life = F.when(waiting, awaiting).otherwise(ttl)
    young = tasks.where(is_terminal(F.col("status")) & (F.lit(now) - F.col("completed_at") <= life))
    capped = newest(young.where(~waiting), "owner_id", "completed_at", "id", cap)
    return capped.unionByName(young.where(waiting))


def runnable(tasks: DataFrame) -> DataFrame:
    return tasks.where("status = 'queued'").orderBy(F.desc("priority"), "created_at", "id")


def admitted(tasks: DataFrame, total: int = 4, per_owner: int = 2) -> DataFrame:
    """Queued tasks that may start now, in priority order.

    Quotas: all tasks, an owner's tasks, and a lane's tasks (``lane_limit``,
    1 if absent). A task that doesn't fit is skipped and the next is tried,
    so ranks don't give the answer. Tasks are judged per ``pool``.
    """

    def step(s: dict, t: dict):
        running = s["running"]
        ok = len(running) < total and sum(r[0] == t["owner_id"] for r in running) < per_owner
        if ok and t["lane"]:
            ok = sum(r[1] == t["lane"] for r in running) < (t["lane_limit"] or 1)
        if ok:
            running.append((t["owner_id"], t["lane"]))
        return [(t["pool"], t["id"], ok)]

    rule = Rule(("pool",), "pool long, id string, admitted boolean", lambda: {"running": []}, step)
    ready = tasks.where("status = 'queued'").withColumn("_neg", -F.col("priority"))
    return fold(ready, rule, ("_neg", "created_at", "id"))


def idempotent(submissions: DataFrame) -> DataFrame:
    """First submission of each (owner, scope, key); keyless ones all stay."""
    w = Window.partitionBy("owner_id", "scope", "key").orderBy("seq")
    kept = submissions.where("key is not null and key <> ''").withColumn("_rn", F.row_number().over(w))
    return kept.where("_rn = 1").drop("_rn").unionByName(submissions.where("key is null or key = ''"))


def leases(events: DataFrame, now: int, ttl: int = LEASE_MS) -> DataFrame:
    """Delivery state of each task from its pending/claim/deliver/release
    events; a lease of ``ttl`` or more is claimable again."""
    w = Window.partitionBy("task_id").orderBy(F.desc("seq"))
    last = events.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    state = (
        F.when(F.col("action") == "deliver", "delivered")
        .when((F.col("action") == "claim") & (F.lit(now) - F.col("time_ms") < ttl), "delivering")
        .otherwise("pending")
    )
    return last.select("task_id", state.alias("state"), (state == "pending").alias("claimable"))


def merge_artifacts(parts: DataFrame) -> DataFrame:
    """Artifacts by id: the first place, the last content."""
    return parts.groupBy("task_id", "artifact_id").agg(
        F.min("pos").alias("pos"), F.max_by("content", "pos").alias("content")
    )


def within_budget(artifacts: Column, budget: int) -> Column:
    """Greedy pick of array<struct<id, bytes>> in order: what doesn't fit is
    skipped and later ones are still tried."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("ids"))

    def step(acc: Column, a: Column) -> Column:
        fits = acc["used"] + a["bytes"] <= budget
        return F.struct(
            F.when(fits, acc["used"] + a["bytes"]).otherwise(acc["used"]).alias("used"),
            F.when(fits, F.concat(acc["ids"], F.array(a["id"]))).otherwise(acc["ids"]).alias("ids"),
        )

    return F.aggregate(artifacts, start, step)


def activity_ring(updates: DataFrame, n: int = 20) -> DataFrame:
    """Recency list of activities by id: an update moves to the end, one equal
    to the last is skipped, the last n stay."""

    def step(s: dict, r: dict):
        held, entry = s["held"], [r["activity_id"], r["content"]]
        s["task"] = r["task_id"]
        if not held or held[-1] != entry:
            if r["activity_id"] is not None:
                held[:] = [e for e in held if e[0] != r["activity_id"]]
            held.append(entry)
            del held[:-n]
        return ()

    def end(s: dict):
        return [(s["task"], i + 1, a, c) for i, (a, c) in enumerate(s["held"])]

    schema = "task_id string, position int, activity_id string, content string"
    return fold(updates, Rule(("task_id",), schema, lambda: {"held": []}, step, end))


def shown_activity(activity: DataFrame) -> DataFrame:
    """One activity of each task: an open tool, a running plan, any tool, any
    plan; the newest of the first kind that exists."""
    rank = (
        F.when((F.col("kind") == "tool") & (F.col("state") == "open"), 1)
        .when((F.col("kind") == "plan") & (F.col("state") == "running"), 2)
        .when(F.col("kind") == "tool", 3)
        .when(F.col("kind") == "plan", 4)
    )
    w = Window.partitionBy("task_id").orderBy("rank", F.desc("pos"))
    ranked = activity.withColumn("rank", rank).where("rank is not null")
    return ranked.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def overdue(reminders: DataFrame, now: int, stagger_ms: int = 30_000) -> DataFrame:
    """Due reminders in time order, each a stagger after the one before."""
    w = Window.partitionBy("owner_id").orderBy("at", "id")
    return reminders.where(F.col("at") <= now).withColumn("delay_ms", (F.row_number().over(w) - 1) * stagger_ms)


def next_due(reminders: DataFrame, now: int) -> DataFrame:
    return reminders.where(F.col("at") > now).groupBy("owner_id").agg(F.min("at").alias("due"))


def granted(grants: DataFrame, now: int, ttl: int = 6 * 3_600_000, cap: int = 500, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Latest permission mode of each session, younger than its life; the
    newest ``cap`` sessions stay."""
    w = Window.partitionBy(*keys).orderBy(F.desc("seq"))
    last = grants.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    live = last.where(F.lit(now) - F.col("time_ms") < ttl)
    return live.orderBy(F.desc("time_ms"), *keys).limit(cap)


def allowed_tasks(decisions: DataFrame, endings: DataFrame, asked: DataFrame, now: int, ttl: int = 6 * 3_600_000, cap: int = 500) -> DataFrame:
    """``asked`` tasks with whether they may act without a question.

    A decision is always, reject or task; all but task set the session's mode,
    and each that names a task sets that task's grant, which an ending of the
    task takes away. An active task may act if its session's mode is always or
    its own grant isn't a refusal. Columns: decisions owner_id, session_id,
    task_id, decision, seq, time_ms; endings owner_id, session_id, task_id,
    seq; asked owner_id, session_id, task_id, active.
    """
    session, task = ("owner_id", "session_id"), ["owner_id", "session_id", "task_id"]
    modes = granted(decisions.where("decision <> 'task'"), now, ttl, cap, session)
    modes = modes.select(*session, (F.col("decision") == "always").alias("_auto"))
    grants = decisions.where("task_id is not null").groupBy(*task).agg(
        F.max("seq").alias("_set"), F.max_by(F.col("decision") != "reject", "seq").alias("_grant")
    )
    ended = endings.groupBy(*task).agg(F.max("seq").alias("_ended"))
    held = grants.join(ended, task, "left").where("_ended is null or _ended < _set").select(*task, "_grant")
    met = asked.join(F.broadcast(modes) if cap <= 10_000 else modes, list(session), "left").join(held, task, "left")
    free = F.coalesce("_auto", F.lit(False)) | F.coalesce("_grant", F.lit(False))
    return met.withColumn("allowed", F.col("active") & free).drop("_auto", "_grant")


#: Kinds of task events that clients see, under the same names.
PUBLIC_KINDS = (
    "task.accepted", "task.scheduled", "task.scheduled.fired", "task.running", "task.delegated", "task.finalizing",
    "task.cancelling", "task.updated", "task.progress", "task.completed", "task.failed", "task.cancelled",
    "task.permission.requested", "task.permission.resolved", "task.input.requested", "task.input.resolved",
    "task.notification.pending", "task.notification.delivered",
)


def public_events(events: DataFrame) -> DataFrame:
    """Events of public kinds that carry a task outside the system's scope.

    Columns: type, task_id, scope; any others are kept.
    """
    return events.where(F.col("type").isin(*PUBLIC_KINDS) & F.col("task_id").isNotNull() & ~F.col("scope").eqNullSafe(F.lit("system")))
