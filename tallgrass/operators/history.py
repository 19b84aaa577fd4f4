"""Conversation history: windows, projections, merges and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.functions import text as T

RECENT_MESSAGES, RING_MESSAGES = 40, 100
VISIBLE_SOURCES = ("voice-user", "text-user", "realtime-direct", "agent-presentation")


def last_n(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The last n rows of each key; Spark plans a bounded window group limit."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def ring(df: DataFrame, keys: list[str], ident: str, order: str, n: int) -> DataFrame:
    """Last n identities of each key by first appearance, with their latest row.

    An update doesn't refresh a row's place in the ring.
    """
    w = Window.partitionBy(*keys, ident)
    placed = df.withColumn("_first", F.min(order).over(w)).withColumn(
        "_last", F.row_number().over(w.orderBy(F.desc(order)))
    )
    newest = placed.where("_last = 1").drop("_last")
    return last_n(newest, keys, ["_first"], n).withColumnRenamed("_first", "position")


def char_budget(df: DataFrame, keys: list[str], order: str, text: str, budget: int) -> DataFrame:
    """Newest rows whose running length fits a budget; the newest always stays."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    used = F.sum(F.length(text)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    kept = df.withColumn("_rn", F.row_number().over(w)).withColumn("_used", used)
    return kept.where((F.col("_rn") == 1) | (F.col("_used") <= budget)).drop("_rn", "_used")


def visible(messages: DataFrame, n: int = RECENT_MESSAGES) -> DataFrame:
    """Messages a user sees: internal results go once they were presented.

    Columns: session_id, seq, source, task_id, task_ids.
    """
    shown = messages.where("source = 'agent-presentation'").select(
        "session_id",
        F.explode(
            F.array_distinct(
                F.concat(F.coalesce("task_ids", F.array().cast("array<string>")), F.array(F.col("task_id")))
            )
        ).alias("shown"),
    )
    shown = shown.where("shown is not null and shown <> ''").distinct()
    results = messages.where("source = 'agent-result' and task_id is not null and task_id <> ''").join(
        shown, (messages["session_id"] == shown["session_id"]) & (messages["task_id"] == shown["shown"]), "left_anti"
    )
    return last_n(
        messages.where(F.col("source").isin(*VISIBLE_SOURCES)).unionByName(results), ["session_id"], ["seq"], n
    )


def latest_tasks(events: DataFrame) -> DataFrame:
    """Latest snapshot of each task over all journals.

    Snapshots compare by (created_at, time_ms, seq); the first read wins ties,
    which ``path`` and ``line`` order.
    """
    w = Window.partitionBy("task_id").orderBy(
        F.coalesce("created_at", F.lit(0)).desc(), F.coalesce("time_ms", F.lit(0)).desc(), F.desc("seq"), "path", "line"
    )
    return events.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def latest_in_log(events: DataFrame) -> DataFrame:
    """Last snapshot of each task in one log, placed where it was first seen."""
    w = Window.partitionBy("session_id", "task_id")
    out = events.withColumn("position", F.min("seq").over(w)).withColumn(
        "_rn", F.row_number().over(w.orderBy(F.desc("seq")))
    )
    return out.where("_rn = 1").drop("_rn")


def fold_messages(events: DataFrame, fields: list[str]) -> DataFrame:
    """Message events folded by id: first position, later fields overwrite.

    ``payload`` is a map of the fields that an event carries; a field that is
    absent keeps its older value, one that is present and null doesn't.
    """
    w = Window.partitionBy("session_id", "message_id").orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def merged(name: str) -> Column:
        carried = F.when(F.map_contains_key("payload", F.lit(name)), F.struct(F.col("payload")[name].alias("v")))
        return F.last(carried, ignorenulls=True).over(whole)["v"].alias(name)

    out = events.select(
        "session_id",
        "message_id",
        "seq",
        F.first("seq").over(whole).alias("position"),
        F.row_number().over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_i"),
        F.count(F.lit(1)).over(whole).alias("_n"),
        *[merged(f) for f in fields],
    )
    return out.where("_i = _n").drop("_i", "_n")


def upsert_conversation(records: DataFrame) -> DataFrame:
    """Keyed upsert: the first seq and created_at stay, content is replaced,
    citations only by a non-empty list; records without id or content go."""
    kept = records.withColumn("content", T.collapse(F.col("content"))).where("id is not null and content <> ''")
    return kept.groupBy("session_id", "id").agg(
        F.min("seq").alias("seq"),
        F.min_by("created_at", "seq").alias("created_at"),
        F.max_by("content", "seq").alias("content"),
        F.max_by("source", "seq").alias("source"),
        F.max_by("citations", F.when(F.size("citations") > 0, F.col("seq"))).alias("citations"),
    )


def merge_history(live: DataFrame, history: DataFrame, n: int = RECENT_MESSAGES) -> DataFrame:
    """Restored messages that aren't live, before the live ones; the last n."""
    old = history.where("id is not null and id <> ''").withColumn("content", T.trim(F.col("content"))).where("content <> ''")
    old = old.join(live.select("session_id", "id").distinct(), ["session_id", "id"], "left_anti")
    both = old.withColumn("_live", F.lit(0)).unionByName(live.withColumn("_live", F.lit(1)), allowMissingColumns=True)
    return last_n(both, ["session_id"], ["_live", "seq"], n).drop("_live")


def turn_times(items: DataFrame) -> DataFrame:
    """Earliest positive time of each turn, else the number its id ends with."""
    tail = F.regexp_extract(F.col("turn_id"), "([0-9]{10,})", 1).try_cast("long")
    return items.groupBy("session_id", "turn_id").agg(
        F.coalesce(F.min(F.when(F.col("time_ms") > 0, F.col("time_ms"))), F.min(tail)).alias("time_ms")
    )


def turn_timeline(messages: DataFrame, tasks: DataFrame) -> DataFrame:
    """Turns of messages and tasks in display order.

    Turns with messages keep their order of arrival; a turn of tasks only goes
    before the first turn of messages that is later, else last.
    """
    m = messages.groupBy("session_id", "turn_id").agg(
        F.min("seq").alias("arrival"), F.count(F.lit(1)).alias("messages"), F.min("time_ms").alias("tm")
    )
    t = tasks.groupBy("session_id", "turn_id").agg(F.count(F.lit(1)).alias("tasks"), F.min("time_ms").alias("tt"))
    both = m.join(t, ["session_id", "turn_id"], "full").withColumn("time_ms", F.least("tm", "tt"))
    # the first later turn of messages: the least arrival over greater times
    later = Window.partitionBy("session_id").orderBy(-F.col("time_ms")).rangeBetween(Window.unboundedPreceding, -1)
    arrival = F.when(F.col("time_ms").isNotNull(), F.col("arrival"))
    placed = both.withColumn("_at", arrival).withColumn(
        "before", F.when(F.col("messages").isNull() & F.col("time_ms").isNotNull(), F.min("_at").over(later))
    )
    far = F.lit(1 << 62)
    w = Window.partitionBy("session_id").orderBy(
        F.coalesce("arrival", "before", far), F.when(F.col("messages").isNull(), 0).otherwise(1), F.asc_nulls_last("time_ms"), "turn_id"
    )
    return placed.select(
        "session_id",
        "turn_id",
        F.coalesce("messages", F.lit(0)).alias("messages"),
        F.coalesce("tasks", F.lit(0)).alias("tasks"),
        "time_ms",
        F.row_number().over(w).alias("position"),
    )


def near_repeats(messages: DataFrame) -> DataFrame:
    """Neighbouring messages of a role in a session that say the same."""
    w = Window.partitionBy("session_id", "role").orderBy("seq")
    keyed = messages.withColumn("key", T.speech_key(F.col("content")))
    paired = keyed.withColumn("before", F.lag("key").over(w)).where("before is not null")
    return paired.withColumn("same", T.equivalent_speech(F.col("key"), F.col("before")))


def recovery_context(messages: DataFrame, task_ids: DataFrame, turn_ids: DataFrame) -> DataFrame:
    """Messages outside the given turns that touch none of the given tasks."""
    touched = messages.select(
        "id", F.explode(F.concat(F.coalesce("task_ids", F.array().cast("array<string>")), F.array("task_id"))).alias("task_id")
    ).join(task_ids, "task_id", "left_semi")
    return messages.join(turn_ids, "turn_id", "left_anti").join(touched.select("id").distinct(), "id", "left_anti")


def consecutive_distinct(df: DataFrame, keys: list[str], order: str, value: str, n: int) -> DataFrame:
    """Drops values equal to the one before; keeps the last n."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.lag(value).over(w)
    first = F.row_number().over(w) == 1
    changed = df.withColumn("_new", first | ~before.eqNullSafe(F.col(value))).where("_new").drop("_new")
    return last_n(changed, keys, [order], n)


def runs(df: DataFrame, keys: list[str], order: str, by: list[str], aggregates: list[Column]) -> DataFrame:
    """Adjacent rows with equal ``by`` merged into one."""
    w = Window.partitionBy(*keys).orderBy(order)
    same = F.lit(True)
    for c in by:
        same = same & F.lag(c).over(w).eqNullSafe(F.col(c))
    flagged = df.withColumn("_new", F.when(same & (F.row_number().over(w) > 1), 0).otherwise(1))
    island = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return flagged.withColumn("run", island).groupBy(*keys, "run", *by).agg(*aggregates)


def carry_forward(df: DataFrame, keys: list[str], order: str, fields: list[str]) -> DataFrame:
    """Per-field last present value so far (context patches)."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.select(*keys, order, *[F.last(f, ignorenulls=True).over(w).alias(f) for f in fields])


def offsets(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Milliseconds since each key's first event."""
    w = Window.partitionBy(*keys)
    return df.withColumn("offset_ms", F.col(time) - F.min(time).over(w))


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "number") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def page_after(df: DataFrame, order: str, cursor: int, size: int = 50) -> DataFrame:
    """Keyset page: rows after a cursor, with whether more follow."""
    size = max(1, min(200, size))
    some = df.where(F.col(order) > cursor).orderBy(order).limit(size + 1)
    w = Window.orderBy(order)
    rows = some.withColumn("_rn", F.row_number().over(w)).withColumn("has_more", F.count(F.lit(1)).over(Window.partitionBy()) > size)
    return rows.where(F.col("_rn") <= size).drop("_rn")
