"""Evidence about preferences over sessions, and session digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.functions import text as T
from tallgrass.operators.folds import Rule, fold

CONFIRM_TARGET, SESSION_TARGET = 2, 2
STALE_MS = 90 * 86_400_000
#: Fields that hold a list, with the most values each keeps.
LIST_FIELDS = {"special_skills": 6}

#: What an observation does to a slot, by its relation to the slot's value:
#: (the slot takes its value, the slot starts anew).
TRANSITIONS = {"same": (False, False), "refine": (True, False), "contradict": (True, True)}

SLOTS = (
    "owner_id string, field string, value string, confirm long, sessions long, first_at long, last_at long, state string"
)


def fold_evidence(observations: DataFrame, stale_ms: int = STALE_MS, lists: dict[str, int] = LIST_FIELDS) -> DataFrame:
    """Slots after all observations of each owner and field, in order.

    Columns: owner_id, session_id, field, value, relation, at, seq. The same
    value or a refinement confirms, another value contradicts and starts anew;
    evidence older than ``stale_ms`` is forgotten, which leaves the state. A
    list field keeps a slot per value and drops its weakest, then oldest.
    """

    def opened(o: dict) -> dict:
        own = [o["session_id"]] if o["session_id"] else []
        return {"value": o["value"], "confirm": 1, "sessions": own, "first": o["at"], "last": o["at"], "state": "tentative"}

    def moved(slot: dict, o: dict) -> dict:
        relation = o["relation"] or ("same" if slot["value"] == o["value"] else "contradict")
        takes_value, anew = TRANSITIONS.get(relation, TRANSITIONS["same"])
        if anew:
            return opened(o)
        forgotten = o["at"] - slot["last"] > stale_ms
        sessions = [] if forgotten else slot["sessions"]
        more = [o["session_id"]] if o["session_id"] and o["session_id"] not in sessions else []
        changed = {"confirm": 1 + (0 if forgotten else slot["confirm"]), "sessions": sessions + more, "last": o["at"]}
        return slot | changed | ({"value": o["value"]} if takes_value else {})

    def step(s: dict, o: dict):
        s.update(owner=o["owner_id"], field=o["field"])
        slots, room = s["slots"], lists.get(o["field"])
        key = "" if room is None else o["value"]
        if key not in slots:
            if room is not None:
                by_strength = sorted(slots, key=lambda name: (slots[name]["confirm"], slots[name]["last"]))
                for name in by_strength[: max(0, len(slots) + 1 - room)]:
                    slots.pop(name)
            slots[key] = opened(o)
        elif slots[key]["state"] != "rejected":
            slots[key] = moved(slots[key], o)
        return ()

    def end(s: dict):
        return [
            (s["owner"], s["field"], x["value"], x["confirm"], len(x["sessions"]), x["first"], x["last"], x["state"])
            for x in s["slots"].values()
        ]

    return fold(observations, Rule(("owner_id", "field"), SLOTS, lambda: {"slots": {}}, step, end))


def ready(confirm: Column, sessions: Column) -> Column:
    """Whether a slot has enough confirmations from enough sessions."""
    return (confirm >= CONFIRM_TARGET) & (sessions >= SESSION_TARGET)


def missing(confirm: Column, sessions: Column) -> Column:
    lacks = F.array(
        F.when(confirm < CONFIRM_TARGET, F.lit("confirm")), F.when(sessions < SESSION_TARGET, F.lit("sessions"))
    )
    return F.array_compact(lacks)


def plain_evidence(observations: DataFrame) -> DataFrame:
    """Confirmations and distinct sessions per (owner, field, value)."""
    return observations.groupBy("owner_id", "field", "value").agg(
        F.count(F.lit(1)).alias("confirm"), F.count_distinct("session_id").alias("sessions"), F.max("at").alias("last_at")
    )


def state_counts(slots: DataFrame) -> DataFrame:
    return slots.groupBy("owner_id").agg(
        *[F.count_if(F.col("state") == s).alias(s) for s in ("tentative", "active", "rejected")],
        F.count(F.lit(1)).alias("total"),
    )


def diagnosis(slots: DataFrame, fields: DataFrame) -> DataFrame:
    """Progress of every known field, never observed ones with zeros."""
    best = slots.groupBy("field").agg(
        F.max("confirm").alias("confirm"), F.max("sessions").alias("sessions"), F.count(F.lit(1)).alias("slots")
    )
    out = best.join(fields, "field", "right")
    zero = F.lit(0).cast("long")
    return out.select(
        "field",
        F.coalesce("confirm", zero).alias("confirm"),
        F.coalesce("sessions", zero).alias("sessions"),
        F.coalesce("slots", zero).alias("slots"),
        F.col("confirm").isNull().alias("never_observed"),
    )


def slot_order(slots: DataFrame) -> DataFrame:
    w = Window.partitionBy("owner_id").orderBy(F.desc("confirm"), F.desc("last_at"), "field", "value")
    return slots.withColumn("rank", F.row_number().over(w))


def labelled(observed: DataFrame, slots: DataFrame) -> DataFrame:
    """Observed labels with the last slot of the same label, case ignored."""
    last = slots.groupBy("owner_id", F.lower("label").alias("_l")).agg(F.max_by("slot_id", "pos").alias("slot_id"))
    o = observed.withColumn("_l", F.lower("label"))
    return o.join(last, ["owner_id", "_l"], "left").drop("_l")


def topics_of(topics: Column, n: int = 5, chars: int = 16) -> Column:
    """Cleaned topics without sensitive ones and repeats, the first n."""
    cut = F.transform(topics, lambda t: T.clean(t, chars))
    kept = F.filter(cut, lambda t: (t != "") & ~T.sensitive(t))
    none = F.array().cast("array<string>")

    def step(acc: Column, t: Column) -> Column:
        again = F.exists(acc, lambda x: T.bare(x) == T.bare(t))
        return F.when(again | (F.size(acc) >= n), acc).otherwise(F.concat(acc, F.array(t)))

    return F.aggregate(kept, none, step)


def work_of(work: Column, n: int = 5, chars: int = 40) -> Column:
    """Cleaned work items (id, objective) by first id, the first n."""
    cut = F.transform(
        work,
        lambda w: F.struct(T.clean(w["id"], 120).alias("id"), T.clean(w["objective"], chars).alias("objective")),
    )
    kept = F.filter(cut, lambda w: (w["objective"] != "") & ~T.sensitive(w["objective"]))
    none = F.array().cast("array<struct<id:string,objective:string>>")

    def step(acc: Column, w: Column) -> Column:
        again = (w["id"] != "") & F.exists(acc, lambda x: x["id"] == w["id"])
        return F.when(again | (F.size(acc) >= n), acc).otherwise(F.concat(acc, F.array(w)))

    return F.aggregate(kept, none, step)


def search_digests(digests: DataFrame, keyword: str, limit: int = 5) -> DataFrame:
    """Digests that mention a keyword: topics before work before gist, newest
    first; without a keyword the newest. Columns: owner_id, session_id, topics,
    work, gist, at."""
    needle = T.bare(F.lit(keyword))
    hit_topic = F.exists("topics", lambda t: F.contains(T.bare(t), needle))
    hit_work = F.exists("work", lambda w: F.contains(T.bare(w), needle))
    rank = F.when(needle == "", 0).when(hit_topic, 0).when(hit_work, 1).when(F.contains(T.bare(F.col("gist")), needle), 2)
    w = Window.partitionBy("owner_id").orderBy("rank", F.desc("at"), "session_id")
    hits = digests.withColumn("rank", rank).where("rank is not null")
    return hits.withColumn("place", F.row_number().over(w)).where(F.col("place") <= max(1, min(10, limit)))


def recent_owners(digests: DataFrame, n: int = 200) -> DataFrame:
    last = digests.groupBy("owner_id").agg(F.max("at").alias("last_at"))
    return last.orderBy(F.desc("last_at"), "owner_id").limit(n)
