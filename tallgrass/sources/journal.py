"""Append-only session journals: files of JSON lines.

The first line of a file is its header, the others are events. A last line
without a line end that doesn't parse is a torn write and is dropped; any
other line that doesn't parse makes the file damaged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallgrass.operators.folds import Rule, fold

JOURNAL_FILE = "session.jsonl"
HEADER = "schema string, type string, version int, sessionId string, createdAt string, ownerId string"
EVENT = (
    "schema string, sessionId string, seq bigint, time string, type string, eventId string, turnId string, "
    "taskId string, source string, payload variant"
)


def read_journals(spark: SparkSession, root: str, name: str = JOURNAL_FILE) -> DataFrame:
    """(path, content) of every journal below a folder; unreadable files are
    skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name)
    return files.option("ignoreCorruptFiles", "true").load(root).select("path", "content", F.col("length").alias("bytes"))


def segment(value: Column) -> Column:
    """Injective path segment of an owner or session: URL-safe base64."""
    encoded = F.base64(value.cast("binary"))
    return F.rtrim(F.translate(F.regexp_replace(encoded, "\\s", ""), "+/", "-_"), F.lit("="))


def journal_lines(files: DataFrame) -> DataFrame:
    """Numbered lines with whether each is terminated and parses."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    whole = F.coalesce(text, F.make_valid_utf8(F.col("content").cast("string")))
    parts = files.select("path", F.split(whole, "\n", -1).alias("lines"))
    rows = parts.select("path", F.size("lines").alias("n"), F.posexplode("lines").alias("line", "raw"))
    rows = rows.where((F.col("line") < F.col("n") - 1) | (F.col("raw") != ""))
    parsed = F.try_parse_json("raw")
    good = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    return rows.select("path", "line", "raw", (F.col("line") < F.col("n") - 1).alias("ended"), good.alias("good"))


def decode_journals(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, file states). Only undamaged files give events.

    A state is ok, torn (ok but for its dropped last line) or damaged: a bad
    line inside, no header, an event of another schema or session, or a seq
    that doesn't grow. Gaps in seq are allowed.
    """
    lines = journal_lines(files)
    torn = ~F.col("good") & ~F.col("ended")
    kept = lines.where(~torn)
    headers = kept.where("line = 0").select("path", F.from_json("raw", HEADER).alias("h"))
    events = kept.where("line > 0").select("path", "line", "good", F.from_json("raw", EVENT, {"mode": "PERMISSIVE"}).alias("e"))
    w = Window.partitionBy("path").orderBy("line")
    checked = events.join(headers, "path", "left").withColumn("before", F.lag("e.seq").over(w))
    bad = (
        ~F.col("good")
        | F.col("e.seq").isNull()
        | (F.col("e.seq") <= 0)
        | F.coalesce(F.col("e.seq") <= F.col("before"), F.lit(False))
        | ~F.col("e.sessionId").eqNullSafe(F.col("h.sessionId"))
        | ~F.col("e.schema").eqNullSafe(F.col("h.schema"))
    )
    broken = checked.where(bad).select("path").distinct().withColumn("_broken", F.lit(True))
    head_ok = (F.col("h.type") == "session") & F.col("h.sessionId").isNotNull()
    states = (
        files.select("path")
        .distinct()
        .join(headers.select("path", F.coalesce(head_ok, F.lit(False)).alias("_head")), "path", "left")
        .join(lines.where(torn).select("path").distinct().withColumn("_torn", F.lit(True)), "path", "left")
        .join(broken, "path", "left")
        .select(
            "path",
            F.when(~F.coalesce("_head", F.lit(False)) | F.coalesce("_broken", F.lit(False)), "damaged")
            .when(F.coalesce("_torn", F.lit(False)), "torn")
            .otherwise("ok")
            .alias("state"),
        )
    )
    out = checked.join(states.where("state <> 'damaged'"), "path", "left_semi")
    fields = ["sessionId", "seq", "time", "type", "eventId", "turnId", "taskId", "source", "payload"]
    return out.select("path", "line", F.col("h.ownerId").alias("ownerId"), *[F.col(f"e.{f}").alias(f) for f in fields]), states


def inspect(states: DataFrame) -> DataFrame:
    """Counts of files by state."""
    return states.agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("state") == "damaged").alias("damaged"),
        F.count_if(F.col("state") == "torn").alias("torn_tails"),
    )


def within_caps(files: DataFrame, max_files: int, max_bytes: int) -> DataFrame:
    """Files in path order that fit a byte budget; one that doesn't fit is
    skipped without using any of it."""

    def step(s: dict, f: dict):
        if s["files"] >= max_files or s["bytes"] + f["bytes"] > max_bytes:
            return ()
        s.update(files=s["files"] + 1, bytes=s["bytes"] + f["bytes"])
        return [(f["path"],)]

    rule = Rule(("_all",), "path string", lambda: {"files": 0, "bytes": 0}, step)
    # a file above the whole budget never fits, so only the others are in line
    able = files.where(F.col("bytes") <= max_bytes)
    return fold(able.select("path", "bytes", F.lit(0).alias("_all")), rule, ("path",))


def append_events(journal: DataFrame, drafts: DataFrame) -> DataFrame:
    """Drafts that a journal doesn't hold yet, numbered on from its last seq.

    A draft whose event id is in its session's journal, or came earlier among
    the drafts, is dropped. Columns of both: session_id, event_id; the journal
    has seq, drafts have an order column ``pos``.
    """
    w = Window.partitionBy("session_id", "event_id").orderBy("pos")
    named = drafts.where("event_id is not null").withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    known = journal.select("session_id", "event_id").where("event_id is not null").distinct()
    fresh = named.join(known, ["session_id", "event_id"], "left_anti")
    fresh = fresh.unionByName(drafts.where("event_id is null"))
    last = journal.groupBy("session_id").agg(F.max("seq").alias("_last"))
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("pos"))
    out = fresh.join(last, "session_id", "left")
    return out.withColumn("seq", F.coalesce("_last", F.lit(0)) + number).drop("_last")


def project(events: DataFrame, keys: list[str], order: str, start: Column, step) -> DataFrame:
    """Folds each key's events in order with a column reducer."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*events.columns).alias("e"))))
    folded = F.aggregate(listed, start, lambda acc, x: step(acc, x["e"]))
    return events.groupBy(*keys).agg(folded.alias("state"))
