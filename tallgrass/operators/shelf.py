"""Catalogues, carts, routes, artifacts, sections, anchors and audio turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallgrass.functions import schedule as C
from tallgrass.functions import text as T
from tallgrass.operators.folds import Rule, fold

FREE_DELIVERY, DELIVERY_FEE, DEFAULT_ETA = 35, 5, 25


def matches_any(query: Column, *fields: Column) -> Column:
    """Whether some field holds the query, case ignored; an empty one matches."""
    out = query == ""
    for f in fields:
        out = out | F.contains(F.lower(f), F.lower(query))
    return out


def filter_or_all(items: DataFrame, keys: list[str], hit: Column) -> DataFrame:
    """Items that match; where none of a key does, all of its items."""
    w = Window.partitionBy(*keys)
    marked = items.withColumn("_hit", hit).withColumn("_any", F.max(F.col("_hit").cast("int")).over(w))
    return marked.where(F.col("_hit") | (F.col("_any") == 0)).drop("_hit", "_any")


def cart_totals(rows: DataFrame, key: str) -> DataFrame:
    """Subtotal, delivery fee, total and soonest arrival of a cart. An arrival
    of 0 counts as unknown, like none at all."""
    eta = F.min(F.regexp_extract("eta", "^\\s*(-?[0-9]+)", 1).try_cast("long"))
    out = rows.groupBy(key).agg(F.sum(F.col("price") * F.col("quantity")).alias("subtotal"), eta.alias("_eta"))
    fee = F.when(F.col("subtotal") >= FREE_DELIVERY, 0).otherwise(DELIVERY_FEE)
    return out.select(
        key, "subtotal", fee.alias("delivery_fee"), (F.col("subtotal") + fee).alias("total"),
        F.coalesce(F.nullif(F.col("_eta"), F.lit(0)), F.lit(DEFAULT_ETA)).alias("eta"),
    )


def route_totals(legs: DataFrame, key: str) -> DataFrame:
    """Distance in km with one decimal and whole minutes of a route's legs."""
    out = legs.groupBy(key).agg(F.sum("distance").alias("distance"), F.sum("duration").alias("duration"))
    return out.withColumns(
        {
            "km": F.format_string("%.1f", F.col("distance") / 1000),
            "minutes": F.ceil(F.col("duration") / 60),
        }
    )


def media_kind(media: Column) -> Column:
    return (
        F.when(media.startswith("image/"), "image")
        .when(media.startswith("audio/"), "audio")
        .when(media.startswith("video/"), "video")
        .otherwise("file")
    )


def artifact_views(artifacts: DataFrame) -> DataFrame:
    """Visible parts of artifacts (task_id, artifact_id, parts): text, data,
    valid base64 or a safe URL, in this order of precedence."""
    rows = artifacts.select("task_id", "artifact_id", F.posexplode("parts").alias("index", "p"))
    media = F.coalesce(F.nullif(F.lower(T.trim(F.coalesce("p.mediaType", F.lit("")))), F.lit("")), F.lit("application/octet-stream"))
    raw = F.regexp_replace(F.coalesce("p.raw", F.lit("")), f"{T.WS}", "")
    raw_ok = (raw != "") & raw.rlike("^[A-Za-z0-9+/]*={0,2}$")
    url = F.coalesce("p.url", F.lit(""))
    kind = (
        F.when(F.col("p.text").isNotNull(), F.when(F.col("p.text") != "", "text"))
        .when(F.col("p.data").isNotNull(), F.when(F.col("p.data") != "", "data"))
        .when(F.col("p.raw").isNotNull(), F.when(raw_ok, media_kind(media)))
        .when(url.rlike("(?i)^(?:https?://|data:)"), media_kind(media))
    )
    href = F.when(F.col("p.raw").isNotNull(), F.concat(F.lit("data:"), media, F.lit(";base64,"), raw)).otherwise(F.col("p.url"))
    content = F.when(kind.isin("text", "data"), F.coalesce("p.text", "p.data")).otherwise(href)
    out = rows.select("task_id", "artifact_id", "index", kind.alias("kind"), content.alias("content"), media.alias("media"))
    return out.where("kind is not null")


def complete_inputs(inputs: DataFrame, assets: DataFrame) -> DataFrame:
    """Inputs with their assets; a reference without an asset is an error of
    its input, counted and not dropped."""
    met = inputs.join(assets, "ref", "left")
    return met.groupBy("input_id").agg(
        F.count(F.lit(1)).alias("refs"),
        F.count_if(F.col("bytes").isNull()).alias("missing"),
        F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes"),
    )


def observed_section(text: Column, heading: str) -> Column:
    """struct<before, items, after> of a Markdown document's section: bullets
    from its heading to the next second-level heading."""
    at = F.instr(text, heading)
    rest = F.substring(text, at + len(heading), F.length(text))
    cut = F.regexp_instr(rest, F.lit("\n## "))
    body = F.when(cut > 0, F.substring(rest, F.lit(1), cut - 1)).otherwise(rest)
    lines = F.transform(F.split(body, "\n"), T.trim)
    items = F.filter(
        F.transform(F.filter(lines, lambda x: x.startswith("- ")), lambda x: T.trim(F.substring(x, F.lit(3), F.length(x)))),
        lambda x: x != "",
    )
    end = f"{T.WS}+$"
    none = F.array().cast("array<string>")
    return F.when(
        at > 0,
        F.struct(
            F.regexp_replace(F.substring(text, F.lit(1), at - 1), end, "").alias("before"),
            items.alias("items"),
            F.when(cut > 0, F.regexp_replace(F.substring(rest, cut, F.length(rest)), end, "")).otherwise("").alias("after"),
        ),
    ).otherwise(F.struct(F.regexp_replace(text, end, "").alias("before"), none.alias("items"), F.lit("").alias("after")))


def anchors(text: Column, references: Column) -> Column:
    """struct<text, spans>: references that the text lacks are put before it,
    and each is located after the one before it, else from the start."""
    missing = F.array_join(F.filter(references, lambda r: ~F.contains(text, r)), " ")
    whole = F.when(missing == "", text).when(text == "", missing).otherwise(F.concat(missing, F.lit(" "), text))
    none = F.array().cast("array<struct<value:string,start:int,end:int>>")

    def step(acc: Column, r: Column) -> Column:
        after = F.position(r, whole, acc["at"] + 1)
        start = F.when(after > 0, after - 1).otherwise(F.position(r, whole) - 1)
        end = start + F.length(r)
        return F.struct(
            end.alias("at"),
            F.concat(acc["spans"], F.array(F.struct(r.alias("value"), start.alias("start"), end.alias("end")))).alias("spans"),
        )

    found = F.aggregate(references, F.struct(F.lit(0).alias("at"), none.alias("spans")), step)
    return F.struct(whole.alias("text"), found["spans"].alias("spans"))


def expand_groups(requests: DataFrame, groups: dict[str, tuple[str, ...]], part: str) -> DataFrame:
    """Group names become their parts; a plain part stays, unknown ones go."""
    known = {p: (p,) for ps in groups.values() for p in ps} | groups
    table = F.create_map(*[x for k, v in known.items() for x in (F.lit(k), F.array(*[F.lit(p) for p in v]))])
    return requests.withColumn(part, F.explode(table[F.col(part)]))


def ranged(value: Column, low: float, high: float) -> Column:
    """struct<valid, clamped> of a number against a range."""
    return F.struct(value.between(low, high).alias("valid"), F.greatest(F.lit(low), F.least(F.lit(high), value)).alias("clamped"))


def series(rules: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Occurrences of recurring schedules in a span of time, after their first.

    Columns: id, at, recurrence, zone. Calendar days come from a sequence, so
    a series is one explode.
    """
    zone, at = F.col("zone"), F.col("at")
    wall = C.local_wall(at, zone)
    low = F.greatest(wall.cast("date"), F.date_sub(C.local_wall(F.lit(start_ms).cast("long"), zone).cast("date"), 1))
    high = F.date_add(C.local_wall(F.lit(end_ms).cast("long"), zone).cast("date"), 1)
    days = F.when(low <= high, F.sequence(low, high))
    rows = rules.withColumn("_wall", wall).withColumn("_day", F.explode(days))
    fits = (
        (F.col("recurrence") == "daily")
        | ((F.col("recurrence") == "weekly") & (F.pmod(F.datediff("_day", F.col("_wall").cast("date")), F.lit(7)) == 0))
        | ((F.col("recurrence") == "weekdays") & ~F.dayofweek("_day").isin(1, 7))
    )
    out = rows.where(fits).withColumn("occurs_ms", C.wall_to_ms(F.col("_day"), F.col("_wall"), zone))
    inside = (F.col("occurs_ms") > at) & F.col("occurs_ms").between(start_ms, end_ms - 1)
    return out.where(inside).select("id", "occurs_ms")


def audio_turns(chunks: DataFrame, pre_roll: int, most: int) -> DataFrame:
    """Bytes of each spoken turn: the last ``pre_roll`` bytes before speech,
    then its own, at most ``most``. Kinds: chunk, start, stop, end."""

    def step(s: dict, c: dict):
        if c["kind"] == "chunk":
            if s["turn"] is None:
                s["roll"].append(min(c["bytes"], pre_roll))
                while s["roll"] and sum(s["roll"]) > pre_roll:
                    s["roll"].pop(0)
            elif s["bytes"] < most:
                s["bytes"] += min(c["bytes"], most - s["bytes"])
        elif c["kind"] == "start":
            s.update(turn=c["seq"], bytes=sum(s["roll"]), roll=[])
        elif c["kind"] == "stop":
            turn, s["turn"] = s["turn"], None
            if turn is not None and s["bytes"]:
                return [(c["source"], turn, c["seq"], s["bytes"])]
        else:
            s.update(turn=None, roll=[])
        return ()

    schema = "source long, start_seq long, stop_seq long, bytes long"
    return fold(chunks, Rule(("source",), schema, lambda: {"roll": [], "turn": None, "bytes": 0}, step))


def read_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(parsed cases, errors with file and line number) of JSON line files."""
    lines = spark.read.format("text").option("wholetext", "true").load(path).select(
        F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("line", "raw")
    )
    lines = lines.where(F.trim("raw") != "").withColumn("line", F.col("line") + 1)
    parsed = lines.withColumn("case", F.try_parse_json("raw"))
    good = F.coalesce(F.schema_of_variant("case").startswith("OBJECT"), F.lit(False))
    return parsed.where(good).select("path", "line", "case"), parsed.where(~good).select("path", "line", "raw")
