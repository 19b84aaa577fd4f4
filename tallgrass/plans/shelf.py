"""Queries over catalogues, carts, artifacts, sections and audio."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallgrass.functions import audio as P
from tallgrass.functions import text as T
from tallgrass.operators import shelf as L
from tallgrass.plans.base import EVENTS, events, query, table


@query("title_filter", "select p_partkey from part where contains(lower(p_name), 'a') or contains(lower(p_brand), 'brand#1') or contains(lower(p_type), 'a1')")
def title_filter(spark, d):
    rows = table(spark, d, "part")
    return rows.where(
        F.contains(F.lower("p_name"), F.lit("a")) | L.matches_any(F.lit("Brand#1"), F.col("p_brand")) | L.matches_any(F.lit("a1"), F.col("p_type"))
    ).select("p_partkey")


@query("catalog_fallback", """, x as (select p_partkey, p_brand, p_size > 48 as hit, max(case when p_size > 48 then 1 else 0 end) over (partition by p_brand) as any_hit from part)
 select p_partkey, p_brand from x where hit or any_hit = 0""")
def catalog_fallback(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    return L.filter_or_all(rows, ["p_brand"], F.col("p_size") > 48).select("p_partkey", "p_brand")


@query("favorites", "select p_partkey, p_name from part where p_partkey in (select k from ev)", EVENTS)
def favorites(spark, d):
    liked = events(spark, d).select(F.col("k").alias("p_partkey")).distinct()
    return table(spark, d, "part").join(liked, "p_partkey", "left_semi").select("p_partkey", "p_name")


@query("cart_totals", """, x as (select source, cast(sum(k * (seq % 3 + 1)) as bigint) as subtotal, min(k % 40) as eta from ev group by 1)
 select source, subtotal, cast(case when subtotal >= 35 then 0 else 5 end as bigint) as delivery_fee, subtotal + case when subtotal >= 35 then 0 else 5 end as total, coalesce(nullif(eta, 0), 25) as eta from x""", EVENTS)
def cart_totals(spark, d):
    rows = events(spark, d).selectExpr("source", "k as price", "seq % 3 + 1 as quantity", "concat(k % 40, '分钟') as eta")
    return L.cart_totals(rows, "source")


@query("route_totals", "select source, cast(sum(k * 100) as bigint) as distance, cast(sum(k * 7) as bigint) as duration, printf('%.1f', sum(k * 100) / 1000) as km, cast(ceil(sum(k * 7) / 60) as bigint) as minutes from ev group by 1", EVENTS)
def route_totals(spark, d):
    rows = events(spark, d).selectExpr("source", "k * 100 as distance", "k * 7 as duration")
    return L.route_totals(rows, "source")


@query("artifact_views", """select concat('t', seq) as task_id, cast(0 as bigint) as index, 'text' as kind, name as content, 'text/plain' as media from ev where k % 4 = 0
 union all select concat('t', seq), 1, 'image', 'data:image/png;base64,QUJD', 'image/png' from ev where k % 3 = 0
 union all select concat('t', seq), 2, 'file', concat('https://x/', k), 'application/octet-stream' from ev where k % 5 <> 0""", EVENTS)
def artifact_views(spark, d):
    shape = "struct<mediaType:string,text:string,data:string,raw:string,url:string>"

    def part(**values):
        names = ("mediaType", "text", "data", "raw", "url")
        return F.struct(*[values.get(n, F.lit(None).cast("string")).alias(n) for n in names]).cast(shape)

    c = F.col
    parts = F.array(
        part(mediaType=F.lit(" Text/Plain"), text=F.when(c("k") % 4 == 0, c("name")).otherwise("")),
        part(mediaType=F.lit("image/png"), raw=F.when(c("k") % 3 == 0, "QUJ D").otherwise("no!")),
        part(url=F.when(c("k") % 5 == 0, "javascript:x").otherwise(F.concat(F.lit("https://x/"), c("k").cast("string")))),
    )
    rows = events(spark, d).select(F.concat(F.lit("t"), F.col("seq").cast("string")).alias("task_id"), F.lit("a").alias("artifact_id"), parts.alias("parts"))
    return L.artifact_views(rows).drop("artifact_id")


@query("input_assets", """, a as (select distinct k as ref, k * 10 as bytes from ev where k % 3 <> 0) select source as input_id, count(*) as refs, count(*) filter (bytes is null) as missing,
 cast(sum(coalesce(bytes, 0)) as bigint) as bytes from ev left join a on a.ref = ev.k group by 1""", EVENTS)
def input_assets(spark, d):
    rows = events(spark, d).selectExpr("source as input_id", "k as ref")
    assets = rows.where("ref % 3 <> 0").selectExpr("ref", "ref * 10 as bytes").distinct()
    return L.complete_inputs(rows, assets)


@query("anchored_values", """, x as (select conv_id, turn, lower(regexp_replace(text, '[^\\p{L}\\p{N}]+', '', 'g')) as q, lower(regexp_replace(lead(text) over (partition by conv_id order by turn), '[^\\p{L}\\p{N}]+', '', 'g')) as v0 from conversations),
 y as (select *, substr(v0, 1, 4) as v from x) select conv_id, turn, case when length(v) <= 2 then v <> '' and contains(q, v) else len(list_filter([substr(v, i, 2) for i in range(1, length(v))], lambda g: contains(q, g))) > 0 end as anchored from y where v0 is not null""")
def anchored_values(spark, d):
    from pyspark.sql import Window

    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, d, "conversations").withColumn("v", after).where("v is not null")
    value = F.substring(T.bare(F.col("v")), 1, 4)
    return rows.select("conv_id", "turn", T.anchored(value, F.col("text")).alias("anchored"))


@query("bullet_dedup", "select seq, concat('- ', name, chr(10), chr(10), '- b', k, chr(10), 'end') as markdown from ev", EVENTS)
def bullet_dedup(spark, d):
    doc = F.concat(F.lit("- "), "name", F.lit("\n\n\n- "), F.upper("name"), F.lit("\n- b"), F.col("k").cast("string"), F.lit("\n* b"), F.col("k").cast("string"), F.lit("\nend\n\n"))
    return events(spark, d).select("seq", T.dedup_bullets(doc).alias("markdown"))


@query("observed_sections", "select seq, name as head, concat('k', k, ',', 'z') as items, concat(chr(10), '## Next', chr(10), 'x') as tail from ev", EVENTS)
def observed_sections(spark, d):
    doc = F.concat("name", F.lit("  \n## Observed\nnote\n- k"), F.col("k").cast("string"), F.lit("\n-  z \n- \n\n## Next\nx  "))
    s = L.observed_section(doc, "## Observed")
    rows = events(spark, d).select("seq", s.alias("s"))
    return rows.select("seq", F.col("s.before").alias("head"), F.array_join("s.items", ",").alias("items"), F.col("s.after").alias("tail"))


@query("attachment_anchors", """select seq, concat('[b', k, '] see [a] and [a]') as text, concat(length(concat('[b', k, '] see ')), '-', length(concat('[b', k, '] see ')) + 3, ';0-', length(concat('[b', k, ']'))) as spans from ev""", EVENTS)
def attachment_anchors(spark, d):
    refs = F.array(F.lit("[a]"), F.concat(F.lit("[b"), F.col("k").cast("string"), F.lit("]")))
    rows = events(spark, d).select("seq", L.anchors(F.lit("see [a] and [a]"), refs).alias("x"))
    spans = F.array_join(F.transform("x.spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ";")
    return rows.select("seq", "x.text", spans.alias("spans"))


@query("part_groups", """select seq, unnest(case k % 3 when 0 then ['front_left', 'front_right'] when 1 then ['rear_left'] else ['front_left', 'front_right', 'rear_left', 'rear_right'] end) as part from ev""", EVENTS)
def part_groups(spark, d):
    groups = {"front": ("front_left", "front_right"), "windows": ("front_left", "front_right", "rear_left", "rear_right")}
    rows = events(spark, d).selectExpr("seq", "case k % 3 when 0 then 'front' when 1 then 'rear_left' else 'windows' end as part")
    return L.expand_groups(rows, groups, "part")


@query("ranged_numbers", "select seq, value between 10 and 100 as valid, greatest(10, least(100, value)) as clamped from ev", EVENTS)
def ranged_numbers(spark, d):
    return events(spark, d).select("seq", L.ranged(F.col("value"), 10.0, 100.0).alias("r")).select("seq", "r.valid", "r.clamped")


@query("series_expansion", """, r as (select seq as id, make_timestamp(time_ms * 1000) as w, k from ev where k % 10 < 3), d as (select unnest(range(timestamp '2024-01-10', timestamp '2024-01-20', interval 1 day)) as day),
 o as (select id, k, w, date_trunc('day', day) + (w - date_trunc('day', w)) as t from r, d), f as (select * from o where t > w and t >= timestamp '2024-01-10' and t < timestamp '2024-01-20'
 and (k % 10 = 0 or (k % 10 = 1 and date_diff('day', date_trunc('day', w), date_trunc('day', t)) % 7 = 0) or (k % 10 = 2 and dayofweek(t) not in (0, 6))))
 select id, epoch_us(t) // 1000 as occurs_ms from f""", EVENTS)
def series_expansion(spark, d):
    rows = events(spark, d).where("k % 10 < 3").selectExpr(
        "seq as id", "time_ms as at", "case k % 10 when 0 then 'daily' when 1 then 'weekly' else 'weekdays' end as recurrence", "'UTC' as zone"
    )
    return L.series(rows, 1_704_844_800_000, 1_705_708_800_000)


_TURNS = """recursive , x as (select source, seq, k * 100 as b, case name when 'signup' then 'start' when 'purchase' then 'stop' else 'chunk' end as kind, row_number() over (partition by source order by seq) as rn from ev),
 r as (select source, seq, rn, case when kind = 'chunk' then list_filter([least(b, 8000)], lambda t: t <= 8000) else []::bigint[] end as roll, case when kind = 'start' then seq end as turn, cast(0 as hugeint) as bytes,
 cast(null as bigint) as told, cast(null as hugeint) as size from x where rn = 1 union all
 select x.source, x.seq, x.rn, case when x.kind = 'start' then []::bigint[] when x.kind = 'chunk' and r.turn is null
 then list_append(r.roll, least(x.b, 8000))[list_filter(range(1, len(r.roll) + 3), lambda i: coalesce(list_sum(list_append(r.roll, least(x.b, 8000))[i:]), 0) <= 8000)[1]:] else r.roll end,
 case when x.kind = 'start' then x.seq when x.kind = 'stop' then null else r.turn end,
 case when x.kind = 'start' then coalesce(list_sum(r.roll), 0) when x.kind = 'chunk' and r.turn is not null then r.bytes + greatest(0, least(x.b, 12000 - r.bytes)) else r.bytes end,
 case when x.kind = 'stop' and r.bytes > 0 then r.turn end, r.bytes from r join x on x.source = r.source and x.rn = r.rn + 1)
 select source, told as start_seq, seq as stop_seq, cast(size as bigint) as bytes from r where told is not null"""


@query("audio_turns", _TURNS, EVENTS)
def audio_turns(spark, d):
    rows = events(spark, d).selectExpr(
        "source", "seq", "k * 100 as bytes", "case name when 'signup' then 'start' when 'purchase' then 'stop' else 'chunk' end as kind"
    )
    return L.audio_turns(rows, 8000, 12_000)


@query("audio_codec", "select seq, cast(trunc(case when k < 50 then (k - 50) / 50.0 * 32768 else (k - 50) / 50.0 * 32767 end) as bigint) as sample from ev", EVENTS)
def audio_codec(spark, d):
    x = (F.col("k") - 50) / 50.0
    raw = P.encode_pcm16(F.array(x.cast("float"), x.cast("float")))
    rows = events(spark, d).select("seq", P.decode_pcm16(raw).alias("s"))
    return rows.select("seq", F.round(F.col("s")[0] * 32768).cast("long").alias("sample"))


@query("audio_resample", "select seq, cast(octet_length(encode(repeat('ab', 480))) // 2 as bigint) // 2 as samples from ev", EVENTS)
def audio_resample(spark, d):
    raw = F.repeat(F.lit("ab"), F.lit(480)).cast("binary")
    run = P.resampler(48_000, 24_000)
    return events(spark, d).select("seq", raw.alias("raw")).select("seq", (F.octet_length(run("raw")) / 2).cast("long").alias("samples"))


# the star schema has no part in the service; these show the platform only


@query("platform_pricing", """select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc, count(*) as n from lineitem
 where l_shipdate <= timestamp '1998-09-02' group by 1, 2""")
def platform_pricing(spark, d):
    rows = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.count(F.lit(1)).alias("n")
    )


@query("platform_join", """select n_name, o_orderpriority, count(*) as orders, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey
 join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'EUROPE' group by 1, 2""")
def platform_join(spark, d):
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    met = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).join(r.where("r_name = 'EUROPE'"), n["n_regionkey"] == r["r_regionkey"])
    return met.groupBy("n_name", "o_orderpriority").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("platform_top_parts", """select l_suppkey, l_partkey, q from (select l_suppkey, l_partkey, sum(l_quantity) as q, row_number() over (partition by l_suppkey order by sum(l_quantity) desc, l_partkey) rn from lineitem group by 1, 2) where rn <= 3""")
def platform_top_parts(spark, d):
    from tallgrass.operators.ledger import newest

    sums = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    return newest(sums, "l_suppkey", "q", "l_partkey", 3)
