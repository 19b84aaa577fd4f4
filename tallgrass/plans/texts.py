"""Queries over texts, schedules and numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallgrass.functions import scalars as S
from tallgrass.functions import schedule as C
from tallgrass.functions import text as T
from tallgrass.operators import evidence as E
from tallgrass.plans.base import EVENTS, events, query, table
from tallgrass.sources import store

#: JavaScript white space for RE2.
WS = T.WS_RE2


@query("clean_text", f"select doc_id, substr(trim(regexp_replace(text, '{WS}+', ' ', 'g')), 1, 300) as cleaned from documents")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clean(F.col("text"), 300).alias("cleaned"))


_UNITS = f"select doc_id, trim(regexp_replace(replace(text, 'e', '😀'), '{WS}+', ' ', 'g')) as t from documents"


@query("cited_title", f"""with c as ({_UNITS}), p as (select doc_id, list_transform(range(0, 81), lambda i: substr(t, 1, i)) as heads from c)
 select doc_id, list_extract(list_filter(heads, lambda h: length(h) + length(regexp_replace(h, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) <= 80), -1) as cut from p""")
def cited_title(spark, d):
    """Texts with pairs of UTF-16 units, cut to 80 units without half a pair."""
    text = F.replace(F.col("text"), F.lit("e"), F.lit("😀"))
    return table(spark, d, "documents").select("doc_id", T.clean_units(text, 80).alias("cut"))


@query("bare_text", "select doc_id, md5(lower(regexp_replace(text, '[^\\p{L}\\p{N}]+', '', 'g'))) as bare from documents")
def bare_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.bare(F.col("text"))).alias("bare"))


@query("speech_keys", f"select conv_id, turn, lower(regexp_replace(trim(regexp_replace(text, '{WS}+', ' ', 'g')), '(?:[\\p{{P}}\\p{{S}}]|{WS})+', '', 'g')) as key from conversations")
def speech_keys(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.speech_key(F.col("text")).alias("key"))


@query("sensitive_gate", """select doc_id, regexp_matches(text, '(?i)(?:api[_-]?key|access[_-]?key|secret|token|password|passwd)')
 or regexp_matches(text, '(?:密码|密钥|口令|验证码|令牌|证件号|身份证)') or regexp_matches(text, '\\bsk-[A-Za-z0-9]{8,}')
 or regexp_matches(text, '\\b\\d{11,19}\\b') or regexp_matches(text, '[A-Za-z0-9+/]{40,}={0,2}') as sensitive from documents""")
def sensitive_gate(spark, d):
    return table(spark, d, "documents").select("doc_id", T.sensitive(F.col("text")).alias("sensitive"))


@query("scrub_log", """select event_id, regexp_replace(concat('Authorization: Bearer a', event_id, 'b ', props), '(?i)\\b(bearer|basic)\\s+[A-Za-z0-9._~+/=-]+', '\\1 [REDACTED]', 'g') as line from events""")
def scrub_log(spark, d):
    line = F.concat(F.lit("Authorization: Bearer a"), F.col("event_id").cast("string"), F.lit("b "), "props")
    return table(spark, d, "events").select("event_id", T.scrub(line).alias("line"))


#: A log entry with secrets by key, in text, in a URL and below; @ for the number.
_ENTRY = '{"credential":"c@","n":{"session_cookie":{"a":1},"u":"http://h/?x=1&token=z@&y=2"},"l":["Basic a@=","plain @"],"max_token":"5","tokens":7,"key":"sk-abcdefgh@"}'
_REDACTED = '{"credential":"[REDACTED]","n":{"session_cookie":"[REDACTED]","u":"http://h/?x=1&token=[REDACTED]&y=2"},"l":["Basic [REDACTED]","plain @"],"max_token":"[REDACTED]","tokens":7,"key":"[REDACTED]"}'
_NESTED = '{"a":{"a":{"a":{"a":{"a":{"a":{"a":{"a":{"a":@}}}}}}}}}'


def _spread(ids, rows_a_task: int = 5_000, most: int = 2_000):
    """The rows dealt over tasks by their count: an id takes few bytes of a
    file, so that the file's own partitions are few, and its long text many."""
    return ids.repartition(min(most, ids.count() // rows_a_task + 1))


@query("redacted_fields", f"""select event_id, replace('{_REDACTED}', '@', cast(event_id as varchar)) as entry, '{_NESTED}'.replace('{{"a":@}}', '"[MaxDepth]"') as nested,
 concat(repeat('x', 32000), '…[truncated]') as long from events""")
def redacted_fields(spark, d):
    number = F.col("event_id").cast("string")

    def made(text: str):
        return T.redact(F.replace(F.lit(text), F.lit("@"), number))

    long = T.scrub(F.concat(F.repeat(F.lit("x"), F.lit(32000)), number))
    return _spread(table(spark, d, "events").select("event_id")).select("event_id", made(_ENTRY).alias("entry"), made(_NESTED).alias("nested"), long.alias("long"))


@query("bigram_overlap", """, k as (select conv_id, turn, lower(regexp_replace(text, '[^\\p{L}\\p{N}]+', '', 'g')) as b from conversations),
 p as (select a.conv_id, a.turn, list_distinct([substr(a.b, i, 2) for i in range(1, length(a.b))]) as x, list_distinct([substr(c.b, i, 2) for i in range(1, length(c.b))]) as y
 from k a join k c on a.conv_id = c.conv_id and c.turn = a.turn + 1) select conv_id, turn, len(x) as grams, len(list_intersect(x, y)) as shared from p""")
def bigram_overlap(spark, d):
    keyed = table(spark, d, "conversations").select("conv_id", "turn", T.ngrams(T.bare(F.col("text"))).alias("x"))
    after = keyed.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("x").alias("y"))
    met = keyed.join(after, ["conv_id", "turn"])
    return met.select("conv_id", "turn", F.size("x").alias("grams"), F.size(F.array_intersect("x", "y")).alias("shared"))


@query("query_terms", """, t as (select item_id, regexp_extract_all(lower(trim(substr(text, 1, 500))), '[\\p{L}\\p{N}]+') as w from benchmark)
 select item_id, array_to_string(list_sort(list_distinct(list_filter(w, lambda x: length(x) >= 2))), ' ') as terms from t""")
def query_terms(spark, d):
    terms = F.array_sort(T.query_terms(F.substring("text", 1, 500)))
    return table(spark, d, "benchmark").select("item_id", F.array_join(terms, " ").alias("terms"))


@query("occurrence_count", "select doc_id, cast((length(text) - length(replace(text, 'the', ''))) / 3 as bigint) as n from documents")
def occurrence_count(spark, d):
    return table(spark, d, "documents").select("doc_id", T.occurrences(F.col("text"), F.lit("the")).alias("n"))


@query("replace_once", """select conv_id, turn, case when (length(text) - length(replace(text, ' and ', ''))) / 5 = 1 then md5(replace(text, ' and ', ' & ')) end as edited from conversations""")
def replace_once(spark, d):
    edited = T.replace_once(F.col("text"), F.lit(" and "), F.lit(" & "))
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(edited).alias("edited"))


@query("truncated_text", "select doc_id, case when length(text) > 40 then concat(substr(text, 1, 40), '…') else text end as short from documents")
def truncated_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.truncated(F.col("text"), 40).alias("short"))


@query("list_values", """, x as (select conv_id, turn, unnest(string_split_regex(text, '[、,，;；/｜|]')) as v from conversations),
 y as (select conv_id, turn, regexp_replace(v, '^[\\s\\x{0B}\\x{A0}]+|[\\s\\x{0B}\\x{A0}]+$', '', 'g') as v from x) select conv_id, turn, v as part from y where v <> ''""")
def list_values(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.explode(T.split_list(F.col("text"))).alias("part"))


@query("escaped_markup", "select doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')) as escaped from documents")
def escaped_markup(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.escape_markup(F.col("text"))).alias("escaped"))


@query("fingerprints", """select doc_id, substr(sha256(text), 1, 24) as objective, sha1(text) as file_mark, substr(sha256(text), 1, 12) as item, substr(sha256(text), 1, 16) as revision from documents""")
def fingerprints(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", S.fingerprint(c, 24).alias("objective"), F.sha1(c).alias("file_mark"),
        S.fingerprint(c, 12).alias("item"), S.fingerprint(c, 16).alias("revision"),
    )


@query("clamped_numbers", """select seq, greatest(1, least(8, case when cast(k % 12 as bigint) = 0 then 5 else k % 12 end)) as top_k,
 floor(value + 0.5) as rounded from ev""", EVENTS)
def clamped_numbers(spark, d):
    return events(spark, d).select(
        "seq", S.bounded((F.col("k") % 12).cast("double"), 1, 8, 5).alias("top_k"), F.floor(F.col("value") + 0.5).cast("double").alias("rounded")
    )


@query("retry_delays", "select seq, cast(least(10000, 500 * power(2, least(k, 8))) as bigint) as delay_ms, cast(least(10000, 1000 * power(2, least(k, 4))) as bigint) as announce_ms from ev", EVENTS)
def retry_delays(spark, d):
    return events(spark, d).select(
        "seq", S.backoff(F.col("k")).alias("delay_ms"), S.backoff(F.col("k"), 1000, 10_000, 4).alias("announce_ms")
    )


@query("debounce_due", """select seq, greatest(least(time_ms + 500, time_ms - k * 100 + 2000), coalesce(case when k % 2 = 0 then time_ms - k * 50 end + 1000, least(time_ms + 500, time_ms - k * 100 + 2000))) as due_ms from ev""", EVENTS)
def debounce_due(spark, d):
    c = F.col
    sent = F.when(c("k") % 2 == 0, c("time_ms") - c("k") * 50)
    return events(spark, d).select(
        "seq", S.debounce_due(c("time_ms") - c("k") * 100, c("time_ms"), sent, 500, 2000, 1000).alias("due_ms")
    )


@query("data_urls", """, x as (select seq, concat('data:image/png;base64,', repeat('QUJD', cast(k % 7 as integer)), case k % 3 when 0 then '' when 1 then 'QQ==' else 'QUI=' end) as u from ev)
 select seq, 'image/png' as media, cast(octet_length(from_base64(split_part(u, ',', 2))) as bigint) as bytes from x""", EVENTS)
def data_urls(spark, d):
    tail = F.when(F.col("k") % 3 == 0, "").when(F.col("k") % 3 == 1, "QQ==").otherwise("QUI=")
    url = F.concat(F.lit("data:image/png;base64,"), F.repeat(F.lit("QUJD"), (F.col("k") % 7).cast("int")), tail)
    return events(spark, d).select("seq", S.data_url(url).alias("u")).select("seq", "u.media", "u.bytes")


@query("attachment_bytes", """select source, cast(sum((k % 7) * 3 + case k % 3 when 0 then 0 when 1 then 1 else 2 end) as bigint) as bytes from ev group by 1""", EVENTS)
def attachment_bytes(spark, d):
    tail = F.when(F.col("k") % 3 == 0, "").when(F.col("k") % 3 == 1, "QQ==").otherwise("QUI=")
    url = F.concat(F.lit("data:image/png;base64,"), F.repeat(F.lit("QUJD"), (F.col("k") % 7).cast("int")), tail)
    return events(spark, d).groupBy("source").agg(F.sum(S.data_url(url)["bytes"]).alias("bytes"))


@query("blocked_addresses", """, x as (select seq, k % 256 as a, (k * 3) % 256 as b, seq % 256 as c from ev) select seq, a = 0 or a = 10 or a = 127 or (a = 100 and b between 64 and 127)
 or (a = 169 and b = 254) or (a = 172 and b between 16 and 31) or (a = 192 and b = 0 and c in (0, 2)) or (a = 192 and b = 168) or (a = 198 and b in (18, 19))
 or (a = 198 and b = 51 and c = 100) or (a = 203 and b = 0 and c = 113) or a >= 224 as blocked from x""", EVENTS)
def blocked_addresses(spark, d):
    address = F.concat_ws(".", *[x.cast("string") for x in (F.col("k") % 256, (F.col("k") * 3) % 256, F.col("seq") % 256, F.lit(7))])
    return events(spark, d).select("seq", S.blocked_ipv4(address).alias("blocked"))


@query("blocked_networks", """select seq, case k % 10 when 0 then concat('fc00::', printf('%x', seq % 65536)) when 1 then concat('fdff:1::', printf('%x', seq % 65536))
 when 2 then concat('fe80::', printf('%x', seq % 65536)) when 3 then concat('febf::', printf('%x', seq % 65536)) when 4 then concat('fec0::', printf('%x', seq % 65536))
 when 5 then concat('2001:db8::', printf('%x', seq % 65536)) when 6 then concat('2001::', printf('%x', seq % 65536)) when 7 then concat('::ffff:10.0.0.', seq % 250)
 when 8 then concat('::ffff:8.8.8.', seq % 250) else concat('ff02::', printf('%x', seq % 65536)) end as address, k % 10 not in (4, 6, 8) as blocked from ev""", EVENTS)
def blocked_networks(spark, d):
    tail, last = F.lower(F.hex(F.col("seq") % 65536)), (F.col("seq") % 250).cast("string")
    heads = ("fc00::", "fdff:1::", "fe80::", "febf::", "fec0::", "2001:db8::", "2001::", "::ffff:10.0.0.", "::ffff:8.8.8.", "ff02::")
    at = (F.col("k") % 10).cast("int")
    address = F.concat(F.get(F.array(*map(F.lit, heads)), at), F.when(at.isin(7, 8), last).otherwise(tail))
    return events(spark, d).select("seq", address.alias("address")).withColumn("blocked", S.blocked_ipv6(F.col("address")))


@query("call_signatures", """select seq, concat(name, ':{"a":"', id, '","k":', k, '}') as signature from ev""", EVENTS)
def call_signatures(spark, d):
    body = F.concat(F.lit('{ "k": '), F.col("k").cast("string"), F.lit(', "a":"'), "id", F.lit('"}'))
    return events(spark, d).select("seq", S.call_signature(F.col("name"), body).alias("signature"))


@query("path_lookup", "select event_id, json_extract_string(props, '$.k') as k from events")
def path_lookup(spark, d):
    return table(spark, d, "events").select("event_id", S.path_value(F.col("props"), F.lit("k")).alias("k"))


@query("first_json", "select event_id, props as found from events")
def first_json(spark, d):
    text = F.concat(F.lit("answer: } "), "props", F.lit(" and {more}"))
    return table(spark, d, "events").select("event_id", S.first_json_object(text).alias("found"))


_NEXT = """, x as (select seq, k, time_ms, {now} as now from ev),
 y as (select *, make_timestamp(time_ms * 1000) as w, cast(make_timestamp(now * 1000) as date) as today from x),
 z as (select *, case when time_ms > now then 0 when k % 3 = 1 then greatest(7, cast(ceil(greatest(0, date_diff('day', cast(w as date), today)) / 7.0) * 7 as integer))
 else greatest(1, date_diff('day', cast(w as date), today)) end as days, case when k % 3 = 1 then 7 else 1 end as step from y),
 c as (select seq, now, k, unnest([w + to_days(cast(days + i * step as integer)) for i in range(0, 8)]) as t from z)
 select seq, epoch_us(min(t)) // 1000 as next_ms from c where epoch_us(t) // 1000 > now and (k % 3 <> 2 or dayofweek(t) not in (0, 6)) group by 1"""


@query("next_occurrence", _NEXT.format(now=1_706_000_000_000), EVENTS)
def next_occurrence(spark, d):
    kind = F.when(F.col("k") % 3 == 0, "daily").when(F.col("k") % 3 == 1, "weekly").otherwise("weekdays")
    at = C.next_occurrence(F.col("time_ms"), kind, F.lit("UTC"), F.lit(1_706_000_000_000).cast("long"))
    return events(spark, d).select("seq", at.alias("next_ms"))


@query("relative_day", """, x as (select seq, date_diff('day', cast(make_timestamp(time_ms * 1000) as date), date '2024-02-05') as n from ev)
 select seq, n as days, case when n <= 0 then '今天' when n = 1 then '昨天' when n < 7 then concat(n, ' 天前') when n < 14 then '上周'
 when n < 30 then concat(n // 7, ' 周前') else concat(n // 30, ' 个月前') end as phrase from x""", EVENTS)
def relative_day(spark, d):
    days = C.days_ago(F.col("time_ms"), F.lit(1_707_091_200_000).cast("long"), F.lit("UTC"))
    return events(spark, d).select("seq", days.alias("days"), C.relative_day(days).alias("phrase"))


@query("wall_clock", """select seq, epoch_us(timezone('America/New_York', make_timestamp(time_ms * 1000))) // 1000 as instant_ms from ev""", EVENTS)
def wall_clock(spark, d):
    wall = C.local_wall(F.col("time_ms"), F.lit("UTC"))
    return events(spark, d).select("seq", C.wall_to_ms(wall.cast("date"), wall, F.lit("America/New_York")).alias("instant_ms"))


@query("topics", """, x as (select source, list(name order by seq) as t from ev group by 1) select source, array_to_string(list_filter(t, lambda v, i: list_position(t, v) = i)[1:5], ',') as topics from x""", EVENTS)
def topics(spark, d):
    listed = F.transform(F.array_sort(F.collect_list(F.struct("seq", "name"))), lambda x: x["name"])
    rows = events(spark, d).groupBy("source").agg(listed.alias("t"))
    return rows.select("source", F.array_join(E.topics_of(F.col("t")), ",").alias("topics"))


@query("work_items", """, x as (select source, id, name, seq, row_number() over (partition by source, id order by seq) as rn from ev),
 y as (select *, row_number() over (partition by source order by seq) as n from x where rn = 1) select source, string_agg(concat(id, '=', name), ',' order by seq) as work from y where n <= 5 group by 1""", EVENTS)
def work_items(spark, d):
    item = F.struct("seq", F.col("id"), F.col("name").alias("objective"))
    listed = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["id"].alias("id"), x["objective"].alias("objective")))
    rows = events(spark, d).groupBy("source").agg(listed.alias("w"))
    shown = F.transform(E.work_of(F.col("w")), lambda x: F.concat(x["id"], F.lit("="), x["objective"]))
    return rows.select("source", F.array_join(shown, ",").alias("work"))


@query("source_kinds", """select page_id, case when ext in ('md','markdown','txt','text','csv','tsv','json','yaml','yml','xml','html','htm','log') then 'text'
 when ext in ('pdf','doc','docx','ppt','pptx','xls','xlsx','epub','rtf') then 'convertible' else 'unsupported' end as kind from (select page_id, lower(regexp_extract(url, '\\.([a-z0-9]+)(?:[?#]|$)', 1)) as ext from pages)""")
def source_kinds(spark, d):
    ext = F.regexp_extract("url", "\\.([a-z0-9]+)(?:[?#]|$)", 1)
    return table(spark, d, "pages").select("page_id", store.classify(ext).alias("kind"))


@query("read_heads", "select doc_id, length(substr(text, 1, 1000)) as n, md5(substr(text, 1, 1000)) as mark from documents")
def read_heads(spark, d):
    head = store.read_head(F.col("text"), 1000)
    return table(spark, d, "documents").select("doc_id", F.length(head).alias("n"), F.md5(head).alias("mark"))


@query("document_import", """, b as (select source as owner_id, doc_id as id, concat('p', doc_id) as path, sha1(text) as fingerprint, doc_id as imported_at from documents where doc_id % 3 = 0),
 n0 as (select source as owner_id, doc_id as id, concat('p', doc_id - doc_id % 2) as path, sha1(text) as fingerprint, doc_id + 100000 as imported_at from documents where doc_id % 3 <> 0),
 n as (select * exclude rn from (select *, row_number() over (partition by owner_id, fingerprint order by imported_at desc, id) rn from n0) where rn = 1),
 k as (select * from b where not exists (select 1 from n where n.owner_id = b.owner_id and n.fingerprint = b.fingerprint)
 and not exists (select 1 from n0 where n0.owner_id = b.owner_id and n0.path = b.path)), u as (select * from k union all select * from n)
 select owner_id, id, imported_at from (select *, row_number() over (partition by owner_id order by imported_at desc, id) rn from u) where rn <= 40""")
def document_import(spark, d):
    rows = table(spark, d, "documents")
    held = rows.where("doc_id % 3 = 0").select(
        F.col("source").alias("owner_id"), F.col("doc_id").alias("id"), F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"),
        F.sha1("text").alias("fingerprint"), F.col("doc_id").alias("imported_at"),
    )
    new = rows.where("doc_id % 3 <> 0").select(
        F.col("source").alias("owner_id"), F.col("doc_id").alias("id"),
        F.concat(F.lit("p"), (F.col("doc_id") - F.col("doc_id") % 2).cast("string")).alias("path"),
        F.lit("md").alias("extension"), F.col("text").alias("content"), (F.col("doc_id") + 100_000).alias("imported_at"),
    )
    return store.import_documents(held, new).select("owner_id", "id", "imported_at")


@query("log_tail", """, x as (select concat('f', source % 9) as path, (source % 9) as modified, seq as line, concat('turn', k % 5) as turn_id, time_ms from ev),
 p as (select distinct path, modified from x order by modified desc, path limit 5), y as (select x.* from x join p using (path) where turn_id = 'turn3' order by path, line limit 500)
 select path, line, time_ms from y""", EVENTS)
def log_tail(spark, d):
    rows = events(spark, d).selectExpr(
        "concat('f', source % 9) as path", "source % 9 as modified", "seq as line", "concat('turn', k % 5) as turn_id", "time_ms"
    )
    return store.tail_logs(rows, "turn3").select("path", "line", "time_ms")


@query("log_fields", """select seq, case when regexp_matches(id, '^e[0-9]{2}$') then id end as id, case when regexp_matches(name, '^[a-z]{4,5}$') then name end as name from ev""", EVENTS)
def log_fields(spark, d):
    return events(spark, d).select(
        "seq", F.when(F.col("id").rlike("^e[0-9]{2}$"), F.col("id")).alias("id"), F.when(F.col("name").rlike("^[a-z]{4,5}$"), F.col("name")).alias("name")
    )


@query("bounded_metadata", """select event_id, props as metadata from events""")
def bounded_metadata(spark, d):
    kept = F.map_filter(F.from_json("props", "map<string,string>"), lambda k, v: v.isNotNull() & (F.length(k) <= 80))
    first = F.map_from_entries(F.slice(F.map_entries(kept), 1, 16))
    number = F.transform_values(first, lambda k, v: v.cast("long"))
    return table(spark, d, "events").select("event_id", F.regexp_replace(F.to_json(number), ":", ": ").alias("metadata"))


@query("document_fields", """select doc_id, coalesce(nullif(trim(substr(text, 1, 20)), ''), source) as title, coalesce(lang, source) as tag from documents""")
def document_fields(spark, d):
    title = F.coalesce(F.nullif(F.trim(F.substring("text", 1, 20)), F.lit("")), F.col("source"))
    return table(spark, d, "documents").select("doc_id", title.alias("title"), F.coalesce("lang", "source").alias("tag"))


@query("reserved_envelope", "select conv_id, turn, turn % 3 = 0 as reserved from conversations")
def reserved_envelope(spark, d):
    text = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("  <SYSTEM_EVENT id=1>"), "text")).otherwise(F.concat(F.lit("<systems>"), "text"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.reserved_envelope(text).alias("reserved"))
