"""Queries over pages, documents, evidence and traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallgrass.operators import evidence as E
from tallgrass.operators import retrieval as R
from tallgrass.operators import scoring as S
from tallgrass.operators import web as W
from tallgrass.plans.base import EVENTS, events, query, table

#: A page's text without Python: numeric references stay.
_TEXT = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'),
 '(?is)<(?:script|style|noscript|svg)\b[^>]*>.*?</(?:script|style|noscript|svg)>', ' ', 'g'), '(?i)<(?:br|hr)\b[^>]*>', chr(10), 'g'),
 '(?i)</(?:p|div|section|article|header|footer|main|li|h[1-6])>', chr(10), 'g'), '<[^>]*>', ' ', 'g')"""
_DECODE = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(?i)&apos;', '''', 'g'), '(?i)&gt;', '>', 'g'), '(?i)&lt;', '<', 'g'), '(?i)&nbsp;', ' ', 'g'), '(?i)&quot;', '\"', 'g'), '(?i)&amp;', '&', 'g')"


@query("html_title", "select page_id, substr(trim(regexp_replace(" + _DECODE.format(r"regexp_replace(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1), '<[^>]*>', ' ', 'g')") + r", '\s+', ' ', 'g')), 1, 300) as title from pages")
def html_title(spark, d):
    return table(spark, d, "pages").select("page_id", W.html_title(F.col("html")).alias("title"))


@query("html_text", "select page_id, md5(regexp_replace(regexp_replace(regexp_replace(" + _DECODE.format(_TEXT) + r", '[ \t]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g'), '^\s+|\s+$', '', 'g')) as mark from pages")
def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(W.html_text(F.col("html"))).alias("mark"))


_URL = r"""case when regexp_matches({0}, '(?i)^https?://[^/?#@\s]+') then concat(lower(regexp_extract({0}, '(?i)^(https?://[^/?#]+)', 1)),
 case when regexp_extract({0}, '(?i)^https?://[^/?#]+([^?#]*)', 1) = '' then '/' else regexp_extract({0}, '(?i)^https?://[^/?#]+([^?#]*)', 1) end,
 regexp_extract({0}, '(?i)^https?://[^/?#]+[^?#]*(\?[^#]*)?', 1)) end"""


#: URLs that need more than lower case: (what stands before and after the page
#: number, the URL that browsers write before and after it; null if none).
_HARD_URLS = (
    (" HTTPS://X.org:443/a/../b/./", "#f", "https://x.org/b/", ""),
    ("https://münchen.de/é/", "?q=a b'c", "https://xn--mnchen-3ya.de/%C3%A9/", "?q=a%20b%27c"),
    ("https://user:pass@x.org/", "", None, ""),
    ("http://0x7f.1:8080\\\\p\\\\", "", "http://127.0.0.1:8080/p/", ""),
    ("https:x.org/%2E%2e/", "?", "https://x.org/", "?"),
    ("ftp://x.org/", "", None, ""),
)


def _hard_url(columns: tuple[int, int]) -> str:
    def text(x):
        return "null" if x is None else "'" + x.replace("'", "''").replace("\\\\", "\\") + "'"

    a, b = columns
    return "case page_id % 6 " + " ".join(f"when {i} then {text(u[a])} || page_id || {text(u[b])}" for i, u in enumerate(_HARD_URLS)) + " end"


@query("url_normalize", "select page_id, " + _URL.format("url") + f" as url, {_hard_url((2, 3))} as hard from pages")
def url_normalize(spark, d):
    number = F.col("page_id").cast("string")
    hard = F.lit(None).cast("string")
    for i, (before, after, _, _) in enumerate(_HARD_URLS):
        made = F.concat(F.lit(before.replace("\\\\", "\\")), number, F.lit(after))
        hard = F.when(F.col("page_id") % 6 == i, made).otherwise(hard)
    return table(spark, d, "pages").select("page_id", W.normalize_url(F.col("url")).alias("url"), W.normalize_url(hard).alias("hard"))


@query("cited_responses", ", x as (select page_id % 25 as response, page_id as pos, " + _URL.format("url") + """ as url from pages),
 f as (select response, url, min(pos) as pos from x where url is not null group by 1, 2), n as (select *, row_number() over (partition by response order by pos) as number from f)
 select response, url, number, concat('source_', number) as citation_id from n where number <= 5""")
def cited_responses(spark, d):
    rows = table(spark, d, "pages").select(
        (F.col("page_id") % 25).alias("response"), F.col("page_id").alias("pos"), "url", F.lit("a title").alias("title"),
        F.lit("").alias("snippet"), F.lit("").alias("source"), F.lit("").alias("published_at"),
    )
    return W.cite_response(rows, ["response"], "pos", 5).select("response", "url", "number", "citation_id")


@query("citation_join", ", x as (select page_id % 20 as turn_id, page_id as pos, " + _URL.format("url") + """ as url from pages), f as (select turn_id, url, min(pos) as pos from x where pos % 2 = 0 group by 1, 2),
 c as (select turn_id, url, concat('source_', row_number() over (partition by turn_id order by pos, url)) as citation_id, row_number() over (partition by turn_id order by pos, url) as n from f)
 select x.turn_id, x.pos, case when x.pos % 7 = 0 then null else citation_id end as citation_id from x left join (select * from c where n <= 16) c on c.turn_id = x.turn_id and c.url = x.url where citation_id is not null or x.pos % 7 = 0""")
def citation_join(spark, d):
    rows = table(spark, d, "pages").select((F.col("page_id") % 20).alias("turn_id"), F.col("page_id").alias("pos"), "url")
    cited = W.cite_turn(rows.where("pos % 2 = 0"))
    shown = rows.withColumn("url", F.when(F.col("pos") % 7 == 0, "").otherwise(F.col("url")))
    return W.join_citations(shown, cited).select("turn_id", "pos", "citation_id")


@query("citation_lines", ", x as (select page_id % 20 as turn_id, page_id as pos, url, concat('T', page_id) as title from pages), f as (select * from (select *, row_number() over (partition by turn_id, url order by pos) r from x) where r = 1), n as (select *, row_number() over (partition by turn_id order by pos, url) as n from f) select turn_id, string_agg(concat('[', n, '] ', title, ' ', url), chr(10) order by n) as lines from n where n <= 16 group by 1")
def citation_lines(spark, d):
    rows = table(spark, d, "pages").select(
        (F.col("page_id") % 20).alias("turn_id"), F.col("page_id").alias("pos"), "url", F.concat(F.lit("T"), F.col("page_id").cast("string")).alias("title")
    )
    return W.citation_lines(rows)


@query("link_harvest", """, x as (select page_id, concat('see [a](', url, '), then ', url, '. And http://x.example/', page_id % 5, '!') as t from pages)
 select page_id, cast(0 as bigint) as pos, url from pages union all select page_id, 1, concat('http://x.example/', page_id % 5) from pages""")
def link_harvest(spark, d):
    text = F.concat(F.lit("see [a]("), "url", F.lit("), then "), "url", F.lit(". And http://x.example/"), (F.col("page_id") % 5).cast("string"), F.lit("!"))
    return W.harvest_links(table(spark, d, "pages").select("page_id", text.alias("t")), "page_id", "t")


def _result_page(spark, d, blocks: list[str], kind: str):
    """A result page per page, with its number for each @ of the blocks."""
    number = F.col("page_id").cast("string")
    page = F.concat(F.lit("<ol>"), *[x for p in "".join(blocks).split("@") for x in (F.lit(p), number)][:-1], F.lit("</ol>"))
    return W.parse_results(table(spark, d, "pages").select("page_id", page.alias("p")), "page_id", "p", kind)


#: Marked terms inside words, a paragraph before the caption, entities twice and
#: out of range, either quote, a repeated URL, credentials, a heading without link.
_MARKED_BLOCKS = [
    """<li class="x b_algo y"><h2 class=t><a target=_blank href="https://R0.example:443/a/../@?x=1&amp;y=2#f">Key<strong>word</strong>s <i>&amp;lt;</i> &#9999999999;</a></h2><p>menu</p><div class="b_caption"><p class=c>about&ensp;the <strong>k</strong>ey</p></div></li>""",
    """<li id=2 class='b_algo'><h2><a href='https://r1.example/@'>Two &#x41;&#38;#x42;</a></h2><p>no caption</p></li>""",
    """<li class="b_algo"><h2><a href="https://r1.example/@">Again</a></h2></li>""",
    """<li class="b_algo"><h2><a href="https://u:p@r2.example/">Hidden</a></h2></li>""".replace("@", "&#64;"),
    """<li class="b_algo"><h2>No link</h2></li>""",
    """<li class="other"><h2><a href="https://r3.example/@">Other</a></h2></li>""",
]


@query("search_page_results", """select page_id, cast(0 as bigint) as pos, concat('https://r0.example/', page_id, '?x=1&y=2#f') as url, concat('Keywords < ', chr(65533)) as title, 'about the key' as snippet, 'r0.example' as source from pages
 union all select page_id, 1, concat('https://r1.example/', page_id), 'Two AB', null, 'r1.example' from pages""")
def search_page_results(spark, d):
    return _result_page(spark, d, _MARKED_BLOCKS, "b_algo")


#: The real address beside a redirect in either order, terms marked in words,
#: links outside the heading, single quotes, a heading without title.
_PORTAL_BLOCKS = [
    """<li class="res-list" data-x=1><a href="https://ad.example/">ad</a><h3 class="res-title "><a data-mdurl="https://real.example/@" href="https://www.portal.example/link?u=1">A <em>te</em>rm</a></h3><p class="m res-desc">to<em>ld</em> &middot; it</p></li>""",
    """<li class='res-list'><h3 class='res-title'><a href='https://www.portal.example/link?u=2' data-mdurl='https://late.example/@'>B</a></h3></li>""",
    """<li class="res-list"><h3 class="res-title"><a href="https://plain.example/@">C</a></h3><p>not this</p></li>""",
    """<li class="res-list"><h3 class="res-title"><a href="https://empty.example/@"> <em></em> </a></h3></li>""",
]


@query("portal_page_results", """select page_id, cast(0 as bigint) as pos, concat('https://real.example/', page_id) as url, 'A term' as title, 'told · it' as snippet, 'real.example' as source from pages
 union all select page_id, 1, concat('https://late.example/', page_id), 'B', null, 'late.example' from pages
 union all select page_id, 2, concat('https://plain.example/', page_id), 'C', null, 'plain.example' from pages""")
def portal_page_results(spark, d):
    return _result_page(spark, d, _PORTAL_BLOCKS, "res-list")


#: Responses of four shapes, @ for the event's number: a key of its own, a nested
#: one, one nested after an empty one, and none that is known.
_RESPONSES = (
    '{"meta":1,"items":[{"link":" https://a/@ ","name":"n","text":"t@","siteName":"s"},{"title":"no url"}]}',
    '{"result":{"search_results":[{"url":"","href":"https://b/@","title":"","name":"m","description":"d","content":"c","published_date":"2024","domain":"dom"}]}}',
    '{"data":{"results":[],"web":[{"url":"https://no/"}]},"web":{"data":{"pages":[{"url":"https://c/@","title":"T","snippet":"s","source":"x","date":"y"}]}}}',
    '{"organic":[{"url":"https://no/"}],"webPages":{"value":[{"url":"https://no/"}]}}',
)


@query("json_results", """select event_id, cast(0 as bigint) as pos, case event_id % 4 when 0 then 'https://a/' when 1 then 'https://b/' else 'https://c/' end || event_id as url,
 case event_id % 4 when 0 then 'n' when 1 then 'm' else 'T' end as title, case event_id % 4 when 0 then 't' || event_id when 1 then 'd' else 's' end as snippet,
 case event_id % 4 when 1 then '2024' when 2 then 'y' end as published_at, case event_id % 4 when 0 then 's' when 1 then 'dom' else 'x' end as source from events where event_id % 4 < 3""")
def json_results(spark, d):
    body = F.get(F.array(*[F.lit(x) for x in _RESPONSES]), (F.col("event_id") % 4).cast("int"))
    rows = table(spark, d, "events").select("event_id", F.replace(body, F.lit("@"), F.col("event_id").cast("string")).alias("b"))
    return W.json_results(rows, "event_id", "b")


@query("normalized_hits", """, x as (select source as query_id, seq as pos, id, name as content, row_number() over (partition by source order by seq) n from ev),
 f as (select *, row_number() over (partition by query_id, id order by pos) r from x where n <= 40), g as (select *, row_number() over (partition by query_id order by pos) as rank from f where r = 1)
 select query_id, pos, id, rank from g where rank <= 5""", EVENTS)
def normalized_hits(spark, d):
    rows = events(spark, d).selectExpr("source as query_id", "seq as pos", "id", "name as content")
    return R.normalize_hits(rows, 5).select("query_id", "pos", "id", "rank")


_EDGES = r"'^[\s\x{0B}\x{A0}]+|[\s\x{0B}\x{A0}]+$', '', 'g'"
_CHUNKS = rf"""recursive , x as (select doc_id, i as rn, l[i] as line from (select doc_id, string_split_regex(substr(text, 1, 240000), '\r?\n') as l from documents), lateral unnest(range(1, len(l) + 1)) as t(i)),
 r as (select doc_id, cast(0 as bigint) as rn, '' as heading, '' as body, '' as oh, '' as ot from documents union all
 select doc_id, rn, case when title then regexp_replace(regexp_extract(line, '^#{{1,6}}\s+(.+)$', 1), {_EDGES}) else heading end, case when title then '' when over then added else concat(body, added) end,
 case when title or over then heading else '' end, case when title or over then regexp_replace(body, {_EDGES}) else '' end from (select x.doc_id, x.rn, x.line, r.heading, r.body, regexp_matches(x.line, '^#{{1,6}}\s+.+$') as title,
 case when r.body = '' then x.line else concat(chr(10), x.line) end as added, length(r.body) + length(case when r.body = '' then x.line else concat(chr(10), x.line) end) > 1600 and regexp_replace(r.body, {_EDGES}) <> '' as over
 from r join x on x.doc_id = r.doc_id and x.rn = r.rn + 1)),
 o as (select doc_id, rn, oh as heading, ot as t from r where ot <> '' union all select doc_id, 1000000000, heading, regexp_replace(body, {_EDGES}) from (select *, row_number() over (partition by doc_id order by rn desc) as b from r) where b = 1),
 p as (select doc_id, rn, j, heading, substr(t, cast(j * 1600 + 1 as bigint), 1600) as text from o, lateral unnest(range(0, cast(ceil(length(t) / 1600.0) as bigint))) as u(j) where t <> '')
 select doc_id, row_number() over (partition by doc_id order by rn, j) as chunk_no, heading, text from p"""


@query("chunk_documents", _CHUNKS)
def chunk_documents(spark, d):
    return R.chunks(table(spark, d, "documents"), ["doc_id"], "text")


@query("lexical_topk")
def lexical_topk(spark, d):
    docs = table(spark, d, "documents")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return R.search(docs.select("doc_id", F.col("source").alias("metadata"), "text"), asked, 5)


@query("name_match", """, r as (select distinct c_custkey as request_id, cast(c_nationkey as bigint) as owner_id, lower(c_name) as k from customer),
 n as (select cast(s_nationkey as bigint) as owner_id, concat('customer#', lpad(cast(s_suppkey as varchar), 4, '0')) as name from supplier),
 rk as (select request_id, owner_id, regexp_replace(k, '[^\\p{L}\\p{N}]+', '', 'g') as k from r), nk as (select owner_id, name, regexp_replace(name, '[^\\p{L}\\p{N}]+', '', 'g') as nk from n),
 m as (select request_id, count(*) filter (k = nk) as exact, min(name) filter (k = nk) as en, count(*) as near, min(name) as nn from rk join nk on rk.owner_id = nk.owner_id and (contains(k, nk) or contains(nk, k)) group by 1)
 select rk.request_id, case when exact >= 1 then en when near = 1 then nn end as name, case when (case when exact >= 1 then en when near = 1 then nn end) is not null then 'found' when near > 1 then 'ambiguous' else 'missing' end as state from rk left join m using (request_id)""")
def name_match(spark, d):
    asked = table(spark, d, "customer").selectExpr("c_custkey as request_id", "cast(c_nationkey as bigint) as owner_id", "c_name as wanted")
    names = table(spark, d, "supplier").selectExpr("cast(s_nationkey as bigint) as owner_id", "concat('customer#', lpad(cast(s_suppkey as string), 4, '0')) as name")
    return R.match_names(asked, names)


@query("chunk_references", "select e.seq, p.page_id from ev e left join (select distinct page_id from pages where page_id % 2 = 0) p on p.page_id = e.k", EVENTS)
def chunk_references(spark, d):
    refs = table(spark, d, "pages").where("page_id % 2 = 0").select("page_id").distinct()
    rows = events(spark, d).select("seq", "k")
    return rows.join(refs, rows["k"] == refs["page_id"], "left").select("seq", "page_id")


# evidence

_FIELD = "case name when 'click' then 'occupation' when 'view' then 'response_style' when 'signup' then 'response_length' else 'special_skills' end"


def observations(spark, d):
    return events(spark, d).selectExpr(
        "concat('o', source % 10) as owner_id", "concat('s', source) as session_id",
        f"{_FIELD} as field", "concat('v', k % 9) as value",
        "case when k % 11 = 0 then 'refine' when k % 13 = 0 then 'contradict' end as relation", "time_ms as at", "seq",
    )


OBSERVED = f"ob as (select concat('o', source % 10) as owner_id, concat('s', source) as session_id, {_FIELD} as field, concat('v', k % 9) as value, time_ms as tm, seq, k from ev)"

#: The fold of single-value fields, one observation at a time.
_SLOTS = f"""recursive , {OBSERVED}, x as (select *, case when k % 11 = 0 then 'refine' when k % 13 = 0 then 'contradict' end as relation, row_number() over (partition by owner_id, field order by seq) as rn from ob where field <> 'special_skills'),
 r as (select owner_id, field, rn, value, 1 as confirm, [session_id] as sessions, tm as first_at, tm as last_at from x where rn = 1 union all
 select x.owner_id, x.field, x.rn, case when l = 'same' then r.value else x.value end, case when l = 'contradict' then 1 when stale then 1 else r.confirm + 1 end,
 case when l = 'contradict' or stale then [x.session_id] when list_contains(r.sessions, x.session_id) then r.sessions else list_append(r.sessions, x.session_id) end,
 case when l = 'contradict' then x.tm else r.first_at end, x.tm from (select r.*, coalesce(x.relation, case when x.value = r.value then 'same' else 'contradict' end) as l, x.tm - r.last_at > 7776000000 as stale
 from r join x on x.owner_id = r.owner_id and x.field = r.field and x.rn = r.rn + 1) r join x on x.owner_id = r.owner_id and x.field = r.field and x.rn = r.rn + 1),
 f as (select *, row_number() over (partition by owner_id, field order by rn desc) as b from r)
 select owner_id, field, value, cast(confirm as bigint) as confirm, len(sessions) as sessions, first_at, last_at, 'tentative' as state from f where b = 1"""


@query("evidence_fold", _SLOTS, EVENTS)
def evidence_fold(spark, d):
    return E.fold_evidence(observations(spark, d).where("field <> 'special_skills'"))


@query("evidence_lists")
def evidence_lists(spark, d):
    return E.fold_evidence(observations(spark, d).where("field = 'special_skills'"))


_PLAIN = f", {OBSERVED}, sl as (select owner_id, field, value, count(*) as confirm, count(distinct session_id) as sessions, max(tm) as last_at from ob group by 1, 2, 3)"


@query("promotion_gate", _PLAIN + " select owner_id, field, value, array_to_string(list_filter([case when confirm < 2 then 'confirm' end, case when sessions < 2 then 'sessions' end], lambda x: x is not null), ',') as missing from sl", EVENTS)
def promotion_gate(spark, d):
    slots = E.plain_evidence(observations(spark, d))
    return slots.select("owner_id", "field", "value", F.array_join(E.missing(F.col("confirm"), F.col("sessions")), ",").alias("missing"))


@query("promotable_slots", _PLAIN + " select owner_id, field, value, sessions from sl where confirm >= 2 and sessions >= 2", EVENTS)
def promotable_slots(spark, d):
    slots = E.plain_evidence(observations(spark, d))
    return slots.where(E.ready(F.col("confirm"), F.col("sessions"))).select("owner_id", "field", "value", "sessions")


@query("slot_counts", f", {OBSERVED}, s as (select owner_id, case when k % 5 = 0 then 'active' when k % 7 = 0 then 'rejected' else 'tentative' end as state from ob) select owner_id, count(*) filter (state = 'tentative') as tentative, count(*) filter (state = 'active') as active, count(*) filter (state = 'rejected') as rejected, count(*) as total from s group by 1", EVENTS)
def slot_counts(spark, d):
    rows = events(spark, d).selectExpr("concat('o', source % 10) as owner_id", "case when k % 5 = 0 then 'active' when k % 7 = 0 then 'rejected' else 'tentative' end as state")
    return E.state_counts(rows)


@query("slot_diagnosis", _PLAIN + ", fd as (select unnest(['occupation', 'response_style', 'response_length', 'special_skills', 'home_town']) as field) select fd.field, coalesce(max(confirm), 0) as confirm, coalesce(max(sessions), 0) as sessions, count(confirm) as slots, count(confirm) = 0 as never_observed from fd left join sl using (field) group by 1", EVENTS)
def slot_diagnosis(spark, d):
    fields = spark.createDataFrame([(x,) for x in ("occupation", "response_style", "response_length", "special_skills", "home_town")], "field string")
    return E.diagnosis(E.plain_evidence(observations(spark, d)), fields)


@query("slot_order", _PLAIN + " select owner_id, field, value, row_number() over (partition by owner_id order by confirm desc, last_at desc, field, value) as rank from sl", EVENTS)
def slot_order(spark, d):
    return E.slot_order(E.plain_evidence(observations(spark, d))).select("owner_id", "field", "value", "rank")


@query("label_slots", f", {OBSERVED}, s as (select owner_id, lower(value) as l, max(seq) as slot_id from ob where k % 2 = 0 group by 1, 2) select o.owner_id, o.seq, slot_id from ob o left join s on s.owner_id = o.owner_id and s.l = lower(o.value) where o.k % 5 = 0", EVENTS)
def label_slots(spark, d):
    rows = observations(spark, d).join(events(spark, d).select("seq", "k"), "seq")
    slots = rows.where("k % 2 = 0").selectExpr("owner_id", "upper(value) as label", "seq as slot_id", "seq as pos")
    return E.labelled(rows.where("k % 5 = 0").selectExpr("owner_id", "value as label", "seq"), slots).select("owner_id", "seq", "slot_id")


@query("digest_search", """, g as (select concat('o', source % 10) as owner_id, seq as session_id, time_ms as tm, case when name = 'click' then 0 when k % 10 = 0 then 1 when id = 'e7' then 2 end as rank from ev)
 select owner_id, session_id, cast(rank as bigint) as rank, place from (select *, row_number() over (partition by owner_id order by rank, tm desc, session_id) as place from g where rank is not null) where place <= 5""", EVENTS)
def digest_search(spark, d):
    rows = events(spark, d).select(
        F.concat(F.lit("o"), (F.col("source") % 10).cast("string")).alias("owner_id"), F.col("seq").alias("session_id"), F.col("time_ms").alias("at"),
        F.array(F.when(F.col("name") == "click", "My CLICK!").otherwise("x")).alias("topics"),
        F.array(F.when(F.col("k") % 10 == 0, "a click job").otherwise("y")).alias("work"),
        F.when(F.col("id") == "e7", "about Click.").otherwise("z").alias("gist"),
    )
    return E.search_digests(rows, "click", 5).select("owner_id", "session_id", "rank", "place")


# traces

_TOOLS = ("vehicle_window_control", "music_play", "navigation_route", "weather")


def traces(spark, d):
    """A case per source: events are calls, some dropped, some with other
    arguments."""
    name = F.array(*[F.lit(x) for x in _TOOLS])
    rows = events(spark, d).withColumn("tool", F.get(name, (F.col("k") % 4).cast("int")))

    def call(turn):
        args = F.struct(F.lit("front").alias("side"), (F.col("k") % 3).alias("level"))
        return F.struct("seq", F.struct(turn.alias("turn_index"), F.lit("/").alias("path"), F.col("tool").alias("name"), args.alias("arguments")).alias("call"))

    def listed(keep, turn):
        items = F.array_sort(F.collect_list(F.when(keep, call(turn))))
        return F.to_json(F.transform(items, lambda x: x["call"]))

    return rows.groupBy(F.concat(F.lit("c"), F.col("source").cast("string")).alias("case_id")).agg(
        listed(F.col("k") % 7 != 0, F.lit(0)).alias("expected"), listed(F.col("k") % 5 != 0, F.when(F.col("k") % 2 == 0, 0).otherwise(1)).alias("actual")
    )


@query("align_calls")
def align_calls(spark, d):
    return S.align_calls(traces(spark, d))


@query("positional_pairs")
def positional_pairs(spark, d):
    return S.positional(traces(spark, d))


@query("missing_calls")
def missing_calls(spark, d):
    aligned = S.align_calls(traces(spark, d))
    return aligned.where("expected_index is null or actual_index is null").groupBy("case_id").agg(
        F.count_if(F.col("actual_index").isNull()).alias("missing"), F.count_if(F.col("expected_index").isNull()).alias("extra")
    )


@query("counts_by_domain", """select case k % 4 when 0 then 'vehicle' when 1 then 'music' when 2 then 'navigation' else 'weather' end as domain, count(*) as calls from ev group by 1""", EVENTS)
def counts_by_domain(spark, d):
    name = F.array(*[F.lit(x) for x in _TOOLS])
    return S.counts_by_domain(events(spark, d).select(F.get(name, (F.col("k") % 4).cast("int")).alias("name")))


@query("score_summary", """, s as (select name as domain, k % 9 as expected_calls, k % 10 as actual_calls, k % 3 as checkpoints, case when k % 2 = 0 then k % 3 else 0 end as checkpoints_passed, k % 4 <> 0 as passed, k % 6 <> 0 as state, k % 9 - k % 2 as tool_selection from ev)
 select domain, cast(grouping(domain) as bigint) as overall, count(*) as cases, cast(sum(expected_calls) as bigint) as expected_calls, cast(sum(actual_calls) as bigint) as actual_calls, count(*) filter (passed) / greatest(count(*), 1) as passed_rate,
 count(*) filter (state) / greatest(count(*), 1) as state_rate, sum(tool_selection) / greatest(sum(expected_calls), 1) as tool_selection_accuracy, case when sum(checkpoints) > 0 then sum(checkpoints_passed) / sum(checkpoints) end as checkpoint_rate from s group by grouping sets ((domain), ())""", EVENTS)
def score_summary(spark, d):
    rows = events(spark, d).selectExpr(
        "name as domain", "k % 9 as expected_calls", "k % 10 as actual_calls", "k % 3 as checkpoints", "if(k % 2 = 0, k % 3, 0) as checkpoints_passed",
        "k % 4 <> 0 as passed", "k % 6 <> 0 as state", "k % 9 - k % 2 as tool_selection",
    )
    return S.summary(rows, ["passed", "state"], ["tool_selection"])


@query("deep_subset", "select seq, k % 3 <> 0 as matches from ev", EVENTS)
def deep_subset(spark, d):
    from tallgrass.functions.scalars import json_subset

    want = F.concat(F.lit('{"a":['), F.col("k").cast("string"), F.lit("]}"))
    have = F.concat(F.lit('{"b":1,"a":['), (F.col("k") + F.when(F.col("k") % 3 == 0, 1).otherwise(0)).cast("string"), F.lit(",2]}"))
    return events(spark, d).select("seq", json_subset(want, have).alias("matches"))


@query("state_assertions", "select seq, k % 2 = 0 as matches from ev", EVENTS)
def state_assertions(spark, d):
    state = F.concat(F.lit('{"car":{"doors":[{"open":'), F.when(F.col("k") % 2 == 0, "true").otherwise("false"), F.lit("}]}}"))
    return events(spark, d).select("seq", S.state_matches(F.lit('{"car.doors[0].open":true}'), state).alias("matches"))


@query("checkpoint_states", """select concat('c', source) as case_id, k as turn_index, count(*) > 0 as matched from ev where name = 'click' group by 1, 2 union all select 'c-none', 0, false""", EVENTS)
def checkpoint_states(spark, d):
    rows = events(spark, d).where("name = 'click'").selectExpr("concat('c', source) as case_id", "k as turn_index", "seq as pos", "'{\"x\":1}' as state")
    wanted = rows.select("case_id", "turn_index").distinct().unionByName(spark.createDataFrame([("c-none", 0)], "case_id string, turn_index long"))
    return S.checkpoints(wanted.withColumn("expected_state", F.lit('{"x":1}')), rows).select("case_id", "turn_index", "matched")


@query("case_violations", """select concat('c', seq) as case_id, 'unknown_domain' as rule from ev where k % 4 = 0 union all select concat('c', seq), 'turn_out_of_range' from ev where k % 5 = 0""", EVENTS)
def case_violations(spark, d):
    rows = events(spark, d).select(
        F.concat(F.lit("c"), F.col("seq").cast("string")).alias("case_id"), F.when(F.col("k") % 4 == 0, "boat").otherwise("music").alias("domain"),
        F.lit('["a","b"]').alias("turns"), F.when(F.col("k") % 5 == 0, '[{"turn_index":2,"name":"n"}]').otherwise('[{"turn_index":1,"name":"n"}]').alias("expected"),
    )
    return S.case_violations(rows)
