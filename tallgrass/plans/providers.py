"""Queries through the knowledge and web search ports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallgrass.plans.base import EVENTS, events, query, table
from tallgrass.sources.providers import CapturedPages, KnowledgeRuntime, LibraryProvider, WebSearchRuntime


class _EventHits:
    """Hits of requests from the events of a source."""

    def __init__(self, rows):
        self.rows = rows

    def describe(self):
        return {"protocol_version": 1, "key": "event-hits", "label": "Event hits"}

    def retrieve(self, requests):
        content = F.when(F.col("k") % 6 == 0, " ").otherwise(F.concat(F.lit(" "), "name", F.lit("\n")))
        url = F.when(F.col("k") % 4 == 1, F.concat(F.lit("HTTPS://K.example:443/"), F.col("k").cast("string")))
        hits = self.rows.select(
            F.col("source").alias("request_id"), F.col("seq").alias("pos"), "id", content.alias("content"), F.col("value").alias("score"),
            F.lit(None).cast("string").alias("source_id"), F.col("name").alias("title"), url.alias("url"), F.lit("p").alias("provider"),
        )
        return hits.join(requests.select("request_id"), "request_id", "left_semi")


_ANSWERS = """, q as (select distinct source as request_id, case when source % 5 = 0 then 'query_required' when source % 7 = 0 then 'owner_required' end as refused,
 least(8, greatest(1, case when source % 11 = 0 then 5 else source % 11 end)) as top_k from ev),
 x as (select ev.*, q.request_id, q.top_k, row_number() over (partition by source order by seq) as n from ev join q on q.request_id = ev.source where refused is null),
 f as (select *, row_number() over (partition by request_id, id order by seq) as r from x where n <= greatest(8, least(64, top_k * 8)) and k % 6 <> 0),
 g as (select *, row_number() over (partition by request_id order by seq) as rank from f where r = 1),
 h as (select *, case when k % 4 = 1 then concat('https://k.example/', k) end as url from g where rank <= top_k),
 c as (select *, case when url is not null then concat('source_', count(url) over (partition by request_id order by rank)) end as citation_id from h)
 select q.request_id, coalesce(refused, case when c.id is null then 'not_found' else 'ok' end) as status, rank, c.id, c.name as content, c.url, c.citation_id
 from q left join c on c.request_id = q.request_id"""


@query("knowledge_answers", _ANSWERS, EVENTS)
def knowledge_answers(spark, d):
    rows = events(spark, d)
    requests = rows.select(F.col("source").alias("request_id")).distinct().select(
        "request_id",
        F.expr("if(request_id % 7 = 0, ' ', 'owner')").alias("owner_id"),
        F.expr("if(request_id % 5 = 0, '\\n', 'what')").alias("query"),
        (F.col("request_id") % 11).alias("top_k"),
    )
    found = KnowledgeRuntime(_EventHits(rows)).search(requests)
    return found.select("request_id", "status", "rank", "id", "content", "url", "citation_id")


def _library(spark, d):
    return table(spark, d, "documents").select(
        F.coalesce("source", F.lit("-")).alias("owner_id"), F.col("doc_id").alias("id"), F.concat(F.lit("p"), F.col("doc_id")).alias("path"),
        F.concat(F.lit("doc"), F.col("doc_id"), F.lit(".md")).alias("filename"), F.expr("if(doc_id % 2 = 0, '', concat(' Title  ', doc_id))").alias("title"),
        F.lit("md").alias("extension"), F.col("text").alias("content"), F.col("doc_id").alias("imported_at"), F.sha1("text").alias("fingerprint"),
    )


@query("library_documents", """select source as owner_id, doc_id as id, case when doc_id % 2 = 0 then concat('doc', doc_id, '.md') else concat('Title ', doc_id) end as title,
 concat('doc', doc_id, '.md') as filename, octet_length(encode(text)) as bytes, doc_id as imported_at from documents where doc_id % 10 <> 0""")
def library_documents(spark, d):
    library = LibraryProvider(_library(spark, d))
    rest, _ = library.remove(library.library.where("id % 10 = 0").select("owner_id", "id"))
    return rest.list()


@query("library_removals", "select source as owner_id, doc_id + doc_id % 2 * 1000000 as id, doc_id % 2 = 0 as removed from documents where doc_id % 10 < 2")
def library_removals(spark, d):
    library = LibraryProvider(_library(spark, d))
    asked = library.library.where("id % 10 < 2").selectExpr("owner_id", "id + id % 2 * 1000000 as id")
    return library.remove(asked)[1]


@query("knowledge_search")
def knowledge_search(spark, d):
    library = _library(spark, d)
    owners = library.select(F.col("id").alias("item_id"), "owner_id")
    asked = table(spark, d, "benchmark").join(owners, "item_id").select(
        F.col("item_id").alias("request_id"), "owner_id", F.col("text").alias("query"), F.lit(3).alias("top_k")
    )
    return KnowledgeRuntime(LibraryProvider(library)).search(asked)


_PAGE = """<ol><li class="b_algo"><h2><a href="https://r.example/@#f">Of @</a></h2><div class="b_caption"><p>about @</p></div></li>
<li class="b_algo"><h2><a href="https://r.example/@">Again</a></h2></li><li class="b_algo"><h2><a href="https://s.example/">S</a></h2></li></ol>"""


@query("web_search", """select c_custkey as request_id, cast(1 as bigint) as number, 'source_1' as citation_id, concat('https://r.example/', c_nationkey) as url, concat('Of ', c_nationkey) as title, concat('about ', c_nationkey) as snippet from customer
 union all select c_custkey, 2, 'source_2', 'https://s.example/', 'S', '' from customer""")
def web_search(spark, d):
    nation = F.col("n_nationkey").cast("string")
    pages = table(spark, d, "nation").select(nation.alias("query"), F.replace(F.lit(_PAGE), F.lit("@"), nation).alias("page"))
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("request_id"), F.col("c_nationkey").cast("string").alias("query"))
    found = WebSearchRuntime(CapturedPages(pages, "b_algo")).search(asked)
    return found.select("request_id", "number", "citation_id", "url", "title", "snippet")
