"""Ports for knowledge and web search: sets of requests in, rows out.

A provider is an object of a user's own that answers a table of requests with
a table of hits; what crosses the port is checked and bounded here, so that
providers stay small.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.functions import text as T
from tallgrass.operators import web
from tallgrass.operators.retrieval import QUERY_CHARS, chunks, search
from tallgrass.sources.scratch import scratch
from tallgrass.sources.store import import_documents

PROTOCOL_VERSION = 1
KEY = re.compile("[a-z0-9][a-z0-9-]*")
HEALTH = ("ready", "unconfigured", "degraded", "unavailable")
DEFAULT_HITS, MOST_HITS = 5, 8
CONTENT_CHARS, ID_CHARS, TITLE_CHARS, SOURCE_CHARS = 4000, 160, 300, 120
MANAGEMENT = ("ingest", "list", "remove")


def _lacking(provider, methods: tuple[str, ...]) -> list[str]:
    return [m for m in methods if not callable(getattr(provider, m, None))]


def _written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to a folder of the session's own and read again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def described(provider, methods: tuple[str, ...], version: int | None = None) -> dict:
    """A provider's own description, or TypeError where it breaks the port."""
    lacking = _lacking(provider, methods)
    if lacking:
        raise TypeError(f"a provider lacks {', '.join(lacking)}")
    own = provider.describe()
    if not isinstance(own, dict) or not KEY.fullmatch(str(own.get("key") or "")) or not str(own.get("label") or "").strip():
        raise TypeError("a provider's describe() needs a key and a label")
    if version is not None and own.get("protocol_version") != version:
        raise TypeError(f"a provider's describe() needs protocol version {version}")
    given = own.get("capabilities") or {}
    able = {k: v for k, v in given.items() if KEY.fullmatch(k) and isinstance(v, bool)}
    return {"key": own["key"], "label": " ".join(own["label"].split())[:120], "capabilities": able}


def bounded_hits(hits: DataFrame, requests: DataFrame) -> DataFrame:
    """Hits that a request keeps, ranked in the provider's order.

    Of the first 8 to 64 candidates (eight times the limit) stay those with a
    content and an id not seen before; an id that is missing is the source's
    with the hit's rank. ``hits``: request_id, pos, id, content, score,
    source_id, title, url, provider; ``requests``: request_id, top_k.
    """
    place = F.row_number().over(Window.partitionBy("request_id").orderBy("pos"))
    met = hits.join(requests.select("request_id", "top_k"), "request_id").withColumn("_n", place)
    scan = F.greatest(F.lit(8), F.least(F.lit(64), F.col("top_k") * 8))
    hit = F.struct(
        F.col("_n").alias("n"),
        T.clean(F.col("id"), ID_CHARS).alias("id"),
        F.substring(T.trim(F.coalesce("content", F.lit(""))), 1, CONTENT_CHARS).alias("content"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
        T.clean(F.col("source_id"), SOURCE_CHARS).alias("source_id"),
        T.clean(F.col("title"), TITLE_CHARS).alias("title"),
        F.col("url").alias("url"),
        T.clean(F.col("provider"), SOURCE_CHARS).alias("provider"),
    )
    listed = met.where(F.col("_n") <= scan).groupBy("request_id", "top_k").agg(F.array_sort(F.collect_list(hit)).alias("_hits"))
    kind = listed.schema["_hits"].dataType.simpleString()

    def step(kept, h):
        made = F.concat(h["source_id"], F.lit(":"), (F.size(kept) + 1).cast("string"))
        name = F.when(h["id"] != "", h["id"]).when(h["source_id"] != "", made).otherwise("")
        fits = (F.size(kept) < F.col("top_k")) & (name != "") & (h["content"] != "") & ~F.exists(kept, lambda x: x["id"] == name)
        return F.when(fits, F.concat(kept, F.array(h.withField("id", name)))).otherwise(kept)

    kept = F.aggregate("_hits", F.array().cast(kind), step)
    rows = listed.select("request_id", F.posexplode(kept).alias("_p", "_h"))
    rows = rows.select("request_id", (F.col("_p") + 1).alias("rank"), "_h.*").drop("n")
    rows = rows.withColumn("url", web.normalize_url(F.col("url")))
    number = F.count("url").over(Window.partitionBy("request_id").orderBy("rank"))
    return rows.withColumn("citation_id", F.when(F.col("url").isNotNull(), F.concat(F.lit("source_"), number.cast("string"))))


class KnowledgeRuntime:
    """Checked requests to a knowledge provider.

    A provider has ``describe()`` and ``retrieve(requests)``, which returns
    hits as ``bounded_hits`` takes them, and may have ``health()`` and all of
    ``ingest``, ``list`` and ``remove``.
    """

    def __init__(self, provider):
        self.description = described(provider, ("describe", "retrieve"), PROTOCOL_VERSION)
        self.provider = provider

    @property
    def managed(self) -> bool:
        return not _lacking(self.provider, MANAGEMENT)

    def health(self) -> dict:
        own = self.provider.health() if callable(getattr(self.provider, "health", None)) else {}
        status = str(own.get("status") or "ready").strip().lower()
        if status not in HEALTH:
            raise TypeError(f"a provider's health() says {status!r}")
        return {"status": status, "ok": status in ("ready", "degraded"), "message": str(own.get("message") or "")[:500]}

    def search(self, requests: DataFrame) -> DataFrame:
        """(request_id, status, rank, id, content, score, source_id, title,
        url, provider, citation_id): a row per hit, or one without a hit.

        ``requests``: request_id, owner_id, query, top_k. A blank query or
        owner is refused and not passed on; a query is cut to 500 characters,
        and top_k lies between 1 and 8, 5 if it is null or 0.
        """
        query = F.substring(T.trim(F.coalesce("query", F.lit(""))), 1, QUERY_CHARS)
        owner = T.trim(F.coalesce(F.col("owner_id").cast("string"), F.lit("")))
        asked = F.coalesce(F.nullif(F.col("top_k").cast("long"), F.lit(0)), F.lit(DEFAULT_HITS))
        bounded = requests.select(
            "request_id", owner.alias("owner_id"), query.alias("query"), F.least(F.lit(MOST_HITS), F.greatest(F.lit(1), asked)).alias("top_k")
        )
        refused = F.when(F.col("query") == "", "query_required").when(F.col("owner_id") == "", "owner_required")
        states = bounded.withColumn("_refused", refused)
        passed = states.where("_refused is null").drop("_refused")
        hits = bounded_hits(self.provider.retrieve(passed), passed)
        met = states.select("request_id", "_refused").join(hits, "request_id", "left")
        status = F.coalesce("_refused", F.when(F.col("id").isNotNull(), "ok").otherwise("not_found"))
        return met.withColumn("status", status).select("request_id", "status", *[c for c in hits.columns if c != "request_id"])


class LibraryProvider:
    """Knowledge from a library of documents: lexical search over chunks.

    ``library``: owner_id (a string), id (a number, of one document only),
    path, filename, title, extension, content, imported_at, fingerprint. A
    provider doesn't change; ``ingest`` and ``remove`` return another.
    """

    def __init__(self, library: DataFrame, key: str = "local-library", label: str = "Local library"):
        self.library, self.key, self.label = library, key, label

    def describe(self) -> dict:
        able = {"filters": False, "scores": True, "citations": False, "ingestion": True, "management": True}
        return {"protocol_version": PROTOCOL_VERSION, "key": self.key, "label": self.label, "capabilities": able}

    def _with(self, library: DataFrame) -> LibraryProvider:
        return LibraryProvider(library, self.key, self.label)

    def ingest(self, incoming: DataFrame) -> LibraryProvider:
        """With incoming documents (the library's columns less fingerprint)."""
        return self._with(import_documents(self.library, incoming))

    def list(self) -> DataFrame:
        """The projection of documents that clients see."""
        title = T.clean(F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("filename"), F.col("id").cast("string")), TITLE_CHARS)
        return self.library.select("owner_id", "id", title.alias("title"), "filename", F.octet_length("content").alias("bytes"), "imported_at")

    def remove(self, asked: DataFrame) -> tuple[LibraryProvider, DataFrame]:
        """(the rest, ``asked`` with whether each was there)."""
        keys = ["owner_id", "id"]
        there = self.library.select(*keys, F.lit(True).alias("removed"))
        told = asked.join(there, keys, "left").withColumn("removed", F.coalesce("removed", F.lit(False)))
        return self._with(self.library.join(asked.select(*keys), keys, "left_anti")), told

    def retrieve(self, requests: DataFrame) -> DataFrame:
        named = F.concat_ws(" ", "title", "filename")
        docs = self.library.select(F.col("id").alias("doc_id"), "owner_id", named.alias("metadata"), F.col("content").alias("text"))
        asked = requests.select(F.col("request_id").alias("query_id"), "owner_id", "query")
        # a few rows per request, read twice below: found once
        found = _written(search(docs, asked, MOST_HITS, owner="owner_id"), "hits")
        shown = self.library.select(
            F.col("id").alias("doc_id"), F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("filename")).alias("title"), "content"
        ).join(found.select("doc_id").distinct(), "doc_id", "left_semi")
        parts = chunks(shown, ["doc_id", "title"], "content")
        name = F.concat(F.lit("《"), "title", F.lit("》"))
        heading = F.when(F.col("heading") != "", F.concat(F.lit("## "), "heading"))
        return found.join(parts, ["doc_id", "chunk_no"]).select(
            F.col("query_id").alias("request_id"),
            F.col("rank").alias("pos"),
            F.concat_ws(":", "doc_id", "chunk_no").alias("id"),
            F.concat_ws("\n", name, heading, F.nullif(F.col("text"), F.lit(""))).alias("content"),
            "score",
            F.col("doc_id").cast("string").alias("source_id"),
            "title",
            F.lit(None).cast("string").alias("url"),
            F.lit(None).cast("string").alias("provider"),
        )


class WebSearchRuntime:
    """Checked requests to a web search provider, which has ``describe()``,
    ``is_configured()`` and ``search(requests)``; the last returns request_id,
    pos, title, url, snippet, source and published_at."""

    def __init__(self, provider):
        self.description = described(provider, ("describe", "is_configured", "search"))
        if not isinstance(provider.is_configured(), bool):
            raise TypeError("a provider's is_configured() must be a bool")
        self.provider = provider

    def search(self, requests: DataFrame, limit: int = DEFAULT_HITS) -> DataFrame:
        """Results of each request by first public URL, with citation ids."""
        return web.cite_response(self.provider.search(requests), ["request_id"], "pos", limit)


class CapturedPages:
    """Web search over result pages that were fetched before.

    ``pages``: query, page, one for each query; ``kind`` names their markup.
    """

    def __init__(self, pages: DataFrame, kind: str, key: str = "captured-pages", label: str = "Captured pages"):
        self.pages, self.kind, self.key, self.label = pages, kind, key, label

    def describe(self) -> dict:
        return {"key": self.key, "label": self.label}

    def is_configured(self) -> bool:
        return self.kind in web.RESULT_PAGES

    def search(self, requests: DataFrame) -> DataFrame:
        # the parser's expressions are large: what follows is planned without them
        found = _written(web.parse_results(self.pages, "query", "page", self.kind), "results")
        met = requests.select("request_id", "query").join(found, "query").drop("query")
        return met.withColumn("published_at", F.lit(None).cast("string"))
