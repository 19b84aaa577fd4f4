"""Document chunks and lexical retrieval."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.functions import text as T
from tallgrass.functions.let import let

CHUNK_CHARS, SCAN_CHARS, QUERY_CHARS = 1600, 240_000, 500
#: Queries that a task scores at a time.
QUERY_BLOCK = 5000
#: Score of an exact query in the metadata or the text, and of each term.
EXACT_META, EXACT_TEXT, TERM_META, TERM_TEXT = 80, 60, 12, 8


def chunk_array(markdown: Column, n: int = CHUNK_CHARS) -> Column:
    """array<struct<heading, text>>: heading lines cut and aren't text; a chunk
    closes before the line that would pass n characters; longer ones are cut."""
    lines = F.split(F.coalesce(markdown, F.lit("")), "\r?\n")
    none = F.array().cast("array<struct<heading:string,text:string>>")

    def flushed(acc: Column) -> Column:
        def cut(body: Column) -> Column:
            parts = F.transform(
                F.sequence(F.lit(0), F.floor((F.length(body) - 1) / n).cast("int")),
                lambda i: F.struct(acc["heading"].alias("heading"), F.substring(body, i * n + 1, F.lit(n)).alias("text")),
            )
            return F.when(F.length(body) > 0, F.concat(acc["chunks"], parts)).otherwise(acc["chunks"])

        # (an open chunk without anything but white space needs no trimming)
        return F.when(acc["solid"], let(T.trim(acc["body"]), cut)).otherwise(acc["chunks"])

    def step(acc: Column, line: Column) -> Column:
        added = F.when(acc["size"] == 0, line).otherwise(F.concat(F.lit("\n"), line))
        size = F.length(line) + F.when(acc["size"] == 0, 0).otherwise(1)
        solid = line.rlike(f"(?!{T.WS})(?s:.)")
        is_title = line.rlike("^#{1,6}\\s+.+$")
        full = acc["solid"] & (acc["size"] + size > n)
        return F.struct(
            F.when(is_title, T.trim(F.regexp_extract(line, "^#{1,6}\\s+(.+)$", 1))).otherwise(acc["heading"]).alias("heading"),
            F.when(is_title, "").when(full, added).otherwise(F.concat(acc["body"], added)).alias("body"),
            F.when(is_title, 0).when(full, size).otherwise(acc["size"] + size).alias("size"),
            F.when(is_title, False).when(full, solid).otherwise(acc["solid"] | solid).alias("solid"),
            F.when(is_title | full, flushed(acc)).otherwise(acc["chunks"]).alias("chunks"),
        )

    start = F.struct(
        F.lit("").alias("heading"), F.lit("").alias("body"), F.lit(0).alias("size"), F.lit(False).alias("solid"), none.alias("chunks")
    )
    return F.aggregate(lines, start, step, flushed)


def chunks(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Numbered chunks of the first 240,000 characters of each document; a
    text with a NUL character is not text."""
    head = F.when(F.contains(F.col(text), F.lit("\0")), "").otherwise(F.substring(text, 1, SCAN_CHARS))
    rows = docs.select(*keys, F.posexplode(chunk_array(head)).alias("pos", "chunk"))
    return rows.select(*keys, (F.col("pos") + 1).alias("chunk_no"), "chunk.heading", "chunk.text")


class Scorer:
    """Scores of texts for a block of queries, each distinct needle once.

    A needle is a term or a whole query; an automaton finds all that a text
    holds in one pass over it, and each adds its weight to the queries that
    have it.
    """

    def __init__(self, asked: list[tuple[str, list[str]]]):
        import ahocorasick

        number: dict[str, int] = {}
        held: list[list[tuple[int, int, int]]] = []
        for q, (exact, terms) in enumerate(asked):
            wanted = [(t, TERM_META, TERM_TEXT) for t in terms] + [(exact, EXACT_META, EXACT_TEXT)]
            for needle, meta, content in wanted:
                if needle:
                    at = number.setdefault(needle, len(number))
                    if at == len(held):
                        held.append([])
                    held[at].append((q, meta, content))
        self.size = len(asked)
        self.queries = [np.array([x[0] for x in h]) for h in held]
        self.weights = [(np.array([x[1] for x in h]), np.array([x[2] for x in h])) for h in held]
        self.found = ahocorasick.Automaton()
        for needle, at in number.items():
            self.found.add_word(needle, at)
        self.found.make_automaton()

    def scores(self, text: str, side: int) -> np.ndarray:
        """Each query's weights in a text, as metadata (0) or content (1)."""
        held = {at for _, at in self.found.iter(text)} if self.queries else ()
        if not held:
            return np.zeros(self.size, dtype=np.int64)
        queries = np.concatenate([self.queries[at] for at in held])
        weights = np.concatenate([self.weights[at][side] for at in held])
        return np.bincount(queries, weights, self.size).astype(np.int64)


def _best(ids: list, asked: list[tuple[str, list[str]]], kind: str, k: int, owners: list | None):
    """The k best chunks of each query among a task's chunks, of its own owner
    only if ``owners`` are given."""
    named = None if owners is None else np.array([*owners, None], dtype=object)[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(asked)
        # per query a heap whose least entry goes first; that entry, once the
        # heap is full, is also kept in arrays that a chunk's scores must pass
        kept: list[list[tuple]] = [[] for _ in ids]
        least, least_doc, least_chunk = (np.zeros(len(ids), dtype=np.int64) for _ in range(3))
        last_meta, base = None, np.zeros(len(ids), dtype=np.int64)
        last_owner, own = None, np.zeros(len(ids), dtype=np.int64)
        for batch in batches:
            for doc, chunk, meta, content, *owner in zip(*(c.to_pylist() for c in batch.columns)):
                if meta != last_meta:
                    last_meta, base = meta, scorer.scores(meta, 0)
                scores = base + scorer.scores(content, 1)
                if named is not None:
                    if owner != last_owner:
                        last_owner, own = owner, (named == owner[0]).astype(np.int64)
                    scores = scores * own
                sooner = (doc < least_doc) | ((doc == least_doc) & (chunk < least_chunk))
                for q in np.flatnonzero((scores > least) | ((scores == least) & sooner & (scores > 0))).tolist():
                    heap = kept[q]
                    (heapq.heappush if len(heap) < k else heapq.heapreplace)(heap, (int(scores[q]), -doc, -chunk))
                    if len(heap) == k:
                        least[q], least_doc[q], least_chunk[q] = heap[0][0], -heap[0][1], -heap[0][2]
        rows = [(ids[q], -d, -c, s) for q, best in enumerate(kept) for s, d, c in best]
        columns = list(zip(*rows)) if rows else [()] * 4
        kinds = (pa.int64() if kind == "bigint" else pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds)], names=["query_id", "doc_id", "chunk_no", "score"])

    return run


def search(docs: DataFrame, queries: DataFrame, k: int = 5, owner: str | None = None) -> DataFrame:
    """Top k (at most 8) chunks of each query: best score, document order, chunk.

    ``docs``: doc_id (a number), metadata, text; ``queries``: query_id (a number
    or a string), query. A query that occurs whole, and each of its terms, adds
    to a chunk's score, in the metadata more than in the text; a term may lie
    inside a longer run of letters. The queries are a stated set, taken in
    blocks of about ``QUERY_BLOCK`` against all chunks: a block goes to each
    task, which finds all its needles in one pass over a chunk and returns k
    rows a query, so that only these are shuffled. ``owner`` names a column of
    both sides; a query then finds documents of its own owner only.
    """
    k = max(1, min(8, k))
    scope = [owner] if owner else []
    cut = chunks(docs, ["doc_id", "metadata", *scope], "text").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("chunk_no").cast("long").alias("chunk_no"),
        T.bare(F.col("metadata")).alias("meta"),
        T.bare(F.concat_ws("\n", "heading", "text")).alias("content"),
        *scope,
    )
    head = F.substring(T.trim(F.col("query")), 1, QUERY_CHARS)
    asked = queries.select("query_id", T.bare(head).alias("exact"), T.query_terms(head).alias("terms"), *scope)
    kind = dict(asked.dtypes)["query_id"]
    if kind != "string":
        asked, kind = asked.withColumn("query_id", F.col("query_id").cast("long")), "bigint"
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    found = None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).collect()
        owners = [r[owner] for r in rows] if owner else None
        run = _best([r["query_id"] for r in rows], [(r["exact"], r["terms"]) for r in rows], kind, k, owners)
        some = cut.mapInArrow(run, f"query_id {kind}, doc_id long, chunk_no long, score long")
        found = some if found is None else found.unionByName(some)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id", "chunk_no")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def normalize_hits(hits: DataFrame, limit: int = 5) -> DataFrame:
    """Provider hits by first id within the scan limit, blank contents gone."""
    scan = max(8, min(64, limit * 8))
    w = Window.partitionBy("query_id").orderBy("pos")
    seen = hits.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= scan)
    seen = seen.withColumn("content", T.clean(F.col("content"), 4000)).where("content <> ''")
    first = seen.withColumn("_f", F.row_number().over(Window.partitionBy("query_id", "id").orderBy("pos"))).where("_f = 1")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).drop("_n", "_f")


def match_names(requests: DataFrame, names: DataFrame) -> DataFrame:
    """Requests matched to names by containment either way, exact ones first.

    One match gives its name, several are ambiguous. Both sides are keyed by
    owner, so the containment is tested within an owner only.
    """
    r = requests.withColumn("key", T.bare(F.col("wanted"))).where("key <> ''")
    n = names.select(F.col("owner_id").alias("_o"), "name", T.bare(F.col("name")).alias("name_key")).where("name_key <> ''")
    near = F.contains(F.col("key"), F.col("name_key")) | F.contains(F.col("name_key"), F.col("key"))
    met = r.join(n, (F.col("owner_id") == F.col("_o")) & near)
    exact = met.groupBy("request_id").agg(
        F.count_if(F.col("key") == F.col("name_key")).alias("exact"),
        F.min(F.when(F.col("key") == F.col("name_key"), F.col("name"))).alias("exact_name"),
        F.count(F.lit(1)).alias("near"),
        F.min("name").alias("near_name"),
    )
    out = r.select("request_id").join(exact, "request_id", "left")
    found = F.when(F.col("exact") >= 1, F.col("exact_name")).when(F.col("near") == 1, F.col("near_name"))
    state = F.when(found.isNotNull(), "found").when(F.col("near") > 1, "ambiguous").otherwise("missing")
    return out.select("request_id", found.alias("name"), state.alias("state"))
