"""The knowledge and web search ports."""

import pytest

from tallgrass.operators import retrieval as R
from tallgrass.sources.providers import KnowledgeRuntime, LibraryProvider, WebSearchRuntime

HITS = "request_id long, pos long, id string, content string, score double, source_id string, title string, url string, provider string"
LIBRARY = "owner_id string, id long, path string, filename string, title string, extension string, content string, imported_at long, fingerprint string"
REQUESTS = "request_id long, owner_id string, query string, top_k long"


class Fixed:
    def __init__(self, hits):
        self.hits = hits

    def describe(self):
        return {"protocol_version": 1, "key": "fixed", "label": " Fixed  hits ", "capabilities": {"scores": True, "x y": True, "n": 1}}

    def retrieve(self, requests):
        return self.hits


def test_hits_are_bounded(spark):
    hits = [
        (1, 1, "a", "  one  two ", 2.0, "s", "T", "https://X.example/a#b", "p"),
        (1, 2, "a", "again", 1.0, "s", "T", None, "p"),
        (1, 3, None, "named", None, "s", "T", None, "p"),
        (1, 4, "s:2", "clash", 1.0, "s", "T", None, "p"),
        (1, 5, None, "nameless", 1.0, None, "T", None, "p"),
        (1, 6, "b", " \n", 1.0, "s", "T", None, "p"),
        (1, 7, "c", "x" * 5000, 1.0, "s", "T", "ftp://x/", "p"),
        (1, 8, "d", "four", 1.0, "s", "T", "https://y.example", "p"),
        (1, 9, "e", "beyond the scan", 1.0, "s", "T", None, "p"),
    ]
    asked = [(1, "o", " q ", 1), (2, "o", "q", None), (3, " ", "q", 3), (4, "o", None, 3)]
    runtime = KnowledgeRuntime(Fixed(spark.createDataFrame(hits, HITS)))
    assert runtime.description == {"key": "fixed", "label": "Fixed hits", "capabilities": {"scores": True}}
    assert runtime.health() == {"status": "ready", "ok": True, "message": ""} and not runtime.managed

    def found(top_k):
        rows = runtime.search(spark.createDataFrame([(1, "o", "q", top_k), *asked[1:]], REQUESTS)).collect()
        states = {r.request_id: r.status for r in rows}
        return states, [(r.id, r.content[:12], r.url, r.citation_id) for r in sorted(rows, key=lambda r: r["rank"] or 0) if r.id]

    first = ("a", "one  two", "https://x.example/a", "source_1")
    assert found(1) == ({1: "ok", 2: "not_found", 3: "owner_required", 4: "query_required"}, [first])
    rest = [("s:2", "named", None, None), ("c", "x" * 12, None, None), ("d", "four", "https://y.example/", "source_2"), ("e", "beyond the s", None, None)]
    assert found(8)[1] == [first, *rest]


def test_broken_providers_are_refused(spark):
    for provider in (object(), type("P", (), {"describe": lambda s: {"key": "A b", "label": "x", "protocol_version": 1}, "retrieve": print})()):
        with pytest.raises(TypeError):
            KnowledgeRuntime(provider)
    with pytest.raises(TypeError):
        WebSearchRuntime(Fixed(None))


def library(spark):
    rows = [
        ("a", 1, "p1", "one.md", "Cats", "md", "# Home\ncats sleep\n# Food\ncats eat fish", 1, "f1"),
        ("a", 2, "p2", "two.md", "", "md", "dogs eat meat", 2, "f2"),
        ("b", 3, "p3", "three.md", "Fish", "md", "cats eat fish", 3, "f3"),
    ]
    return LibraryProvider(spark.createDataFrame(rows, LIBRARY))


def test_library_answers_its_owner_only(spark):
    runtime = KnowledgeRuntime(library(spark))
    assert runtime.managed
    asked = spark.createDataFrame([(1, "a", "eat", 8), (2, "b", "eat", 8), (3, "c", "eat", 8)], REQUESTS)
    rows = runtime.search(asked).collect()
    got = sorted((r.request_id, r["rank"] or 0, r.status, r.id, r.content) for r in rows)
    assert got == [
        (1, 1, "ok", "1:2", "《Cats》\n## Food\ncats eat fish"),
        (1, 2, "ok", "2:1", "《two.md》\ndogs eat meat"),
        (2, 1, "ok", "3:1", "《Fish》\ncats eat fish"),
        (3, 0, "not_found", None, None),
    ]


def test_scoped_search_equals_searches_of_each_owner(spark):
    docs = spark.createDataFrame(
        [(i, "o" + str(i % 3), "m" + str(i % 4), f"# h{i}\n" + " ".join(f"w{(i * j) % 7}" for j in range(9))) for i in range(40)],
        "doc_id long, owner_id string, metadata string, text string",
    )
    asked = spark.createDataFrame([(q, "o" + str(q % 4), f"w{q} m1") for q in range(8)], "query_id long, owner_id string, query string")
    got = sorted(map(tuple, R.search(docs, asked, 4, owner="owner_id").select("query_id", "doc_id", "chunk_no", "score", "rank").collect()))
    each = []
    for o in range(4):
        some = R.search(docs.where(f"owner_id = 'o{o}'"), asked.where(f"owner_id = 'o{o}'"), 4)
        each += map(tuple, some.select("query_id", "doc_id", "chunk_no", "score", "rank").collect())
    assert got and got == sorted(each)


def test_library_management(spark):
    new = spark.createDataFrame([("a", 9, "p1", "one.md", "Cats", "md", "new cats", 5)], LIBRARY.rsplit(", ", 1)[0])
    own = library(spark).ingest(new)
    assert sorted(r.id for r in own.list().collect()) == [2, 3, 9]
    rest, told = own.remove(spark.createDataFrame([("a", 9), ("b", 9)], "owner_id string, id long"))
    assert sorted((r.owner_id, r.removed) for r in told.collect()) == [("a", True), ("b", False)]
    assert sorted((r.id, r.title) for r in rest.list().collect()) == [(2, "two.md"), (3, "Fish")]
