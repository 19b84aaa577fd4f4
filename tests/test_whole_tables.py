"""Queries take every row of their tables: small tables beyond the former bounds."""

import datetime
import json
import re

from test_operators import naive_chunks

import __spark_entry__ as entry

Q = entry.queries()


def put(spark, folder, name, data, schema):
    spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")


def bare(text):
    return re.sub(r"[\W_]+", "", text).lower()


def naive_top(docs, asked, k=5):
    """All chunks of all documents against whole queries, without Han runs."""
    out = []
    for q, query in asked:
        query = query.strip()[:500].strip()
        terms = {t for t in re.findall(r"[^\W_]+", query.lower()) if len(t) >= 2}
        met = []
        for d, source, text in docs:
            for n, (heading, chunk) in enumerate(naive_chunks(text), 1):
                meta, content, exact = bare(source), bare(f"{heading}\n{chunk}"), bare(query)
                score = 80 * (exact in meta) + 60 * (exact in content) + sum(12 * (t in meta) + 8 * (t in content) for t in terms)
                if score:
                    met.append((-score, d, n))
        out += [(q, d, n, -s, rank) for rank, (s, d, n) in enumerate(sorted(met)[:k], 1)]
    return sorted(out)


def test_lexical_topk_searches_all_documents_by_whole_queries(spark, tmp_path):
    tail = "omega psi chi"
    asked = [(1, "alpha beta gamma " * 5 + tail), (2, "delta epsilon")]
    docs = [
        (1, "web", "alpha beta"), (2, "web", "filler words " * 200 + "\n" + "x " * 700 + "\n" + asked[0][1]), (3, "books", "# Delta epsilon\nbody"),
        (4, "delta", "y " * 900 + "\nepsilon"), (5, "web", tail), (6, "web", "nothing"),
    ]
    put(spark, tmp_path, "documents", docs, "doc_id long, source string, text string")
    put(spark, tmp_path, "benchmark", asked, "item_id long, text string")
    got = sorted((r.query_id, r.doc_id, r.chunk_no, r.score, r["rank"]) for r in Q["lexical_topk"](spark, str(tmp_path)).collect())
    assert got == naive_top(docs, asked)
    assert [(r[1], r[2] > 1) for r in got if r[0] == 1 and r[-1] == 1] == [(2, True)]
    assert {r[1] for r in got if r[0] == 2} == {3, 4}


EVENT = "user_id long, event_id long, event_type string, ts timestamp, value double, props string"


def put_events(spark, folder, seqs, k):
    at = datetime.datetime(2024, 1, 1)
    put(spark, folder, "events", [(s % 3, s, "click", at, 1.0, json.dumps({"k": k(s)})) for s in seqs], EVENT)


def test_traces_take_all_events(spark, tmp_path):
    put_events(spark, tmp_path, range(3990, 4020), lambda s: 1)
    aligned = Q["align_calls"](spark, str(tmp_path)).collect()
    assert len(aligned) == 30 and all(r.expected_index == r.actual_index for r in aligned)
    assert sorted({r.case_id for r in aligned}) == ["c0", "c1", "c2"]
    assert Q["positional_pairs"](spark, str(tmp_path)).count() == 30
    folder = tmp_path / "dropped"
    put_events(spark, folder, range(4000, 4006), lambda s: 5 if s < 4003 else 7)
    got = {r.case_id: (r.missing, r.extra) for r in Q["missing_calls"](spark, str(folder)).collect()}
    assert got == {f"c{i}": (1, 1) for i in range(3)}


def test_name_match_answers_all_customers(spark, tmp_path):
    asked = [(300, 1, "Customer#0007"), (301, 1, "Customer#0007"), (5000, 2, "Customer#00"), (5001, 3, "Customer#0009")]
    put(spark, tmp_path, "customer", asked, "c_custkey long, c_nationkey int, c_name string")
    put(spark, tmp_path, "supplier", [(7, 1), (8, 2), (9, 2)], "s_suppkey long, s_nationkey int")
    got = sorted((r.request_id, r.name, r.state) for r in Q["name_match"](spark, str(tmp_path)).collect())
    assert got == [(300, "customer#0007", "found"), (301, "customer#0007", "found"), (5000, None, "ambiguous"), (5001, None, "missing")]


def test_cart_totals_and_audio_resample_take_all_events(spark, tmp_path):
    put_events(spark, tmp_path, range(195, 225), lambda s: s % 7)
    carts = {r.source: (r.subtotal, r.total) for r in Q["cart_totals"](spark, str(tmp_path)).collect()}
    sums = {u: sum(s % 7 * (s % 3 + 1) for s in range(195, 225) if s % 3 == u) for u in range(3)}
    assert carts == {u: (x, x + (0 if x >= 35 else 5)) for u, x in sums.items()}
    heard = sorted((r.seq, r.samples) for r in Q["audio_resample"](spark, str(tmp_path)).collect())
    assert heard == [(s, 240) for s in range(195, 225)]
