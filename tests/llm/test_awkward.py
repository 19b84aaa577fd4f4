"""Nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import pytest
from docs import CLASHING, awkward, clashing, empty, rows

import corpus_pipeline
from tallgrass.llm import (
    decontam,
    html_extract,
    langid,
    minhash_dedup,
    mixing,
    pii,
    quality,
    secrets_scan,
    stages,
    suffix_dedup,
    token_counts,
)

N = len(rows())
PER_ROW = {
    "op1": minhash_dedup.near_duplicates,
    "op2": secrets_scan.find_secrets,
    "op3": mixing.mix,
    "op5": token_counts.count_tokens,
    "op6": quality.judge,
    "op7": suffix_dedup.remove_repeats,
    "op8": langid.identify,
    "op9": pii.find_pii,
}


def items(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (None, "x"), (3, "one two")], "item_id long, text string")


@pytest.mark.parametrize("name", PER_ROW)
def test_a_row_for_each_row(spark, name):
    got = PER_ROW[name](spark, awkward(spark)).collect()
    assert len(got) == N
    assert sorted(r.doc_id for r in got if r.doc_id) == sorted(r[0] for r in rows() if r[0])


@pytest.mark.parametrize("name", PER_ROW)
def test_clashing_columns_change_nothing(spark, name):
    plain = sorted(map(repr, PER_ROW[name](spark, awkward(spark)).collect()))
    assert sorted(map(repr, PER_ROW[name](spark, clashing(spark)).collect())) == plain


@pytest.mark.parametrize("name", PER_ROW)
def test_empty_table(spark, name):
    assert PER_ROW[name](spark, empty(spark)).collect() == []


def test_op1_values(spark):
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(spark, awkward(spark)).collect() if r.doc_id}
    assert [got[i].component_id for i in (1, 2, 3)] == [1, 1, 1]
    assert [got[i].n_shingles for i in (4, 5, 6, 9)] == [0, 0, 0, 1]
    assert [got[i].component_id for i in (4, 5, 6)] == [4, 5, 6]
    assert got[9].component_id == got[10].component_id == 9 and not got[10].kept
    without = [r for r in minhash_dedup.near_duplicates(spark, awkward(spark)).collect() if r.doc_id is None]
    assert sorted((r.component_id or 0, r.kept) for r in without) == [(0, True), (1, False), (2, True)] or sorted(
        (r.component_id or 0, r.kept) for r in without
    ) == [(0, True), (0, True), (1, False)]


def test_op3_values(spark):
    got = mixing.mix(spark, awkward(spark)).collect()
    assert all(r.taken <= 3 * r["size"] for r in got)
    assert all(r.taken == 0 for r in got if r["size"] == 0)
    by = {r.source: (r.source_size, r.target) for r in got}
    assert all(t <= 3 * s for s, t in by.values())
    assert abs(sum(t for _, t in by.values()) - sum(s for s, _ in by.values())) < 1e-6 * sum(s for s, _ in by.values())


def test_op8_undetermined(spark):
    got = {r.doc_id: r for r in langid.identify(spark, awkward(spark)).collect() if r.doc_id}
    assert [(got[i].lang_pred, got[i].score) for i in (4, 5, 6)] == [("und", 0.0)] * 3
    assert all(0 <= r.score <= 1 for r in got.values())


def test_op8_without_labels(spark):
    from pyspark.sql import functions as F

    got = langid.identify(spark, awkward(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in got} == {"und"}


def test_op10(spark):
    docs = awkward(spark)
    got = decontam.contained_items(spark, docs, items(spark)).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(9, 3), (10, 3)] or {(r.doc_id, r.item_id) for r in got} >= {(9, 3), (10, 3)}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contained_items(spark, docs, none).collect() == []
    assert decontam.contained_items(spark, empty(spark), items(spark)).collect() == []
    assert decontam.drop_contaminated(spark, clashing(spark), items(spark)).count() == docs.count() - len({r.key for r in got})


def test_op4(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<p>a"), (3, "u", "x" * 100_000), (3, "u", "<div>" * 20_000 + "deep")], "page_id long, url string, html string")
    got = html_extract.extract_text(spark, pages).collect()
    assert [(r.page_id, r.text[:5]) for r in got] == [(1, ""), (2, ""), (None, "a"), (3, "xxxxx"), (3, "deep")]
    assert html_extract.extract_text(spark, pages.limit(0)).collect() == []


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, name, tmp_path):
    items(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, empty(spark), str(tmp_path)).collect() == []
    docs = awkward(spark)
    got = stage(spark, docs, str(tmp_path))
    if name != "mixing":
        assert got.columns == docs.columns
        wide = stage(spark, clashing(spark), str(tmp_path))
        assert wide.columns == clashing(spark).columns
        assert sorted(repr(r[:5]) for r in map(tuple, wide.collect())) == sorted(repr(tuple(r)) for r in got.collect())
        assert all(r[c] == f"own {c}" for r in wide.collect() for c in CLASHING)
    else:
        assert {r.doc_id for r in got.collect()} <= {r[0] for r in rows()}


def test_dedup_stage(spark):
    got = stages.drop_near_duplicates(spark, awkward(spark)).collect()
    copies = [r for r in got if r.text and r.text.startswith(rows()[0][1])]
    assert len(copies) == 1
    assert sum(r.doc_id == 7 for r in got) == 1
    assert sum(r.text is None or not r.text.strip(" \n\t\x0b\x0c\r") for r in got) == 4


def test_masking(spark):
    got = {r.doc_id: r for r in pii.mask_pii(awkward(spark)).collect() if r.doc_id}
    assert got[5].text is None and got[4].text == ""
    for put in ("[PHONE]", "[EMAIL]", "[CARD]", "[IP]"):
        assert put in got[11].text
    assert got[11].n_chars == len(got[11].text) and got[9].n_chars == 7
