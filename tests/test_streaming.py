"""Streams give what the batch rules give."""

import pytest
from pyspark.sql import functions as F

from tallgrass.operators import admission as A
from tallgrass.operators.folds import fold
from tallgrass.plans.base import events
from tallgrass.streaming import processors as P

SF = "/root/testdata/sf0.001"
HOUR = 3_600_000

RULES = {
    "dedup": A.dedup_rule(24 * HOUR, 5),
    "rate": A.rate_rule(48 * HOUR, 2),
    "throttle": A.throttle_rule(6 * HOUR),
    "fence": A.fence_rule(),
    "completion": A.completion_rule(7),
    "batch": A.batch_rule(24 * HOUR, 8, 150),
    "guard": A.guard_rule(480 * HOUR),
    "debounce": A.debounce_rule(24 * HOUR),
    "heartbeat": A.heartbeat_rule(72 * HOUR),
    "owner": A.owner_rule(),
    "lease": A.lease_rule(24 * HOUR),
}


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    """Events in files by order, so that a stream sees them in order."""
    path = str(tmp_path_factory.mktemp("events"))
    rows = events(spark, SF).selectExpr(
        "source", "seq", "id", "name", "time_ms", "k % 50 as generation", "time_ms - k * 3600000 as occurred_ms", "name as kind",
        "k as chars", "source as turn", "name as tool", "concat(name, k) as signature", "source % 5 as owner", "k % 3 <> 0 as eligible",
        "source as task", "if(k % 9 = 0, null, name) as content", "concat('i', k % 4) as instance", "concat('t', source % 5) as task_id",
        "case name when 'error' then 'release' when 'purchase' then 'takeover' when 'view' then 'pending' when 'signup' then 'deliver' else 'claim' end as action",
    )
    for lo, hi in ((0, 300), (300, 700), (700, 10_000)):
        rows.where(F.col("seq").between(lo, hi - 1)).coalesce(1).write.mode("append").parquet(path)
    return path, rows


def drain(spark, stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return sorted(map(repr, map(tuple, spark.table(name).collect())))


def read(spark, source):
    path, rows = source
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("name", RULES)
def test_stream_equals_batch(spark, source, name):
    rule = RULES[name]
    got = drain(spark, P.run_rule(read(spark, source), rule), f"out_{name}")
    assert got and got == sorted(map(repr, map(tuple, fold(source[1], rule).collect())))


def test_lease_lapses(spark):
    data = [("t", 1, 0, "pending"), ("t", 2, 10, "claim"), ("t", 3, 20, "claim"), ("t", 4, 60_010, "claim"), ("t", 5, 60_020, "deliver")]
    df = spark.createDataFrame(data, "task_id string, seq long, time_ms long, action string")
    got = sorted((r.seq, r.state, r.granted) for r in fold(df, A.lease_rule()).collect())
    assert got == [(1, "pending", True), (2, "delivering", True), (3, "delivering", False), (4, "delivering", True), (5, "delivered", True)]


def test_latest_by_key(spark, source):
    rows = source[1]
    got = drain(spark, P.latest_by_key(read(spark, source), ["source"], "seq"), "latest", "complete")
    assert len(got) == rows.select("source").distinct().count()


def test_watermark_dedup(spark, source):
    stream = read(spark, source).withColumn("ts", F.timestamp_millis("time_ms"))
    got = drain(spark, P.drop_repeats(stream, ["source", "seq"], "ts").select("seq"), "marks")
    assert len(got) == source[1].count()


def test_sink_versions(spark, source, tmp_path):
    query = P.coalesced_sink(read(spark, source), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == source[1].count()


def test_journal_tail(spark, tmp_path):
    (tmp_path / "o" / "s").mkdir(parents=True)
    (tmp_path / "o" / "s" / "session.jsonl").write_text('{"seq":1}\n{"seq":2}\n')
    stream = P.tail_journal(spark, str(tmp_path), "seq long")
    assert drain(spark, stream, "tail") == ["(1,)", "(2,)"]
