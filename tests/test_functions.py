"""Literal rows for semantics that the tables can't show."""

import datetime as dt
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallgrass.functions import audio as P
from tallgrass.functions import scalars as S
from tallgrass.functions import schedule as C
from tallgrass.functions import text as T
from tallgrass.operators import web as W
from tallgrass.plans.catalog import QUERIES


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'bigint' if isinstance(v, int) else 'array<string>'}" for k, v in values.items())
    df = spark.createDataFrame([tuple(values.values())], schema) if values else spark.range(1)
    return df.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("电话13800138000号", True), ("order 1234567890", False), ("x12345678901", False), ("a sk-abcdefgh", True), ("我的密码", True),
        ("My API_Key", True), ("A" * 40, True), (None, False), ("", False),
    ],
)
def test_sensitive(spark, text, expected):
    assert one(spark, T.sensitive(F.col("x")), x=text) is expected


def test_spaces(spark):
    assert one(spark, T.collapse(F.col("x")), x="a　 b ﻿ \x0b") == "a b"
    assert one(spark, T.trim(F.col("x")), x="　a b﻿") == "a b"
    assert one(spark, T.collapse(F.col("x")), x=None) == ""


def test_units_and_points(spark):
    assert one(spark, T.clean_units(F.col("x"), 3), x="😀😀ab") == "😀"
    assert one(spark, T.clean(F.col("x"), 3), x="😀😀ab") == "😀😀a"


def test_ngrams(spark):
    assert one(spark, T.ngrams(F.col("x")), x="a") == []
    assert one(spark, T.ngrams(F.col("x")), x="") == []
    assert one(spark, T.ngrams(F.col("x")), x="abab") == ["ab", "ba"]


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("ok", "ok", True), ("short", "shorx", False), ("abcdefgh", "abcdxxxxyy", True), ("abcdefgh", "zyxwvuts", False), ("", "", True)],
)
def test_equivalent_speech(spark, a, b, same):
    assert one(spark, T.equivalent_speech(F.col("a"), F.col("b")), a=a, b=b) is same


def test_query_terms(spark):
    terms = one(spark, T.query_terms(F.col("x")), x="怎么 使用 Spark 引擎优化器 a")
    assert terms == ["使用", "spark", "引擎", "擎优", "优化", "化器"]


def test_anchor_short_and_long(spark):
    assert one(spark, T.anchored(F.col("v"), F.col("q")), v="茶", q="我爱喝茶") is True
    assert one(spark, T.anchored(F.col("v"), F.col("q")), v="工程师", q="程序员") is False
    assert one(spark, T.anchored(F.col("v"), F.col("q")), v="", q="x") is False


def test_scrub(spark):
    got = one(spark, T.scrub(F.col("x")), x='bearer abc.def sk-12345678 http://h/?token=zz&x=1 {"api_key":"q"}')
    assert "abc.def" not in got and "12345678" not in got and "zz" not in got and '"q"' not in got and "x=1" in got


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("BASIC a=", "BASIC [REDACTED]"),
        ("bearer\tx", "bearer [REDACTED]"),
        ("sk-abcdefgh", "[REDACTED]"),
        ("h?Api_Key=1", "h?Api_Key=[REDACTED]"),
        ('"a_TOKEN" : "1\\"2"', '"a_TOKEN" : "[REDACTED]"'),
        ("x" * 32_000, "x" * 32_000),
        ("x" * 32_001, "x" * 32_000 + "…[truncated]"),
        ("é" * 32_001, "é" * 32_000 + "…[truncated]"),
        ("x" * 31_999 + "😀", "x" * 31_999 + "…[truncated]"),
        ("😀" * 16_000 + "x", "😀" * 16_000 + "…[truncated]"),
        ("x" * 32_000 + "é", "x" * 32_000 + "…[truncated]"),
        ("x" * 31_980 + " Bearer " + "y" * 99, "x" * 31_980 + " Bearer [REDACTED]"),
    ],
)
def test_scrub_each_pattern_and_cut(spark, text, expected):
    assert one(spark, T.scrub(F.col("x")), x=text) == expected


def test_scrub_of_long_plain_text_costs_less_than_two_patterns(spark):
    """What no pattern can match isn't looked at character by character."""
    long = F.concat(F.repeat(F.lit("x"), F.lit(32_000)), F.col("id").cast("string"))

    def seconds(column):
        def once():
            began = time.perf_counter()
            spark.range(0, 3_000, 1, 1).select(column).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - began

        return min(once() for _ in range(3))

    assert seconds(T.scrub(long)) < 2 * seconds(F.regexp_replace(long, T.AUTH_VALUE, ""))


def test_redacted_fields_spreads_the_rows_of_one_file(spark, tmp_path):
    spark.range(0, 20_001, 1, 1).withColumnRenamed("id", "event_id").write.parquet(f"{tmp_path}/events.parquet")
    made = QUERIES["redacted_fields"](spark, str(tmp_path))
    assert made.count() == 20_001 and made.rdd.getNumPartitions() >= 5


def test_lists_and_bullets(spark):
    assert one(spark, T.split_list(F.col("x")), x=" 读书、跑步,, 茶｜ ") == ["读书", "跑步", "茶"]
    assert one(spark, T.dedup_bullets(F.col("x")), x="- a\n\n\n- A\n* b\nt\n") == "- a\n\n* b\nt"


def ms(text):
    return int(dt.datetime.fromisoformat(text.replace("Z", "+00:00")).timestamp() * 1000)


@pytest.mark.parametrize(
    ("at", "kind", "zone", "now", "expected"),
    [
        ("2026-01-01T09:30:00.123Z", "daily", "UTC", "2026-01-01T10:00:00Z", "2026-01-02T09:30:00.123Z"),
        ("2026-01-01T09:30:00.123Z", "weekly", "UTC", "2026-01-01T10:00:00Z", "2026-01-08T09:30:00.123Z"),
        ("2026-01-09T09:30:00Z", "weekdays", "UTC", "2026-01-12T15:00:00Z", "2026-01-13T09:30:00Z"),
        ("2026-03-07T07:30:00Z", "daily", "America/New_York", "2026-03-07T07:30:01Z", "2026-03-08T07:30:00Z"),
        ("2026-03-07T08:30:00Z", "daily", "America/New_York", "2026-03-07T08:30:01Z", "2026-03-08T07:30:00Z"),
        ("2010-01-01T09:30:00Z", "daily", "UTC", "2026-01-01T10:00:00Z", "2026-01-02T09:30:00Z"),
        ("2026-05-01T09:30:00Z", "daily", "UTC", "2026-01-01T10:00:00Z", "2026-05-01T09:30:00Z"),
        ("2010-01-01T09:30:00Z", "once", "UTC", "2026-01-01T10:00:00Z", None),
    ],
)
@pytest.mark.parametrize("session_zone", ["UTC", "Asia/Tokyo"])
def test_next_occurrence(spark, at, kind, zone, now, expected, session_zone):
    spark.conf.set("spark.sql.session.timeZone", session_zone)
    try:
        got = one(spark, C.next_occurrence(F.col("a"), F.col("r"), F.col("z"), F.col("n")), a=ms(at), r=kind, z=zone, n=ms(now))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == (ms(expected) if expected else None)


def test_entities(spark):
    text = "a &amp;lt; &#38;amp; &#x1F600; &bogus; &LT; &#99999999; &#xD800; & b"
    assert one(spark, W.decode_entities(F.col("x")), x=text) == "a &lt; &amp; 😀 &bogus; < &#99999999; &#xD800; & b"
    assert one(spark, W.decode_search_entities(F.col("x")), x="&amp;lt; &amp;#65; &middot;") == "< A ·"


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("HTTP://Ex.COM:80/a#f", "http://ex.com/a"), ("https://h.com:443", "https://h.com/"), ("https://h:8443/x?q=1#z", "https://h:8443/x?q=1"),
        ("ftp://h/x", None), ("https://u:p@h/x", None), ("javascript:alert(1)", None), (" https://h/ ", "https://h/"), (None, None),
    ],
)
def test_urls(spark, url, expected):
    assert one(spark, W.normalize_url(F.col("u")), u=url) == expected


@pytest.mark.parametrize(
    ("address", "blocked"),
    [("127.0.0.1", True), ("8.8.8.8", False), ("172.32.0.1", False), ("172.31.255.255", True), ("1.2.3", None), ("1.2.3.256", None), ("01.2.3.4", None)],
)
def test_ipv4(spark, address, blocked):
    assert one(spark, S.blocked_ipv4(F.col("a")), a=address) is blocked


def test_ipv6_json_and_paths(spark):
    assert one(spark, S.blocked_ipv6(F.col("a")), a="::1") is True
    assert one(spark, S.blocked_ipv6(F.col("a")), a="2606:4700::1111") is False
    assert one(spark, S.blocked_ipv6(F.col("a")), a="::ffff:10.0.0.1") is True
    assert one(spark, S.first_json_object(F.col("x")), x='no } {"a":"}{","b":{"c":1}} {') == '{"a":"}{","b":{"c":1}}'
    assert one(spark, S.first_json_object(F.col("x")), x="{ open") is None
    assert one(spark, S.canonical_json(F.col("x")), x='{"b":[1, {"d":1,"c":2}], "a":null}') == '{"a":null,"b":[1,{"c":2,"d":1}]}'
    assert one(spark, S.path_value(F.col("x"), F.lit("a.b[0]")), x='{"a":{"b":[7]}}') == "7"


def test_deep_subset():
    assert S.deep_subset({"a": [1]}, {"a": [1, 2], "b": 0})
    assert not S.deep_subset({"a": 1}, {"a": True})
    assert S.deep_subset({"a": 1}, {"a": 1.0})
    assert not S.deep_subset([1, 2], [1])
    assert not S.deep_subset({"a": None}, {})


def test_numbers(spark):
    assert one(spark, F.floor(F.lit(-2.5) + 0.5)) == -2
    assert one(spark, S.number(F.col("x")), x="abc") == 0.0
    assert one(spark, S.number(F.col("x")), x="1e3") == 1000.0
    assert one(spark, S.bounded(F.lit(0.0), 1, 8, 5)) == 5
    assert one(spark, S.bounded(F.lit(99.9), 1, 8, 5)) == 8


def test_data_url(spark):
    assert one(spark, S.data_url(F.col("x")), x="data:text/plain;base64,QUI=")["bytes"] == 2
    assert one(spark, S.data_url(F.col("x")), x="data:text/plain,hello") is None


@given(st.lists(st.integers(-32768, 32767), min_size=4, max_size=200), st.sampled_from([(48000, 16000), (16000, 24000), (44100, 16000)]), st.integers(1, 50))
@settings(max_examples=60, deadline=None)
def test_stream_resampler_equals_whole(samples, rates, cut):
    x = np.array(samples, dtype=float)
    whole = P.StreamResampler(*rates).push(x)
    stream = P.StreamResampler(*rates)
    parts = np.concatenate([stream.push(x[i : i + cut]) for i in range(0, len(x), cut)])
    assert np.allclose(whole, parts)
