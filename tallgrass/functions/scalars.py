"""Scalar functions over numbers, addresses, payloads and calls."""

from __future__ import annotations

import ipaddress
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from tallgrass.functions.let import let


def number(value: Column) -> Column:
    """A number, or 0 where the text isn't one."""
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def bounded(value: Column, low: int, high: int, default: int) -> Column:
    """Truncated and clamped; null and 0 give the default."""
    whole = F.coalesce(value, F.lit(0.0)).cast("long")
    return F.greatest(F.lit(low), F.least(F.lit(high), F.when(whole == 0, default).otherwise(whole))).cast("long")


def half_up(value: Column) -> Column:
    """Rounding with halves towards plus infinity."""
    return F.floor(value + 0.5)


def backoff(attempt: Column, base_ms: int = 500, cap_ms: int = 10_000, steps: int = 8) -> Column:
    return F.least(F.lit(cap_ms), F.lit(base_ms) * F.pow(F.lit(2.0), F.least(attempt, F.lit(steps)))).cast("long")


def jittered(delay: Column, seed: int, share: float = 0.2) -> Column:
    return half_up(delay * (1 + share * (2 * F.rand(seed) - 1))).cast("long")


def debounce_due(first: Column, last: Column, sent: Column, quiet: int, most: int, interval: int) -> Column:
    """When held progress is due: after a quiet period, no later than ``most``
    after the first, no sooner than ``interval`` after the last sent."""
    held = F.least(last + quiet, first + most)
    return F.greatest(held, F.coalesce(sent + interval, held))


def data_url(value: Column) -> Column:
    """struct<media, bytes> of a base64 data URL, else null."""
    body = F.regexp_extract(value, "^data:[^;,]*(?:;[^;,]*)*;base64,([A-Za-z0-9+/]*={0,2})$", 1)
    media = F.regexp_extract(value, "^data:([^;,]*)", 1)
    padding = F.length(body) - F.length(F.rtrim(body, F.lit("=")))
    return F.when(
        value.rlike("^data:[^;,]*(?:;[^;,]*)*;base64,[A-Za-z0-9+/]*={0,2}$"),
        F.struct(media.alias("media"), F.floor(F.length(body) * 3 / 4 - padding).cast("long").alias("bytes")),
    )


def fingerprint(value: Column, n: int) -> Column:
    return F.substring(F.sha2(value, 256), 1, n)


#: IPv4 networks that a fetch must not reach, as (address, prefix length).
BLOCKED_V4 = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12),
    ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24),
    ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)
#: Blocked IPv6 networks.
BLOCKED_V6 = (("::", 128), ("::1", 128), ("fc00::", 7), ("fe80::", 10), ("ff00::", 8), ("2001:db8::", 32))


def ipv4_number(address: Column) -> Column:
    parts = F.split(address, "\\.")
    value = F.lit(0).cast("long")
    for i in range(4):
        value = value * 256 + F.get(parts, F.lit(i)).try_cast("long")
    ok = address.rlike("^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\\.|$)){4}(?<!\\.)$")
    return F.when(ok, value)


def blocked_ipv4(address: Column) -> Column:
    """True for an address in a blocked network; null if it isn't IPv4."""

    def inside(n: Column) -> Column:
        out = F.lit(False)
        for network, prefix in BLOCKED_V4:
            low = int(ipaddress.ip_address(network))
            out = out | n.between(low, low + (1 << (32 - prefix)) - 1)
        return F.when(n.isNotNull(), out)

    return let(ipv4_number(address), inside)


@F.pandas_udf(Y.BooleanType())
def blocked_ipv6(addresses: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """True for an IPv6 address in a blocked network; one that maps an IPv4
    address is tested as that. Null if it isn't IPv6."""
    networks = {
        4: [ipaddress.ip_network(f"{network}/{prefix}") for network, prefix in BLOCKED_V4],
        6: [ipaddress.ip_network(f"{network}/{prefix}") for network, prefix in BLOCKED_V6],
    }

    def test(value):
        try:
            address = ipaddress.IPv6Address(value)
        except (ValueError, TypeError):
            return None
        address = address.ipv4_mapped or ipaddress.IPv6Address(int(address))  # without its zone
        return any(address in network for network in networks[address.version])

    for series in addresses:
        yield series.map(test).astype("boolean")


@F.pandas_udf(Y.StringType())
def first_json_object(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The first balanced {...} of a text, quotes and escapes respected."""

    def find(text):
        if text is None:
            return None
        begin = text.find("{")
        while begin >= 0:
            depth, quoted, escaped = 0, False, False
            for i in range(begin, len(text)):
                c = text[i]
                if quoted:
                    if escaped:
                        escaped = False
                    elif c == "\\":
                        escaped = True
                    elif c == '"':
                        quoted = False
                elif c == '"':
                    quoted = True
                elif c == "{":
                    depth += 1
                elif c == "}":
                    depth -= 1
                    if not depth:
                        return text[begin : i + 1]
            begin = text.find("{", begin + 1)
        return None

    for series in texts:
        yield series.map(find)


@F.pandas_udf(Y.StringType())
def canonical_json(payloads: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """JSON with sorted keys and no spaces; unreadable text becomes null."""

    def canon(value):
        try:
            return json.dumps(json.loads(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except (TypeError, ValueError):
            return None

    for series in payloads:
        yield series.map(canon)


def call_signature(name: Column, arguments: Column) -> Column:
    return F.concat(name, F.lit(":"), F.coalesce(canonical_json(arguments), F.lit("null")))


def deep_subset(expected, actual) -> bool:
    """Objects by subset of keys, arrays by prefix, scalars by identity."""
    if isinstance(expected, list):
        return (
            isinstance(actual, list)
            and len(actual) >= len(expected)
            and all(deep_subset(e, a) for e, a in zip(expected, actual))
        )
    if isinstance(expected, dict):
        return isinstance(actual, dict) and all(k in actual and deep_subset(v, actual[k]) for k, v in expected.items())
    if isinstance(expected, bool) or isinstance(actual, bool):
        return expected is actual
    if isinstance(expected, (int, float)) and isinstance(actual, (int, float)):
        return float(expected) == float(actual)
    return type(expected) is type(actual) and expected == actual


@F.pandas_udf(Y.BooleanType())
def json_subset(expected: pd.Series, actual: pd.Series) -> pd.Series:
    """``deep_subset`` over JSON texts; unreadable JSON matches nothing."""

    def test(e, a):
        try:
            return deep_subset(json.loads(e), json.loads(a))
        except (TypeError, ValueError):
            return False

    return pd.Series([test(e, a) for e, a in zip(expected, actual)], dtype="boolean")


def path_value(payload: Column, path: Column) -> Column:
    """Text of the value at a dotted path such as ``a.b[0]``, else null."""
    return F.try_variant_get(F.try_parse_json(payload), F.concat(F.lit("$."), path), "string")
