"""Personal data: patterns propose, checksums confirm, context scores.

DataFrame functions only. Each kind's pattern is written without backtracking
between its repeated parts and may only begin where a run of its characters
begins or where the last match ended, so that a long run of letters or digits
costs time in proportion to its length; the matches are those of the plain
pattern.

The base kinds email, ip, card and phone are reported whenever their own test
holds. The method adds the kinds iban (mod-97) and ssn; their score, raised
by a checksum and by nearby context words, must reach ``LEAST``.

Defined results. A null or empty text has no span. Positions are code points,
the end exclusive. Spans of different kinds may overlap. Repeated rows are
scanned each; other input columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.llm.columns import before, let, located
from tallgrass.llm.common import unused

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = 4
#: Java regular expressions; \G is the end of the last match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
CONTEXT = {
    "email": "(?i)mail|contact|write to|reply",
    "ip": "(?i)\\bip\\b|address|host|server|login",
    "card": "(?i)card|visa|master|credit|debit|payment",
    "phone": "(?i)phone|call|tel\\b|mobile|fax|contact",
    "iban": "(?i)iban|account|bank|transfer",
    "ssn": "(?i)ssn|social security",
}
#: Score of a confirmed pattern, and what a context word within REACH adds.
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7, "ssn": 0.3}
CONTEXT_SCORE, REACH, LEAST = 0.2, 40, 0.5
#: Spans that are cut out of a text at a time.
CUT_BLOCK = 256


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """Luhn's check over a string of digits."""

    def step(d: Column, n: Column):
        def add(acc: Column, i: Column) -> Column:
            x = F.substring(d, n - i, F.lit(1)).cast("int")
            y = F.when(i % 2 == 1, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x)
            return acc + y

        return add

    return let(
        digits,
        lambda d: F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), step(d, F.length(d))) % 10 == 0,
    )


def mod97(value: Column) -> Column:
    """The check of ISO 7064 over an account number with spaces."""
    bare = F.regexp_replace(value, " ", "")
    turned = let(bare, lambda v: F.concat(F.substring(v, F.lit(5), F.length(v)), F.substring(v, 1, 4)))

    def add(v: Column):
        def step(acc: Column, i: Column) -> Column:
            c = F.substring(v, i, F.lit(1))
            return F.when(c.between("0", "9"), acc * 10 + F.ascii(c) - 48).otherwise(acc * 100 + F.ascii(c) - 55) % 97

        return step

    return let(turned, lambda v: F.aggregate(F.sequence(F.lit(1), F.length(v)), F.lit(0), add(v)) == 1)


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(f"^{_PART}(?:\\.{_PART}){{3}}$")
    if kind == "card":
        n = F.length(_digits(value))
        return F.when(n.between(12, 19), luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "iban":
        return mod97(value)
    if kind == "ssn":
        return ~value.rlike("^(?:000|666|9..)-|-00-|-0000$")
    return F.lit(True)


def spans_of(text: Column, raw: Column, kind: str) -> Column:
    """array<struct<start, kind, end, score, byte, stop>> of one kind, in
    order; ``raw`` are the text's bytes, byte and stop the span's place there."""
    order = KINDS.index(kind)

    def span(m: Column) -> Column:
        near = before(raw, m["byte"], REACH).rlike(CONTEXT[kind])
        score = F.lit(SCORES[kind]) + F.when(near, CONTEXT_SCORE).otherwise(0.0)
        return F.struct(
            m["start"].alias("start"),
            F.lit(order).alias("kind"),
            (m["start"] + F.length(m["value"])).alias("end"),
            score.alias("score"),
            m["byte"].alias("byte"),
            (m["byte"] + F.octet_length(m["value"])).alias("stop"),
        )

    found = F.filter(located(text, PATTERNS[kind], NEEDS.get(kind)), lambda m: _valid(kind, m["value"]))
    spans = F.transform(found, span)
    return spans if order < BASE_KINDS else F.filter(spans, lambda s: s["score"] >= LEAST)


def written(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            F.sort_array(spans),
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def with_spans(docs: DataFrame, text: str, out: str) -> DataFrame:
    """Adds column ``out``: all spans of column ``text``, sorted."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    found = let(body, lambda b: let(b.cast("binary"), lambda raw: F.concat(*[spans_of(b, raw, k) for k in KINDS])))
    return docs.withColumn(out, F.sort_array(found))


def find_pii(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_iban,
    n_ssn, top_score) for each row."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = with_spans(plain, "text", "found").select("doc_id", "found")

    def count(kind: str) -> Column:
        order = KINDS.index(kind)
        return F.size(F.filter("found", lambda s: s["kind"] == order)).cast("long").alias(f"n_{kind}")

    base = F.filter("found", lambda s: s["kind"] < BASE_KINDS)
    return found.select(
        "doc_id",
        *[count(k) for k in KINDS[:BASE_KINDS]],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("found")).alias("spans"),
        *[count(k) for k in KINDS[BASE_KINDS:]],
        F.array_max(F.transform("found", lambda s: s["score"])).alias("top_score"),
    )


def mask_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in brackets.

    Overlapping spans are replaced once, by the kind that starts first. Null
    texts stay null; ``n_chars``, where present, is counted anew for changed
    texts; all other columns pass unchanged.
    """
    spans, columns = unused(docs, "_spans"), docs.columns
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    none = F.array().cast("array<string>")

    def cut(raw: Column):
        def step(acc: Column, s: Column) -> Column:
            put = F.array(
                F.substring(raw, acc["pos"] + 1, F.greatest(s["byte"] - acc["pos"], F.lit(0))).cast("string"),
                F.get(names, s["kind"]),
            )
            return F.struct(
                F.greatest(acc["pos"], s["stop"]).alias("pos"),
                F.when(s["byte"] < acc["pos"], acc["out"]).otherwise(F.concat(acc["out"], put)).alias("out"),
            )

        return step

    def whole(raw: Column) -> Column:
        # in blocks, so that no long array is copied for each span
        start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<array<string>>").alias("out"))

        def block(acc: Column, b: Column) -> Column:
            own = F.struct(acc["pos"].alias("pos"), none.alias("out"))
            done = F.aggregate(F.slice(F.col(spans), b * CUT_BLOCK + 1, F.lit(CUT_BLOCK)), own, cut(raw))
            return let(done, lambda d: F.struct(d["pos"].alias("pos"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

        blocks = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / F.lit(CUT_BLOCK)).cast("int"))
        rest = lambda acc: F.substring(raw, acc["pos"] + 1, F.octet_length(raw)).cast("string")
        return F.aggregate(blocks, start, block, lambda acc: F.concat(F.array_join(F.flatten(acc["out"]), ""), rest(acc)))

    masked = let(F.col("text").cast("string").cast("binary"), whole)
    text = F.col("text")
    # a column of its own first: a lambda that names a column which the same
    # projection replaces would see the new value
    put = unused(docs, "_masked")
    found = with_spans(docs, "text", spans).withColumn(put, F.when(F.size(spans) > 0, masked).otherwise(text))
    new = {"text": F.col(put)}
    if "n_chars" in columns:
        new["n_chars"] = F.when(F.size(spans) > 0, F.length(put).cast("long")).otherwise(F.col("n_chars"))
    return found.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in columns])
