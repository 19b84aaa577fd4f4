"""Awkward documents that every operator and stage must take."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside; an input may have them as well.
CLASHING = (
    "key", "w", "n", "body", "rep", "component", "component_id", "kept", "gram", "doc", "chunk", "start", "size", "k",
    "taken", "target", "found", "bands", "m", "shingles", "held_out", "score", "spans", "_key", "_gone", "b", "first", "q", "h",
)


def prose(seed, n, words=None):
    rng = random.Random(seed)
    words = words or [f"w{seed}x{i}" for i in range(max(50, n // 2))]
    return " ".join(rng.choice(words) for _ in range(n))


def rows():
    long_text = "\n".join(prose(100 + i, 12) for i in range(6000))
    copy = prose(1, 60)
    return [
        (1, copy, "en", "a", len(copy)),
        (2, copy, "en", None, None),
        (3, copy + " tail", None, "b", 5),
        (4, "", "en", "a", 0),
        (5, None, None, None, None),
        (6, " \n\t\x0b\x0c\r ", "en", "c", 7),
        (None, prose(2, 40), "de", "a", 1),
        (None, copy, "de", None, 1),
        (None, None, None, None, None),
        (7, prose(3, 50), "fr", "", 3),
        (7, prose(3, 50), "fr", "", 3),
        (8, long_text, "en", "a", len(long_text)),
        (9, "One two", "es", "b", 7),
        (10, "one TWO", "es", "b", 7),
        (11, "é😀 token = \"abcdef0123456789abcdef01\" +1 (555) 010-9999 x@y.example 4111 1111 1111 1111, 10.0.0.1", "en", "a", 9),
        (12, "x" * 20_000, "en", "a", 20_000),
        (13, "The " * 300, "en", "z", 1200),
        (14, "\0 nul \0", "en", "a", 7),
    ]


def awkward(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def clashing(spark):
    out = awkward(spark)
    return out.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
