"""Column helpers for the operators that use DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row.

    An expression that a lambda names would be evaluated for each element;
    as a lambda's own variable it is evaluated once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words of a text: runs between white space (space, \\t to \\r)."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\t-\\r]+", -1))


FOUND = "array<struct<start:int,byte:int,value:string>>"
_BLOCK = 256


def located(text: Column, pattern: str, needs: str | None = None) -> Column:
    """Leftmost non-overlapping matches with their code point and byte offsets.

    The gaps between matches come from splitting by the pattern, so a match's
    offset is the length of all gaps and matches before it. Offsets are added
    up within blocks first and then over blocks, so that a text of very many
    matches stays cheap. ``needs`` is a string that any match contains.
    """
    empty = F.array().cast(FOUND)

    def moved(y: Column, acc: Column) -> Column:
        return F.struct((y["start"] + acc["pos"]).alias("start"), (y["byte"] + acc["at"]).alias("byte"), y["value"].alias("value"))

    def block(pairs: Column) -> Column:
        return F.aggregate(
            pairs,
            F.struct(F.lit(0).alias("pos"), F.lit(0).alias("at"), empty.alias("out")),
            lambda acc, x: F.struct(
                (acc["pos"] + F.length(x["0"]) + F.length(x["1"])).alias("pos"),
                (acc["at"] + F.octet_length(x["0"]) + F.octet_length(x["1"])).alias("at"),
                F.concat(
                    acc["out"],
                    F.array(
                        F.struct(
                            (acc["pos"] + F.length(x["0"])).alias("start"),
                            (acc["at"] + F.octet_length(x["0"])).alias("byte"),
                            x["1"].alias("value"),
                        )
                    ),
                ).alias("out"),
            ),
        )

    def blocks(pairs: Column) -> Column:
        n = F.size(pairs) - 1  # the last gap has no match
        cut = F.transform(
            F.sequence(F.lit(0), F.floor((n - 1) / F.lit(_BLOCK)).cast("int")),
            lambda b: block(F.slice(pairs, b * _BLOCK + 1, F.least(F.lit(_BLOCK), n - b * _BLOCK))),
        )
        joined = F.aggregate(
            cut,
            F.struct(F.lit(0).alias("pos"), F.lit(0).alias("at"), F.array().cast(f"array<{FOUND}>").alias("out")),
            lambda acc, x: F.struct(
                (acc["pos"] + x["pos"]).alias("pos"),
                (acc["at"] + x["at"]).alias("at"),
                F.concat(acc["out"], F.array(F.transform(x["out"], lambda y: moved(y, acc)))).alias("out"),
            ),
        )
        return F.when(n > 0, F.flatten(joined["out"])).otherwise(empty)

    pairs = F.arrays_zip(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    found = let(pairs, blocks)
    return found if needs is None else F.when(F.instr(text, needs) > 0, found).otherwise(empty)


def before(raw: Column, byte: Column, reach: int) -> Column:
    """The ``reach`` code points before a byte offset of a text.

    They are cut from the text's bytes ``raw``, which needs no walk from the
    text's begin. A code point has four bytes at most, so one that the cut
    parts is never among the nearest ``reach``.
    """
    room = 4 * reach + 3
    cut = F.substring(raw, F.greatest(byte - room, F.lit(0)) + 1, F.least(byte, F.lit(room)))
    return F.right(cut.cast("string"), F.lit(reach))
