"""Secret spans: fixed patterns, and dictionary-primed zstandard novelty.

Three base kinds are read from patterns alone. The method adds the kind
``novel``: strings of ``LEAST`` characters or more near a word of a sensitive
context, before or after it, are candidates, and a candidate is reported if it
adds many bytes to the compressed form of what surrounds it. The compressor is
primed with a dictionary of identifiers, so that long but ordinary names add
few bytes. A context word inside a run of characters ends the string before it
and begins the next, so no two novel spans overlap.

Defined results. A null or empty text has no span. Positions are code points,
the end exclusive. Repeated rows are scanned each; other columns of the input
are ignored; an empty table gives no rows. Whole texts are scanned, a batch at
a time, and nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

CONTEXT_WORDS = (*ASSIGN_WORDS, "credential", "private_key", "private key", "access key", "access_key", "bearer ", "authorization", "pwd")
CONTEXT = re.compile("|".join(map(re.escape, CONTEXT_WORDS)), re.IGNORECASE)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Characters of the shortest candidate (the pattern asks them of the run that
#: it lies in), and how far a context word may be.
LEAST, REACH = 16, 64
AROUND = 160
#: Marginal compressed bytes per character at which a candidate is novel.
NOVELTY = 0.7

#: Names that code and configuration repeat; the compressor is primed with them.
IDENTIFIERS = (
    "access_token refresh_token client_id client_secret authorization bearer password username user_id session_id "
    "api_key api_secret private_key public_key certificate credentials environment configuration application "
    "development production staging database connection string host port localhost endpoint response request "
    "headers content_type application/json https http www example com org net import export default function "
    "return const static class public private protected void int float double boolean true false null none self "
    "this object array list dict value values index length size count total name path file directory timeout "
    "retry version license copyright reserved identifier description parameters arguments result error exception "
    "message logger warning debug info abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 "
)


class Novelty:
    """Marginal compressed bytes of a string inside its surroundings."""

    def __init__(self, identifiers: str = IDENTIFIERS, level: int = 9):
        raw = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self._with = zstandard.ZstdCompressor(level=level, dict_data=raw, write_content_size=False, write_checksum=False)

    def marginal(self, before: str, candidate: str, after: str) -> int:
        rest = len(self._with.compress((before + after).encode()))
        return len(self._with.compress((before + candidate + after).encode())) - rest


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, unsorted."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of the strings near a context word, in order."""
    words = [m.span() for m in CONTEXT.finditer(text)]
    found, near, cut = [], 0, 0
    for m in CANDIDATE.finditer(text):
        # the run without the context words that lie in it
        while cut < len(words) and words[cut][1] <= m.start():
            cut += 1
        at, i, parts = m.start(), cut, []
        while i < len(words) and words[i][0] < m.end():
            parts.append((at, words[i][0]))
            at = words[i][1]
            i += 1
        parts.append((at, m.end()))
        for a, b in parts:
            if b - a < LEAST:
                continue
            while near < len(words) and words[near][1] < a - REACH:
                near += 1
            if near < len(words) and words[near][0] <= b + REACH:
                found.append((a, b))
    return found


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty, least: float) -> list[tuple[int, int, int]]:
    """Candidates that hardly compress, outside base spans."""
    low = text.lower()
    if not any(w in low for w in CONTEXT_WORDS):
        return []
    found, taken = [], sorted((a, b) for a, _, b in base)
    i, reach = 0, -1  # base spans that begin before a candidate's end, and their last end
    for a, b in candidates(text):
        while i < len(taken) and taken[i][0] < b:
            reach = max(reach, taken[i][1])
            i += 1
        if reach > a:
            continue
        before, after = text[max(0, a - AROUND) : a], text[b : b + AROUND]
        if novelty.marginal(before, text[a:b], after) >= least * (b - a):
            found.append((a, 3, b))
    return found


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def _scan(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in batches:
            rows = []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                more = novel_spans(text, base, novelty, least)
                count = [sum(k == i for _, k, _ in base) for i in range(3)]
                rows.append((*count, len(more), hashlib.sha256(written(base).encode()).hexdigest(), written(base + more)))
            cols = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array(c, type=pa.int64()) for c in cols[:4]),
                    *(pa.array(c, type=pa.string()) for c in cols[4:]),
                ],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"],
            )

    return run


def find_secrets(spark: SparkSession, docs: DataFrame, *, novelty: float = NOVELTY) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans) per row."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(
        _scan(novelty),
        "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string",
    )
