"""Language by unigram piece models, summed over all segmentations.

Each language has probabilities over the pieces of a fixed public vocabulary.
The probability of a word is the sum over all its segmentations of the product
of its pieces' probabilities, by a forward pass over a trie of the distinct
words; a text's score is the sum of its words' log probabilities. The piece
probabilities are fitted by expectation maximisation, whose expectations come
from the forward and backward passes of the same lattice.

Fitting takes a bounded sample: about ``SAMPLE_DOCS`` labelled documents of
each language, chosen by a hash, with all words of theirs. Each language is
fitted in a task of its own; the driver gets one row of probabilities for each
of at most ``MAX_LANGUAGES`` languages, and stops with an error beyond these.
Documents whose crc32(doc_id as text) mod 4 is 2 are never learned from. Every
document is predicted from its whole text.

Words are lower-cased runs of letters; runs of more than 64 letters are scored
64 at a time. Defined results. A null text, one without a letter, or any text
while no language could be learned is ``und`` with score 0. A null doc_id is
held out. Repeated rows are predicted each; other input columns are ignored;
an empty table gives no rows. Equal scores go to the first language in code
point order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.llm import bytekit as bk
from tallgrass.llm.lattice import Pieces, Trie
from tallgrass.llm.vocabulary import MARK, SENTENCE_FILE, sentence_pieces

SAMPLE_DOCS, MAX_LANGUAGES = 400, 500
ROUNDS, SMOOTHING = 3, 0.05
RUN = 64
#: Probability of a character that no piece covers.
UNKNOWN = 1e-6
#: Forward values are scaled by this factor for each character.
SCALE = float(np.exp(4.0))
PIECE_BYTES = 8 << 20
_LETTERS = re.compile(r"[^\W\d_]+")


def letter_words(text: str) -> list[str]:
    """Lower-cased runs of letters, cut at 64."""
    found = _LETTERS.findall(text.lower())
    if any(len(w) > RUN for w in found):
        found = [w[i : i + RUN] for w in found for i in range(0, len(w), RUN)]
    return found


def letter_pieces(path: str) -> list[str]:
    """Pieces of lower-case letters, with or without the word mark."""
    known, _ = sentence_pieces(path)
    return [p for p in known if re.fullmatch(f"{MARK}?[^\\W\\d_]*", p) and p == p.lower() and p]


def forward(trie: Trie, pieces: Pieces, chance: np.ndarray) -> Iterator:
    """Per depth (depth, endings, scaled forward values of its nodes).

    ``chance`` holds (pieces, languages) probabilities.
    """
    past = [np.ones((1, chance.shape[1]))]
    for depth, found in trie.levels(pieces):
        now = np.zeros((len(trie.parents[depth - 1]), chance.shape[1]))
        plain = np.ones(len(now), dtype=bool)
        for length, nodes, above, numbers in found:
            now[nodes] += past[-length][above] * chance[numbers] * SCALE**length
            if length == 1:
                plain[nodes] = False
        now[plain] += past[-1][trie.parents[depth - 1][plain]] * (UNKNOWN * SCALE)
        past.append(now)
        if len(past) > pieces.longest:
            past.pop(0)
        yield depth, found, now


def log_chances(words: list[str], pieces: Pieces, chance: np.ndarray) -> np.ndarray:
    """(words, languages) log probabilities, summed over segmentations."""
    trie = Trie([MARK + w for w in words])
    out = np.zeros((len(words), chance.shape[1]))
    by_depth = np.argsort(trie.end_depth, kind="stable")
    cut = np.searchsorted(trie.end_depth[by_depth], np.arange(len(trie.parents) + 2))
    for depth, _, now in forward(trie, pieces, chance):
        ends = by_depth[cut[depth] : cut[depth + 1]]
        out[ends] = np.log(now[trie.end_node[ends]]) - depth * np.log(SCALE)
    return out


def fit(words: list[str], counts: np.ndarray, pieces: Pieces, n_pieces: int, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities (pieces, languages) from (words, languages) counts."""
    trie = Trie([MARK + w for w in words])
    chance = np.full((n_pieces, counts.shape[1]), 1.0 / n_pieces)
    for _ in range(rounds):
        steps = list(forward(trie, pieces, chance))
        values = [np.ones((1, counts.shape[1]))] + [now for _, _, now in steps]
        back = [np.zeros_like(v) for v in values]
        for depth in range(1, len(values)):
            ends = trie.ends_at(depth)
            np.add.at(back[depth], trie.end_node[ends], counts[ends] / values[depth][trie.end_node[ends]])
        expected = np.zeros_like(chance)
        for depth, found, _ in reversed(steps):
            here = back[depth]
            plain = np.ones(len(here), dtype=bool)
            for length, nodes, above, numbers in found:
                flow = here[nodes] * chance[numbers] * SCALE**length
                np.add.at(expected, numbers, flow * values[depth - length][above])
                np.add.at(back[depth - length], above, flow)
                if length == 1:
                    plain[nodes] = False
            np.add.at(back[depth - 1], trie.parents[depth - 1][plain], here[plain] * (UNKNOWN * SCALE))
        expected += SMOOTHING
        chance = expected / expected.sum(axis=0)
    return chance


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def _sample_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: dict[tuple[str, str], int] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for w in letter_words(text):
                seen[lang, w] = seen.get((lang, w), 0) + 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in seen], type=pa.string()),
                pa.array([k[1] for k in seen], type=pa.string()),
                pa.array(list(seen.values()), type=pa.int64()),
            ],
            names=["lang", "word", "n"],
        )


def _fit_language(listed: list[str]):
    """One row (lang, chance) from the (lang, word, n) rows of a language."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        t = group.select(["word", "n"]).sort_by("word")
        counts = t["n"].to_numpy().astype(np.float64)[:, None]
        chance = fit(t["word"].to_pylist(), counts, Pieces(listed), len(listed))[:, 0]
        return pa.table({"lang": pa.array([key[0].as_py()]), "chance": pa.array([chance.tolist()])})

    return run


def learn(spark: SparkSession, docs: DataFrame, vocabulary: str = SENTENCE_FILE):
    """(languages, pieces, probabilities) from a bounded labelled sample."""
    known = docs.where(~held_out(F.col("doc_id"))).where("lang is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    )
    langs = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not langs:
        return [], None, None
    # a document is chosen if its hash falls in its language's share
    share = F.create_map(*[x for k, n in langs.items() for x in (F.lit(k), F.lit(min(1.0, SAMPLE_DOCS / n)))])
    chosen = known.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < share[F.col("lang")] * float(1 << 20))
    counted = (
        chosen.select("lang", "text")
        .mapInArrow(_sample_words, "lang string, word string, n long")
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("n"))
    )
    listed = letter_pieces(vocabulary)
    fitted = counted.groupBy("lang").applyInArrow(_fit_language(listed), "lang string, chance array<double>").collect()
    if not fitted:
        return [], None, None
    fitted = sorted(fitted, key=lambda r: r["lang"])
    return [r["lang"] for r in fitted], Pieces(listed), np.array([r["chance"] for r in fitted]).T.copy()


def _predict(names: list[str], pieces: Pieces | None, chance: np.ndarray | None):
    def score(texts: list[str]) -> tuple[list[str], list[float]]:
        number: dict[str, int] = {}
        rows = []
        for text in texts:
            found = letter_words(text)
            if not any(c.isalpha() for w in found for c in w):
                found = []
            rows.append([number.setdefault(w, len(number)) for w in found])
        if not number or not names:
            return ["und"] * len(texts), [0.0] * len(texts)
        table = log_chances(list(number), pieces, chance)
        langs, scores = [], []
        for row in rows:
            if not row:
                langs.append("und")
                scores.append(0.0)
                continue
            total = table[row].sum(axis=0)
            best = int(total.argmax())
            langs.append(names[best])
            scores.append(float(1.0 / np.exp(total - total[best]).sum()))
        return langs, scores

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = bk.utf8(batch.column(2))
            for lo, hi in bk.pieces(offsets, PIECE_BYTES):
                langs, scores = score(bk.strings(offsets, data, lo, hi))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(1).slice(lo, hi - lo),
                        pa.array(langs, type=pa.string()),
                        pa.array(scores, type=pa.float64()),
                    ],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    return run


def identify(spark: SparkSession, docs: DataFrame, *, vocabulary: str = SENTENCE_FILE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row."""
    names, pieces, chance = learn(spark, docs, vocabulary)
    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    return plain.mapInArrow(
        _predict(names, pieces, chance), "doc_id long, held_out boolean, lang_pred string, score double"
    )
