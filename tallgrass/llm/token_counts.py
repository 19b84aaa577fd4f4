"""Token counts by dynamic programming over a trie of pre-tokens.

A pre-token is a word with the word mark before it. The distinct pre-tokens of
a batch of texts are inserted in a trie; the best unigram score of a prefix is
computed once for all words that share it, and a word's end stores the number
of pieces of its best segmentation. A text's count is the sum over its words.
The trie holds words to a depth of ``CHAIN``; what is longer goes on from its
node there as a chain of its own, with the same scores, so that a word of
millions of characters costs time in proportion to its length.

Pieces come from a vocabulary file. Files of merge ranks hold no
probabilities, so a piece of rank r has the score ``-log(r + 2)``. A character
that is no piece falls back to its UTF-8 bytes, each as improbable as a rank
after the last. Of equal scores the one with fewer pieces counts.

Defined results. A null, empty or word-less text has no tokens. Repeated rows
are counted each; other input columns are ignored; an empty table gives no
rows. A batch's trie is dropped after the batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.llm import bytekit as bk
from tallgrass.llm.lattice import Pieces, Trie, code_points
from tallgrass.llm.vocabulary import MARK, SENTENCE_FILE, sentence_pieces

WORDS = re.compile("[^\x20\x09-\x0d]+")
PIECE_BYTES = 8 << 20
#: Depth of the trie, and characters of a chain whose pieces are found at once.
CHAIN, CHAIN_BLOCK = 256, 1 << 18


def rank_scores(n: int) -> np.ndarray:
    return -np.log(np.arange(n) + 2.0)


def _utf8_sizes(chars: np.ndarray) -> np.ndarray:
    return 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)


def _chain(word: str, pieces: Pieces, scores: np.ndarray, byte_score: float, best: list[float], used: list[int]) -> int:
    """Pieces of a word whose prefix of ``CHAIN`` characters is done; ``best``
    and ``used`` hold the last places of that prefix, the nearest last."""
    sizes = _utf8_sizes(code_points([word])[0])
    for low in range(CHAIN, len(word), CHAIN_BLOCK):
        high = min(len(word), low + CHAIN_BLOCK)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(high - low)]
        for length, ends, numbers in pieces.inside(word, low, high):
            for end, score in zip((ends - low).tolist(), scores[numbers].tolist()):
                ending[end].append((length, score))
        for found, size in zip(ending, sizes[low:high].tolist()):
            score, count = best[-1] + size * byte_score, used[-1] + size
            for length, own in found:
                s, c = best[-length] + own, used[-length] + 1
                if length == 1 or s > score or (s == score and c < count):
                    score, count = s, c
            best.append(score)
            used.append(count)
        del best[: -pieces.longest], used[: -pieces.longest]
    return used[-1]


def best_counts(words: list[str], pieces: Pieces, scores: np.ndarray, byte_score: float) -> np.ndarray:
    """Pieces of the best segmentation of each distinct word."""
    trie = Trie([w[:CHAIN] for w in words])
    best, used = [np.zeros(1)], [np.zeros(1, dtype=np.int64)]
    out = np.zeros(len(words), dtype=np.int64)
    by_depth = np.argsort(trie.end_depth, kind="stable")
    cut = np.searchsorted(trie.end_depth[by_depth], np.arange(len(trie.parents) + 2))
    for depth, found in trie.levels(pieces):
        parents, sizes = trie.parents[depth - 1], _utf8_sizes(trie.chars[depth - 1])
        # bytes first; any piece of one character replaces them
        score = best[-1][parents] + sizes * byte_score
        count = used[-1][parents] + sizes
        for length, nodes, above, numbers in found:
            s, c = best[-length][above] + scores[numbers], used[-length][above] + 1
            better = (s > score[nodes]) | ((s == score[nodes]) & (c < count[nodes]))
            if length == 1:
                better[:] = True
            score[nodes[better]], count[nodes[better]] = s[better], c[better]
        best.append(score)
        used.append(count)
        if len(best) > pieces.longest:
            best.pop(0)
            used.pop(0)
        ends = by_depth[cut[depth] : cut[depth + 1]]
        out[ends] = count[trie.end_node[ends]]
    for i in (i for i, w in enumerate(words) if len(w) > CHAIN):
        past_best, past_used, node = [], [], trie.end_node[i]
        for back in range(len(best)):
            past_best.append(float(best[-1 - back][node]))
            past_used.append(int(used[-1 - back][node]))
            node = trie.parents[CHAIN - 1 - back][node]
        out[i] = _chain(words[i], pieces, scores, byte_score, past_best[::-1], past_used[::-1])
    return out


def _count(pieces: Pieces, scores: np.ndarray, byte_score: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = bk.utf8(batch.column(1))
            for lo, hi in bk.pieces(offsets, PIECE_BYTES):
                number: dict[str, int] = {}
                rows, distinct = [], []
                for text in bk.strings(offsets, data, lo, hi):
                    own = [number.setdefault(w, len(number)) for w in WORDS.findall(text)]
                    rows.append(np.array(own, dtype=np.int64))
                    distinct.append(len(set(own)))
                counts = best_counts([MARK + w for w in number], pieces, scores, byte_score)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array([len(r) for r in rows], type=pa.int64()),
                        pa.array(distinct, type=pa.int64()),
                        pa.array([int(counts[r].sum()) for r in rows], type=pa.int64()),
                    ],
                    names=["doc_id", "n_words", "n_distinct", "n_tokens"],
                )

    return run


def count_tokens(spark: SparkSession, docs: DataFrame, *, vocabulary: str = SENTENCE_FILE) -> DataFrame:
    """(doc_id, n_words, n_distinct, n_tokens) for each row."""
    known, _ = sentence_pieces(vocabulary)
    scores = rank_scores(len(known))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    run = _count(Pieces(list(known)), scores, float(-np.log(len(known) + 2.0)))
    return plain.mapInArrow(run, "doc_id long, n_words long, n_distinct long, n_tokens long")
