"""Segmentation lattices over a trie of distinct words.

Words that share a prefix share its lattice: a trie node stands for a prefix,
and the ways to end a piece there depend on that prefix alone. Nodes are kept
by depth as arrays, so a step works on all prefixes of one length at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
_STEP = U64(0xBF58476D1CE4E5B9)
_FILTER_BITS = 22


def _code(chars: np.ndarray) -> np.ndarray:
    x = (chars.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15)
    return x ^ (x >> U64(29))


def _slot(h: np.ndarray) -> np.ndarray:
    return (h * U64(0x94D049BB133111EB)) >> U64(64 - _FILTER_BITS)


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return flat, np.fromiter(map(len, words), dtype=np.int64, count=len(words))


class Pieces:
    """A fixed set of pieces, found by the hash of their code points."""

    def __init__(self, pieces: list[str]):
        flat, lengths = code_points(pieces)
        hashes = np.zeros(len(pieces), dtype=U64)
        starts = np.cumsum(lengths) - lengths
        for d in range(int(lengths.max(initial=0))):
            some = lengths > d
            hashes[some] = hashes[some] * _STEP + _code(flat[starts[some] + d])
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        if (self.sorted[1:] == self.sorted[:-1]).any():
            raise ValueError("pieces repeat or collide")
        self.longest = int(lengths.max(initial=0))
        self.filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.filter[_slot(hashes)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``hashes`` that are pieces, their piece numbers)."""
        maybe = np.flatnonzero(self.filter[_slot(hashes)])
        at = np.searchsorted(self.sorted, hashes[maybe])
        at[at == len(self.sorted)] = 0
        hit = self.sorted[at] == hashes[maybe]
        return maybe[hit], self.order[at[hit]]

    def inside(self, word: str, low: int, high: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Pieces of a word that end at a place in low..high-1: for each piece
        length (length, places of the last characters, piece numbers)."""
        begin = max(0, low - self.longest + 1)
        codes = _code(code_points([word[begin:high]])[0])
        grown = codes.copy()  # hashes of the runs of ``length`` from each place
        for length in range(1, min(self.longest, high) + 1):
            if length > 1:
                grown = grown[:-1] * _STEP + codes[length - 1 :]
            if not len(grown):
                break
            places, numbers = self.find(grown)
            ends = places + (begin + length - 1)
            yield length, ends[ends >= low], numbers[ends >= low]


class Trie:
    """Distinct words by depth.

    ``parents[d]`` and ``chars[d]`` describe the nodes of depth d + 1;
    ``ends`` gives (depth, node) of each word in its given order.
    """

    def __init__(self, words: list[str]):
        ranked = sorted(range(len(words)), key=words.__getitem__)
        flat, lengths = code_points([words[i] for i in ranked])
        starts = np.cumsum(lengths) - lengths
        node = np.zeros(len(words), dtype=np.int64)
        self.parents: list[np.ndarray] = []
        self.chars: list[np.ndarray] = []
        end_depth, end_node = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        active = np.flatnonzero(lengths > 0)
        depth = 0
        while len(active):
            chars, above = flat[starts[active] + depth], node[active]
            new = np.ones(len(active), dtype=bool)
            new[1:] = (chars[1:] != chars[:-1]) | (above[1:] != above[:-1])
            node[active] = np.cumsum(new) - 1
            self.parents.append(above[new])
            self.chars.append(chars[new])
            depth += 1
            done = active[lengths[active] == depth]
            end_depth[done], end_node[done] = depth, node[done]
            active = active[lengths[active] > depth]
        self.end_depth, self.end_node = np.empty_like(end_depth), np.empty_like(end_node)
        self.end_depth[ranked], self.end_node[ranked] = end_depth, end_node

    def ends_at(self, depth: int) -> np.ndarray:
        return np.flatnonzero(self.end_depth == depth)

    def levels(self, pieces: Pieces) -> Iterator[tuple[int, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]]:
        """For each depth its piece endings: (piece length, nodes, ancestor
        nodes at depth - length, piece numbers)."""
        hashes = [np.zeros(1, dtype=U64)]
        for d, (parents, chars) in enumerate(zip(self.parents, self.chars), start=1):
            own = hashes[-1][parents] * _STEP + _code(chars)
            found, power, above = [], U64(1), np.arange(len(own))
            for length in range(1, min(d, pieces.longest) + 1):
                above = self.parents[d - length][above]
                power = np.multiply(power, _STEP)
                nodes, numbers = pieces.find(own - hashes[-length][above] * power)
                if len(nodes):
                    found.append((length, nodes, above[nodes], numbers))
            hashes.append(own)
            if len(hashes) > pieces.longest:
                hashes.pop(0)
            yield d, found
