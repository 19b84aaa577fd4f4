"""PCM audio as arrays: resampling and 16-bit coding, on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as Y


def resample(samples: np.ndarray, source: int, target: int) -> np.ndarray:
    """Linear interpolation from one rate to another."""
    if source == target or not len(samples):
        return samples
    n = max(1, int(np.floor(len(samples) * target / source)))
    at = np.arange(n) * (source / target)
    return np.interp(at, np.arange(len(samples)), samples)


def resampler(source: int, target: int):
    """Column function: PCM16 bytes at one rate to another."""

    @F.pandas_udf(Y.BinaryType())
    def run(chunks: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in chunks:
            yield series.map(
                lambda raw: None
                if raw is None
                else np.rint(resample(np.frombuffer(raw[: len(raw) // 2 * 2], "<i2").astype(float), source, target)).astype("<i2").tobytes()
            )

    return run


class StreamResampler:
    """Resampling of a stream in chunks; the phase carries over, so chunks
    give what the whole would. Places are kept as whole numbers: output k lies
    at k * source / target of the input."""

    def __init__(self, source: int, target: int):
        self.source, self.target = source, target
        self.made = self.dropped = 0
        self.tail = np.zeros(0)

    def push(self, chunk: np.ndarray) -> np.ndarray:
        data = np.concatenate([self.tail, np.asarray(chunk, dtype=float)])
        last = self.dropped + len(data) - 1  # the outputs before it can be made
        stop = max(self.made, -(-last * self.target // self.source)) if len(data) else self.made
        places = np.arange(self.made, stop) * self.source - self.dropped * self.target
        out = np.interp(places / self.target, np.arange(len(data)), data) if len(places) else np.zeros(0)
        self.made = stop
        gone = min(max(0, self.made * self.source // self.target - self.dropped), max(0, len(data) - 1))
        self.tail, self.dropped = data[gone:], self.dropped + gone
        return out


@F.pandas_udf(Y.BinaryType())
def encode_pcm16(samples: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Floats in -1..1 to little-endian 16-bit; the halves scale apart."""

    def run(values):
        if values is None:
            return None
        x = np.clip(np.asarray(values, dtype=float), -1, 1)
        return np.where(x < 0, x * 0x8000, x * 0x7FFF).astype("<i2").tobytes()

    for series in samples:
        yield series.map(run)


@F.pandas_udf(Y.ArrayType(Y.FloatType()))
def decode_pcm16(chunks: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def run(raw):
        if raw is None:
            return None
        return (np.frombuffer(raw[: len(raw) // 2 * 2], "<i2") / 0x8000).astype("float32").tolist()

    for series in chunks:
        yield series.map(run)
