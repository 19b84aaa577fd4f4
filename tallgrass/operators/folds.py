"""Ordered folds: rules whose next answer depends on all answers before.

A rule is written once, as a step over a small state, and runs in two ways: as
a batch fold that streams over rows sorted by key and order and holds the
state of one key only, and as a stream processor that keeps the state in the
state store (``tallgrass.streaming``). Keys are dealt over the cluster by
hash; a key's own rows are one sequence by definition, so a key of any size
needs bounded memory but is one task's work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

Row = dict
State = dict


def _none(state: State) -> Iterable[tuple]:
    return ()


@dataclass(frozen=True)
class Rule:
    """A keyed rule.

    ``initial()`` gives a new key's state, a dict that JSON can hold.
    ``step(state, row)`` changes it and returns the rows to emit; ``end(state)``
    returns those to emit after a batch key's last row. Emitted rows fit
    ``schema``.
    """

    keys: tuple[str, ...]
    schema: str
    initial: Callable[[], State]
    step: Callable[[State, Row], Iterable[tuple]]
    end: Callable[[State], Iterable[tuple]] = _none


def fold(df: DataFrame, rule: Rule, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Folds each key's rows in order, which must be total within a key."""
    schema: StructType = _parse_datatype_string(rule.schema)
    arrow, keys = to_arrow_schema(schema), rule.keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state, out = None, None, []

        def emitted():
            return pa.RecordBatch.from_pylist([dict(zip(arrow.names, r)) for r in out], schema=arrow)

        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != here:
                    if state is not None:
                        out.extend(rule.end(state))
                    here, state = key, rule.initial()
                out.extend(rule.step(state, row))
            if out:
                yield emitted()
                out = []
        if state is not None:
            out.extend(rule.end(state))
        if out:
            yield emitted()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
