"""Streams: keyed rules in the state store, tails of journals, and sinks.

A rule gives on a stream the rows that its batch fold gives, as long as a
key's rows arrive in order: both run the same step. The state of a key is one
small JSON record.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallgrass.operators.folds import Rule


class RuleProcessor(StatefulProcessor):
    """Runs a rule's step over the rows of a key, sorted within a batch."""

    def __init__(self, rule: Rule, order: tuple[str, ...] = ("seq",)):
        self.rule, self.order = rule, list(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.record = handle.getValueState("record", "value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = json.loads(self.record.get()[0]) if self.record.exists() else self.rule.initial()
        frame = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        plain = frame.astype(object).where(frame.notna(), None)
        out = [r for row in plain.to_dict("records") for r in self.rule.step(state, row)]
        self.record.update((json.dumps(state, default=_number),))
        names = [field.split()[0] for field in self.rule.schema.split(", ")]
        yield pd.DataFrame(out, columns=names)

    def close(self) -> None:
        pass


def _number(value):
    """Numbers of array libraries as JSON numbers."""
    return value.item()


def run_rule(events: DataFrame, rule: Rule, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Applies a rule to a stream; needs the RocksDB state store."""
    return events.groupBy(*rule.keys).transformWithStateInPandas(
        statefulProcessor=RuleProcessor(rule, order), outputStructType=rule.schema, outputMode="Append", timeMode="None"
    )


def drop_repeats(events: DataFrame, ident: list[str], time: str, within: str = "5 minutes") -> DataFrame:
    """Approximate repeats by watermark, for sources too many for own state."""
    return events.withWatermark(time, within).dropDuplicatesWithinWatermark(ident)


def latest_by_key(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Latest row of each key, for update mode."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("latest")).select(*keys, "latest.*")


def tail_journal(spark, root: str, schema) -> DataFrame:
    """New lines of journal folders as a stream of events."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").json(root)


def coalesced_sink(stream: DataFrame, root: str, checkpoint: str, every: str = "250 milliseconds"):
    """Starts a query that writes each micro-batch as a version; a repeated
    batch replaces its own version, so a retry leaves one copy."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/version={number:012d}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=every).start()
