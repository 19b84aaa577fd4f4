"""Mixing sources to target weights by blocks, shards and index permutations.

The words of each source form one stream. Rows are dealt into chunks by a hash
and follow each other by doc_id inside a chunk; the words of a chunk are cut in
blocks of a fixed length, of which only a chunk's last may be shorter. Blocks
of a source are numbered on over its chunks.

The output has a fixed number of shards. Each shard draws how many of its slots
each source fills from a multinomial; its chances are what the sources lack of
their share of all slots up to this shard, so that a draw's luck is made good
by later shards and the totals stay near the targets. What a source gives is
what was drawn: the slots of a source are numbered on across shards, and slot q
takes the block at place ``q mod n`` of permutation ``q div n`` of the source's
n blocks. Slots and blocks meet by (source, block), inside the chunk that holds
the block, so that texts are shuffled once; the output is a row per slot of a
shard with the words of its block, and what is taken of each document is
counted on that output. Slots of a shard are permuted too, so that sources
alternate.

A permutation is a swap-or-not shuffle: a bijection of any length, computed
for one index from a seed, so that no list of indices is ever shuffled.

Targets. Sources in code point order, null last, weigh 1, 2, 3 and so on in
turn, and share the size of all sources by weight. A target stops at three
times its source's size; the excess is shared again by weight.

Defined results. A null text has size 0 and takes nothing; a null source is a
source of its own; rows that repeat a doc_id are separate documents. A source
without words has target 0. Other input columns are ignored; an empty table
gives no rows. No document is taken more than three times. The driver holds
one row per source, at most ``MAX_SOURCES`` (beyond it the operator stops with
an error), and one number per source and shard.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallgrass.llm import bytekit as bk
from tallgrass.llm.columns import words
from tallgrass.llm.common import Workspace, bounded_broadcast

WEIGHTS = (1, 2, 3)
CAP = 3
#: Words of a block, and shards of the output.
BLOCK, SHARDS, MAX_SOURCES = 16, 512, 20_000
#: About so many rows and words are in a chunk, at most.
CHUNK_ROWS, CHUNK_WORDS = 2000, 1_000_000
#: Slots of a row before they are spread, and of a task that spreads them.
SPREAD, SLOTS_A_TASK, MAX_TASKS = 4096, 200_000, 20_000
#: Blocks of one key by which slots find their chunk.
RANGE = 1 << 15
BROADCAST_BYTES = 16 << 20
ROUNDS = 12
WORDS = re.compile(rb"[^\x20\x09-\x0d]+")


def fill_targets(sizes: list[int], weights: list[int], cap: int = CAP) -> list[Fraction]:
    """Shares of the sum of sizes by weight, none above cap times its size."""
    targets = [Fraction(0)] * len(sizes)
    left, free = Fraction(sum(sizes)), [i for i, s in enumerate(sizes) if s > 0]
    while free:
        total = sum(weights[i] for i in free)
        above = [i for i in free if left * weights[i] > cap * sizes[i] * total]
        if not above:
            for i in free:
                targets[i] = left * weights[i] / total
            break
        for i in above:
            targets[i] = Fraction(cap * sizes[i])
            left -= targets[i]
        free = [i for i in free if i not in set(above)]
    return targets


def draw_shards(wanted: np.ndarray, most: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources) slot counts, drawn shard by shard.

    ``wanted`` are the slots that the sources should fill, not whole numbers,
    and ``most`` those that they can fill.
    """
    total = min(int(round(float(wanted.sum()))), int(most.sum()))
    if wanted.sum() > 0:
        total = max(total, 1)
    out = np.zeros((shards, len(wanted)), dtype=np.int64)
    drawn = np.zeros(len(wanted), dtype=np.int64)
    for m in range(shards):
        rng = np.random.default_rng([seed, m])
        due = total * (m + 1) // shards
        need = due - total * m // shards
        while need > 0:
            lacking = np.where(drawn < most, np.maximum(wanted * (due / total) - drawn, 0.0), 0.0)
            if not lacking.sum() > 0:
                lacking = np.where(drawn < most, wanted, 0.0)
            found = np.minimum(rng.multinomial(need, lacking / lacking.sum()), most - drawn)
            out[m] += found
            drawn += found
            need -= int(found.sum())
    return out


def shuffled(place: np.ndarray, n: np.ndarray, source: np.ndarray, epoch: np.ndarray, seed: int) -> np.ndarray:
    """Swap-or-not shuffle of each place in 0..n-1, keyed by source and epoch."""
    x, n = place.astype(bk.U64), n.astype(bk.U64)
    name = bk.mix(bk.mix(source.astype(bk.U64) + bk.U64(seed + 1)) + epoch.astype(bk.U64))
    for r in range(1, ROUNDS + 1):
        key = bk.mix(name + bk.U64(2 * r)) % n
        partner = np.where(key >= x, key - x, key + (n - x))
        side = bk.mix(bk.mix(name + bk.U64(2 * r + 1)) + np.maximum(x, partner))
        x = np.where(side & bk.U64(1) == 1, partner, x)
    return x.astype(np.int64)


def permuted(place: Column, n: Column, source: Column, epoch: Column, seed: int) -> Column:
    """``shuffled`` as a column of longs, a batch of rows at a time."""

    def run(place: pa.Array, n: pa.Array, source: pa.Array, epoch: pa.Array) -> pa.Array:
        return pa.array(shuffled(*(v.to_numpy(zero_copy_only=False).astype(np.int64) for v in (place, n, source, epoch)), seed))

    return F.arrow_udf(run, "long")(place, n, source, epoch)


def _take(seed: int):
    """(shard, slot, k, b) of slots: both permutations in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, k, first, base, total, n, q = (batch.column(c).to_numpy() for c in ("shard", "k", "first", "base", "total", "n", "q"))
            slot = shuffled(base + q - first, total, np.full(len(q), -1), shard, seed + 2)
            b = shuffled(q % n, n, k, q // n, seed)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (shard, slot, k, b)], names=["shard", "slot", "k", "b"])

    return run


NAMED = "k long, source string, source_size long, target double"


def _sources(spark: SparkSession, sized: DataFrame) -> tuple[DataFrame, list[int], list[Fraction]]:
    """(one row per source, sizes, targets), sources in order."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows = sorted(rows, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in rows]
    targets = fill_targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(rows))])
    named = spark.createDataFrame([(i, r["source"], s, float(t)) for i, (r, s, t) in enumerate(zip(rows, sizes, targets))], NAMED)
    if sum(len((r["source"] or "").encode()) + 32 for r in rows) <= BROADCAST_BYTES:
        named = F.broadcast(named)
    return named, sizes, targets


def _slots(spark: SparkSession, counts: np.ndarray, blocks: np.ndarray, seed: int) -> DataFrame:
    """(shard, slot, k, b) of each slot: its source and the block it takes."""
    first = np.cumsum(counts, axis=0) - counts
    base = np.cumsum(counts, axis=1) - counts
    m, k = np.nonzero(counts)
    columns = {"shard": m, "k": k, "first": first[m, k], "slots": counts[m, k], "base": base[m, k], "total": counts.sum(axis=1)[m], "n": blocks[k]}
    drawn = spark.createDataFrame(pa.table({c: pa.array(v.astype(np.int64)) for c, v in columns.items()}))
    tasks = int(min(MAX_TASKS, max(spark.sparkContext.defaultParallelism, counts.sum() // SLOTS_A_TASK)))
    spread = (
        drawn.withColumn("s", F.explode(F.expr(f"sequence(0L, slots - 1, {SPREAD}L)")))
        .repartition(tasks, "k", "first", "s")
        .withColumn("q", F.explode(F.expr(f"sequence(first + s, first + least(s + {SPREAD}L, slots) - 1)")))
    )
    asked = spread.select("shard", "k", "first", "base", "total", "n", "q")
    return asked.mapInArrow(_take(seed), "shard long, slot long, k long, b long")


OUT = "shard long, slot long, k long, block long, text string, parts array<struct<start:long,doc_id:long,words:long>>"


def _pack(block: int):
    """Packs a chunk's documents in blocks and gives each slot its block.

    Left: doc_id, mark and text of documents with words. Right: k, shard,
    slot and b of slots, with the chunk's first block and first word.
    """

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema(
            [("shard", pa.int64()), ("slot", pa.int64()), ("k", pa.int64()), ("block", pa.int64()), ("text", pa.string()),
             ("parts", pa.list_(pa.struct([("start", pa.int64()), ("doc_id", pa.int64()), ("words", pa.int64())])))]
        )
        if not right.num_rows or not left.num_rows:
            return schema.empty_table()
        order = pc.sort_indices(left, sort_keys=[("doc_id", "ascending"), ("mark", "ascending")], null_placement="at_start")
        left = left.take(order)
        right = right.combine_chunks()
        offsets, data = bk.utf8(left["text"])
        raw = data.tobytes()
        held: list[bytes] = []
        begin = np.empty(left.num_rows, dtype=np.int64)
        for i, (a, z) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            begin[i] = len(held)
            held += WORDS.findall(raw, a, z)
        total = len(held)
        # a block's words with a space between: pieces of all words so joined
        joined = b" ".join(held)
        ends = np.cumsum(np.fromiter(map(len, held), dtype=np.int64, count=total) + 1)
        cut = np.arange(0, total, block)
        low = np.where(cut > 0, ends[cut - 1], 0).tolist()
        high = (ends[np.minimum(cut + block, total) - 1] - 1).tolist()
        texts = pa.array([joined[a:z] for a, z in zip(low, high)], type=pa.binary()).cast(pa.string())
        # pieces between the bounds of blocks and documents
        edge = np.unique(np.concatenate([cut, begin]))
        doc = np.searchsorted(begin, edge, side="right") - 1
        length = np.diff(np.append(edge, total))
        origin = right["origin"][0].as_py()
        parts = pa.StructArray.from_arrays(
            [pa.array(begin[doc] + origin), left["doc_id"].combine_chunks().take(pa.array(doc)), pa.array(length)],
            names=["start", "doc_id", "words"],
        )
        starts = np.append(np.searchsorted(edge, cut), len(edge)).astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(starts), parts)
        at = pa.array(right["b"].to_numpy() - right["base"].to_numpy())
        return pa.Table.from_arrays(
            [right["shard"], right["slot"], right["k"], right["b"], texts.take(at), listed.take(at)], schema=schema
        )

    return run


def _mixed(space: Workspace, docs: DataFrame, seed: int, block: int, shards: int) -> tuple[DataFrame, DataFrame]:
    """(one row per document with its place, one row per slot of a shard)."""
    spark = space.spark
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.size(words(text)).cast("long").alias("size"),
        F.xxhash64(text).alias("mark"),
        text.alias("text"),
    )
    sized = space.save(rows.drop("text"))
    named, sizes, targets = _sources(spark, sized)
    chunks = max(1, sized.count() // CHUNK_ROWS, sum(sizes) // CHUNK_WORDS)

    def chunked(df: DataFrame) -> DataFrame:
        known = named.select("k", F.col("source").alias("_source"), "source_size", "target")
        met = df.join(known, df["source"].eqNullSafe(F.col("_source"))).drop("_source")
        return met.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(chunks)))

    # the chunks' first words and blocks, by running sums over chunks
    before = Window.partitionBy("k").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    count = F.ceil(F.col("words") / block)
    offsets = space.save(
        chunked(sized)
        .where("size > 0")
        .groupBy("k", "chunk")
        .agg(F.sum("size").alias("words"))
        .select(
            "k",
            "chunk",
            F.coalesce(F.sum("words").over(before), F.lit(0)).alias("origin"),
            F.coalesce(F.sum(count).over(before), F.lit(0)).alias("base"),
            count.alias("blocks"),
        )
    )
    # rows equal in doc_id and text may swap places
    inside = Window.partitionBy("k", "chunk").orderBy("doc_id", "mark").rowsBetween(Window.unboundedPreceding, -1)
    within = chunked(sized).withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    places = space.save(
        within.join(offsets.select("k", "chunk", "origin"), ["k", "chunk"], "left").select(
            "doc_id", "source", "size", "k", "source_size", "target",
            F.when(F.col("size") > 0, F.col("origin") + F.col("within")).alias("start"),
        )
    )

    blocks = np.zeros(len(sizes), dtype=np.int64)
    for r in offsets.groupBy("k").agg(F.sum("blocks").alias("n")).collect():  # a row per source
        blocks[r["k"]] = r["n"]
    wanted = np.array([float(t * int(n) / s) if s else 0.0 for s, t, n in zip(sizes, targets, blocks)])
    counts = draw_shards(wanted, CAP * blocks, shards, seed) if blocks.sum() else np.zeros((0, len(sizes)), dtype=np.int64)
    # a slot's block lies in the chunk whose range holds it
    spans = F.sequence(F.floor(F.col("base") / RANGE), F.floor((F.col("base") + F.col("blocks") - 1) / RANGE))
    ranges = space.save(offsets.select("*", F.explode(spans).alias("r")))
    asked = (
        _slots(spark, counts, blocks, seed)
        .withColumn("r", F.floor(F.col("b") / RANGE))
        .join(bounded_broadcast(ranges, BROADCAST_BYTES), ["k", "r"])
        .where("b >= base and b < base + blocks")
        .select("k", "chunk", "shard", "slot", "b", "base", "origin")
    )
    texts = chunked(rows.drop("size").where(F.col("text").rlike("[^ \\t-\\r]"))).select("k", "chunk", "doc_id", "mark", "text")
    packed = texts.groupBy("k", "chunk").cogroup(asked.groupBy("k", "chunk")).applyInArrow(_pack(block), OUT)
    out = space.save(packed, compression="zstd")
    space.drop(sized, offsets, ranges)
    return places, out.join(named.select("k", "source"), "k")


def mixed_blocks(spark: SparkSession, docs: DataFrame, *, seed: int = 20, block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """The mix: (shard, slot, source, block, text, parts) for each slot.

    ``text`` has the block's words with a space between; ``parts`` names the
    documents that they come from, with their place in the source's stream and
    their number of words. Slots of a shard count from 0 without gaps.
    """
    out = _mixed(Workspace(spark), docs, seed, block, shards)[1]
    return out.select("shard", "slot", "source", "block", "text", "parts")


def mix(spark: SparkSession, docs: DataFrame, *, seed: int = 20, block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, n_slots, first_shard,
    first_slot) for each row, where ``taken`` counts the document's words in
    the output of the mix, ``n_slots`` the slots that hold some of them, and
    the last two name the first of these, null if there is none."""
    places, out = _mixed(Workspace(spark), docs, seed, block, shards)
    per_doc = (
        out.select("k", "shard", "slot", F.explode("parts").alias("p"))
        .groupBy("k", F.col("p.start").alias("start"))
        .agg(F.sum("p.words").alias("taken"), F.count(F.lit(1)).alias("n_slots"), F.min(F.struct("shard", "slot")).alias("first"))
    )
    return places.join(per_doc, ["k", "start"], "left").select(
        "doc_id",
        "size",
        "source_size",
        "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        "source",
        F.coalesce("n_slots", F.lit(0)).alias("n_slots"),
        F.col("first.shard").alias("first_shard"),
        F.col("first.slot").alias("first_slot"),
    )
