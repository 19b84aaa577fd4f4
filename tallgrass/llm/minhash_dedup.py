"""Near-duplicate groups by circulant MinHash, banding and exact verification.

Two permutations make all signature coordinates: the first maps a shingle to
a place in a universe of 2**32, the second is shifted circularly by one place
for each further coordinate (C-MinHash-(sigma, pi)). Bands of coordinates
propose pairs; every link is confirmed on the full shingle sets.

Copies are folded first: documents with equal shingle sets form one class,
represented by its smallest doc_id, and only representatives are banded.
Links within a bucket are then searched in three exact ways, none of which
emits all pairs of a large group:

1. every member is compared with the bucket's smallest member, which joins
   groups of near copies in time linear in their size;
2. in buckets of up to ``SMALL`` members, the pairs still in different
   components are compared;
3. larger buckets are cut in blocks of bounded rows and shingles, once what
   lies outside the bucket's largest component and once all members; a task
   compares one block of the former with one of the latter, holds no more than
   these two, and returns only links that join two components.

Defined results. A null or word-less text has no shingles, is linked with
nothing and is kept. A text of one to four words is one shingle, its whole
sequence. Rows that repeat a doc_id are one document and share its result. A
null doc_id takes the component of an equal set under another doc_id, else
null, and is kept in the latter case only. An empty table gives no rows.
Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.llm import bytekit as bk
from tallgrass.llm.common import Workspace
from tallgrass.llm.components import connected

BANDS, ROWS = 24, 4
SMALL = 8
#: A block of a large bucket has about so many rows and shingles, at most.
BLOCK, BLOCK_SHINGLES = 256, 1 << 21
PIECE_BYTES = 2 << 20


def _universe(shingles: np.ndarray) -> np.ndarray:
    """First permutation: a shingle's place among 2**32."""
    return (bk.mix(shingles ^ bk.U64(0xA24BAED4963EE407)) >> bk.U64(32)).astype(np.uint32)


def signatures(places: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """k circulant MinHash coordinates of each run of places."""
    out = np.empty((k, len(starts)), dtype=np.uint32)
    x, t = np.empty_like(places), np.empty_like(places)
    for i in range(k):
        np.add(places, np.uint32(i + 1), out=x)
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, None)):
            np.right_shift(x, np.uint32(shift), out=t)
            np.bitwise_xor(x, t, out=x)
            if factor is not None:
                np.multiply(x, np.uint32(factor), out=x)
        out[i] = np.minimum.reduceat(x, starts)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(documents, bands) 64-bit bucket keys; a key names its band."""
    keys = np.empty((signature.shape[1], bands), dtype=np.int64)
    for b in range(bands):
        acc = np.full(signature.shape[1], b + 1, dtype=bk.U64)
        for r in range(rows):
            acc = bk.mix(acc * bk.U64(0x9E3779B97F4A7C15) + signature[b * rows + r].astype(bk.U64))
        keys[:, b] = acc.view(np.int64)
    return keys


def set_marks(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent order-free 64-bit names of each set."""
    return (
        np.add.reduceat(bk.mix(hashes), starts).view(np.int64),
        np.add.reduceat(bk.mix(hashes ^ bk.U64(0xD1B54A32D192ED03)), starts).view(np.int64),
    )


def _sign(bands: int, rows: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            offsets, data = bk.utf8(batch.column(1))
            for lo, hi in bk.pieces(offsets, PIECE_BYTES):
                part = offsets[lo : hi + 1] - offsets[lo]
                text = bk.LOWER[data[offsets[lo] : offsets[hi]]]
                hashes, first = bk.shingle_sets(part, text, size)
                count = np.diff(first)
                full = np.flatnonzero(count)
                one, two = np.zeros(hi - lo, dtype=np.int64), np.zeros(hi - lo, dtype=np.int64)
                keys = np.zeros((len(full), bands), dtype=np.int64)
                if len(full):
                    starts = first[full]
                    one[full], two[full] = set_marks(hashes, starts)
                    keys = band_keys(signatures(_universe(hashes), starts, bands * rows), bands, rows)
                at = np.zeros(hi - lo + 1, dtype=np.int32)
                np.cumsum(np.where(count > 0, bands, 0), out=at[1:])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo),
                        pa.array(count.astype(np.int64)),
                        pa.array(one),
                        pa.array(two),
                        pa.ListArray.from_arrays(pa.array(at), pa.array(keys.reshape(-1))),
                    ],
                    names=["doc_id", "n_shingles", "m1", "m2", "bands"],
                )

    return run


def _sets(size: int):
    """Shingle sets of (rep, n, m1, m2, bands, text) whose marks agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = bk.utf8(batch.column(5))
            m1, m2 = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for lo, hi in bk.pieces(offsets, PIECE_BYTES):
                part = offsets[lo : hi + 1] - offsets[lo]
                hashes, first = bk.shingle_sets(part, bk.LOWER[data[offsets[lo] : offsets[hi]]], size)
                rows, sets = [], []
                for i in range(hi - lo):
                    own = hashes[first[i] : first[i + 1]]
                    if len(own):
                        a, b = set_marks(own, np.zeros(1, dtype=np.int64))
                        if a[0] == m1[lo + i] and b[0] == m2[lo + i]:
                            rows.append(lo + i)
                            sets.append(own.tobytes())
                kept = batch.take(pa.array(rows, type=pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [kept.column(0), kept.column(1), kept.column(4), pa.array(sets, type=pa.binary())],
                    names=["rep", "n", "bands", "shingles"],
                )

    return run


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _confirm(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            x, y = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                a = np.frombuffer(x[i].as_py(), dtype=bk.U64)
                b = np.frombuffer(y[i].as_py(), dtype=bk.U64)
                both = _shared(a, b)
                keep.append(den * both >= num * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, type=pa.bool_()))

    return run


def _block_links(num: int, den: int):
    """Links between two blocks of a bucket that join two components.

    Columns: key, i, j, outside, main, rep, component, n, bands, shingles. The
    rows that carry ``outside`` form block i of what lies outside the bucket's
    main component; the others are block j of all its rows. A pair is compared
    in the first band in which it meets, and only while its ends are apart.
    """

    def run(group: pa.Table) -> pa.Table:
        t = group.combine_chunks()
        key = t["key"][0].as_py()
        rep, component, n = (t[c].to_numpy() for c in ("rep", "component", "n"))
        outside, main = (t[c].to_numpy(zero_copy_only=False) for c in ("outside", "main"))
        bands = np.array(t["bands"].to_pylist(), dtype=np.int64)
        band = int(np.flatnonzero(bands[0] == key)[0])
        sets = [np.frombuffer(x, dtype=bk.U64) for x in t["shingles"].to_pylist()]
        links, root = [], component.copy()
        left, right = np.flatnonzero(outside), np.flatnonzero(~outside)
        if len(left) and len(right):
            names, flat = np.unique(np.concatenate([sets[i] for i in right]), return_inverse=True)
            starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in right])[:-1]]).astype(np.int64)
        else:
            left = left[:0]
        for i in left:
            # two rows outside the main component meet in either's blocks
            able = (root[right] != root[i]) & (main[right] | (rep[right] > rep[i]))
            able &= den * np.minimum(n[right], n[i]) >= num * np.maximum(n[right], n[i])
            if band:
                able &= ~(bands[right, :band] == bands[i, :band]).any(axis=1)
            if not able.any():
                continue
            at = np.searchsorted(names, sets[i])
            at[at == len(names)] = 0
            mine = np.zeros(len(names), dtype=np.int32)
            mine[at[names[at] == sets[i]]] = 1
            both = np.add.reduceat(mine[flat], starts)
            linked = able & (den * both >= num * (n[right] + n[i] - both))
            for j in right[linked]:
                if root[i] != root[j]:
                    links.append((int(rep[i]), int(rep[j])))
                    low, high = sorted((root[i], root[j]))
                    root[root == high] = low
        return pa.table(
            {"a": pa.array([x[0] for x in links], type=pa.int64()), "b": pa.array([x[1] for x in links], type=pa.int64())}
        )

    return run


def _compare(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    x = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    y = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    met = pairs.join(x, "a").join(y, "b").select("a", "b", "sa", "sb")
    return met.mapInArrow(_confirm(num, den), "a long, b long")


def near_duplicates(
    spark: SparkSession,
    docs: DataFrame,
    *,
    num: int = 85,
    den: int = 100,
    size: int = 5,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Documents are linked where ``den * |A & B| >= num * |A | B|``. At a
    similarity of 0.85, 24 bands of 4 miss a pair with a chance of 2e-8.
    """
    space = Workspace(spark)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = space.save(
        plain.mapInArrow(_sign(bands, rows, size), "doc_id long, n_shingles long, m1 long, m2 long, bands array<long>")
    )
    mark = ["n_shingles", "m1", "m2"]
    full = signed.where("n_shingles > 0")
    # (saved, so that the join can split the rows of a large class)
    classes = space.save(full.groupBy(*mark).agg(F.min("doc_id").alias("rep")))
    members = space.save(
        full.join(classes, mark).select(
            "doc_id", *mark, "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("bands")).alias("bands")
        )
    )
    empty = space.save(signed.where("n_shingles = 0").select("doc_id"))
    space.drop(signed, classes)
    reps = members.where("bands is not null").select("rep", F.col("n_shingles").alias("n"), "m1", "m2", "bands")
    banded = reps.select("rep", "n", F.explode("bands").alias("key")).distinct()
    buckets = space.save(
        banded.groupBy("key").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("m")).where("m > 1")
    )
    hits = space.save(banded.join(buckets, "key").select("key", "rep", "n", "leader", "m"))

    chosen = hits.select("rep").distinct()
    sets = space.save(
        reps.join(chosen, "rep", "left_semi")
        .join(plain, F.col("rep") == F.col("doc_id"))
        .select("rep", "n", "m1", "m2", "bands", "text")
        .mapInArrow(_sets(size), "rep long, n long, bands array<long>, shingles binary")
    )
    sizes = sets.select("rep", "n").distinct()

    # 1: everyone against the smallest member of its buckets
    stars = hits.where("rep <> leader").select(F.col("rep").alias("a"), F.col("leader").alias("b"), "n").distinct()
    stars = (
        stars.join(sizes.select(F.col("rep").alias("b"), F.col("n").alias("nb")), "b")
        .where(F.lit(den) * F.least("n", "nb") >= F.lit(num) * F.greatest("n", "nb"))
        .select("a", "b")
    )
    links = space.save(_compare(stars, sets, num, den))
    parts = connected(space, links)
    placed = space.save(
        hits.join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
            "component", F.coalesce("component", "rep")
        )
    )
    # a bucket's components, the largest of which is its main one
    parted = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("shingles"))
    open_keys = space.save(
        parted.groupBy("key")
        .agg(
            F.count(F.lit(1)).alias("components"),
            F.max(F.struct("c", "component", "shingles")).alias("main"),
            F.sum("c").alias("rows"),
            F.sum("shingles").alias("shingles"),
        )
        .where("components > 1")
        .select(
            "key",
            F.col("main.component").alias("main"),
            F.greatest(F.ceil(F.col("rows") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).alias("js"),
            F.greatest(
                F.ceil((F.col("rows") - F.col("main.c")) / BLOCK),
                F.ceil((F.col("shingles") - F.col("main.shingles")) / BLOCK_SHINGLES),
            ).alias("is"),
        )
    )
    rest = space.save(placed.join(open_keys, "key").withColumn("main", F.col("component") == F.col("main")))
    space.drop(placed, open_keys, buckets)

    # 2: the pairs of small buckets
    few = rest.where(F.col("m") <= SMALL).select("key", "rep", "n", "leader", "component")
    other = few.select("key", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"))
    pairs = (
        few.where("rep <> leader")
        .join(other, "key")
        .where("rep < b and component <> cb")
        .where(F.lit(den) * F.least("n", "nb") >= F.lit(num) * F.greatest("n", "nb"))
        .select(F.col("rep").alias("a"), "b")
        .distinct()
    )
    more = _compare(pairs, sets, num, den)

    # 3: blocks of large buckets, what is outside the main component with all
    many = rest.where(F.col("m") > SMALL)
    columns = ["key", "i", "j", "outside", "main", "rep", "component"]

    def block(count: str, salt: int):
        return F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(count))

    def visits(count: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

    outer = many.where(~F.col("main")).withColumn("outside", F.lit(True)).withColumn("i", block("is", 1)).withColumn("j", visits("js"))
    inner = many.withColumn("outside", F.lit(False)).withColumn("j", block("js", 2)).withColumn("i", visits("is"))
    dealt = outer.select(*columns).unionByName(inner.select(*columns)).join(sets, "rep")
    found = dealt.groupBy("key", "i", "j").applyInArrow(_block_links(num, den), "a long, b long")
    every = space.save(links.unionByName(more).unionByName(found))
    final = connected(space, every)
    joined = members.join(final.withColumnRenamed("node", "rep"), "rep", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id")
    )
    out = joined.unionByName(
        empty.select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    )
    result = out.select(
        "doc_id",
        "n_shingles",
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"),
    )
    space.drop(hits, rest, sets, links, every)
    return result
