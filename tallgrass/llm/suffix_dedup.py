"""Removal of repeated byte strings by bucket-pointer refinement.

A position is repeated if the ``LENGTH`` bytes that start there also start
somewhere else in the corpus. Every byte covered by such a string is removed.

The suffix array is never built whole. Its initial q-gram buckets are taken
only at anchors: in each window of ``LENGTH`` bytes the q-gram of smallest
hash, leftmost on ties. Equal windows choose equal anchors at equal offsets,
so windows can only be equal inside the bucket of one anchor q-gram, and a
bucket of one anchor settles all windows that chose it. The windows of one
anchor form one context, the bytes from its first window's start to its last
window's end; contexts that occur twice are repeated whole.

What is left are buckets of different contexts. They are refined by bucket
pointers (``refine``): the places of all contexts of a bucket are sorted by the
buckets that lie a bucket's depth further on, part by part, and each part that
falls out is pointed to at once by what is sorted after it. A bucket too large for
one task is first cut: the windows of each context in two halves by their
distance from the anchor, each half under the name of the bytes that all its
windows share, and again until a part fits a task or is one whole window.

Defined results. A null text is empty. Matches never cross documents; rows
that repeat a doc_id are separate documents. Texts shorter than ``LENGTH``
bytes lose nothing. Other input columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.llm import bytekit as bk
from tallgrass.llm.common import Workspace

LENGTH = 200
GRAM = 32
#: Contexts of one bucket that one task refines, about 3 MB; larger ones are cut.
IN_TASK = 8000
#: Rows above which a key's rows are dealt over SALTS parts, and how many keys
#: can be so: with more rows in all, the former grows.
HOT, MAX_HOT, SALTS = 10_000, 100_000, 64


def window_minima(grams: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest value in each window of ``width``.

    The upper 40 bits of a value are compared with its place below them, and
    minima of windows of powers of two are joined, so the cost per position
    grows with the logarithm of the width.
    """
    n = len(grams) - width + 1
    block = 1 << 23
    out = np.empty(n, dtype=np.int64)
    for at in range(0, n, block):
        end = min(n, at + block)
        low = (grams[at : end + width - 1] & ~bk.U64(0xFFFFFF)) | np.arange(end - at + width - 1, dtype=bk.U64)
        span = 1
        while span < width:
            step = min(span, width - span)
            low = np.minimum(low[:-step], low[step:])
            span += step
        out[at:end] = (low & bk.U64(0xFFFFFF)).astype(np.int64) + at
    return out


def anchors(data: np.ndarray, length: int, gram: int):
    """(gram hash, context hash, first start, starts) of a text's anchors."""
    prefix = bk.Prefix(data)
    grams = bk.mix(prefix.grams(gram))
    place = window_minima(grams, length - gram + 1)
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    starts = np.diff(np.concatenate([new, [len(place)]]))
    at = place[new]
    context = bk.mix(prefix.ranges(new, new + starts + length - 1))
    context = bk.mix(context + bk.mix((at - new).astype(bk.U64) * bk.U64(0x100000001B3) + starts.astype(bk.U64)))
    return grams[at], context, new, starts


def _anchors(length: int, gram: int):
    names = ["doc", "gram", "context", "first", "starts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            offsets, data = bk.utf8(batch.column(1))
            held, rows = [], 0
            for i in np.flatnonzero(np.diff(offsets) >= length):
                found = anchors(data[offsets[i] : offsets[i + 1]], length, gram)
                held.append((np.full(len(found[0]), ids[i]), *found))
                rows += len(found[0])
                if rows > 100_000:
                    yield _columns(held, names)
                    held, rows = [], 0
            if held:
                yield _columns(held, names)

    return run


def _columns(held: list[tuple], names: list[str]) -> pa.RecordBatch:
    doc, gram, context, first, starts = (np.concatenate(x) for x in zip(*held))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(doc.astype(np.int64)),
            pa.array(gram.view(np.int64)),
            pa.array(context.view(np.int64)),
            pa.array(first.astype(np.int32)),
            pa.array(starts.astype(np.int32)),
        ],
        names=names,
    )


def _contexts(length: int):
    """Bytes of the asked contexts: (text, spans) -> one row per span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = bk.utf8(batch.column(1))
            docs, asked = batch.column(0), batch.column(2)
            out: list[list] = [[], [], [], [], [], []]
            size = 0
            for i in range(batch.num_rows):
                text = data[offsets[i] : offsets[i + 1]]
                for s in asked[i].as_py():
                    first, starts = s["first"], s["starts"]
                    raw = text[first : first + starts + length - 1].tobytes()
                    size += len(raw)
                    for column, value in zip(out, (docs[i].as_py(), s["gram"], s["m"], first, starts, raw)):
                        column.append(value)
                if size > 4 << 20:
                    yield _context_rows(out)
                    out, size = [[], [], [], [], [], []], 0
            if out[0]:
                yield _context_rows(out)

    return run


CONTEXT = "doc long, gram long, m long, first int, starts int, raw binary"


def _context_rows(out: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    names = ["doc", "gram", "m", "first", "starts", "raw"]
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(out, kinds)], names=names)


#: Bytes of an initial bucket in a task, and places that are refined together.
INITIAL, TOGETHER = 32, 1 << 16


def initial_buckets(text: np.ndarray, words: np.ndarray, q: int) -> np.ndarray:
    """Bucket of each place: how many places are below those that share its
    first q bytes. Buckets so named stand in the order of their bytes."""
    _, rank = np.unique(words, return_inverse=True)
    have = 8
    while have < q:
        ahead = np.zeros(len(text), dtype=np.int64)
        ahead[: max(0, len(text) - have)] = rank[have:] + 1
        _, rank = np.unique(rank * (len(text) + 1) + ahead, return_inverse=True)
        have *= 2
    count = np.bincount(rank)
    return (np.cumsum(count) - count)[rank]


def refine(text: np.ndarray, positions: np.ndarray, length: int) -> np.ndarray:
    """Which positions start a ``length``-byte string that starts at another.

    Bucket-pointer refinement: every place points to its bucket, whose members
    agree in ``depth`` bytes. Some buckets at a time are sorted by the buckets
    that their members point to ``depth`` bytes on. A bucket falls apart where
    these differ, and its parts are as much deeper as the buckets pointed to;
    their members point to the parts at once, so that the rest of the recursion
    and the buckets that come later sort by what is refined already. Places
    are done when alone or ``length`` deep. Then the positions are in suffix
    order as far as ``length`` bytes go, and neighbours in different buckets are
    compared byte by byte, for a bucket may have been cut by later bytes.
    """
    n = len(text)
    if not len(positions):
        return positions
    padded = np.zeros(n + 8, dtype=np.uint8)
    padded[:n] = text
    words = np.zeros(n, dtype=bk.U64)
    for k in range(8):
        words = (words << bk.U64(8)) | padded[k : k + n].astype(bk.U64)
    q = 8
    while 2 * q <= min(length, INITIAL):
        q *= 2
    bucket = initial_buckets(text, words, q)
    depth = np.full(n, q, dtype=np.int64)
    size = np.bincount(bucket, minlength=n)
    shared = np.flatnonzero(size[bucket] > 1)
    shared = shared[np.argsort(bucket[shared], kind="stable")]
    edge = np.flatnonzero(np.diff(bucket[shared], prepend=-1))  # where buckets begin
    at = 0
    while at < len(shared):
        end = np.searchsorted(edge, at + TOGETHER)
        end = int(edge[end]) if end < len(edge) else len(shared)
        members = shared[at:end]
        at = end
        while len(members):
            group = bucket[members]
            members = members[depth[group] < length]
            group = bucket[members]
            onward = members + depth[group]
            inside = onward < n
            key = np.where(inside, bucket[np.where(inside, onward, 0)], -1)
            order = np.argsort(group * (n + 1) + key + 1, kind="stable")
            members, group, key = members[order], group[order], key[order]
            if not len(members):
                break
            new_group = np.diff(group, prepend=-1) != 0
            first = np.flatnonzero(new_group | (np.diff(key, prepend=-2) != 0))
            count = np.diff(np.append(first, len(members)))
            begin = np.maximum.accumulate(np.where(new_group, np.arange(len(members)), 0))
            name = group[first] + first - begin[first]
            deeper = depth[group[first]] + np.where(key[first] < 0, length, depth[np.maximum(key[first], 0)])
            bucket[members] = np.repeat(name, count)
            depth[name] = deeper
            members = members[np.repeat(count > 1, count)]
    ranked = positions[np.argsort(bucket[positions], kind="stable")]
    left, right = ranked[:-1], ranked[1:]
    same = bucket[left] == bucket[right]
    maybe = np.flatnonzero(~same)
    for offset in [*range(0, length - 8, 8), length - 8]:
        maybe = maybe[words[left[maybe] + offset] == words[right[maybe] + offset]]
    same[maybe] = True
    twice = np.zeros(len(ranked), dtype=bool)
    twice[:-1] |= same
    twice[1:] |= same
    return ranked[twice]


RUNS = "doc long, first int, starts int"


def _runs(doc: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Runs of consecutive starts in sorted (doc, start)."""
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    columns = (doc[first], start[first], np.diff(np.append(first, len(doc))))
    kinds = (pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(c.astype(np.int64), type=pa.int64()).cast(k) for c, k in zip(columns, kinds)],
        names=["doc", "first", "starts"],
    )


def _repeated(t: pa.Table, length: int) -> pa.RecordBatch:
    doc, first, starts, m = (t[k].to_numpy() for k in ("doc", "first", "starts", "m"))
    offsets, data = bk.utf8(t["raw"])
    owner = np.repeat(np.arange(len(doc)), starts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(starts) - starts, starts)
    same = refine(data, offsets[owner] + within, length)
    row = np.searchsorted(offsets, same, side="right") - 1
    alone = m[row] == 1  # the others are repeated whole already
    row, same = row[alone], same[alone]
    at = first[row] + (same - offsets[row])
    order = np.lexsort((at, doc[row]))
    return _runs(doc[row][order], at[order])


def _refine_buckets(length: int, together: int = 1 << 20):
    """Refines whole buckets of a partition sorted by gram, some at a time.

    Buckets side by side can't disturb each other: a string equal to one in
    another bucket is repeated all the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            gram = batch.column(1).to_numpy()
            edge = np.flatnonzero(gram[1:] != gram[:-1]) + 1
            at = 0
            for end in [*edge.tolist(), batch.num_rows]:
                part = batch.slice(at, end - at)
                if held and size >= together and held[-1].column(1)[-1].as_py() != gram[at]:
                    yield _repeated(pa.Table.from_batches(held).combine_chunks(), length)
                    held, size = [], 0
                held.append(part)
                size += int(np.diff(bk.utf8(part.column(5))[0]).sum())
                at = end
        if held:
            yield _repeated(pa.Table.from_batches(held).combine_chunks(), length)

    return run


def _halves(length: int, gram: int):
    """Cuts each context's windows in two and names both halves' common bytes.

    A window lies at some distance o before the anchor. Windows of distances
    lo..hi all hold the bytes from lo before the anchor to ``length - hi``
    after it, so equal windows meet again under the name of those bytes. With
    lo = hi that name is the whole window.
    """
    names = ["doc", "gram", "m", "first", "starts", "raw", "lo", "hi"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.to_pydict()
            out: list[list] = [[] for _ in names]
            for doc, m, first, starts, raw, lo, hi in zip(*(columns[k] for k in names if k != "gram")):
                data = np.frombuffer(raw, dtype=np.uint8)
                prefix = bk.Prefix(data)
                grams = bk.mix(prefix.grams(gram))
                lead = int(window_minima(grams[: length - gram + 1], length - gram + 1)[0])
                middle = (lo + hi + 1) // 2
                for low, high in ((lo, middle - 1), (middle, hi)):
                    # this context has the distances lead - starts + 1 .. lead
                    x, y = max(low, lead - starts + 1), min(high, lead)
                    if x > y:
                        continue
                    core = prefix.ranges(np.array([lead - low]), np.array([lead + length - high]))
                    name = bk.mix(core + bk.U64(low * 65536 + high))
                    part = (doc, int(name.view(np.int64)[0]), m, first + lead - y, y - x + 1)
                    values = (*part, raw[lead - y : lead - x + length], low, high)
                    for column, value in zip(out, values):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(out, kinds)], names=names)

    return run


def cover(n: int, first: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, int]:
    """(mask of removed bytes, maximal removed runs) for runs of starts."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + starts + length - 1, -1)
    gone = np.cumsum(change[:-1]) > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if n else 0
    return gone, spans


def _strip(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = bk.utf8(batch.column(1))
            size, gone_n, spans_n, marks, kept_text = [], [], [], [], []
            for i, runs in enumerate(batch.column(2)):
                text = data[offsets[i] : offsets[i + 1]]
                found = runs.as_py()
                gone, spans = 0, 0
                if found:
                    mask, spans = cover(
                        len(text),
                        np.array([r["first"] for r in found], dtype=np.int64),
                        np.array([r["starts"] for r in found], dtype=np.int64),
                        length,
                    )
                    gone = int(mask.sum())
                    text = text[~mask]
                size.append(int(offsets[i + 1] - offsets[i]))
                gone_n.append(gone)
                spans_n.append(spans)
                kept_text.append(text.tobytes())
                marks.append(hashlib.sha256(kept_text[-1]).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array(c, type=pa.int64()) for c in (size, gone_n, spans_n)),
                    pa.array(marks, type=pa.string()),
                    pa.array(kept_text, type=pa.binary()),
                ],
                names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return run


def _spread_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """Inner join of places with distinct ``right`` keys. The rows of the keys
    in ``hot``, at most ``MAX_HOT`` by their definition, are dealt over
    ``SALTS`` parts, so that copies without number don't meet in one task."""
    if hot.isEmpty():
        return left.join(right, keys)
    known = F.broadcast(hot.select(*keys, F.lit(True).alias("hot")))
    every = F.sequence(F.lit(0), F.lit(SALTS - 1))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc", "first"), F.lit(SALTS))).otherwise(0).cast("int")
    dealt = left.join(known, keys, "left").withColumn("salt", salt).drop("hot")
    copied = right.join(known, keys, "left").withColumn("salt", F.explode(F.when(F.col("hot"), every).otherwise(F.array(F.lit(0))))).drop("hot")
    return dealt.join(copied, [*keys, "salt"]).drop("salt")


def remove_repeats(
    spark: SparkSession,
    docs: DataFrame,
    *,
    length: int = LENGTH,
    gram: int = GRAM,
    in_task: int = IN_TASK,
    with_text: bool = False,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) per row.

    ``kept`` holds the remaining bytes; a cut may leave part of a character.
    """
    if not 8 <= gram <= length or length < 16:
        raise ValueError("needs 8 <= gram <= length and length >= 16")
    space = Workspace(spark)
    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    # one number per row: repeated doc_ids stay apart, null ones are rows too
    twin = plain.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    renumber = not twin.isEmpty()
    if renumber:
        plain = space.save(plain.withColumn("doc", F.monotonically_increasing_id()))
    else:
        plain = plain.withColumn("doc", F.col("doc_id"))
    rows = plain.select("doc", "text")
    marked = space.save(
        rows.mapInArrow(_anchors(length, gram), "doc long, gram long, context long, first int, starts int")
    )
    # initial buckets; one row of a context stands for all its copies
    # (saved, so that the join can split the rows of a frequent bucket)
    counted = space.save(marked.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    # a key above this share of the rows is hot; there are at most MAX_HOT
    share = max(HOT, marked.count() // MAX_HOT)
    shared = space.save(_spread_join(marked, counted.select("gram"), ["gram"], counted.where(F.col("n") > share)))
    space.drop(marked, counted)
    contexts = shared.groupBy("gram", "context").agg(
        F.count(F.lit(1)).alias("m"), F.min(F.struct("doc", "first", "starts")).alias("s")
    )
    contexts = space.save(contexts.select("gram", "context", "m", "s.doc", "s.first", "s.starts"))
    names = ["gram", "context"]
    copied = contexts.where("m > 1").select(*names)
    whole = _spread_join(shared, copied, names, contexts.where(F.col("m") > share)).select("doc", "first", "starts")
    mixed = contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    asked = contexts.join(mixed, "gram").select("doc", F.struct("gram", "m", "first", "starts", "kinds").alias("s"))
    asked = asked.groupBy("doc").agg(F.collect_list("s").alias("asked"))
    dealt = rows.repartition("doc")
    bytes_of = space.save(dealt.join(asked, "doc").select("doc", "text", "asked").mapInArrow(_contexts(length), CONTEXT))
    found = whole
    fields = ["doc", "gram", "m", "first", "starts", "raw"]
    crowded = space.save(mixed.where(F.col("kinds") > in_task).select("gram"))
    used = [shared, contexts, crowded, bytes_of]
    ready = bytes_of.join(crowded, "gram", "left_anti").select(*fields)
    open_rows = bytes_of.join(crowded, "gram", "left_semi").select(
        *fields, F.lit(0).alias("lo"), F.lit(length - gram).alias("hi")
    )
    while not crowded.isEmpty():
        # a crowded bucket is cut by deeper names until its parts fit a task
        cut = space.save(
            open_rows.mapInArrow(_halves(length, gram), CONTEXT + ", lo int, hi int")
        )
        named = space.save(cut.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("hi") - F.col("lo")).alias("width")).where("n > 1"))
        used += [cut, named]
        equal = cut.join(named.where("width = 0").select("gram"), "gram", "left_semi").where("m = 1")
        found = found.unionByName(equal.select("doc", "first", "starts"))
        fits = named.where((F.col("width") > 0) & (F.col("n") <= in_task)).select("gram")
        ready = ready.unionByName(cut.join(fits, "gram", "left_semi").select(*fields))
        crowded = space.save(named.where((F.col("width") > 0) & (F.col("n") > in_task)).select("gram"))
        used.append(crowded)
        open_rows = cut.join(crowded, "gram", "left_semi")
    ready = ready.repartition("gram").sortWithinPartitions("gram")
    found = found.unionByName(ready.mapInArrow(_refine_buckets(length), RUNS))
    runs = space.save(found)
    space.drop(*used)
    per_doc = runs.groupBy("doc").agg(F.collect_list(F.struct("first", "starts")).alias("runs"))
    schema = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    if not with_text:
        schema = schema.removesuffix(", kept binary")
    done = rows.join(per_doc, "doc", "left").select("doc", "text", "runs").mapInArrow(
        _strip(length) if with_text else _without_text(length), schema
    )
    if not renumber:
        return done.withColumnRenamed("doc", "doc_id")
    ids = plain.select("doc", "doc_id")
    return done.join(ids, "doc").drop("doc").select("doc_id", *[c for c in done.columns if c != "doc"])


def _without_text(length: int):
    run = _strip(length)

    def bare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield batch.drop_columns(["kept"])

    return bare
