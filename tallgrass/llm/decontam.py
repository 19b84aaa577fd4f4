"""Benchmark items inside documents by size-partitioned MinHash containment.

DataFrame functions only. Items are parted by the size of their shingle sets,
from each power of two to the next. The sketch of an item is its shingles of
smallest hash; a part's sketches have one size, ``HITS`` more than the shingles
that the part's largest item may miss. A document that holds a share t of an
item of n shingles misses at most ``n - ceil(t * n)`` of them, so at least the
rest of the sketch is found in it. The share of the sketch that is found thus
estimates the containment, from below enough: a document is a candidate for an
item when so much of the sketch is found, and no contained item is lost.
Candidates are verified on all shingles, as strings.

Documents have no signature of their own. The smallest hashes of a long
document are nearly all of shingles outside a short item, so a signature that
is to find it must grow with the document until it is the document's whole
set; the set is therefore streamed past the sketches instead, and what is
parted by size are the items, whose sketches must not miss.

Sketches and item shingles are broadcast while their files are small, and
joined by shuffle otherwise. Words are lower-cased runs between white space.

Defined results. Null or word-less items and documents match nothing. An item
of one to four words has its whole sequence as its only shingle, and is
searched among the word sequences of that length. Rows that repeat a doc_id
are one document; rows without one are told apart by their texts. An item is
an item_id, null or not, with a text: different texts under one item_id are
searched apart, and each found one has its row. Other input
columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallgrass.llm.columns import words
from tallgrass.llm.common import Workspace, bounded_broadcast

SIZE, SHARE = 5, (8, 10)
#: Sketch shingles, at least, that a document must hold of an item, where the
#: item has so many.
HITS = 4
#: File bytes up to which sketches or item shingles are broadcast.
BROADCAST_BYTES = 16 << 20


def shingle_rows(rows: DataFrame, keys: list[str], size: int, name: str, hashed: bool) -> DataFrame:
    """One row per ``size`` consecutive words of column w, named or hashed."""
    n = F.greatest(F.size("w") - (size - 1), F.lit(0))
    runs = F.arrays_zip(*[F.slice("w", i + 1, n).alias(f"w{i}") for i in range(size)])
    out = rows.select(*keys, F.explode(runs).alias("s"))
    parts = [F.col("s").getField(f"w{i}") for i in range(size)]
    return out.select(*keys, (F.xxhash64(F.lit(size), *parts) if hashed else F.concat_ws(" ", *parts)).alias(name))


def _worded(rows: DataFrame, keys: list[Column]) -> DataFrame:
    return rows.select(*keys, words(F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("w"))


def doc_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")))


def contained_items(
    spark: SparkSession, docs: DataFrame, items: DataFrame, *, size: int = SIZE, share: tuple[int, int] = SHARE
) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment, key) of found pairs."""
    space = Workspace(spark)
    num, den = share
    listed = _worded(items, [F.col("item_id"), F.xxhash64(F.col("text").cast("string")).alias("item")]).where(F.size("w") > 0)
    listed = listed.withColumn("k", F.least(F.size("w"), F.lit(size)))
    parts = []
    for k in range(1, size + 1):
        some = listed.where(F.col("k") == k)
        parts.append(shingle_rows(some, ["item_id", "item", "k"], k, "shingle", False))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    every = space.save(every.distinct())
    h = F.xxhash64("k", "shingle")
    ranked = every.select(
        "item_id",
        "item",
        "k",
        "shingle",
        F.row_number().over(Window.partitionBy("item_id", "item").orderBy(h, "shingle")).alias("rank"),
        F.count(F.lit(1)).over(Window.partitionBy("item_id", "item")).alias("n_item"),
    )
    # sizes 2**p .. 2**(p+1)-1 form a part
    largest = F.pow(F.lit(2.0), F.floor(F.log2("n_item")) + 1).cast("long") - 1

    def misses(n: Column) -> Column:
        return n - F.ceil(n * num / den)

    held = F.least(F.col("n_item"), misses(largest) + HITS)
    ranked = space.save(
        ranked.select(
            "item_id", "item", "k", "shingle", "n_item",
            (F.col("rank") <= held).alias("sketched"), (held - misses(F.col("n_item"))).alias("least"),
        )
    )

    keyed = _worded(docs, [doc_key().alias("key")])
    found = None
    for k in [r["k"] for r in ranked.select("k").distinct().collect()]:  # at most five values
        pieces = F.split("shingle", " ")
        sketch = ranked.where((F.col("k") == k) & F.col("sketched")).select(
            F.xxhash64(F.lit(k), *[F.get(pieces, F.lit(i)) for i in range(k)]).alias("h"), "item_id", "item", "least"
        )
        sketch = space.save(sketch)
        hits = shingle_rows(keyed, ["key"], k, "h", True).join(bounded_broadcast(sketch, BROADCAST_BYTES), "h")
        some = (
            hits.distinct()
            .groupBy("key", "item_id", "item", "least")
            .agg(F.count(F.lit(1)).alias("hits"))
            .where("hits >= least")
            .select("key", F.lit(k).alias("k"))
        )
        found = some if found is None else found.unionByName(some)
    if found is None:
        return spark.createDataFrame([], "doc_id long, item_id long, n_shared long, n_item long, containment double, key long")
    chosen = space.save(found.distinct())
    full = bounded_broadcast(ranked.select("item_id", "item", "k", "shingle", "n_item"), BROADCAST_BYTES)
    again = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", doc_key().alias("key"))
    again = again.join(chosen.select("key").distinct(), "key", "left_semi")
    again = _worded(again, [F.col("key"), F.col("doc_id")])
    met = None
    for k in [r["k"] for r in chosen.select("k").distinct().collect()]:
        some = shingle_rows(again, ["key", "doc_id"], k, "shingle", False).join(full.where(F.col("k") == k), "shingle")
        met = some if met is None else met.unionByName(some)
    if met is None:
        return spark.createDataFrame([], "doc_id long, item_id long, n_shared long, n_item long, containment double, key long")
    pairs = (
        met.select("key", "doc_id", "item_id", "item", "n_item", "shingle")
        .distinct()
        .groupBy("key", "doc_id", "item_id", "item", "n_item")
        .agg(F.count(F.lit(1)).alias("n_shared"))
        .where(F.lit(den) * F.col("n_shared") >= F.lit(num) * F.col("n_item"))
    )
    return pairs.select(
        "doc_id",
        F.col("item_id").cast("long").alias("item_id"),
        "n_shared",
        "n_item",
        (F.col("n_shared") / F.col("n_item")).alias("containment"),
        "key",
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item."""
    space = Workspace(spark)
    bad = space.save(contained_items(spark, docs, items).select("key").distinct())
    return docs.join(bad, doc_key() == bad["key"], "left_anti")
