"""Filtering forms of the operators: documents in, documents out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.llm.common import Workspace, unused
from tallgrass.llm.decontam import doc_key
from tallgrass.llm.minhash_dedup import near_duplicates
from tallgrass.llm.mixing import mix

#: Least similarity of near copies in hundredths; 24 bands of 4 miss a pair at
#: it with a chance of about 3e-6.
NEAR = 80


def drop_near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate group, with its own columns.

    Copies are near from a similarity of ``NEAR`` hundredths, below op1's own.
    Rows without a doc_id are told apart by their texts; rows that repeat both
    doc_id and text become one.
    """
    space, columns = Workspace(spark), docs.columns
    keyed = docs.select(doc_key().alias("doc_id"), "text")
    mark = unused(docs, "_key")
    same = doc_key().eqNullSafe(F.col(mark))
    gone = near_duplicates(spark, keyed, num=NEAR).where(~F.col("kept")).select(F.col("doc_id").alias(mark)).distinct()
    rest = docs.join(space.save(gone), doc_key() == F.col(mark), "left_anti")
    twins = space.save(keyed.groupBy(F.col("doc_id").alias(mark)).count().where("count > 1").select(mark))
    if twins.isEmpty():
        return rest
    alone = rest.join(twins, same, "left_anti")
    again = rest.join(twins, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return alone.unionByName(again).select(*[F.col(f"`{c}`") for c in columns])


def mixed_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents that the mix takes words from, with how many it takes.

    Adds size, source_size, target and taken, in place of columns of these
    names; a document of which nothing is taken goes. Rows are told apart by
    doc_id, or by text where it is null; if one repeats, rows are numbered in
    the table's order instead and each stays a document of its own.
    """
    space = Workspace(spark)
    docs = docs.drop("size", "source_size", "target", "taken")
    key = unused(docs, "_key")
    if docs.groupBy(doc_key().alias(key)).count().where("count > 1").isEmpty():
        keyed = docs.withColumn(key, doc_key())
    else:
        keyed = space.save(docs.withColumn(key, F.monotonically_increasing_id()))
    found = mix(spark, keyed.select(F.col(key).alias("doc_id"), "text", "source")).where("taken > 0")
    found = found.select(F.col("doc_id").alias(key), "size", "source_size", "target", "taken")
    return keyed.join(found, key).drop(key)
