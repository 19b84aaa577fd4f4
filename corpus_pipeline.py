"""The corpus pipeline: quality, near copies, benchmark leaks, PII, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``. A stage is written as Parquet in the
shared folder and read again by the next, so that a lost executor costs at
most the stage that runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallgrass.llm.common import Workspace, table
from tallgrass.llm.decontam import drop_contaminated
from tallgrass.llm.pii import mask_pii
from tallgrass.llm.quality import keep_good
from tallgrass.llm.stages import drop_near_duplicates, mixed_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality cascade (operator 6)."""
    return keep_good(spark, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (operator 1)."""
    return drop_near_duplicates(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item (operator 10)."""
    return drop_contaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind (operator 9)."""
    return mask_pii(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words from, with how many (operator 3)."""
    return mixed_documents(spark, docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", pii),
    ("mixing", mixing),
]

#: Components, block mixing and PII masks have no plain SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    space = Workspace(spark)
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        done = space.save(stage(spark, docs, sf_dir))
        if last is not None:
            space.drop(last)
        docs = last = done
    return docs
