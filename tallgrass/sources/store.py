"""Snapshots, logs and document libraries on files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TEXT_TYPES = ("md", "markdown", "txt", "text", "csv", "tsv", "json", "yaml", "yml", "xml", "html", "htm", "log")
CONVERTIBLE_TYPES = ("pdf", "doc", "docx", "ppt", "pptx", "xls", "xlsx", "epub", "rtf")
MAX_IMPORT_BYTES, LIBRARY_DOCUMENTS = 10 << 20, 40
#: Bytes at the end of a log file that are read.
TAIL_BYTES = 2 << 20


def save_snapshot(df: DataFrame, root: str, version: int) -> str:
    """Writes a new version beside the old ones; readers take the newest that
    was committed, so a failed write is never seen."""
    path = f"{root}/version={version:012d}"
    df.write.mode("overwrite").parquet(path)
    return path


def load_snapshot(spark: SparkSession, root: str, schema_version: int) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantined rows) of the newest version below a folder."""
    every = spark.read.parquet(root)
    newest = every.agg(F.max("version")).first()[0]
    rows = every.where(F.col("version") == newest)
    ok = F.col("schema_version") == schema_version
    return rows.where(ok), rows.where(~F.coalesce(ok, F.lit(False)))


def changed(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows of ``after`` whose content hash isn't the one saved for the key."""
    columns = sorted(c for c in after.columns if c != key)
    mark = F.sha2(F.to_json(F.struct(*columns)), 256)
    old = before.select(key, mark.alias("_mark"))
    return after.withColumn("_mark", mark).join(old, [key, "_mark"], "left_anti").drop("_mark")


def append_audit(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def tail_logs(logs: DataFrame, turn: str, files: int = 5, most: int = 500, tail_bytes: int = TAIL_BYTES) -> DataFrame:
    """Log rows of a turn from the newest files, the first ``most`` in reading
    order, then by time. Columns: path, modified, line, turn_id, time_ms.

    With columns ``offset`` (of a line's first byte) and ``size`` (of its
    file), only a file's last ``tail_bytes`` are read, without the line that
    they begin in.
    """
    if {"offset", "size"} <= set(logs.columns):
        logs = logs.where((F.col("size") <= tail_bytes) | (F.col("offset") > F.col("size") - tail_bytes))
    newest = logs.select("path", "modified").distinct().orderBy(F.desc("modified"), "path").limit(files).select("path")
    own = logs.join(newest, "path", "left_semi").where(F.col("turn_id") == turn)
    return own.orderBy("path", "line").limit(most).orderBy("time_ms", "path", "line")


def classify(extension: Column) -> Column:
    ext = F.lower(extension)
    return F.when(ext.isin(*TEXT_TYPES), "text").when(ext.isin(*CONVERTIBLE_TYPES), "convertible").otherwise("unsupported")


def read_head(text: Column, n: int) -> Column:
    """The first n characters; a text with a NUL character is empty."""
    return F.when(F.contains(text, F.lit("\0")), "").otherwise(F.substring(text, 1, n))


def import_documents(library: DataFrame, incoming: DataFrame, cap: int = LIBRARY_DOCUMENTS) -> DataFrame:
    """Library after an import. An incoming file replaces the entry of the
    same owner and fingerprint, else the one of the same source path; files
    too large or of an unsupported kind are refused; the newest ``cap`` of an
    owner stay. Columns: owner_id, id, path, extension, content, imported_at.
    """
    marked = incoming.where(
        (classify(F.col("extension")) != "unsupported") & (F.octet_length("content") <= MAX_IMPORT_BYTES)
    ).withColumn("fingerprint", F.sha1("content"))
    # every accepted file pushes out what it replaces, also one that is itself
    # replaced by a later file
    by_mark = library.join(marked.select("owner_id", "fingerprint"), ["owner_id", "fingerprint"], "left_anti")
    kept = by_mark.join(marked.select("owner_id", "path"), ["owner_id", "path"], "left_anti")
    for key in ("fingerprint", "path"):
        last = Window.partitionBy("owner_id", key).orderBy(F.desc("imported_at"), "id")
        marked = marked.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn")
    both = kept.unionByName(marked.select(*kept.columns))
    w = Window.partitionBy("owner_id").orderBy(F.desc("imported_at"), "id")
    return both.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap).drop("_rn")
