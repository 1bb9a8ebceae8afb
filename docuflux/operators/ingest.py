"""Incremental maintenance of a chunk store, as set differences of two snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["doc_id", "chunk_hash"]


def stale(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stored chunks that the new version lacks, for documents that it has."""
    return old.join(new.select("doc_id").distinct(), "doc_id", "left_semi").join(new, KEY, "left_anti")


def fresh(old: DataFrame, new: DataFrame) -> DataFrame:
    """New chunks, repeated ones too, that the store lacks."""
    return new.join(old, KEY, "left_anti")


def applied(old: DataFrame, new: DataFrame) -> DataFrame:
    """The store after the change."""
    gone = stale(old, new).select(*KEY).distinct()
    return old.join(gone, KEY, "left_anti").unionByName(fresh(old, new))


def statuses(known: DataFrame, files: DataFrame) -> DataFrame:
    """files (doc_id, file_hash) against known ones: unchanged, duplicate (with the document that
    has the content) or ingest. Of several documents with the content the least is named."""
    same = known.select("doc_id", F.col("file_hash").alias("known_hash"))
    by_hash = known.groupBy("file_hash").agg(F.sort_array(F.collect_set("doc_id")).alias("owners"))
    out = files.join(same, "doc_id", "left").join(by_hash, "file_hash", "left").withColumn("owner", F.try_element_at(F.filter("owners", lambda o: o != F.col("doc_id")), F.lit(1)))
    status = F.when(F.col("known_hash") == F.col("file_hash"), "unchanged").when(F.col("owner").isNotNull(), "duplicate").otherwise("ingest")
    return out.select("doc_id", status.alias("status"), F.when(status == "duplicate", F.col("owner")).alias("duplicate_of"))


def upserted(table: DataFrame, rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The latest row of each key; of equal versions the new one."""
    both = table.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("_new"))
    return both.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_new")
