"""Helpers shared by the training-data operators.

Intermediate tables are Parquet under the folder that `spark.checkpoint.dir` names, so that
they outlive any executor; a folder of our own is used only where that setting is absent.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docuflux.session import ship

#: Rows of a driver-made table that may be broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 2_000_000
#: Setting by which Spark deletes a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of text that a worker turns into arrays at a time.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Workspace:
    """Intermediate tables of one operator call, in the shared checkpoint folder."""

    def __init__(self, spark: SparkSession, label: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            base = tempfile.mkdtemp(prefix="docuflux-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.spark = spark
        self.root = f"{base.rstrip('/')}/docuflux/{label}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        schema = df.schema
        # the table is read from its files from now on, so the shuffles that made it can go
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most `limit` rows; counts no further than limit + 1."""
    return df.limit(limit + 1).count() <= limit


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast when its size is checked to be small, else as it is."""
    return F.broadcast(df) if bounded(df, limit) else df


def text_slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Parts of the batches with about `size` bytes of `column`, and its values."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column)).to_pylist()
        start, held = 0, 0
        for i, value in enumerate(values):
            held += len(value or b"")
            if held >= size:
                yield batch.slice(start, i + 1 - start), values[start : i + 1]
                start, held = i + 1, 0
        if start < len(values):
            yield batch.slice(start), values[start:]


def arrow_map(df: DataFrame, worker: Callable, schema: str | T.StructType) -> DataFrame:
    """mapInArrow over batches that are bounded in bytes as well as rows."""
    ship(df.sparkSession)
    return df.mapInArrow(worker, schema)


def packed(docs: DataFrame) -> DataFrame:
    """Whole rows of docs as one column `_row`, whatever their names, beside their text as bytes."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.encode(F.col("text").cast("string"), "UTF-8").alias("text"))


def kept_rows(docs: DataFrame, keep: Callable[[], Callable[[list], list]]) -> DataFrame:
    """The rows of docs that a worker keeps, in one pass and with all columns. keep() makes, once a
    task, a function from texts (bytes or None) to booleans."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = keep()
        for batch, texts in text_slices(batches, "text"):
            yield batch.select(["_row"]).filter(pa.array(judge(texts), pa.bool_()))

    rows = packed(docs)
    return arrow_map(rows, work, T.StructType([rows.schema["_row"]])).select("_row.*")


def ascii_lower(column):
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_key(*columns: str):
    """A stable 64-bit key of the given columns."""
    return F.xxhash64(*[F.col(c) for c in columns])
