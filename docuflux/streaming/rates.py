"""Streaming forms: rate windows with a watermark, deduplicated jobs with retries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docuflux.operators import operations as ops

ATTEMPTS = 3
JOB = "kind string, file_name string, ext string, file_hash string, attempts int, ts timestamp"


def rate_stream(calls: DataFrame, key: str, lateness: str = "10 minutes", width: str = ops.WINDOW, limit: int = ops.LIMIT) -> DataFrame:
    """Event-time tumbling counts of a stream, by the same function as in batch."""
    return ops.rate_windows(calls.withWatermark("ts", lateness), key, width=width, limit=limit)


def jobs(stream: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Jobs whose content was not seen within the lateness."""
    return stream.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["file_hash"])


def worked(batch: DataFrame, work: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(done or failed for good, to try again) of a micro-batch. work adds a boolean `ok`."""
    out = work(batch).withColumn("attempts", F.col("attempts") + 1)
    again = out.filter(~F.col("ok") & (F.col("attempts") < ATTEMPTS)).drop("ok")
    ended = out.filter(F.col("ok") | (F.col("attempts") >= ATTEMPTS))
    return ended.withColumn("status", F.when(F.col("ok"), "done").otherwise("failed")).drop("ok"), again
