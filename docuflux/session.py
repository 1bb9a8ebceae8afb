"""Sessions, and how the package reaches the Python workers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Bytes of a batch that a Python worker is handed.
BATCH_BYTES = 4 << 20


def session(name: str = "docuflux", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC times; conf keys use _ for dots."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def small_batches(spark: SparkSession) -> None:
    """Bounds batches for Python workers in bytes as well as rows, as texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def ship(spark: SparkSession) -> None:
    """Sends this package to all Python workers of the session, once per application."""
    small_batches(spark)
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="docuflux-")) / "docuflux.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(here.rglob("*.py")):
            out.write(source, source.relative_to(here.parent).as_posix())
    context.addPyFile(str(path))
    _SHIPPED.add(context.applicationId)


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder for a job's tables in the one that spark.checkpoint.dir names, which executors
    share; where that is unset, as in tests on one machine, a temporary one is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the executors share")
        base = tempfile.mkdtemp(prefix="docuflux-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/docuflux/{label}-{uuid.uuid4().hex[:12]}"


def parts_for(source: DataFrame, spread: int = 16) -> int:
    """Partitions for a shuffle that grows with a table as it is read: `spread` for each of its splits, so
    that a task's share is that of a part of a split, whatever the table's size. Nothing is read."""
    return spread * max(1, source.rdd.getNumPartitions())
