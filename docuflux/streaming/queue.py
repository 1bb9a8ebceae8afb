"""A durable queue: jobs are JSON files in a folder, a stream with a checkpoint takes each once, and
what is worth another try goes back into the folder.

A batch runs one job of a file at a time; jobs on a file that another one of the batch has are skipped,
as are those whose content was done before. Results are appended, status by status, so that a batch that
is run again after a failure adds its rows under the same batch number, and readers keep one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docuflux.operators import operations as ops

JOB = "job_id string, kind string, file_name string, ext string, file_hash string, attempts int, queued_at timestamp"


def process(batch: DataFrame, work: Callable[[DataFrame], DataFrame], most: int = 3) -> DataFrame:
    """The batch's jobs with status done, retry, failed or skipped, and attempts. work adds booleans ok and again."""
    order = F.row_number().over(ops.Window.partitionBy("file_name").orderBy("queued_at", "job_id"))
    first = batch.withColumn("_n", order)
    ran = ops.attempted(work(first.filter("_n = 1").drop("_n")), most).drop("ok", "again")
    return ran.unionByName(first.filter("_n > 1").drop("_n").withColumn("status", F.lit("skipped")))


def run(spark: SparkSession, folder: str, work: Callable[[DataFrame], DataFrame], results: str, checkpoint: str, most: int = 3) -> None:
    """Takes all jobs that are in the folder, batch by batch, until none is left, and ends."""

    def each(batch: DataFrame, number: int) -> None:
        out = process(batch, work, most).withColumn("batch", F.lit(number))
        path = f"{results}/batch={number}"
        out.drop("batch").write.mode("overwrite").parquet(path)  # a batch that runs again replaces itself
        done = spark.read.parquet(path)
        again = done.filter("status = 'retry'").drop("status").withColumn("job_id", F.concat("job_id", F.lit("+")))
        if again.limit(1).count():
            again.write.mode("append").json(folder)

    while True:
        stream = spark.readStream.schema(JOB).option("maxFilesPerTrigger", 1000).json(folder)
        query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        if not any(p["numInputRows"] for p in query.recentProgress):
            return


def outcome(spark: SparkSession, results: str) -> DataFrame:
    """The last status of each job."""
    rows = spark.read.parquet(results).withColumn("job", F.regexp_replace("job_id", r"\++$", ""))
    return rows.groupBy("job").agg(F.max_by(F.struct("file_name", "status", "attempts"), F.struct("attempts", "batch")).alias("r")).select("job", "r.*")
