"""Captures as a stream: files arrive, repeats within a day go, batches run through the job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Settings
from ..operators.capture import converted
from ..plans.job import JobOptions, run


def capture_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def deduplicated(captures: DataFrame, time: str, key: str = "bytes_sha256", within: str = "1 day") -> DataFrame:
    """The first capture of each key; state is kept for as long as late ones may come."""
    return captures.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def converted_stream(captures: DataFrame) -> DataFrame:
    return converted(captures)


def windowed_counts(captures: DataFrame, time: str, size: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Captures and bytes per window of arrival and status class."""
    status = F.concat(F.floor(F.col("status_code") / 100).cast("string"), F.lit("xx"))
    rows = captures.withWatermark(time, late).groupBy(F.window(time, size), status.alias("status"))
    return rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("html")).alias("bytes"))


def run_stream(captures: DataFrame, target: str, checkpoint: str, options: JobOptions, settings: Settings = Settings()) -> StreamingQuery:
    """Each batch becomes a job whose results are appended to ``target``; hashes stored before count as seen."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            seen = spark.read.parquet(target).where(F.col("outcome").isin("saved", "blocked") & (F.col("batch") != number)).select("content_hash")
        except Exception:  # the first batch finds no table
            seen = None
        done = run(batch, options, settings, seen=seen).withColumn("batch", F.lit(number))
        kept = done.select("url", "outcome", "content_hash", "bytes_sha256", "markdown", "fetched_at", "seq", "batch")
        # a batch that is run again replaces itself
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)

    return captures.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
