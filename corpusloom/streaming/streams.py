"""The stateful parts of the crawl as Structured Streaming queries over a growing log.

Late rows are taken until the watermark passes; state is keyed by site, window
or text hash and expires with the watermark where the semantics allow it."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.plans.session import shared_folder


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A growing parquet table as a stream; a single file is a table of one."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("recursiveFileLookup", False).parquet(folder) if _is_file(spark, path) else spark.readStream.schema(schema).parquet(path)


def _is_file(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and read what it wrote, from the shared folder."""
    spark = stream.sparkSession
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", f"{out}/data")
    else:  # whole results are rewritten by every batch

        def replace(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/data")

        writer = stream.writeStream.foreachBatch(replace)
    query = writer.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def appended_updates(stream: DataFrame) -> DataFrame:
    """Every update a stream in update mode sends, as rows."""
    spark = stream.sparkSession
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def add(batch: DataFrame, _: int) -> None:
        batch.write.mode("append").parquet(f"{out}/data")

    query = stream.writeStream.foreachBatch(add).outputMode("update").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def unique_requests(log: DataFrame, delay: str = "30 days") -> DataFrame:
    """Every request once; its repeats may come within the delay."""
    return log.withColumn("logged_at", F.col("logged_at").cast("timestamp")).withWatermark("logged_at", delay).dropDuplicatesWithinWatermark(["request_id"])


def hourly_status(log: DataFrame, delay: str = "30 days") -> DataFrame:
    """(hour, status_code, requests): requests in windows of event time; null statuses are a group."""
    log = log.withColumn("clock", F.col("clock").cast("timestamp"))
    windows = log.withWatermark("clock", delay).groupBy(F.window("clock", "1 hour").alias("w"), "status_code")
    return windows.agg(F.count(F.lit(1)).alias("requests")).select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "status_code", "requests")


def running_totals(log: DataFrame) -> DataFrame:
    """(siteindex, pages, errors, bytes) of every site, updated as rows arrive, by a state of three numbers."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pages, errors, size = state.get if state.exists else (0, 0, 0)
        for pdf in batches:
            pages += int((pdf["status_code"] == "OK").sum())
            errors += int(pdf["error_message"].notna().sum())
            size += int(pdf["content_size_bytes"].fillna(0).sum())
        state.update((pages, errors, size))
        yield pd.DataFrame({"siteindex": [key[0]], "pages": [pages], "errors": [errors], "bytes": [size]})

    schema = "siteindex int, pages long, errors long, bytes long"
    cols = log.select("siteindex", "status_code", "error_message", "content_size_bytes")
    return cols.groupBy("siteindex").applyInPandasWithState(update, schema, "pages long, errors long, bytes long", "update", GroupStateTimeout.NoTimeout)
