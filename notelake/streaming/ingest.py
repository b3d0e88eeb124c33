"""Incremental ingest as a stream: new files of captures become notes, upserted by key, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.plans.library import Library
from notelake.plans.store import shared_folder


def upsert_stream(captures: DataFrame, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> None:
    """Runs a stream of captures through ``transform`` into ``target``, a folder for each batch, until the input is used up.

    A batch that is repeated after a failure overwrites its own folder, so each is there once.
    """

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch-{number:08d}")

    query = captures.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def follow(captures: DataFrame, library: Library, checkpoint: str) -> None:
    """Ingests a stream of captures into a library (notes, postings and vectors) until its input is used up.

    A batch that is repeated after a failure replaces its own notes by the same ones.
    """
    query = captures.writeStream.foreachBatch(lambda batch, _: library.ingest(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def latest(spark: SparkSession, target: str, key: str) -> DataFrame:
    """The newest row of each key over all batches."""
    rows = spark.read.parquet(f"{target}/batch-*")
    own = [c for c in rows.columns if c != "batch"]
    last = F.max_by(F.struct(*own), F.struct("batch", F.xxhash64(*own)))  # of one batch's rows the same one each time
    return rows.groupBy(key).agg(last.alias("_row")).select("_row.*")


def ingest_documents(spark: SparkSession, path: str, transform: Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
    """Streams the Parquet files at ``path`` into notes and returns the latest of each key."""
    schema = spark.read.parquet(path).schema
    folder = shared_folder(spark, "stream")
    pattern = f"{path[:-1]}[{path[-1]}]"  # a pattern that fits the path alone: it may be a folder or one file
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(pattern)
    upsert_stream(stream, transform, f"{folder}/notes", f"{folder}/checkpoint")
    return latest(spark, f"{folder}/notes", key)
