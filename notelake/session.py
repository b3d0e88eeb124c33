"""Session construction and the shared folder that jobs may write to."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "notelake", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and single-node benchmarks. A cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("NOTELAKE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-wh-"))
        .getOrCreate()
    )


#: Bytes up to which a table is dealt out to all cores.
DEALT_BYTES = 256 << 20


def dealt(df: DataFrame) -> DataFrame:
    """``df`` with its rows dealt out to all cores, if it is small and fewer tasks than there are cores would read it.

    A large table stays as it is, whatever the number of cores: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size <= DEALT_BYTES and df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return dealt(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
