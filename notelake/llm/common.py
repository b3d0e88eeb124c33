"""What the operators of this subpackage share: tables, the shared folder, Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rows, and bytes, that Spark hands to Python at once. Texts and sets of their parts are long: by default a batch could fill a worker.
ROWS_PER_BATCH, BYTES_PER_BATCH = 500, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From here on the session hands rows to Python in small batches, unless it has smaller ones set.

    Queries are lazy, so the setting must outlast the call that builds them: it stays for the session.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH), ("spark.sql.execution.arrow.maxBytesPerBatch", BYTES_PER_BATCH)):
        now = spark.conf.get(key).removesuffix("b")
        if now.lstrip("-").isdigit() and not 0 < int(now) <= most:  # a value with a unit is the caller's own
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new path below the folder that the cluster names in ``spark.checkpoint.dir``, with its scheme.

    Where that is unset, a temporary folder takes its place, one for each application and on a local master alone;
    a cluster without the setting is an error, because its machines do not see each other's folders.
    """
    base, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = context.applicationId
        if app not in _folders:
            _folders[app] = "file://" + tempfile.mkdtemp(prefix="notelake-")
        base = _folders[app]
    path = context._jvm.org.apache.hadoop.fs.Path(base)  # a path without a scheme is one of Spark's default file system
    whole = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"{whole.rstrip('/')}/{what}-{uuid.uuid4().hex}"


#: For rows of megabytes: by default a writer looks at its size every 100 rows first, and a reader holds a row group's column.
LARGE_ROWS = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 4, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 4}


def materialise(df: DataFrame, what: str, options: dict[str, int] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at files that outlive any executor."""
    spark = df.sparkSession
    small_batches(spark)
    path = shared_folder(spark, what)
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def row_slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices whose ``column`` (string or binary) holds about ``most_bytes`` at most, one row at least."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def quoted(columns: list[str]) -> list[Column]:
    """Columns by their whole names: a dot in a name is no path."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


#: Bits of the bitmaps that tell tasks which rows may matter. What passes one by chance is dropped by a join.
BITS = 1 << 22


def bitmap_of(numbers: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """Which remainders modulo ``bits`` the column's numbers have: a bitmap of fixed size, gathered in pieces of 4 KB."""
    place = F.pmod(F.col(column), F.lit(bits))
    pieces = numbers.select(place.alias("p")).groupBy(F.bitmap_bucket_number(F.col("p") + 1).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("p") + 1)).alias("m")).collect()
    out = np.zeros(bits, bool)
    for piece in pieces:
        m = np.unpackbits(np.frombuffer(piece["m"], np.uint8), bitorder="little")
        at = (piece["b"] - 1) * len(m)
        out[at : at + len(m)] = m[: bits - at]
    return out


def rare_prefixes(spread: DataFrame, key: str, element: str, least: float) -> DataFrame:
    """Of ``spread(key, n, element, ...)``, a row for each element of a set of n, those rows that an exact join must look at.

    Sets of Jaccard similarity ``least`` share one of the first n - ceil(least * n) + 1 elements of each in order of
    rarity. Elements of one set alone come first and are counted, not joined.
    """
    counts = materialise(spread.groupBy(element).agg(F.count("*").alias("_df")).where("_df > 1"), "rarity")
    singles = F.col("n") - F.count("*").over(Window.partitionBy(key))
    nth = F.row_number().over(Window.partitionBy(key).orderBy("_df", element)) + singles
    ranked = spread.join(counts, element).withColumn("_nth", nth)
    return ranked.where(F.col("_nth") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).drop("_df", "_nth")


def record_batch(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def varints(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in bytes of seven bits, lowest first, and where each begins, with the end of all."""
    most = int(v.max(initial=0))
    if most < 128:
        return v.astype(np.uint8), np.arange(len(v) + 1)
    size = np.ones(len(v), np.int8)
    for bits in range(7, most.bit_length(), 7):
        size += v >= 1 << bits
    start = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    out = np.zeros(start[-1], np.uint8)
    some, rest = np.arange(len(v)), v
    for k in range(int(size.max(initial=0))):
        more = size[some] > k + 1
        out[start[some] + k] = (rest & 127) | np.where(more, 128, 0)
        some, rest = some[more], rest[more] >> 7
    return out, start


def numbers(data: np.ndarray) -> np.ndarray:
    """What ``varints`` made bytes of."""
    last = np.flatnonzero(data < 128)
    if len(last) == len(data):
        return data.astype(np.int64)
    start = np.concatenate([[0], last[:-1] + 1])
    size = last - start + 1
    out = (data[start] & 127).astype(np.int64)
    some = np.flatnonzero(size > 1)
    for k in range(1, int(size.max(initial=0))):
        out[some] |= (data[start[some] + k] & 127).astype(np.int64) << (7 * k)
        some = some[size[some] > k + 1]
    return out
