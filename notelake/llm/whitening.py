"""Whitening of embeddings by distributed block matrices.

Each entry c of a vector becomes the whole number x = floor(1024 * c) + 100000. The centred rows are indexed and
dealt into an MLlib ``BlockMatrix`` A of n rows; its transpose times itself is the scatter matrix, whose size is
that of a vector, and which alone comes to the driver: there it is decomposed (``eigh``), and the whitening matrix of
its leading components goes back as a block matrix of one block that A is multiplied with. The middle dimension of the
first product is split, so that blocks of rows are multiplied and summed wherever they are and not in one task.

Rows never pass through Python: they are arrays of Spark, vectors of MLlib, and arrays again.

Rows whose vector is null or empty, or holds null or non-finite entries or entries of 2^50 or more, have no place in the
matrix and are left out. One space has vectors of one length: that of most rows, the longer one of two as frequent; rows of
another length are left out too. Components whose share of the variance is under 1e-12 have no direction and are left
out, so that equal vectors, a single one or an empty table give no rows. Rows that repeat each count and are each
returned, null ids among them. ``deviation`` is null where it takes more than 64 bits. Other columns of the input,
whatever they are called, are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.common import materialise, table

#: Fixed values of whole-number vectors.
SCALE, SHIFT = 1024, 100_000
#: Bytes of a block of the matrix, and components below this share of the variance that have no direction.
BLOCK_BYTES, LEAST_SHARE = 2 << 20, 1e-12


def whole_vectors(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """vec_id, x, d: the vectors as whole numbers, without those that have none, numbered apart in each partition (_at)."""
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= float(1 << 50)))
    found = rows.select(F.col(id_column).alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & ~bad)
    return found.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE) + SHIFT).alias("x"), F.size("v").alias("d"))


def indexed(rows: DataFrame) -> DataFrame:
    """``rows`` with index, from 0 without gaps: the place within a partition after the rows of the partitions before it."""
    placed = materialise(rows.withColumn("_at", F.monotonically_increasing_id()), "rows")
    sizes = placed.groupBy(F.shiftright("_at", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # a row for each task
    before = np.concatenate([[0], np.cumsum([r["n"] for r in sizes])[:-1]]).astype(int).tolist() if sizes else []
    offsets = rows.sparkSession.createDataFrame([(r["part"], b) for r, b in zip(sizes, before, strict=True)], "part long, before long")
    joined = placed.join(F.broadcast(offsets), F.shiftright("_at", 33) == F.col("part"))
    return joined.withColumn("index", F.col("before") + F.col("_at") - F.shiftleft("part", 33)).drop("_at", "part", "before")


def block_matrix(rows: DataFrame, n: int, width: int) -> BlockMatrix:
    """The rows (index, centred) as blocks of whole rows."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("centred").alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, width).toBlockMatrix(max(1, BLOCK_BYTES // (8 * width)), width)


def product(left: BlockMatrix, right: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """left times right; the dimension that they share is summed in ``splits`` parts."""
    made = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(made, left.rowsPerBlock, right.colsPerBlock)


def whitening_matrix(scatter: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The matrix that projects centred rows on the leading components, over their deviations; each component's share."""
    values, vectors = np.linalg.eigh(scatter / n)
    order = np.argsort(-values, kind="stable")[:k]
    total = float(np.trace(scatter)) / n
    order = order[values[order] > LEAST_SHARE * total] if total > 0 else order[:0]
    return vectors[:, order] / np.sqrt(values[order]), values[order] / total if total > 0 else values[order]


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 8) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for each row and leading component."""
    spark = rows.sparkSession
    every = materialise(whole_vectors(rows, id_column, vector_column), "whole")
    lengths = every.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], _OUT)
    width, n = lengths["d"], lengths["n"]
    fit = every.where(F.col("d") == width)
    # Sums by dimension: entries are summed where they are read, and a task sends one row for each dimension.
    sums = {r["dim"]: int(r["s"]) for r in fit.select(F.posexplode("x").alias("dim", "x")).groupBy("dim").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("s")).collect()}
    whole = [sums[i] if abs(sums[i]) < 1 << 63 else None for i in range(width)]
    shared = F.broadcast(spark.createDataFrame([(whole, [sums[i] / n for i in range(width)])], "sums array<long>, means array<double>"))  # one row
    count = F.lit(n).cast("long")
    off = F.zip_with("x", "sums", lambda x, s: F.try_subtract(F.try_multiply(count, x), s))
    centred = F.transform(F.arrays_zip("x", "off", "means"), lambda p: F.coalesce(p["off"].cast("double") / n, p["x"].cast("double") - p["means"]))
    squares = F.aggregate("off", F.lit(0).cast("long"), lambda total, o: F.try_add(total, F.try_multiply(o, o)))
    placed = indexed(fit.crossJoin(shared).withColumn("off", off).select("vec_id", squares.alias("deviation"), centred.alias("centred")))
    placed = materialise(placed, "centred")

    matrix = block_matrix(placed, n, width)
    tasks = max(1, min(matrix.numRowBlocks, 2 * spark.sparkContext.defaultParallelism))
    scatter = product(matrix.transpose(), matrix, tasks).toLocalMatrix().toArray()
    projection, shares = whitening_matrix((scatter + scatter.T) / 2, n, k)
    if not len(shares):
        return spark.createDataFrame([], _OUT)
    local = DenseMatrix(width, len(shares), projection.ravel(order="F"))
    right = BlockMatrix(spark.sparkContext.parallelize([((0, 0), local)], 1), width, len(shares))
    made = callMLlibFunc("getIndexedRows", product(matrix, right).toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    projected = materialise(made.select("index", vector_to_array("vector").alias("whitened")), "whitened")

    # The covariance of what came out, entry by entry: bounded by the number of components.
    pairs = [(i, j) for i in range(len(shares)) for j in range(i, len(shares))]
    entries = projected.agg(*[F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(entries[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    explained = F.array(*[F.lit(float(s)) for s in shares])
    out = placed.select("index", "vec_id", "deviation").join(projected, "index").select("vec_id", "deviation", F.posexplode("whitened").alias("nth", "whitened"))
    return out.select(
        F.col("vec_id").cast("long").alias("vec_id"), (F.col("nth") + 1).cast("int").alias("component"), count.alias("n"), "deviation",
        "whitened", F.get(explained, F.col("nth")).alias("explained"), F.lit(float(error)).alias("identity_error"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of ``embeddings`` on their eight leading components."""
    return whitened(table(spark, sf_dir, "embeddings"))
