"""Shards of jointly balanced bytes, tokens and rows, by vector bin packing.

Groups of equal texts are the items and the shards are the bins. An item is placed where the dot product of
its (bytes, tokens, rows), in shares of a shard, with the shard's residual capacity is highest, large items first.

One greedy pass over all groups would be one task. A group that holds more than one in ``SMALL`` of a shard's share of
anything is large; there are fewer than 3 * shards * ``SMALL`` of them, whatever the table, and they are placed in one pass on
the driver, by their aggregated sizes. A group above half a shard's share is dealt out in pieces first, as no
placing of it could be even; every other group stays whole. The small groups are dealt into blocks of about
``GROUPS_PER_BLOCK`` groups of one magnitude, and each block is placed by itself into what the large ones leave: no
group is then large in its block, and what a block leaves uneven is at most about one of its small groups.

Groups are placed by their sizes alone; then rows get their group's shard, the rows of large groups by a broadcast of
bounded size and those of small ones by a join without hot keys. The slot in a shard is the row's place there within its
task plus the rows of earlier tasks: a running sum over one row for each task and shard, not over the rows.

Null texts have no bytes and form a group with empty texts (of size ``OVERHEAD``). Very long texts are rows of large size,
whose text stays where it is read. Ties go to the first shard in the block's rotation. Rows that repeat are rows
like others. An empty table gives an empty result. Other columns of the input, whatever they are called, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notelake.llm.common import materialise, table, text_or_empty

OVERHEAD = 8
LAW = "bytes"
#: How much an uneven share of bytes, tokens and rows counts; bytes more than both others, as the law is that they are near equal.
WEIGHTS = np.array([2.0, 1.0, 1.0])
#: A group is large above one in SMALL of a shard's share, and dealt out in pieces of one in PIECES above half of it.
SMALL, PIECES, GROUPS_PER_BLOCK = 1024, 8, 2_000
#: Tables of offsets of up to so many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000
_PLACED = "doc_id long, size long, text_crc32 long, shard int, part int, nth long"


def place(items: np.ndarray, residual: np.ndarray, first: int = 0) -> np.ndarray:
    """The shard of each item, large ones first, by the dot product with the residual capacity, which is used up.

    Items and residual capacity are in shares of a shard. ``first`` rotates the shards, so that ties don't favour the same one in each block.
    """
    rotated = (np.arange(len(residual)) + first) % len(residual)
    out = np.empty(len(items), np.int64)
    for i in np.argsort(-items.max(axis=1), kind="stable") if len(items) else ():
        best = rotated[int(np.argmax(residual[rotated] @ (items[i] * WEIGHTS)))]
        residual[best] -= items[i]
        out[i] = best
    return out


def place_block(groups: pd.DataFrame, left: np.ndarray) -> pd.DataFrame:
    """gid, shard of a block of small groups; ``left`` is what large groups leave of each shard."""
    groups = groups.sort_values("gid", kind="stable")
    items = groups[["b", "t", "n"]].to_numpy(float)
    items /= np.maximum(items.sum(axis=0) / len(left), 1e-9)
    free = np.maximum(left, 0)
    residual = free / np.maximum(free.sum(axis=0), 1e-9) * len(left)
    return pd.DataFrame({"gid": groups["gid"], "shard": place(items, residual, int(groups["block"].iloc[0]) % len(left)).astype(np.int32)})


def sized(documents: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, tokens (blanks and one), gid (a hash of the text), deal (a number by chance) of every row."""
    text = text_or_empty()
    return documents.select(
        "doc_id",
        (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        (F.length(text) - F.length(F.replace(text, F.lit(" "))) + 1).cast("long").alias("tokens"),
        F.xxhash64(text).alias("gid"),
        F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("deal"),
    )


def with_place(rows: DataFrame) -> DataFrame:
    """Rows with the task that writes them and their number there among the rows of their shard."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, counts = TaskContext.get().partitionId(), np.zeros(0, np.int64)
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            if not len(shard):
                continue
            counts = np.pad(counts, (0, max(0, int(shard.max()) + 1 - len(counts))))
            order = np.argsort(shard, kind="stable")
            nth = np.empty(len(shard), np.int64)
            ranked = shard[order]
            nth[order] = np.arange(len(shard)) - np.searchsorted(ranked, ranked) + counts[ranked]
            counts += np.bincount(shard, minlength=len(counts))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "size", "text_crc32", "shard")), pa.array(np.full(len(shard), part, np.int32)), pa.array(nth)], names=[c.split()[0] for c in _PLACED.split(", ")])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "size", "text_crc32", "shard").mapInArrow(made, _PLACED)


def shard_documents(documents: DataFrame, shards: int = 24, small: int = SMALL, groups_per_block: int = GROUPS_PER_BLOCK) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of ``documents(doc_id, text)``."""
    spark = documents.sparkSession
    rows = materialise(sized(documents), "sized")
    groups = rows.groupBy("gid").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n"))
    groups = materialise(groups, "groups")
    total = groups.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "btn"]).first()
    share = {c: max(total[c], 1) / shards for c in "btn"}
    shares = groups.select("gid", *[(F.col(c) / share[c]).alias(c) for c in "btn"]).withColumn("most", F.greatest("b", "t", "n"))
    # Shares of one kind sum up to the number of shards: fewer than 3 * shards * small groups are large, and 6 * shards are halved or more.
    pieces = F.when(F.col("most") > 0.5, F.ceil(F.col("most") * PIECES)).otherwise(1).cast("long")
    large = shares.where(F.col("most") > 1 / small).select("gid", pieces.alias("pieces"), "b", "t", "n").toPandas()
    huge = spark.createDataFrame([(int(g), int(p)) for g, p in zip(large["gid"], large["pieces"], strict=True) if p > 1], "gid long, pieces long")
    cut = rows.join(F.broadcast(huge), "gid").groupBy("gid", "pieces", F.pmod("deal", "pieces").alias("piece"))
    cut = cut.agg(*[(F.sum(c) / share[k]).alias(k) for c, k in (("size", "b"), ("tokens", "t"))], (F.count("*") / share["n"]).alias("n")).toPandas()
    items = pd.concat([large[large["pieces"] == 1].assign(piece=0), cut])[["gid", "pieces", "piece", "b", "t", "n"]].sort_values(["gid", "piece"], kind="stable")
    left = np.ones((shards, 3))
    items["shard"] = place(items[["b", "t", "n"]].to_numpy(float), left)
    of_large = spark.createDataFrame([tuple(map(int, x)) for x in items[["gid", "pieces", "piece", "shard"]].itertuples(index=False)], "gid long, pieces long, piece long, shard int")
    rest = shares.where(F.col("most") <= 1 / small).withColumn("magnitude", F.floor(F.log2("most")).cast("int"))
    sizes = {r["magnitude"]: -(-r["count"] // groups_per_block) for r in rest.groupBy("magnitude").count().collect()}
    blocks = F.element_at(F.create_map(*[F.lit(x) for pair in (sizes or {0: 1}).items() for x in pair]), F.col("magnitude"))
    dealt = rest.withColumn("block", F.pmod(F.xxhash64("gid", F.lit(1)), blocks.cast("long")))
    of_small = materialise(dealt.groupBy("magnitude", "block").applyInPandas(lambda g: place_block(g, left), "gid long, shard int"), "small-groups")
    known = F.broadcast(of_large.select("gid", "pieces").distinct())
    in_large = rows.join(known, "gid").withColumn("piece", F.pmod("deal", "pieces")).join(F.broadcast(of_large), ["gid", "pieces", "piece"])
    in_small = rows.join(known, "gid", "left_anti").join(of_small, "gid")
    columns = ["doc_id", "size", "text_crc32", "shard"]
    placed = materialise(with_place(in_large.select(columns).unionByName(in_small.select(columns))), "shards")
    counts = placed.groupBy("part", "shard").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(counts.select("part", "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "offsets")
    offsets = F.broadcast(offsets) if offsets.count() <= BROADCAST_ROWS else offsets
    return placed.join(offsets, ["part", "shard"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("nth")).alias("slot"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
