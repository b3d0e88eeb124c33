"""Exact top-k search in binary codes by incremental multi-index hashing.

Codes are the signs of the vectors' components. A code is cut into segments, each with a table of its own. A
query looks up, segment after segment, the keys at distance 0, then at distance 1, and so on: after step s =
radius * segments + segment, every code within distance s has been met. Candidates are verified on the whole
code. A query ends as soon as its kth verified distance is s or less, which proves that nothing nearer, nor
a tie, is left; no other limit exists.

Equal codes are one entry of the tables: of an entry the k + 1 least ids are kept, which a query can need, so
that a code which a third of all rows share costs no more than any other. Codes and queries are dealt out in
blocks of bounded size; each pair of blocks is searched in one task, and the blocks' results are merged by
distance and id. Few queries mean few copies of the codes: the query set is what is held against all rows.

A row is not its own neighbour. Ties go to lesser ids. Rows with a null or empty vector or a null id have no code: they
neither ask nor answer. Vectors of different lengths are not compared. Rows that repeat
id and vector are one row that asks as often as it occurs; an id with several vectors is no neighbour of itself
and may get that many fewer results. With fewer than k others there are fewer results; an empty table gives none. Very long
vectors have more segments. Other columns of the input, whatever they are called, are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notelake.llm.common import materialise, table

_FOUND = "asked binary, code binary, least_id long, distance int"


def binary_codes(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id, code: a bit for each component, 1 where it is above zero, the first component highest in the first byte."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [np.packbits(np.nan_to_num(np.asarray(v, float)) > 0).tobytes() + len(v).to_bytes(4, "big") for v in (x.values.to_numpy(zero_copy_only=False) for x in batch.column("v"))]
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), pa.array(codes, pa.binary())], names=["id", "code"])

    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v")).where("id is not null and size(v) > 0")
    return rows.mapInArrow(made, "id long, code binary")


def as_words(codes: list[bytes], size: int) -> np.ndarray:
    """Codes of ``size`` bytes as rows of 64-bit words, filled up with zeros."""
    wide = -(-max(size, 1) // 8) * 8
    out = np.zeros((len(codes), wide), np.uint8)
    if size:
        out[:, :size] = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), size)
    return out.view(np.uint64)


class MultiIndex:
    """Tables over the segments of distinct codes (bits: n x d booleans)."""

    def __init__(self, codes: np.ndarray, bits: int, least_ids: np.ndarray) -> None:
        self.codes, self.bits, self.least_ids = codes, bits, least_ids
        self.flat = np.unpackbits(codes.view(np.uint8), axis=1)[:, :bits]
        segments = max(1, min(bits, max(math.ceil(bits / 16), round(bits / math.log2(max(len(codes), 4))))))
        self.cuts = [(int(x[0]), int(x[-1]) + 1) for x in np.array_split(np.arange(bits), segments)]
        self.tables = []
        for a, b in self.cuts:
            key = self.keys(self.flat, a, b)
            self.tables.append((np.argsort(key, kind="stable"), np.r_[0, np.cumsum(np.bincount(key, minlength=1 << (b - a)))]))

    @staticmethod
    def keys(flat: np.ndarray, a: int, b: int) -> np.ndarray:
        return flat[:, a:b].astype(np.int64) @ (1 << np.arange(b - a, dtype=np.int64)[::-1])

    @staticmethod
    def masks(width: int, radius: int) -> np.ndarray:
        return np.array([sum(1 << i for i in x) for x in itertools.combinations(range(width), radius)], np.int64)

    def search(self, asked: np.ndarray, k: int, most_pairs: int = 1_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of query, index of code and distance of the ``k`` nearest codes of each query, by distance and least id."""
        k = min(k, len(self.codes))
        flat = np.unpackbits(asked.view(np.uint8), axis=1)[:, : self.bits]
        keys = [self.keys(flat, a, b) for a, b in self.cuts]
        best_q, best_c, best_d = (np.zeros(0, np.int64) for _ in range(3))
        kth = np.full(len(asked), self.bits + 1)
        active = np.arange(len(asked))
        for step in range(self.bits + 1):
            j, radius = step % len(self.cuts), step // len(self.cuts)
            a, b = self.cuts[j]
            if radius <= b - a and len(active):
                order, offsets = self.tables[j]
                masks = self.masks(b - a, radius)
                some = max(1, most_pairs // max(1, len(masks)))
                for lo in range(0, len(active), some):
                    q = active[lo : lo + some]
                    probe = (keys[j][q][:, None] ^ masks[None, :]).ravel()
                    count = offsets[probe + 1] - offsets[probe]
                    owner = np.repeat(np.repeat(q, len(masks)), count)
                    upto = np.cumsum(count)
                    place = np.arange(upto[-1] if len(upto) else 0) - np.repeat(upto - count, count) + np.repeat(offsets[probe], count)
                    new_q, new_c, new_d = [], [], []
                    for at in range(0, len(place), most_pairs):
                        o, c = owner[at : at + most_pairs], order[place[at : at + most_pairs]]
                        d = np.bitwise_count(asked[o] ^ self.codes[c]).sum(axis=1, dtype=np.int64)
                        near = d <= kth[o]
                        new_q.append(o[near])
                        new_c.append(c[near])
                        new_d.append(d[near])
                    if not sum(map(len, new_q)):
                        continue
                    best_q, best_c, best_d = np.concatenate([best_q, *new_q]), np.concatenate([best_c, *new_c]), np.concatenate([best_d, *new_d])
                    ranked = np.lexsort((best_c, self.least_ids[best_c], best_d, best_q))
                    best_q, best_c, best_d = best_q[ranked], best_c[ranked], best_d[ranked]
                    again = np.zeros(len(best_q), bool)
                    again[1:] = (best_q[1:] == best_q[:-1]) & (best_c[1:] == best_c[:-1])
                    best_q, best_c, best_d = best_q[~again], best_c[~again], best_d[~again]
                    first = np.searchsorted(best_q, best_q)
                    keep = np.arange(len(best_q)) - first < k
                    best_q, best_c, best_d, first = best_q[keep], best_c[keep], best_d[keep], first[keep]
                    rank = np.arange(len(best_q)) - np.searchsorted(best_q, best_q)
                    kth[best_q[rank == k - 1]] = best_d[rank == k - 1]
            active = active[kth[active] > step]
            if not len(active):
                break
        return best_q, best_c, best_d


def search_block(codes: pd.DataFrame, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` nearest of a block's codes for each of a block's queries; both of one length of vector."""
    out = []
    if len(codes) and len(asked):
        whole = list(codes["code"])
        bits = int.from_bytes(whole[0][-4:], "big")
        size = len(whole[0]) - 4
        index = MultiIndex(as_words([c[:-4] for c in whole], size), bits, codes["least_id"].to_numpy(np.int64))
        questions = list(asked["asked"])
        q, c, d = index.search(as_words([x[:-4] for x in questions], size), k)
        out = pd.DataFrame({"asked": [questions[i] for i in q], "code": [whole[i] for i in c], "least_id": index.least_ids[c], "distance": d.astype(np.int32)})
    return out if len(out) else pd.DataFrame({"asked": [], "code": [], "least_id": np.zeros(0, np.int64), "distance": np.zeros(0, np.int32)})


def nearest(coded: DataFrame, queries: DataFrame, k: int, codes_per_block: int = 131_072, queries_per_block: int = 4_096, least_queries: int = 64) -> DataFrame:
    """id, neighbour, distance, rank for every row of ``queries(id, code)`` against all rows of ``coded(id, code)``."""
    nth = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    entries = materialise(coded.dropDuplicates(["code", "id"]).withColumn("nth", nth).where(F.col("nth") <= k + 1), "code-entries")
    codes = entries.where("nth = 1").select("code", F.col("id").alias("least_id"))
    asked = materialise(queries.select(F.col("code").alias("asked")).distinct(), "asked")
    n_codes, n_asked = codes.count(), asked.count()
    blocks = max(1, -(-n_codes // codes_per_block))
    parts = max(1, -(-n_asked // queries_per_block), min(16, n_asked // least_queries))
    length = F.length
    bits = lambda c: F.hex(F.substring(c, -4, 4))
    left = codes.select(F.pmod(F.xxhash64("code"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), length("code").alias("size"), bits("code").alias("bits"), "code", "least_id")
    right = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod(F.xxhash64("asked"), F.lit(parts)).cast("int").alias("part"), length("asked").alias("size"), bits("asked").alias("bits"), "asked")
    key = ["block", "part", "size", "bits"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(lambda a, b: search_block(a, b, k + 1), _FOUND)
    merged = F.row_number().over(Window.partitionBy("asked").orderBy("distance", "least_id"))
    found = found.withColumn("nth", merged).where(F.col("nth") <= k + 1).drop("nth", "least_id")
    rows = found.join(entries.select("code", "id"), "code")
    first = F.row_number().over(Window.partitionBy("asked").orderBy("distance", "id"))
    of_code = materialise(rows.withColumn("nth", first).where(F.col("nth") <= k + 1).select(F.col("asked").alias("code"), F.col("id").alias("neighbour"), "distance"), "found")
    own = F.row_number().over(Window.partitionBy("id", "nonce").orderBy("distance", "neighbour"))
    asking = queries.select("id", "code").withColumn("nonce", F.monotonically_increasing_id())
    answers = asking.join(of_code, "code").where(F.col("id") != F.col("neighbour"))
    return answers.withColumn("rank", own).where(F.col("rank") <= k).select("id", "neighbour", "distance", "rank")


def op9_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows, by the signs of their vectors, of every row whose id is divisible by 20."""
    coded = materialise(binary_codes(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "codes")
    return nearest(coded, coded.where("id % 20 = 0"), 10).select(F.col("id").alias("vec_id"), F.col("neighbour").alias("neighbour_id"), "distance", "rank")


OP9_SQL = """
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
w AS (SELECT vec_id, len(b) AS n, list_transform(range(0, CAST(ceil(len(b) / 32.0) AS BIGINT)), lambda s: list_sum(list_transform(range(1, 33), lambda i: COALESCE(b[s * 32 + i], 0) * CAST(2 ** (i - 1) AS BIGINT)))) AS words FROM c),
d AS (SELECT q.vec_id, r.vec_id AS neighbour_id, CAST(list_sum(list_transform(list_zip(q.words, r.words), lambda z: bit_count(xor(CAST(z[1] AS BIGINT), CAST(z[2] AS BIGINT))))) AS INTEGER) AS distance
  FROM w q JOIN w r ON q.n = r.n AND q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour_id) AS INTEGER) AS rank FROM d)
SELECT vec_id, neighbour_id, distance, rank FROM k WHERE rank <= 10
"""
