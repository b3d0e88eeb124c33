"""Ranked lexical search by Block-Max MaxScore over an index of shards.

Documents are indexed where they are read: a task cuts its rows into shards of bounded size and writes, for each term of
a shard, one row with its posting list in compressed blocks, each block's last document and largest gain, and the largest
gain of the list. Nothing of a posting list is shuffled to build it. A document's gain from a term does not depend on
the query, so that maxima are exact; the term's weight is put in when it is asked for.

A search joins the lists of the terms asked for and brings those of one shard and one block of queries together. Lists
are ordered by their bounds. Those whose bounds together cannot pass the score of the kth document so far are not
essential: they give no candidates. A candidate of the others is held against block maxima first, list by list, and a
block is decompressed only for candidates that may still pass. Documents go by ascending id, so that one of an equal
score never displaces another. Each shard's best k are merged by score and id.

Null texts, and those without a term, are no documents of the statistics and are never found; very long texts are one
document, indexed whole. Rows that repeat an id are documents each; ids may be null and come last among equals. Rows of
queries that share an id (null too) are one query of all their terms; queries without a term, or of which no document
has one, give no rows, as do empty tables. Other columns, whatever they are called, are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notelake.llm.common import materialise, numbers, table, varints

#: Postings in a block, documents in a window of a search, and what bounds a shard.
BLOCK, WINDOW, SHARD_ROWS, SHARD_BYTES = 64, 2_048, 16_384, 16 << 20
#: Queries that are searched for at once, and rows of asked terms up to which they are broadcast.
QUERIES_PER_BLOCK, BROADCAST_ROWS = 256, 200_000
TERM = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII letters in lower case, digits and all bytes beyond ASCII; anything else parts terms.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_LISTS = pa.schema([("shard", pa.int64()), ("term", pa.binary()), ("df", pa.int32()), ("top", pa.int64()), ("heads", pa.binary()), ("postings", pa.binary())])
_LISTS_SQL = "shard long, term binary, df int, top long, heads binary, postings binary"


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, repeats included."""
    return (text or b"").translate(_BYTES).split()


def gains(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def shard_rows(shard: int, ids: list[int | None], texts: list[bytes | None], docs: int, length: int) -> Iterator[pa.RecordBatch]:
    """The rows of one shard: a list for each term, and one without a term for its documents (ids and lengths)."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    vocabulary: dict[bytes, int] = defaultdict(count().__next__)
    found, sizes = [], []
    for i in order:
        words = terms(texts[i])
        sizes.append(len(words))
        found.append(np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words)))
    n = np.array(sizes, np.int64)
    if not n.sum():
        return
    m = 50 + (50 * n * docs) // length
    key, tf = np.unique(np.concatenate(found) * len(n) + np.repeat(np.arange(len(n)), n), return_counts=True)
    term, doc = key // len(n), key % len(n)
    first = np.concatenate([[0], np.flatnonzero(np.diff(term)) + 1])
    df = np.diff(np.concatenate([first, [len(key)]]))
    before = np.where(np.isin(np.arange(len(key)), first), -1, np.concatenate([[-1], doc[:-1]]))
    data, at = varints(np.stack([doc - before - 1, tf], axis=1).ravel())
    blocks = -(-df // BLOCK)
    upto = np.cumsum(blocks)
    start = np.repeat(first, blocks) + BLOCK * (np.arange(upto[-1]) - np.repeat(upto - blocks, blocks))
    end = np.minimum(start + BLOCK, np.repeat(first + df, blocks))
    gain = gains(tf.astype(np.int64), m[doc])
    heads = np.stack([doc[end - 1], np.maximum.reduceat(gain, start), at[2 * end] - np.repeat(at[2 * first], blocks)], axis=1).astype("<i4")
    binary = lambda offsets, raw: pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
    lists = pa.RecordBatch.from_arrays([
        pa.array(np.full(len(df), shard)), pa.array(list(vocabulary), pa.binary()), pa.array(df.astype(np.int32)), pa.array(np.maximum.reduceat(gain, first)),
        binary(np.concatenate([[0], upto]) * 12, heads), binary(np.concatenate([at[2 * first], at[-1:]]), data),
    ], schema=_LISTS)
    for lo in range(0, lists.num_rows, 50_000):
        yield lists.slice(lo, 50_000)
    known = pa.array([ids[i] for i in order], pa.int64())
    named = np.stack([known.fill_null(0).to_numpy(), known.is_valid().to_numpy(zero_copy_only=False)]).astype("<i8")
    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((shard, None, len(n), 0, named.tobytes(), m.astype("<i8").tobytes()), _LISTS, strict=True)], schema=_LISTS)


@dataclass
class Index:
    """Rows of lists and of the shards' documents; the number of documents and of all their terms."""

    rows: DataFrame
    docs: int
    length: int


def build_index(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> Index:
    rows = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("binary").alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = length = 0
        for batch in batches:
            for text in batch.column("text"):
                n = len(terms(text.as_py()))
                docs, length = docs + (n > 0), length + n
        yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([length])], names=["docs", "length"])

    found = rows.mapInArrow(counted, "docs long, length long").agg(F.sum("docs").alias("docs"), F.sum("length").alias("length")).first()
    docs, length = found["docs"] or 0, found["length"] or 0

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        texts: list[bytes | None] = []
        held = 0
        for batch in batches:
            for id_, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                raw = text.as_py()
                if texts and (len(texts) >= SHARD_ROWS or held + len(raw or b"") > SHARD_BYTES):
                    yield from shard_rows(shard, ids, texts, docs, length)
                    shard, ids, texts, held = shard + 1, [], [], 0
                ids.append(id_)
                texts.append(raw)
                held += len(raw or b"")
        if texts:
            yield from shard_rows(shard, ids, texts, docs, length)

    return Index(materialise(rows.mapInArrow(made, _LISTS_SQL), "index"), docs, length)


class PostingList:
    """A list in blocks, of which those that are looked into are decompressed, once."""

    def __init__(self, top: int, heads: bytes, postings: bytes, m: np.ndarray) -> None:
        table_ = np.frombuffer(heads, "<i4").reshape(-1, 3).astype(np.int64)
        self.last, self.tops, self.ends = table_[:, 0], table_[:, 1], table_[:, 2]
        self.top, self.data, self.m = top, np.frombuffer(postings, np.uint8), m
        self.known: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def blocks(self, lo: int, hi: int) -> tuple[int, int]:
        """The blocks (from, to) that may have documents in ``[lo, hi)``."""
        a, b = np.searchsorted(self.last, (lo, hi - 1))
        return int(a), min(int(b) + 1, len(self.last))

    def read(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and gains of the blocks from ``a`` to ``b``."""
        if (a, b) not in self.known:
            pairs = numbers(self.data[self.ends[a - 1] if a else 0 : self.ends[b - 1]]).reshape(-1, 2)
            doc = np.cumsum(pairs[:, 0] + 1) + (self.last[a - 1] if a else -1)
            self.known[a, b] = doc, gains(pairs[:, 1], self.m[doc])
        return self.known[a, b]


def best_documents(lists: list[tuple[int, PostingList]], size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best ``k`` documents (numbers in ascending order of id) of a shard of ``size``, and their scores."""
    lists = sorted(lists, key=lambda x: x[0] * x[1].top)
    upto = np.cumsum([w * x.top for w, x in lists])
    best, scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for lo in range(0, size, WINDOW):
        hi = min(lo + WINDOW, size)
        essential = int(np.searchsorted(upto, least, side="right"))  # lists before it cannot pass by themselves
        if essential == len(lists):
            break
        spans = [x.blocks(lo, hi) for _, x in lists]
        bounds = [w * int(x.tops[a:b].max(initial=0)) for (w, x), (a, b) in zip(lists, spans, strict=True)]
        if sum(bounds) <= least:
            continue
        score = np.zeros(hi - lo, np.int64)
        for (w, x), (a, b) in zip(lists[essential:], spans[essential:], strict=True):
            if b > a:
                doc, gain = x.read(a, b)
                some = (doc >= lo) & (doc < hi)
                score[doc[some] - lo] += w * gain[some]
        candidates = np.flatnonzero(score)
        rest = sum(bounds[:essential])
        for i in range(essential - 1, -1, -1):
            w, x = lists[i]
            rest -= bounds[i]
            block = np.searchsorted(x.last, candidates + lo)
            bound = np.where(block < len(x.last), w * x.tops[np.minimum(block, len(x.last) - 1)], 0)
            alive = score[candidates] + bound + rest > least
            candidates, block, bound = candidates[alive], block[alive], bound[alive]
            if not len(candidates):
                break
            for b in np.unique(block[bound > 0]):
                here = candidates[block == b]
                doc, gain = x.read(int(b), int(b) + 1)
                at = np.minimum(np.searchsorted(doc, here + lo), len(doc) - 1)
                score[here] += np.where(doc[at] == here + lo, w * gain[at], 0)
        passed = candidates[score[candidates] > least]
        if len(passed):
            best, scores = np.concatenate([best, passed + lo]), np.concatenate([scores, score[passed]])
            order = np.lexsort((best, -scores))[:k]
            best, scores = best[order], scores[order]
            least = int(scores[-1]) if len(scores) == k else 0
    return best, scores


def search(index: Index, queries: DataFrame, id_column: str, text_column: str, k: int) -> DataFrame:
    """id_column, rank, doc_id, score: the ``k`` best documents of each query with a score above 0."""
    spark = index.rows.sparkSession
    words = F.regexp_extract_all(F.translate(F.col(text_column), _UPPER, _UPPER.lower()), F.lit(TERM), 1)
    items = queries.select(F.col(id_column).alias("item"), F.explode(words.cast("array<binary>")).alias("term")).distinct()
    items = materialise(items, "asked")
    numbered = items.select("item").distinct().withColumn("_q", F.monotonically_increasing_id())
    numbered = materialise(numbered, "numbered")
    n_items = numbered.count()
    if not n_items or not index.length:
        return queries.select(F.col(id_column), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    # Few shards are searched for smaller blocks of queries, so that all cores have work.
    shards = max(1, index.rows.where("term is null").count())
    parts = max(-(-n_items // QUERIES_PER_BLOCK), min(-(-n_items // 16), -(-2 * spark.sparkContext.defaultParallelism // shards)))
    asked = items.join(numbered, items["item"].eqNullSafe(numbered["item"])).select("term", "_q", F.pmod(F.xxhash64("_q"), F.lit(parts)).alias("part"))
    small = lambda df: F.broadcast(df) if items.count() <= BROADCAST_ROWS else df
    lists = index.rows.where("term is not null").join(small(items.select("term").distinct()), "term", "left_semi")
    lists = materialise(lists, "lists")
    # The weights of the terms asked for, in doubles, rounded down; then who asks for each, a block of queries at a time.
    ratio = F.lit(2 * index.docs + 2).cast("double") / (2 * F.col("df") + 1).cast("double")
    weights = lists.groupBy("term").agg(F.sum("df").alias("df")).select("term", F.floor(1000 * F.log(ratio)).alias("w")).where("w > 0")
    by_part = asked.groupBy("part", "term").agg(F.collect_list("_q").alias("who"))  # QUERIES_PER_BLOCK or so at most
    wanted = materialise(by_part.join(weights, "term"), "wanted")
    hits = lists.join(small(wanted), "term").select("shard", "part", "top", "heads", "postings", "who", "w")
    blocks = hits.select("shard", "part").distinct()
    # The shards' documents, one row for each shard, once for each block of queries.
    docs = index.rows.where("term is null").select("shard", F.lit(0).cast("long").alias("top"), "heads", "postings").join(blocks, "shard").select("shard", "part", "top", "heads", "postings", F.lit(None).cast("array<bigint>").alias("who"), F.lit(None).cast("bigint").alias("w"))

    def searched(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        own = next(r for r in rows if r["who"] is None)
        ids, valid = np.frombuffer(own["heads"], "<i8").reshape(2, -1)
        m = np.frombuffer(own["postings"], "<i8")
        by_query: dict[int, list[tuple[int, PostingList]]] = defaultdict(list)
        for r in rows:
            if r["who"] is not None:
                one = PostingList(r["top"], r["heads"], r["postings"], m)
                for q in r["who"]:
                    by_query[q].append((r["w"], one))
        out_q, out_d, out_s = [], [], []
        for q, mine in by_query.items():
            best, scores = best_documents(mine, len(m), k)
            out_q.append(np.full(len(best), q))
            out_d.append(best)
            out_s.append(scores)
        q, d, s = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_q, out_d, out_s))
        return pa.table({"_q": pa.array(q), "doc_id": pa.array(ids[d], mask=valid[d] == 0), "score": pa.array(s)})

    heaps = hits.unionByName(docs).groupBy("shard", "part").applyInArrow(searched, "_q long, doc_id long, score long")
    rank: Column = F.row_number().over(Window.partitionBy("_q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    top = heaps.withColumn("rank", rank).where(F.col("rank") <= k)
    named = numbered.withColumnRenamed("item", id_column)
    return top.join(F.broadcast(named) if n_items <= BROADCAST_ROWS else named, "_q").select(id_column, "rank", "doc_id", "score")


def op11_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best of all ``documents`` for each item of ``benchmark``."""
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), "item_id", "text", 50)


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
h AS (SELECT r, doc_id, t, len(t) AS n FROM d WHERE len(t) > 0),
s AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS length FROM h),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT DISTINCT term FROM q),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM h) u SEMI JOIN w USING (term) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * s.docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM p, s GROUP BY term, s.docs),
m AS (SELECT r, doc_id, 50 + (50 * n * docs) // length AS m FROM h, s),
g AS (SELECT p.r, m.doc_id, p.term, f.weight * ((1000000000 * p.tf) // (1000 * p.tf + 20 * m.m)) AS gain FROM p JOIN f USING (term) JOIN m USING (r)),
x AS (SELECT q.item_id, g.r, g.doc_id, CAST(sum(g.gain) AS BIGINT) AS score FROM q JOIN g USING (term) GROUP BY ALL),
k AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50
"""
