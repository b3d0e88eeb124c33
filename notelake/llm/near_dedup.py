"""Near-duplicates by DartMinHash signatures, a banded join and exact verification.

A text is the weighted set of its runs of ``width`` words: a run's weight is how often the text has it (or one, with
``weights="set"``). Every element has a region, as wide as its weight, at which darts are thrown: a Poisson process whose
darts have a rank and a hash. Of all darts in a text's regions each coordinate of the signature keeps the one of least
rank. Two texts agree in a coordinate with the probability of their weighted Jaccard similarity. A text with
many elements meets enough darts at low ranks and few elements have one there, so that a signature costs
little more than the hashes of the text's elements.

Links are pairs of different texts of weighted similarity ``least`` or more, found like this:

1. Texts that are equal are one item; what follows goes by the text's digest.
2. Bands of ``rows`` coordinates are buckets. The items of a bucket are compared with its least item, not
   with each other, so that a group of copies gives one pair for each item.
3. Pairs are verified on the whole sets. Verified links join items into classes.
4. What a bucket still holds in different classes is compared in full, across classes only: buckets of ``SMALL`` items by
   pairs, larger ones by pairs of blocks of bounded size, each one product of matrices. After that, no pair that shares a
   bucket and is similar enough is in two classes. Two texts of similarity 0.8 share no bucket with a probability of 3 in
   100,000 (20 bands of 4).

Step 4 is quadratic in the items of a bucket that stay in different classes, near copies of one text at 0.6 to 0.8 of
similarity, say. A prefix filter in its place was tried: such texts share their rarest elements, so that it emits as many pairs.

Buckets and classes are found by aggregation and equi-joins; a bucket that holds a third of all items is
pre-aggregated before its shuffle and split by the adaptive join after it. The links' components are found by
alternating stars, each round written to the shared folder.

A null text is no copy of anything. Empty texts, and texts without words, have no elements and are copies of
equal texts alone. A text of fewer than ``width`` words is one element. Very long texts are sets like others, whole, in slices of
few texts. Of texts that tie for a place the least id counts, then the least digest of the row. Rows may repeat and ids may be
null: classes are of texts, and each row gets its text's class. An empty table gives an empty result. Other columns,
whatever they are called, are ignored by ``near_duplicate_classes`` and kept by ``without_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.common import bitmap_of, materialise, quoted, row_slices, table
from notelake.llm.hashing import by_text, mixed, shingles, uniform

BANDS, ROWS, WIDTH, LEAST = 20, 4, 5, 0.8
#: Open buckets of more items than SMALL are compared by blocks of about BLOCK items, fewer where they have more than ELEMENTS together.
SMALL, BLOCK, ELEMENTS = 32, 256, 400_000
_ITEM = "item binary, id long, n long, bands array<long>"
#: Stands for a null id; larger than any other.
_NO_ID = 2**63 - 1


def _darts(elements: np.ndarray, width: np.ndarray, limit: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All darts of rank under ``limit`` in a region ``width`` wide: index of the element, rank, hash, place in the region."""
    at, rank, ids, place = [], [], [], []
    left, now, level = np.arange(len(elements)), np.zeros(len(elements)), 0
    while len(left):
        # Few elements need many darts each: as many levels at once as the work of one level with many elements.
        steps = int(np.clip(4096 // len(left), 1, 64))
        levels = np.arange(level, level + steps, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
        h = mixed(elements[left, None] ^ levels[None, :], salt)
        upto = now[left, None] + np.cumsum(-np.log(uniform(h)) / width[left, None], axis=1)
        row, col = np.nonzero(upto < limit[left, None])
        at.append(left[row])
        rank.append(upto[row, col])
        ids.append(mixed(h[row, col], 1))
        place.append(uniform(mixed(h[row, col], 2)) * width[left[row]])
        now[left] = upto[:, -1]
        left = left[upto[:, -1] < limit[left]]
        level += steps
    return np.concatenate(at or [np.zeros(0, np.int64)]), np.concatenate(rank or [np.zeros(0)]), np.concatenate(ids or [np.zeros(0, np.uint64)]), np.concatenate(place or [np.zeros(0)])


def dart_minhash(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, k: int) -> np.ndarray:
    """Signatures (n x k) of ``n`` weighted sets, whose entries are sorted by ``owner``. Sets without weight get zeros."""
    out = np.zeros((n, k), np.uint64)
    total = np.bincount(owner, weights=weights, minlength=n)
    todo = np.flatnonzero(total > 0)
    darts = k * (np.log(k) + 2)
    while len(todo):
        limit = np.zeros(n)
        limit[todo] = darts / total[todo]
        of, rank, ids = [], [], []
        # The region of weights is cut at 1, 3, 7, ...: the darts in a part are the same for all sets that reach it.
        for part in range(int(np.log2(weights.max() + 1)) + 1):
            low, wide = 2.0**part - 1, 2.0**part
            some = np.flatnonzero((weights > low) & (limit[owner] > 0))
            if not len(some):
                continue
            at, r, d, place = _darts(elements[some], np.full(len(some), wide), limit[owner[some]], 100 + part)
            hit = low + place <= weights[some[at]]
            of.append(owner[some[at[hit]]])
            rank.append(r[hit])
            ids.append(d[hit])
        of, rank, ids = np.concatenate(of), np.concatenate(rank), np.concatenate(ids)
        cell = of * k + (ids % np.uint64(k)).astype(np.int64)
        order = np.argsort(-rank, kind="stable")  # later ones overwrite: the least rank stays
        flat = np.zeros(n * k, np.uint64)
        full = np.zeros(n * k, bool)
        flat[cell[order]] = mixed(ids[order], 3)
        full[cell] = True
        done = todo[full.reshape(n, k)[todo].all(axis=1)]
        out[done] = flat.reshape(n, k)[done]
        todo = np.setdiff1d(todo, done, assume_unique=True)
        darts *= 2
    return out


def weighted_sets(texts: pa.Array, width: int, weights: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements, their weights and owners, sorted by owner and element."""
    h, owner = shingles(texts, width)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.r_[at, len(h)]).astype(float)
    return h[at], count if weights == "count" else np.ones(len(at)), owner[at]


def with_item(documents: DataFrame) -> DataFrame:
    """``documents`` with ``_item``, the digest that stands for equal texts; null for a null text."""
    return documents.withColumn("_item", F.unhex(F.md5(F.col("text").cast("binary"))))


def signatures(documents: DataFrame, width: int, weights: str, bands: int, rows: int) -> DataFrame:
    """item, n (the set's whole weight), bands (a hash for each band) of every different text that has elements."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("item", pa.binary()), ("id", pa.int64()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))])
        for batch in batches:
            for part in row_slices(batch, "text"):
                texts = part.column("text")
                h, w, owner = weighted_sets(texts, width, weights)
                if not len(h):
                    continue
                sig = dart_minhash(h, w, owner, len(texts), bands * rows)
                n = np.bincount(owner, weights=w, minlength=len(texts)).astype(np.int64)
                key = np.broadcast_to(np.arange(bands, dtype=np.uint64) + np.uint64(1), (len(texts), bands)) * np.uint64(0xC2B2AE3D27D4EB4F)
                for j in range(rows):
                    key = mixed(key ^ sig[:, j * bands : (j + 1) * bands], j)
                some = np.flatnonzero(n)
                flat = pa.array(key[some].astype(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * bands), flat)
                yield pa.RecordBatch.from_arrays([part.column("_item").take(pa.array(some)).cast(pa.binary()), part.column("_id").take(pa.array(some)), pa.array(n[some]), lists], schema=schema)

    texts = with_item(documents.select("doc_id", "text").where("text is not null")).select("_item", F.coalesce("doc_id", F.lit(_NO_ID)).alias("_id"), "text")
    return texts.mapInArrow(made, _ITEM).groupBy("item").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"))


def element_sets(documents: DataFrame, items: DataFrame, width: int, weights: str) -> DataFrame:
    """item, elements (distinct hashes) for the texts of ``items(item, id)``."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text"):
                h, w, owner = weighted_sets(part.column("text"), width, weights)
                if weights == "count":  # an element of weight w is w elements: Jaccard similarity of these sets is the weighted one
                    times = w.astype(np.int64)
                    copy = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    h, owner = mixed(np.repeat(h, times) ^ (copy.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)), 7), np.repeat(owner, times)
                ends = pa.array([0, *(e for _, e in by_text(owner, part.num_rows))], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("item").cast(pa.binary()), pa.ListArray.from_arrays(ends, pa.array(h.astype(np.int64)))], names=["item", "elements"])

    # By text and id, so that the copies of a text, however many, are not gathered: one row of them is read.
    texts = with_item(documents.select("doc_id", "text").where("text is not null")).select(F.col("_item").alias("item"), F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), "text")
    one = texts.join(items, ["item", "id"], "left_semi").groupBy("item", "id").agg(F.first("text").alias("text"))
    return one.select("item", "text").mapInArrow(made, "item binary, elements array<long>")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two arrays of distinct values."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / max(1, len(a) + len(b) - common)


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The rows of ``pairs(a, b)`` whose sets have similarity ``least`` or more."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lambda c, i: c[i].values.to_numpy(zero_copy_only=False)
        for batch in batches:
            x, y = batch.column("ea"), batch.column("eb")
            keep = [jaccard(of(x, i), of(y, i)) >= least for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(c).cast(pa.binary()) for c in ("a", "b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first = sets.select(F.col("item").alias("a"), F.col("elements").alias("ea"))
    second = sets.select(F.col("item").alias("b"), F.col("elements").alias("eb"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "ea", "eb").mapInArrow(kept, "a binary, b binary")


def overlaps(left: list[np.ndarray], right: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """How many elements each set of ``left`` shares with each of ``right``."""
    of = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    values = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right)]
    both = np.intersect1d(*values)
    out = np.zeros((len(left), len(right)), np.float32)
    at = [np.searchsorted(both, v) for v in values]
    found = [(a < len(both)) & (both[np.minimum(a, len(both) - 1)] == v) if len(both) else np.zeros(len(v), bool) for a, v in zip(at, values, strict=True)]
    for lo in range(0, len(both), columns):
        sides = []
        for k, n in enumerate((len(left), len(right))):
            some = found[k] & (at[k] >= lo) & (at[k] < lo + columns)
            m = np.zeros((n, min(columns, len(both) - lo)), np.float32)
            m[of[k][some], at[k][some] - lo] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def links_of_blocks(rows: pd.DataFrame, least: float) -> pd.DataFrame:
    """Of a pair of blocks (or a block with itself) links a < b that join all classes between which there are some."""
    i, j = rows["i"].iloc[0], rows["j"].iloc[0]
    x, y = rows[rows["own"] == i].reset_index(drop=True), rows[rows["own"] == j].reset_index(drop=True)
    if not len(x) or not len(y):
        return pd.DataFrame({"a": [], "b": []})
    sets_x, sets_y = list(map(np.asarray, x["elements"])), list(map(np.asarray, y["elements"]))
    common = overlaps(sets_x, sets_y)
    sim = common / (np.array([len(s) for s in sets_x])[:, None] + np.array([len(s) for s in sets_y])[None, :] - common)
    hit = np.argwhere(sim >= least - 1e-7)
    out, joined = [], {}

    def find(c: bytes) -> bytes:
        while c in joined:
            c = joined[c]
        return c

    for p, q in hit:  # classes that the block has joined already need no further link
        c, d = find(x["root"][p]), find(y["root"][q])
        if c != d and jaccard(sets_x[p], sets_y[q]) >= least:
            joined[c] = d
            out.append(sorted((x["item"][p], y["item"][q])))
    return pd.DataFrame(out, columns=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """item, root for every item in ``links(a, b)``: the least item of its connected component."""
    edges = materialise(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u < v").distinct(), "links")
    while True:
        # Large star: each node's larger neighbours go to the least of it and all its neighbours.
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = materialise(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m")), "least")
        large = materialise(both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct(), "large-star")
        # Small star: each node and its smaller neighbours go to the least of these.
        near = materialise(large.groupBy("v").agg(F.min("u").alias("m")), "near")
        small = large.join(near, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u < v").unionByName(near.select("v", F.col("m").alias("u"))).distinct()
        after = materialise(small, "stars")
        # Stars all: every node has one, smaller, neighbour, which has none.
        undone = after.groupBy("v").count().where("count > 1").select("v").unionByName(after.select(F.col("u").alias("v")).join(after.select("v"), "v", "left_semi")).limit(1).count()
        edges = after
        if not undone:
            return edges.select(F.col("v").alias("item"), F.col("u").alias("root")).unionByName(edges.select(F.col("u").alias("item"), F.col("u").alias("root")).distinct())


def links_and_classes(documents: DataFrame, width: int = WIDTH, least: float = LEAST, weights: str = "count", bands: int = BANDS, rows: int = ROWS, small: int = SMALL) -> DataFrame:
    """item, root for every text that has a near-duplicate (other than equal texts)."""
    items = materialise(signatures(documents, width, weights, bands, rows), "signatures")
    placed = items.select("item", "id", "n", F.explode("bands").alias("bucket"))
    # What is joined with the rows of hot buckets is written first: a join of two shuffles can be split where it is skewed.
    shared = placed.groupBy("bucket").agg(F.min(F.struct("item", "n")).alias("head"), F.count("*").alias("items")).where("items > 1").select("bucket", F.col("head.item").alias("a"), F.col("head.n").alias("na"))
    shared = materialise(shared, "heads")
    members = materialise(placed.join(shared, "bucket"), "buckets")
    close = lambda x, y: F.least(x, y) >= F.lit(least) * F.greatest(x, y)  # noqa: E731  sizes alone rule out the rest
    pairs = members.where(F.col("a") < F.col("item")).where(close(F.col("n"), F.col("na"))).select("a", F.col("item").alias("b")).distinct()
    candidates = members.select("item", "id").distinct()
    sets = materialise(element_sets(documents, candidates, width, weights), "sets")
    first = materialise(verified(pairs, sets, least), "first-links")
    classes = materialise(components(first), "first-classes")
    # Buckets that still hold items of more than one class.
    known = materialise(members.join(classes, "item", "left").select("bucket", "item", "n", F.coalesce("root", "item").alias("root")), "known")
    open_ = known.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("items"), F.sum("n").alias("total")).where("lo < hi").select("bucket", "items", "total")
    open_ = materialise(known.join(materialise(open_, "open-buckets"), "bucket"), "open")
    few = open_.where(F.col("items") <= small)
    x, y = (few.select("bucket", F.col("item").alias(i), F.col("n").alias(f"n{i}"), F.col("root").alias(f"r{i}")) for i in "ab")
    across = x.join(y, "bucket").where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & close(F.col("na"), F.col("nb"))).select("a", "b")
    second = verified(across.distinct().join(pairs, ["a", "b"], "left_anti"), sets, least)
    blocks = F.greatest(F.ceil(F.col("items") / BLOCK), F.ceil(F.col("total") / ELEMENTS)).cast("int")
    many = open_.where(F.col("items") > small).withColumn("own", F.pmod(F.xxhash64("item", "bucket"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    many = many.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "item", "root").join(sets, "item")
    third = many.groupBy("bucket", "i", "j").applyInPandas(lambda rows: links_of_blocks(rows, least), "a binary, b binary")
    more = materialise(second.unionByName(third), "more-links")
    if not more.limit(1).count():
        return classes
    stars = classes.where("item != root").select(F.col("item").alias("a"), F.col("root").alias("b"))
    return components(stars.unionByName(more))


def near_duplicate_classes(documents: DataFrame, **how) -> DataFrame:
    """doc_id, class_id (the least id in the class), class_size and is_kept (one row of each class) for every row."""
    return with_classes(documents.select("doc_id", "text"), **how).select("doc_id", F.col("_class").alias("class_id"), F.col("_size").alias("class_size"), F.col("_kept").alias("is_kept"))


def with_classes(documents: DataFrame, **how) -> DataFrame:
    """_item, _class, _size, _kept beside doc_id for every row of ``documents(doc_id, text)``."""
    classes = links_and_classes(documents.select("doc_id", "text"), **how)
    rows = materialise(with_item(documents.select("doc_id", "text")).select("doc_id", "_item", F.monotonically_increasing_id().alias("_row")), "rows")
    texts = rows.where("_item is not null").groupBy("_item").agg(F.count("*").alias("copies"), F.min(F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), "doc_id", "_row")).alias("first"))
    rooted = materialise(texts.join(classes.withColumnRenamed("item", "_item"), "_item", "left").withColumn("root", F.coalesce("root", "_item")), "rooted")
    whole = rooted.groupBy("root").agg(F.sum("copies").alias("_size"), F.min("first").alias("first"))
    whole = materialise(whole, "classes")
    of_text = rooted.select("_item", "root").join(whole, "root").select("_item", "_size", F.col("first.doc_id").alias("_class"), F.col("first._row").alias("_first"))
    return rows.join(of_text, "_item", "left").select(
        "doc_id", "_item", "_row",
        F.when(F.col("_item").isNull(), F.col("doc_id")).otherwise(F.col("_class")).alias("_class"),
        F.coalesce("_size", F.lit(1)).alias("_size"),
        (F.col("_item").isNull() | (F.col("_row") == F.col("_first"))).alias("_kept"),
    )


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))


def without_near_duplicates(documents: DataFrame, **how) -> DataFrame:
    """``documents`` with one row of each class: that of the least id, and of rows that repeat it the one of least hash.

    Rows whose text passes a bitmap of the texts of larger classes are joined and aggregated (before the shuffle as well);
    all others are kept where they are read.
    """
    classed = materialise(with_classes(documents, **how), "classed")
    contested = classed.where("_item is not null and _size > 1")
    kept = materialise(contested.where("_kept").select("_item", F.coalesce("_class", F.lit(_NO_ID)).alias("_id")), "kept")
    passing = bitmap_of(contested.select(F.xxhash64("_item").alias("h")), "h")
    bits, shared = len(passing), documents.sparkSession.sparkContext.broadcast(np.packbits(passing))

    @F.pandas_udf("boolean")
    def may_have(h: pd.Series) -> pd.Series:
        return pd.Series(np.unpackbits(shared.value).astype(bool)[h.to_numpy() % bits])

    rows = documents.select(F.struct(*quoted(documents.columns)).alias("_whole"), F.coalesce("doc_id", F.lit(_NO_ID)).alias("_id"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("_item"))
    rows = rows.withColumn("_may", F.coalesce(may_have(F.xxhash64("_item")), F.lit(False)) & F.col("_item").isNotNull())
    # What passes the bitmap by chance is of a class of its own: only rows of contested texts are dropped.
    others = materialise(contested.select("_item").distinct(), "contested")
    single = rows.where("_may").join(others, "_item", "left_anti")
    one = rows.where("_may").join(kept, ["_item", "_id"], "left_semi").groupBy("_item", "_id").agg(F.min_by("_whole", F.xxhash64("_whole")).alias("_whole"))
    return rows.where("not _may").select("_whole").unionByName(single.select("_whole")).unionByName(one.select("_whole")).select("_whole.*")
