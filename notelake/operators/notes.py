"""Notes from raw captures, their order, their generation digest, and incremental upkeep."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.functions import text as T
from notelake.plans.store import materialise
from notelake.sources.captures import DEFAULT_CONFIDENCE


#: The first note's second, and how far ids may move a timestamp from it: years of four digits.
EPOCH, EARLIEST, LATEST = 1_704_067_200, -28_000_000_000, 251_000_000_000


def id_in_path(doc_id: Column) -> Column:
    """An id's digits, all of them and eight at least, with m for a minus: no two ids have the same."""
    text = F.replace(doc_id.cast("string"), F.lit("-"), F.lit("m"))
    return F.when(F.length(text) < 8, F.lpad(text, 8, "0")).otherwise(text)


def timestamp_of(doc_id: Column) -> Column:
    """A second for each id; ids too far off for that share the first or the last one, and go by path among each other."""
    seconds = F.greatest(F.least(doc_id, F.lit(LATEST)), F.lit(EARLIEST)) + EPOCH
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def from_documents(documents: DataFrame) -> DataFrame:
    """The ``documents`` table as captures: path, text, resource, timestamp and the tags that the data give."""
    return documents.select(
        "doc_id",
        F.concat(F.lit("concepts/doc-"), id_in_path(F.col("doc_id")), F.lit(".md")).alias("path"),
        T.text_of("text").alias("body"),
        F.col("source").alias("resource"),
        timestamp_of(F.col("doc_id")).alias("timestamp"),
        F.array_compact(F.array("lang", "source")).alias("given_tags"),
    )


def with_description(captures: DataFrame) -> DataFrame:
    return captures.withColumn("description", T.summary(F.col("body"))).withColumn("title", T.title(F.col("description")))


def keyword_ranks(captures: DataFrame, key: str = "doc_id", body: str = "body") -> DataFrame:
    """key, token, n, rank: a text's words by number, ties by first place. A text's words are counted before any shuffle."""
    words = captures.select(key, F.posexplode(T.tokens(F.col(body))).alias("pos", "token")).where(T.is_keyword(F.col("token")))
    counts = words.groupBy(key, "token").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "first"))
    return counts.withColumn("rank", rank).select(key, "token", "n", "rank")


def first_words(lists: pa.ListArray, n: int) -> pa.ListArray:
    """Of each list of words the ``n`` that it has most often, ties by first place."""
    words, sizes = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    coded = words.dictionary_encode()
    owner, codes, many = np.repeat(np.arange(len(sizes)), sizes), coded.indices.to_numpy(zero_copy_only=False), max(1, len(coded.dictionary))
    found, first, times = np.unique(owner * many + codes, return_index=True, return_counts=True)
    order = np.lexsort((first, -times, found // many))
    own = (found // many)[order]
    rank = np.arange(len(own)) - np.searchsorted(own, own)
    best = order[rank < n]
    ends = np.searchsorted(found[best] // many, np.arange(len(sizes) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), coded.dictionary.take(pa.array(found[best] % many)).cast(pa.string()))


def keywords_in_row(body: Column, n: int) -> Column:
    """A text's first ``n`` keywords as ``keyword_ranks`` has them, counted where the text is read: no shuffle."""

    @F.arrow_udf("array<string>")
    def first(words: pa.Array) -> pa.Array:
        return first_words(words, n)

    return first(F.filter(T.tokens(body), T.is_keyword))


def each_once(rows: DataFrame, key: str) -> bool:
    """Whether every row has a key of its own: a job over that column alone."""
    return not rows.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(key).isNull()).limit(1).count()


def build_notes(captures: DataFrame, base_tags: tuple[str, ...] = (), keywords: int = 5, apart: bool = False) -> DataFrame:
    """Notes with title, description and tags: the given ones and the text's first keywords.

    ``apart``: every capture has an id of its own (see ``each_once``). Else the keywords of an id are those of all its rows.
    """
    if apart:
        notes = with_description(captures).withColumn("words", keywords_in_row(F.col("body"), keywords))
    else:
        top = keyword_ranks(captures).where(F.col("rank") <= keywords).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]).alias("words"))
        notes = with_description(captures).join(top, "doc_id", "left")
    given = F.concat(F.array(*map(F.lit, base_tags)).cast("array<string>"), "given_tags", F.coalesce("words", F.array().cast("array<string>")))
    return notes.withColumn("tags", F.array_distinct(given)).withColumn("confidence", F.lit(DEFAULT_CONFIDENCE)).drop("words", "given_tags")


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` numbered from 0 in ``order``. Ranges are sorted apart and offset by the sizes of those before them."""
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    placed = materialise(ranged.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))  # one row for each range
    return placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_at") - F.shiftleft("_part", 33)).drop("_at", "_part", "_before")


def with_sections(notes: DataFrame, key: str = "doc_id", body: str = "body") -> DataFrame:
    """Notes with claims (their first five sentences), open_questions and related (their eight keywords)."""
    top = keyword_ranks(notes, key, body).where(F.col("rank") <= 8).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]).alias("related"))
    sections = notes.withColumns({"claims": F.slice(T.sentences(T.text_of(body)), 1, 5), "open_questions": T.open_questions(T.text_of(body))})
    return sections.join(top, key, "left").withColumn("related", F.coalesce("related", F.array().cast("array<string>")))


def nearest_ranks(counted: DataFrame, group: str, value: str, n: str, shares: dict[str, float]) -> DataFrame:
    """group, runs and nearest-rank percentiles of ``value``, each of whose rows counts ``n`` times.

    Running sums are made in ranges of (group, value) and offset by those of the ranges before: no task has a whole group.
    """
    spark = counted.sparkSession
    ranged = counted.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), group, value).withColumn("_part", F.spark_partition_id())
    placed = materialise(ranged, "percentiles")
    sums = placed.groupBy("_part", group).agg(F.sum(n).alias("_n"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("_part", group, before.alias("_before"), F.sum("_n").over(whole).alias("runs"))  # a row for each range and group
    upto = F.col("_before") + F.sum(n).over(Window.partitionBy("_part", group).orderBy(value))
    ranked = placed.join(offsets, ["_part", group]).withColumn("_upto", upto)
    return ranked.groupBy(group).agg(F.max("runs").alias("runs"), *[F.min(F.when(F.col("_upto") >= F.ceil(F.col("runs") * p), F.col(value))).alias(name) for name, p in shares.items()])


def with_following(rows: DataFrame, group: list[str], order: list[Column], value: str, n: int) -> DataFrame:
    """``rows`` with ``following``: the values of the next ``n`` rows of the same group in ``order``.

    Rows are sorted in ranges of equal size, whatever the groups' sizes; a range gets the first ``n`` rows of each of the
    ``n`` ranges after it as guests, so that a group may cross any border.
    """
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *group, *order).sortWithinPartitions(*group, *order)
    placed = materialise(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranges").withColumn("_part", F.shiftright("_at", 33))
    ranges = placed.select("_part").distinct().select("_part", F.row_number().over(Window.orderBy("_part")).alias("_range"))  # one row for each range
    own = placed.join(F.broadcast(ranges), "_part").withColumn("_guest", F.lit(False))
    guests = own.where(F.col("_at") - F.shiftleft("_part", 33) < n).withColumn("_guest", F.lit(True)).withColumn("_range", F.explode(F.sequence(F.col("_range") - n, F.col("_range") - 1)))
    after = Window.partitionBy("_range").orderBy("_at")
    same = lambda i: F.lead(F.struct(*group), i).over(after).eqNullSafe(F.struct(*group))
    following = F.array_compact(F.array(*[F.when(same(i), F.lead(value, i).over(after)) for i in range(1, n + 1)]))
    return own.unionByName(guests).withColumn("following", following).where("not _guest").drop("_at", "_part", "_range", "_guest")


#: Notes that a leaf of a digest tree is to have, and hexadecimal digits of its prefix at most.
LEAF, DEEPEST = 256, 10
_WORDS = ("w1", "w2", "w3", "w4")


def digests(notes: DataFrame, key: str = "path", content: str = "body") -> DataFrame:
    """key, place, w1 to w4: where each note is in the tree, by a hash of its key, and the digest of its key and content."""
    line = F.sha2(F.concat(F.col(key), F.lit("\n"), F.sha2(T.text_of(content).cast("binary"), 256)).cast("binary"), 256)
    rows = notes.select(key, F.sha1(F.col(key).cast("binary")).alias("place"), line.alias("_d"))
    word = lambda i: F.conv(F.substring("_d", 1 + 16 * i, 16), 16, -10).cast("long")  # noqa: E731  all 64 bits, signed
    return rows.select(key, "place", *[word(i).alias(w) for i, w in enumerate(_WORDS)])


def digest_tree(lines: DataFrame, depth: int) -> DataFrame:
    """level, prefix, n, w1 to w4: digests of all notes below each prefix of places, from none (level 0) to ``depth`` digits.

    Digests merge: a node's is the exclusive or of its notes', whatever their order, and of its children's.
    """
    sums = lambda df, *by: df.groupBy(*by).agg(F.sum("n").alias("n"), *[F.bit_xor(w).alias(w) for w in _WORDS])
    leaves = materialise(sums(lines.withColumn("n", F.lit(1).cast("long")), F.substring("place", 1, depth).alias("prefix")), "leaves")
    out = leaves.withColumn("level", F.lit(depth))
    for level in range(depth - 1, -1, -1):
        out = out.unionByName(sums(leaves.withColumn("prefix", F.substring("prefix", 1, level)), "prefix").withColumn("level", F.lit(level)))
    return out.select("level", "prefix", "n", *_WORDS)


def tree_depth(n: int) -> int:
    """Digits enough for leaves of about ``LEAF`` of ``n`` notes."""
    depth = 1
    while depth < DEEPEST and n > LEAF * 16**depth:
        depth += 1
    return depth


def tree_differences(before: DataFrame, after: DataFrame, lines_before: DataFrame, lines_after: DataFrame, key: str = "path") -> DataFrame:
    """key, status (added, deleted, changed) of the notes in which two trees of one depth differ.

    Level by level only children of nodes that differ are compared, and of the notes only those below leaves that do.
    """
    depth = before.agg(F.max("level").alias("d")).first()["d"]
    node = F.struct("n", *_WORDS)
    differ = None
    for level in range(depth + 1):
        sides = [t.where(F.col("level") == level).select("prefix", node.alias(name)) for t, name in ((before, "was"), (after, "now"))]
        if differ is not None:
            above = differ.withColumnRenamed("prefix", "_above")
            sides = [x.join(above, F.substring("prefix", 1, level - 1) == F.col("_above"), "left_semi") for x in sides]
        both = sides[0].join(sides[1], "prefix", "full_outer").where(~F.col("was").eqNullSafe(F.col("now")))
        differ = materialise(both.select("prefix"), "differ")
    below = lambda x, name: x.join(differ, F.substring("place", 1, depth) == F.col("prefix"), "left_semi").select(key, F.struct(*_WORDS).alias(name))
    rows = below(lines_before, "was").join(below(lines_after, "now"), key, "full_outer").where(~F.col("was").eqNullSafe(F.col("now")))
    return rows.select(key, F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").otherwise("changed").alias("status"))


def _bucket_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, n, digest of buckets whose sorted lines follow each other: hashed as they come, none is held whole."""
    done, bucket, n, state = [], None, 0, hashlib.sha256()
    for batch in batches:
        rows = zip(batch.column("bucket").to_pylist(), batch.column("line").to_pylist(), strict=True)
        for key, same in itertools.groupby(rows, key=lambda x: x[0]):
            if n and key != bucket:
                done.append((bucket, n, state.hexdigest()))
                n, state = 0, hashlib.sha256()
            lines = [line for _, line in same]
            if key is not None:
                state.update((b"\n" if n else b"") + b"\n".join(lines))
            bucket, n = key, n + len(lines)
    if n:
        done.append((bucket, n, state.hexdigest()))
    buckets, counts, hashes = zip(*done, strict=True) if done else ((), (), ())
    yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.string()), pa.array(counts, pa.int64()), pa.array(hashes, pa.string())], ["bucket", "n", "digest"])


def generation(notes: DataFrame, key: str = "path", content: str = "body") -> DataFrame:
    """notes, generation: one digest of all notes in order of path, of digests of the sorted lines of 4,096 buckets by path hash.

    Every line counts as often as it is there. Notes without a path are counted alone; without lines there is no digest.
    """
    line = F.concat(F.col(key), F.lit("\n"), F.sha2(T.text_of(content).cast("binary"), 256)).cast("binary")
    rows = notes.select(F.substring(F.sha1(F.col(key).cast("binary")), 1, 3).alias("bucket"), line.alias("line"))
    parts = rows.repartition("bucket").sortWithinPartitions("bucket", "line").mapInArrow(_bucket_digests, "bucket string, n long, digest string")
    hashed = F.array_sort(F.collect_list(F.when(F.col("bucket").isNotNull(), F.struct("bucket", "digest"))))
    whole = F.array_join(F.transform(hashed, lambda x: x["digest"]), "\n")
    return parts.agg(F.sum("n").alias("notes"), F.when(F.count("bucket") > 0, F.sha2(whole.cast("binary"), 256)).alias("generation"))


def freshness(previous: DataFrame, current: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """key, status: added, deleted, changed or same, by full outer join."""
    a = previous.select(key, F.struct(*compared).alias("was"))
    b = current.select(key, F.struct(*compared).alias("now"))
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("was") == F.col("now"), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def upsert(base: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """``base`` with the rows of ``delta`` in place of those of the same key.

    Where ``delta`` repeats a key, one of its rows counts, the same one each time. Rows with a true ``deleted``, if ``delta``
    has that column, take their key out.
    """
    columns = base.columns
    whole = F.struct(*columns, *(["deleted"] if "deleted" in delta.columns else []))
    last = delta.groupBy(key).agg(F.max_by(whole, F.xxhash64(*columns)).alias("_row"))
    gone = F.coalesce(F.col("_row.deleted"), F.lit(False)) if "deleted" in delta.columns else F.lit(False)
    return base.join(delta.select(key), key, "left_anti").unionByName(last.where(~gone).select("_row.*").select(*columns))
