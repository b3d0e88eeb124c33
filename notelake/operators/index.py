"""The stored full-text index: posting blocks of tokens, lengths and statistics, runs of characters of the vocabulary.

Notes are dealt into segments of about ``SEGMENT`` notes. A block holds what one segment has of one token: its notes with
how often each has the token, as it is written and with accents folded, and their lengths; and, beside them, the number of
notes, the most and the shortest. These bound what any note of the block can gain, whatever the statistics are when
it is asked. Blocks are written in order of their tokens, so that a reader of few tokens skips most row groups.

An index is read in parts: a whole one and those that were added since, and of a note that several parts have the last
counts. Statistics are of the notes that count: a note that was replaced or taken out is left out of them.

Searches read no text. The bounds of each query's segments come first; those of the best segments are scored in
full, and their kth score decides which of the others are read at all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.functions import text as T
from notelake.operators import recall as R
from notelake.plans.store import current, materialise

#: Notes in a segment; segments of a query that are scored before the others; tokens that are looked up by their names.
SEGMENT, FIRST_SEGMENTS, NAMED = 1_024, 2, 2_000
#: Characters of a run.
RUN = 3


def taken_apart(notes: DataFrame, key: str, text: Column) -> DataFrame:
    """key, t, f: a note's tokens as written, and folded where folding changes its text; each note's row is in the task of its key."""
    said = T.text_of(text)
    rows = notes.select(key, said.alias("_text")).repartition(key).withColumn("_folded", T.folded(F.col("_text")))
    return rows.select(key, T.tokens(F.col("_text")).alias("t"), F.when(F.col("_text") != F.col("_folded"), T.tokens(F.col("_folded"))).alias("f"))


def lengths(notes: DataFrame, key: str, text: Column) -> DataFrame:
    """key, dl: a note's tokens."""
    return notes.select(key, F.size(T.tokens(T.text_of(text))).alias("dl"))


def blocks(notes: DataFrame, key: str, text: Column, segments: int) -> DataFrame:
    """token, segment, n, nf, most, mostf, least, entries: the posting blocks of all notes, in order of tokens in each file.

    An entry is (key, times as written, times folded, length). Folding keeps the number of a text's tokens. A text that it leaves
    as it is is taken apart once.
    """
    rows = taken_apart(notes, key, text).withColumn("dl", F.size("t"))
    every = rows.select(key, "dl", F.col("f").isNull().alias("_same"), F.posexplode(F.concat("t", F.coalesce("f", F.array().cast("array<string>")))).alias("_at", "token"))
    plain = F.col("_at") < F.col("dl")
    tokens = every.groupBy(key, "dl", "token").agg(F.sum(plain.cast("int")).alias("tf"), F.sum((F.col("_same") | ~plain).cast("int")).alias("ff"))
    entry = F.struct(F.col(key).alias("key"), F.col("tf").cast("int").alias("tf"), F.col("ff").cast("int").alias("ff"), F.col("dl"))
    segment = F.pmod(F.xxhash64(key), F.lit(segments))
    made = tokens.withColumn("segment", segment).repartition("token").groupBy("token", "segment").agg(
        F.sum((F.col("tf") > 0).cast("long")).alias("n"), F.sum((F.col("ff") > 0).cast("long")).alias("nf"), F.max("tf").alias("most"), F.max("ff").alias("mostf"),
        F.min("dl").alias("least"), F.collect_list(entry).alias("entries"),
    )
    return made.sortWithinPartitions("token", "segment")


def runs(tokens: DataFrame) -> DataFrame:
    """run, token: the runs of characters of distinct tokens; a shorter token is its own run."""
    starts = F.when(F.length("token") > RUN, F.sequence(F.lit(1), F.length("token") - (RUN - 1))).otherwise(F.array(F.lit(1)))
    found = F.array_distinct(F.transform(starts, lambda i: F.substring("token", i, F.lit(RUN))))
    return tokens.select("token", F.explode(found).alias("run")).select("run", "token")


@dataclass
class Index:
    """Lengths, blocks and runs, each with the _place of its part; which part of a note counts (None: there is one part)."""

    key: str
    lengths: DataFrame
    blocks: DataFrame
    runs: DataFrame
    newest: DataFrame | None = None

    def stats(self) -> tuple[int, float]:
        """The number of notes that count and their mean length."""
        row = current(self.lengths, self.newest, self.key).agg(F.count("*").alias("docs"), F.avg("dl").alias("avgdl")).first()
        return row["docs"], row["avgdl"] or 0.0

    def of_tokens(self, tokens: DataFrame, names: list[str] | None = None) -> DataFrame:
        """The blocks of ``tokens(token)``: by their names, where these are given, by a join else."""
        if names is not None:
            return self.blocks.where(F.col("token").isin(names))
        return self.blocks.join(R.small(tokens.select("token").distinct()), "token", "left_semi")

    def counted(self, entries: DataFrame) -> DataFrame:
        """Of ``entries`` (of blocks, with key and _place) those of notes that count."""
        return current(entries.withColumnRenamed("key", self.key), self.newest, self.key)


def written(notes: DataFrame, key: str, text: Column, segments: int | None = None) -> dict[str, DataFrame]:
    """The tables of a part: rows (lengths), blocks and runs; blocks and runs are in order of what they are looked up by."""
    segments = segments or max(1, -(-notes.count() // SEGMENT))
    made = materialise(blocks(notes, key, text, segments), "blocks")
    found = runs(made.where("n > 0").select("token").distinct()).repartition("run").sortWithinPartitions("run")
    return {"rows": lengths(notes, key, text), "blocks": made, "runs": found}


def built(notes: DataFrame, key: str, text: Column) -> Index:
    """An index of one part. Its blocks are written to the shared folder; its runs are where a search first asks for them."""
    tables = {name: df.withColumn("_place", F.lit(0)) for name, df in written(notes, key, text).items()}
    tables["rows"] = materialise(tables["rows"], "lengths")
    return Index(key, tables["rows"], tables["blocks"], tables["runs"])


def _entries(hits: DataFrame, *columns: str) -> DataFrame:
    return hits.select(*columns, "_place", F.explode("entries").alias("e")).select(*columns, "_place", "e.*")


def asked_for(tokens: DataFrame) -> tuple[DataFrame, list[str] | None]:
    """``tokens`` ready to be joined, and the distinct ones by name where they are few: then they are rows of the driver's."""
    few = tokens.limit(NAMED + 1).collect()  # NAMED rows at most are kept
    if len(few) > NAMED:
        return R.small(tokens), None
    return F.broadcast(tokens.sparkSession.createDataFrame(few, tokens.schema)), sorted({r["token"] for r in few})


def lexical(index: Index, queries: DataFrame, query: str, k: int, text: str = "text") -> DataFrame:
    """As ``recall.lexical``, from the index."""
    asked, names = asked_for(R.query_tokens(queries, query, text))
    hits = index.of_tokens(asked, names).where("n > 0")
    found = index.counted(_entries(hits, "token").where("tf > 0")).join(asked, "token")
    scores = found.groupBy(query, index.key).agg(F.sum(F.col("tf") * F.col("times")).alias("score"))
    return R.best(scores, query, [F.desc("score"), F.col(index.key)], k)


def gain(tf: Column, length: Column, avgdl: float) -> Column:
    return tf * (R.K1 + 1) / (tf + R.K1 * (1 - R.B + R.B * length / F.lit(avgdl)))


def bm25(index: Index, queries: DataFrame, query: str, k: int, text: str = "text") -> DataFrame:
    """As ``recall.bm25``, from the index, without segments that cannot hold one of the best ``k``."""
    asked, names = asked_for(R.first_tokens(queries, query, text).groupBy(query, T.folded(F.col("token")).alias("token")).agg(F.sum("times").alias("times")))
    hits = materialise(index.of_tokens(asked, names).where("nf > 0"), "hits")  # the asked tokens' blocks, read several times
    counts = hits.groupBy("token").agg(F.sum("nf").alias("df"))
    if index.newest is not None:  # notes that were replaced or taken out do not count
        dead = _entries(hits, "token").where("ff > 0").join(index.newest.withColumnRenamed(index.key, "key"), "key")
        dead = dead.where((F.col("_place") != F.col("_newest")) | F.col("_gone")).groupBy("token").agg(F.count("*").alias("dead"))
        counts = counts.join(dead, "token", "left").select("token", (F.col("df") - F.coalesce("dead", F.lit(0))).alias("df")).where("df > 0")
    docs, avgdl = index.stats()
    idf = F.greatest(F.log((F.lit(docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(R.LEAST_IDF))
    terms = asked.join(counts, "token").select(query, "token", (idf * F.col("times")).alias("idf"))
    terms = terms if names is None else F.broadcast(terms)  # as few rows as were asked for
    bounds = hits.select("token", "segment", "_place", "mostf", "least").join(terms, "token")
    bounds = bounds.groupBy(query, "segment", "_place").agg(F.sum(F.col("idf") * gain(F.col("mostf"), F.col("least"), avgdl)).alias("bound"))
    bounds = materialise(bounds.withColumn("nth", F.row_number().over(R.Window.partitionBy(query).orderBy(F.desc("bound"), "_place", "segment"))), "bounds")

    def scored(some: DataFrame) -> DataFrame:
        wanted = terms.join(some, query).select(query, "token", "segment", "_place", "idf")
        own = hits.select("token", "segment", "_place", "entries").join(wanted, ["token", "segment", "_place"])
        found = index.counted(_entries(own, query, "token", "idf").where("ff > 0"))
        return found.groupBy(query, index.key).agg((-F.sum(F.col("idf") * gain(F.col("ff"), F.col("dl"), avgdl))).alias("raw")).withColumn("bm25", F.round("raw", 4) + 0.0)

    first = materialise(scored(bounds.where(F.col("nth") <= FIRST_SEGMENTS)), "first-segments")
    kth = first.withColumn("_nth", F.row_number().over(R.Window.partitionBy(query).orderBy("bm25"))).where(F.col("_nth") == k).select(query, F.col("bm25").alias("kth"))
    more = bounds.where(F.col("nth") > FIRST_SEGMENTS).join(kth, query, "left").where(F.col("kth").isNull() | (-F.col("bound") <= F.col("kth") + 1e-4))
    return R.best(first.unionByName(scored(more.select(query, "segment", "_place"))), query, [F.col("bm25"), F.col(index.key)], k).select(query, index.key, "bm25", "rank")


def containing(index: Index, strings: DataFrame) -> DataFrame:
    """string, token: which tokens contain which of ``strings(string)``, by the rarest run of each string.

    Strings are runs of letters and digits. Shorter ones than a run are held against the vocabulary.
    """
    strings = materialise(strings.where("string <> ''").select("string").distinct(), "strings")
    long_ = strings.where(F.length("string") >= RUN)
    starts = F.sequence(F.lit(1), F.length("string") - (RUN - 1))
    own = long_.select("string", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring("string", i, F.lit(RUN))))).alias("run"))
    few = own.select("run").distinct().limit(NAMED + 1).collect()
    index_runs = materialise(index.runs, "runs")
    known = index_runs.where(F.col("run").isin([r["run"] for r in few])) if len(few) <= NAMED else index_runs.join(R.small(own.select("run").distinct()), "run", "left_semi")
    sizes = own.join(known.groupBy("run").agg(F.count("*").alias("size")), "run")
    rarest = R.small(sizes.groupBy("string").agg(F.min_by("run", F.struct("size", "run")).alias("run"), F.count("*").alias("found")).join(own.groupBy("string").agg(F.count("*").alias("all")), "string").where("found = all").select("string", "run"))
    out = known.join(rarest, "run").where(F.contains("token", F.col("string"))).select("string", "token")
    short = strings.where(F.length("string") < RUN)
    if short.limit(1).count():
        words = index_runs.select("token").distinct()
        out = out.unionByName(words.join(R.small(short), F.contains("token", F.col("string"))).select("string", "token"))
    return out.distinct()


def substring_recall(index: Index, queries: DataFrame, query: str, k: int, text: str = "text") -> DataFrame:
    """As ``recall.substring_recall``, from the index: a token is in a text if it is in one of the text's tokens."""
    asked, _ = asked_for(R.first_tokens(queries, query, text))
    sizes = R.small(asked.groupBy(query).agg(F.sum("times").alias("size")))
    words, names = asked_for(containing(index, asked.select(F.col("token").alias("string"))))
    hits = index.of_tokens(words, names).where("n > 0").join(words, "token")
    found = index.counted(_entries(hits, "string").where("tf > 0")).select(index.key, F.col("string").alias("token")).distinct()
    scores = found.join(asked, "token").groupBy(query, index.key).agg(F.sum("times").alias("n")).join(sizes, query)
    return R.best(scores.select(query, index.key, F.round(F.col("n") / F.col("size"), 4).alias("score")), query, [F.desc("score"), F.col(index.key)], k)


def full_text(index: Index, queries: DataFrame, query: str, k: int, text: str = "text") -> DataFrame:
    """As ``recall.full_text``, from the index."""
    top = bm25(index, queries, query, k, text)
    hits = materialise(top.select(query, index.key, R.compatible_score(F.col("bm25")).alias("score"), F.col("bm25").alias("tie")), "full-text")
    without = materialise(queries.join(hits.select(query).distinct(), query, "left_anti"), "without-hits")
    if without.limit(1).count():
        hits = hits.unionByName(substring_recall(index, without, query, k, text).select(query, index.key, "score", F.lit(0.0).alias("tie")))
    return R.best(hits, query, [F.desc("score"), F.col("tie"), F.col(index.key)], k).drop("tie")
