"""Lexical, full-text, substring, vector and fused recall: every query of a table of queries against all notes.

The query side is a table of its own. It is broadcast where it is found to be small and joined by a shuffle
where it is not; notes are never sent to the queries. Scores are summed for each (query, note) before the
shuffle, and the best k of each query are kept by a ranked limit that Spark applies before the shuffle too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.functions import text as T
from notelake.operators.embedding import hashed_matrix
from notelake.operators.notes import each_once
from notelake.plans.store import materialise

#: Query tables of so many rows at most are broadcast, and tables of ids alone.
BROADCAST_ROWS, ID_ROWS = 200_000, 2_000_000
#: Fixed values of the ranking: BM25's constants and the least weight of a term.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: So many tokens of a query count in full-text and substring search.
QUERY_TOKENS = 8


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` written, and marked for broadcast if it has few rows."""
    df = materialise(df, "small")
    return F.broadcast(df) if df.count() <= rows else df


def best(rows: DataFrame, query: str, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(query).orderBy(*order))
    return rows.withColumn(rank, nth).where(F.col(rank) <= k).withColumn(rank, F.col(rank).cast("long"))


def query_tokens(queries: DataFrame, query: str, text: str) -> DataFrame:
    """query, token, times: a token counts as often as the query has it."""
    return queries.select(query, F.explode(T.tokens(T.text_of(text))).alias("token")).groupBy(query, "token").agg(F.count("*").alias("times"))


def first_tokens(queries: DataFrame, query: str, text: str) -> DataFrame:
    """query, token, times: the first tokens of each query; one that comes again there counts again."""
    return queries.select(query, F.explode(F.slice(T.tokens(T.text_of(text)), 1, QUERY_TOKENS)).alias("token")).groupBy(query, "token").agg(F.count("*").alias("times"))


def term_counts(notes: DataFrame, key: str, text: str) -> DataFrame:
    """key, token, tf."""
    return notes.select(key, F.explode(T.tokens(T.text_of(text))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))


#: Tables of queries are held against texts as a matrix of tokens and queries: so many queries, rows and cells at most.
MATRIX_QUERIES, MATRIX_CELLS = 2_048, 1 << 25
#: Entries of texts that are summed up at once.
ENTRIES = 8_192


class Asked:
    """A small table of queries: ``ids`` in order, ``tokens``, and ``weights``, how often each query asks for each token."""

    def __init__(self, rows: list, query: str) -> None:
        self.ids = np.array(sorted({r[query] for r in rows}), np.int64)
        self.tokens = sorted({r["token"] for r in rows})
        at = {t: i for i, t in enumerate(self.tokens)}
        self.weights = np.zeros((len(self.tokens), len(self.ids)))
        for r in rows:
            self.weights[at[r["token"]], np.searchsorted(self.ids, r[query])] += r["times"]

    @classmethod
    def of(cls, asked: DataFrame, query: str, notes: DataFrame, key: str) -> Asked | None:
        """None where a join is to do it: many queries, names for keys, or keys that repeat."""
        whole = lambda df, c: df.schema[c].dataType.simpleString() in ("bigint", "int")
        if not whole(asked, query) or not whole(notes, key):
            return None
        rows = asked.where(F.col(query).isNotNull()).limit(BROADCAST_ROWS + 1).collect()
        if len(rows) > BROADCAST_ROWS or len({r[query] for r in rows}) > MATRIX_QUERIES or len({r[query] for r in rows}) * len({r["token"] for r in rows}) > MATRIX_CELLS:
            return None
        return cls(rows, query) if each_once(notes, key) else None


class Best:
    """The best ``k`` rows of each query so far, ties by ``sign`` times key: what a task keeps of the texts that it reads."""

    def __init__(self, queries: int, k: int, sign: int = 1) -> None:
        self.k, self.sign, self.least = k, sign, np.full(queries, -np.inf)
        self.who, self.key, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, keys: np.ndarray, scores: np.ndarray, hit: np.ndarray) -> None:
        """``scores`` of rows and queries; ``hit``: where there is one."""
        row, who = np.nonzero(hit & (scores >= self.least))
        if not len(row):
            return
        who, key, score = np.concatenate([self.who, who]), np.concatenate([self.key, keys[row]]), np.concatenate([self.score, scores[row, who]])
        order = np.lexsort((self.sign * key, -score, who))
        order = order[np.arange(len(order)) - np.searchsorted(who[order], who[order]) < self.k]
        self.who, self.key, self.score = who[order], key[order], score[order]
        n = np.bincount(self.who, minlength=len(self.least))
        full = np.flatnonzero(n >= self.k)
        self.least[full] = self.score[np.cumsum(n)[full] - 1]

    def batch(self, ids: np.ndarray, names: list[str], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids[self.who]), pa.array(self.key), pa.array(self.score).cast(kind)], names=names)


def _some(owner: np.ndarray, most: int = ENTRIES) -> Iterator[tuple[int, int]]:
    """Where to cut entries, in order of their owners, so that an owner is whole."""
    lo = 0
    while lo < len(owner):
        hi = min(lo + most, len(owner))
        if hi < len(owner):
            cut = int(np.searchsorted(owner, owner[hi], side="left"))
            hi = cut if cut > lo else int(np.searchsorted(owner, owner[hi], side="right"))
        yield lo, hi
        lo = hi


def _summed(best_: Best, keys: np.ndarray, owner: np.ndarray, entries: Callable[[slice], np.ndarray], done: Callable[[np.ndarray], np.ndarray]) -> None:
    """Adds to ``best_`` what rows of ``entries`` (a row of queries for each) come to for each owner."""
    for lo, hi in _some(owner):
        own = owner[lo:hi]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        sums = np.add.reduceat(entries(slice(lo, hi)), first, axis=0)
        best_.add(keys[own[first]], done(sums), sums > 0)


def _coded(words: pa.Array, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lists of words those among ``tokens``: their lists' numbers and their own; and the lists' lengths."""
    sizes = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = pc.index_in(words.flatten(), value_set=tokens).fill_null(-1).to_numpy(zero_copy_only=False)
    some = np.flatnonzero(codes >= 0)
    return np.repeat(np.arange(len(sizes)), sizes)[some], codes[some], sizes


def token_scores(rows: DataFrame, asked: Asked, key: str, query: str, k: int, newest: bool = False) -> DataFrame:
    """query, key, score, rank of ``rows(key, t)``: how often their words are asked for. Ties go to the least key or the ``newest``."""
    shared, sign = rows.sparkSession.sparkContext.broadcast(asked), -1 if newest else 1

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        tokens, found = pa.array(q.tokens, pa.string()), Best(len(q.ids), k, sign)
        for batch in batches:
            owner, codes, _ = _coded(batch.column("t"), tokens)
            _summed(found, batch.column(key).to_numpy(zero_copy_only=False), owner, lambda s, codes=codes: q.weights[codes[s]], lambda x: x)
        yield found.batch(q.ids, [query, key, "score"], pa.int64())

    scores = rows.select(F.col(key).cast("long").alias(key), "t").mapInArrow(made, f"{query} long, {key} long, score long")
    return best(scores, query, [F.desc("score"), F.desc(key) if newest else F.col(key)], k)


def lexical(notes: DataFrame, queries: DataFrame, key: str, query: str, k: int, text: str = "text") -> DataFrame:
    """query, key, score, rank: the sum of the query tokens' frequencies, repeated tokens counting again.

    A small table of queries is a matrix that each batch of texts is multiplied with: no pair of a text and a query is a row but
    the best. Else tokens are joined.
    """
    asked = query_tokens(queries, query, text)
    if (matrix := Asked.of(asked, query, notes, key)) is not None:
        return token_scores(notes.select(key, T.tokens(T.text_of(text)).alias("t")), matrix, key, query, k)
    asked = small(asked)
    hits = notes.select(key, F.explode(T.tokens(T.text_of(text))).alias("token")).join(asked, "token")
    scores = hits.groupBy(query, key).agg(F.sum("times").alias("score"))
    return best(scores, query, [F.desc("score"), F.col(key)], k)


def containing(notes: DataFrame, strings: DataFrame, key: str, text: Column) -> DataFrame:
    """key, string: which of ``strings(string)`` each note's text contains.

    A string is looked for by one of its words: an inner one, which a text that contains the string has as a whole
    word, or else its longest, which is then part of some word of the text. Words are found by equi-joins: whole ones
    by themselves, parts by their first characters (three, or as many as there are). What is found is held against the
    text. Strings without a word are held against every text, a small table of queries against all rows.
    """
    longest = lambda a: F.element_at(F.array_sort(a, lambda x, y: F.length(y) - F.length(x)), 1)
    toks = F.regexp_extract_all("string", F.lit(r"([\p{L}\p{N}]+)"), 1)
    asked = strings.where("string <> ''").select("string").distinct().withColumn("t", toks)
    inner = F.filter(F.slice("t", 2, F.greatest(F.size("t") - 2, F.lit(0))), lambda w: F.length(w) >= 3)
    asked = asked.withColumn("inner", inner).select("string", F.when(F.size("inner") > 0, longest(F.col("inner"))).alias("whole"), F.when(F.size("t") > 0, longest(F.col("t"))).alias("part"))
    asked = materialise(asked, "strings")
    rows = notes.select(key, text.alias("_text"))
    words = rows.select(key, F.explode(F.array_distinct(F.regexp_extract_all("_text", F.lit(r"([\p{L}\p{N}]+)"), 1))).alias("word"))
    by_whole = asked.where("whole is not null").select("string", F.col("whole").alias("word"))
    by_part = asked.where("whole is null and part is not null").select("string", "part", F.substring("part", 1, 3).alias("gram"))
    found = words.join(small(by_whole), "word").select(key, "string")
    if by_part.limit(1).count():
        # The words of all texts once, by their runs of one, two and three characters, as far as any string asks for them.
        sizes = [r[0] for r in by_part.select(F.length("gram")).distinct().collect()]
        runs = lambda n: F.when(F.length("word") >= n, F.transform(F.sequence(F.lit(1), F.length("word") - (n - 1)), lambda i: F.substring("word", i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
        grams = F.array_distinct(F.flatten(F.array(*map(runs, sizes))))
        pieces = words.select("word").distinct().select("word", F.explode(grams).alias("gram"))
        with_part = pieces.join(small(by_part), "gram").where(F.contains("word", F.col("part"))).select("word", "string").distinct()
        found = found.unionByName(words.join(small(with_part), "word").select(key, "string"))
    found = materialise(found.distinct(), "may-contain")
    exact = found.join(asked.where("whole is null and string = part").select("string"), "string", "left_semi").select(key, "string")
    checked = found.join(asked.where("whole is not null or string <> part").select("string"), "string", "left_semi").join(rows, key).where(F.contains("_text", F.col("string"))).select(key, "string")
    out = exact.unionByName(checked)
    bare = asked.where("part is null").select("string")
    if bare.limit(1).count():
        out = out.unionByName(rows.join(small(bare), F.contains("_text", F.col("string"))).select(key, "string"))
    return out


class Parts:
    """Which of a few strings of letters and digits each word contains; a word that comes again is not taken apart again."""

    def __init__(self, strings: list[str], most: int = 200_000) -> None:
        self.code, self.sizes, self.most = {s: i for i, s in enumerate(strings)}, sorted(set(map(len, strings))), most
        self.known: dict[str, np.ndarray] = {}

    def of(self, words: list[str]) -> list[np.ndarray]:
        if len(self.known) > self.most:
            self.known.clear()
        for w in words:
            if w not in self.known:
                found = {self.code.get(w[i : i + n], -1) for n in self.sizes for i in range(len(w) - n + 1)}
                self.known[w] = np.array(sorted(found - {-1}), np.int64)
        return [self.known[w] for w in words]


def _part_scores(rows: DataFrame, asked: Asked, key: str, query: str, k: int) -> DataFrame:
    """``substring_recall`` of ``rows(key, t)``: a token is in a text if it is in one of its words."""
    shared = rows.sparkSession.sparkContext.broadcast(asked)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        parts, found, size, many = Parts(q.tokens), Best(len(q.ids), k), q.weights.sum(axis=0), max(1, len(q.tokens))
        for batch in batches:
            words = batch.column("t")
            sizes = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = words.flatten().dictionary_encode()
            lists, which = parts.of(coded.dictionary.to_pylist()), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            n = np.array([len(x) for x in lists], np.int64)
            if not n.sum():
                continue
            flat, start, times = np.concatenate(lists), np.cumsum(n) - n, n[which]
            at = np.repeat(start[which] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            pairs = np.unique(np.repeat(np.repeat(np.arange(len(sizes)), sizes), times) * many + flat[at])  # a string counts once a text
            owner, codes = pairs // many, pairs % many
            _summed(found, batch.column(key).to_numpy(zero_copy_only=False), owner, lambda s, codes=codes: q.weights[codes[s]], lambda x: np.round(x / size, 4))
        yield found.batch(q.ids, [query, key, "score"], pa.float64())

    return best(rows.mapInArrow(made, f"{query} long, {key} long, score double"), query, [F.desc("score"), F.col(key)], k)


def _gains(notes: DataFrame, asked: Asked, key: str, query: str, k: int, text: str) -> DataFrame:
    """``bm25`` for a small table of queries. What texts have of the asked tokens is written, then weighed."""
    context = notes.sparkSession.sparkContext
    shared = context.broadcast(asked)

    def had(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array(shared.value.tokens, pa.string())
        many = max(1, len(tokens))
        for batch in batches:
            owner, codes, sizes = _coded(batch.column("t"), tokens)
            pairs, tf = np.unique(owner * many + codes, return_counts=True)
            ends = pa.array(np.searchsorted(pairs // many, np.arange(len(sizes) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (pairs % many, tf)]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(sizes), *lists], names=[key, "dl", "codes", "tf"])

    rows = notes.select(F.col(key).cast("long").alias(key), T.tokens(T.folded(T.text_of(text))).alias("t"))
    postings = materialise(rows.mapInArrow(had, f"{key} long, dl long, codes array<int>, tf array<int>"), "postings")
    stats = postings.agg(F.count("*").alias("docs"), F.avg("dl").alias("avgdl")).first()
    df = np.zeros(len(asked.tokens))
    for r in postings.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("df")).collect():  # the asked tokens
        df[r["code"]] = r["df"]
    idf = np.maximum(np.log((stats["docs"] - df + 0.5) / (df + 0.5)), LEAST_IDF)
    weighed = context.broadcast((asked.ids, asked.weights * idf[:, None], stats["avgdl"] or 1.0))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, weights, avgdl = weighed.value
        found = Best(len(ids), k)
        for batch in batches:
            sizes = batch.column("codes").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            codes, tf = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("codes", "tf"))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * batch.column("dl").to_numpy(zero_copy_only=False)[owner] / avgdl))
            _summed(found, batch.column(key).to_numpy(zero_copy_only=False), owner, lambda s, codes=codes, gain=gain: weights[codes[s]] * gain[s, None], lambda x: np.round(x, 4))
        yield found.batch(ids, [query, key, "score"], pa.float64())

    scores = postings.mapInArrow(made, f"{query} long, {key} long, score double").select(query, key, (-F.col("score") + 0.0).alias("bm25"))
    return best(scores, query, [F.col("bm25"), F.col(key)], k).select(query, key, "bm25", "rank")


def substring_recall(notes: DataFrame, queries: DataFrame, key: str, query: str, k: int, text: str = "text") -> DataFrame:
    """query, key, score, rank: the share of the query's first tokens that the text contains anywhere."""
    asked = first_tokens(queries, query, text)
    if (matrix := Asked.of(asked, query, notes, key)) is not None:
        return _part_scores(notes.select(F.col(key).cast("long").alias(key), F.array_distinct(T.tokens(T.text_of(text))).alias("t")), matrix, key, query, k)
    asked = small(asked)
    sizes = small(asked.groupBy(query).agg(F.sum("times").alias("size")))
    hits = containing(notes, asked.select(F.col("token").alias("string")), key, F.lower(T.text_of(text))).withColumnRenamed("string", "token")
    scores = hits.join(asked, "token").groupBy(query, key).agg(F.sum("times").alias("n")).join(sizes, query)
    return best(scores.select(query, key, F.round(F.col("n") / F.col("size"), 4).alias("score")), query, [F.desc("score"), F.col(key)], k)


def bm25(notes: DataFrame, queries: DataFrame, key: str, query: str, k: int, text: str = "text") -> DataFrame:
    """query, key, bm25 (lower is better), rank, over the query's first tokens; diacritics do not count."""
    asked = first_tokens(queries, query, text).groupBy(query, T.folded(F.col("token")).alias("token")).agg(F.sum("times").alias("times"))
    if (matrix := Asked.of(asked, query, notes, key)) is not None:
        return _gains(notes, matrix, key, query, k, text)
    asked = small(asked)
    wanted = small(asked.select(F.col("token").alias("wanted")).distinct())
    toks = notes.select(key, T.tokens(T.folded(T.text_of(text))).alias("t")).select(key, F.size("t").alias("dl"), F.explode(F.concat("t", F.array(F.lit(None)))).alias("token"))
    # Texts are taken apart once: what no query asks for counts with the null that each text ends in.
    postings = materialise(toks.join(wanted, F.col("token") == F.col("wanted"), "left").groupBy(key, "dl", F.col("wanted").alias("token")).agg(F.count("*").alias("tf")), "postings")
    stats = postings.where("token is null").agg(F.count("*").alias("docs"), F.avg("dl").alias("avgdl"))
    postings = postings.where("token is not null")
    df = postings.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    terms = small(asked.join(df, "token").crossJoin(F.broadcast(stats)).select(query, "token", (idf * F.col("times")).alias("idf"), "avgdl"))  # stats is one row
    gain = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scores = postings.join(terms, "token").groupBy(query, key).agg((-F.sum(gain)).alias("raw"))
    return best(scores.withColumn("bm25", F.round("raw", 4) + 0.0), query, [F.col("bm25"), F.col(key)], k).select(query, key, "bm25", "rank")


def with_snippets(found: DataFrame, notes: DataFrame, queries: DataFrame, key: str, query: str, text: str = "text") -> DataFrame:
    """``found(query, key, ...)`` with the words of each text around the first one that its query asks for."""
    asked = first_tokens(queries, query, text).groupBy(query).agg(F.collect_set(T.folded(F.col("token"))).alias("_wanted"))
    rows = small(found).join(asked, query)  # k rows a query
    return notes.select(key, T.text_of(text).alias("_text")).join(rows, key).select(*found.columns, T.snippet(F.col("_text"), F.col("_wanted")).alias("snippet"))


def full_text(notes: DataFrame, queries: DataFrame, key: str, query: str, k: int, text: str = "text") -> DataFrame:
    """query, key, score, rank of the full-text search; queries of which it finds nothing get those of the substring search."""
    top = bm25(notes, queries, key, query, k, text)
    hits = materialise(top.select(query, key, compatible_score(F.col("bm25")).alias("score"), F.col("bm25").alias("tie")), "full-text")
    without = materialise(queries.join(hits.select(query).distinct(), query, "left_anti"), "without-hits")
    if without.limit(1).count():
        hits = hits.unionByName(substring_recall(notes, without, key, query, k, text).select(query, key, "score", F.lit(0.0).alias("tie")))
    return best(hits, query, [F.desc("score"), F.col("tie"), F.col(key)], k).drop("tie")


def compatible_score(c: Column) -> Column:
    """1 / (1 + bm25), which for sums under -1 falls to the least score: what callers of the full-text search get."""
    return F.round(F.when(c <= -1, F.lit(0.01)).otherwise(F.greatest(1 / (1 + c), F.lit(0.01))), 4)


#: Queries whose vectors are broadcast at once, and rows of vectors that are held against them in one product.
QUERY_BLOCK, VECTOR_BLOCK = 2_048, 8_192


def block_scores(ids: np.ndarray, asked: np.ndarray, keys: list[np.ndarray], x: np.ndarray, k: int, digits: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score): of each query's scores over ``least`` the best row of each note (``keys[0]``), and of these the best ``k``.

    A note that is among the best ``k`` of all is so among those of the block that has its best row, too.
    """
    at, who, what = [], [], []
    for q in range(len(ids)):
        score = np.round(x @ asked[q], digits) + 0.0
        some = np.flatnonzero(score > least)
        order = some[np.lexsort((*[n[some] for n in keys[::-1]], -score[some]))]
        first = np.sort(np.unique(keys[0][order], return_index=True)[1])[:k]
        at.append(order[first])
        who.append(np.full(len(first), q))
        what.append(score[order[first]])
    return (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (who, at, what))


def vector_scores(vectors: DataFrame, asked: DataFrame, keys: list[str], query: str, k: int, digits: int = 4, least: float = 0.0) -> DataFrame:
    """query, keys, score: of every query the best row of each note, ``k`` notes at least for each task; ``keys[0]`` is the note.

    Up to ``QUERY_BLOCK`` queries are broadcast and the vectors stay where they are. More are dealt into blocks, and each
    block of queries meets each block of vectors in a task. Vectors of different lengths are not compared; null ones neither
    ask nor answer, nor do those with an entry that is null or no number.
    """
    whole = lambda df: df.where(F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)))
    rows = materialise(whole(asked.select(F.col(query).cast("long").alias(query), F.col("vector").cast("array<double>").alias("vector"))), "asked")
    vectors = whole(vectors.select(*[F.col(c).cast("long").alias(c) for c in keys], F.col("vector").cast("array<double>").alias("vector")))
    out = ", ".join([f"{query} long", *(f"{c} long" for c in keys), "score double"])
    n = rows.count()
    if n <= QUERY_BLOCK:
        part = rows.collect()
        sizes = {len(r["vector"]) for r in part}
        shared = vectors.sparkSession.sparkContext.broadcast({n: (np.array([r[query] for r in part if len(r["vector"]) == n], np.int64), np.array([r["vector"] for r in part if len(r["vector"]) == n], float)) for n in sizes})

        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                lengths = pc.list_value_length(whole.column("vector")).to_numpy(zero_copy_only=False)
                for size, (ids, m) in shared.value.items():
                    mine = whole.filter(pa.array(lengths == size))
                    for lo in range(0, mine.num_rows, VECTOR_BLOCK):
                        batch = mine.slice(lo, VECTOR_BLOCK)
                        names = [batch.column(c).to_numpy(zero_copy_only=False) for c in keys]
                        x = np.asarray(batch.column("vector").flatten()).astype(float).reshape(batch.num_rows, size)
                        who, at, score = block_scores(ids, m, names, x, k, digits, least)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[who]), *(pa.array(c[at]) for c in names), pa.array(score)], names=[query, *keys, "score"])

        return vectors.mapInArrow(made, out)
    parts = -(-n // QUERY_BLOCK)
    vectors = materialise(vectors, "vectors")
    blocks = max(1, -(-vectors.count() // VECTOR_BLOCK))
    left = vectors.withColumn("block", F.pmod(F.xxhash64(*keys), F.lit(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    right = rows.withColumn("part", F.pmod(F.xxhash64(query), F.lit(parts))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def compared(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        found = []
        for size in set(map(len, x["vector"])) & set(map(len, y["vector"])):
            rows_, own = x[x["vector"].map(len) == size], y[y["vector"].map(len) == size]
            ids, names = own[query].to_numpy(), [rows_[c].to_numpy() for c in keys]
            matrix = lambda v: np.stack(v.to_list()).astype(float)
            who, at, score = block_scores(ids, matrix(own["vector"]), names, matrix(rows_["vector"]), k, digits, least)
            found.append(pd.DataFrame({query: ids[who], **{c: v[at] for c, v in zip(keys, names, strict=True)}, "score": score}))
        none = pd.DataFrame({c: np.zeros(0, float if c == "score" else np.int64) for c in (query, *keys, "score")})
        return pd.concat(found) if found else none

    return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInPandas(compared, out)


def text_scores(rows: DataFrame, asked: DataFrame, keys: list[str], text: Column, query: str, k: int, digits: int = 4) -> DataFrame:
    """``vector_scores`` over 0 of the hashed vectors of texts, for up to ``QUERY_BLOCK`` queries: vectors are made, held against the queries and
    left where the texts are read, and a task gives the best ``k`` notes of all that it has read, each with its best row."""
    part = asked.limit(QUERY_BLOCK + 1).collect()
    if len(part) > QUERY_BLOCK:
        from notelake.operators.embedding import hashed_vectors

        return vector_scores(hashed_vectors(rows, keys, text), asked, keys, query, k, digits)
    shared = rows.sparkSession.sparkContext.broadcast((np.array([r[query] for r in part], np.int64), np.array([r["vector"] for r in part], float).reshape(len(part), T.VECTOR_BINS)))
    names = [query, *keys, "score"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, m = shared.value
        least, held = np.full(len(ids), -np.inf), [np.zeros(0, np.int64) for _ in range(len(keys) + 1)]
        scores = np.zeros(0)
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                score = np.round(hashed_matrix(batch.column("_text").to_pylist()) @ m.T, digits) + 0.0
                row, who = np.nonzero((score > 0) & (score >= least))
                if not len(row):
                    continue
                held = [np.concatenate([h, x]) for h, x in zip(held, (who, *(batch.column(c).to_numpy(zero_copy_only=False)[row] for c in keys)), strict=True)]
                scores = np.concatenate([scores, score[row, who]])
                order = np.lexsort((*held[:1:-1], -scores, held[1], held[0]))  # of each query and note the best row
                q, note = held[0][order], held[1][order]
                order = order[np.concatenate([[True], (q[1:] != q[:-1]) | (note[1:] != note[:-1])])]
                order = order[np.lexsort((held[1][order], -scores[order], held[0][order]))]
                order = order[np.arange(len(order)) - np.searchsorted(held[0][order], held[0][order]) < k]
                held, scores = [h[order] for h in held], scores[order]
                n = np.bincount(held[0], minlength=len(ids))
                full = np.flatnonzero(n >= k)
                least[full] = scores[np.cumsum(n)[full] - 1]
        yield pa.RecordBatch.from_arrays([pa.array(ids[held[0]]), *map(pa.array, held[1:]), pa.array(scores)], names=names)

    said = rows.select(*[F.col(c).cast("long").alias(c) for c in keys], T.text_of(text).alias("_text"))
    return said.where(F.col(keys[0]).isNotNull()).mapInArrow(made, ", ".join([f"{query} long", *(f"{c} long" for c in keys), "score double"]))


def best_rows(found: DataFrame, keys: list[str], query: str) -> DataFrame:
    """Of what ``vector_scores`` found the best row of each note, ties by the further keys."""
    nth = F.row_number().over(Window.partitionBy(query, keys[0]).orderBy(F.desc("score"), *keys[1:]))
    return found.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def fused(signals: list[tuple[str, DataFrame, bool]], query: str, key: str, k: int) -> DataFrame:
    """query, key, score, signals, rank from (name, top rows with score, to be normalised): scores add up.

    Signals are normalised by their own best among the rows that they contribute; ties go to the signal named first.
    """
    rows = None
    for nth, (name, top, normalise) in enumerate(signals):
        most = F.max("score").over(Window.partitionBy(query))
        share = F.when(most > 0, F.col("score") / most).otherwise(0.0) if normalise else F.col("score")
        part = top.select(query, key, share.alias("share"), F.struct(F.lit(nth).alias("nth"), F.lit(name).alias("name")).alias("signal"), F.col("rank").alias("place"))
        rows = part if rows is None else rows.unionByName(part)
    sums = rows.groupBy(query, key).agg(F.round(F.sum("share"), 4).alias("score"), F.array_sort(F.collect_set("signal")).alias("s"), F.min(F.struct(F.col("signal.nth"), "place")).alias("first"))
    out = best(sums, query, [F.desc("score"), F.col("first"), F.col(key)], k)
    return out.select(query, key, "score", F.array_join(F.transform("s", lambda x: x["name"]), "+").alias("signals"), "rank")
