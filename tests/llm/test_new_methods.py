"""Ranked lexical search, context-tree weighting and whitening against plain versions, and over odd tables."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from notelake.llm import block_max, context_tree, whitening
from notelake.llm.common import numbers, table, varints

TEXTS = [
    (1, "the cat sat on the mat and the cat ran"),
    (2, "The CAT sat on the mat and the cat ran"),
    (3, None),
    (None, "no id but a cat, a mat; naïve Ünïcode_words 42"),
    (4, ""),
    (5, " \t\n - ; "),
    (6, "the quick brown fox " * 3_000),
    (7, "\x00odd\x1cé́\U0001f600 tokens"),
    (1, "the cat sat on the mat and the cat ran"),
    (20, "a held out text of the cat"),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    return df.withColumns({c: F.lit(f"clash-{c}") for c in ("id", "row", "train", "block", "score", "term", "shard", "rank", "share", "n", "word", "known", "_q", "item")})


def test_varints():
    v = np.array([0, 1, 127, 128, 16_383, 16_384, 2**40, 2**62, 5])
    data, at = varints(v)
    assert numbers(data).tolist() == v.tolist() and at[-1] == len(data)
    assert numbers(varints(v[:0])[0]).tolist() == []


# Ranked lexical search


def plain_search(texts, queries, k):
    import re

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    rows = [(d, split(t)) for d, t in texts]
    n = sum(bool(w) for _, w in rows)
    length = sum(len(w) for _, w in rows)
    df = Counter(t for _, w in rows for t in set(w))
    asked = defaultdict(set)
    for q, t in queries:
        asked[q] |= set(split(t))
    out = []
    for q, words in asked.items():
        found = []
        for d, w in rows:
            m, tf = 100 - 50 + (50 * len(w) * n) // max(length, 1), Counter(w)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in words if tf[t])
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(q, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(found)[:k])]
    return out


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.mark.parametrize(("shard_rows", "window", "k"), [(16_384, 2_048, 3), (2, 1, 2), (3, 2, 50)])
def test_search_against_all_scores(spark, docs, monkeypatch, shard_rows, window, k):
    monkeypatch.setattr(block_max, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(block_max, "WINDOW", window)
    queries = [(1, "The cat, the MAT!"), (2, "fox naïve 42 42"), (2, "odd"), (None, "tokens é́"), (3, ""), (4, None), (5, "absent"), (6, "ünïcode ran")]
    asked = spark.createDataFrame(queries, "item_id long, text string").withColumn("term", F.lit("clash"))
    got = block_max.search(block_max.build_index(docs.coalesce(1)), asked, "item_id", "text", k)
    assert rows_of(got, "item_id", "rank", "doc_id", "score") == sorted(plain_search(TEXTS, queries, k), key=str)


def test_search_of_long_lists_skips_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    words = np.array([f"w{i}" for i in range(60)])
    shares = 1 / np.arange(1, 61)
    texts = [(i, " ".join(rng.choice(words, rng.integers(1, 40), p=shares / shares.sum()))) for i in range(3_000)]
    queries = [(i, " ".join(rng.choice(words, 6, replace=False))) for i in range(20)]
    monkeypatch.setattr(block_max, "WINDOW", 256)
    index = block_max.build_index(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1))
    got = block_max.search(index, spark.createDataFrame(queries, "item_id long, text string"), "item_id", "text", 10)
    assert rows_of(got, "item_id", "rank", "doc_id", "score") == sorted(plain_search(texts, queries, 10), key=str)
    # One shard by hand: fewer postings are read than there are.
    rows = index.rows.collect()
    own = next(r for r in rows if r["term"] is None)
    m = np.frombuffer(own["postings"], "<i8")
    by_df = sorted((r for r in rows if r["term"] is not None), key=lambda r: r["df"])
    one = lambda w, r: (w, block_max.PostingList(r["top"], r["heads"], r["postings"], m))
    frequent = [one(1, r) for r in by_df[-5:]]
    found, scores = block_max.best_documents([*[one(1_000, r) for r in by_df[:3]], *frequent], len(m), 3)
    assert len(found) == 3 and (np.diff(scores) <= 0).all()
    read = sum(len(np.unique(np.concatenate([d for d, _ in x.known.values()]))) for _, x in frequent if x.known)
    assert 0 < read < 0.5 * sum(r["df"] for r in by_df[-5:])


def test_search_of_empty_tables(spark, docs):
    none = docs.limit(0)
    asked = spark.createDataFrame([(1, "cat")], "item_id long, text string")
    assert block_max.search(block_max.build_index(none), asked, "item_id", "text", 5).count() == 0
    assert block_max.search(block_max.build_index(docs), asked.limit(0), "item_id", "text", 5).count() == 0


# Context-tree weighting


class PlainTree:
    """The weights by their definition: dictionaries of counts, recursion over contexts."""

    def __init__(self, texts, depth):
        self.depth, self.counts, self.longer = depth, defaultdict(lambda: [0, 0]), defaultdict(set)
        for text in texts:
            for context, byte in self.steps(text):
                for bit in range(8):
                    for d in range(depth + 1):
                        node = (context[:d], byte >> (8 - bit), bit)
                        self.counts[node][(byte >> (7 - bit)) & 1] += 1
                        if d < depth:
                            self.longer[node].add(context[: d + 1])
        self.known = {}

    def steps(self, text):
        whole = b"\xff" * self.depth + text + b"\xff"
        for i in range(self.depth, len(whole)):
            yield whole[i - self.depth : i][::-1], whole[i]

    def own(self, node):
        a, b = self.counts[node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weights(self, node):
        if node not in self.known:
            if len(node[0]) == self.depth:
                self.known[node] = (self.own(node), None)
            else:
                below = sum(self.weights((c, *node[1:]))[0] for c in self.longer[node])
                self.known[node] = (float(np.logaddexp(self.own(node), below)) - math.log(2), below)
        return self.known[node]

    def one(self, context, prefix, bit, d=0):
        """The probability of a one by the contexts of ``d`` bytes and more; None where training had none of them."""
        node = (context[:d], prefix, bit)
        if node not in self.counts:
            return None
        a, b = self.counts[node]
        kt = (b + 0.5) / (a + b + 1)
        if d == self.depth:
            return kt
        longer = self.one(context, prefix, bit, d + 1)
        stop = 1 / (1 + math.exp(self.weights(node)[1] - self.own(node)))
        return kt if longer is None else stop * kt + (1 - stop) * longer

    def score(self, text):
        total = 0.0
        for context, byte in self.steps(text):
            for bit in range(8):
                p = self.one(context, byte >> (8 - bit), bit)
                p = 0.5 if p is None else p
                total += math.log10(p if (byte >> (7 - bit)) & 1 else 1 - p)
        return total


def plain_base(texts, trained):
    words = [[*(t or "").encode().lower().split(), b""] for _, t in texts]
    c = Counter(w for ws, t in zip(words, trained, strict=True) if t for w in ws)
    n, v = sum(c.values()), len(c)
    return [(len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for ws in words]


@pytest.mark.parametrize("block_bytes", [64, 1 << 20])
def test_context_tree_against_its_definition(spark, docs, block_bytes):
    texts = [(d, t if d != 6 else "the quick brown fox " * 12) for d, t in TEXTS]
    rows = docs.withColumn("text", F.when(F.col("doc_id") == 6, F.lit("the quick brown fox " * 12)).otherwise(F.col("text")))
    got = context_tree.scored(rows, f"NOT {context_tree.HELD_OUT}", block_bytes=block_bytes)
    trained = [d is None or zlib.crc32(str(d).encode()) % 10 != 0 for d, _ in texts]
    tree = PlainTree([(t or "").encode().lower() for (_, t), x in zip(texts, trained, strict=True) if x], context_tree.DEPTH)
    want = [(d, x, *b, tree.score((t or "").encode().lower())) for (d, t), x, b in zip(texts, trained, plain_base(texts, trained), strict=True)]
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    found = sorted((tuple(r) for r in got.collect()), key=key)
    for a, b in zip(found, sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-5)


def test_probabilities_of_a_context_sum_to_one():
    rng = np.random.default_rng(3)
    text = bytes(rng.choice(np.frombuffer(b"abcd \xc3\xa9", np.uint8), 4_000).astype(np.uint8))
    block = {"before": [b"\xff" * 3], "size": [len(text)], "last": [True], "train": [True], "text": zlib.compress(text)}
    keys, n = context_tree.distinct_runs(block, 3)
    sums = context_tree.share_sums(keys, n, 3)
    roots = context_tree.Roots(*[sums[c] for c in ("node", "zeros", "ones", "children")])
    for context in (int(keys[5]) >> 8, int(keys[400]) >> 8, 0x616161, 0x7A7A7A):
        asked = np.union1d(keys, (context << 8) | np.arange(256))
        counts = np.zeros(len(asked), np.int64)
        counts[np.searchsorted(asked, keys)] = n
        p = np.exp(context_tree.run_scores(asked, counts, 3, roots))
        assert p[(asked >> 8) == context].sum() == pytest.approx(1, abs=1e-9)


def test_block_probabilities():
    a, b = np.array([0, 3, 4_095, 5_000, 10**7]), np.array([0, 9, 4_096, 0, 3])
    want = [math.lgamma(x + 0.5) + math.lgamma(y + 0.5) - math.lgamma(x + y + 1) - math.log(math.pi) for x, y in zip(a, b, strict=True)]
    assert context_tree.block_probability(a, b) == pytest.approx(want, rel=1e-9, abs=1e-6)


def test_context_tree_of_the_tables(spark, sf):
    got = context_tree.op12_context_tree(spark, sf).toPandas()
    texts = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    trained = [zlib.crc32(str(d).encode()) % 10 != 0 for d, _ in texts]
    want = {d: b for (d, _), b in zip(texts, plain_base(texts, trained), strict=True)}
    assert len(got) == len(texts)
    for r in got.itertuples():
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3] and r.base_score == pytest.approx(want[r.doc_id][3], rel=1e-9)
    assert got.held_out.sum() == len(texts) - sum(trained) and (got.score < 0).all()


def test_context_tree_on_held_out_texts(spark):
    """From a megabyte of training text on the model is ahead of word frequencies on texts that it has not seen."""
    got = context_tree.op12_context_tree(spark, "/root/testdata/sf0.01").toPandas()
    held = got[got.held_out]
    assert held.score.sum() > 0.98 * held.base_score.sum()


def test_context_tree_without_training_or_rows(spark, docs):
    got = context_tree.scored(docs, "false").where("doc_id = 1").first()
    n = len("the cat sat on the mat and the cat ran") + 1
    assert got["score"] == pytest.approx(-8 * n * math.log10(2), rel=1e-6) and got["base_score"] == pytest.approx(0) and got["n_known"] == 0
    assert context_tree.scored(docs.limit(0), "true").count() == 0


def test_pieces_cut_at_white_space():
    text = b"one two  three" + b"x" * 40 + b" four"
    cuts = list(context_tree.pieces(text, 10))
    assert b"".join(text[a:b] for a, b in cuts) == text
    assert [w for a, b in cuts for w in text[a:b].split()] == text.split()


# Whitening


def test_whitening_against_numpy(spark, sf):
    got = whitening.op13_whitening(spark, sf).toPandas()
    rows = [r for r in table(spark, sf, "embeddings").select("vec_id", "embedding").collect()]
    x = np.array([[math.floor(1024 * c) + 100_000 for c in r["embedding"]] for r in rows])
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    v = centred.T @ centred / n
    e, w = np.linalg.eigh(v)
    order = np.argsort(-e)[:8]
    want = centred @ w[:, order] / np.sqrt(e[order])
    assert len(got) == 8 * n and (got.n == n).all() and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[[r["vec_id"] for r in rows]].to_numpy()
    signs = np.sign((wide * want).sum(axis=0))
    assert np.abs(wide * signs - want).max() < 1e-7
    assert got.drop_duplicates("component").sort_values("component").explained.to_numpy() == pytest.approx(e[order] / np.trace(v))
    deviation = dict(zip((r["vec_id"] for r in rows), ((n * x - s) ** 2).sum(axis=1).tolist(), strict=True))
    assert {r.vec_id: r.deviation for r in got.itertuples()} == deviation


def test_whitening_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 64)  # several blocks
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [2.0, 1.0]), (3, [0.5, 0.5]), (3, [0.5, 0.5]), (None, [4.0, -1.0]), (5, None), (6, []), (7, [nan, 1.0]), (8, [None, 1.0]), (9, [inf, 1.0]), (10, [1.0]), (11, [1.0, 1e300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("x", "d", "index", "v", "off", "component", "part", "n")})
    got = whitening.whitened(df)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    found = got.collect()
    assert len(found) == 10 and {r["n"] for r in found} == {5} and max(r["identity_error"] for r in found) < 1e-9
    assert sorted({r["vec_id"] for r in found}, key=str) == [1, 2, 3, None]
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "vec_id long, embedding array<double>")
    assert whitening.whitened(same).count() == whitening.whitened(df.limit(0)).count() == 0


def test_rows_of_megabytes_are_written_in_small_groups(spark, monkeypatch):
    import pyarrow.parquet as pq

    from notelake.llm import common, context_tree

    made = []

    def kept(df, what, *options):
        made.append((what, common.materialise(df, what, *options)))
        return made[-1][1]

    monkeypatch.setattr(context_tree, "materialise", kept)
    docs = spark.range(64).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: F.sha2(F.concat_ws("-", "id", i), 256))).alias("text")).coalesce(1)
    assert context_tree.scored(docs, "doc_id % 2 = 0", depth=2, block_bytes=1 << 20).count() == 64
    files = [f.removeprefix("file://") for what, df in made if what == "blocks" for f in df.inputFiles()]
    groups = [g for f in files for m in [pq.ParquetFile(f).metadata] for g in map(m.row_group, range(m.num_row_groups))]
    assert sum(g.num_rows for g in groups) >= 64 and max(g.total_byte_size for g in groups) < 24 << 20
