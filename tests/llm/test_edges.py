"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns, for each operator."""

import pytest
from pyspark.sql import functions as F

from notelake.llm import hamming_topk, mixing, near_dedup, packing, pii, sharding, spotsigs, token_counts, toxicity, warc
from notelake.llm.common import materialise, shared_folder
from notelake.llm.registry import queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the word idiot follows of a tree " * 20_000
ROWS = [
    (1, "The cat sat on the mat and looked at the dog.", "en", "src1", 45),
    (1, "The cat sat on the mat and looked at the dog.", "en", "src1", 45),
    (2, "The cat sat on the mat and looked at the dog.", "en", "src1", 45),
    (3, None, None, None, None),
    (None, "a text without an id", "de", "src2", 20),
    (4, "", "en", "", 0),
    (5, "", None, "src3", 0),
    (6, LONG, "fr", "src4", len(LONG)),
    (7, "\x00 odd \x1c \U0001f600 é́ <|endoftext|>", "es", "src5", 3),
    (8, "x", "en", "src1", 1),
]
CLASH = [c for c in ("item", "_item", "row", "id", "key", "range", "guest", "bucket", "n", "terms", "_copies", "budget", "token", "size", "at", "gid", "block", "score", "tags", "rank")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({c: F.lit(f"clash-{c}") for c in CLASH})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def ids(rows):
    return sorted((r["doc_id"] for r in rows), key=lambda x: (x is None, x))


EVERY = sorted((r[0] for r in ROWS), key=lambda x: (x is None, x))


def test_token_counts(docs, none):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    got = token_counts.count_tokens(docs, path).collect()
    assert ids(got) == EVERY
    t = token_counts.tokenizer(path)
    want = sorted((r[0] or -1, len((r[1] or "").encode()), len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in ROWS)
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert token_counts.count_tokens(none, path).count() == 0


def test_token_counts_with_a_tiny_cache(docs):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    a = token_counts.count_tokens(docs, path).collect()
    b = token_counts.count_tokens(docs, path, table_size=1, cache_size=1).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_packing(docs, none):
    got = packing.pack_documents(docs).collect()
    assert ids({(r["doc_id"], i): r for i, r in enumerate(got) if r["start"] == 0}.values()) == EVERY
    assert sum(r["length"] for r in got) == sum(r["doc_tokens"] for r in got if r["start"] == 0)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))]
        assert sum(n for _, n in pieces) <= 2048
    assert packing.pack_documents(none).count() == 0


def test_sharding(docs, none):
    got = sharding.shard_documents(docs, 3).collect()
    assert ids(got) == EVERY
    for s in range(3):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard_documents(none, 3).count() == 0


def test_mixing(docs, none):
    got = mixing.mix(docs)
    assert got.columns == docs.columns
    assert got.count() >= 1
    assert mixing.mix(none).count() == 0
    leaves = mixing.mixture(docs).collect()
    assert {(r["_lang"], r["_source"]) for r in leaves} >= {("(none)", "(none)"), ("en", "")}
    assert all(r["budget"] <= 2 * r["total"] for r in leaves)


def test_near_dedup(docs, none):
    got = near_dedup.near_duplicate_classes(docs).collect()
    assert ids(got) == EVERY
    classes = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in got}
    assert classes[1] == classes[2] == (1, 3)
    assert classes[4] == classes[5] == (4, 2)
    assert classes[3] == (3, 1)
    kept = near_dedup.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert ids(kept.collect()) == sorted([1, 3, None, 4, 6, 7, 8], key=lambda x: (x is None, x))
    assert near_dedup.near_duplicate_classes(none).count() == 0
    assert near_dedup.without_near_duplicates(none).count() == 0


def test_pii(docs, none):
    got = pii.personal_data(docs).collect()
    assert ids(got) == EVERY
    assert all(r["spans"] == "" for r in got)
    clean = pii.sanitised(docs)
    assert clean.columns == docs.columns
    assert sorted(str(r["text"]) for r in clean.collect()) == sorted(str(r[1]) for r in ROWS)
    assert pii.personal_data(none).count() == 0
    assert pii.sanitised(none).count() == 0


def test_spotsigs(docs, none):
    got = spotsigs.edited_fingerprints(docs).collect()
    assert ids(got) == EVERY
    prints = {}
    for r in got:
        prints.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert prints[1] == prints[2] and prints[3] == prints[4] == prints[5]
    assert all(r["fingerprint"] and 0 <= r["near_next"] <= 1 for r in got)
    assert spotsigs.edited_fingerprints(none).count() == 0
    assert spotsigs.near_pairs(spotsigs.fingerprint_documents(none)).count() == 0
    spotsigs.near_pairs(spotsigs.fingerprint_documents(docs)).collect()


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 1), (None, 0, 1), (2, 1, None), (2, 1, 0)], "doc_id long, quality int, toxic int")
    for seen in (labels, labels.where("false")):
        model = toxicity.fit(docs, seen)
        got = toxicity.scored(docs, model).collect()
        assert ids(got) == EVERY
        assert all(0 <= r["score"] <= 1 for r in got)
        assert toxicity.without_toxic(docs, model, 2.0).columns == docs.columns
        assert toxicity.without_toxic(docs, model, 2.0).count() == len(ROWS)
        assert toxicity.scored(none, model).count() == 0
    assert toxicity.fit(none, labels).scores(["", "anything"]).tolist() == [0, 0]


def test_warc(spark):
    same = "<p>" + "y" * 2000
    rows = [(1, "http://a/\r\nX: y", same), (2, None, same), (2, "u", same), (3, "u", None), (4, "u", ""), (None, "u", same), (5, "u", "short"), (6, "u", "short"), (7, "u", "<b>\r\n\r\nWARC/1.1\r\n" * 60_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("digest", "head", "payload", "path", "record_type")})
    folder = shared_folder(spark, "warc-test")
    manifest = warc.write_archives(warc.with_record_types(pages), folder, segment_bytes=4000)
    chunks = warc.read_archives(manifest, folder, chunk_bytes=1000).collect()
    whole = {}
    for r in sorted(chunks, key=lambda r: r["chunk_no"]):
        whole.setdefault(r["record_id"], []).append(r)
    import hashlib

    # A record identifier and a chunk number are a key: all records come together again from their chunks.
    assert len(whole) == len(rows)
    written = []
    for parts in whole.values():
        last = parts[-1]
        assert [p["chunk_no"] for p in parts] == list(range(len(parts))) and [p["last"] for p in parts] == [False] * (len(parts) - 1) + [True]
        if last["record_type"] == "response":
            data = b"".join(bytes(p["data"]) for p in parts)
            upto = b""
            for p in parts:
                upto += bytes(p["data"])
                assert hashlib.sha1(upto).hexdigest() == p["payload_digest"] and len(upto) == p["payload_bytes"]
            written.append((last["page_id"], last["url"], data.decode()))
    assert sorted(written, key=str) == sorted([(i, u, t or "") for i, u, t in rows if t != same or i == 2], key=str)
    last = [(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in chunks if r["last"]]
    assert sorted(last, key=str) == sorted([(1, "revisit", 2, 2003), (2, "response", None, 2003), (2, "response", None, 2003), (3, "response", None, 0), (4, "response", None, 0), (None, "revisit", 2, 2003), (5, "response", None, 5), (6, "response", None, 5), (7, "response", None, 17 * 60_000)], key=str)
    assert {r["url"] for r in chunks if r["page_id"] == 1} == {"http://a/\r\nX: y"}
    empty = warc.write_archives(warc.with_record_types(pages.where("false")), shared_folder(spark, "warc-test"))
    assert warc.read_archives(empty, folder).count() == 0


def test_hamming_topk(spark):
    rows = [(1, [1.0, -1.0, 1.0]), (1, [1.0, -1.0, 1.0]), (2, [1.0, -1.0, 1.0]), (3, None), (None, [1.0, 1.0, 1.0]), (4, [-1.0, 1.0, -1.0]), (5, []), (6, [float("nan"), 0.0, 2.0]), (7, [1.0] * 70)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    coded = hamming_topk.binary_codes(vectors, "vec_id", "embedding")
    got = sorted((r["id"], r["rank"], r["neighbour"], r["distance"]) for r in hamming_topk.nearest(coded, coded.where("id in (2, 4, 5, 7)"), 2).collect())
    assert got == [(2, 1, 1, 0), (2, 2, 6, 1), (4, 1, 6, 2), (4, 2, 1, 3)]
    assert hamming_topk.nearest(coded.where("false"), coded.where("false"), 2).count() == 0


@pytest.fixture(scope="module")
def edge_tables(spark, docs, none, tmp_path_factory):
    """Folders of the tables that the queries read: one of odd rows and one of none."""
    pages = spark.createDataFrame([(1, "u", "<p>" + "y" * 2000), (2, None, "<p>" + "y" * 2000), (3, "v", None), (None, "v", ""), (3, "v", None)], "page_id long, url string, html string")
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 1), (None, 0, 1), (2, 1, None), (2, 1, 0), (9, 1, 1)], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([(20, [1.0, -1.0]), (20, [1.0, -1.0]), (1, [1.0, 1.0]), (2, None), (None, [0.0, 0.0])], "vec_id long, embedding array<float>")
    items = spark.createDataFrame([(1, "The CAT!"), (None, "idiot"), (2, None), (3, ""), (5, "id, text"), (5, "id")], "item_id long, text string").withColumn("term", F.lit("clash"))
    folders = []
    for empty in (False, True):
        at = tmp_path_factory.mktemp("tables")
        for name, df in (("documents", docs), ("pages", pages.withColumn("a.b", F.lit("dot"))), ("labels", labels), ("embeddings", vectors.withColumn("code", F.lit("clash"))), ("benchmark", items)):
            (df.where("false") if empty else df).write.parquet(f"{at}/{name}.parquet")
        folders.append(str(at))
    return folders


@pytest.mark.parametrize("name", sorted(queries()))
def test_queries_over_odd_and_empty_tables(spark, edge_tables, name):
    rows = {"op1_warc": 5, "op9_hamming_topk": 2, "op11_block_max": 6, "op13_whitening": 8}.get(name, len(ROWS))
    got = queries()[name](spark, edge_tables[0]).collect()
    assert len({(r["doc_id"], i) for i, r in enumerate(got) if r["start"] == 0}) == rows if name == "op7_packing" else len(got) == rows
    assert queries()[name](spark, edge_tables[1]).count() == 0


def test_pipeline_over_odd_and_empty_tables(spark, edge_tables):
    import corpus_pipeline

    for folder in edge_tables:
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = materialise(stage(spark, docs, folder), name)
            assert docs.columns == columns
    assert docs.count() == 0 and corpus_pipeline.run(spark, edge_tables[1]).count() == 0
    got = corpus_pipeline.run(spark, edge_tables[0]).collect()
    assert all(0 < r["length"] <= 2048 for r in got) and {r["doc_id"] for r in got} <= {r[0] for r in ROWS}


def test_a_dot_in_a_column_name(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumn("a.b", F.lit(1)).withColumn("a", F.lit(2))
    for out in (near_dedup.without_near_duplicates(docs), mixing.mix(docs), pii.sanitised(docs)):
        assert out.columns == docs.columns and out.count() >= 1
