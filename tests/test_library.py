"""The library end to end on a small folder, and embedding with providers that fail."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from notelake.operators import embedding, export, recall
from notelake.plans.library import Config, Library, enriched, within_budget
from notelake.plans.store import shared_folder

ROWS = [
    (1, "Kestrels hover above the motorway verge and look for voles in the grass.", "en", "birds"),
    (2, "Voles live in runs through thick grass and are the prey of kestrels and owls.", "en", "mammals"),
    (3, "The ledger is closed at the end of each month and the accounts are checked twice.", "en", "work"),
    (4, "Too short.", "en", "work"),
]


def test_library(spark):
    lib = Library(spark, shared_folder(spark, "library"))
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    first = lib.ingest(docs)
    out = lib.daily("2024-01-01T00:00:00.000Z")
    assert out["notes"] == 4 and out["issues"] == 0 and "Recent notes" in out["synthesis"]
    queries = spark.createDataFrame([(1, "kestrels and voles"), (2, "monthly ledger accounts")], "query_id long, text string")
    best = {r["query_id"]: r for r in lib.recall(queries).where("rank = 1").collect()}
    assert best[1]["doc_id"] in (1, 2) and best[2]["doc_id"] == 3 and "vector" in best[2]["signals"]
    weak = [r for r in lib.queue(most=100).collect() if r["type"] == "enrich_ambiguous_concept"]
    assert len(weak) == 1
    lib.update(weak[0]["id"], "accepted", "2024-01-02T00:00:00.000Z", "will do")
    assert lib.queue("accepted").count() == 1
    again = Library(spark, lib.root)  # a new object goes on where the folder is
    vectors = again.store.rows("vectors", "doc_id").count()
    second = again.ingest(spark.createDataFrame([(4, "Now a note of its own length, with more than forty characters in one sentence.", "en", "work")], docs.schema))
    assert second != first and again.notes().count() == 4 and again.store.rows("vectors", "doc_id").count() == vectors
    assert again.notes().where("doc_id = 4").first()["body"].startswith("Now a note") and "kestrel" in again.notes().where("doc_id = 1").first()["body"].lower()
    out = again.daily("2024-01-03T00:00:00.000Z", review=lambda text: text[:11])
    assert out["review"] == "# Synthesis" and not out["degraded"] and out["issues"] == 0 and len(out["generation"]) == 64
    kept = again.queue("accepted").collect()
    assert len(kept) == 1 and kept[0]["stale"]
    todo = {r["type"]: r["id"] for r in again.queue(most="100").collect() if not r["stale"]}
    done = again.execute(todo["promote_entity_note"], "2024-01-04T00:00:00.000Z")
    assert done["status"] == "done" and done["path"].startswith("entities/")
    assert "## Mentioned by" in again.artifacts().first()["markdown"] and again.queue("done").count() == 1
    notes_of = {r["path"]: r["markdown"] for r in export.action_notes(again.queue(), again.store.rows("objects", "id")).collect()}
    assert len(notes_of) == again.queue().count() and all(p.startswith("actions/action-") and "## Targets" in m for p, m in notes_of.items())
    assert again.recall(queries, 99).groupBy("query_id").count().where("count > 20").count() == 0


def test_link_budget_of_a_build(spark):
    lib = Library(spark, shared_folder(spark, "library"), config=Config.of({"max_links": "9", "top_k": 500, "unknown": 1}))
    assert lib.config.top_k == 100
    lib.ingest(spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string"))
    out = lib.daily("2024-01-01T00:00:00.000Z")
    assert out["degraded"] and out["links"] == 9 and "link budget" in out["reasons"]


def test_enrichment_of_ambiguous_captures(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["text"] for r in enriched(docs, lambda query: (f"About {query}", ["https://a.example"])).collect()}
    assert got[4] == "Too short.\n\nAbout Too short. Too short\n\nhttps://a.example" and got[3] == ROWS[2][1]


def test_export_and_its_check(spark):
    notes = spark.createDataFrame([("a.md", "A", "d", ["t"], "C:\\x", "2024", "Body [[b|B]]"), ("b c.md", "B", "d", [], "http://e", "2024", " "), ("d.md", "D", 'q"', [], None, "2024", "[[a]]")], "path string, title string, description string, tags array<string>, resource string, timestamp string, body string")
    folder = shared_folder(spark, "export")
    assert export.write_notes(notes, folder).count() == 0
    out = {r["path"]: r["markdown"] for r in spark.read.parquet(f"{folder}/notes").collect()}
    assert set(out) == {"a.md", "d.md"} and "[B](b.md)" in out["a.md"] and 'resource: "./C:/x"' in out["a.md"] or 'resource: "file:///C:/x"' in out["a.md"]
    assert [r["line"] for r in spark.read.parquet(f"{folder}/index").orderBy("nth").collect()] == ["- [a](a.md)", "- [d](d.md)"]
    assert "Exported files: 2" in spark.read.parquet(f"{folder}/log").first()["markdown"]


def test_hashed_vectors_by_hand(spark):
    texts = [r[1] for r in ROWS] + ["知识管理 ab", "", "x" * 200]

    def plain(text):
        out = np.zeros(384)
        tokens = re.findall(r"\w+", text.lower())
        parts = [t[k : k + n] for t in tokens if len(t) > 2 and t >= "一" for n in (2, 3) for k in range(len(t) - n + 1)]
        for token in [*tokens, *parts, *(f"{a}_{b}" for a, b in zip(tokens, tokens[1:], strict=False))]:
            h = 2166136261
            for c in token:
                h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
            out[h % 384] += 1.4 if "_" in token else 1.2 if len(token) >= 6 else 1.0
        return out / (np.linalg.norm(out) or 1)

    assert np.allclose(embedding.hashed_matrix(texts), [plain(t) for t in texts])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["vector"] for r in embedding.hashed_vectors(df, ["doc_id"], F.col("text")).collect()}
    assert set(got) == set(range(len(texts))) - {5} and all(np.allclose(v, plain(texts[i])) for i, v in got.items())


@pytest.mark.parametrize("block", [2_048, 3])
def test_vector_search_against_all_pairs(spark, monkeypatch, block):
    """Broadcast queries and (block=3) blocks by blocks; one note has very many good chunks."""
    monkeypatch.setattr(recall, "QUERY_BLOCK", block)
    monkeypatch.setattr(recall, "VECTOR_BLOCK", 50)
    rng = np.random.default_rng(0)
    rows = [(d if i else 7, c, rng.normal(size=6).tolist()) for i, (d, c) in enumerate((n % 25 if n < 200 else 7, n) for n in range(400))]
    asked = [(q, rng.normal(size=6).tolist()) for q in range(8)]
    found = recall.vector_scores(spark.createDataFrame(rows, "doc_id long, chunk_no long, vector array<double>"), spark.createDataFrame(asked, "q long, vector array<double>"), ["doc_id", "chunk_no"], "q", 3)
    got = recall.best(recall.best_rows(found, ["doc_id", "chunk_no"], "q"), "q", [F.desc("score"), F.col("doc_id")], 3).collect()
    want = set()
    for q, v in asked:
        best = {}
        for d, c, x in rows:
            s = round(float(np.dot(v, x)), 4)
            if s > 0 and (d not in best or (-s, c) < best[d]):
                best[d] = (-s, c)
        want |= {(q, d, c) for _, d, c in sorted((s, d, c) for d, (s, c) in best.items())[:3]}
    assert {(r["q"], r["doc_id"], r["chunk_no"]) for r in got} == want


def test_substring_search_against_all_pairs(spark):
    texts = ["alpha beta gamma", "Das Größte ist weiß", "x-y ... z", "betamax", "", "a b c", "一二三四"]
    strings = ["eta", "pha beta ga", "beta", "rößt", "...", "b", "e", "alpha beta gamma", "二三", "y ", "zz"]
    docs, asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([(s,) for s in strings], "string string")
    got = {(r["doc_id"], r["string"]) for r in recall.containing(docs, asked, "doc_id", F.col("text")).collect()}
    assert got == {(i, s) for i, t in enumerate(texts) for s in strings if s in t}


def test_provider_chain_and_reuse(spark):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(70)], "id long, text string")

    def broken(texts):
        raise OSError("offline")

    def one_hot(texts):
        return [[float(len(t) % 4 == k) for k in range(4)] for t in texts]

    chain = {"broken": broken, "mock": one_hot}
    known = embedding.embedded(rows, "text", chain, 6)
    assert {r["provider"] for r in known.collect()} == {"mock"} and {len(r["vector"]) for r in known.collect()} == {4}  # the provider's own size
    assert {(r["provider"], len(r["vector"])) for r in embedding.embedded(rows, "text", {"broken": broken}, 6).limit(3).collect()} == {("hashed", 6)}
    changed = rows.withColumn("text", F.when(F.col("id") == 3, "other").otherwise(F.col("text")))
    asked = spark.sparkContext.accumulator(0)

    def counted(texts):
        asked.add(len(texts))
        return one_hot(texts)

    again = embedding.refreshed(known, changed, ["id"], "text", {"mock": counted})
    assert again.count() == 70 and {r["provider"] for r in again.collect()} == {"mock"} and asked.value == 1
    assert {r["provider"] for r in embedding.refreshed(known, changed, ["id"], "text", None, 6).collect()} == {"hashed"}  # none is kept of another provider


def test_link_budget(spark):
    links = spark.createDataFrame([(i,) for i in range(10)], "n long")
    kept, degraded = within_budget(links, [F.desc("n")], 4)
    assert sorted(r["n"] for r in kept.collect()) == [6, 7, 8, 9] and degraded
    assert within_budget(links, ["n"], 10)[1] is False
