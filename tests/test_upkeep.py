"""Upkeep of a library: odd ids, deletes, concurrent writers, stale tables, providers, folders of files."""

import os
import subprocess
import sys
import threading

import pytest
from pyspark.sql import functions as F

from notelake.operators import embedding, graph, index, notes, recall
from notelake.plans.library import Library
from notelake.plans.store import Store, shared_folder
from notelake.sources.captures import frontmatter

SCHEMA = "doc_id long, text string, lang string, source string"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_ids_of_all_sizes_are_notes_of_their_own(spark):
    ids = [1, 12345678, -12345678, 123456780, 123456789, 10**12, 7 * 10**18, 2**63 - 1, -1, -(2**63)]
    docs = spark.createDataFrame([(i, f"A text about number {i} and its many friends in the wide plain.", "en", "s") for i in ids], SCHEMA)
    made = notes.from_documents(docs)
    rows = {r["doc_id"]: r for r in made.collect()}
    assert len({r["path"] for r in rows.values()}) == len(ids) and rows[1]["path"] == "concepts/doc-00000001.md"
    analysed = graph.analyse(notes.build_notes(made))
    assert graph.objects(analysed).where("type = 'Concept'").count() == len(ids)
    times = [rows[i]["timestamp"] for i in sorted(ids)]
    assert times == sorted(times) and all(len(t) == 24 for t in times)
    assert graph.capped_links(graph.pair_scores(analysed, graph.candidate_pairs(analysed))).count() > 0


def test_without_a_checkpoint_folder():
    """The setting is absent: queries that write tables run all the same, and a cluster is told what it lacks."""
    code = (
        "import os, sys\n"
        f"sys.path.insert(0, {ROOT!r})\n"
        "from notelake.session import local_session\n"
        "spark = local_session(2, 'bare', 2)\n"
        "assert spark.conf.get('spark.checkpoint.dir', None) is None\n"
        "from notelake.plans.store import shared_folder\n"
        "a, b = shared_folder(spark, 'x'), shared_folder(spark, 'x')\n"
        "assert a.startswith('file:/') and os.path.dirname(a) == os.path.dirname(b) and a != b\n"
        "from notelake import registry\n"
        "assert registry.queries()['lexical_recall'](spark, '/root/testdata/sf0.001').count() > 0\n"
    )
    empty = subprocess.run(["mktemp", "-d", "/tmp/conf-XXXXXX"], capture_output=True, text=True, check=True).stdout.strip()
    subprocess.run([sys.executable, "-c", code], env=os.environ | {"SPARK_CONF_DIR": empty}, check=True, timeout=300)


def test_vectors_of_odd_sizes(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0, 0.0]), (4, [0.6, 0.8]), (5, None), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [])]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>")
    asked = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, None)], "q long, vector array<double>")
    for block in (2_048, 1):
        recall.QUERY_BLOCK, before = block, recall.QUERY_BLOCK
        got = {(r["q"], r["id"], r["score"]) for r in recall.vector_scores(vectors, asked, ["id"], "q", 5).collect()}
        recall.QUERY_BLOCK = before
        assert got == {(0, 1, 1.0), (0, 4, 0.6), (1, 3, 1.0)}


# The store


def test_concurrent_writers_keep_everything(spark):
    store = Store(spark, shared_folder(spark, "store"))
    failed = []

    def write(i):
        try:
            store.append("t", spark.createDataFrame([(i, f"v{i}")], "k long, v string"))
        except Exception as why:  # noqa: BLE001
            failed.append(why)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(20)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and sorted(r["k"] for r in store.rows("t", "k").collect()) == list(range(20))
    assert sorted(m.nth for m in store.versions("t")) == list(range(1, 21))


def test_versions_replace_and_take_out(spark):
    store = Store(spark, shared_folder(spark, "store"))
    rows = lambda *x: spark.createDataFrame(list(x), "k long, v string")
    keys = lambda *x: spark.createDataFrame([(k,) for k in x], "k long")
    got = lambda: sorted(tuple(r) for r in store.rows("t", "k").collect())
    with pytest.raises(LookupError):
        store.rows("t", "k")
    store.append("t", rows((1, "a"), (2, "b"), (2, "c")))
    store.append("t", rows((2, "d")))
    assert got() == [(1, "a"), (2, "d")]
    store.append("t", rows((3, "e")), gone=keys(1, 3))  # of a key both taken out and there, what is there counts
    assert got() == [(2, "d"), (3, "e")]
    store.append("t", rows((1, "f")))
    upto = store.last("t")
    store.append("t", rows((9, "late")))  # by another writer, while a whole version of what was there is made
    store.append("t", rows((1, "F"), (2, "D")), whole=True, upto=upto)
    assert got() == [(1, "F"), (2, "D"), (9, "late")]


def test_a_table_is_behind_what_it_was_made_from(spark):
    store = Store(spark, shared_folder(spark, "store"))
    one = spark.createDataFrame([(1,)], "k long")
    assert store.behind("made", "notes")
    first = store.append("notes", one)
    store.append("made", one, covers=first)
    assert not store.behind("made", "notes")
    a, b = store.append("notes", one), store.append("notes", one)
    store.append("made", one, covers=b)
    assert store.behind("made", "notes")
    store.append("made", one, covers=a)
    assert not store.behind("made", "notes")
    store.append("notes", one)
    assert store.behind("made", "notes")
    store.append("made", one, whole=True, covers=store.last("notes"))
    assert not store.behind("made", "notes")


# The library


ROWS = [
    (1, "Kestrels hover above the motorway verge and look for voles in the grass.", "en", "birds"),
    (2, "Voles live in runs through thick grass and are the prey of kestrels and owls.", "en", "mammals"),
    (3, "The ledger is closed at the end of each month and the accounts are checked twice.", "en", "work"),
    (4, "Élan vital is a term of Bergson, and the café is closed on Mondays all the year.", "en", "work"),
]


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def test_stale_signals_are_left_out(spark):
    lib = Library(spark, shared_folder(spark, "library"))
    lib.ingest(spark.createDataFrame(ROWS, SCHEMA))
    assert lib.state() == {"index": "current", "postings": "absent", "vectors": "current"}
    lib.daily("2024-01-01T00:00:00.000Z")
    assert set(lib.state().values()) == {"current"}
    first = lib.recall(asked(spark, "kestrels and voles")).collect()
    assert {r["left_out"] for r in first} == {""} and "graph" in first[0]["signals"]
    lib.ingest(spark.createDataFrame([(5, "Owls and kestrels share the barn by the river in cold winters.", "en", "birds"), (5, "Owls and kestrels share the barn by the river in cold winters.", "en", "birds")], SCHEMA))
    assert lib.state() == {"index": "current", "postings": "behind", "vectors": "current"} and lib.notes().count() == 5
    after = lib.recall(asked(spark, "owls in the barn")).orderBy("rank").collect()
    assert {r["left_out"] for r in after} == {"graph"} and 5 in {r["doc_id"] for r in after} and not any("graph" in r["signals"] for r in after)
    lib.remove(spark.createDataFrame([(5,), (2,)], "doc_id long"))
    gone = lib.recall(asked(spark, "owls kestrels barn")).collect()
    assert {r["doc_id"] for r in gone} <= {1, 3, 4} and lib.store.rows("vectors", "doc_id").where("doc_id IN (2, 5)").count() == 0
    out = lib.daily("2024-01-02T00:00:00.000Z")
    assert out["notes"] == 3 and out["issues"] == 0 and set(lib.state().values()) == {"current"}


def test_index_of_parts_is_that_of_a_whole(spark, monkeypatch):
    """Searches of an index in parts, with notes replaced and taken out, against the search of all texts."""
    monkeypatch.setattr(index, "SEGMENT", 4)
    monkeypatch.setattr(index, "FIRST_SEGMENTS", 1)
    words = ["alpha", "beta", "gamma", "delta", "épée", "epee", "x1", "Über", "一二三"]
    text = lambda i, n: " ".join(words[(i * j + n) % len(words)] for j in range(1, 3 + i % 7))
    lib = Library(spark, shared_folder(spark, "library"))
    docs = lambda ids, n: spark.createDataFrame([(i, text(i, n), "en", "s") for i in ids], SCHEMA)
    lib.ingest(docs(range(30), 0))
    lib.ingest(docs(range(20, 36), 1))
    lib.remove(spark.createDataFrame([(3,), (21,), (99,)], "doc_id long"))
    lib.ingest(docs([3], 2))
    stored = lib.full_text_index()
    rows = lib.notes().select("doc_id", F.concat_ws(" ", "title", "description", F.array_join("tags", " "), "body").alias("text"))
    assert rows.count() == 35
    queries = asked(spark, "alpha beta", "epee über", "gamma", "lph elt", "nothing", "", "x1 一二", "a")
    shown = lambda df: sorted(map(str, df.collect()))
    for k in (1, 5, 50):
        assert shown(index.lexical(stored, queries, "query_id", k)) == shown(recall.lexical(rows, queries, "doc_id", "query_id", k))
        assert shown(index.bm25(stored, queries, "query_id", k)) == shown(recall.bm25(rows, queries, "doc_id", "query_id", k))
    assert shown(index.substring_recall(stored, queries, "query_id", 5)) == shown(recall.substring_recall(rows, queries, "doc_id", "query_id", 5))
    assert shown(index.full_text(stored, queries, "query_id", 5)) == shown(recall.full_text(rows, queries, "doc_id", "query_id", 5))


class OneHot:
    def __init__(self, model, size, fails=()):
        self.model, self.size, self.fails = model, size, fails

    def __call__(self, texts):
        if any(t in self.fails for t in texts):
            raise OSError("offline")
        return [[float(len(t) % self.size == k) for k in range(self.size)] for t in texts]


def test_a_table_of_vectors_has_one_identity(spark):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "id long, text string").repartition(4)
    four = embedding.embedded(rows, "text", {"native": OneHot("m", 4)})
    assert {(r["provider"], len(r["vector"])) for r in four.collect()} == {("native", 4)}
    six = embedding.refreshed(four, rows, ["id"], "text", {"native": OneHot("m", 6)})  # nothing is missing: known ones stay
    assert {len(r["vector"]) for r in six.collect()} == {4}
    changed = rows.withColumn("text", F.when(F.col("id") == 7, "changed").otherwise(F.col("text")))
    six = embedding.refreshed(four, changed, ["id"], "text", {"native": OneHot("m", 6)})  # the new one has another size: all are asked for
    assert {len(r["vector"]) for r in six.collect()} == {6} and six.select("identity").distinct().count() == 1
    other = embedding.refreshed(four, changed, ["id"], "text", {"native": OneHot("n", 4)})
    assert {r["model"] for r in other.collect()} == {"n"}
    partly = embedding.embedded(rows, "text", {"a": OneHot("m", 4, fails=("text 150",)), "b": OneHot("m", 5)})
    assert {(r["provider"], len(r["vector"])) for r in partly.collect()} == {("b", 5)}
    long_ = embedding.embedded(rows.limit(3), "text", {"wide": lambda texts: [[0.0] * 399 + [1.0] for _ in texts]})
    assert {(len(r["vector"]), r["vector"][-1]) for r in long_.collect()} == {(400, 1.0)}
    slow = embedding.embedded(rows.limit(1), "text", {"slow": lambda texts: __import__("time").sleep(30)}, timeout=0.2)
    assert {r["provider"] for r in slow.collect()} == {"hashed"}


def test_library_with_providers_that_change(spark):
    lib = Library(spark, shared_folder(spark, "library"), {"native": OneHot("m", 4)})
    lib.ingest(spark.createDataFrame(ROWS[:3], SCHEMA))
    first = lib.identity()
    lib.providers = {"native": OneHot("m", 6)}
    lib.ingest(spark.createDataFrame(ROWS[3:], SCHEMA))
    assert lib.identity() != first and {len(r["vector"]) for r in lib.store.rows("vectors", "doc_id").collect()} == {6}
    assert lib.store.rows("vectors", "doc_id").select("doc_id").distinct().count() == 4 and lib.state()["vectors"] == "current"
    assert "vector" in {s for r in lib.recall(asked(spark, ROWS[0][1])).collect() for s in r["signals"].split("+")}
    lib.providers = {}
    assert {r["left_out"] for r in lib.recall(asked(spark, "kestrels")).collect()} == {"graph+vector"}


def test_folder_edited_moved_and_deleted(spark, tmp_path):
    """A note file is edited, moved and deleted by hand; a malformed one does not stop the others."""
    folder = f"file://{tmp_path}"
    lib = Library(spark, shared_folder(spark, "library"))
    file = tmp_path / "concepts" / "projects" / "alpha" / "manual.md"
    file.parent.mkdir(parents=True)
    file.write_text("---\ntype: Concept\ntitle: Manual nested concept\ndescription: |-\n  Block description for nested memory.\n  Second line remains valid.\ntags: [nested, manual]\nmetadata:\n  owner: human\nconfidence: 0.8\n---\n\nOriginal recall token zephyrmanual.\n")
    (tmp_path / "concepts" / "broken.md").write_text("---\ntype: Concept\ntitle: 'Recoverable note'\ndescription: 'unterminated\ntags: [old, malformed]\n---\n\n# Recoverable body\n")
    found = lambda word: [r["doc_id"] for r in lib.recall(asked(spark, word)).where("signals LIKE '%lexical%'").collect()]
    assert lib.sync(folder) == {"added": 2}
    rows = {r["path"]: r for r in lib.notes().collect()}
    note = rows["concepts/projects/alpha/manual.md"]
    assert note["tags"] == ["nested", "manual"] and "Second line remains valid" in note["description"] and note["confidence"] == 0.8
    assert rows["concepts/broken.md"]["title"] == "Recoverable note" and found("zephyrmanual") == [note["doc_id"]]
    assert lib.sync(folder) == {}
    file.write_text("---\ntype: Concept\ntitle: Manually edited concept\ndescription: A human edit.\ntags: [nested, edited]\n---\n\nReplacement token auroramanual after an edit.\n")
    assert lib.sync(folder) == {"changed": 1} and found("auroramanual") == [note["doc_id"]] and found("zephyrmanual") == []
    moved = tmp_path / "concepts" / "archive" / "manual-moved.md"
    moved.parent.mkdir()
    file.rename(moved)
    assert lib.sync(folder) == {"moved": 1, "moved_away": 1}
    assert {r["path"] for r in lib.notes().collect()} == {"concepts/archive/manual-moved.md", "concepts/broken.md"} and len(found("auroramanual")) == 1
    moved.unlink()
    assert lib.sync(folder) == {"deleted": 1} and found("auroramanual") == [] and lib.notes().count() == 1
    out = lib.daily("2024-01-01T00:00:00.000Z")
    assert out["notes"] == 1 and out["issues"] == 0


@pytest.mark.parametrize(("line", "good"), [("title: 'it''s'", True), ("title: \"a \\\" b\"", True), ("tags: [a, b] # two", True), ("title: plain 'quote", True), ("title: \"unclosed", False), ("title: 'unclosed", False), ("tags: [a", False), ("more: {a: 1", False), ("title: 'a' b", False)])
def test_unclosed_values(spark, line, good):
    raw = spark.createDataFrame([(f"---\ntype: Concept\n{line}\n---\nBody",)], "raw string")
    assert (raw.select(frontmatter(F.col("raw"))["error"].alias("e")).first()["e"] is None) == good


def test_queue_carries_what_an_action_had(spark):
    none = spark.createDataFrame([], "id string, type string, targets array<string>, description string, confidence double")
    one = lambda i: (f"a{i}", "enrich_ambiguous_concept", ["c"], "d", 0.6)
    now = spark.createDataFrame([one(1), one(2)], none.schema)
    queue = graph.reconcile(now, none.withColumns({"status": F.lit("proposed"), "updated_at": F.lit("t")}), "t0")
    queue = graph.with_status(queue, F.col("id") == "a1", "archived", "t1", "")
    queue = graph.with_status(queue, F.col("id") == "a2", "dismissed", "t1", "no").withColumn("stale", F.col("id") == "a2")
    again = {r["id"]: r for r in graph.reconcile(now.where("id = 'a1'"), queue, "t2").collect()}
    assert again["a1"]["status"] == "archived" and again["a1"]["archived_reason"] == "manual_update" and not again["a1"]["stale"]
    assert again["a2"]["stale"] and again["a2"]["status"] == "dismissed" and len(again["a2"]["history"]) == 1 and again["a2"]["closed_at"] == "t1"
