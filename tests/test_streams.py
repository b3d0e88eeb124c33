"""The queue as a stream's state, a library that follows a stream, and notes as files."""

import random

from pyspark.sql import functions as F

from notelake.operators import export, graph
from notelake.plans.library import Library
from notelake.plans.store import Store, shared_folder
from notelake.sources.captures import read_notes
from notelake.streaming.ingest import follow
from notelake.streaming.queue import EVENTS, follow_queue


def test_queue_of_a_stream_is_that_of_batches(spark):
    """Generations of suggestions and changes of status, one file each; the stream is started anew for each of them."""
    rng = random.Random(5)
    folder = shared_folder(spark, "queue")
    store = Store(spark, f"{folder}/store")
    none = spark.createDataFrame([], "id string, type string, targets array<string>, description string, confidence double")
    queue = none.withColumns({"status": F.lit("proposed"), "updated_at": F.lit("t")})
    for generation in range(4):
        at, later = f"2024-01-0{generation + 1}T00", f"2024-01-0{generation + 1}T12"
        now = [(f"a{i}", "enrich_ambiguous_concept", [f"c{i}"], rng.choice("xy"), rng.choice([0.6, 0.9])) for i in range(12) if rng.random() < 0.6]
        states = [(f"a{i}", rng.choice(graph.STATUSES), rng.choice(["", " why "])) for i in range(12) if rng.random() < 0.4]
        events = [("generation", at, None, None, None, None, None, None, None), *(("suggestion", at, *x, None, None) for x in now), *(("status", later, i, None, None, None, None, s, n) for i, s, n in states)]
        spark.createDataFrame(events, EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/events")
        stream = spark.readStream.schema(EVENTS).parquet(f"{folder}/events")
        follow_queue(stream, store, f"{folder}/checkpoint", buckets=3)
        queue = graph.reconcile(spark.createDataFrame(now, none.schema), queue, at)
        for i, status, note in states:
            queue = graph.with_status(queue, F.col("id") == i, status, later, note)
        queue = spark.createDataFrame(queue.collect(), queue.schema)
        columns = [c for c in queue.columns if c in store.rows("queue", "id").columns]
        shown = lambda df: sorted(str(tuple(r)) for r in df.select(*columns).collect())
        assert len(columns) == 13 and shown(store.rows("queue", "id")) == shown(queue)


def test_library_follows_a_stream(spark):
    folder = shared_folder(spark, "follow")
    schema = "doc_id long, text string, lang string, source string"
    lib = Library(spark, f"{folder}/library")
    for part in ([(1, "Kestrels hover above the verge and look for voles."), (2, "The ledger is closed at the end of each month.")], [(2, "Now the ledger is open again, and the accounts too."), (3, "Owls live in the barn by the river.")]):
        spark.createDataFrame([(i, t, "en", "s") for i, t in part], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        follow(spark.readStream.schema(schema).parquet(f"{folder}/in"), lib, f"{folder}/checkpoint")
    assert {r["doc_id"]: r["body"].split()[0] for r in lib.notes().collect()} == {1: "Kestrels", 2: "Now", 3: "Owls"}
    assert lib.state() == {"index": "current", "postings": "absent", "vectors": "current"}


def test_notes_as_files_and_back(spark, tmp_path):
    lib = Library(spark, shared_folder(spark, "library"))
    lib.ingest(spark.createDataFrame([(1, "Kestrels hover above the verge: \"look\" for voles.", "en", "s"), (2, "", "en", "s"), (10**12, "The ledger is 'closed' at the end.", "de", "t")], "doc_id long, text string, lang string, source string"))
    folder = f"file://{tmp_path}/out"
    for _ in range(2):  # the second time over the first
        assert export.write_notes(lib.notes(), folder).count() == 0
    back = {r["path"].rpartition("/files/")[2]: r for r in read_notes(spark, f"{folder}/files").collect()}
    want = {r["path"]: r for r in lib.notes().where("body <> ''").collect()}
    assert set(back) == set(want) and len(want) == 2
    for path, note in want.items():
        got = back[path]
        assert got["error"] is None and got["title"] == note["title"] and got["tags"] == note["tags"] and got["body"].strip() == note["body"]
    assert sorted(p.name for p in (tmp_path / "out" / "files").iterdir()) == ["concepts"]
    odd = spark.createDataFrame([("../up.md", "x")], "path string, markdown string")
    try:
        export.write_files(odd, folder).count()
        raise AssertionError
    except Exception as why:  # noqa: BLE001
        assert "no path below a folder" in str(why)
