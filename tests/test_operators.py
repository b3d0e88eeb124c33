"""Text functions on literal rows, graph selection against a plain walk, sources, exports and the store."""

import random
import re

import pytest
from pyspark.sql import functions as F

from notelake.functions import text as T
from notelake.operators import export, graph, notes, recall
from notelake.plans.store import Store, shared_folder
from notelake.sources import captures


def value(spark, column, **literals):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in literals.items()]).select(column.alias("x")).first()["x"]


def test_texts_with_other_scripts(spark):
    t = F.col("t")
    assert value(spark, T.tokens(t), t="Größe_2 使用Codex进行") == ["größe", "2", "使用codex进行"]
    assert value(spark, T.normalized(t), t="　a \t b\r\nc﻿ ") == "a b\nc"
    assert value(spark, T.sentences(t), t="One. Two!  三？ 四。五") == ["One.", "Two!", "三？", "四。五"]
    assert value(spark, T.open_questions(t), t="Why? Because. 真的？") == ["Why?", "真的？"]
    assert value(spark, T.is_ambiguous(t), t="x" * 80) is False
    assert value(spark, T.is_ambiguous(t), t="这个") is True
    assert value(spark, T.title(T.summary(t)), t="") == "Untitled note"
    assert value(spark, T.title(T.summary(t)), t="a, b c-d (e) f g h i j") == "a b c-d e f g h i"
    assert value(spark, T.summary(t), t="Short. " + "y" * 300 + ".") == "y" * 217 + "..."
    assert value(spark, T.normalized_id(t), t="A\\B//Ünï 使用 -") == "a-b-ünï-使用"
    assert value(spark, T.normalized_id(t), t="--") == "unknown"
    assert value(spark, T.fnv1a(t), t="abc") == 440920331
    assert value(spark, T.word_pairs(T.tokens(t)), t="a b c") == ["a_b", "b_c"]
    assert value(spark, T.word_pairs(T.tokens(t)), t="a") == value(spark, T.word_pairs(T.tokens(t)), t="") == []
    assert value(spark, T.chunks(t), t="") == [] and [len(c) for c in value(spark, T.chunks(t), t="z" * 1801)] == [900, 900, 1]
    assert value(spark, T.linked_as_markdown(t), t="[[a|b]] and [[c]]") == "[b](a.md) and [c](c.md)"
    assert value(spark, T.without_markup(t), t="<style>x</style>a&amp;b<SCRIPT>\n1</SCRIPT><p>c") == "a&b c"
    assert value(spark, T.html_title(t), t="<p>none") is None
    assert value(spark, T.json_text(t), t='{"topic": "x。", "n": 1}') == "topic: x. n: 1"
    assert value(spark, T.source_type(t), t="a/b.JPG?x=1") == "image" and value(spark, T.source_type(t), t="http://a.example/b") == "text"


def test_entities_of_all_patterns(spark):
    found = value(spark, graph.entities(F.col("t")), t="使用Codex进行 ROI the listing Codex")
    assert [(e["id"], e["name"], e["kind"]) for e in found] == [("entity:codex", "Codex", "Platform"), ("entity:roi", "ROI", "Metric"), ("entity:listing", "listing", "DomainTerm"), ("entity:使用codex进行", "使用Codex进行", "Term")]
    assert value(spark, graph.entities(F.col("t")), t="") == [] and len(value(spark, graph.entities(F.col("t")), t=" ".join(f"abc{i}" for i in range(99)))) == 24
    assert value(spark, graph.domains(F.col("t")), t="An Agent in a vault") == ["codex", "obsidian"]
    assert value(spark, graph.canvas_hash(F.col("t")), t="abc") == "00017862"


@pytest.mark.parametrize("walked", [10**6, 0])
def test_capped_links_are_those_of_a_walk(spark, walked):
    rng = random.Random(walked)
    rows = [(a, b, "similar_to", round(rng.random(), 1), rng.randrange(2, 5)) for a in range(24) for b in range(a) if rng.random() < 0.6]
    df = spark.createDataFrame(rows, "a long, b long, type string, confidence double, evidence_count long")
    degree, want = {}, set()
    for a, b, *_ in sorted(rows, key=lambda r: (-r[0], -r[3], -r[4], -r[1])):
        if degree.get(a, 0) < 4 and degree.get(b, 0) < 4:
            want.add((a, b))
            degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    got = graph.capped_links(df, 4, walked).collect()
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want)


def test_following_rows_across_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", f"k{i % 9}"]), i) for i in range(120)]
    df = spark.createDataFrame(rows, "key string, n long")
    got = {(r["key"], r["n"]): r["following"] for r in notes.with_following(df, ["key"], [-F.col("n")], "n", 8).collect()}
    assert got == {(k, n): sorted((m for j, m in rows if j == k and m < n), reverse=True)[:8] for k, n in rows}


def test_upsert_of_repeated_and_deleted_keys(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    delta = spark.createDataFrame([(2, "x", False), (2, "y", False), (3, None, True), (4, "z", None)], "k long, v string, deleted boolean")
    got = {r["k"]: r["v"] for r in notes.upsert(base, delta, "k").collect()}
    assert set(got) == {1, 2, 4} and got[2] in "xy" and notes.upsert(base, delta, "k").count() == 3
    assert {r["k"]: r["v"] for r in notes.upsert(base, delta.drop("deleted").where("k > 2"), "k").collect()} == {1: "a", 2: "b", 3: None, 4: "z"}


def test_postings_of_similar_links(spark):
    docs = spark.createDataFrame([(1, "Kestrels hover above the verge and look for voles.", "en", "birds"), (2, "Voles live in runs through the grass.", "en", "birds")], "doc_id long, text string, lang string, source string")
    a = graph.analyse(notes.build_notes(notes.from_documents(docs)))
    similar = graph.pair_scores(a, graph.candidate_pairs(a))
    plain, more = ({(r["doc_id"], r["token"]): r["n"] for r in graph.recall_postings(a, s).collect()} for s in (None, similar))
    link = similar.first()
    assert (link["a"], link["b"], link["type"]) == (2, 1, "similar_to") and {"en", "birds"} <= set(link["evidence"])
    said = {1: f"similar_to {a.where('doc_id = 2').first()['title']}", 2: f"similar_to {a.where('doc_id = 1').first()['title']}"}
    want = dict(plain)
    for i, text in said.items():
        for w in re.findall(r"[a-z0-9]+", f"{text} {' '.join(link['evidence'])}".lower()):
            want[i, w] = want.get((i, w), 0) + 1
    assert more == want


def test_schema_issues(spark):
    whole = graph.schema_rows(spark)
    codes = lambda df: sorted((r["code"], r["path"]) for r in graph.schema_issues(df).collect())
    assert codes(whole) == [] and codes(whole.limit(0))[-1] == ("missing_schema_section", "schema.objectTypes") and ("missing_schema", "schema") in codes(whole.limit(0)) or codes(whole.limit(0)) == [("missing_schema", "schema")]
    broken = whole.where("section <> 'actionTypes' and type <> 'Tag'").withColumn("to_type", F.when(F.col("type") == "mentions", "Tag").otherwise(F.col("to_type"))).withColumn("properties", F.when(F.col("type") == "Entity", F.array(F.lit("name"))).otherwise(F.col("properties")))
    assert codes(broken) == [("missing_schema_property", "schema.objectTypes.Entity.kind"), ("missing_schema_section", "schema.actionTypes"), ("missing_schema_type", "schema.objectTypes.Tag"), ("schema_type_mismatch", "schema.linkTypes.mentions.to")]
    odd = whole.withColumn("inputs", F.when(F.col("type") == "promote_entity_note", F.array(F.lit("Tag"))).otherwise(F.col("inputs")))
    assert codes(odd) == [("schema_inputs_mismatch", "schema.actionTypes.promote_entity_note")]


def test_bm25_against_a_full_text_index(spark):
    import sqlite3

    texts = ["the cat sat", "the dog sat on the cat", "a bird", "cat cat cat dog", "nothing here at all"]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(t)")
    con.executemany("insert into f(rowid, t) values (?, ?)", list(enumerate(texts)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    queries = spark.createDataFrame([(1, "cat dog"), (2, "bird zebra")], "item_id long, text string")
    got = {(r["item_id"], r["doc_id"]): r["bm25"] for r in recall.bm25(docs, queries, "doc_id", "item_id", 10).collect()}
    want = {(q, i): round(s, 4) for q, m in ((1, '"cat" OR "dog"'), (2, '"bird" OR "zebra"')) for i, s in con.execute("select rowid, bm25(f) from f where f match ?", (m,))}
    assert got == want
    scores = [value(spark, recall.compatible_score(F.col("x")), x=float(x)) for x in (-2.0, -1.0, -0.5, 1.0)]
    assert scores == [0.01, 0.01, 2.0, 0.5]


def test_numbered_and_generation(spark):
    rows = spark.createDataFrame([(i, f"p{i % 7}", "x") for i in range(50)], "n long, path string, body string")
    got = notes.numbered(rows, [F.desc("path"), F.col("n")], "ord").orderBy("ord").collect()
    want = sorted(((f"p{i % 7}", i) for i in range(50)), key=lambda x: (-int(x[0][1:]), x[1]))
    assert [(r["path"], r["n"]) for r in got] == want and [r["ord"] for r in got] == list(range(50))
    a, b = (notes.generation(rows.repartition(k)).first() for k in (1, 5))
    assert a == b and a["notes"] == 50
    assert notes.generation(rows.withColumn("body", F.lit("y"))).first()["generation"] != a["generation"]


def test_generation_tells_repeated_notes_apart(spark):
    digest = lambda *rows: notes.generation(spark.createDataFrame(list(rows), "path string, body string")).first()["generation"]
    assert len({digest(("a", "x"), ("a", "x")), digest(("a", "y"), ("a", "y")), digest(("b", "x"), ("b", "x"))}) == 3
    assert digest(("a", "x"), ("a", "x"), ("b", "y")) != digest(("b", "y"), ("b", "y"), ("b", "y"))


def test_generation_hashes_sorted_lines(spark):
    import hashlib

    rows = [(f"p{i % 900}", None if i % 7 == 0 else f"body {i % 11}") for i in range(9_000)] + [(None, "no path")] * 3
    buckets, sha = {}, lambda x: hashlib.sha256(x.encode()).hexdigest()
    for path, body in rows[:9_000]:
        buckets.setdefault(hashlib.sha1(path.encode()).hexdigest()[:3], []).append(f"{path}\n{sha(body or '')}")
    want = sha("\n".join(sha("\n".join(sorted(lines))) for _, lines in sorted(buckets.items())))
    df = spark.createDataFrame(rows, "path string, body string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # buckets lie in several batches
    try:
        assert tuple(notes.generation(df.repartition(5)).first()) == (9_003, want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_generation_digest_of_odd_documents(spark, tmp_path):
    import duckdb

    from notelake import registry

    odd = [(1, "a"), (1, "a"), (1, "b"), (-3, None), (None, "x"), (2, ""), (123456789012, "Grüße\n")]
    for name, rows in (("odd", odd), ("empty", []), ("without_ids", [(None, "x"), (None, None)])):
        docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
        docs.coalesce(1).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        con = duckdb.connect()
        con.execute(f"create view documents as select * from '{tmp_path}/{name}/documents.parquet/*.parquet'")
        want = con.execute(registry.oracle_sql()["generation_digest"]).fetchall()
        assert [tuple(r) for r in registry.queries()["generation_digest"](spark, f"{tmp_path}/{name}").collect()] == want


def test_frontmatter(spark):
    raw = ['---\ntitle: "A: b"\ntags: [x, y]\ntitle: later\n---\nbody\n', "no front", "---\r\ntitle: x\r\n---\r\n", "---\ntitle: x\n\"bad\n---\nb"]
    n = captures.frontmatter(F.col("raw"))
    got = [r["n"] for r in spark.createDataFrame([(x,) for x in raw], "raw string").select(n.alias("n")).collect()]
    assert got[0]["fields"] == {"title": "later", "tags": "[x, y]"} and got[0]["body"] == "body\n" and got[0]["error"] is None
    deep = "---\ntags:\n  - x\n  - y z\nmeta:\n  a: 1\n  b: 2\nsummary: |\n  one\n  two\n---\nbody"
    fields = spark.createDataFrame([(deep,)], "raw string").select(n.alias("n")).first()["n"]
    assert fields["fields"] == {"tags": "x, y z", "meta": "a: 1; b: 2", "summary": "one two"} and fields["error"] is None
    assert [x["error"] for x in got[1:]] == ["missing_frontmatter", "missing_frontmatter", "invalid_frontmatter"]


def test_folder_of_notes(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.md").write_text("---\ntype: Concept\ntitle: One\ntags: [x]\n---\nBody [[two]]")
    (tmp_path / "two.MD").write_text("bare")
    (tmp_path / "three.txt").write_text("no note")
    (tmp_path / "index.md").write_text("- [one](a/one.md)")
    (tmp_path / "actions").mkdir()
    (tmp_path / "actions" / "x.md").write_text("a view")
    got = {r["path"].rsplit("/", 1)[1]: r for r in captures.read_notes(spark, str(tmp_path)).collect()}
    assert set(got) == {"one.md", "two.MD"}
    assert (got["one.md"]["title"], got["one.md"]["tags"], got["one.md"]["error"]) == ("One", ["x"], None)
    assert got["two.MD"]["error"] == "missing_frontmatter"


def test_extraction_by_type(spark):
    rows = spark.createDataFrame([("a.json", '{"k": "v."}'), ("b.csv", "x,y\n\n1,2"), ("c.html", "<b>t</b>"), ("d.md", " t  u ")], "path string, text string")
    assert {r["path"]: r["extracted"] for r in captures.extracted(rows).collect()} == {"a.json": 'a.json. k: v\n\nRaw JSON:\n{\n  "k": "v."\n}', "b.csv": "x,y\n1,2", "c.html": "t", "d.md": "t u"}
    more = spark.createDataFrame([("x/i.json", '{"topic": "Lists", "detail": {"a": 1}, "next": ["p", "q"]}'), ("j.json", "not json")], "path string, text string")
    got = {r["path"]: (r["title"], r["extracted"]) for r in captures.extracted(more).collect()}
    assert got["x/i.json"][0] == "Lists" and got["x/i.json"][1].startswith('Lists. topic: Lists. detail: {"a":1}. next: p, q\n\nRaw JSON:\n{\n  "topic"') and got["j.json"] == ("j.json", "not json")

    def broken(_):
        raise ValueError("no model")

    media = spark.createDataFrame([("image", b"abc"), ("audio", b"d")], "source_type string, content binary")
    got = {r["source_type"]: r for r in captures.extracted_media(media, {"image": [broken, lambda b: b.decode().upper()]}).collect()}
    assert got["image"]["extracted"] == "ABC" and got["image"]["failures"] == ["broken: no model"] and got["audio"]["extracted"] is None


def test_queue_states(spark):
    now = spark.createDataFrame([("1", "t", ["x"], "d", 0.9), ("2", "t", ["x"], "d", 0.7), ("6", "t", ["x"], "new", 0.7)], "id string, type string, targets array<string>, description string, confidence double")
    old = spark.createDataFrame([(i, "t", ["x"], "d", 0.7, s, "then") for i, s in (("2", "done"), ("3", "proposed"), ("4", "accepted"), ("5", "dismissed"), ("6", "accepted"))], "id string, type string, targets array<string>, description string, confidence double, status string, updated_at string").withColumn("history", F.array().cast("array<struct<at:string,from:string,to:string,note:string>>"))
    queue = graph.reconcile(now, old, "now")
    got = {r["id"]: (r["status"], r["stale"], r["archived_reason"], r["updated_at"], r["priority"]) for r in queue.collect()}
    assert got == {"1": ("proposed", False, None, "now", "high"), "2": ("done", False, None, "then", "medium"), "3": ("archived", True, "suggestion_not_current", "now", "medium"), "4": ("accepted", True, None, "then", "medium"), "5": ("dismissed", False, None, "then", "medium"), "6": ("accepted", False, None, "now", "medium")}
    after = {r["id"]: r for r in graph.with_status(queue, F.col("id") == "1", "archived", "later", " seen ").collect()}
    assert (after["1"]["status"], after["1"]["archived_reason"], after["1"]["closed_at"], after["1"]["history"][0]["from"]) == ("archived", "seen", "later", "proposed")
    assert "[accepted] medium t" in export.queue_markdown(queue)
    with pytest.raises(ValueError):
        graph.with_status(queue, F.lit(True), "odd", "now")


def test_store_generations(spark):
    store = Store(spark, shared_folder(spark, "store"))
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    assert store.read_or_build("t", "g1", build).count() == store.read_or_build("t", "g1", build).count() == 3
    assert len(built) == 1
    with pytest.raises(LookupError):
        store.read("t", "g2")


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    queries = spark.createDataFrame([], "item_id long, text string")
    a = graph.analyse(notes.build_notes(notes.from_documents(docs)))
    for df in (recall.lexical(docs, queries, "doc_id", "item_id", 3), recall.bm25(docs, queries, "doc_id", "item_id", 3), recall.substring_recall(docs, queries, "doc_id", "item_id", 3), graph.structural_links(a), graph.candidate_pairs(a), graph.capped_links(graph.pair_scores(a, graph.candidate_pairs(a)))):
        assert df.count() == 0


def test_chunks_and_keywords_are_made_where_texts_are_read(spark):
    long_ = " ".join(f"Word{i % 7} and then number{i}." for i in range(400))
    rows = [(1, long_), (2, "a " * 900 + "b. " + "This sentence is the first one of forty characters or more. End."), (3, None), (4, " \t\n"), (5, "été été Été zebra, zebra apple")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    made = notes.from_documents(docs)
    here, shuffled = (notes.build_notes(made, apart=x) for x in (True, False))
    shown = lambda df: sorted(str(sorted(r.asDict().items())) for r in df.collect())
    assert shown(here) == shown(shuffled) and "Exchange" not in here._jdf.queryExecution().executedPlan().toString()
    assert here.where("doc_id = 5").first()["tags"] == ["en", "s", "été", "zebra", "apple"]
    assert notes.each_once(docs, "doc_id") and not notes.each_once(docs.unionByName(docs.limit(1)), "doc_id") and not notes.each_once(docs.withColumn("doc_id", F.lit(None).cast("long")), "doc_id")
    assert value(spark, T.chunks(F.col("t")), t=long_) == [long_[i : i + 900] for i in range(0, len(long_), 900)]
    plan = spark.createDataFrame([(long_,)], "t string").select(T.chunks(F.col("t")).alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 1  # the body is made once, not once a chunk
    sentence = "This sentence is the first one of forty characters or more."
    assert value(spark, T.summary(F.col("t")), t="Short. " * 300 + sentence + " End.") == sentence
    assert value(spark, T.summary(F.col("t")), t=("Tiny. " * 243 + sentence + " End. ") * 3) == sentence


@pytest.fixture(scope="module")
def alike(spark):
    """Analysed notes that share tags, entities and keywords, some written alike and some with capitals."""
    rng = random.Random(5)
    words = ["Codex", "codex", "listing", "Budget", "kestrel", "vole", "grass", "verge", "ontology", "Zebra", "campaign", "über"]
    rows = [(i * 3 - 20, " ".join(rng.choices(words, k=rng.randrange(0, 9))) + ".", rng.choice(["en", "Grass", None]), rng.choice(["codex", "vole"])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return graph.analyse(notes.build_notes(notes.from_documents(docs))).localCheckpoint()


def _rows(df):
    return sorted((r["a"], r["b"], r["type"], r["confidence"], r["evidence_count"]) for r in df.collect())


@pytest.mark.parametrize("block", [7, 1 << 18])
def test_pairs_scored_by_numbers_are_those_of_strings(spark, alike, block):
    want = _rows(graph.pair_scores(alike, graph.candidate_pairs(alike)))
    assert _rows(graph.scored_pairs(alike, block)) == want and len(want) > 500 and {"similar_to", "same_domain"} == {r[2] for r in want}


def test_pairs_of_repeated_ids_and_of_nothing(spark, alike):
    twice = alike.unionByName(alike.limit(2))
    assert _rows(graph.scored_pairs(twice)) == _rows(graph.pair_scores(twice, graph.candidate_pairs(twice)))
    assert graph.scored_pairs(alike.limit(0)).collect() == [] and graph.scored_pairs(alike.limit(1)).collect() == []


def test_pairs_are_not_joined_with_strings(spark, alike):
    """What a pair costs to shuffle: numbers of both notes once a block, no arrays of strings once a pair."""
    plan = graph.scored_pairs(alike)._jdf.queryExecution().optimizedPlan().toString()
    assert "keywords" not in plan and "entities" not in plan
    pairs = graph.candidate_pairs(alike)._jdf.queryExecution().optimizedPlan().toString()
    assert " key#" not in pairs and ",key#" not in pairs and "place#" in pairs


def test_newest_notes_pairs_alone(spark, alike):
    want = {(r["a"], r["b"], r["nth"]) for r in graph.candidate_pairs(alike).where("a >= 100").collect()}
    assert {(r["a"], b, n + 1) for r in graph.newest_lists(alike, 100).collect() for n, b in enumerate(r["bs"])} == want and want
    whole = graph.capped_links(graph.pair_scores(alike, graph.candidate_pairs(alike))).where(f"type = 'similar_to' and confidence >= {graph.MERGE_FROM}")
    best = [(r["a"], r["b"]) for r in whole.orderBy(F.desc("a"), *graph.proposal_order()).limit(8).collect()]
    for first in (2, 256):
        assert sorted((r["a"], r["b"]) for r in graph.first_merges(alike, 8, first).collect()) == sorted(best)


def test_capped_links_in_ranges(spark, alike, monkeypatch):
    scored = graph.pair_scores(alike, graph.candidate_pairs(alike))
    walks = []
    monkeypatch.setattr(graph, "_walked", lambda rows, k, was=graph._walked: walks.append(1) or was(rows, k))
    whole, parts = (sorted(map(str, graph.capped_links(scored, 5, n).collect())) for n in (10**6, 300))
    assert whole == parts and 3 <= len(walks) <= 12


def test_small_queries_as_a_matrix_find_what_joins_find(spark, monkeypatch):
    rng = random.Random(8)
    words = ["été", "ete", "vole", "volet", "le", "grass", "12", "kestrel", "x", "知识管理"]
    rows = [(i * 7 - 50, None if i % 17 == 0 else " ".join(rng.choices(words, k=rng.randrange(0, 12)))) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    queries = spark.createDataFrame([(1, "vole vole le"), (2, "été grass"), (3, ""), (4, None), (5, "ole"), (-6, "知识 x absent"), (7, " ".join(words))], "item_id long, text string")
    ask = {"lexical": recall.lexical, "bm25": recall.bm25, "substring": recall.substring_recall, "full": recall.full_text}
    found = lambda: {name: sorted(str(r.asDict()) for r in f(docs, queries, "doc_id", "item_id", 6).collect()) for name, f in ask.items()}
    monkeypatch.setattr(recall, "ENTRIES", 16)
    here = found()
    plan = recall.lexical(docs, queries, "doc_id", "item_id", 6)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan
    monkeypatch.setattr(recall, "MATRIX_QUERIES", 0)
    assert here == found() and all(len(v) > 10 for v in here.values())
    monkeypatch.undo()
    twice = docs.unionByName(docs.limit(3)).withColumn("doc_id", F.when(F.col("doc_id") != 6, F.col("doc_id")))
    assert recall.Asked.of(recall.query_tokens(queries, "item_id", "text"), "item_id", twice, "doc_id") is None


def test_texts_against_queries_without_their_vectors(spark):
    from notelake.operators import embedding

    rng = random.Random(9)
    words = ["vole", "grass", "x" * 70, "知识管理", "kestrel", "verge", "été"]
    rows = [(i % 40, i, " ".join(rng.choices(words, k=rng.randrange(0, 6)))) for i in range(200)]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_no long, chunk string").repartition(4)
    asked = embedding.hashed_vectors(spark.createDataFrame([(1, "vole grass"), (2, "知识管理 " + "x" * 70), (3, "")], "q long, text string"), ["q"], F.col("text"))
    keys = ["doc_id", "chunk_no"]
    best = lambda found, k: [tuple(r) for r in recall.best(recall.best_rows(found, keys, "q"), "q", [F.desc("score"), F.col("doc_id")], k).select("q", *keys, "score", "rank").orderBy("q", "rank").collect()]
    for k in (3, 50):
        got = best(recall.text_scores(chunks, asked, keys, F.col("chunk"), "q", k), k)
        assert got == best(recall.vector_scores(embedding.hashed_vectors(chunks, keys, F.col("chunk")), asked, keys, "q", k), k) and len(got) > 5
    bins = {(r["doc_id"], r["chunk_no"], r["bin"]): r["weight"] for r in embedding.hashed_bins(chunks, keys, F.col("chunk")).collect()}
    want = {(r["doc_id"], r["chunk_no"], i): w for r in embedding.hashed_vectors(chunks, keys, F.col("chunk")).collect() for i, w in enumerate(r["vector"]) if w}
    assert bins == want


def test_queries_that_stand_alone_build_no_index(spark, sf, monkeypatch):
    from notelake import registry
    from notelake.operators import index

    def built(*_):
        raise AssertionError("an index of all tokens was built")

    monkeypatch.setattr(index, "built", built)
    for name in ("lexical_recall", "like_recall", "score_normalize", "fused_recall"):
        assert registry.queries()[name](spark, sf).count() > 0
