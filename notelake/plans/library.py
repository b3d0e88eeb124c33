"""A library of notes on a folder: ingest, the daily rebuild, recall, and the action queue with its artifacts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.functions import text as T
from notelake.operators import embedding, export, graph, index, notes, recall
from notelake.plans.store import Store, materialise
from notelake.sources import captures as captures_


def bounded(value: object, low: int, high: int, default: int) -> int:
    """``value`` as a whole number between ``low`` and ``high``; ``default`` where it is none."""
    try:
        return max(low, min(high, int(str(value).strip())))
    except ValueError:
        return default


@dataclass
class Config:
    """What a library may be told; anything else has these defaults."""

    base_tags: tuple[str, ...] = ()
    top_k: int = graph.TOP_K
    queue_limit: int = 20
    recall_limit: int = 5
    max_links: int | None = None

    @classmethod
    def of(cls, given: dict[str, object]) -> Config:
        """``given`` over the defaults; names that are not known are left out, numbers are kept within their bounds."""
        known = {f.name: given[f.name] for f in fields(cls) if given.get(f.name) is not None}
        bounds = {"top_k": (1, 100, graph.TOP_K), "queue_limit": (1, 100, 20), "recall_limit": (1, 20, 5), "max_links": (1, 2**62, 1000)}
        known |= {k: bounded(known[k], *b) for k, b in bounds.items() if k in known}
        return cls(**known | ({"base_tags": tuple(known["base_tags"])} if "base_tags" in known else {}))


def within_budget(links: DataFrame, order: list, most: int) -> tuple[DataFrame, bool]:
    """The first ``most`` links in ``order``, and whether that left any out. Nothing is sorted where all fit."""
    if links.count() <= most:
        return links, False
    return notes.numbered(links, [F.expr(o) if isinstance(o, str) else o for o in order], "_nth").where(F.col("_nth") < most).drop("_nth"), True


def enriched(captures: DataFrame, ask: Callable[[str], tuple[str, list[str]]]) -> DataFrame:
    """Ambiguous captures with what ``ask`` says to their search query, and its citations, put after their text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            said = []
            for text, query, wanted in zip(batch["text"], batch["_query"], batch["_ask"], strict=True):
                more, citations = ask(query) if wanted else ("", [])
                said.append("\n\n".join(x for x in (text or "", more, "\n".join(citations)) if x) if wanted else text)
            yield batch.assign(text=pd.Series(said, dtype=object, index=batch.index)).drop(columns=["_query", "_ask"])

    title = T.title(T.summary(T.text_of("text")))
    rows = captures.withColumns({"_ask": T.is_ambiguous(T.text_of("text")), "_query": T.search_query(title, F.col("text"))})
    return rows.mapInPandas(run, captures.schema)


#: The tables that a search reads.
SIGNALS = ("index", "postings", "vectors")


def one_of_each(rows: DataFrame, key: str) -> DataFrame:
    """One row of each key, the same one each time."""
    columns = rows.columns
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.xxhash64(*columns)).alias("_row")).select("_row.*")


def note_text() -> Column:
    """What of a note is searched for words."""
    return F.concat_ws(" ", "title", "description", F.array_join("tags", " "), "body")


def chunks(rows: DataFrame) -> DataFrame:
    """doc_id, chunk_no, chunk: what of notes is embedded."""
    made = rows.select("doc_id", F.explode(T.note_chunks(F.col("title"), F.col("description"), F.col("tags"), F.col("body"))).alias("c"))
    return made.select("doc_id", F.col("c.chunk_no").alias("chunk_no"), F.col("c.chunk").alias("chunk")).where("chunk is not null")


def _identities(vectors: DataFrame) -> str | None:
    found = [r["identity"] for r in vectors.select("identity").distinct().limit(2).collect()]
    if len(found) > 1:
        raise ValueError("vectors of different identities in one table")
    return found[0] if found else None


#: The columns of notes.
NOTE_COLUMNS = ("doc_id", "path", "body", "resource", "timestamp", "description", "title", "tags", "confidence")


@dataclass
class Library:
    """Tables below ``root``, each a whole version and what was added since. A new object on an old folder goes on where it was.

    Every table that is made from notes names the version of the notes that it was made from. What is behind the notes is
    not read: ``state`` says which tables are, and ``recall`` which signals it left out for it.
    """

    spark: SparkSession
    root: str
    providers: dict[str, embedding.Provider] = field(default_factory=dict)
    dictionary: dict[str, tuple[str, ...]] = field(default_factory=lambda: graph.DOMAINS)
    config: Config = field(default_factory=Config)

    def __post_init__(self) -> None:
        self.store = Store(self.spark, self.root)

    def notes(self) -> DataFrame:
        return self.store.rows("notes", "doc_id")

    def ingest(self, captures: DataFrame, enrich: Callable[[str], tuple[str, list[str]]] | None = None) -> int:
        """Adds captures (doc_id, text, lang, source); those of a known id replace it, and of a repeated id one counts.

        Returns the number of the notes' new version. Only the captures are written, as notes, postings and vectors; of
        their chunks those with known contents are not embedded again.
        """
        captures = one_of_each(captures, "doc_id")
        captures = captures if enrich is None else enriched(captures, enrich)
        return self.put(notes.build_notes(notes.from_documents(captures), self.config.base_tags))

    def put(self, made: DataFrame, gone: DataFrame | None = None) -> int:
        """Adds notes as they are, and takes the keys ``gone(doc_id)`` out; postings and vectors follow."""
        new = materialise(made, "notes")
        version = self.store.append("notes", new, gone=gone)
        self._index(new, version, gone=gone)
        if self.store.last("vectors"):
            touched = new.select("doc_id") if gone is None else new.select("doc_id").unionByName(gone.select("doc_id"))
            known = self.store.rows("vectors", "doc_id").join(touched.distinct(), "doc_id", "left_semi")
        else:
            known = None
        fresh = materialise(embedding.refreshed(known, chunks(new), ["doc_id", "chunk_no"], "chunk", self.providers), "vectors")
        own, whole = _identities(fresh), self.identity()
        if own and whole and own != whole:  # another provider answered: its vectors are not put beside those of the last one
            self._embed_all(version)
        else:
            self.store.append("vectors", fresh, gone=gone, covers=version)
        return version

    def remove(self, ids: DataFrame) -> int:
        """Takes the notes ``ids(doc_id)`` out of the library, of its postings and of its vectors."""
        gone = materialise(ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "gone")
        return self.put(self.notes().limit(0), gone)

    def sync(self, folder: str) -> dict[str, int]:
        """Brings the library's notes of a folder of Markdown files up to the folder: new, edited, moved and deleted files.

        Files whose size and time are as they were are not read. A moved file is a deleted and a new one; ``moved`` counts them.
        """
        listed = materialise(captures_.listing(self.spark, folder), "listing")
        before = self.store.rows("files", "path") if self.store.last("files") else listed.limit(0).withColumns({"sha256": F.lit(""), "doc_id": F.lit(0).cast("long")})
        before = materialise(before.select("path", "size", "modified", "sha256", "doc_id"), "before")
        touched = captures_.touched(before, listed)
        read = materialise(captures_.file_notes(self.spark, folder, touched.where("status <> 'deleted'")), "read")
        now = read.select("path", "size", "modified", "sha256", "doc_id")
        changes = materialise(captures_.changes(before, touched, now), "changes")
        edited = read.join(changes.where("status IN ('added', 'moved', 'changed')").select("path"), "path", "left_semi")
        out = changes.where("status IN ('deleted', 'moved_away')").select("path", "doc_id")
        if changes.where("status <> 'same'").limit(1).count():
            self.put(edited.select(*NOTE_COLUMNS), out.select("doc_id"))
        self.store.append("files", now, gone=out.select("path"))
        return {r["status"]: r["n"] for r in changes.groupBy("status").agg(F.count("*").alias("n")).collect()}  # six at most

    def identity(self) -> str | None:
        """The identity of the library's vectors; None without vectors."""
        if not self.store.last("vectors"):
            return None
        return _identities(self.store.rows("vectors", "doc_id"))

    def _embed_all(self, version: int) -> None:
        upto = self.store.last("vectors")
        every = embedding.refreshed(None, chunks(self.notes()), ["doc_id", "chunk_no"], "chunk", self.providers)
        self.store.append("vectors", every, whole=True, covers=version, upto=upto)

    def _index(self, rows: DataFrame, version: int, whole: bool = False, gone: DataFrame | None = None) -> None:
        upto = self.store.last("index") if whole else None
        tables = index.written(rows, "doc_id", note_text())
        self.store.append("index", tables.pop("rows"), whole=whole, covers=version, upto=upto, gone=gone, beside=tables)

    def full_text_index(self) -> index.Index:
        return index.Index("doc_id", *[self.store.parts("index", part) for part in ("rows", "blocks", "runs")], self.store.newest("index", "doc_id"))

    def state(self) -> dict[str, str]:
        """Of every table that recall reads whether it is absent, behind the notes, or current."""
        return {name: "absent" if not self.store.last(name) else "behind" if self.store.behind(name, "notes") else "current" for name in SIGNALS}

    def daily(self, at: str, review: Callable[[str], str] | None = None) -> dict[str, object]:
        """Rebuilds the graph and reconciles the queue; returns counts, issues, the digest of all notes and the synthesis.

        What was added to notes, postings and vectors since the last time becomes one whole version of each.
        """
        version = self.store.last("notes")
        self.store.append("notes", self.notes(), whole=True, upto=version)
        rows = self.notes()
        if self.store.behind("vectors", "notes"):
            self._embed_all(version)
        else:
            self.store.append("vectors", self.store.rows("vectors", "doc_id"), whole=True, covers=version)
        self._index(rows, version, whole=True)
        n = rows.count()
        analysed = materialise(graph.analyse(rows, self.dictionary), "analysis")
        objects = graph.objects(analysed)
        relations = -(-n * self.config.top_k // 2)
        most = self.config.max_links or max(1000, n * (1 + graph.MAX_TAGS + graph.MAX_ENTITIES) + relations)
        links, degraded = within_budget(graph.structural_links(analysed), graph.link_order(), most)
        links = materialise(links, "links")
        left = most - links.count()
        similar, fewer = within_budget(graph.capped_links(graph.pair_scores(analysed, graph.candidate_pairs(analysed)), self.config.top_k), [F.desc("a"), "rank"], min(relations, max(left, 0)))
        similar = materialise(similar, "similar")
        actions = materialise(graph.actions(analysed, links, similar), "actions")
        queue = materialise(graph.reconcile(actions, self._queue() if self.store.last("queue") else self._no_queue(actions), at), "queue")
        for name, df in (("objects", objects), ("links", links), ("similar", similar), ("postings", graph.recall_postings(analysed, similar)), ("queue", queue)):
            self.store.append(name, df, whole=True, covers=version)
        every = links.select("type", "from_id", "to_id", "confidence", F.array("from_id").alias("evidence")).unionByName(graph.with_concepts(similar, analysed).select("type", "from_id", "to_id", "confidence", "evidence"))
        issues = graph.graph_issues(objects, every, actions).unionByName(graph.queue_issues(queue, objects, actions))
        synthesis = export.synthesis_markdown(rows, links, similar, actions)
        out = {"notes": n, "links": links.count(), "similar": similar.count(), "issues": issues.count(), "generation": notes.generation(rows).first()["generation"]}
        out |= {"degraded": degraded or fewer, "reasons": [r for r, is_so in (("link budget", degraded), ("similarity budget", fewer)) if is_so]}
        return out | {"synthesis": synthesis, "queue": export.queue_markdown(queue)} | ({"review": review(synthesis)} if review else {})

    @staticmethod
    def _no_queue(actions: DataFrame) -> DataFrame:
        none = F.lit(None).cast("string")
        return actions.limit(0).withColumns({"status": F.lit("proposed"), "stale": F.lit(False), "archived_reason": none, "updated_at": none, "created_at": none, "closed_at": none, "history": F.array().cast("array<struct<at:string,from:string,to:string,note:string>>")})

    def _queue(self) -> DataFrame:
        return self.store.rows("queue", "id")

    def queue(self, status: str | None = None, most: object = None) -> DataFrame:
        if status is not None and status not in graph.STATUSES:
            raise ValueError(f"no such status: {status}")
        rows = self._queue() if status is None else self._queue().where(F.col("status") == status)
        return rows.orderBy(*graph.queue_order()).limit(bounded(most, 1, 100, self.config.queue_limit))

    def update(self, action: str, status: str, at: str, note: str = "") -> None:
        """Sets an action's status: the action alone is written, in front of the queue's last version."""
        queue = self._queue()
        one = queue.where(F.col("id") == action)
        if not one.limit(1).count():
            raise LookupError(f"no such action: {action}")
        self.store.append("queue", graph.with_status(one, F.lit(True), status, at, note).select(*queue.columns))

    def execute(self, action: str, at: str) -> dict[str, str]:
        """Writes what an action is for (a note of an entity, or a review) among the artifacts, and moves its status on."""
        one = self._queue().where(F.col("id") == action)
        row = one.first()
        if row is None:
            raise LookupError(f"no such action: {action}")
        made = materialise(export.artifacts(one, self.store.rows("objects", "id"), self.store.rows("links", "from_id"), at), "artifact")
        self.store.append("artifacts", made)
        out = made.first()
        self.update(action, out["next_status"], at, f"executed: {out['path']}")
        return {"path": out["path"], "kind": out["kind"], "status": out["next_status"]}

    def artifacts(self) -> DataFrame:
        return self.store.rows("artifacts", "path")

    def recall(self, queries: DataFrame, k: object = None) -> DataFrame:
        """query_id, doc_id, score, signals, rank, left_out for ``queries(query_id, text)``, by up to four signals fused.

        ``left_out`` names the signals that were not asked, because what they read is absent or behind the notes, or because
        the provider of the vectors does not answer the questions.
        """
        k = bounded(k, 1, 20, self.config.recall_limit)
        state = self.state()
        signals, left_out = [], []
        top = lambda df, *ties: recall.best(df, "query_id", [F.desc("score"), *ties], k)
        if state["index"] == "current":
            stored = self.full_text_index()
            signals.append(("lexical", index.lexical(stored, queries, "query_id", k), True))
            signals.append(("fulltext", index.full_text(stored, queries, "query_id", k), True))
        else:
            left_out += ["lexical", "fulltext"]
        if state["postings"] == "current":
            asked = recall.small(recall.query_tokens(queries, "query_id", "text"))
            by_graph = self.store.rows("postings", "doc_id").join(asked, "token").groupBy("query_id", "doc_id").agg(F.sum(F.col("n") * F.col("times")).alias("score"))
            signals.append(("graph", top(by_graph, F.desc("doc_id")), True))
        else:
            left_out.append("graph")
        wanted = self.identity() if state["vectors"] == "current" else None
        questions = embedding.questions(queries.select("query_id", "text"), "text", wanted, self.providers) if wanted else None
        if questions is not None:
            keys = ["doc_id", "chunk_no"]
            near = recall.best_rows(recall.vector_scores(self.store.rows("vectors", "doc_id"), questions, keys, "query_id", k), keys, "query_id")
            signals.append(("vector", top(near.select("query_id", "doc_id", "score"), F.col("doc_id")), False))
        else:
            left_out.append("vector")
        if not signals:
            out = queries.select("query_id", F.lit(0).cast("long").alias("doc_id"), F.lit(0.0).alias("score"), F.lit("").alias("signals"), F.lit(0).cast("long").alias("rank")).limit(0)
        else:
            out = recall.fused(signals, "query_id", "doc_id", k)
        return out.withColumn("left_out", F.lit("+".join(left_out)))
