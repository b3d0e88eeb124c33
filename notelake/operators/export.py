"""Notes and views as text: what is written out of the tables."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.functions import text as T
from notelake.operators.notes import numbered
from notelake.plans.store import materialise
from notelake.sources.captures import frontmatter


def rendered_note(note_type: str = "Concept") -> Column:
    """A note (path, title, description, tags, resource, timestamp, body) as Markdown with frontmatter."""
    escaped = lambda c: F.replace(F.replace(F.replace(T.text_of(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    quoted = lambda c: F.concat(F.lit('"'), escaped(c), F.lit('"'))
    lines = [F.lit("---"), F.lit(f"type: {note_type}"), F.concat(F.lit("title: "), quoted("title")), F.concat(F.lit("description: "), quoted("description")), F.concat(F.lit("tags: ["), F.array_join("tags", ", "), F.lit("]")), F.concat(F.lit("resource: "), quoted("resource")), F.concat(F.lit("timestamp: "), T.text_of("timestamp")), F.lit("---"), F.lit(""), T.text_of("body")]
    return F.concat_ws("\n", *lines)


def write_notes(notes: DataFrame, folder: str, parts: int | None = None) -> DataFrame:
    """Valid notes as Parquet of (path, markdown) and as files, with an index and a log of the export; returns what is wrong with it.

    Valid are notes with a body (and a type, where there is such a column) and without an error. Links are Markdown links and
    resources addresses. The index has a line for each note in order of paths; it is written from as many tasks as the notes.
    """
    ok = T.trimmed(T.text_of("body")) != ""
    for c, good in (("type", lambda x: T.text_of(x) != ""), ("error", lambda x: F.col(x).isNull())):
        ok = ok & good(c) if c in notes.columns else ok
    valid = notes.where(ok).withColumn("resource", T.resource_address(F.coalesce(F.nullif(T.text_of("resource"), F.lit("")), F.lit("inline-input"))))
    out = valid.select("path", T.linked_as_markdown(rendered_note()).alias("markdown"))
    (out if parts is None else out.repartition(parts, "path")).write.mode("overwrite").parquet(f"{folder}/notes")
    spark = notes.sparkSession
    write_files(spark.read.parquet(f"{folder}/notes"), f"{folder}/files")
    written = spark.read.parquet(f"{folder}/notes")
    name = F.regexp_replace("path", r"\.md$", "")
    index = numbered(written.select("path"), [F.col("path")], "nth").select("nth", F.concat(F.lit("- ["), name, F.lit("]("), F.replace("path", F.lit(" "), F.lit("%20")), F.lit(")")).alias("line"))
    index.write.mode("overwrite").parquet(f"{folder}/index")
    log = written.agg(F.count("*").alias("n")).select(F.concat(F.lit("# Export log\n\n- Exported files: "), F.col("n").cast("string"), F.lit("\n")).alias("markdown"))
    log.write.mode("overwrite").parquet(f"{folder}/log")
    return note_issues(written.select("path", F.col("markdown").alias("raw")))


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes ``files(path, markdown)`` as files below ``folder``; path, bytes, sha256 of what is there then.

    A task writes below a name of its own attempt, and Spark commits the list of what the attempts that count have written;
    only what that list names is then put in its place, so that a killed attempt leaves nothing to be seen. Putting in place
    can be repeated. Of rows of one path one counts. Paths that leave the folder, or begin as Spark's hidden files do, raise.
    """
    spark = files.sparkSession
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(folder)
    root = at.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")
    attempts = f"{root}/_attempts-{uuid.uuid4().hex}"
    odd = ~F.col("path").rlike(r"^[^/]") | F.col("path").rlike(r"(^|/)(\.\.?|[._][^/]*)(/|$)") | F.col("path").isNull()
    rows = files.groupBy("path").agg(F.min("markdown").alias("markdown")).select("path", F.coalesce("markdown", F.lit("")).alias("markdown"), odd.alias("odd"))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        name = uuid.uuid4().hex
        for batch in batches:
            system, base = fs.FileSystem.from_uri(attempts)
            out: list[tuple[str, str, int, str]] = []
            for path, text, odd_ in zip(*(batch.column(c).to_pylist() for c in ("path", "markdown", "odd")), strict=True):
                if odd_:
                    raise ValueError(f"no path below a folder: {path}")
                data = text.encode()
                place = f"{name}/{path}"
                system.create_dir(f"{base}/{place}".rpartition("/")[0], recursive=True)
                with system.open_output_stream(f"{base}/{place}") as f:
                    f.write(data)
                out.append((path, place, len(data), hashlib.sha256(data).hexdigest()))
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], names=["path", "place", "bytes", "sha256"])

    manifest = materialise(rows.mapInArrow(written, "path string, place string, bytes long, sha256 string"), "manifest")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            system, base = fs.FileSystem.from_uri(attempts)
            target = fs.FileSystem.from_uri(root)[1]
            for path, place in zip(batch.column("path").to_pylist(), batch.column("place").to_pylist(), strict=True):
                system.create_dir(f"{target}/{path}".rpartition("/")[0], recursive=True)
                if system.get_file_info(f"{base}/{place}").type != fs.FileType.NotFound:  # else an earlier attempt has put it there
                    system.move(f"{base}/{place}", f"{target}/{path}")
            yield batch.select(["path", "bytes", "sha256"])

    done = materialise(manifest.mapInArrow(put, "path string, bytes long, sha256 string"), "files")
    system = at.getFileSystem(context._jsc.hadoopConfiguration())
    system.delete(context._jvm.org.apache.hadoop.fs.Path(attempts), True)
    return done


def note_issues(files: DataFrame, key: str = "path") -> DataFrame:
    """key, code: what is wrong with Markdown files (key, raw)."""
    parts = r"(?s)\A---\n(.*?)\n---\n(.*)\z"
    n = files.withColumns({"_front": F.regexp_extract("raw", parts, 1), "_body": F.regexp_extract("raw", parts, 2), "_has": F.col("raw").rlike(parts), "_error": frontmatter(F.col("raw"))["error"]})
    has = F.col("_has")
    rules = ((~has, "missing_frontmatter"), (has & (F.col("_error") == "invalid_frontmatter"), "invalid_frontmatter"), (has & ~F.col("_front").rlike(r"(?m)^type:\s*\S"), "missing_type"), (has & (T.trimmed(F.col("_body")) == ""), "empty_body"), (has & F.col("raw").rlike(r"\[\[[^\]]+\]\]"), "wiki_link"))
    return n.select(key, F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(code)) for bad, code in rules]))).alias("code"))


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(T.text_of(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def action_notes(queue: DataFrame, objects: DataFrame) -> DataFrame:
    """path, markdown: a note for each action of the queue, with its targets by name."""
    names = objects.select(F.col("id").alias("target"), T.object_title(F.element_at("properties", "title"), F.element_at("properties", "name"), F.element_at("properties", "resource"), F.col("id")).alias("said"))
    targets = queue.select("id", F.posexplode("targets").alias("nth", "target")).join(names, "target", "left")
    listed = targets.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.coalesce("said", "target").alias("said")))), lambda x: F.concat(F.lit("- "), x["said"])), "\n").alias("listed"))
    text = lambda name, c: F.concat(F.lit(f"{name}: "), c)
    lines = [F.lit("---"), F.lit("type: Action"), text("title", _quoted(F.concat_ws(" ", "type", "priority"))), text("description", _quoted(F.col("description"))), text("source_action", _quoted(F.col("id"))), text("action_type", _quoted(F.col("type"))), text("status", _quoted(F.col("status"))), text("priority", _quoted(F.col("priority"))), text("confidence", F.col("confidence").cast("string")), text("target_count", F.size("targets").cast("string")), text("stale", F.col("stale").cast("string")), text("created", _quoted(F.col("created_at"))), text("updated", _quoted(F.col("updated_at"))), F.lit("---"), F.lit(""), F.concat(F.lit("# "), "type"), F.lit(""), F.col("description"), F.lit(""), F.lit("## Targets"), F.lit(""), F.coalesce("listed", F.lit("- none"))]
    return queue.join(listed, "id", "left").select(F.concat(F.lit("actions/"), F.regexp_replace("id", "[^A-Za-z0-9_-]+", "-"), F.lit(".md")).alias("path"), F.concat_ws("\n", *lines).alias("markdown"))


#: A table view over the notes of actions.
ACTION_VIEW = """filters:
  and:
    - 'file.inFolder("actions")'
views:
  - type: table
    name: Actions
    limit: 100
    order: [file.name, status, priority, action_type, confidence, target_count, source_action]
    sort:
      - {property: priority, direction: ASC}
      - {property: status, direction: ASC}
"""


def artifacts(actions: DataFrame, objects: DataFrame, links: DataFrame, at: str) -> DataFrame:
    """path, kind, next_status, markdown for each action: the note of a promoted entity, or a review of its targets.

    A promoted entity's action is then done, others are in progress.
    """
    said = T.object_title(F.element_at("properties", "title"), F.element_at("properties", "name"), F.element_at("properties", "resource"), F.col("id"))
    names = objects.select(F.col("id").alias("object"), said.alias("said"))
    promote = F.col("type") == "promote_entity_note"
    targets = actions.select("id", "type", F.posexplode("targets").alias("nth", "object")).join(names, "object", "left").withColumn("said", F.coalesce("said", "object"))
    titled = targets.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "said"))), lambda x: x["said"]).alias("names"))
    by = links.where("type = 'mentions'").join(targets.where(promote).select("id", F.col("object").alias("to_id")), "to_id").join(names.withColumnRenamed("object", "from_id"), "from_id")
    mentions = by.groupBy("id").agg(F.array_sort(F.collect_set(F.concat(F.lit("- "), "said"))).alias("mentions"))
    rows = actions.select("id", "type", "description", "priority", "confidence").join(titled, "id", "left").join(mentions, "id", "left")
    name = F.coalesce(F.array_join("names", " + "), F.col("type"))
    listed = F.array_join(F.when(promote, F.coalesce("mentions", F.array().cast("array<string>"))).otherwise(F.transform(F.coalesce("names", F.array().cast("array<string>")), lambda x: F.concat(F.lit("- "), x))), "\n")
    front = [F.lit("---"), F.when(promote, "type: Entity").otherwise("type: Review"), F.concat(F.lit("title: "), _quoted(name)), F.concat(F.lit("description: "), _quoted(F.col("description"))), F.lit(f"timestamp: {at}"), F.concat(F.lit("source_action: "), _quoted(F.col("id"))), F.lit("---"), F.lit("")]
    body = [F.concat(F.lit("# "), name), F.lit(""), F.when(promote, "## Mentioned by").otherwise("## Targets"), F.lit(""), listed, F.lit(""), F.lit("## Action"), F.lit(""), F.concat(F.lit("- "), "type", F.lit(": "), "description"), F.concat(F.lit("- Priority: "), "priority"), F.concat(F.lit("- Confidence: "), F.col("confidence").cast("string"))]
    path = F.when(promote, F.concat(F.lit("entities/"), T.slug(name, F.col("id")), F.lit(".md"))).otherwise(F.concat(F.lit("reviews/"), F.regexp_replace("id", "[^A-Za-z0-9_-]+", "-"), F.lit(".md")))
    return rows.select(path.alias("path"), F.when(promote, "entity_note").otherwise("review").alias("kind"), F.when(promote, "done").otherwise("in_progress").alias("next_status"), F.concat_ws("\n", *front, *body).alias("markdown"))


def queue_markdown(queue: DataFrame, most: int = 24) -> str:
    """The active part of an action queue as Markdown: counts and the first ``most`` actions."""
    from notelake.operators.graph import STATUSES, queue_order

    counts = {r["status"]: r["count"] for r in queue.groupBy("status").count().collect()}
    active = queue.where(F.col("status").isin(*STATUSES[:3])).orderBy(*queue_order()).limit(most).collect()
    lines = ["# Action queue", "", *[f"- {s}: {counts.get(s, 0)}" for s in STATUSES], "", "## Active", ""]
    lines += [f"- [{r['status']}] {r['priority']} {r['type']}: {r['description']} ({', '.join(r['targets'])})" for r in active] or ["- none"]
    return "\n".join(lines) + "\n"


def synthesis_markdown(notes: DataFrame, links: DataFrame, similar: DataFrame, actions: DataFrame, most: int = 12) -> str:
    """The daily overview: recent notes, strongest links, most mentioned entities and suggested actions, ``most`` of each."""
    from notelake.operators.graph import hotspots, proposal_order

    recent = notes.orderBy(F.desc("timestamp"), "path").limit(most).select("title", "path").collect()
    strong = similar.orderBy(F.desc("confidence"), F.desc("a"), *proposal_order()).limit(most).collect()
    hot = hotspots(links, most).orderBy("rank").collect()
    todo = actions.orderBy(F.desc("confidence"), "id").limit(most).collect()
    parts = [("Recent notes", [f"[{r['title']}]({r['path']})" for r in recent]), ("Strongest links", [f"{r['a']} {r['type']} {r['b']} ({r['confidence']})" for r in strong]), ("Most mentioned", [f"{r['entity_id']}: {r['mentions']}" for r in hot]), ("Suggested actions", [f"{r['type']}: {r['description']}" for r in todo])]
    return "# Synthesis\n\n" + "\n".join(f"## {name}\n\n" + "\n".join(f"- {x}" for x in lines or ["none"]) + "\n" for name, lines in parts)
