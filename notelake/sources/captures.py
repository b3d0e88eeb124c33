"""Raw captures: files of many kinds and note folders, read as tables."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from notelake.functions import text as T

#: So many files at most are opened by their names.
NAMED = 10_000
#: Notes whose file states no confidence.
DEFAULT_CONFIDENCE = 0.72
#: Frontmatter is recognised with line feeds, from the first byte on.
_PARTS = r"(?s)\A---\n(.*?)\n---\n(.*)\z"
#: A value that begins with a quote or a bracket and does not end with it (and a comment).
_UNCLOSED = r"""^(?:'(?!(?:[^']|'')*'\s*(?:#.*)?$)|"(?!(?:[^"\\]|\\.)*"\s*(?:#.*)?$)|\[(?!.*\]\s*(?:#.*)?$)|\{(?!.*\}\s*(?:#.*)?$))"""
_LINE = r"^[A-Za-z_][A-Za-z0-9_-]*\s*:.*$"


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, modified, size, text, sha256 of every file below ``folder`` whose name fits."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), F.col("content").cast("string").alias("text"), F.sha2("content", 256).alias("sha256"))


def listing(spark: SparkSession, folder: str, pattern: str = "*.[mM][dD]") -> DataFrame:
    """path (below the folder), size, modified of every file; no content is read. Indexes, logs and views are none of them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    own = ~F.regexp_extract("path", r"([^/]*)$", 1).isin(*RESERVED) & ~F.col("path").rlike(f"/({'|'.join(GENERATED)})/[^/]*$")
    return files.where(own).select(F.col("path").alias("address"), relative(folder).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def relative(folder: str) -> Column:
    """A file's path below ``folder``, by the folder's name without its scheme."""
    name = re.sub(r"^[a-z]+:/*(?=/)", "", folder).rstrip("/") + "/"
    return F.expr(f"substring(path, locate({_text(name)}, path) + {len(name)})")


def _text(said: str) -> str:
    """``said`` as a literal of Spark SQL."""
    return "'" + said.replace("\\", "\\\\").replace("'", "\\'") + "'"


def touched(before: DataFrame, listed: DataFrame) -> DataFrame:
    """path, address, status of files that are new, of another size or time, or gone (deleted)."""
    old = before.select("path", F.struct("size", "modified").alias("was"))
    now = listed.select("path", "address", F.struct("size", "modified").alias("now"))
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("was") == F.col("now"), "same").otherwise("changed")
    return old.join(now, "path", "full_outer").select("path", "address", status.alias("status")).where("status <> 'same'")


def changes(before: DataFrame, touched_: DataFrame, read: DataFrame) -> DataFrame:
    """path, doc_id, status: what became of the files that ``touched`` names, now that the new ones were ``read``.

    Files whose content is as it was are ``same``, whatever their time. Where a content is gone from one path and new at
    another the new one is ``moved`` and the old one ``moved_away``; of several the least paths are paired.
    """
    old = before.select("path", F.col("sha256").alias("was"), F.col("doc_id").alias("old_id"))
    new = read.select("path", F.col("sha256").alias("is"), F.col("doc_id").alias("new_id"))
    rows = touched_.select("path", "status").join(old, "path", "left").join(new, "path", "left")
    status = F.when((F.col("status") == "changed") & (F.col("was") == F.col("is")), "same").otherwise(F.col("status"))
    rows = rows.select("path", status.alias("status"), F.coalesce("new_id", "old_id").alias("doc_id"), F.coalesce("is", "was").alias("digest"))
    nth = F.row_number().over(Window.partitionBy("digest", "status").orderBy("path"))
    paired = rows.where("status IN ('added', 'deleted')").withColumn("_nth", nth)
    twins = paired.groupBy("digest", "_nth").agg(F.count("*").alias("_n")).where("_n = 2").drop("_n")
    moved = paired.join(twins, ["digest", "_nth"], "left_semi").select("path", F.lit(True).alias("_moved"))
    renamed = F.when(F.col("_moved") & (F.col("status") == "added"), "moved").when(F.col("_moved"), "moved_away").otherwise(F.col("status"))
    return rows.join(moved, "path", "left").select("path", "doc_id", renamed.alias("status"))


def file_notes(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """Notes of the files ``wanted(path, address)``, with size, modified, sha256 and error; no other file's content is read.

    A note's id is a hash of its path. Title and description are the fields' or else made from the text, as of any note.
    """
    columns = "doc_id long, path string, body string, resource string, timestamp string, description string, title string, tags array<string>, confidence double, size long, modified timestamp, sha256 string, error string"
    few = wanted.select("address").limit(NAMED + 1).collect()
    reader = spark.read.format("binaryFile")
    if len(few) <= NAMED:  # these alone are opened; characters of patterns stand for themselves
        paths = [re.sub(r"([\[\]{}*?\\])", r"\\\1", r["address"]) for r in few]
        mine = reader.load(paths) if paths else reader.schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "/").load(folder)
    else:
        files = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[mM][dD]").load(folder)
        mine = files.join(wanted.select(F.col("address").alias("path")), "path", "left_semi")
    raw = mine.select(relative(folder).alias("path"), F.col("content").cast("string").alias("text"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))
    parsed = raw.withColumn("n", frontmatter(F.col("text")))
    field = lambda name: F.element_at("n.fields", name)
    body = T.text_of("n.body")
    description = F.coalesce(F.nullif(T.text_of(field("description")), F.lit("")), T.summary(body))
    tags = F.filter(F.split(F.regexp_replace(F.coalesce(field("tags"), F.lit("")), r"[\[\]]", ""), r"\s*,\s*"), lambda t: t != "")
    made = parsed.select(
        F.xxhash64("path").alias("doc_id"), "path", body.alias("body"), F.coalesce(field("resource"), F.lit("")).alias("resource"), F.coalesce(F.nullif(T.text_of(field("timestamp")), F.lit("")), F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("timestamp"),
        description.alias("description"), F.coalesce(F.nullif(T.text_of(field("title")), F.lit("")), T.title(description)).alias("title"), tags.alias("tags"),
        F.coalesce(F.expr("try_cast(element_at(n.fields, 'confidence') AS double)"), F.lit(DEFAULT_CONFIDENCE)).alias("confidence"), "size", "modified", "sha256", F.col("n.error").alias("error"),
    )
    return made.select(*[F.col(c.split()[0]) for c in columns.split(", ")])


@F.pandas_udf(StringType())
def _indented(raw: pd.Series) -> pd.Series:
    """JSON documents indented, in their own order; null for what is none."""

    def one(text: str) -> str | None:
        try:
            return json.dumps(json.loads(text), indent=2, ensure_ascii=False)
        except ValueError:
            return None

    return pd.Series([one(x) for x in raw], dtype=object)


def extracted(captures: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Adds source_type, title (of JSON and HTML) and extracted: the readable text of text, Markdown, JSON, CSV and HTML captures."""
    kind = T.source_type(F.col(path))
    raw = T.text_of(text)
    name = F.regexp_extract(F.col(path), r"([^/\\]*)$", 1)
    captures = captures.withColumn("title", F.when(kind == "json", F.coalesce(T.json_title(raw), name)).when(kind.isin("html", "xml"), T.html_title(raw)))
    # Only the JSON captures go to Python: for the others the function sees null.
    readable = F.when(kind == "json", T.json_note(raw, name, _indented(F.when(kind == "json", raw).otherwise("null")))).when(kind == "csv", F.array_join(T.first_lines(raw), "\n")).when(kind.isin("html", "xml"), T.without_markup(raw)).otherwise(T.normalized(raw))
    return captures.withColumn("source_type", kind).withColumn("extracted", readable)


def extracted_media(captures: DataFrame, extractors: dict[str, list[Callable[[bytes], str]]]) -> DataFrame:
    """Adds extracted and failures to (source_type, content): of a type's extractors the first that gives a text counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, failures = [], []
            for kind, content in zip(batch["source_type"], batch["content"], strict=True):
                text, failed = None, []
                for extract in extractors.get(kind, []):
                    try:
                        text = extract(content) or None
                    except Exception as why:  # noqa: BLE001  a failed extractor is data: the next one is tried
                        failed.append(f"{getattr(extract, '__name__', 'extractor')}: {why}")
                    if text:
                        break
                texts.append(text)
                failures.append(failed)
            yield batch.assign(extracted=pd.Series(texts, dtype=object, index=batch.index), failures=pd.Series(failures, dtype=object, index=batch.index))

    return captures.mapInPandas(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in captures.schema), "extracted string", "failures array<string>"]))


def frontmatter(raw: Column) -> Column:
    """A note file's fields (a map of its "key: value" lines), body, and what is wrong with its frontmatter."""
    # Lists, nested fields and text over several lines become one line of their field.
    front = F.regexp_replace(F.regexp_extract(raw, _PARTS, 1), r"\n[ \t]*-[ \t]+", ", ")
    front = F.regexp_replace(F.regexp_replace(front, r"\n[ \t]+(?=[A-Za-z_][A-Za-z0-9_-]*\s*:)", "; "), r"\n[ \t]+(?=\S)", " ")
    lines = F.filter(F.split(front, "\n"), lambda x: ~x.rlike(r"^\s*(#.*)?$"))
    known = F.filter(lines, lambda x: x.rlike(_LINE))
    clean = lambda v: F.regexp_replace(F.regexp_replace(T.trimmed(v), r"^([,;]|[|>][-+]?(?=\s))\s*", ""), "^[\"'](.*)[\"']$", "$1")
    pair = lambda x: F.struct(T.trimmed(F.regexp_extract(x, "^([^:]*):", 1)).alias("key"), clean(F.regexp_extract(x, "^[^:]*:(.*)$", 1)).alias("value"))
    pairs = F.transform(known, pair)
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs) + 1), lambda q: q["key"] == p["key"]))
    has = raw.rlike(_PARTS)
    nested = F.exists(lines, lambda x: ~x.rlike(_LINE) & ~x.rlike(r"^\s+\S|^\s*-\s"))
    unclosed = F.exists(known, lambda x: T.trimmed(F.regexp_extract(x, "^[^:]*:(.*)$", 1)).rlike(_UNCLOSED))
    return F.struct(
        F.when(has, F.map_from_entries(last)).alias("fields"),
        F.when(has, F.regexp_extract(raw, _PARTS, 2)).otherwise(raw).alias("body"),
        F.when(~has, "missing_frontmatter").when(nested | unclosed, "invalid_frontmatter").alias("error"),
    )


#: Files that exports write beside the notes, and folders of views that the library writes itself.
RESERVED, GENERATED = ("index.md", "log.md"), ("actions",)


def read_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Notes of a folder of Markdown files: path, title, type, tags, body, error, size, modified, sha256, once for each path.

    Indexes, logs and views that are made from notes are none.
    """
    files = read_files(spark, folder, "*.[mM][dD]").dropDuplicates(["path"])
    own = ~F.regexp_extract("path", r"([^/]*)$", 1).isin(*RESERVED) & ~F.col("path").rlike(f"/({'|'.join(GENERATED)})/[^/]*$")
    files = files.where(own).withColumn("n", frontmatter(F.col("text")))
    field = lambda name: F.element_at("n.fields", name)
    tags = F.filter(F.split(F.regexp_replace(F.coalesce(field("tags"), F.lit("")), r"[\[\]]", ""), r"\s*,\s*"), lambda t: t != "")
    return files.select("path", F.coalesce(field("title"), F.lit("Untitled note")).alias("title"), field("type").alias("type"), tags.alias("tags"), F.col("n.body").alias("body"), F.col("n.error").alias("error"), "size", "modified", "sha256")
