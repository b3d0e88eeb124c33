"""Queries that go through sources, streams and exports. With their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.functions import text as T
from notelake.operators import export as E
from notelake.operators import notes as N
from notelake.plans.store import Store, materialise, shared_folder
from notelake.queries.texts import PATH, TITLED
from notelake.session import table
from notelake.sources import captures
from notelake.sources.captures import frontmatter
from notelake.streaming.ingest import ingest_documents


def stream_ingest(spark, sf_dir):
    """All documents, streamed into notes and upserted by id."""

    def noted(batch):
        return N.with_description(N.from_documents(batch)).select("doc_id", "path", "title", F.md5(F.col("body").cast("binary")).alias("body_md5"))

    return ingest_documents(spark, f"{sf_dir}/documents.parquet", noted, "doc_id")


def note_round_trip(spark, sf_dir):
    """Notes rendered as Markdown files and parsed again."""
    notes = N.with_description(N.from_documents(table(spark, sf_dir, "documents"))).withColumn("tags", F.col("given_tags"))
    files = notes.select("doc_id", E.rendered_note().alias("raw")).withColumn("n", frontmatter(F.col("raw")))
    return files.select("doc_id", F.element_at("n.fields", "title").alias("title"), F.element_at("n.fields", "type").alias("type"), F.md5(F.regexp_replace("n.body", r"\A\n", "").cast("binary")).alias("body_md5"), T.text_of("n.error").alias("error"))


def _states(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The documents in two states: before, those not reviewed as poor; after, without toxic ones, good ones edited, poor ones put in an
    archive, those of ids that 7 divides moved there as they were, and all that were reviewed written anew."""
    d = N.from_documents(table(spark, sf_dir, "documents")).join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    good, poor = F.col("quality") == 1, F.col("quality") == 0
    archived = F.concat(F.lit("archive/"), F.substring_index("path", "/", -1))
    file = lambda path, body, time: [path.alias("path"), F.octet_length(body).cast("long").alias("size"), time.alias("modified"), F.sha2(body.cast("binary"), 256).alias("sha256"), "doc_id"]
    day = lambda n: F.lit(f"2024-05-0{n} 00:00:00").cast("timestamp")
    before = d.where(~F.coalesce(poor, F.lit(False))).select(*file(F.col("path"), F.col("body"), day(1)))
    moved = F.coalesce(poor, F.lit(False)) | (F.col("doc_id") % 7 == 0)
    edited = F.when(F.coalesce(good, F.lit(False)) & (F.col("doc_id") % 7 != 0), F.concat("body", F.lit("\nreviewed"))).otherwise(F.col("body"))
    after = d.where(~F.coalesce(F.col("toxic") == 1, F.lit(False))).select(*file(F.when(moved, archived).otherwise(F.col("path")), edited, F.when(F.col("quality").isNull(), day(1)).otherwise(day(2))))
    return before, after


def folder_changes(spark, sf_dir):
    """What became of each file of a folder between two listings: by size and time first, then by content, with moves."""
    before, after = (materialise(x, "state") for x in _states(spark, sf_dir))
    touched = materialise(captures.touched(before, after.withColumn("address", F.col("path"))), "touched")
    read = after.join(touched.where("status <> 'deleted'").select("path"), "path", "left_semi")
    return captures.changes(before, touched, read)


def tree_differences(spark, sf_dir):
    """The same two states by their digest trees: only subtrees that differ are walked."""
    sides = [N.digests(x.withColumn("body", F.col("sha256"))) for x in _states(spark, sf_dir)]
    sides = [materialise(x, "digests") for x in sides]
    depth = N.tree_depth(sides[0].count())
    trees = [materialise(N.digest_tree(x, depth), "tree") for x in sides]
    return N.tree_differences(*trees, *sides)


def stale_signals(spark, sf_dir):
    """Which tables are behind the notes, and by how many: unlabelled notes come first, then good ones, then poor ones; the postings
    were made before the poor ones came, the vectors after, and the graph at the start."""
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    store = Store(spark, shared_folder(spark, "library"))
    steps = [d.where(F.coalesce("quality", F.lit(-1)) == q).select("doc_id") for q in (-1, 1, 0)]
    for rows in steps:
        version = store.append("notes", rows)
        for name, known in (("postings", 2), ("vectors", 3)):
            if version <= known:
                store.append(name, rows, covers=version)
        if version == 1:
            store.append("graph", rows, whole=True, covers=version)
    notes = store.rows("notes", "doc_id")
    out = None
    for name in ("postings", "vectors", "graph"):
        missing = notes.join(store.rows(name, "doc_id"), "doc_id", "left_anti")
        part = missing.agg(F.lit(name).alias("name"), F.lit(store.behind(name, "notes")).alias("behind"), F.count("*").alias("missing"))
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {f.__name__: f for f in (stream_ingest, note_round_trip, folder_changes, tree_differences, stale_signals)}

_STATES = f"""st AS (SELECT doc_id, {PATH} AS path, 'archive/' || regexp_extract({PATH}, '[^/]*$') AS archived, COALESCE(text, '') AS body, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)),
fa AS (SELECT path, doc_id, strlen(body) AS size, 1 AS day, sha256(body) AS digest FROM st WHERE quality IS NULL OR quality <> 0),
fb0 AS (SELECT doc_id, CASE WHEN quality = 0 OR doc_id % 7 = 0 THEN archived ELSE path END AS path, CASE WHEN quality = 1 AND doc_id % 7 <> 0 THEN body || chr(10) || 'reviewed' ELSE body END AS body, CASE WHEN quality IS NULL THEN 1 ELSE 2 END AS day FROM st WHERE toxic IS NULL OR toxic <> 1),
fb AS (SELECT path, doc_id, strlen(body) AS size, day, sha256(body) AS digest FROM fb0)"""

SQL = {
    "stream_ingest": f"WITH {TITLED} SELECT doc_id, {PATH} AS path, title, md5(text) AS body_md5 FROM d4",
    "folder_changes": f"""WITH {_STATES}, j AS (SELECT COALESCE(b.path, a.path) AS path, COALESCE(b.doc_id, a.doc_id) AS doc_id, COALESCE(b.digest, a.digest) AS digest,
 CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' WHEN a.digest = b.digest THEN 'same' ELSE 'changed' END AS status FROM fa a FULL JOIN fb b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.size <> b.size OR a.day <> b.day),
r AS (SELECT *, row_number() OVER (PARTITION BY digest, status ORDER BY path) AS nth FROM j), m AS (SELECT digest, nth FROM r WHERE status IN ('added', 'deleted') GROUP BY ALL HAVING COUNT(*) = 2)
SELECT path, doc_id, CASE WHEN m.nth IS NOT NULL AND status = 'added' THEN 'moved' WHEN m.nth IS NOT NULL AND status = 'deleted' THEN 'moved_away' ELSE status END AS status FROM r LEFT JOIN m USING (digest, nth)""",
    "tree_differences": f"WITH {_STATES} SELECT COALESCE(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' ELSE 'changed' END AS status FROM fa a FULL JOIN fb b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.digest <> b.digest",
    "stale_signals": "WITH d AS (SELECT quality FROM documents LEFT JOIN labels USING (doc_id)), c AS (SELECT COUNT(*) FILTER (WHERE quality = 1) AS good, COUNT(*) FILTER (WHERE quality = 0) AS poor FROM d) SELECT 'postings' AS name, true AS behind, poor AS missing FROM c UNION ALL SELECT 'vectors', false, 0 FROM c UNION ALL SELECT 'graph', true, good + poor FROM c",
    "note_round_trip": f"WITH {TITLED} SELECT doc_id, title, 'Concept' AS type, md5(text) AS body_md5, '' AS error FROM d4",
}
