"""Queries over single texts, pages and notes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.functions import text as T
from notelake.operators import notes as N
from notelake.session import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("text", T.text_of("text"))


def tokenize_docs(spark, sf_dir):
    t = _docs(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5"))


def sentence_split(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))


def doc_summary(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.summary(F.col("text")).alias("summary"))


def doc_title(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.title(T.summary(F.col("text"))).alias("title"))


def doc_slug(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", "text", T.title(T.summary(F.col("text"))).alias("title"))
    return d.select("doc_id", T.slug(F.col("title"), F.col("text")).alias("slug"))


def doc_keywords(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return N.keyword_ranks(d, "doc_id", "text").where("rank <= 8").select("doc_id", "token", "n", F.col("rank").cast("long").alias("rank"))


def ambiguous_docs(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.length(T.normalized(F.col("text"))).cast("long").alias("chars"), T.is_ambiguous(F.col("text")).alias("ambiguous"), F.size(T.open_questions(F.col("text"))).cast("long").alias("open_questions"))


def notes_of(spark, sf_dir):
    """The notes of all documents; their keywords are counted where they are read, unless ids repeat."""
    documents = table(spark, sf_dir, "documents")
    return N.build_notes(N.from_documents(documents), apart=N.each_once(documents, "doc_id"))


def note_tags(spark, sf_dir):
    notes = notes_of(spark, sf_dir)
    return notes.select("doc_id", "path", F.array_join("tags", ",").alias("tags"))


def note_sections(spark, sf_dir):
    """The claims, open questions and related keywords of each note."""
    n = N.with_sections(_docs(spark, sf_dir), "doc_id", "text")
    return n.select("doc_id", F.size("claims").cast("long").alias("n_claims"), F.md5(F.array_join("claims", "|").cast("binary")).alias("claims_md5"), F.size("open_questions").cast("long").alias("n_questions"), F.array_join("related", ",").alias("related"))


def normalize_id(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.normalized_id(F.col("url")).alias("id"))


def html_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.without_markup(T.text_of("html")).alias("text"))


def html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_title(T.text_of("html")).alias("title"))


def json_flatten(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.json_text(F.col("props")).alias("text"))


def json_salvage(spark, sf_dir):
    """The properties of events found again in what a tool might print around them."""
    said = F.concat(F.lit("warning {1}\n"), "event_type", F.lit(" "), "props", F.lit(" done\n"))
    found = table(spark, sf_dir, "events").select("event_id", T.salvaged_json(said).alias("found"))
    return found.select("event_id", "found", T.json_text(F.col("found")).alias("text"))


def csv_head(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", T.first_lines(F.col("text")).alias("lines"))
    return d.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.array_join("lines", "\n").alias("head"))


def source_type_detect(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.extension(F.col("url")).alias("extension"), T.source_type(F.col("url")).alias("source_type"), T.resource_type(F.col("url")).alias("resource_type"))


def conversation_notes(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("said"))
    body = F.array_join(F.transform("said", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n")
    notes = turns.select("conv_id", "turns", body.alias("body"))
    return notes.select("conv_id", "turns", T.title(T.summary(F.col("body"))).alias("title"), F.md5(F.col("body").cast("binary")).alias("body_md5"))


def notes_ordered(spark, sf_dir):
    notes = N.from_documents(table(spark, sf_dir, "documents")).select("doc_id", "path", "timestamp")
    return N.numbered(notes, [F.desc("timestamp"), F.col("path")], "ord").select("doc_id", "path", "timestamp", "ord")


def generation_digest(spark, sf_dir):
    return N.generation(N.from_documents(table(spark, sf_dir, "documents")))


def _labelled(spark, sf_dir):
    """Documents with what the labels say of them: two states of a corpus, before and after a review."""
    return _docs(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")


def freshness_diff(spark, sf_dir):
    d = _labelled(spark, sf_dir).withColumn("size", F.octet_length("text").cast("long"))
    before = d.where("quality is null or quality = 1").select("doc_id", "size")
    after = d.where("toxic is null or toxic = 0").select("doc_id", F.when(F.col("quality") == 1, F.col("size") + 1).otherwise(F.col("size")).alias("size"))
    return N.freshness(before, after, "doc_id", ["size"])


def incremental_upsert(spark, sf_dir):
    base = _docs(spark, sf_dir).select("doc_id", F.lit("unreviewed").alias("state"), F.md5(F.col("text").cast("binary")).alias("body_md5"))
    delta = _labelled(spark, sf_dir).where("quality is not null").select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("poor").alias("state"), F.md5(F.concat("text", F.lit("\nreviewed")).cast("binary")).alias("body_md5"))
    return N.upsert(base, delta, "doc_id")


def chunked(spark, sf_dir):
    """doc_id, chunk_no, chunk: every note's chunks, number 0 of its title, description and tags."""
    notes = notes_of(spark, sf_dir)
    c = notes.select("doc_id", F.explode(T.note_chunks(F.col("title"), F.col("description"), F.col("tags"), F.col("body"))).alias("c"))
    return c.select("doc_id", F.col("c.chunk_no").cast("long").alias("chunk_no"), F.col("c.chunk").alias("chunk")).where("chunk is not null")


def chunk_notes(spark, sf_dir):
    c = chunked(spark, sf_dir)
    return c.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.length("chunk").cast("long").alias("chars"), F.sha2(F.col("chunk").cast("binary"), 256).alias("content_hash"))


def link_rewrite(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", T.linked_as_markdown(F.concat(F.lit("[["), "source", F.lit("|"), "lang", F.lit("]] [["), "source", F.lit("]] "), "text")).alias("text"))
    return d.select("doc_id", F.substring("text", 1, 60).alias("start"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


QUERIES = {f.__name__: f for f in (
    tokenize_docs, sentence_split, doc_summary, doc_title, doc_slug, doc_keywords, ambiguous_docs, note_tags, note_sections, normalize_id,
    html_extract, html_title, json_flatten, json_salvage, csv_head, source_type_detect, conversation_notes, notes_ordered,
    generation_digest, freshness_diff, incremental_upsert, chunk_notes, link_rewrite,
)}

# Pieces of SQL.
_STOP = ", ".join(f"'{w}'" for w in T.KEYWORD_STOP_WORDS)
TOKENS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"


def norm(c: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({c}, '\\r\\n', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"


def sents(c: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace({norm(c)}, '([.!?。！？])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"


DOCS = "SELECT doc_id, COALESCE(text, '') AS text, lang, source FROM documents"
SUMMARY = f"""d0 AS ({DOCS}), d1 AS (SELECT *, {sents('text')} AS ss FROM d0),
d2 AS (SELECT *, COALESCE(list_filter(ss, lambda s: length(s) >= 40)[1], ss[1], substr(text, 1, 180)) AS f FROM d1),
d3 AS (SELECT doc_id, text, lang, source, CASE WHEN length(f) > 220 THEN substr(f, 1, 217) || '...' ELSE f END AS summary FROM d2)"""


def titled(c: str) -> str:
    words = f"list_filter(regexp_split_to_array(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}\\s\\-]', '', 'g'), '\\s+'), lambda w: w <> '')"
    return f"COALESCE(NULLIF(array_to_string(list_slice({words}, 1, 8), ' '), ''), 'Untitled note')"


TITLED = f"{SUMMARY}, d4 AS (SELECT *, {titled('summary')} AS title FROM d3)"
KEYWORDS = f"""w AS (SELECT doc_id, t.token AS token, t.pos AS pos FROM (SELECT doc_id, unnest(list_transform({TOKENS.format('text')}, lambda x, i: {{'token': x, 'pos': i}})) AS t FROM ({DOCS}))),
wc AS (SELECT doc_id, token, COUNT(*) AS n, MIN(pos) AS first FROM w WHERE length(token) >= 3 AND token NOT IN ({_STOP}) GROUP BY ALL),
wr AS (SELECT doc_id, token, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM wc)"""


def unmarked(c: str) -> str:
    for pattern, by, flags in (("<script[\\s\\S]*?</script>", " ", "gi"), ("<style[\\s\\S]*?</style>", " ", "gi"), ("</?[^>]+>", " ", "g")):
        c = f"regexp_replace({c}, '{pattern}', '{by}', '{flags}')"
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        c = f"replace({c}, '{a}', '{b}')"
    return norm(c)


_EXT = "lower(regexp_extract(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/\\\\]*)$', 1), '\\.([A-Za-z0-9]+)$', 1))"
_STATES = "s AS (SELECT d.doc_id, COALESCE(text, '') AS text, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id))"


def id_in_path(c: str) -> str:
    text = f"replace(CAST({c} AS VARCHAR), '-', 'm')"
    return f"CASE WHEN length({text}) < 8 THEN lpad({text}, 8, '0') ELSE {text} END"


PATH = f"'concepts/doc-' || {id_in_path('doc_id')} || '.md'"
HEADS = """hk AS (SELECT doc_id, list(token ORDER BY rank) AS words FROM wr WHERE rank <= 5 GROUP BY doc_id),
hg AS (SELECT d4.doc_id, title, summary, list_concat(list_filter([lang, source], lambda x: x IS NOT NULL), COALESCE(words, [])) AS t FROM d4 LEFT JOIN hk USING (doc_id)),
hd AS (SELECT doc_id, title || chr(10) || summary || chr(10) || array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), ' ') AS head FROM hg)"""
CHUNKS = f"""{TITLED}, {KEYWORDS}, {HEADS}, cb AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS body FROM ({DOCS})),
cc AS (SELECT doc_id, i + 1 AS chunk_no, substr(body, CAST(i * {T.CHUNK_CHARS} + 1 AS BIGINT), {T.CHUNK_CHARS}) AS chunk FROM (SELECT doc_id, body, unnest(range(0, CAST(ceil(length(body) / {T.CHUNK_CHARS}.0) AS BIGINT))) AS i FROM cb)
 UNION ALL SELECT doc_id, 0, head FROM hd WHERE regexp_matches(head, '\\S'))"""

SQL = {
    "tokenize_docs": f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {TOKENS.format('text')} AS t FROM ({DOCS}))",
    "sentence_split": f"SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, ss[i] AS sentence FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM (SELECT doc_id, {sents('text')} AS ss FROM ({DOCS})))",
    "doc_summary": f"WITH {SUMMARY} SELECT doc_id, summary FROM d3",
    "doc_title": f"WITH {TITLED} SELECT doc_id, title FROM d4",
    "doc_slug": f"WITH {TITLED} SELECT doc_id, COALESCE(NULLIF(substr(regexp_replace(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 70), ''), 'note') || '-' || substr(sha1(title || chr(10) || text), 1, 8) AS slug FROM d4",
    "doc_keywords": f"WITH {KEYWORDS} SELECT doc_id, token, n, rank FROM wr WHERE rank <= 8",
    "ambiguous_docs": f"SELECT doc_id, CAST(length({norm('text')}) AS BIGINT) AS chars, length({norm('text')}) < 80 OR {norm('text')} IN ({', '.join(repr(w) for w in T.AMBIGUOUS_WORDS)}) AS ambiguous, CAST(least(5, len(list_filter({sents('text')}, lambda q: regexp_matches(q, '[?？]$')))) AS BIGINT) AS open_questions FROM ({DOCS})",
    "note_tags": f"WITH {KEYWORDS}, k AS (SELECT doc_id, list(token ORDER BY rank) AS words FROM wr WHERE rank <= 5 GROUP BY doc_id), g AS (SELECT d.doc_id, list_concat(list_filter([lang, source], lambda x: x IS NOT NULL), COALESCE(words, [])) AS t FROM documents d LEFT JOIN k USING (doc_id)) SELECT doc_id, {PATH} AS path, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), ',') AS tags FROM g",
    "note_sections": f"WITH {KEYWORDS}, k AS (SELECT doc_id, string_agg(token, ',' ORDER BY rank) AS related FROM wr WHERE rank <= 8 GROUP BY doc_id), s AS (SELECT doc_id, {sents('text')} AS ss FROM ({DOCS})) SELECT doc_id, CAST(LEAST(5, len(ss)) AS BIGINT) AS n_claims, md5(array_to_string(list_slice(ss, 1, 5), '|')) AS claims_md5, CAST(LEAST(5, len(list_filter(ss, lambda q: regexp_matches(q, '[?？]$')))) AS BIGINT) AS n_questions, COALESCE(related, '') AS related FROM s LEFT JOIN k USING (doc_id)",
    "normalize_id": "SELECT page_id, COALESCE(NULLIF(substr(regexp_replace(regexp_replace(lower(url), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 96), ''), 'unknown') AS id FROM pages",
    "html_extract": f"SELECT page_id, {unmarked(chr(67) + 'OALESCE(html, ' + chr(39) * 2 + ')')} AS text FROM pages",
    "html_title": f"SELECT page_id, CASE WHEN regexp_matches(html, '(?i)<title[^>]*>[\\s\\S]*?</title>') THEN {unmarked('regexp_extract(html, ' + chr(39) + '(?i)<title[^>]*>([' + chr(92) + 's' + chr(92) + 'S]*?)</title>' + chr(39) + ', 1)')} END AS title FROM pages",
    "json_flatten": "SELECT event_id, array_to_string(list_transform(json_keys(props), lambda k: k || ': ' || regexp_replace(COALESCE(json_extract_string(props, '$.' || k), 'null'), '[.。]+$', '')), '. ') AS text FROM events",
    "json_salvage": "SELECT event_id, props AS found, array_to_string(list_transform(json_keys(props), lambda k: k || ': ' || regexp_replace(COALESCE(json_extract_string(props, '$.' || k), 'null'), '[.。]+$', '')), '. ') AS text FROM events",
    "csv_head": f"SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, array_to_string(l, chr(10)) AS head FROM (SELECT doc_id, list_slice(list_filter(string_split({norm('text')}, chr(10)), lambda x: x <> ''), 1, 40) AS l FROM ({DOCS}))",
    "source_type_detect": f"SELECT page_id, {_EXT} AS extension, CASE {_EXT} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.SOURCE_TYPES.items()) + f" ELSE 'text' END AS source_type, CASE WHEN {_EXT} IN ('mp4', 'mov', 'mkv') THEN 'video' WHEN {_EXT} IN ('mp3', 'wav', 'm4a') THEN 'audio' WHEN {_EXT} IN ('png', 'jpg', 'jpeg', 'webp') THEN 'image' WHEN {_EXT} = 'pdf' THEN 'pdf' WHEN regexp_matches(url, '(?i)^https?:') THEN 'url' ELSE 'unknown' END AS resource_type FROM pages",
    "conversation_notes": f"WITH c AS (SELECT conv_id, COUNT(*) AS turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS body FROM conversations GROUP BY conv_id), s AS (SELECT *, {sents('body')} AS ss FROM c), f AS (SELECT *, COALESCE(list_filter(ss, lambda s: length(s) >= 40)[1], ss[1], substr(body, 1, 180)) AS f FROM s), g AS (SELECT *, CASE WHEN length(f) > 220 THEN substr(f, 1, 217) || '...' ELSE f END AS summary FROM f) SELECT conv_id, turns, {titled('summary')} AS title, md5(body) AS body_md5 FROM g",
    "notes_ordered": f"WITH n AS (SELECT doc_id, {PATH} AS path, strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(GREATEST(LEAST(doc_id, {N.LATEST}), {N.EARLIEST})), '%Y-%m-%dT%H:%M:%S.000Z') AS timestamp FROM documents) SELECT *, row_number() OVER (ORDER BY timestamp DESC, path) - 1 AS ord FROM n",
    "generation_digest": f"WITH n AS (SELECT {PATH} AS path, COALESCE(text, '') AS body FROM documents), l AS (SELECT substr(sha1(path), 1, 3) AS bucket, path || chr(10) || sha256(body) AS line FROM n), p AS (SELECT bucket, COUNT(*) AS n, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest FROM l GROUP BY bucket) SELECT CAST(SUM(n) AS BIGINT) AS notes, sha256(string_agg(digest, chr(10) ORDER BY bucket)) AS generation FROM p",
    "freshness_diff": f"WITH {_STATES}, a AS (SELECT doc_id, strlen(text) AS size FROM s WHERE quality IS NULL OR quality = 1), b AS (SELECT doc_id, strlen(text) + CASE WHEN quality = 1 THEN 1 ELSE 0 END AS size FROM s WHERE toxic IS NULL OR toxic = 0) SELECT doc_id, CASE WHEN a.size IS NULL THEN 'added' WHEN b.size IS NULL THEN 'deleted' WHEN a.size = b.size THEN 'same' ELSE 'changed' END AS status FROM a FULL JOIN b USING (doc_id)",
    "incremental_upsert": f"WITH {_STATES} SELECT doc_id, CASE WHEN quality IS NULL THEN 'unreviewed' WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'poor' END AS state, md5(CASE WHEN quality IS NULL THEN text ELSE text || chr(10) || 'reviewed' END) AS body_md5 FROM s",
    "chunk_notes": f"WITH {CHUNKS} SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, CAST(length(chunk) AS BIGINT) AS chars, sha256(chunk) AS content_hash FROM cc",
    "link_rewrite": f"SELECT doc_id, substr(t, 1, 60) AS start, md5(t) AS text_md5 FROM (SELECT doc_id, '[' || lang || '](' || source || '.md) [' || source || '](' || source || '.md) ' || text AS t FROM ({DOCS}))",
}
