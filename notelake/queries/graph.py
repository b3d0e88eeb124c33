"""Queries over the graph of notes, its actions, queue, validation and views. With their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notelake.functions import text as T
from notelake.operators import export
from notelake.operators import graph as G
from notelake.operators import notes as N
from notelake.operators import recall as R
from notelake.plans.store import materialise
from notelake.queries.texts import DOCS, KEYWORDS, PATH, TITLED, TOKENS, id_in_path, notes_of
from notelake.session import table

#: The dictionary of domains for prose of made-up syllables, where no term of the library's own dictionary occurs.
PROSE_DOMAINS = {"english": ("tion", "thing"), "french": ("ment", "eau"), "german": ("keit", "ung"), "spanish": ("ción", "osa")}
AT = "2024-06-01T00:00:00.000Z"
CANVAS = 2_000


def notes(spark, sf_dir) -> DataFrame:
    return notes_of(spark, sf_dir)


def analysed(spark, sf_dir) -> DataFrame:
    return materialise(G.analyse(notes(spark, sf_dir), PROSE_DOMAINS), "analysis")


def extract_entities(spark, sf_dir):
    e = analysed(spark, sf_dir).select("doc_id", F.posexplode("entities").alias("nth", "e"))
    return e.select("doc_id", F.col("nth").cast("long").alias("nth"), "e.id", "e.name", "e.kind")


def detect_domains(spark, sf_dir):
    return analysed(spark, sf_dir).select("doc_id", F.array_join("domains", ",").alias("domains"))


def graph_objects(spark, sf_dir):
    return G.objects(analysed(spark, sf_dir)).select("id", "type", "name", "confidence")


def structural_links(spark, sf_dir):
    return G.structural_links(analysed(spark, sf_dir)).select("type", "from_id", "to_id", "confidence")


def link_dedupe(spark, sf_dir):
    links = G.structural_links(analysed(spark, sf_dir))
    return links.groupBy("type").agg(F.count("*").alias("links"), F.count_distinct("to_id").alias("targets"), F.max("confidence").alias("confidence"))


def candidate_pairs(spark, sf_dir):
    return G.candidate_pairs(analysed(spark, sf_dir)).withColumn("nth", F.col("nth").cast("long"))


def pair_scores(spark, sf_dir):
    return G.scored_pairs(analysed(spark, sf_dir))


def capped_links(spark, sf_dir):
    return G.capped_links(pair_scores(spark, sf_dir))


def entity_hotspots(spark, sf_dir):
    return G.hotspots(G.structural_links(analysed(spark, sf_dir)), 12)


def suggest_actions(spark, sf_dir):
    a = analysed(spark, sf_dir)
    return _suggested(a, G.ACTIONS).select("id", "type", F.array_join("targets", ",").alias("targets"), "description", "confidence")


def recall_postings(spark, sf_dir):
    return G.recall_postings(analysed(spark, sf_dir))


def graph_top(spark, sf_dir, k: int):
    asked, a = R.query_tokens(table(spark, sf_dir, "benchmark"), "item_id", "text"), analysed(spark, sf_dir)
    if (matrix := R.Asked.of(asked, "item_id", a, "doc_id")) is not None:
        return R.token_scores(G.words_said(a), matrix, "doc_id", "item_id", k, newest=True)
    scores = G.recall_postings(a).join(R.small(asked), "token").groupBy("item_id", "doc_id").agg(F.sum(F.col("n") * F.col("times")).alias("score"))
    return R.best(scores, "item_id", [F.desc("score"), F.desc("doc_id")], k)


def graph_recall(spark, sf_dir):
    return graph_top(spark, sf_dir, 5)


def _suggested(a, n: int) -> DataFrame:
    """What the graph of analysed notes suggests: of its similarity links only those are made that merges come from."""
    return materialise(G.actions(a, G.structural_links(a), G.first_merges(a, G.ACTIONS), n), "actions")


def _previous(spark, sf_dir, a):
    """The suggestions that the labelled part of the corpus gives, in states that their ids decide."""
    labelled = R.small(table(spark, sf_dir, "labels").select("doc_id").distinct(), R.ID_ROWS)
    old = _suggested(materialise(a.join(labelled, "doc_id", "left_semi"), "labelled"), 500)
    digit = F.conv(F.substring("id", -1, 1), 16, 10).cast("int")
    status = F.when(digit < 4, "proposed").when(digit < 7, "accepted").when(digit < 9, "in_progress").when(digit < 12, "done").when(digit < 14, "dismissed").otherwise("archived")
    states = {"status": status, "stale": digit == 15, "archived_reason": F.when(digit >= 14, "manual_update"), "updated_at": F.lit("2024-05-01T00:00:00.000Z"), "history": F.array().cast("array<struct<at:string,from:string,to:string,note:string>>")}
    return old.withColumns(states)


def _queue(spark, sf_dir):
    a = analysed(spark, sf_dir)
    return G.reconcile(_suggested(a, 500), _previous(spark, sf_dir, a), AT)


def queue_reconcile(spark, sf_dir):
    return _queue(spark, sf_dir).select("id", "type", "status", "stale", "archived_reason", "priority", "updated_at")


def queue_summary(spark, sf_dir):
    statuses = F.array(*[F.struct(F.lit(s).alias("status"), F.lit(s in G.STATUSES[:3]).alias("active")) for s in G.STATUSES])
    queue = _queue(spark, sf_dir)
    every = spark.range(1).select(F.explode(statuses).alias("s")).select("s.status", "s.active")
    counts = every.join(queue.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", "active", F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum(F.when(F.col("active"), F.col("n")).otherwise(0)).over(Window.partitionBy(F.lit(1)))  # six rows
    return counts.withColumn("active_total", total)


def queue_list(spark, sf_dir):
    """The first twenty actions of the queue."""
    top = _queue(spark, sf_dir).orderBy(*G.queue_order()).limit(20)
    return top.select("id", "status", "priority", "type")


def queue_status_update(spark, sf_dir):
    """Proposed actions of medium priority are accepted, accepted ones done."""
    queue = G.with_status(_queue(spark, sf_dir), F.col("status") == "accepted", "done", AT, "reviewed")
    queue = G.with_status(queue, (F.col("status") == "proposed") & (F.col("priority") == "medium"), "accepted", AT, "")
    return queue.select("id", "status", "updated_at", F.size("history").cast("long").alias("changes"), F.coalesce(F.get("history", F.lit(0))["from"], F.lit("")).alias("changed_from"))


def graph_issues(spark, sf_dir):
    """The graph of all notes, broken at one object, link and action in some dozens, in each of the ways there are."""
    a = analysed(spark, sf_dir)
    k = F.when(F.col("type") == "Concept", F.regexp_extract("id", r"(\d+)-md$", 1).cast("long") % 50).otherwise(-1)
    unsure = F.map_concat(F.map_filter("properties", lambda key, _: key != "confidence"), F.create_map(F.lit("confidence"), F.lit("1.5")))
    objects = G.objects(a).withColumn("k", k).select(
        "k", F.when(F.col("k") == 1, " ").when(F.col("k") != 6, F.col("id")).alias("id"), F.when(F.col("k") == 2, "Thing").when(F.col("k") != 6, F.col("type")).alias("type"),
        F.when(F.col("k") == 4, unsure).when(~F.col("k").isin(3, 6), F.col("properties")).alias("properties"),
    )
    objects = materialise(objects.unionByName(objects.where("k = 5")).drop("k"), "broken-objects")
    l = F.col("doc_id") % 40  # noqa: E741
    links = G.structural_links(a).select(
        F.when(l == 1, "odd").when(l != 7, F.col("type")).alias("type"), F.when(l == 2, "concept:none").when(l == 4, F.col("to_id")).when(l != 7, F.col("from_id")).alias("from_id"),
        F.when(l == 3, "tag:none").when(l == 4, F.col("from_id")).when(l != 7, F.col("to_id")).alias("to_id"), F.when(l == 5, 1.3).otherwise(F.col("confidence")).alias("confidence"), F.when(l != 6, F.array("from_id")).alias("evidence"),
    )
    d = F.substring("id", -1, 1)
    actions = G.actions(a, G.structural_links(a), None, 500).select(
        "id", F.when(d == "0", "odd").when(d != "7", F.col("type")).alias("type"),
        F.when(d == "2", F.array().cast("array<string>")).when(d == "3", F.array(F.lit("entity:none"))).when(d == "6", F.array(F.lit("tag:en"))).when(~d.isin("1", "7"), F.col("targets")).alias("targets"),
        F.when(d == "4", " ").when(d != "7", F.col("description")).alias("description"), F.when(d == "5", 2.0).otherwise(F.col("confidence")).alias("confidence"),
    )
    return G.graph_issues(objects, links, actions)


def queue_issues(spark, sf_dir):
    """Current and previous suggestions put together unreconciled, and broken in each of the ways there are."""
    a = analysed(spark, sf_dir)
    current = _suggested(a, 500)
    now = current.withColumns({"status": F.lit("proposed"), "created_at": F.lit(AT), "stale": F.lit(False)})
    columns = ["id", "type", "targets", "description", "confidence", "status", "created_at", "stale"]
    old = _previous(spark, sf_dir, a).withColumn("stale", F.col("status") == "archived").withColumn("created_at", F.col("updated_at"))
    both = now.select(columns).unionByName(old.select(columns)).withColumn("priority", G.priority(F.col("confidence"))).withColumn("updated_at", F.col("created_at"))
    d = F.substring("id", -2, 1)
    broken = {"type": (F.lit(""), "1"), "status": (F.lit("odd"), "2"), "priority": (F.lit("x"), "3"), "targets": (F.lit(None).cast("array<string>"), "4"), "confidence": (F.lit(-1.0), "5"), "description": (F.lit(""), "6"), "created_at": (F.lit(" "), "7"), "updated_at": (F.lit(None).cast("string"), "8"), "id": (F.lit(""), "0")}
    lost = F.col("d") == "9"
    queue = both.withColumn("d", d).select("stale", *[F.when(F.col("d") == x, v).when(~lost if c in ("id", "type", "status") else F.lit(True), F.col(c)).alias(c) for c, (v, x) in broken.items()])
    return G.queue_issues(materialise(queue, "broken-queue"), G.objects(a.where(F.length("description") >= 40)), current)


def note_files(spark, sf_dir) -> DataFrame:
    """Notes as Markdown files: the labelled ones with frontmatter (toxic ones without a type, poor ones with a wiki link, one in nine malformed), others bare."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    kind = F.when(F.col("toxic") == 1, "").otherwise(F.lit("type: Concept\n"))
    link = F.when(F.col("quality") == 0, F.concat(F.lit("[["), "source", F.lit("]] "))).otherwise("")
    odd = F.when(F.col("doc_id") % 9 == 0, "\"unclosed\n").otherwise("")
    front = F.concat(F.lit("---\n"), kind, odd, F.lit("lang: "), "lang", F.lit("\n---\n"), link, T.text_of("text"))
    return d.select("doc_id", F.when(F.col("quality").isNull(), T.text_of("text")).otherwise(front).alias("raw"))


def note_issues(spark, sf_dir):
    """What is wrong with note files."""
    return export.note_issues(note_files(spark, sf_dir), "doc_id")


_TYPES = ("Concept", "Source", "Tag", "Entity")


def _canvas_objects(spark, sf_dir, a):
    """The first objects of the graph: concepts, newest first, then sources, tags and entities by id."""
    order = F.array_position(F.array(*map(F.lit, _TYPES)), F.col("type"))
    newest = F.when(F.col("type") == "Concept", F.regexp_extract("id", r"(\d+)-md$", 1).cast("long")).otherwise(0)
    rows = G.objects(a).withColumns({"o": order, "newest": newest}).orderBy("o", F.desc("newest"), "id").limit(CANVAS)
    return materialise(rows, "canvas")


def canvas_nodes(spark, sf_dir):
    rows = _canvas_objects(spark, sf_dir, analysed(spark, sf_dir))
    nth = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("newest"), "id")) - 1
    x = F.when(F.col("type") == "Entity", 460).when(F.col("type") == "Source", -460).when(F.col("type") == "Tag", 920).otherwise(0)
    return rows.select(F.concat(F.lit("node-"), G.canvas_hash(F.col("id"))).alias("node"), "id", x.cast("long").alias("x"), (nth * 170).cast("long").alias("y"))


def canvas_edges(spark, sf_dir):
    a = analysed(spark, sf_dir)
    rows = _canvas_objects(spark, sf_dir, a).select("id")
    kept = G.structural_links(a).join(rows.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(rows.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    first = kept.orderBy(F.desc("doc_id"), "type", "to_id").limit(3 * CANVAS)
    return first.select(F.concat(F.lit("node-"), G.canvas_hash(F.col("from_id"))).alias("from_node"), F.concat(F.lit("node-"), G.canvas_hash(F.col("to_id"))).alias("to_node"), F.col("type").alias("label"))


QUERIES = {f.__name__: f for f in (
    extract_entities, detect_domains, graph_objects, structural_links, link_dedupe, candidate_pairs, pair_scores, capped_links,
    entity_hotspots, suggest_actions, recall_postings, graph_recall, queue_reconcile, queue_summary, queue_list,
    queue_status_update, graph_issues, queue_issues, note_issues, canvas_nodes, canvas_edges,
)}

_STOP = ", ".join(f"'{w}'" for w in T.ENTITY_STOP_WORDS)


def nid(c: str) -> str:
    return f"COALESCE(NULLIF(substr(regexp_replace(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 96), ''), 'unknown')"


def analysis(docs: str = DOCS, p: str = "") -> str:
    """Tables {p}n (notes), {p}e (entities) and {p}k (keywords), as in ``analyse``."""
    base = f"{TITLED}, {KEYWORDS}"
    ent = " UNION ALL ".join(f"SELECT doc_id, {i} AS p, '{kind}' AS kind, unnest(list_transform(regexp_extract_all(whole, '{pattern}'), lambda x, j: {{'name': x, 'at': j}})) AS m FROM n" for i, (kind, pattern) in enumerate([*((k, "(?i)\\b(" + "|".join(w) + ")\\b") for k, w in (("Platform", G.PLATFORMS), ("Metric", G.METRICS), ("DomainTerm", G.DOMAIN_TERMS))), ("Term", "[\\p{Han}A-Za-z0-9]{3,18}")]))
    dom = ", ".join(f"CASE WHEN {' OR '.join(f'contains(lower(said), {chr(39)}{t}{chr(39)})' for t in terms)} THEN '{name}' END" for name, terms in PROSE_DOMAINS.items())
    sql = f"""{base}, kt AS (SELECT doc_id, list(token ORDER BY rank) AS words FROM wr WHERE rank <= 5 GROUP BY doc_id),
n0 AS (SELECT d4.doc_id, {PATH} AS path, title, summary AS description, text AS body, source AS resource, list_concat(list_filter([lang, source], lambda x: x IS NOT NULL), COALESCE(words, [])) AS tt FROM d4 LEFT JOIN kt USING (doc_id)),
n1 AS (SELECT * EXCLUDE (tt), list_filter(tt, lambda x, i: list_position(tt, x) = i) AS tags FROM n0),
n AS (SELECT *, 'concept:' || {nid('path')} AS concept_id, title || ' ' || description || ' ' || body AS whole, title || ' ' || description || ' ' || array_to_string(tags, ' ') AS said FROM n1),
em AS ({ent}), ef AS (SELECT doc_id, 'entity:' || {nid('m.name')} AS id, arg_min(m.name, p * 10000000 + m.at) AS name, arg_min(kind, p * 10000000 + m.at) AS kind, MIN(p * 10000000 + m.at) AS first FROM em WHERE length(m.name) >= 3 AND lower(m.name) NOT IN ({_STOP}) GROUP BY ALL),
e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS nth FROM ef) WHERE nth < {G.MAX_ENTITIES}),
kx AS (SELECT doc_id, t.token AS token, t.pos AS pos FROM (SELECT doc_id, unnest(list_transform({TOKENS.format("said || ' ' || body")}, lambda x, i: {{'token': x, 'pos': i}})) AS t FROM n)),
kf AS (SELECT doc_id, token, MIN(pos) AS pos FROM kx WHERE length(token) > 3 AND token NOT IN ({_STOP}) GROUP BY ALL),
k AS (SELECT doc_id, token FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM kf) WHERE r <= {G.MAX_KEYWORDS}),
dm AS (SELECT doc_id, list_filter([{dom}], lambda x: x IS NOT NULL) AS domains FROM n),
tg AS (SELECT doc_id, unnest(tags) AS tag, unnest(range(len(tags))) AS pos FROM n),
l0 AS (SELECT doc_id, 'derived_from' AS type, concept_id AS from_id, 'source:' || {nid('resource')} AS to_id, {G.DERIVED_FROM} AS confidence FROM n WHERE resource <> ''
 UNION ALL SELECT doc_id, 'has_tag', concept_id, 'tag:' || {nid('tag')}, {G.HAS_TAG} FROM tg JOIN n USING (doc_id)
 UNION ALL SELECT doc_id, 'mentions', concept_id, e.id, CASE WHEN kind = 'Term' THEN {G.MENTIONS_TERM} ELSE {G.MENTIONS} END FROM e JOIN n USING (doc_id)),
l AS (SELECT type, from_id, to_id, CAST(MAX(confidence) AS DOUBLE) AS confidence, MAX(doc_id) AS doc_id FROM l0 GROUP BY type, from_id, to_id),
o0 AS (SELECT concept_id AS id, 'Concept' AS type, title AS name, {N.DEFAULT_CONFIDENCE} AS confidence, doc_id, description, 0 AS pos FROM n UNION ALL SELECT 'source:' || {nid('resource')}, 'Source', resource, NULL, doc_id, description, 0 FROM n WHERE resource <> ''
 UNION ALL SELECT 'tag:' || {nid('tag')}, 'Tag', tag, NULL, doc_id, description, pos FROM tg JOIN n USING (doc_id) UNION ALL SELECT e.id, 'Entity', e.name, CASE WHEN kind = 'Term' THEN {G.MENTIONS_TERM} ELSE {G.MENTIONS} END, doc_id, description, nth FROM e JOIN n USING (doc_id)),
o AS (SELECT id, type, arg_min(name, doc_id * 1000 - pos) AS name, CAST(MAX(confidence) AS DOUBLE) AS confidence FROM o0 GROUP BY id, type),
og AS (SELECT id, type, MIN(name) AS name, CAST(MAX(confidence) AS DOUBLE) AS confidence FROM o0 WHERE length(description) >= 40 GROUP BY id, type),
hs AS (SELECT to_id AS entity_id, COUNT(*) AS mentions, row_number() OVER (ORDER BY COUNT(*) DESC, to_id) AS rank FROM l WHERE type = 'mentions' GROUP BY to_id)"""
    return sql if docs == DOCS else sql.replace(DOCS, docs)


def _action_sql(n: int, name: str) -> str:
    ident = "'action:' || type || ':' || substr(sha1('{{\"type\":\"' || type || '\",\"targets\":[\"' || array_to_string(targets, '\",\"') || '\"]}}'), 1, 12)".replace("{{", "{").replace("}}", "}")
    return f"""{name}0 AS (SELECT 'promote_entity_note' AS type, [entity_id] AS targets, 'Give the repeated entity ' || substr(entity_id, 8) || ' a note of its own.' AS description, CAST({G.PROMOTE} AS DOUBLE) AS confidence FROM hs WHERE rank <= {n} AND mentions >= 2
 UNION ALL SELECT 'enrich_ambiguous_concept', [concept_id], 'Weak context: enrich with sources.', CAST({G.ENRICH} AS DOUBLE) FROM (SELECT * FROM n WHERE length(description) < 40 ORDER BY doc_id DESC LIMIT {n})),
{name} AS (SELECT *, {ident} AS id FROM {name}0)"""


CANDIDATES = f"""ck AS (SELECT doc_id, 3 AS weight, lower(tag) AS key FROM tg UNION SELECT doc_id, 2, id FROM e UNION SELECT doc_id, 1, token FROM k),
cl AS (SELECT doc_id AS a, weight, key, COUNT(*) OVER (PARTITION BY weight, key) AS size, [{', '.join(f'lead(doc_id, {i}) OVER (PARTITION BY weight, key ORDER BY doc_id DESC)' for i in range(1, G.NEXT_IN_POSTING + 1))}] AS f FROM ck),
cx AS (SELECT a, weight, key, size, unnest(range(1, {G.NEXT_IN_POSTING + 1})) AS off, unnest(f) AS b FROM cl),
cf AS (SELECT a, b, MIN({{'size': size, 'w': -weight, 'key': key, 'off': off}}) AS first FROM cx WHERE b IS NOT NULL GROUP BY a, b),
c AS (SELECT * FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY first) AS nth FROM cf) WHERE nth <= {G.MAX_CANDIDATES})"""
SCORES = f"""st AS (SELECT c.a, c.b, list(x.tag) AS v FROM c JOIN (SELECT DISTINCT doc_id, lower(tag) AS tag FROM tg) x ON x.doc_id = c.a JOIN (SELECT DISTINCT doc_id, lower(tag) AS tag FROM tg) y ON y.doc_id = c.b AND x.tag = y.tag GROUP BY ALL),
se AS (SELECT c.a, c.b, list(x.name) AS v FROM c JOIN e x ON x.doc_id = c.a JOIN e y ON y.doc_id = c.b AND x.id = y.id GROUP BY ALL),
sk AS (SELECT c.a, c.b, list(x.token) AS v FROM c JOIN k x ON x.doc_id = c.a JOIN k y ON y.doc_id = c.b AND x.token = y.token GROUP BY ALL),
s0 AS (SELECT c.a, c.b, COALESCE(st.v, []) AS t, COALESCE(se.v, []) AS e, COALESCE(sk.v, []) AS k, len(list_intersect(x.domains, y.domains)) AS d FROM c LEFT JOIN st USING (a, b) LEFT JOIN se USING (a, b) LEFT JOIN sk USING (a, b) JOIN dm x ON x.doc_id = c.a JOIN dm y ON y.doc_id = c.b),
s1 AS (SELECT a, b, d, LEAST(6, len(list_distinct(list_concat(list_concat(t, e), k)))) AS ev, 3 * len(t) + 2 * len(e) + len(k) AS w FROM s0),
s AS (SELECT a, b, CASE WHEN ev >= 2 THEN 'similar_to' ELSE 'same_domain' END AS type, ROUND(CAST(CASE WHEN ev >= 2 THEN LEAST(0.95, 0.5 + LEAST(7, w) * 0.06) ELSE {G.SAME_DOMAIN} END AS DOUBLE), 4) AS confidence, CAST(CASE WHEN ev >= 2 THEN ev ELSE 1 END AS BIGINT) AS evidence_count FROM s1 WHERE ev >= 2 OR d > 0)"""


def _with_merges(n: int, name: str) -> str:
    """As ``_action_sql``, with the merges of the first similar notes: at their place degrees are not at their bounds yet."""
    pair = lambda c: f"'concept:concepts-doc-' || {id_in_path(c)} || '-md'"
    ident = "'action:' || type || ':' || substr(sha1('{\"type\":\"' || type || '\",\"targets\":[\"' || array_to_string(targets, '\",\"') || '\"]}'), 1, 12)"
    merges = f"SELECT 'merge_duplicate_concepts' AS type, [{pair('a')}, {pair('b')}] AS targets, 'High-overlap notes: review for duplicates.' AS description, confidence FROM s WHERE type = 'similar_to' AND confidence >= {G.MERGE_FROM} ORDER BY a DESC, confidence DESC, evidence_count DESC, b DESC LIMIT {G.ACTIONS}"
    return f"{CANDIDATES}, {SCORES}, {_action_sql(n, name + 'p')}, {name}m AS ({merges}), {name} AS (SELECT type, targets, description, confidence, id FROM {name}p UNION ALL SELECT type, targets, description, confidence, {ident} FROM {name}m)"


_ALL, _OLD = analysis(), analysis("SELECT doc_id, COALESCE(text, '') AS text, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
_PREVIOUS_TABLES = f"prev AS (WITH {_OLD}, {_with_merges(500, 'ax')} SELECT id, type, targets, description, confidence, CASE WHEN d < 4 THEN 'proposed' WHEN d < 7 THEN 'accepted' WHEN d < 9 THEN 'in_progress' WHEN d < 12 THEN 'done' WHEN d < 14 THEN 'dismissed' ELSE 'archived' END AS status, d = 15 AS stale, CASE WHEN d >= 14 THEN 'manual_update' END AS reason FROM (SELECT *, strpos('0123456789abcdef', id[-1]) - 1 AS d FROM ax))"
_NOW_TABLES = f"now AS (WITH {_ALL}, {_with_merges(500, 'ax')} SELECT * FROM ax)"
QUEUE = f"""{_NOW_TABLES}, {_PREVIOUS_TABLES},
q0 AS (SELECT COALESCE(now.id, prev.id) AS id, COALESCE(now.type, prev.type) AS type, COALESCE(now.confidence, prev.confidence) AS confidence, now.id IS NOT NULL AS is_now, prev.id IS NOT NULL AS was, prev.status AS old, prev.stale AS old_stale, prev.reason AS reason,
  now.id IS NOT NULL AND prev.id IS NOT NULL AND (now.description <> prev.description OR now.confidence <> prev.confidence) AS changed FROM now FULL JOIN prev ON now.id = prev.id),
q AS (SELECT id, type, CASE WHEN is_now THEN COALESCE(old, 'proposed') WHEN old = 'proposed' THEN 'archived' ELSE old END AS status, CASE WHEN is_now THEN false WHEN old IN ('proposed', 'accepted', 'in_progress') THEN true ELSE old_stale END AS stale,
  CASE WHEN NOT is_now AND old = 'proposed' THEN 'suggestion_not_current' ELSE reason END AS archived_reason, CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.68 THEN 'medium' ELSE 'low' END AS priority,
  CASE WHEN (is_now AND (NOT was OR changed)) OR (NOT is_now AND old = 'proposed') THEN '{AT}' ELSE '2024-05-01T00:00:00.000Z' END AS updated_at FROM q0)"""


def canvas_hash_sql(c: str) -> str:
    chars = f"list_transform(string_split({c}, ''), lambda ch: CAST(unicode(ch) AS BIGINT))"
    return f"printf('%08x', abs(list_reduce({chars}, lambda h, ch: ((h * 31 + ch + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648, CAST(0 AS BIGINT))))"


_CANVAS = f"cv AS (SELECT *, CASE type WHEN 'Concept' THEN 1 WHEN 'Source' THEN 2 WHEN 'Tag' THEN 3 ELSE 4 END AS ty, CASE WHEN type = 'Concept' THEN CAST(regexp_extract(id, '(\\d+)-md$', 1) AS BIGINT) ELSE 0 END AS newest FROM o), ca AS (SELECT * FROM cv ORDER BY ty, newest DESC, id LIMIT {CANVAS})"
_FILES = """f AS (SELECT doc_id, CASE WHEN quality IS NULL THEN COALESCE(text, '') ELSE '---' || chr(10) || CASE WHEN toxic = 1 THEN '' ELSE 'type: Concept' || chr(10) END || CASE WHEN doc_id % 9 = 0 THEN '"unclosed' || chr(10) ELSE '' END || 'lang: ' || lang || chr(10) || '---' || chr(10) || CASE WHEN quality = 0 THEN '[[' || source || ']] ' ELSE '' END || COALESCE(text, '') END AS raw, quality IS NOT NULL AS has, toxic, text FROM documents LEFT JOIN labels USING (doc_id))"""

_KINDS = "[" + ", ".join(f"('{t}', '{a}', '{b}')" for t, (a, b) in G.LINK_TYPES.items()) + "]"
_GRAPH_ISSUES = f"""ob AS (SELECT CASE WHEN k = 1 THEN ' ' WHEN k <> 6 THEN id END AS id, CASE WHEN k = 2 THEN 'Thing' WHEN k <> 6 THEN 'Concept' END AS type, k, description FROM (SELECT concept_id AS id, doc_id % 50 AS k, description FROM n) UNION ALL SELECT id, type, -1, 'x' FROM o WHERE type <> 'Concept'),
ek AS (SELECT id, MIN(type) AS kind FROM ob WHERE trim(id) <> '' GROUP BY id), kinds AS (SELECT unnest({list(G.LINK_TYPES)}) AS t, unnest({[a for a, _ in G.LINK_TYPES.values()]}) AS f, unnest({[b for _, b in G.LINK_TYPES.values()]}) AS g),
lb0 AS (SELECT doc_id % 40 AS k, * FROM l), lb AS (SELECT k, CASE WHEN k = 1 THEN 'odd' WHEN k <> 7 THEN type END AS type, CASE k WHEN 2 THEN 'concept:none' WHEN 4 THEN to_id WHEN 7 THEN NULL ELSE from_id END AS from_id, CASE k WHEN 3 THEN 'tag:none' WHEN 4 THEN from_id WHEN 7 THEN NULL ELSE to_id END AS to_id FROM lb0),
lj AS (SELECT lb.k, lb.type, lb.type || '|' || lb.from_id || '|' || lb.to_id AS path, x.kind AS fk, y.kind AS tk, kinds.f, kinds.g FROM lb LEFT JOIN ek x ON x.id = from_id LEFT JOIN ek y ON y.id = to_id LEFT JOIN kinds ON kinds.t = lb.type),
{_action_sql(500, 'ax')}, ac0 AS (SELECT *, id[-1] AS d FROM ax), ac AS (SELECT id, d, CASE WHEN d = '0' THEN 'odd' WHEN d <> '7' THEN type END AS type, CASE WHEN d = '2' THEN [] WHEN d = '3' THEN ['entity:none'] WHEN d = '6' THEN ['tag:en'] WHEN d NOT IN ('1', '7') THEN targets END AS targets FROM ac0),
ats AS (SELECT id || '[' || (i - 1) || ']' AS path, type, targets[i] AS target FROM (SELECT *, unnest(range(1, len(targets) + 1)) AS i FROM ac WHERE type <> 'odd')), ak AS (SELECT ats.*, kind FROM ats LEFT JOIN ek ON ek.id = target)
SELECT 'invalid_object' AS code, '' AS path FROM ob WHERE k = 6 UNION ALL SELECT 'missing_object_id', id FROM ob WHERE k = 1 UNION ALL SELECT 'unknown_object_type', id FROM ob WHERE k = 2 UNION ALL SELECT 'invalid_object_properties', id FROM ob WHERE k = 3
UNION ALL SELECT 'invalid_confidence', id FROM ob WHERE k = 4 UNION ALL SELECT 'duplicate_object_id', id FROM ob WHERE k = 5 UNION ALL SELECT 'missing_object_property', id || '.description' FROM ob WHERE description = '' AND k NOT IN (2, 3, 6) UNION ALL SELECT 'missing_object_property', id || '.description' FROM ob WHERE description = '' AND k = 5
UNION ALL SELECT 'invalid_link', '' FROM lj WHERE k = 7 UNION ALL SELECT 'unknown_link_type', path FROM lj WHERE k = 1 UNION ALL SELECT 'missing_link_from', path FROM lj WHERE f IS NOT NULL AND fk IS NULL UNION ALL SELECT 'missing_link_to', path FROM lj WHERE f IS NOT NULL AND tk IS NULL
UNION ALL SELECT 'link_from_type_mismatch', path FROM lj WHERE fk <> f UNION ALL SELECT 'link_to_type_mismatch', path FROM lj WHERE tk <> g UNION ALL SELECT 'invalid_link_confidence', path FROM lj WHERE k = 5 UNION ALL SELECT 'invalid_link_evidence', path FROM lj WHERE k = 6
UNION ALL SELECT 'invalid_action', id FROM ac WHERE d = '7' UNION ALL SELECT 'unknown_action_type', id FROM ac WHERE d = '0' UNION ALL SELECT 'invalid_action_targets', id FROM ac WHERE d = '1' UNION ALL SELECT 'action_target_count_mismatch', id FROM ac WHERE d = '2' UNION ALL SELECT 'invalid_action_confidence', id FROM ac WHERE d = '5' UNION ALL SELECT 'missing_action_description', id FROM ac WHERE d = '4'
UNION ALL SELECT 'missing_action_target', path FROM ak WHERE kind IS NULL UNION ALL SELECT 'action_target_type_mismatch', path FROM ak WHERE kind <> CASE WHEN type = 'promote_entity_note' THEN 'Entity' ELSE 'Concept' END"""
_QUEUE_ISSUES = f"""u0 AS (SELECT id, type, targets, confidence, 'proposed' AS status, false AS stale FROM now UNION ALL SELECT id, type, targets, confidence, status, status = 'archived' FROM prev),
u AS (SELECT id[-2] AS d, CASE id[-2] WHEN '0' THEN '' WHEN '9' THEN NULL ELSE id END AS id, CASE WHEN id[-2] <> '4' THEN targets END AS targets, stale FROM u0)
SELECT 'invalid_action' AS code, '' AS path FROM u WHERE d = '9' UNION ALL SELECT c, COALESCE(id, '') FROM u JOIN (SELECT unnest(['missing_action_id', 'missing_action_type', 'invalid_action_status', 'invalid_action_priority', 'invalid_action_targets', 'invalid_action_confidence', 'missing_action_description', 'missing_created_at', 'missing_updated_at']) AS c, unnest(['0', '1', '2', '3', '4', '5', '6', '7', '8']) AS x) ON x = d
UNION ALL SELECT 'duplicate_action_id', id FROM u WHERE id <> '' GROUP BY id HAVING COUNT(*) > 1 UNION ALL SELECT 'missing_action_target', COALESCE(id, '') FROM (SELECT id, unnest(targets) AS t FROM u WHERE NOT stale) WHERE t NOT IN (SELECT id FROM g)
UNION ALL SELECT 'missing_graph_action', COALESCE(id, '') FROM u WHERE NOT stale AND d <> '9' AND id NOT IN (SELECT id FROM now)"""

SQL = {
    "extract_entities": f"WITH {_ALL} SELECT doc_id, nth, id, name, kind FROM e",
    "detect_domains": f"WITH {_ALL} SELECT doc_id, array_to_string(domains, ',') AS domains FROM dm",
    "graph_objects": f"WITH {_ALL} SELECT id, type, name, confidence FROM o",
    "structural_links": f"WITH {_ALL} SELECT type, from_id, to_id, confidence FROM l",
    "link_dedupe": f"WITH {_ALL} SELECT type, COUNT(*) AS links, COUNT(DISTINCT to_id) AS targets, MAX(confidence) AS confidence FROM l GROUP BY type",
    "candidate_pairs": f"WITH {_ALL}, {CANDIDATES} SELECT a, b, nth FROM c",
    "pair_scores": f"WITH {_ALL}, {CANDIDATES}, {SCORES} SELECT a, b, type, confidence, evidence_count FROM s",
    "entity_hotspots": f"WITH {_ALL} SELECT entity_id, mentions, rank FROM hs WHERE rank <= 12",
    "suggest_actions": f"WITH {_ALL}, {_with_merges(G.ACTIONS, 'ay')} SELECT id, type, array_to_string(targets, ',') AS targets, description, confidence FROM ay",
    "recall_postings": f"WITH {_ALL}, tl AS (SELECT doc_id, string_agg('has_tag ' || tag || ' ' || path, ' ') AS s FROM tg JOIN n USING (doc_id) GROUP BY doc_id), el AS (SELECT doc_id, string_agg('mentions ' || e.name || ' ' || path, ' ') AS s FROM e JOIN n USING (doc_id) GROUP BY doc_id), rp AS (SELECT doc_id, unnest({TOKENS.format(chr(116) + 'itle || chr(32) || description || chr(32) || CASE WHEN resource <> chr(0) THEN ' + repr('derived_from ') + ' || resource || chr(32) || path ELSE ' + repr('') + ' END || chr(32) || COALESCE(tl.s, ' + repr('') + ') || chr(32) || COALESCE(el.s, ' + repr('') + ')')}) AS token FROM n LEFT JOIN tl USING (doc_id) LEFT JOIN el USING (doc_id)) SELECT doc_id, token, COUNT(*) AS n FROM rp GROUP BY ALL",
    "queue_reconcile": f"WITH {QUEUE} SELECT id, type, status, stale, archived_reason, priority, updated_at FROM q",
    "queue_summary": f"WITH {QUEUE}, s AS (SELECT unnest({list(G.STATUSES)}) AS status) SELECT s.status, s.status IN ('proposed', 'accepted', 'in_progress') AS active, COUNT(q.id) AS n, (SELECT COUNT(*) FROM q WHERE status IN ('proposed', 'accepted', 'in_progress')) AS active_total FROM s LEFT JOIN q USING (status) GROUP BY s.status",
    "queue_list": f"WITH {QUEUE} SELECT id, status, priority, type FROM q ORDER BY list_position({list(G.STATUSES)}, status), list_position(['high', 'medium', 'low'], priority), type, id LIMIT 20",
    "queue_status_update": f"WITH {QUEUE} SELECT id, CASE WHEN status = 'accepted' THEN 'done' WHEN status = 'proposed' AND priority = 'medium' THEN 'accepted' ELSE status END AS status, CASE WHEN status = 'accepted' OR (status = 'proposed' AND priority = 'medium') THEN '{AT}' ELSE updated_at END AS updated_at, CAST(CASE WHEN status = 'accepted' OR (status = 'proposed' AND priority = 'medium') THEN 1 ELSE 0 END AS BIGINT) AS changes, CASE WHEN status = 'accepted' OR (status = 'proposed' AND priority = 'medium') THEN status ELSE '' END AS changed_from FROM q",
    "graph_issues": f"WITH {_ALL}, {_GRAPH_ISSUES}",
    "queue_issues": f"WITH {_NOW_TABLES}, {_PREVIOUS_TABLES}, g AS (WITH {_ALL} SELECT id FROM og), {_QUEUE_ISSUES}",
    "note_issues": f"WITH {_FILES} SELECT doc_id, 'missing_frontmatter' AS code FROM f WHERE NOT has UNION ALL SELECT doc_id, 'invalid_frontmatter' FROM f WHERE has AND doc_id % 9 = 0 UNION ALL SELECT doc_id, 'missing_type' FROM f WHERE has AND toxic = 1 UNION ALL SELECT doc_id, 'wiki_link' FROM f WHERE has AND regexp_matches(raw, '\\[\\[[^\\]]+\\]\\]') UNION ALL SELECT doc_id, 'empty_body' FROM f WHERE has AND NOT regexp_matches(substr(raw, strpos(raw, chr(10) || '---' || chr(10)) + 5), '\\S')",
    "canvas_nodes": f"WITH {_ALL}, {_CANVAS} SELECT 'node-' || {canvas_hash_sql('id')} AS node, id, CAST(CASE type WHEN 'Entity' THEN 460 WHEN 'Source' THEN -460 WHEN 'Tag' THEN 920 ELSE 0 END AS BIGINT) AS x, (row_number() OVER (PARTITION BY type ORDER BY newest DESC, id) - 1) * 170 AS y FROM ca",
    "canvas_edges": f"WITH {_ALL}, {_CANVAS}, ed AS (SELECT * FROM l WHERE from_id IN (SELECT id FROM ca) AND to_id IN (SELECT id FROM ca) ORDER BY doc_id DESC, type, to_id LIMIT {3 * CANVAS}) SELECT 'node-' || {canvas_hash_sql('from_id')} AS from_node, 'node-' || {canvas_hash_sql('to_id')} AS to_node, type AS label FROM ed",
}
_RP = SQL["recall_postings"].removeprefix("WITH ").rpartition(" SELECT doc_id, token")[0]
_GRAPH_TABLES = f"gp AS (WITH {_RP} SELECT doc_id, token, COUNT(*) AS n FROM rp GROUP BY ALL), gq AS (SELECT item_id, token, COUNT(*) AS times FROM (SELECT item_id, unnest({TOKENS.format('text')}) AS token FROM benchmark) GROUP BY ALL), g0 AS (SELECT item_id, doc_id, CAST(SUM(n * times) AS BIGINT) AS score FROM gp JOIN gq USING (token) GROUP BY ALL), gr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id DESC) AS rank FROM g0) WHERE rank <= 5)"
SQL["graph_recall"] = f"WITH {_GRAPH_TABLES} SELECT item_id, doc_id, score, rank FROM gr"


def _fused_sql() -> None:
    from notelake.queries.recall import _QUALITY, _TRUTH, BM25, LEXICAL, VECTOR, fused_sql

    # Every passage has words that some document has: the substring search never stands in here.
    tables = f"{LEXICAL}, {BM25}, {_GRAPH_TABLES}, {VECTOR}, {fused_sql([('lexical', 'lex', True), ('fulltext', 'bc', True), ('graph', 'gr', True), ('vector', 'vec', False)])}"
    SQL["fused_recall"] = f"WITH {tables} SELECT item_id, doc_id, score, signals, rank FROM fr"
    SQL["recall_quality"] = f"WITH {tables}, {_TRUTH} {_QUALITY}"


_fused_sql()
