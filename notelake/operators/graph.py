"""The graph of notes: entities, objects, links, candidate pairs, capped similarity links, actions and recall.

Analysis of a note stays in its row (array functions). Pairs come from posting lists: a note is paired with the
next notes that share a tag, an entity or a keyword, never with all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.functions import text as T
from notelake.operators import notes as N
from notelake.operators.recall import ID_ROWS, small
from notelake.plans.store import materialise, shared_folder

# Fixed values of the graph: dictionaries, limits and confidences.
PLATFORMS = ("Obsidian", "Codex", "Douyin", "Amazon", "PaddleOCR", "FunASR", "Whisper", "Palantir", "Foundry")
METRICS = ("ACOS", "CVR", "CTR", "ROI", "BSR", "conversion", "budget", "inventory", "sales")
DOMAIN_TERMS = ("listing", "keyword", "campaign", "review", "store", "report", "ontology", "skill", "agent", "vault")
DOMAINS = {"amazon": ("amazon", "亚马逊", "listing", "acos", "keyword", "广告"), "codex": ("codex", "skill", "agent"), "obsidian": ("obsidian", "vault", "ontology"), "douyin": ("douyin", "抖音", "video", "transcription")}
MAX_TAGS, MAX_ENTITIES, MAX_KEYWORDS, TOP_K = 16, 24, 48, 20
NEXT_IN_POSTING, MAX_CANDIDATES = 8, 80
DERIVED_FROM, HAS_TAG, MENTIONS, MENTIONS_TERM, SAME_DOMAIN = 0.92, 0.86, 0.78, 0.58, 0.68
MERGE_FROM, PROMOTE, ENRICH, ACTIONS = 0.78, 0.7, 0.62, 8
STATUSES = ("proposed", "accepted", "in_progress", "done", "dismissed", "archived")


def _words(words: tuple[str, ...]) -> str:
    return rf"(?i)(?<![A-Za-z0-9_])({'|'.join(words)})(?![A-Za-z0-9_])"


#: Kind and pattern, in the order in which they are looked for. The last takes runs of Han and ASCII characters.
ENTITY_PATTERNS = (("Platform", _words(PLATFORMS)), ("Metric", _words(METRICS)), ("DomainTerm", _words(DOMAIN_TERMS)), ("Term", r"([\p{IsHan}A-Za-z0-9]{3,18})"))


def entities(text: Column, n: int = MAX_ENTITIES) -> Column:
    """The first ``n`` entities of a text: id, name, kind; the first pattern that finds an id names it.

    What the patterns find has letters and digits only, so that its normalised id is its lower case. Names are made
    distinct before anything else is done with them.
    """
    struct = "array<struct<id:string,name:string,kind:string>>"
    by_kind = [F.array_distinct(F.regexp_extract_all(text, F.lit(p), 1)) for _, p in ENTITY_PATTERNS]
    kinds = [kind for kind, _ in ENTITY_PATTERNS]

    def named(found: Column) -> Column:
        names = [found[f"n{i}"] for i in range(len(kinds))]
        every = T.bound(F.concat(*names), lambda x: F.struct(x.alias("names"), F.transform(x, F.lower).alias("low")))

        def of(all_: Column) -> Column:
            ids = F.slice(F.array_except(all_["low"], F.array(*map(F.lit, T.ENTITY_STOP_WORDS))), 1, n)

            def made(i: Column) -> Column:
                at = F.array_position(all_["low"], i).cast("int")
                kind, upto = F.lit(kinds[-1]), sum((F.size(x) for x in names[:-1]), F.lit(0))
                for k in range(len(kinds) - 2, -1, -1):
                    upto = sum((F.size(x) for x in names[: k + 1]), F.lit(0))
                    kind = F.when(at <= upto, F.lit(kinds[k])).otherwise(kind)
                return F.struct(F.concat(F.lit("entity:"), i).alias("id"), F.get(all_["names"], at - 1).alias("name"), kind.alias("kind"))

            return F.transform(ids, made)

        return T.bound(every, of)

    return F.coalesce(T.bound(F.struct(*[x.alias(f"n{i}") for i, x in enumerate(by_kind)]), named), F.array().cast(struct))


def domains(text: Column, dictionary: dict[str, tuple[str, ...]] = DOMAINS) -> Column:
    low = F.lower(text)
    has = lambda terms: F.greatest(*[F.contains(low, F.lit(t)) for t in terms], F.lit(False))
    return F.array_compact(F.array(*[F.when(has(terms), F.lit(name)) for name, terms in dictionary.items()]))


def analyse(notes: DataFrame, dictionary: dict[str, tuple[str, ...]] = DOMAINS) -> DataFrame:
    """Per note: concept_id, tags, tag_keys, entities, keywords, domains."""
    tags = F.slice(F.filter(F.array_distinct(F.transform("tags", T.trimmed)), lambda t: t != ""), 1, MAX_TAGS)
    rows = notes.withColumn("tags", tags).withColumn("entities", entities(F.concat_ws(" ", "title", "description", "body")))
    words = F.array_except(T.tokens(F.concat_ws(" ", "title", "description", F.array_join("tags", " "), "body")), F.array(*map(F.lit, T.ENTITY_STOP_WORDS)))
    return rows.select(
        "doc_id", "path", "title", "description", "resource", "timestamp", "confidence", "tags", "entities",
        F.concat(F.lit("concept:"), T.normalized_id(F.col("path"))).alias("concept_id"),
        F.array_distinct(F.transform("tags", F.lower)).alias("tag_keys"),
        F.slice(F.filter(words, lambda t: F.length(t) > 3), 1, MAX_KEYWORDS).alias("keywords"),
        domains(F.concat_ws(" ", "title", "description", F.array_join("tags", " ")), dictionary).alias("domains"),
    )


def _id(kind: str, name: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), T.normalized_id(name))


def _confidence(kind: Column) -> Column:
    return F.when(kind == "Term", MENTIONS_TERM).otherwise(MENTIONS)


def objects(analysed: DataFrame) -> DataFrame:
    """id, type, name, confidence, properties: one row for each object. Where notes differ the last in order (the oldest) counts."""
    text = lambda **p: F.create_map(*[x for k, v in p.items() for x in (F.lit(k), v.cast("string"))])
    kind = T.source_type(F.coalesce("resource", F.lit("")))
    none = F.lit(None).cast("double").alias("confidence")
    row = lambda id_, type_, name, confidence, properties, pos: ["doc_id", pos.cast("int").alias("pos"), id_.alias("id"), F.lit(type_).alias("type"), name.alias("name"), confidence, properties.alias("properties")]
    col = F.col
    concept = analysed.select(*row(col("concept_id"), "Concept", col("title"), col("confidence"), text(title=col("title"), description=col("description"), path=col("path"), timestamp=col("timestamp"), confidence=col("confidence"), source_type=kind), F.lit(0)))
    source = analysed.where("resource <> ''").select(*row(_id("source", col("resource")), "Source", col("resource"), none, text(resource=col("resource"), source_type=T.resource_type(col("resource"))), F.lit(0)))
    tag = analysed.select("doc_id", F.posexplode("tags").alias("pos", "t")).select(*row(_id("tag", col("t")), "Tag", col("t"), none, text(name=col("t")), col("pos")))
    entity = analysed.select("doc_id", F.posexplode("entities").alias("pos", "e")).select(*row(col("e.id"), "Entity", col("e.name"), _confidence(col("e.kind")).alias("confidence"), text(name=col("e.name"), kind=col("e.kind")), col("pos")))
    every = concept.unionByName(source).unionByName(tag).unionByName(entity)
    last = F.struct("doc_id", -F.col("pos"))
    return every.groupBy("id", "type").agg(F.min_by("name", last).alias("name"), F.max("confidence").alias("confidence"), F.min_by("properties", last).alias("properties"))


def structural_links(analysed: DataFrame) -> DataFrame:
    """doc_id, type, from_id, to_id, confidence, pos: one row for each link, the most confident where one repeats.

    ``pos`` is its place among the note's links of its type; see ``link_order``.
    """
    base = ["doc_id", F.col("concept_id").alias("from_id")]
    said = lambda kind, to, confidence, pos: [*base, F.lit(kind).alias("type"), to.alias("to_id"), F.lit(confidence).alias("confidence") if isinstance(confidence, float) else confidence.alias("confidence"), pos.cast("int").alias("pos")]
    source = analysed.where("resource <> ''").select(*said("derived_from", _id("source", F.col("resource")), DERIVED_FROM, F.lit(0)))
    tags = analysed.select("doc_id", "concept_id", F.posexplode("tags").alias("at", "t"))
    tag = tags.select(*said("has_tag", _id("tag", F.col("t")), HAS_TAG, F.col("at")))
    found = analysed.select("doc_id", "concept_id", F.posexplode("entities").alias("at", "e"))
    entity = found.select(*said("mentions", F.col("e.id"), _confidence(F.col("e.kind")), F.col("at")))
    return deduplicated(source.unionByName(tag).unionByName(entity))


def deduplicated(links: DataFrame) -> DataFrame:
    return links.groupBy("type", "from_id", "to_id").agg(F.max("confidence").alias("confidence"), F.max("doc_id").alias("doc_id"), F.min("pos").alias("pos"))


def _keys(analysed: DataFrame, order: Column | None = None) -> DataFrame:
    """doc_id, order, weight, key, own, doms: a row for each tag, entity and keyword of a note.

    ``own``: an entity whose name has capitals, which is no tag's or keyword's string. ``doms``: which of its domains the note has, if
    the caller has numbered them.
    """
    row = lambda weight, key, own: F.struct(F.lit(weight).alias("weight"), key.alias("key"), own.alias("own"))
    found = F.concat(
        F.transform("tag_keys", lambda k: row(3, k, F.lit(False))),
        F.transform("entities", lambda e: row(2, F.substring(e["id"], len("entity:") + 1, 1 << 20), e["name"] != F.lower(e["name"]))),
        F.transform("keywords", lambda k: row(1, k, F.lit(False))),
    )
    doms = F.col("doms") if "doms" in analysed.columns else F.lit(0).cast("long").alias("doms")
    keys = analysed.select("doc_id", doms, F.explode(found).alias("k")).select("doc_id", "doms", "k.*")
    return keys.withColumn("order", order if order is not None else F.bitwise_not("doc_id"))


def _numbered_keys(sizes: DataFrame) -> DataFrame:
    """weight, key, place, code of ``sizes(weight, key, size)``: the place in order of rarity, and a number that tells weight (its last
    two bits) and string, which is the same for a tag, an entity and a keyword that are written alike."""
    placed = N.numbered(sizes.where("size > 1"), [F.col("size"), F.desc("weight"), F.col("key")], "place")
    string = F.min("place").over(Window.partitionBy("key"))
    return materialise(placed.select("weight", "key", "place", (string * 4 + F.col("weight")).alias("code")), "places")


def _candidates(sized: DataFrame) -> DataFrame:
    """a, bs, codes, doms of ``sized(doc_id, order, place, code, own, doms)``: a note's candidates, rarest keys first, and its keys' codes."""
    rows = sized.select("doc_id", "order", "place", (F.col("code") * 2 + F.col("own").cast("int")).alias("code"), "doms")
    placed = N.with_following(rows, ["place"], [F.col("order")], "doc_id", NEXT_IN_POSTING)
    lists = placed.groupBy(F.col("doc_id").alias("a")).agg(F.array_sort(F.collect_list(F.struct("place", "following", "code"))).alias("l"), F.max("doms").alias("doms"))  # a row for each key of a note: 88 at most
    near = F.slice(F.array_distinct(F.flatten(F.transform("l", lambda x: x["following"]))), 1, MAX_CANDIDATES)
    return lists.select("a", near.alias("bs"), F.array_sort(F.transform("l", lambda x: x["code"])).alias("codes"), "doms")


def candidate_lists(analysed: DataFrame, order: Column | None = None) -> DataFrame:
    """a, bs, codes, doms: every note that shares a key, with its candidates in order.

    Strings are shuffled once, to number them; what follows which is found by numbers, and a note's lists meet as its row.
    """
    keys = materialise(_keys(analysed, order), "keys")
    places = _numbered_keys(keys.groupBy("weight", "key").agg(F.count("*").alias("size")))
    return _candidates(keys.join(places, ["weight", "key"]))  # a join of two written tables is split where a key is frequent


def newest_lists(analysed: DataFrame, since: int) -> DataFrame:
    """``candidate_lists`` of the notes from id ``since`` on alone: of their keys the sizes and the rows that follow, no others."""
    keys = _keys(analysed)
    own = materialise(keys.where(F.col("doc_id") >= since), "newest-keys")
    asked = keys.join(small(own.select("weight", "key").distinct()), ["weight", "key"], "left_semi")
    places = _numbered_keys(asked.groupBy("weight", "key").agg(F.count("*").alias("size")))
    nth = F.row_number().over(Window.partitionBy("weight", "key").orderBy(F.desc("doc_id")))  # Spark limits these before the shuffle
    after = asked.where(F.col("doc_id") < since).withColumn("_nth", nth).where(F.col("_nth") <= NEXT_IN_POSTING).drop("_nth")
    return _candidates(own.unionByName(after).join(places, ["weight", "key"])).where(F.col("a") >= since)


def candidate_pairs(analysed: DataFrame, order: Column | None = None) -> DataFrame:
    """a, b, nth: for each note the notes that follow it in the posting lists of its keys, rarest keys first.

    ``order``: the notes' order, newest first by default.
    """
    return _pairs(candidate_lists(analysed, order))


def _pairs(lists: DataFrame) -> DataFrame:
    return lists.select("a", F.posexplode("bs").alias("nth", "b")).select("a", "b", (F.col("nth") + 1).alias("nth"))


#: Notes whose codes a task of ``scored_pairs`` holds, and domains that it can tell apart; keys that an int can number.
NOTE_BLOCK, MOST_DOMAINS, INT_CODES = 1 << 18, 62, 1 << 28


def cell_scores(left: pa.Table, right: pa.Table, pairs: int = 1 << 14) -> pa.Table:
    """a, b, evidence, weight, same of the pairs of ``left(a, codes, doms, bs)`` with ``right(id, codes, doms)``, some at a time."""

    def lists(t: pa.Table, c: str) -> tuple[np.ndarray, np.ndarray]:
        whole = t.column(c).combine_chunks()
        sizes = whole.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        return whole.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])

    numbers = lambda t, c: t.column(c).to_numpy().astype(np.int64)
    (mine, start), (near, near_start), (theirs, begin) = lists(left, "codes"), lists(left, "bs"), lists(right, "codes")
    ids = numbers(right, "id")
    by_id = np.argsort(ids)
    owner = np.repeat(np.arange(left.num_rows), np.diff(near_start))
    row = by_id[np.searchsorted(ids[by_id], near)] if len(near) else near
    same = (numbers(left, "doms")[owner] & numbers(right, "doms")[row]) != 0
    evidence, weight = np.zeros(len(near), np.int64), np.zeros(len(near), np.int64)
    for lo in range(0, len(near), pairs):
        o, r = owner[lo : lo + pairs], row[lo : lo + pairs]
        first, last = start[o[0]], start[o[-1] + 1]
        of = np.repeat(np.arange(o[-1] - o[0] + 1), np.diff(start[o[0] : o[-1] + 2]))
        known = (of << 44) | (mine[first:last] >> 1)  # in order: notes, then codes
        n = begin[r + 1] - begin[r]
        which = np.repeat(np.arange(len(o)), n)
        code = theirs[np.repeat(begin[r] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())] >> 1
        wanted = ((o - o[0])[which] << 44) | code
        at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
        hit = np.flatnonzero(known[at] == wanted)
        which, code, own = which[hit], code[hit], mine[first:last][at[hit]] & 1
        weight[lo : lo + pairs] = np.bincount(which, weights=code & 3, minlength=len(o))
        plain = np.flatnonzero(own == 0)  # strings that several kinds share count once
        w, string = which[plain], code[plain] >> 2
        new = np.concatenate([[True], (w[1:] != w[:-1]) | (string[1:] != string[:-1])]) if len(w) else np.zeros(0, bool)
        evidence[lo : lo + pairs] = np.bincount(which[own == 1], minlength=len(o)) + np.bincount(w[new], minlength=len(o))
    some = np.flatnonzero((evidence >= 2) | same)
    a = numbers(left, "a")[owner[some]]
    return pa.table({"a": a, "b": near[some], "evidence": np.minimum(evidence[some], 6), "weight": weight[some], "same": same[some]})


def scored_pairs(analysed: DataFrame, block: int = NOTE_BLOCK) -> DataFrame:
    """``pair_scores`` of all candidate pairs, without the evidence itself.

    Notes are numbers by then. They are dealt into blocks, and a task has one block's notes with their candidates in another and the
    other's codes: what is shuffled grows with notes times blocks, not with pairs times strings.
    """
    names = [r[0] for r in analysed.select(F.explode("domains")).distinct().limit(MOST_DOMAINS + 1).collect()]  # the dictionary's
    if len(names) > MOST_DOMAINS or not N.each_once(analysed, "doc_id"):
        return pair_scores(analysed, candidate_pairs(analysed)).drop("evidence")
    doms = sum((F.when(F.array_contains("domains", name), 1 << i).otherwise(0).cast("long") for i, name in enumerate(names)), F.lit(0).cast("long"))
    lists = materialise(candidate_lists(analysed.withColumn("doms", doms)), "candidates")
    size = lists.agg(F.count("*").alias("n"), F.max(F.element_at("codes", -1)).alias("most")).first()
    if not size["n"]:
        return pair_scores(analysed, _pairs(lists)).drop("evidence")
    codes = F.col("codes").cast("array<int>" if size["most"] < 8 * INT_CODES - 1 else "array<long>").alias("codes")
    across = -(-size["n"] // block)
    down = max(across, -(-2 * analysed.sparkSession.sparkContext.defaultParallelism // across))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = lists.select("a", codes, "doms", "bs", to(across).alias("j")).withColumn("bs", F.filter("bs", lambda b: place(b, across) == F.col("j"))).where(F.size("bs") > 0)
    left = left.select((place("a", down) * across + F.col("j")).alias("cell"), "a", "codes", "doms", "bs")
    right = lists.select(F.col("a").alias("id"), codes, "doms", to(down).alias("i")).select((F.col("i") * across + place("id", across)).alias("cell"), "id", "codes", "doms")

    def scored(x: pa.Table, y: pa.Table) -> pa.Table:
        return cell_scores(x, y)

    rows = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(scored, "a long, b long, evidence long, weight long, same boolean")
    return _typed(rows, F.col("evidence"), F.col("weight"), F.col("same")).select("a", "b", "type", "confidence", "evidence_count")


def _typed(rows: DataFrame, evidence: Column, weight: Column, same: Column) -> DataFrame:
    """``rows`` that have a type, with it, its confidence and evidence_count."""
    kind = F.when(evidence >= 2, "similar_to").when(same, "same_domain")
    similar = F.least(F.lit(0.95), F.lit(0.5) + F.least(F.lit(7), weight) * 0.06)
    is_similar = F.col("type") == "similar_to"
    return rows.withColumn("type", kind).where("type is not null").withColumns({"confidence": F.round(F.when(is_similar, similar).otherwise(SAME_DOMAIN), 4), "evidence_count": F.when(is_similar, evidence).otherwise(1).cast("long")})


def pair_scores(analysed: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, type, confidence, evidence_count, evidence (six things shared at most) of the candidate pairs that share enough."""
    side = lambda s: analysed.select(F.col("doc_id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("tag_keys", "entities", "keywords", "domains")])
    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    ids_b = F.transform("entities_b", lambda e: e["id"])
    shared = F.filter("entities_a", lambda e: F.array_contains(ids_b, e["id"]))
    rows = rows.withColumns({"tags": F.array_intersect("tag_keys_a", "tag_keys_b"), "ents": F.transform(shared, lambda e: e["name"]), "words": F.array_intersect("keywords_a", "keywords_b"), "doms": F.array_intersect("domains_a", "domains_b")})
    rows = rows.withColumn("evidence", F.slice(F.array_distinct(F.concat("tags", "ents", "words")), 1, 6))
    weight = 3 * F.size("tags") + 2 * F.size("ents") + F.size("words")
    rows = _typed(rows, F.size("evidence"), weight, F.size("doms") > 0)
    return rows.select("a", "b", "type", "confidence", "evidence_count", F.when(F.col("type") == "similar_to", F.col("evidence")).otherwise(F.slice("doms", 1, 1)).alias("evidence"))


def proposal_order() -> list[Column]:
    """A note's proposals: confidence, evidence, then newer notes first."""
    return [F.desc("confidence"), F.desc("evidence_count"), F.desc("b")]


#: So many proposals, about, are walked by one task.
WALKED = 2_000_000


def _walked(rows: DataFrame, top_k: int) -> DataFrame:
    """Those of a bounded number of proposals that are taken, walked in order by one task.

    ``at_a`` and ``at_b``: how many links each end has from ranges before.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        degree: dict[int, int] = {}
        for batch in batches:
            taken = []
            for i, (a, b, at_a, at_b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "b", "at_a", "at_b")), strict=True)):
                now_a, now_b = degree.get(a, at_a), degree.get(b, at_b)
                if now_a < top_k and now_b < top_k:
                    degree[a], degree[b] = now_a + 1, now_b + 1
                    taken.append(i)
            yield batch.take(pa.array(taken, pa.int64()))

    return rows.repartition(1).sortWithinPartitions(F.desc("a"), "rank").mapInArrow(walk, rows.schema)


def capped_links(scored: DataFrame, top_k: int = TOP_K, walked: int = WALKED) -> DataFrame:
    """The links that remain if notes, newest first, take their proposals in order while both ends have under ``top_k``.

    That is a sequence. It is cut into ranges of notes of about ``walked`` proposals; what a range takes depends on those before it
    by its notes' degrees alone. Ranges go one after another: proposals whose ends are full are left out and the degrees of
    the others joined to them in parallel, then one task walks the range.
    """
    spark = scored.sparkSession
    scored = materialise(scored, "scored")
    ranges = max(1, -(-scored.count() // max(1, walked)))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(*proposal_order()))
    rows = scored.repartitionByRange(ranges, F.desc("a")).withColumn("_range", F.spark_partition_id()).withColumn("rank", rank.cast("long"))
    rows = materialise(rows, "proposals") if ranges > 1 else rows
    path, columns = shared_folder(spark, "links"), [c for c in ("a", "b", "type", "confidence", "evidence_count", "evidence", "rank") if c in rows.columns]
    schema = rows.select(*columns).schema
    if ranges == 1:
        return _walked(rows.select(*columns, F.lit(0).alias("at_a"), F.lit(0).alias("at_b")), top_k).select(*columns)
    for n, nth in enumerate(sorted(r[0] for r in rows.select("_range").distinct().collect())):
        mine = rows.where(F.col("_range") == nth).select(*columns)
        if n:
            links = spark.read.schema(schema).parquet(path)
            degrees = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").cast("int").alias("n"))
            at = lambda c, degrees=degrees: degrees.select(F.col("node").alias(c), F.col("n").alias(f"at_{c}"))
            mine = mine.join(at("a"), "a", "left").join(at("b"), "b", "left").fillna(0, ["at_a", "at_b"]).where((F.col("at_a") < top_k) & (F.col("at_b") < top_k))
        else:
            mine = mine.withColumns({"at_a": F.lit(0), "at_b": F.lit(0)})
        _walked(mine.select(*columns, "at_a", "at_b"), top_k).select(*columns).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def first_merges(analysed: DataFrame, n: int, first: int = 256) -> DataFrame:
    """The first ``n`` capped links, newest notes first, between notes so alike that they may be one.

    What a note links depends on newer notes alone, so that the newest ``first`` are enough if ``n`` are found among them; else
    eight times as many are looked at, and so on. Of other notes only those are read that these are paired with.
    """
    order = [F.desc("a"), *proposal_order()]
    while True:
        newest = analysed.select("doc_id").distinct().orderBy(F.desc("doc_id")).limit(first).agg(F.min("doc_id").alias("oldest"), F.count("*").alias("n")).first()
        every = newest["n"] < first
        pairs = materialise(candidate_pairs(analysed) if every else _pairs(newest_lists(analysed, newest["oldest"])), "pairs")
        ids = small(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), ID_ROWS)
        scored = pair_scores(materialise(analysed.join(ids, "doc_id", "left_semi"), "paired"), pairs)
        merges = capped_links(scored).where((F.col("type") == "similar_to") & (F.col("confidence") >= MERGE_FROM)).orderBy(*order).limit(n)
        merges = materialise(merges, "merges")
        if every or merges.count() == n:
            return merges
        first *= 8


def link_order() -> list:
    """The order in which links are made: notes newest first; of each its source, its tags and its entities."""
    return [F.desc("doc_id"), F.array_position(F.array(*map(F.lit, LINK_TYPES)), F.col("type")), "pos", "to_id"]


def with_concepts(similar: DataFrame, analysed: DataFrame) -> DataFrame:
    """Capped links with the concepts of their ends, from_id and to_id."""
    end = lambda c, name: analysed.select(F.col("doc_id").alias(c), F.col("concept_id").alias(name))
    return similar.join(end("a", "from_id"), "a").join(end("b", "to_id"), "b")


def hotspots(links: DataFrame, n: int) -> DataFrame:
    """entity_id, mentions, rank of the most mentioned entities."""
    counts = links.where("type = 'mentions'").groupBy(F.col("to_id").alias("entity_id")).agg(F.count("*").alias("mentions"))
    top = counts.orderBy(F.desc("mentions"), "entity_id").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mentions"), "entity_id")).cast("long"))  # n rows


def action_id(kind: Column, targets: Column) -> Column:
    said = F.to_json(F.struct(kind.alias("type"), targets.alias("targets")))
    return F.concat(F.lit("action:"), kind, F.lit(":"), F.substring(F.sha1(said.cast("binary")), 1, 12))


def actions(analysed: DataFrame, links: DataFrame, similar: DataFrame | None, n: int = ACTIONS, merges: int = ACTIONS) -> DataFrame:
    """id, type, targets, description, confidence: what the graph suggests, ``n`` of each kind (``merges`` merges) at most."""
    parts = []
    if similar is not None:
        merge = similar.where((F.col("type") == "similar_to") & (F.col("confidence") >= MERGE_FROM)).orderBy(F.desc("a"), *proposal_order()).limit(merges)
        merge = with_concepts(F.broadcast(merge), analysed)  # ``merges`` rows
        parts.append(merge.select(F.lit("merge_duplicate_concepts").alias("type"), F.array("from_id", "to_id").alias("targets"), F.lit("High-overlap notes: review for duplicates.").alias("description"), "confidence"))
    promote = hotspots(links, n).where("mentions >= 2")
    parts.append(promote.select(F.lit("promote_entity_note").alias("type"), F.array("entity_id").alias("targets"), F.concat(F.lit("Give the repeated entity "), F.substring("entity_id", 8, 200), F.lit(" a note of its own.")).alias("description"), F.lit(PROMOTE).alias("confidence")))
    weak = analysed.where(F.length("description") < 40).orderBy(F.desc("doc_id")).limit(n)
    parts.append(weak.select(F.lit("enrich_ambiguous_concept").alias("type"), F.array("concept_id").alias("targets"), F.lit("Weak context: enrich with sources.").alias("description"), F.lit(ENRICH).alias("confidence")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("id", action_id(F.col("type"), F.col("targets")))


def words_said(analysed: DataFrame) -> DataFrame:
    """doc_id, t: the words of a concept's title, description and of its structural links, with their other ends."""
    source = F.when(F.col("resource") != "", F.concat(F.lit("derived_from "), "resource", F.lit(" "), "path"))
    tag = F.array_join(F.transform("tags", lambda t: F.concat(F.lit("has_tag "), t, F.lit(" "), "path")), " ")
    entity = F.array_join(F.transform("entities", lambda e: F.concat(F.lit("mentions "), e["name"], F.lit(" "), "path")), " ")
    return analysed.select("doc_id", T.tokens(F.concat_ws(" ", "title", "description", source, tag, entity)).alias("t"))


def recall_postings(analysed: DataFrame, similar: DataFrame | None = None) -> DataFrame:
    """doc_id, token, n: the words of a concept's title, description and of its links, with their other ends and evidence.

    With ``similar`` (what ``capped_links`` gives) its links count at both of their ends.
    """
    words = words_said(analysed).select("doc_id", F.explode("t").alias("token"))
    if similar is not None:
        ends = F.explode(F.array(F.struct(F.col("a").alias("doc_id"), F.col("b").alias("other")), F.struct(F.col("b").alias("doc_id"), F.col("a").alias("other"))))
        links = similar.select("type", "evidence", ends.alias("e")).select("e.*", "type", "evidence")
        titled = links.join(analysed.select(F.col("doc_id").alias("other"), "title"), "other")
        words = words.unionByName(titled.select("doc_id", F.explode(T.tokens(F.concat_ws(" ", "type", "title", F.array_join("evidence", " ")))).alias("token")))
    return words.groupBy("doc_id", "token").agg(F.count("*").alias("n"))


def priority(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "high").when(confidence >= 0.68, "medium").otherwise("low")


_HISTORY = "array<struct<at:string,from:string,to:string,note:string>>"


def reconcile(current: DataFrame, previous: DataFrame, at: str) -> DataFrame:
    """The action queue: current suggestions with the states that they had, and what becomes of those no longer made.

    What an action had (history, times, why it was archived) stays with it. Of those no longer made, proposed ones are
    archived and open ones are stale; closed ones stay as they were.
    """
    said = ("type", "targets", "description", "confidence")
    kinds = {"archived_reason": "string", "stale": "boolean", "created_at": "string", "closed_at": "string", "history": _HISTORY}
    had = lambda c: F.col(c) if c in previous.columns else F.lit(None).cast(kinds[c])
    now = current.select("id", *[F.col(c).alias(f"now_{c}") for c in said], F.lit(True).alias("_now"))
    old = previous.select("id", *[F.col(c).alias(f"old_{c}") for c in (*said, "status", "updated_at")], *[had(c).alias(f"old_{c}") for c in kinds], F.lit(True).alias("_was"))
    rows = now.join(old, "id", "full_outer").withColumns({"is_now": F.coalesce("_now", F.lit(False)), "was": F.coalesce("_was", F.lit(False))})
    is_now, was = F.col("is_now"), F.col("was")
    proposed = F.col("old_status") == "proposed"
    differs = [~F.col(f"now_{c}").eqNullSafe(F.col(f"old_{c}")) for c in said]
    changed = was & (differs[0] | differs[1] | differs[2] | differs[3])
    return rows.select(
        "id", *[F.when(is_now, F.col(f"now_{c}")).otherwise(F.col(f"old_{c}")).alias(c) for c in said],
        F.when(is_now & was & F.col("old_status").isin(*STATUSES), F.col("old_status")).when(is_now, "proposed").when(proposed, "archived").otherwise(F.col("old_status")).alias("status"),
        F.when(is_now, False).when(F.col("old_status").isin(*STATUSES[:3]), True).otherwise(F.coalesce("old_stale", F.lit(False))).alias("stale"),
        F.when(~is_now & proposed, "suggestion_not_current").otherwise(F.col("old_archived_reason")).alias("archived_reason"),
        F.when(F.when(is_now, changed | ~was).otherwise(proposed), F.lit(at)).otherwise(F.col("old_updated_at")).alias("updated_at"),
        F.coalesce("old_created_at", "old_updated_at", F.lit(at)).alias("created_at"),
        F.col("old_closed_at").alias("closed_at"),
        F.coalesce("old_history", F.array().cast(_HISTORY)).alias("history"),
    ).withColumn("priority", priority(F.col("confidence")))


def queue_order() -> list[Column]:
    at = lambda c, names: F.array_position(F.array(*map(F.lit, names)), c)
    return [at(F.col("status"), STATUSES), at(F.col("priority"), ("high", "medium", "low")), F.col("type"), F.col("id")]


def with_status(queue: DataFrame, which: Column, status: str, at: str, note: str = "") -> DataFrame:
    """The queue with ``status`` where ``which`` holds; the change is added to the action's history."""
    if status not in STATUSES:
        raise ValueError(f"no such status: {status}")
    entry = F.struct(F.lit(at).alias("at"), F.col("status").alias("from"), F.lit(status).alias("to"), F.lit(note.strip()).alias("note"))
    columns = {
        "history": F.when(which, F.array_append("history", entry)).otherwise(F.col("history")),
        "updated_at": F.when(which, F.lit(at)).otherwise(F.col("updated_at")),
        "archived_reason": F.when(which & F.lit(status == "archived"), F.coalesce("archived_reason", F.lit(note.strip() or "manual_update"))).otherwise(F.col("archived_reason")),
        "closed_at": F.when(which, F.lit(at if status in STATUSES[3:] else None).cast("string")).otherwise(F.col("closed_at") if "closed_at" in queue.columns else F.lit(None)),
        "status": F.when(which, F.lit(status)).otherwise(F.col("status")),
    }
    return queue.withColumns(columns)


#: Fixed values of the schema: what objects must have, which ends links join, what actions are about.
OBJECT_TYPES = {"Concept": ("title", "description", "path", "timestamp", "confidence", "source_type"), "Source": ("resource", "source_type"), "Tag": ("name",), "Entity": ("name", "kind")}
LINK_TYPES = {"derived_from": ("Concept", "Source"), "has_tag": ("Concept", "Tag"), "mentions": ("Concept", "Entity"), "similar_to": ("Concept", "Concept"), "same_domain": ("Concept", "Concept")}
ACTION_TYPES = {"merge_duplicate_concepts": ("Concept", "Concept"), "promote_entity_note": ("Entity",), "enrich_ambiguous_concept": ("Concept",), "schedule_review": ("Concept",)}
SCHEMA_SECTIONS = ("objectTypes", "linkTypes", "actionTypes")


def _issues(rows: DataFrame, rules: list[tuple[Column, str, Column]]) -> DataFrame:
    """code, path: of each row those rules that it breaks."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(code).alias("code"), path.alias("path"))) for bad, code, path in rules]))
    return rows.select(F.explode(found).alias("i")).select("i.code", F.coalesce("i.path", F.lit("")).alias("path"))


def _table(values: dict, of: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]), of)


def _blank(c: str) -> Column:
    return T.trimmed(T.text_of(c)) == ""


def object_issues(objects_: DataFrame) -> DataFrame:
    """code, path of objects (id, type, properties)."""
    nothing = F.col("id").isNull() & F.col("type").isNull() & F.col("properties").isNull()
    known = F.coalesce(F.col("type").isin(*OBJECT_TYPES), F.lit(False))
    has = F.col("properties").isNotNull()
    confidence = F.expr("try_cast(properties['confidence'] as double)")
    path = F.col("id")
    rules = [
        (nothing, "invalid_object", path),
        (~nothing & _blank("id"), "missing_object_id", path),
        (~nothing & ~known, "unknown_object_type", path),
        (known & ~has, "invalid_object_properties", path),
        *[(has & (F.col("type") == kind) & (T.text_of(F.element_at("properties", p)) == ""), "missing_object_property", F.concat_ws(".", "id", F.lit(p))) for kind, names in OBJECT_TYPES.items() for p in names],
        (has & (F.col("type") == "Concept") & ~F.coalesce(confidence.between(0, 1), F.lit(False)), "invalid_confidence", path),
    ]
    again = objects_.where(~_blank("id")).groupBy(F.col("id").alias("path")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_object_id").alias("code"), "path")
    return _issues(objects_, rules).unionByName(again)


def link_issues(links: DataFrame, objects_: DataFrame) -> DataFrame:
    """code, path of links (type, from_id, to_id, confidence, evidence)."""
    ends = objects_.where(~_blank("id")).groupBy(F.col("id").alias("key")).agg(F.min("type").alias("kind"))
    rows = links.join(ends.select(F.col("key").alias("from_id"), F.col("kind").alias("from_kind")), "from_id", "left").join(ends.select(F.col("key").alias("to_id"), F.col("kind").alias("to_kind")), "to_id", "left")
    nothing = F.col("type").isNull() & F.col("from_id").isNull() & F.col("to_id").isNull()
    known = F.coalesce(F.col("type").isin(*LINK_TYPES), F.lit(False))
    name = F.concat_ws("|", "type", "from_id", "to_id")
    wanted = [_table({k: F.lit(v[i]) for k, v in LINK_TYPES.items()}, F.col("type")) for i in (0, 1)]
    rules = [
        (nothing, "invalid_link", name),
        (~nothing & ~known, "unknown_link_type", name),
        (known & F.col("from_kind").isNull(), "missing_link_from", name),
        (known & F.col("to_kind").isNull(), "missing_link_to", name),
        (known & (F.col("from_kind") != wanted[0]), "link_from_type_mismatch", name),
        (known & (F.col("to_kind") != wanted[1]), "link_to_type_mismatch", name),
        (known & ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "invalid_link_confidence", name),
        (known & F.col("evidence").isNull(), "invalid_link_evidence", name),
    ]
    return _issues(rows, rules)


def action_issues(actions_: DataFrame, objects_: DataFrame) -> DataFrame:
    """code, path of actions (id, type, targets, description, confidence)."""
    nothing = F.col("type").isNull() & F.col("targets").isNull() & F.col("description").isNull()
    known = F.coalesce(F.col("type").isin(*ACTION_TYPES), F.lit(False))
    has, path = F.col("targets").isNotNull(), F.col("id")
    inputs = _table({k: F.array(*map(F.lit, v)) for k, v in ACTION_TYPES.items()}, F.col("type"))
    own = _issues(actions_, [
        (nothing, "invalid_action", path),
        (~nothing & ~known, "unknown_action_type", path),
        (known & ~has, "invalid_action_targets", path),
        (known & has & (F.size("targets") < F.size(inputs)), "action_target_count_mismatch", path),
        (known & has & F.col("confidence").isNotNull() & ~F.col("confidence").between(0, 1), "invalid_action_confidence", path),
        (known & has & _blank("description"), "missing_action_description", path),
    ])
    kinds = objects_.where(~_blank("id")).groupBy(F.col("id").alias("target")).agg(F.min("type").alias("kind"))
    targets = actions_.where(known & has).select("id", inputs.alias("inputs"), F.posexplode("targets").alias("nth", "target")).join(kinds, "target", "left")
    at = F.concat(F.col("id"), F.lit("["), F.col("nth").cast("string"), F.lit("]"))
    expected = F.get("inputs", F.least(F.col("nth"), F.size("inputs") - 1))
    return own.unionByName(_issues(targets, [(F.col("kind").isNull(), "missing_action_target", at), (F.col("kind") != expected, "action_target_type_mismatch", at)]))


def schema_rows(spark) -> DataFrame:
    """The schema as a table: section, type, properties, from_type, to_type, inputs."""
    rows = [("objectTypes", k, list(v), None, None, None) for k, v in OBJECT_TYPES.items()]
    rows += [("linkTypes", k, None, *v, None) for k, v in LINK_TYPES.items()]
    rows += [("actionTypes", k, None, None, None, list(v)) for k, v in ACTION_TYPES.items()]
    return spark.createDataFrame(rows, "section string, type string, properties array<string>, from_type string, to_type string, inputs array<string>")


def schema_issues(schema: DataFrame) -> DataFrame:
    """code, path of a graph's schema table, held against ``schema_rows``."""
    spark = schema.sparkSession
    want = schema_rows(spark).select("section", "type", *[F.col(c).alias(f"w_{c}") for c in ("properties", "from_type", "to_type", "inputs")])
    some = schema.agg(F.count("*").alias("rows"), F.collect_set("section").alias("sections"))  # one row, three names
    rows = want.join(schema.withColumn("is_there", F.lit(True)), ["section", "type"], "left").crossJoin(F.broadcast(some))
    has_section, there = F.array_contains("sections", F.col("section")), F.col("is_there").isNotNull()
    path = F.concat_ws(".", F.lit("schema"), "section", "type")
    lost = F.array_except("w_properties", F.coalesce("properties", F.array().cast("array<string>")))
    own = _issues(rows, [
        (has_section & ~there, "missing_schema_type", path),
        (there & (F.col("w_from_type") != F.coalesce("from_type", F.lit(""))), "schema_type_mismatch", F.concat(path, F.lit(".from"))),
        (there & (F.col("w_to_type") != F.coalesce("to_type", F.lit(""))), "schema_type_mismatch", F.concat(path, F.lit(".to"))),
        (there & F.col("w_inputs").isNotNull() & ~F.col("w_inputs").eqNullSafe(F.col("inputs")), "schema_inputs_mismatch", path),
    ])
    properties = rows.where(there & F.col("w_properties").isNotNull()).select(F.explode(lost).alias("p"), path.alias("path")).select(F.lit("missing_schema_property").alias("code"), F.concat_ws(".", "path", "p").alias("path"))
    sections = rows.select("section", has_section.alias("has"), F.col("rows")).distinct().where(~F.col("has") & (F.col("rows") > 0)).select(F.lit("missing_schema_section").alias("code"), F.concat_ws(".", F.lit("schema"), "section").alias("path"))
    none = some.where("rows = 0").select(F.lit("missing_schema").alias("code"), F.lit("schema").alias("path"))
    return own.unionByName(properties).unionByName(sections).unionByName(none)


def graph_issues(objects_: DataFrame, links: DataFrame, actions_: DataFrame | None = None, schema: DataFrame | None = None) -> DataFrame:
    """code, path: whatever in a graph breaks its rules."""
    out = object_issues(objects_).unionByName(link_issues(links, objects_))
    out = out if actions_ is None else out.unionByName(action_issues(actions_, objects_))
    return out if schema is None else out.unionByName(schema_issues(schema))


def queue_issues(queue: DataFrame, objects_: DataFrame | None = None, current: DataFrame | None = None) -> DataFrame:
    """code, path: actions that break the queue's rules. ``current``: the graph's actions; what is not stale must be among them."""
    nothing = F.col("id").isNull() & F.col("type").isNull() & F.col("status").isNull()
    stale = F.coalesce("stale", F.lit(False)) if "stale" in queue.columns else F.lit(False)
    rows, path = queue.withColumn("_stale", stale), F.col("id")
    own = _issues(rows, [
        (nothing, "invalid_action", path),
        (~nothing & _blank("id"), "missing_action_id", path),
        (~nothing & _blank("type"), "missing_action_type", path),
        (~nothing & ~F.coalesce("status", F.lit("")).isin(*STATUSES), "invalid_action_status", path),
        (~nothing & ~F.coalesce("priority", F.lit("")).isin("high", "medium", "low"), "invalid_action_priority", path),
        (~nothing & F.col("targets").isNull(), "invalid_action_targets", path),
        (~nothing & ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "invalid_action_confidence", path),
        (~nothing & _blank("description"), "missing_action_description", path),
        *[(~nothing & _blank(c), f"missing_{c}", path) for c in ("created_at", "updated_at") if c in queue.columns],
    ])
    out = own.unionByName(rows.where(~_blank("id")).groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_action_id").alias("code"), F.col("id").alias("path")))
    if objects_ is not None:
        lost = rows.where("not _stale").select("id", F.explode("targets").alias("target")).join(objects_.select(F.col("id").alias("target")).distinct(), "target", "left_anti")
        out = out.unionByName(lost.select(F.lit("missing_action_target").alias("code"), F.coalesce("id", F.lit("")).alias("path")))
    if current is not None:
        gone = rows.where(~F.col("_stale") & ~nothing).join(current.select("id").distinct(), "id", "left_anti")
        out = out.unionByName(gone.select(F.lit("missing_graph_action").alias("code"), F.coalesce("id", F.lit("")).alias("path")))
    return out


def canvas_hash(c: Column) -> Column:
    """A short name: the 31-fold hash of the characters in 32 bits, absolute, in eight hexadecimal digits."""
    wrap = lambda x: F.pmod(x + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)
    h = F.aggregate(F.filter(F.split(c, ""), lambda ch: ch != ""), F.lit(0).cast("long"), lambda a, ch: wrap(a * 31 + F.ascii(ch).cast("long")))
    return F.lpad(F.lower(F.hex(F.abs(h))), 8, "0")
