"""Personal data: patterns, and terms that by the corpus reveal what the patterns protect.

The base are e-mail addresses, IP addresses, card and telephone numbers. Each value found is a protected entity.
Information theory adds terms: of a term t in documents of entity e, wherever it stands, the disclosure is
PMI(t; e) = log(N df(t, e) / (df(t) df(e))) in documents, as a share of the entity's information
IC(e) = log(N / df(e)); 1 means that t occurs with e alone. A term with a share of ``disclosure`` or more, seen
with e in ``support`` different texts (copies are one), discloses it. Every occurrence of such a term outside base
spans is a span of kind "term", in documents without the value as well. ``sanitised`` replaces base spans by their
kind and generalises terms.

All counts are over all documents. An entity in fewer than ``support`` texts has no terms, so only the words of the
other entities' documents are paired. Bitmaps of fixed size (``BITS``) tell tasks which entities and terms count;
what passes one by chance is dropped by a join. Pairs are summed in tasks; only texts that have copies are told
apart by their digest. Counts, digests and places are shuffled, no texts.

A null text counts as empty and has no spans. Very long texts are searched whole, in slices of few texts. Spans that tie for a start
go by kind. Rows that repeat are documents each. An empty table gives an empty result. Columns of the input other than
doc_id and text, whatever they are called, are kept by ``sanitised`` as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.common import bitmap_of, materialise, row_slices, table, text_or_empty
from notelake.llm.hashing import by_text, text_bytes, words
from notelake.llm.spotsigs import COMMON

KINDS = ("email", "ip", "card", "phone", "term")
SUPPORT, DISCLOSURE = 3, 0.9
#: Pairs of entity and term that a task sums at once.
PAIRS = 500_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NOT_DIGIT = re.compile(r"[^0-9]")
_ANY = re.compile(r"[0-9@]")
_COMMON = words(pa.array(sorted(COMMON)))[0]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each at sign: its local part begins at the first fitting character since the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, kinds numbered as in ``KINDS``, by start and kind."""
    if not _ANY.search(text):
        return []
    found = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def entity(kind: int, value: str) -> int:
    """The number of a protected value, however it is written."""
    value = value.lower() if kind == 0 else value if kind == 1 else _NOT_DIGIT.sub("", value)
    return int.from_bytes(hashlib.md5(f"{kind}:{value}".encode(), usedforsecurity=False).digest()[:8], "little", signed=True)


def entities(text: str) -> list[int]:
    """The different protected values of a text."""
    return sorted({entity(k, text[s:e]) for s, k, e in base_spans(text)})


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every word that can disclose something: hash, number of its text, start and end (characters of that text).

    Numbers, words of fewer than three characters and common words can't.
    """
    h, owner, start, end = words(texts)
    data, offsets = text_bytes(pc.utf8_lower(texts))
    chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    digits = np.r_[0, np.cumsum((data >= 48) & (data <= 57))]
    size = chars[end] - chars[start]
    some = (size >= 3) & (digits[end] - digits[start] < size) & ~np.isin(h, _COMMON)
    h, owner, start, end = h[some], owner[some], start[some], end[some]
    first = chars[offsets[owner]]
    return h.astype(np.int64), owner, chars[start] - first, chars[end] - first


_BASE = "item binary, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans array<struct<start:int,kind:int,end:int>>, entities array<long>"
_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])


def item_of(text: Column) -> Column:
    """The digest of a text; equal texts are one item."""
    return F.unhex(F.md5(text.cast("binary")))


def found_in(documents: DataFrame) -> DataFrame:
    """Base spans and protected values for every row of ``documents(doc_id, text)``."""
    rows = documents.select("doc_id", text_or_empty().alias("text")).select(item_of(F.col("text")).alias("item"), "doc_id", "text")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text"):
                texts = part.column("text").to_pylist()
                spans = [base_spans(t) for t in texts]
                counts = [[sum(k == kind for _, k, _ in found) for found in spans] for kind in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("item").cast(pa.binary()), part.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in counts),
                        pa.array([hashlib.sha256(shown(found).encode()).hexdigest() for found in spans], pa.string()),
                        pa.array([[{"start": s, "kind": k, "end": e} for s, k, e in found] for found in spans], pa.list_(_SPAN)),
                        pa.array([sorted({entity(k, t[s:e]) for s, k, e in found}) for t, found in zip(texts, spans, strict=True)], pa.list_(pa.int64())),
                    ],
                    names=["item", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "entities"],
                )

    return rows.mapInArrow(made, _BASE)


def document_counts(documents: DataFrame, passing: np.ndarray) -> DataFrame:
    """term, df: in how many documents each term that passes the bitmap occurs."""
    bits = len(passing)
    shared = documents.sparkSession.sparkContext.broadcast(np.packbits(passing))

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        term, back = np.unique(np.concatenate([t for t, _ in parts]), return_inverse=True)
        n = np.zeros(len(term), np.int64)
        np.add.at(n, back, np.concatenate([n for _, n in parts]))
        return term, n

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(shared.value).astype(bool)
        parts, held = [], 0  # of the whole task; given out only where it has more than ``PAIRS`` different terms
        for batch in batches:
            for part in row_slices(batch, "text"):
                h, owner, _, _ = words(part.column("text"))
                h = h.astype(np.int64)
                some = known[h % bits]
                h, owner = h[some], owner[some]
                order = np.lexsort((owner, h))
                h, owner = h[order], owner[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
                term, n = np.unique(h[new], return_counts=True)
                parts.append((term, n.astype(np.int64)))
                held += len(term)
                if held >= 2 * PAIRS:
                    parts = [summed(parts)]
                    held = len(parts[0][0])
                    if held >= PAIRS:
                        yield pa.RecordBatch.from_arrays([*map(pa.array, parts[0])], names=["term", "n"])
                        parts, held = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([*map(pa.array, summed(parts))], names=["term", "n"])

    return documents.select(text_or_empty().alias("text")).mapInArrow(made, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))


def joint_counts(documents: DataFrame, protected: np.ndarray, copied: np.ndarray) -> DataFrame:
    """entity, term, texts, joint: in how many different texts and in how many documents each entity and term occur together.

    Of entities that pass the bitmap ``protected``. Texts that don't pass ``copied`` have no copies: each counts on its own.
    """
    bits = len(protected)
    shared = documents.sparkSession.sparkContext.broadcast((np.packbits(protected), np.packbits(copied)))
    rows = documents.select(text_or_empty().alias("text")).select("text", F.xxhash64(item_of(F.col("text"))).alias("digest"))

    def summed(pairs: list[tuple[int, int | None, np.ndarray]]) -> pa.RecordBatch:
        sizes = [len(t) for _, _, t in pairs]
        which = pa.array(np.repeat(np.arange(len(pairs)), sizes))
        whole = pa.table({
            "entity": pa.array([e for e, _, _ in pairs], pa.int64()).take(which),
            "term": pa.array(np.concatenate([t for _, _, t in pairs])),
            "digest": pa.array([d for _, d, _ in pairs], pa.int64()).take(which),
        }).group_by(["entity", "term", "digest"]).aggregate([([], "count_all")])
        return whole.rename_columns(["entity", "term", "digest", "n"]).combine_chunks().to_batches()[0]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, twice = (np.unpackbits(x).astype(bool) for x in shared.value)
        pairs, held = [], 0
        for batch in batches:
            for part in row_slices(batch, "text"):
                whose = [[e for e in entities(t) if known[e % bits]] for t in part.column("text").to_pylist()]
                some = [i for i, mine in enumerate(whose) if mine]
                if not some:
                    continue
                h, owner, _, _ = terms_of(part.column("text").take(pa.array(some)))
                digests = part.column("digest").take(pa.array(some)).to_pylist()
                for (lo, hi), i, digest in zip(by_text(owner, len(some)), some, digests, strict=True):
                    terms = np.unique(h[lo:hi])
                    for e in whose[i] if len(terms) else ():
                        pairs.append((e, digest if twice[digest % bits] else None, terms))
                        held += len(terms)
                        if held >= PAIRS:
                            yield summed(pairs)
                            pairs, held = [], 0
        if pairs:
            yield summed(pairs)

    of_texts = rows.mapInArrow(made, "entity long, term long, digest long, n long").groupBy("entity", "term", "digest").agg(F.sum("n").alias("n"))
    texts = F.when(F.col("digest").isNull(), F.col("n")).otherwise(1)
    return of_texts.groupBy("entity", "term").agg(F.sum(texts).alias("texts"), F.sum("n").alias("joint"))


def disclosing_terms(documents: DataFrame, found: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """entity, term: the terms whose disclosure of the entity reaches the threshold."""
    of_texts = found.select("item", F.explode("entities").alias("entity")).groupBy("entity", "item").agg(F.count("*").alias("n"))
    several = of_texts.groupBy("entity").agg(F.count("*").alias("texts"), F.sum("n").alias("de")).where(F.col("texts") >= support)
    several = materialise(several.select("entity", "de"), "entities")
    protected = bitmap_of(several, "entity")
    if not protected.any():
        return documents.sparkSession.createDataFrame([], "entity long, term long")
    copies = found.where(F.size("entities") > 0).groupBy("item").agg(F.count("*").alias("n")).where("n > 1")
    pairs = joint_counts(documents, protected, bitmap_of(copies.select(F.xxhash64("item").alias("h")), "h"))
    supported = materialise(pairs.where(F.col("texts") >= support), "supported-terms")
    terms = document_counts(documents, bitmap_of(supported, "term"))
    rows = found.count()
    share = 1 + F.log(F.least(F.lit(1.0), F.col("joint") / F.col("df"))) / F.greatest(F.log(F.lit(float(max(rows, 1))) / F.col("de")), F.lit(1e-9))
    return supported.join(several, "entity").join(terms, "term").where(share >= disclosure).select("entity", "term")


def term_spans(documents: DataFrame, disclosing: DataFrame) -> DataFrame:
    """item, terms: all spans of disclosing terms in each text that has some (equal texts are one item)."""
    terms = materialise(disclosing.select("term").distinct(), "terms")
    passing = bitmap_of(terms, "term")
    if not passing.any():
        return documents.sparkSession.createDataFrame([], "item binary, terms array<struct<start:int,kind:int,end:int>>")
    bits = len(passing)
    shared = documents.sparkSession.sparkContext.broadcast(np.packbits(passing))
    rows = documents.select(text_or_empty().alias("text")).select(item_of(F.col("text")).alias("item"), "text")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            for part in row_slices(batch, "text"):
                h, owner, start, end = terms_of(part.column("text"))
                some = known[h % bits]
                h, owner, start, end = h[some], owner[some], start[some], end[some]
                free = np.ones(len(h), bool)
                for i in np.unique(owner):
                    mine = slice(*np.searchsorted(owner, [i, i + 1]))
                    for s, _, e in base_spans(part.column("text")[int(i)].as_py()):
                        free[mine] &= (end[mine] <= s) | (start[mine] >= e)
                if free.any():
                    yield pa.RecordBatch.from_arrays(
                        [part.column("item").cast(pa.binary()).take(pa.array(owner[free])), pa.array(h[free]), pa.array(start[free].astype(np.int32)), pa.array(end[free].astype(np.int32))],
                        names=["item", "term", "start", "end"],
                    )

    places = rows.mapInArrow(made, "item binary, term long, start int, end int").distinct()
    spans = places.join(terms, "term").select("item", F.struct("start", F.lit(4).alias("kind"), "end").alias("span"))
    return spans.groupBy("item").agg(F.sort_array(F.collect_list("span")).alias("terms"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of an array of spans, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(documents: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """Base counts and all spans for every row of ``documents(doc_id, text)``."""
    found = materialise(found_in(documents), "found")
    disclosing = materialise(disclosing_terms(documents, found, support, disclosure), "disclosing")
    terms = materialise(term_spans(documents, disclosing), "term-spans")
    whole = found.drop("entities").join(terms, "item", "left")
    every = F.array_sort(F.concat("spans", F.coalesce("terms", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    return whole.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans_text(every).alias("spans"), F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_terms"))


def generalised(term: str) -> str:
    return "[NUMBER]" if any(c.isdigit() for c in term) else "[NAME]" if term[:1].isupper() else "[TERM]"


def replaced(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with its spans replaced; of spans that overlap, all is replaced by the first one's kind."""
    out, upto = [], 0
    for s, k, e in sorted(spans):
        if s >= upto:
            out += [text[upto:s], generalised(text[s:e]) if k == 4 else f"[{KINDS[k].upper()}]"]
        upto = max(upto, e)
    return "".join([*out, text[upto:]])


def sanitised(documents: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """``documents`` with personal data replaced in ``text`` (and ``n_chars`` set to its new length, where there is one).

    Texts whose digest passes a bitmap of those with disclosing terms are joined with them; all others are
    rewritten where they are read.
    """
    found = materialise(found_in(documents), "found")
    disclosing = materialise(disclosing_terms(documents, found, support, disclosure), "disclosing")
    terms = materialise(term_spans(documents, disclosing), "term-spans")
    digest = lambda c: F.xxhash64(c)
    passing = bitmap_of(terms.select(digest("item").alias("h")), "h")
    bits = len(passing)
    named = {c: f"_c{i}" for i, c in enumerate(documents.columns)}  # whatever the columns are called
    rows = documents.withColumnsRenamed(named)
    text = named["text"]
    rows = rows.withColumn("_item", F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))))
    if passing.any():
        shared = documents.sparkSession.sparkContext.broadcast(passing)

        @F.pandas_udf("boolean")
        def may_have(h: pd.Series) -> pd.Series:
            return pd.Series(shared.value[h.to_numpy() % bits])

        rows = rows.withColumn("_may", may_have(digest("_item")))
        joined = rows.where("_may").join(terms.withColumnRenamed("item", "_item"), "_item", "left")
        rows = rows.where("not _may").withColumn("terms", F.lit(None).cast("array<struct<start:int,kind:int,end:int>>")).select(joined.columns).unionByName(joined).drop("_may")
    else:
        rows = rows.withColumn("terms", F.lit(None).cast("array<struct<start:int,kind:int,end:int>>"))

    @F.pandas_udf("string")
    def rewritten(texts: pd.Series, terms: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else replaced(t, [*base_spans(t), *((x["start"], x["kind"], x["end"]) for x in ([] if more is None else more))]) for t, more in zip(texts, terms, strict=True)], dtype=object)

    rows = rows.withColumn(text, rewritten(text, "terms"))
    if "n_chars" in named:
        rows = rows.withColumn(named["n_chars"], F.when(F.col(text).isNull(), F.col(named["n_chars"])).otherwise(F.length(text)).cast(documents.schema["n_chars"].dataType))
    return rows.select(*(F.col(n).alias(c) for c, n in named.items()))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
