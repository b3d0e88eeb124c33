"""SpotSigs fingerprints: chains of content words that follow common words.

A common word is an anchor. It and the next ``chain`` words that are not common, in steps of ``step`` such
words, form a signature; a text's fingerprint is the set of its signatures' hashes, sorted. Natural prose has
many, and lists of names or links have few. So that lists and
texts in other languages can be compared as well, one word in ``spare`` is an anchor by its hash (0: none
is). A text without any signature gets one, of the text itself: every text has a fingerprint, and equal texts
have equal ones.

Sets are compared by Jaccard similarity, pruned: sets whose lengths rule out the wanted similarity are not
compared. ``near_pairs`` partitions sets by length, so that sets similar enough are in the same or in
neighbouring partitions, and joins within these on the rarest signatures of each.

A null text counts as empty. Rows that repeat, ties of ids and null ids (which come first) are rows in a
defined order: by id and then by text. Very long texts are fingerprinted whole, in slices of few texts. An empty table
gives an empty result; other columns, whatever they are called, are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notelake.llm.common import materialise, rare_prefixes, row_slices, table, text_or_empty
from notelake.llm.hashing import by_text, mixed, words

COMMON = (
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their there they this to was we were which will with you "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous ou par pas plus pour qui que sa se ses son sur un une vous "
    "auch auf aus bei das dem den der die ein eine einem einen einer er es für hat ich ihr im ist mit nach nicht sich sie sind so um und von vor war werden wie wir zu zum zur "
    "al como con del el ella ellos era esta este fue ha las lo los más muy no nos o para pero por si sin sobre su sus una uno y ya yo"
).split()
CHAIN, STEP, SPARE = 2, 1, 16
_FIRST = -(2**63)


def _common_hashes() -> np.ndarray:
    return np.unique(words(pa.array(sorted(set(COMMON))))[0])


def fingerprints(texts: pa.Array, chain: int = CHAIN, step: int = STEP, spare: int = SPARE) -> list[np.ndarray]:
    """The sorted signature hashes of each text (no nulls)."""
    h, owner, _, _ = words(texts)
    n = len(texts)
    common = np.isin(h, _common_hashes())
    content = np.flatnonzero(~common)
    anchors = np.flatnonzero(common | (mixed(h, 10) % np.uint64(spare) == 0) if spare else common)
    first = np.searchsorted(content, anchors, side="right")
    last = first + (chain - 1) * step
    ok = last < len(content)
    anchors, first, last = anchors[ok], first[ok], last[ok]
    ok = owner[content[last]] == owner[anchors]
    anchors, first = anchors[ok], first[ok]
    sig = mixed(h[anchors], 11)
    for j in range(chain):
        sig = mixed(sig ^ h[content[first + j * step]], 12 + j)
    of = owner[anchors]
    order = np.lexsort((sig, of))
    sig, of = sig[order], of[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (of[1:] != of[:-1])
    sig, of = sig[new], of[new]
    out = [sig[a:b] for a, b in by_text(of, n)]
    for i, found in enumerate(out):
        if not len(found):
            whole = hashlib.md5(texts[i].as_py().encode(), usedforsecurity=False).digest()
            out[i] = np.frombuffer(whole[:8], "<u8")
    return out


def shown(fingerprint: np.ndarray) -> str:
    """Sixteen hexadecimal digits for each signature, in order."""
    return fingerprint.astype(">u8").tobytes().hex()


def pruned_jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two fingerprints, or 0 where it is under ``least``; lengths may decide it alone."""
    short, long_ = sorted((len(a), len(b)))
    if short < least * long_:
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    sim = common / (short + long_ - common)
    return sim if sim >= least else 0.0


def fingerprint_documents(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (as ``shown``), signatures (array) of every row of ``documents(doc_id, text)``."""
    rows = documents.select("doc_id", text_or_empty().alias("text"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text"):
                found = fingerprints(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([shown(x) for x in found], pa.string()), pa.array([x.astype(np.int64) for x in found], pa.list_(pa.int64()))], names=["doc_id", "fingerprint", "signatures"])

    return rows.mapInArrow(made, "doc_id long, fingerprint string, signatures array<long>")


def near_pairs(fingerprinted: DataFrame, least: float = 0.8) -> DataFrame:
    """Pairs a < b of different fingerprints (what ``fingerprint_documents`` gives) of similarity ``least`` or more."""
    sets = materialise(fingerprinted.groupBy("fingerprint").agg(F.first("signatures").alias("signatures")), "fingerprints")
    # Lengths l and m of similar sets have l >= least * m, so their logarithms to 1 / least differ by at most 1.
    part = F.floor(F.log(F.size("signatures").cast("double")) / math.log(1 / least) + 1e-9).cast("long")
    spread = materialise(sets.select("fingerprint", F.size("signatures").alias("n"), part.alias("part"), F.explode("signatures").alias("sig")), "spread")
    prefix = materialise(rare_prefixes(spread, "fingerprint", "sig", least).select("fingerprint", "n", "part", "sig"), "prefix")
    left = prefix.select(F.col("fingerprint").alias("a"), F.col("n").alias("na"), F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"), "sig")
    right = prefix.select(F.col("fingerprint").alias("b"), F.col("n").alias("nb"), "part", "sig")
    fits = F.least("na", "nb") >= F.lit(least) * F.greatest("na", "nb")
    pairs = left.join(right, ["part", "sig"]).where((F.col("a") != F.col("b")) & fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    of = lambda c, s: sets.select(F.col("fingerprint").alias(c), F.col("signatures").alias(s))
    common = F.size(F.array_intersect("sa", "sb"))
    sim = common / (F.size("sa") + F.size("sb") - common)
    return pairs.join(of("a", "sa"), "a").join(of("b", "sb"), "b").withColumn("similarity", sim).where(F.col("similarity") >= least - 1e-12).select("a", "b", "similarity")


def with_next(documents: DataFrame, rows_per_range: int = 1_000, most_ranges: int = 8_192) -> DataFrame:
    """range, guest, key, doc_id, text: rows of ranges of ids, each range with the row that follows it as a guest.

    Ranges are cut at quantiles of the ids. A range's last row has its successor in the next range, whose
    first row is therefore sent along: one row for each range, and no text is sent twice otherwise.
    """
    rows = documents.select("doc_id", text_or_empty().alias("text"), F.coalesce("doc_id", F.lit(_FIRST)).alias("key"))
    ids = documents.select(F.coalesce("doc_id", F.lit(_FIRST)).alias("key"))
    n = ids.count()
    ranges = min(most_ranges, max(1, n // rows_per_range))
    cuts = ids.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 10 * most_ranges)).first()[0] if ranges > 1 else []
    cuts = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("long")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy(), side="left"))

    heads = ids.select("key", range_of("key").alias("range")).groupBy("range").agg(F.min("key").alias("key"))
    order = Window.orderBy("range")  # over one row for each range, at most ``most_ranges``
    before = F.coalesce(F.lag("range").over(order), F.max("range").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = materialise(heads.select("key", before.alias("range")), "heads")
    guests = rows.join(F.broadcast(heads), "key").select("range", F.lit(True).alias("guest"), "key", "doc_id", "text")
    return rows.select(range_of("key").alias("range"), F.lit(False).alias("guest"), "key", "doc_id", "text").unionByName(guests)


def edited_text(text: str, after: str) -> str:
    """The last quarter of ``text`` replaced by the start of ``after``."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + after[:quarter]


_EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_fingerprints(documents: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how near they and the next document's are."""
    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = with_next(documents)
    # Ranges are dealt out in turn rather than by hash: tasks get as many each.
    dealt = rows.repartitionById(parts, (F.col("range") % parts).cast("int")).sortWithinPartitions("range", "guest", "key", "text")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row: range, guest, doc_id, text, fingerprint
        for batch in batches:
            for part in row_slices(batch, "text"):
                own = fingerprints(part.column("text"))
                rows = list(zip(part.column("range").to_pylist(), part.column("guest").to_pylist(), part.column("doc_id").to_pylist(), part.column("text").to_pylist(), own, strict=True))
                if held is not None:
                    rows.insert(0, held)
                held = rows[-1]
                done = [(x, y) for x, y in zip(rows, rows[1:], strict=False) if not x[1] and x[0] == y[0]]
                if not done:
                    continue
                texts = [edited_text(x[3], y[3]) for x, y in done]
                edited = fingerprints(pa.array(texts, pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[2] for x, _ in done], pa.int64()),
                        pa.array([len(x[3]) for x, _ in done], pa.int64()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
                        pa.array([shown(x[4]) for x, _ in done], pa.string()),
                        pa.array([shown(e) for e in edited], pa.string()),
                        pa.array([pruned_jaccard(x[4], e) for (x, _), e in zip(done, edited, strict=True)], pa.float64()),
                        pa.array([pruned_jaccard(x[4], y[4]) for x, y in done], pa.float64()),
                    ],
                    names=[c.split()[0] for c in _EDITED.split(", ")],
                )

    return dealt.mapInArrow(compared, _EDITED)


def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
