"""Token counts by a two-tier lookup on the map side.

The pre-tokens of a text are looked up in two tables and no pre-token is ever shuffled:

* tier one is a compact table of frequent pre-tokens and their numbers of tokens, made once and broadcast.
  It holds at most ``table_size`` entries, whatever the input, so its size is bounded (about 8 MB);
* tier two is a cache in each Python worker, filled by the tokenizer as misses occur. It is emptied when it
  holds ``cache_size`` entries, which bounds it as well.

Both tiers only save work: a pre-token that neither holds is encoded, so counts never depend on them. The
frequent table is fitted on a bounded sample of about ``sample_rows`` documents, taken by a hash of the text.

The texts are normalised and split here as the tokenizer file says (NFC, white space, lower case, its split
pattern). Texts with characters on which the regular expression engines may differ, or with the string of
a special token, go to the library whole, so that its own handling applies.

Null texts count as empty and have no tokens; very long texts are counted whole, in slices of few texts; of pre-tokens that tie
for the frequent table the first by name is in it; rows that repeat are counted each; an empty table gives an empty
result; the input's other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.common import record_batch, row_slices, table, text_or_empty

PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Information separators and next-line are white space to one engine only; a text with "<|" may hold a special token.
ODD = regex.compile(r"[\x1c-\x1f\x85\u180e\u200b\ufeff]|<\||[^\x00-\uffff]")

_caches: dict[str, dict[str, int]] = {}
_tokenizers: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of ``path``, loaded once in each process."""
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _tokenizers[path] = t
    return _tokenizers[path]


def pre_tokens(text: str) -> list[str]:
    """What the file's normaliser and pre-tokenizer make of a text for which ``ODD`` finds nothing."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final sigma: lower case goes by characters
    return PATTERN.findall(text.lower())


def text_tokens(text: str, path: str, frequent: dict[str, int], cache: dict[str, int], cache_size: int) -> int:
    if ODD.search(text):
        return len(tokenizer(path).encode(text, add_special_tokens=False).ids)
    words = pre_tokens(text)
    found = list(map(frequent.get, words))
    if None not in found:
        return sum(found)
    total = sum(n for n in found if n is not None)
    for word, n in zip(words, found, strict=True):
        if n is None:
            if (n := cache.get(word)) is None:
                if len(cache) >= cache_size:
                    cache.clear()
                n = cache[word] = len(tokenizer(path).encode(word, add_special_tokens=False).ids)
            total += n
    return total


def frequent_table(documents: DataFrame, path: str, sample_rows: int, table_size: int) -> dict[str, int]:
    """The most frequent pre-tokens of a sample of about ``sample_rows`` texts, with their numbers of tokens."""
    rows = documents.count()
    share = max(1, rows // sample_rows)
    sample = documents.select(text_or_empty().alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if not ODD.search(text):
                    counts.update(pre_tokens(text))
            if len(counts) > 4 * table_size:
                counts = Counter(dict(counts.most_common(table_size)))
        # Each task names its own most frequent words: one row per word and task of the sample.
        top = [(w, n) for w, n in counts.most_common(table_size // 4) if n > 1 and len(w) < 40]
        if top:
            yield record_batch({"word": [w for w, _ in top], "n": [n for _, n in top]}, schema)

    top = sample.mapInArrow(words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(table_size).collect()
    t = tokenizer(path)
    return {r["word"]: len(t.encode(r["word"], add_special_tokens=False).ids) for r in top}


def count_tokens(documents: DataFrame, path: str, sample_rows: int = 4_000, table_size: int = 40_000, cache_size: int = 300_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every whole text of ``documents(doc_id, text)``."""
    spark = documents.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_table(documents, path, sample_rows, table_size))
    rows = documents.select("doc_id", text_or_empty().alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cache = frequent.value, _caches.setdefault(path, {})
        for batch in batches:
            for part in row_slices(batch, "text"):
                texts = part.column("text").to_pylist()
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pc.binary_length(part.column("text")).cast(pa.int64()), pa.array([text_tokens(t, path, known, cache, cache_size) for t in texts], pa.int64())], schema=schema)

    return rows.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)
