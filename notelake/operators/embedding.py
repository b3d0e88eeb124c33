"""Embedding by functions that the caller passes, with fallback to the library's hashed vectors, and its upkeep.

A table of vectors has one identity (provider, model, size): a build is one provider's whole answer, or the next one's.
"""

from __future__ import annotations

import hashlib
import queue
import threading
import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.functions import text as T
from notelake.plans.store import materialise

Provider = Callable[[list[str]], Sequence[Sequence[float]]]
#: Texts in a request, tries, and the first pause between tries in seconds. Seconds to wait for an answer.
BATCH, TRIES, PAUSE = 64, 3, 0.2
TIMEOUT = 60.0
_TOKEN = regex.compile(r"[\p{L}\p{N}]+")
_HAN = regex.compile(r"\p{Han}")


#: Tokens of more characters are hashed by themselves.
_LONG = 64


def _letters(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens' characters, a row of ``_LONG`` each, and their lengths."""
    length = np.fromiter(map(len, tokens), np.int64, len(tokens))
    return np.array(tokens, dtype=f"U{_LONG}").view(np.uint32).reshape(len(tokens), _LONG), length


def _hashed_on(h: np.ndarray, which: np.ndarray, tokens: list[str], letters: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The FNV-1a hashes that go on from ``h`` over the tokens numbered ``which``: character by character, all at once."""
    h = h.astype(np.uint32)
    size = length[which]
    order = np.argsort(-np.minimum(size, _LONG + 1), kind="stable")
    many = int((size > _LONG).sum())
    for i in order[:many]:  # the few very long ones
        x = int(h[i])
        for c in tokens[which[i]]:
            x = ((x ^ ord(c)) * 16777619) & 0xFFFFFFFF
        h[i] = x
    rest = order[many:]
    if len(rest):
        state, row, ends = h[rest], which[rest], -size[rest]
        for j in range(int(-ends[0])):
            n = int(np.searchsorted(ends, -j, side="left"))  # tokens of more than j characters come first
            state[:n] = (state[:n] ^ letters[row[:n], j]) * np.uint32(16777619)
        h[rest] = state
    return h


def fnv1a(tokens: list[str], start: np.ndarray | None = None) -> np.ndarray:
    """The 32-bit FNV-1a hash of each token, from ``start`` on."""
    h = np.full(len(tokens), 2166136261, np.uint32) if start is None else start
    return _hashed_on(h, np.arange(len(tokens)), tokens, *_letters(tokens)).astype(np.int64) if tokens else np.zeros(0, np.int64)


def hashed_matrix(texts: list[str], bins: int = T.VECTOR_BINS) -> np.ndarray:
    """The hashed vectors of texts, each of length one (or zero): tokens, their Han parts and pairs of neighbours.

    Distinct tokens are hashed once; a pair goes on from its first token's hash over the second.
    """
    tokens, sizes, extra, extra_owner = [], [], [], []
    for i, text in enumerate(texts):
        found = _TOKEN.findall(text.lower())
        tokens += found
        sizes.append(len(found))
        if _HAN.search(text):
            parts = [t[k : k + n] for t in found if len(t) > 2 and _HAN.search(t) for n in (2, 3) for k in range(len(t) - n + 1)]
            extra += parts
            extra_owner += [i] * len(parts)
    if not tokens:
        return np.zeros((len(texts), bins))
    coded = pa.array(tokens, pa.string()).dictionary_encode()
    names, which, whose = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(texts)), sizes)
    letters, length = _letters(names)
    h = _hashed_on(np.full(len(names), 2166136261, np.uint32), np.arange(len(names)), names, letters, length)
    at, weight = [whose * bins + h.astype(np.int64)[which] % bins], [np.where(length[which] >= 6, 1.2, 1.0)]
    if extra:
        at.append(np.array(extra_owner) * bins + fnv1a(extra) % bins)
        weight.append(np.where(np.fromiter((len(t) >= 6 for t in extra), bool, len(extra)), 1.2, 1.0))
    first = np.flatnonzero(whose[1:] == whose[:-1])
    if len(first):
        joined = (h[which[first]] ^ np.uint32(ord("_"))) * np.uint32(16777619)
        at.append(whose[first] * bins + _hashed_on(joined, which[first + 1], names, letters, length).astype(np.int64) % bins)
        weight.append(np.full(len(first), 1.4))
    out = np.bincount(np.concatenate(at), weights=np.concatenate(weight), minlength=len(texts) * bins).reshape(len(texts), bins)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0)


def hashed_vector(text: str, bins: int = T.VECTOR_BINS) -> np.ndarray:
    """The hashed vector of one text."""
    return hashed_matrix([text], bins)[0]


def hashed_vectors(rows: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """keys, vector for every text that has a token: hashed where it is read, a batch of texts at a time, without a shuffle."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                m = hashed_matrix(batch.column("_text").to_pylist())
                some = np.flatnonzero(m.any(axis=1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * m.shape[1]), pa.array(m[some].ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(some)) for k in keys), lists], names=[*keys, "vector"])

    part = rows.select(*keys, T.text_of(text).alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema if f.name != "_text"), "vector array<double>"])
    return part.mapInArrow(made, schema)


def hashed_bins(rows: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """keys, bin, weight of the hashed vectors' bins that are not zero: no vector leaves the task that makes it."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                m = hashed_matrix(batch.column("_text").to_pylist())
                row, bin_ = np.nonzero(m)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(row)) for k in keys), pa.array(bin_), pa.array(m[row, bin_])], names=[*keys, "bin", "weight"])

    part = rows.select(*keys, T.text_of(text).alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema if f.name != "_text"), "bin long, weight double"])
    return part.mapInArrow(made, schema)


def unit(vector: Sequence[float]) -> np.ndarray:
    """``vector`` at length one, with as many numbers as it has; a vector of zeros, and one with odd numbers, is zeros."""
    v = np.asarray(vector, float)
    norm = np.linalg.norm(v)
    return v / norm if np.isfinite(norm) and norm > 0 else np.zeros(len(v))


def _asked(provider: Provider, texts: list[str], timeout: float) -> list[Sequence[float]]:
    """A provider's answer, asked ``TRIES`` times, ``timeout`` seconds each; raises what the last try raised."""
    for n in range(TRIES):
        answer: queue.SimpleQueue = queue.SimpleQueue()

        def ask(answer: queue.SimpleQueue = answer) -> None:
            try:
                answer.put((list(provider(texts)), None))
            except Exception as why:  # noqa: BLE001  whatever a provider raises is tried again and then left to the next one
                answer.put((None, why))

        # A thread that still waits when its time is up is left behind and ends with the task's process.
        threading.Thread(target=ask, daemon=True).start()
        try:
            vectors, why = answer.get(timeout=timeout)
        except queue.Empty:
            vectors, why = None, TimeoutError(f"no answer within {timeout} s")
        if why is None and len(vectors) != len(texts):
            why = ValueError(f"{len(texts)} texts, {len(vectors)} vectors")
        if why is None:
            return vectors
        if n == TRIES - 1:
            raise why
        time.sleep(PAUSE * 2**n)
    raise AssertionError


def model_of(provider: Provider) -> str:
    """The model that a provider names, if it does."""
    return str(getattr(provider, "model", ""))


def identity(name: str, model: str, size: int) -> str:
    """A digest of what vectors must have in common to be compared."""
    return hashlib.sha256("\0".join((name, model, str(size))).encode()).hexdigest()


def _answers(rows: DataFrame, text: str, name: str, provider: Provider, timeout: float) -> DataFrame:
    """``rows`` with vector and failure, written. A task whose provider fails once does not ask it again."""
    columns = rows.columns

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        failed = None
        for whole in batches:
            for lo in range(0, whole.num_rows, BATCH):
                batch = whole.slice(lo, BATCH)
                texts = [t or "" for t in batch.column(text).to_pylist()]
                vectors: list = [None] * len(texts)
                if failed is None:
                    try:
                        vectors = [unit(v).tolist() for v in _asked(provider, texts, timeout)]
                    except Exception as why:  # noqa: BLE001  a failure is data: the next provider is asked
                        failed = f"{name}: {why}"
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(vectors, pa.list_(pa.float64())), pa.array([failed] * len(texts), pa.string())], names=[*columns, "vector", "failure"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "vector array<double>", "failure string"])
    return materialise(rows.mapInArrow(made, schema), "answers")


def _chain(providers: dict[str, Provider] | None, size: int) -> list[tuple[str, Provider]]:
    return [*(providers or {}).items(), ("hashed", lambda texts: hashed_matrix(texts, size))]


def _whole(answers: DataFrame) -> tuple[int, int, str | None]:
    """Rows, their vectors' size (-1: they differ), and why not all have one."""
    found = answers.agg(F.count("*").alias("n"), F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most"), F.min("failure").alias("failure")).first()
    if found["failure"]:
        return found["n"], -1, found["failure"]
    same = found["least"] == found["most"]
    return found["n"], (found["most"] or 0) if same else -1, None if same else "vectors of different sizes"


def _named(answers: DataFrame, name: str, model: str, size: int, text: str) -> DataFrame:
    said = {"provider": name, "model": model, "identity": identity(name, model, size)}
    return answers.drop("failure").withColumns({**{c: F.lit(v) for c, v in said.items()}, "content_hash": F.sha2(T.text_of(text).cast("binary"), 256)})


def refreshed(known: DataFrame | None, rows: DataFrame, keys: list[str], text: str, providers: dict[str, Provider] | None = None, size: int = T.VECTOR_BINS, timeout: float = TIMEOUT) -> DataFrame:
    """``rows`` with vector, provider, model, identity and content_hash, all of one identity.

    Of the providers, in order, the first counts that answers for all rows with vectors of one size, whatever that is; the
    last are the library's own hashed vectors. Known vectors are kept where key, content, provider and model are as they were
    and the new ones have their size; if these have another, the provider is asked for all rows.
    """
    current = rows.withColumn("content_hash", F.sha2(T.text_of(text).cast("binary"), 256))
    for name, provider in _chain(providers, size):
        model = model_of(provider)
        if known is not None:
            kept = known.where((F.col("provider") == name) & (F.col("model") == model)).select(*keys, "content_hash", "vector")
            kept = materialise(current.join(kept, [*keys, "content_hash"]).select(*rows.columns, "vector"), "kept")
            n_kept, size_kept, _ = _whole(kept.withColumn("failure", F.lit(None).cast("string")))
            missing = current.join(kept.select(*keys), keys, "left_anti").select(*rows.columns)
            if n_kept and size_kept > 0 and (name != "hashed" or size_kept == size):
                answers = _answers(missing, text, name, provider, timeout)
                n, got, failure = _whole(answers)
                if failure is None and (n == 0 or got == size_kept):
                    return _named(answers.unionByName(kept.withColumn("failure", F.lit(None).cast("string"))), name, model, size_kept, text)
                if failure is not None and got == -1 and not failure.startswith("vectors of"):
                    continue
        answers = _answers(rows, text, name, provider, timeout)
        n, got, failure = _whole(answers)
        if failure is None:
            return _named(answers, name, model, got, text)
    raise AssertionError("the hashed vectors do not fail")


def embedded(rows: DataFrame, text: str, providers: dict[str, Provider] | None = None, size: int = T.VECTOR_BINS, timeout: float = TIMEOUT) -> DataFrame:
    """``rows`` with vectors of one identity, none of them known before."""
    return refreshed(None, rows, [], text, providers, size, timeout)


def questions(rows: DataFrame, text: str, wanted: str, providers: dict[str, Provider] | None = None, size: int = T.VECTOR_BINS, timeout: float = TIMEOUT) -> DataFrame | None:
    """``rows`` with the vectors of the provider whose identity is ``wanted``; None where none of the providers has it or answers."""
    for name, provider in _chain(providers, size):
        if name == "hashed" and identity(name, "", size) != wanted:
            continue
        answers = _answers(rows, text, name, provider, timeout)
        n, got, failure = _whole(answers)
        if failure is None and (n == 0 or identity(name, model_of(provider), got) == wanted):
            return _named(answers, name, model_of(provider), got, text)
    return None
