"""Hashes of words and of runs of words, for whole Arrow batches of texts at a time.

A word is a run of letters and digits; all bytes beyond ASCII count as letters. Texts are lower-cased first.
The hash of a word is a polynomial over its bytes, from differences of one running sum over the batch, so
that no Python code runs for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Bytes are hashed as odd numbers that differ, so that no byte is a zero digit.
_DIGIT = (np.arange(256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A well-mixed 64-bit hash of 64-bit integers (the finaliser of SplitMix64)."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] from 64-bit hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        n = max(n, (1 << 18) + 4096)
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p)
    return _POWERS[0], _POWERS[1]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (no nulls) and where each begins, with the end of the last."""
    texts = texts.cast(pa.large_string()) if pa.types.is_string(texts.type) else texts
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def _word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; ``bounds`` are places where a word cannot go on."""
    inside = IS_WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = bounds[(bounds > 0) & (bounds < len(data))]
    first[cut] |= inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cut - 1] |= inside[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(texts: pa.Array, chunk: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every word: hash, number of its text, start and end (bytes from the start of the first text)."""
    data, offsets = text_bytes(pc.utf8_lower(texts))
    if not len(data):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    starts, ends = _word_spans(data, offsets[1:-1])
    hashes = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):  # words in runs of about ``chunk`` bytes, so that memory stays bounded
        base = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, base + chunk, side="right")))
        size = int(ends[hi - 1] - base)
        up, down = _powers(size + 1)
        run = np.zeros(size + 1, np.uint64)
        np.cumsum(_DIGIT[data[base : base + size]] * up[:size], out=run[1:])
        s, e = starts[lo:hi] - base, ends[lo:hi] - base
        hashes[lo:hi] = (run[e] - run[s]) * down[s]
        lo = hi
    return mixed(hashes), np.searchsorted(offsets, starts, side="right") - 1, starts, ends


def shingles(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and number of text of every run of ``width`` words. A text with fewer words has one run of them all."""
    hashes, owner, _, _ = words(texts)
    n = len(texts)
    counts = np.bincount(owner, minlength=n)
    out, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(hashes) >= width:
        size = len(hashes) - width + 1
        whole = owner[:size] == owner[width - 1 :]
        run = np.zeros(size, np.uint64)
        for j in range(width):
            run = (run + hashes[j : j + size]) * _BASE
        out, of = mixed(run[whole], width), owner[:size][whole]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        first = np.searchsorted(owner, short)
        run = np.zeros(len(short), np.uint64)
        for j in range(width - 1):
            some = counts[short] > j
            run[some] = (run[some] + hashes[first[some] + j]) * _BASE
        out, of = np.concatenate([out, mixed(run, width + 1)]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        out, of = out[order], of[order]
    return out, of


def by_text(owner: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """For each of ``n`` texts the range of its entries in an array sorted by ``owner``."""
    ends = np.cumsum(np.bincount(owner, minlength=n))
    return zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)
