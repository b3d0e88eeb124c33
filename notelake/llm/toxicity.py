"""Toxicity by a support vector machine with a subsequence string kernel and Nystroem landmarks.

The kernel compares two stretches of text by the subsequences of ``ORDER`` symbols that they share, each
weighted by ``DECAY`` to the power of the length it spans, ``SPAN`` at most. A symbol between two letters of an
insult, or a letter put into it, lengthens the span of some subsequences and leaves others: the stretch stays
similar. A stretch begins at any symbol before a letter and takes the subsequences that begin within ``STARTS``
symbols, so that an insult within a longer word has a stretch of its own. Accented letters are symbols of their
own: words may differ by an accent alone. Letters that stand alone one after another (s p e l t out, or with
stars or full stops between) are read as one word.

Landmarks are stretches from the training documents; the kernel between them makes the Nystroem map, in which
a linear support vector machine (squared hinge) is fitted. Labels are of documents: a toxic document has a
toxic stretch in some sentence, a clean one has none. So the stretches that stand for toxic documents are
those that the machine rates highest, in rounds that begin with word beginnings more frequent in toxic
documents than in clean ones; the highest stretch of each clean document is added from round to round. So that
stretches with a letter or a separator put in, or within a longer word, are known, training adds such stretches
to those it finds.

As the kernel is a sum over subsequences, the fitted function is one weight for each subsequence: landmarks and
their coefficients fold into a table of ``SYMBOLS`` ** ``ORDER`` numbers. It is all that tasks get, and a text of any
length is scored by look-ups and a running sum, in pieces of ``PIECE`` characters. A document's score is the higher
of two logistics: of its highest stretch, and of its two highest that do not overlap, as what means little once may
mean much when it is repeated. Both are fitted on labelled documents that the machine fitted for it has not seen.

The fit takes a bounded sample of labelled rows: at most ``most_toxic`` and ``most_clean`` documents for each of two
parts, in the order of a hash of the id; where an id has several texts, the one of the least digest stands for it.
Sampled texts are whole, stay in tasks and are rated there; the driver gets at most ``TOXIC_STRETCHES`` stretches of
13 symbols for a toxic document and ``CLEAN_STRETCHES`` and one more a round for a clean one, and a margin for each.

Scores see the text alone. Null and empty texts have no stretch and get the score of the lowest margin. Very long texts are
rated in pieces that overlap, whole. Without labels of both classes every score is 0. Equal texts have equal scores
(ties at the threshold count as toxic); rows that repeat are scored each; an empty table gives an empty result; labels
that contradict each other count as toxic. Other columns, whatever they are called, are ignored or, by ``without_toxic``, kept.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.common import materialise, row_slices, table, text_or_empty

ORDER, SPAN, STARTS, DECAY = 3, 5, 8, 0.7
THRESHOLD = 0.7
LOWEST = -3.0
#: Stretches that the driver gets of a labelled document (see above), and characters of a text that are rated at once.
TOXIC_STRETCHES, CLEAN_STRETCHES, PIECE, OVERLAP = 4, 3, 1 << 18, 128
#: Stretches of a class among which landmarks are looked for.
CANDIDATES = 2_000
#: Lengths of word beginnings, and how far above chance one must be in toxic documents to start with.
BEGINNINGS, LEAST_Z = (4, 5, 6), 3.0
#: The two parts of the sample that each machine learns from; the first two are calibrated on the other part.
MACHINES = ((0,), (1,), (0, 1))

#: Symbols: 0 for what separates words, 1 to 26 for letters, then accented letters, other letters, digits, the end mark.
_ACCENTED = ("ä", "àáâãåæ", "é", "è", "êë", "ìíîï", "ö", "òóôõø", "ü", "ùúû", "ñ", "ç", "ß", "ýÿ")
_OTHER = 27 + len(_ACCENTED)
_DIGITS, _END = _OTHER + 1, _OTHER + 2
SYMBOLS = _END + 1
#: Ends a text: so many marks that no stretch reaches the next one.
_BREAK = b"\x01" * (STARTS + SPAN)
_ASCII = np.zeros(256, np.uint8)
_ASCII[97:123] = np.arange(1, 27)
_ASCII[48:58] = _DIGITS
_ASCII[1] = _END
_AFTER_C3 = np.full(256, _OTHER, np.uint8)
for _i, _letters in enumerate(_ACCENTED):
    for _c in _letters:
        _AFTER_C3[_c.encode()[1]] = 27 + _i

#: The places of a subsequence's symbols after its first, and the weight of its span.
PATTERNS = [(places, DECAY ** (places[-1] + 1)) for places in itertools.combinations(range(1, SPAN), ORDER - 1)]
_WIDTH = STARTS + SPAN


def symbols(texts: list[str]) -> np.ndarray:
    """The symbols of all texts, lower-cased, separators in a row as one; each text begins with a separator and ends with end marks."""
    joined = b"".join(b" " + t.lower().replace("\x01", " ").encode("utf-8", "replace") + _BREAK for t in texts)
    data = np.frombuffer(joined, np.uint8)
    out = _ASCII[data]
    wide = np.flatnonzero(data >= 128)
    if len(wide):
        before = data[wide - 1]
        second = (data[wide] < 192) & (before >= 192)
        out[wide] = np.where(second, np.where(before == 0xC3, _AFTER_C3[data[wide]], _OTHER), 255)
        # Punctuation beyond ASCII (dashes, quotes) separates words as well.
        out[wide[second & (before == 0xC2)]] = 0
        out[wide[second & (before == 0xE2)]] = 0
        out = out[out != 255]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    out = out[keep]
    # Letters that stand alone in a row: the separator between two of them goes.
    word = (out != 0) & (out != _END)
    alone = np.zeros(len(out), bool)
    alone[1:-1] = word[1:-1] & (out[:-2] == 0) & ~word[2:]
    between = np.zeros(len(out), bool)
    between[1:-1] = (out[1:-1] == 0) & alone[:-2] & alone[2:]
    return out[~between]


def subsequences(sym: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For each pattern the number of the subsequence that begins at each place, and the pattern's weight."""
    wide = np.concatenate([sym, np.full(SPAN, _END, np.uint8)]).astype(np.int32)
    scaled = [wide * SYMBOLS ** (ORDER - 1 - k) for k in range(ORDER)]
    n = len(sym)
    for places, weight in PATTERNS:
        number = scaled[0][:n].copy()
        for k, at in enumerate(places, 1):
            number += scaled[k][at : at + n]
        yield number, weight


def values(sym: np.ndarray, weights: np.ndarray, chunk: int = 1 << 18) -> np.ndarray:
    """What the subsequences that begin at each place weigh together, a bounded number of places at a time."""
    out = np.zeros(len(sym), np.float32)
    for lo in range(0, len(sym), chunk):
        piece = out[lo : lo + chunk]
        for number, weight in subsequences(sym[lo : lo + chunk + SPAN]):
            piece += np.float32(weight) * weights[number[: len(piece)]]
    return out


def pieces(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Texts in pieces that overlap, and the number of each piece's text."""
    out, of = [], []
    for i, t in enumerate(texts):
        for lo in range(0, max(1, len(t) - OVERLAP), PIECE):
            out.append(t[lo : lo + PIECE + OVERLAP])
            of.append(i)
    return out, np.array(of, np.int64)


class Corpus:
    """Some texts as symbols, with the places where stretches begin and the text of each."""

    def __init__(self, texts: list[str]) -> None:
        self.n = len(texts)
        parts, of = pieces(texts)
        self.sym = symbols(parts)
        ends = np.flatnonzero((self.sym == _END) & np.r_[True, self.sym[:-1] != _END])
        after = np.r_[self.sym[1:], np.uint8(_END)] if len(self.sym) else self.sym
        self.at = np.flatnonzero((self.sym != _END) & (after != 0) & (after != _END))
        self.owner = of[np.searchsorted(ends, self.at)]
        self.word = self.sym[self.at] == 0

    def ratings(self, model: Model) -> np.ndarray:
        n = len(self.sym)
        upto = np.zeros(n + STARTS + 1)
        np.cumsum(values(self.sym, model.weights), dtype=np.float64, out=upto[1 : n + 1])
        upto[n + 1 :] = upto[n]
        return upto[self.at + STARTS] - upto[self.at] + model.bias

    def beginnings(self, length: int) -> np.ndarray:
        """The first letters of the word at each stretch that begins with one, as numbers; 0 at other stretches."""
        out = np.full(len(self.at), length, np.int64)
        for k in range(1, length + 1):
            out = out * SYMBOLS + self.sym[np.minimum(self.at + k, len(self.sym) - 1)]
        return np.where(self.word, out, 0)

    def windows(self, which: np.ndarray) -> np.ndarray:
        """The symbols of some stretches, with those that their last subsequences reach."""
        return np.concatenate([self.sym, np.full(_WIDTH, _END, np.uint8)])[self.at[which][:, None] + np.arange(_WIDTH)]

    def best(self, rating: np.ndarray, most: int, least: float = -np.inf, near: float | None = None) -> np.ndarray:
        """The ``most`` stretches rated highest of each text, over ``least`` and, with ``near``, that share of the text's highest."""
        some = np.flatnonzero(rating > least)
        if near is not None and len(some):
            top = np.full(self.n, -np.inf)
            np.maximum.at(top, self.owner[some], rating[some])
            some = some[rating[some] >= near * top[self.owner[some]]]
        order = some[np.lexsort((some, -rating[some], self.owner[some]))]
        owner = self.owner[order]
        return order[np.arange(len(order)) - np.searchsorted(owner, owner) < most]


def disturbed(rows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Stretches as someone writes them to pass a filter: a letter or a separator put in, or within a longer word."""
    out = rows.copy()
    for i, row in enumerate(rows):
        if rng.random() < 0.3:
            out[i, 0] = rng.integers(1, 27)
        else:
            k = int(rng.integers(2, 6))
            out[i, k + 1 :] = row[k:-1]
            out[i, k] = 0 if rng.random() < 0.5 else rng.integers(1, 27)
    return out


def features(rows: np.ndarray) -> np.ndarray:
    """The numbers of each stretch's subsequences, those of one pattern after those of another."""
    wide = rows.astype(np.int32)
    numbers = []
    for places, _ in PATTERNS:
        number = wide[:, :STARTS] * SYMBOLS ** (ORDER - 1)
        for k, j in enumerate(places, 1):
            number = number + wide[:, j : j + STARTS] * SYMBOLS ** (ORDER - 1 - k)
        numbers.append(number)
    return np.concatenate(numbers, axis=1)


_FEATURE_WEIGHTS = np.repeat([w for _, w in PATTERNS], STARTS).astype(np.float32)


class Landmarks:
    """Landmark stretches as columns over the subsequences that occur in them, each column of length one."""

    def __init__(self, rows: np.ndarray) -> None:
        numbers = features(rows)
        self.known = np.unique(numbers)
        self.known = self.known[self.known % SYMBOLS != _END]
        self.place = np.full(SYMBOLS**ORDER, len(self.known), np.int32)
        self.place[self.known] = np.arange(len(self.known))
        self.maps = np.zeros((len(self.known) + 1, len(rows)), np.float32)  # the last row is of all that occurs in none
        np.add.at(self.maps, (self.place[numbers], np.arange(len(rows))[:, None]), np.broadcast_to(_FEATURE_WEIGHTS, numbers.shape))
        self.maps[-1] = 0
        self.maps /= np.maximum(np.sqrt((self.maps**2).sum(axis=0)), 1e-9)

    def kernel(self, rows: np.ndarray, block: int = 256) -> np.ndarray:
        """The kernel between stretches and landmarks."""
        out = np.zeros((len(rows), self.maps.shape[1]), np.float32)
        for lo in range(0, len(rows), block):
            for weight, place in zip(_FEATURE_WEIGHTS, self.place[features(rows[lo : lo + block])].T, strict=True):
                out[lo : lo + block] += weight * self.maps[place]
        return out

    def whitening(self) -> np.ndarray:
        """What turns the kernel with landmarks into coordinates: the inverse root of the kernel between landmarks."""
        value, vector = np.linalg.eigh((self.maps.T @ self.maps).astype(float))
        return (vector / np.sqrt(np.maximum(value, 1e-3))).astype(np.float32)

    def folded(self, coefficients: np.ndarray) -> np.ndarray:
        """One weight for each subsequence: the sum over landmarks."""
        out = np.zeros(SYMBOLS**ORDER, np.float32)
        out[self.known] = (self.maps @ coefficients.astype(np.float32))[:-1]
        return out


def varied(rows: np.ndarray, most: int) -> np.ndarray:
    """``most`` of some stretches that differ: each next one is that which those before it explain least (pivoted Cholesky)."""
    numbers = features(rows)
    numbers = np.where(numbers % SYMBOLS == _END, 0, numbers)
    vector = np.zeros(SYMBOLS**ORDER, np.float32)

    def against(i: int) -> np.ndarray:
        np.add.at(vector, numbers[i], _FEATURE_WEIGHTS)
        vector[0] = 0
        out = vector[numbers] @ _FEATURE_WEIGHTS
        vector[numbers[i]] = 0
        return out

    # A stretch's own length: equal numbers add up.
    order = np.argsort(numbers, axis=1, kind="stable")
    ranked, weight = np.take_along_axis(numbers, order, 1), _FEATURE_WEIGHTS[order]
    group = np.cumsum(np.c_[np.zeros((len(rows), 1), int), ranked[:, 1:] != ranked[:, :-1]], axis=1) + np.arange(len(rows))[:, None] * numbers.shape[1]
    sums = np.bincount(group.ravel(), weights=np.where(ranked == 0, 0, weight).ravel(), minlength=numbers.size).reshape(len(rows), -1)
    length = np.sqrt(np.maximum((sums**2).sum(axis=1), 1e-9))
    left = np.ones(len(rows))
    basis = np.zeros((0, len(rows)))
    chosen: list[int] = []
    while len(chosen) < min(most, len(rows)):
        i = int(np.argmax(left))
        if left[i] < 1e-3:
            break
        row = against(i) / (length * length[i]) - basis[:, i] @ basis
        basis = np.vstack([basis, row / np.sqrt(left[i])])
        left = np.maximum(left - basis[-1] ** 2, 0)
        left[i] = 0
        chosen.append(i)
    return rows[chosen]


@dataclass
class Model:
    """What scoring needs: a weight for each subsequence, the bias, and the two logistics' coefficients."""

    weights: np.ndarray
    bias: float
    one: np.ndarray | None = None
    two: np.ndarray | None = None

    def margins(self, texts: list[str]) -> np.ndarray:
        """The highest stretch of each text, and the highest of those that do not overlap it."""
        out = np.full((len(texts), 2), LOWEST)
        corpus = Corpus(texts) if texts else None
        if corpus is None or not len(corpus.at):
            return out
        rating = corpus.ratings(self)
        first = np.flatnonzero(np.r_[True, corpus.owner[1:] != corpus.owner[:-1]])
        size = np.diff(np.r_[first, len(rating)])
        highest = np.maximum.reduceat(rating, first)
        where = np.flatnonzero(rating == np.repeat(highest, size))
        place = corpus.at[where[np.searchsorted(where, first)]]
        rating[np.abs(corpus.at - np.repeat(place, size)) < STARTS] = LOWEST
        out[corpus.owner[first]] = np.maximum(LOWEST, np.c_[highest, np.maximum.reduceat(rating, first)])
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.one is None:
            return np.zeros(len(texts))
        margin = self.margins(texts)
        return np.maximum(logistic(margin[:, :1], self.one), logistic(margin, self.two))


def fit_machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 25, block: int = 4096) -> tuple[np.ndarray, float]:
    """The linear machine of squared hinge loss, by Newton's method: coefficients and bias. Sums are made block by block."""
    d = x.shape[1]
    w = np.zeros(d + 1)
    active = np.ones(len(x), bool)
    for _ in range(rounds):
        left, right = np.eye(d + 1), np.zeros(d + 1)
        left[-1, -1] = 1e-3
        for lo in range(0, len(x), block):
            some = active[lo : lo + block]
            part = np.c_[x[lo : lo + block][some], np.ones(int(some.sum()), np.float32)].astype(float)
            heavy = part * cost[lo : lo + block][some, None]
            left += part.T @ heavy
            right += heavy.T @ y[lo : lo + block][some]
        w = np.linalg.solve(left, right)
        now = y * (x @ w[:-1].astype(np.float32) + w[-1]) < 1
        if (now == active).all():
            break
        active = now
    return w[:-1], float(w[-1])


def logistic(margin: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin @ w[:-1] + w[-1], -40, 40)))


def fit_logistic(margin: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes and offset of the logistic that gives labels from margins, with Platt's targets."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.c_[margin, np.ones(len(margin))]
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = logistic(margin, w)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(len(w)), x.T @ (p - target) + 1e-3 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def trained(good: np.ndarray, bad: np.ndarray, landmarks: int, rng: np.random.Generator) -> Model:
    """The machine from stretches that stand for toxic documents and stretches of clean ones."""
    changed, half = disturbed(good, rng), landmarks // 2
    marks = Landmarks(np.concatenate([varied(good[rng.permutation(len(good))[:CANDIDATES]], half), varied(bad[rng.permutation(len(bad))[:CANDIDATES]], half)]))
    whiten = marks.whitening()
    x = np.concatenate([marks.kernel(rows) @ whiten for rows in (good, changed, bad)])
    y = np.r_[np.ones(2 * len(good)), -np.ones(len(bad))]
    cost = np.r_[np.full(len(good), 500 / len(good)), np.full(len(good), 200 / len(good)), np.full(len(bad), 1000 / len(bad))]
    w, bias = fit_machine(x, y, cost)
    return Model(marks.folded(whiten @ w), bias)


def remainder(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def labelled_sample(documents: DataFrame, labels: DataFrame, most_toxic: int, most_clean: int) -> DataFrame:
    """part, toxic, text: whole texts of a bounded number of labelled documents, written to the shared folder.

    Part 0 are ids of remainder 0 and part 1 those of remainder 2. Of each part and class the first by a hash of the id.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("part", F.when(remainder(F.col("doc_id")) == 0, 0).when(remainder(F.col("doc_id")) == 2, 1)).where("part is not null")
    chosen = None
    for part, (toxic, most) in itertools.product((0, 1), ((1, most_toxic), (0, most_clean))):
        some = known.where((F.col("part") == part) & (F.col("toxic") == toxic)).orderBy(F.xxhash64("doc_id")).limit(most)
        chosen = some if chosen is None else chosen.unionByName(some)
    chosen = materialise(chosen, "toxicity-ids")  # at most 2 * (most_toxic + most_clean) rows
    rows = documents.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")
    one = rows.groupBy("doc_id", "part", "toxic").agg(F.min(F.struct(F.md5(F.col("text").cast("binary")).alias("digest"), "text"))["text"].alias("text"))
    parts = max(1, documents.sparkSession.sparkContext.defaultParallelism)
    return materialise(one.repartition(parts, "doc_id").select("part", "toxic", "text"), "toxicity-sample")


def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, Corpus]]:
    """part, toxic and the corpus of every slice of the sample's rows."""
    for batch in batches:
        for rows in row_slices(batch, "text", 250_000):
            yield rows.column("part").to_numpy(), rows.column("toxic").to_numpy(), Corpus(rows.column("text").to_pylist())


def first_ratings(sample: DataFrame, sizes: np.ndarray) -> list[dict[int, float]]:
    """For each machine the word beginnings that are much more frequent, in documents, in its toxic than in its clean ones."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, toxic, corpus in batches_of(batches):
            for length in BEGINNINGS:
                code = corpus.beginnings(length)
                some = np.flatnonzero(code)
                order = some[np.lexsort((corpus.owner[some], code[some]))]
                c, o = code[order], corpus.owner[order]
                new = np.r_[True, (c[1:] != c[:-1]) | (o[1:] != o[:-1])] if len(c) else np.zeros(0, bool)
                c, o = c[new], o[new]
                yield pa.RecordBatch.from_arrays([pa.array(c), pa.array((part[o] * 2 + toxic[o]).astype(np.int32))], names=["code", "kind"])

    counts = sample.mapInArrow(counted, "code long, kind int").groupBy("code").agg(*[F.sum((F.col("kind") == k).cast("long")).alias(f"k{k}") for k in range(4)])
    ratings = []
    for parts in MACHINES:
        n0, n1 = (max(1.0, float(sum(sizes[p, t] for p in parts))) for t in (0, 1))
        a = sum(F.col(f"k{2 * p + 1}") for p in parts) / n1
        b = sum(F.col(f"k{2 * p}") for p in parts) / n0
        z = (a - b) / F.sqrt((a * (1 - a) + 1 / n1) / n1 + (b * (1 - b) + 1 / n0) / n0)
        ratings.append(F.when(a > 4 * b, z).otherwise(0.0))
    found = counts.select("code", *[z.alias(f"z{m}") for m, z in enumerate(ratings)])
    # The most telling beginnings alone start the rounds; documents without any of them join in later ones.
    top = found.where(F.greatest(*[F.col(f"z{m}") for m in range(len(MACHINES))]) > LEAST_Z).collect()
    return [{r["code"]: r[f"z{m}"] for r in top if r[f"z{m}"] > LEAST_Z} for m in range(len(MACHINES))]


def stretches_of(sample: DataFrame, models: list[Model] | None, first: list[dict[int, float]]) -> dict[tuple[int, int], np.ndarray]:
    """(machine, class): the stretches that stand for its documents, as the given models (or, at first, the beginnings) rate them."""
    shared = sample.sparkSession.sparkContext.broadcast((models, first))

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, first = shared.value
        for part, toxic, corpus in batches_of(batches):
            for m, parts in enumerate(MACHINES):
                if models is None:
                    known = np.array(sorted(first[m]), np.int64)
                    z = np.array([first[m][c] for c in known.tolist()])
                    rating = np.zeros(len(corpus.at))
                    for length in BEGINNINGS if len(known) else ():
                        code = corpus.beginnings(length)
                        at = np.minimum(np.searchsorted(known, code), len(known) - 1)
                        rating = np.maximum(rating, np.where(known[at] == code, z[at], 0))
                else:
                    rating = corpus.ratings(models[m])
                of_machine = np.isin(part[corpus.owner], parts)
                is_toxic = toxic[corpus.owner] == 1
                good = corpus.best(np.where(of_machine & is_toxic, rating, -np.inf), TOXIC_STRETCHES, 0.0, 0.7)
                if models is None:
                    spread = np.flatnonzero(of_machine & ~is_toxic & corpus.word)
                    owner = corpus.owner[spread]
                    begin, size = np.searchsorted(owner, owner), np.searchsorted(owner, owner, side="right") - np.searchsorted(owner, owner)
                    nth = np.arange(len(spread)) - begin
                    bad = spread[np.isin(nth, 0) | (nth * CLEAN_STRETCHES // np.maximum(size, 1) != (nth - 1) * CLEAN_STRETCHES // np.maximum(size, 1))]
                else:
                    bad = corpus.best(np.where(of_machine & ~is_toxic, rating, -np.inf), 1)
                yield pa.RecordBatch.from_arrays([pa.array([m, m], pa.int32()), pa.array([1, 0], pa.int32()), pa.array([corpus.windows(x).tobytes() for x in (good, bad)], pa.binary())], names=["machine", "toxic", "windows"])

    found: dict[tuple[int, int], list[np.ndarray]] = {(m, k): [np.zeros((0, _WIDTH), np.uint8)] for m in range(len(MACHINES)) for k in (0, 1)}
    for r in sample.mapInArrow(rated, "machine int, toxic int, windows binary").collect():
        found[r["machine"], r["toxic"]].append(np.frombuffer(r["windows"], np.uint8).reshape(-1, _WIDTH))
    # In an order of their own: tasks come back in any.
    return {key: (rows := np.concatenate(x))[np.lexsort(rows.T[::-1])] for key, x in found.items()}


def unseen_margins(sample: DataFrame, models: list[Model]) -> tuple[np.ndarray, np.ndarray]:
    """Margin and label of every sampled document, by the machine that has not seen its part."""
    shared = sample.sparkSession.sparkContext.broadcast(models)

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in row_slices(batch, "text", 250_000):
                part, texts = rows.column("part").to_numpy(), rows.column("text").to_pylist()
                margin = np.where(part[:, None] == 0, shared.value[1].margins(texts), shared.value[0].margins(texts))
                yield pa.RecordBatch.from_arrays([*map(pa.array, margin.T.copy()), rows.column("toxic").cast(pa.int32())], names=["m1", "m2", "toxic"])

    found = np.array(sorted(map(tuple, sample.mapInArrow(rated, "m1 double, m2 double, toxic int").collect())), float).reshape(-1, 3)
    return found[:, :2], found[:, 2]


def fit(documents: DataFrame, labels: DataFrame, most_toxic: int = 800, most_clean: int = 1_600, landmarks: int = 384, rounds: int = 3, seed: int = 7) -> Model:
    """A model from a sample of labelled documents with remainders 0 and 2, bounded for each; those with 1 are held out."""
    sample = labelled_sample(documents, labels, most_toxic, most_clean)
    sizes = np.zeros((2, 2))
    for r in sample.groupBy("part", "toxic").count().collect():
        sizes[r["part"], r["toxic"]] = r["count"]
    if not sizes[:, 1].sum() or not sizes[:, 0].sum():
        return Model(np.zeros(SYMBOLS**ORDER, np.float32), LOWEST)
    first = first_ratings(sample, sizes)
    models: list[Model] | None = None
    negative: dict[int, np.ndarray] = {}
    for _ in range(rounds):
        found, after = stretches_of(sample, models, first), []
        for m in range(len(MACHINES)):
            good = found[m, 1]
            negative[m] = np.unique(np.concatenate([negative[m], found[m, 0]]), axis=0) if m in negative else found[m, 0]
            if len(good) and len(negative[m]):
                after.append(trained(good, negative[m], landmarks, np.random.default_rng(seed)))
            else:
                after.append(models[m] if models else Model(np.zeros(SYMBOLS**ORDER, np.float32), LOWEST))
        models = after
    model = models[-1]
    # A part without toxic documents has taught its machine nothing: the whole machine stands in for it.
    judges = [models[m] if models[m].weights.any() else model for m in (0, 1)]
    margin, toxic = unseen_margins(sample, judges)
    model.one, model.two = fit_logistic(margin[:, :1], toxic), fit_logistic(margin, toxic)
    return model


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every whole text of ``documents(doc_id, text)``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select("doc_id", text_or_empty().alias("text"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text", 250_000):
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(shared.value.scores(part.column("text").to_pylist()), pa.float64())], names=["doc_id", "score"])

    return rows.mapInArrow(made, "doc_id long, score double")


def without_toxic(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents`` whose text scores under ``threshold``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out, held, size = [], [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= 250_000:
                out.append(shared.value.scores(held))
                held, size = [], 0
        return pd.Series(np.concatenate([*out, shared.value.scores(held)]))

    return documents.where(score(text_or_empty()) < threshold)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scores = scored(documents, fit(documents, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
