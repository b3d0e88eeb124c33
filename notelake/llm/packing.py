"""Packing of tokenised examples into sequences, by vector bin packing.

An example (or what is left of it after its full sequences) is an item with three sizes: tokens, segments
(one) and loss-bearing tokens. A sequence has a capacity in each. The item placed next is the one, among a
pool of waiting items, whose dot product with the residual capacity is highest and which fits. When none
fits, an item is cut to fill the sequence, if the segment limit allows one more.

Documents are tokenised and packed in the task that reads them: neither texts nor ids are shuffled. A task
holds the ids of its pool, ``pool`` items of less than one sequence, and of one batch of texts. All that a
task leaves unfilled is its last sequence. Sequence ids hold the partition in the upper bits; packing is a
function of the partition's rows in order, so a repeated task gives the same sequences.

Null and empty texts give one piece with the end id alone. Very long texts fill sequences of their own and leave a rest. Of items
that tie the one that waits longest is placed. Rows that repeat are packed each. An empty table gives no pieces. Other
columns of the input, whatever they are called, are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.common import row_slices, table, text_or_empty

MAX_TOKENS = 2048
END_ID = 1
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([(c.split()[0], pa.int64()) for c in PIECE.split(", ")])

_encoders: dict[str, Callable[[str], list[int]]] = {}


def encoder(name: str) -> Callable[[str], list[int]]:
    """Ids as ``tokenizers`` gives them for the file ``name`` of the public tokenizers.

    The same vocabulary's rank file, where there is one, encodes ordinary text faster with equal ids; texts
    that hold the start of a special token go to the library itself.
    """
    if name not in _encoders:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        whole = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        _encoders[name] = lambda text: whole.encode(text, add_special_tokens=False).ids if "<|" in text else fast(text)
    return _encoders[name]


class Packer:
    """Sequences from a stream of examples. ``emit`` gets (doc_id, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, emit: Callable, max_tokens: int = MAX_TOKENS, max_segments: int = 256, max_loss: int = MAX_TOKENS, pool: int = 256, least_cut: int = 1) -> None:
        self.capacity = np.array([max_tokens, max_segments, max_loss], float)
        self.emit, self.pool, self.least_cut, self.sequence = emit, pool, least_cut, 0
        self.items: list[tuple] = []  # doc_id, start, ids, loss-bearing flags, doc_tokens
        self.sizes = np.zeros((0, 3))

    def add(self, doc_id: int | None, ids: np.ndarray, loss: np.ndarray) -> None:
        """``loss``: for each id, whether it bears loss."""
        most = int(self.capacity[0])
        start, n = 0, len(ids)
        while n - start >= most and loss[start : start + most].sum() <= self.capacity[2]:
            self.emit(doc_id, start, ids[start : start + most], n, self.sequence, 0)
            self.sequence += 1
            start += most
        while start < n:
            end = self.fitting(loss[start:], self.capacity) + start
            self.wait(doc_id, start, ids[start:end], loss[start:end], n)
            start = end
        while len(self.items) >= self.pool:
            self.fill()

    def fitting(self, loss: np.ndarray, room: np.ndarray) -> int:
        """The longest prefix that fits into ``room``."""
        part = loss[: int(room[0])]
        return int(np.searchsorted(np.cumsum(part), room[2], side="right")) if len(part) and part.sum() > room[2] else len(part)

    def wait(self, doc_id: int | None, start: int, ids: np.ndarray, loss: np.ndarray, n: int) -> None:
        self.items.append((doc_id, start, ids, loss, n))
        self.sizes = np.vstack([self.sizes, [[len(ids), 1, loss.sum()]]])

    def take(self, k: int) -> tuple:
        self.sizes = np.delete(self.sizes, k, axis=0)
        return self.items.pop(k)

    def fill(self) -> None:
        """One sequence out of the waiting items."""
        room, offset = self.capacity.copy(), 0
        while self.items and room[0] >= 1 and room[1] >= 1:
            fits = np.flatnonzero((self.sizes <= room).all(axis=1))
            if len(fits):
                scores = (self.sizes[fits] / self.capacity) @ (room / self.capacity)
                doc_id, start, ids, loss, n = self.take(int(fits[np.argmax(scores)]))
            else:
                k = int(np.argmin(self.sizes[:, 0]))  # the rest of a cut item should stay short
                cut = self.fitting(self.items[k][3], room)
                if cut < self.least_cut:
                    break
                doc_id, start, ids, loss, n = self.take(k)
                self.wait(doc_id, start + cut, ids[cut:], loss[cut:], n)
                ids, loss = ids[:cut], loss[:cut]
            self.emit(doc_id, start, ids, n, self.sequence, offset)
            offset += len(ids)
            room -= [len(ids), 1, loss.sum()]
        self.sequence += 1

    def close(self) -> None:
        while self.items:
            self.fill()


def pack_documents(documents: DataFrame, tokenizer: str = "byte_bpe_50k", prompt: str | None = None, max_tokens: int = MAX_TOKENS, max_segments: int = 256, max_loss: int = MAX_TOKENS, pool: int = 256) -> DataFrame:
    """One row for each piece of each document of ``documents(doc_id, text)``, with its place in a sequence.

    Of a document all ids bear loss but the first, which nothing predicts. For instruction data ``prompt``
    names a column whose ids come before those of the text and bear no loss.
    """
    rows = documents.select("doc_id", text_or_empty().alias("text"), text_or_empty(prompt).alias("prompt") if prompt else F.lit("").alias("prompt"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base = encoder(tokenizer), TaskContext.get().partitionId() << 40
        out: list[tuple] = []
        packer = Packer(lambda d, s, ids, n, q, o: out.append((d, s, len(ids), zlib.crc32(ids.tobytes()), n, base + q, o)), max_tokens, max_segments, max_loss, pool)

        def flush() -> pa.RecordBatch:
            cols = zip(*out, strict=True)
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=ARROW)
            out.clear()
            return batch

        for batch in batches:
            for part in row_slices(batch, "text"):
                for doc_id, text, before in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "prompt")), strict=True):
                    asked = encode(before) if before else []
                    ids = np.array([*asked, *encode(text), END_ID], "<u4")
                    loss = np.ones(len(ids), np.int64)
                    loss[: max(1, len(asked))] = 0
                    packer.add(doc_id, ids, loss)
                if out:
                    yield flush()
        packer.close()
        if out:
            yield flush()

    return rows.mapInArrow(packed, PIECE)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
