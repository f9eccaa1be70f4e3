"""Harmonic packing of token sequences.

Lengths fall into classes by the reciprocal of the capacity: class k has lengths in (C/(k+1), C/k], and each of its bins
takes exactly k pieces. Full windows of a document are pieces of class 1. What is left is first cut at the largest
reciprocal floor(C/k) that it reaches, twice, so that bins fill up almost wholly; the short last bit joins its class.
Every worker fills its bins alone, without a shuffle. Bins that stay open at a worker's end are joined end to end and cut
at the capacity, and the very last, part-full sequence is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import bounded_batches
from tessella.llm.tokens import AT_ONCE, END_ID, MEMO, default_tokenizer, encoder

CAPACITY = 1024
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PER_TASK = 1 << 36


def cuts(n: int, capacity: int = CAPACITY, exact: int = 2) -> list[int]:
    """Lengths of the pieces of a document of ``n`` ids."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    for _ in range(exact):
        if rest and capacity // -(-capacity // rest) < rest:
            out.append(capacity // -(-capacity // rest))
            rest -= out[-1]
    return out + [rest] * bool(rest)


class Packer:
    """Bins of one worker. At most k - 1 pieces of a class k wait, so the memory is bounded by the capacity's square."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY):
        self._open: dict[int, list[tuple]] = {}
        self._next, self._capacity = first_sequence, capacity
        self.rows: list[tuple] = []

    def _sequence(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self._next, at))
            at += len(ids)
        self._next += 1

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        start = 0
        for n in cuts(len(ids), self._capacity):
            piece, k = (doc, start, ids[start : start + n], len(ids)), self._capacity // n
            start += n
            if k == 1:
                self._sequence([piece])
                continue
            waiting = self._open.setdefault(k, [])
            waiting.append((piece[0], piece[1], piece[2].copy(), piece[3]))
            if len(waiting) == k:
                self._sequence(self._open.pop(k))

    def finish(self) -> None:
        left = [p for k in sorted(self._open) for p in self._open[k]]
        self._open = {}
        total = sum(len(p[2]) for p in left)
        sizes = [self._capacity] * (total // self._capacity) + [1 << b for b in range(total.bit_length(), -1, -1) if (total % self._capacity) >> b & 1]
        left.reverse()
        for size in sizes:
            now: list[tuple] = []
            while size:
                doc, start, ids, n = left.pop()
                if len(ids) > size:
                    left.append((doc, start + size, ids[size:], n))
                    ids = ids[:size]
                now.append((doc, start, ids, n))
                size -= len(ids)
            self._sequence(now)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, memo: int = MEMO, at_once: int = AT_ONCE) -> DataFrame:
    """One row per piece of each document's ids (null text: empty, so only the end id).

    Null and repeated ids pack like any others; an empty table gives no rows; further columns are not read. A task that
    runs again gives the same rows, as numbers of sequences start from the number of its partition. ``memo`` and
    ``at_once`` trade a worker's memory for speed (see ``tokens.Encoder``) and change no row.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(path, memo, at_once)
        packer = Packer(TaskContext.get().partitionId() * _PER_TASK, capacity)

        def flush() -> pa.RecordBatch:
            rows, packer.rows = packer.rows, []
            names = [x.split()[0] for x in _PIECES.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

        for key, ids in encode.documents(batches, end_id):
            packer.add(key, ids)
            if len(packer.rows) >= 20_000:
                yield flush()
        packer.finish()
        if packer.rows:
            yield flush()

    return bounded_batches(docs).select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, _PIECES)
