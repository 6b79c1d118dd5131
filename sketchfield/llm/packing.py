"""Bounded-space online best-fit packing of token sequences.

Documents are encoded, ended with a separator id and, only if longer than the capacity, cut into
full pieces and a shorter last one.  Pieces are dealt by a hash of their place to tasks of about
``rows_per_task`` documents; there they arrive in the order of that hash (so a repeated task gives
the same result), wait in a buffer of ``LOOKAHEAD`` arrivals, and leave it longest first.  Each is
packed online into one of at most ``OPEN_BINS`` open bins.  An integer serves as a bitset with a
bit for each amount of free space that some open bin has: the best bin for a piece is at the
lowest set bit not below the piece's length, and when too many bins are open, the one at the
lowest bit, the fullest, closes.  A full bin closes at once.

Null and empty texts are documents of the separator alone.  Ties (equal lengths, equal free
space) go by the order of arrival; null doc_ids are dealt evenly.  Repeated rows are packed once for each row; they may have
the same doc_id and piece.  A null doc_id is packed like any other.  Texts of any length are
packed whole.  An empty table gives an empty table; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_arrow, record_batch, runs, texts_of
from .word_bpe import load

CAPACITY = 2048
OPEN_BINS = 1024
LOOKAHEAD = 4096  # arrivals that are sorted before they are packed
ROWS_PER_TASK = 50_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"


class BestFit:
    """Bounded-space best-fit: ``place`` gives a piece's bin and its offset there."""

    def __init__(self, capacity: int, open_bins: int) -> None:
        self.capacity, self.open_bins = capacity, open_bins
        self._by_free: dict[int, deque[int]] = defaultdict(deque)
        self._bits = 0
        self._open = 0
        self.bins = 0
        self.closed = 0  # of these, closed for another one to open

    def _take(self, free: int) -> int:
        own = self._by_free[free]
        out = own.popleft()
        if not own:
            self._bits ^= 1 << free
        self._open -= 1
        return out

    def place(self, length: int) -> tuple[int, int]:
        fitting = self._bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            number, free = self.bins, self.capacity
            self.bins += 1
        left = free - length
        if left:
            if self._open == self.open_bins:
                self._take((self._bits & -self._bits).bit_length() - 1)
                self.closed += 1
            own = self._by_free[left]
            if not own:
                self._bits |= 1 << left
            own.append(number)
            self._open += 1
        return number, self.capacity - free


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, separator: int = 0, with_ids: bool = False) -> DataFrame:
    """The pieces of every document, with the CRC-32 of their ids and, if asked for, the ids."""

    def make():
        bpe = load(tokenizer)
        end = np.array([separator], "<u4").tobytes()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, row, piece, start, length, crc, ids = texts_of(batch.column(1)), [], [], [], [], [], []
            step, i = 4 * capacity, 0
            for a, b in runs(texts):
                for raw in bpe.encode(texts[a:b]):
                    raw += end
                    for n, at in enumerate(range(0, len(raw), step)):
                        part = raw[at : at + step]
                        row.append(i)
                        piece.append(n)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(np.frombuffer(part, "<u4").astype(np.int32))
                    i += 1
            columns = {
                "doc_id": (batch.column(0).take(pa.array(row, pa.int64())), pa.int64()),
                "piece": (piece, pa.int32()),
                "start": (start, pa.int64()),
                "length": (length, pa.int64()),
                "ids_crc32": (crc, pa.int64()),
            }
            return record_batch(columns | ({"ids": (ids, pa.list_(pa.int32()))} if with_ids else {}))

        return each

    return map_arrow(docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text"), make, PIECES + ", ids array<int>" * with_ids)


def best_fit(found: DataFrame, tasks: int, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, lookahead: int = LOOKAHEAD) -> DataFrame:
    """Pack rows of ``pieces``; adds sequence_id and offset.

    ``tasks`` bounds how many rows meet in one task.  Sequence ids are unique over tasks.
    """
    names = found.columns

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, fit = TaskContext.get().partitionId() << 40, BestFit(capacity, open_bins)
        for batch in batches:
            for first in range(0, batch.num_rows, lookahead):
                waiting = batch.slice(first, lookahead)
                length = waiting.column("length").to_numpy()
                where = np.empty((len(length), 2), np.int64)
                for i in np.argsort(-length, kind="stable").tolist():
                    where[i] = fit.place(int(length[i]))
                yield pa.RecordBatch.from_arrays(
                    [*(waiting.column(i) for i in range(len(names))), pa.array(base + where[:, 0]), pa.array(where[:, 1])],
                    names=[*names, "sequence_id", "offset"],
                )

    place = F.xxhash64(F.coalesce("doc_id", F.monotonically_increasing_id()), "piece")
    dealt = found.repartition(tasks, place).sortWithinPartitions(F.xxhash64("doc_id", "piece", F.lit(1)), "doc_id", "piece", "ids_crc32", "length")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields)
    return dealt.mapInArrow(pack, f"{fields}, sequence_id long, offset long")


def packed(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    open_bins: int = OPEN_BINS,
    rows_per_task: int = ROWS_PER_TASK,
    with_ids: bool = False,
) -> DataFrame:
    """Pack whole documents; with ids, the rows of a sequence in order of offset make it up."""
    tasks = max(1, -(-docs.select("doc_id").count() // rows_per_task))
    return best_fit(pieces(docs, tokenizer, capacity, 0, with_ids), tasks, capacity, open_bins)
