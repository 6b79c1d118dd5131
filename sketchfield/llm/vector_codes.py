"""Product codes of vectors, by Elkan's form of Lloyd's algorithm in integers.

A vector becomes integers, is cut into equal parts, and each part position has a codebook.  A round assigns
every part to its nearest entry and moves each entry to the mean of its parts.

Each part carries an upper bound of the distance to its entry and a lower bound of that to every entry of
its codebook.  The state is a table in the shared folder, written once a round, so a lost executor repeats its task
and no round is done again.  When entries have moved, upper bounds grow by the movement of the part's own
entry and lower ones shrink by that of each.  An entry is passed over only if it is farther than the upper bound
*strictly*, by its lower bound or by half its distance from the part's entry; floating numbers are rounded to
the safe side.  Whatever is left is compared by exact integer distances, ties going to the lower index, so the
codes are those of plain search.  Lower bounds are the upper halves of 32-bit floats: cutting rounds down.

A task adds up what its parts give to each entry and writes it as one row of the state; only these sums, of
``parts * entries`` entries, are aggregated, and only the codebooks come to the driver.

Rows whose vector is null, or has a null or non-finite component, are dropped.  All others must have one length that
the parts divide, and components below ``LARGEST`` in magnitude, so that distances fit in 64 bits; else the job
fails with a message.  With fewer vectors than entries, there are as many entries as vectors.  The first entries go by
vec_id, then by vector; null vec_ids come last.  Repeated rows count each.  An empty table gives an empty table.
Columns other than vec_id, embedding and label are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, apart, give_back, record_batch, stored

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Magnitude of components; up to it, squared distances of parts of 500 positions are below 2^63.
LARGEST = 1 << 14
_ROWS = 16_384  # vectors of one step

_STATE = "vec_id long, label string, x binary, near binary, upper binary, lower binary, sums array<long>"


def up(x: np.ndarray) -> np.ndarray:
    """32-bit floats that are not smaller."""
    y = x.astype(np.float32)
    return np.where(y < x, np.nextafter(y, np.float32(np.inf)), y)


def down(x: np.ndarray) -> np.ndarray:
    """The upper halves of 32-bit floats that are not larger, for numbers from 0 on."""
    y = x.astype(np.float32)
    y = np.where(y > x, np.nextafter(y, np.float32(0)), y)
    return (np.ascontiguousarray(y).view(np.uint32) >> 16).astype(np.uint16)


def full(half: np.ndarray) -> np.ndarray:
    return (half.astype(np.uint32) << 16).view(np.float32)


def _roots(squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the square roots of integers, from below and above."""
    root = np.sqrt(squares.astype(np.float64))
    return root * (1 - 1e-12), root * (1 + 1e-12)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a.astype(np.int64) - b
    return (d * d).sum(-1)


class Step:
    """One round for the parts at every position: ``books`` are the entries now, ``before`` those that the bounds are of."""

    def __init__(self, books: np.ndarray, before: np.ndarray | None) -> None:
        self.books = books  # parts, entries, positions
        self.moved = None if before is None else _roots(_squares(books, before))[1]
        between = _roots(_squares(books[:, :, None, :], books[:, None, :, :]))[0] / 2
        self.half = between
        self.compared = 0

    def assign(self, x: np.ndarray, near: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """New (near, upper, lower) of vectors (n, parts, positions)."""
        n, (parts, entries, _) = len(x), self.books.shape
        near, new_up, new_low = near.copy(), upper.astype(np.float64), np.empty((n, parts, entries), np.uint16)
        for p in range(parts):
            book, own, bound = self.books[p], near[:, p].astype(np.int64), new_up[:, p]
            low = full(lower[:, p]).astype(np.float64)
            if self.moved is not None:
                bound = bound + self.moved[p][own]
                low = np.maximum(low - self.moved[p] * (1 + 1e-12), 0)
            others = np.arange(entries) != own[:, None]
            # strictly farther entries are passed over
            may = others & (low <= bound[:, None]) & (self.half[p][own] <= bound[:, None])
            rows = np.flatnonzero(may.any(1))
            if len(rows):
                best = _squares(x[rows, p], book[own[rows]])
                self.compared += len(rows)
                below, bound[rows] = _roots(best)
                low[rows, own[rows]] = below
                i, j = np.nonzero(may[rows] & (low[rows] <= bound[rows, None]) & (self.half[p][own[rows]] <= bound[rows, None]))
                exact = _squares(x[rows[i], p], book[j])
                self.compared += len(i)
                low[rows[i], j] = _roots(exact)[0]
                # the least (distance, index) of the entry that a part has and of those compared
                at, entry, far = np.concatenate([np.arange(len(rows)), i]), np.concatenate([own[rows], j]), np.concatenate([best, exact])
                order = np.lexsort((entry, far, at))
                first = order[np.flatnonzero(np.concatenate([[True], at[order][1:] != at[order][:-1]]))]
                near[rows, p] = entry[first]
                bound[rows] = _roots(far[first])[1]
            new_up[:, p], new_low[:, p] = bound, down(low)
        return near, up(new_up), new_low

    def sums(self, x: np.ndarray, near: np.ndarray) -> np.ndarray:
        """(parts, entries, positions + 1): sums of the parts of each entry, and their number."""
        parts, entries, positions = self.books.shape
        out = np.zeros((parts, entries, positions + 1), np.int64)
        for p in range(parts):
            which = near[:, p].astype(np.int64)
            out[p, :, -1] = np.bincount(which, minlength=entries)
            np.add.at(out[p, :, :-1], which, x[:, p])
        return out


def moved_books(books: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Entries at the floors of their means; one without parts stays."""
    count = sums[:, :, -1:]
    return np.where(count > 0, sums[:, :, :-1] // np.maximum(count, 1), books)


def _of_lists(column: pa.Array, parts: int) -> np.ndarray:
    """Integers of (n, parts, positions); the lists have no nulls."""
    n = len(column)
    lengths = set(column.value_lengths().to_pylist())
    if len(lengths) > 1 or min(lengths, default=0) % parts:
        raise ValueError(f"vectors must have one length that {parts} divides, not {sorted(lengths)[:5]}")
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    if len(x) and np.abs(x).max() >= LARGEST:
        raise ValueError(f"components must be below {LARGEST} in magnitude")
    return np.floor(x * SCALE).astype(np.int32).reshape(n, parts, min(lengths, default=0) // parts)


def _of_binary(column: pa.Array, kind: type, *shape: int) -> np.ndarray:
    """The numbers of a column of binary values of one size."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def _binary(x: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(x)
    size = data.nbytes // max(1, len(data))
    offsets = np.arange(len(data) + 1, dtype=np.int32) * np.int32(size)
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _clean(vectors: DataFrame) -> DataFrame:
    """vec_id, label as text, and the vectors that stay."""
    chosen = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return chosen.where(F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))


def _parts_of(batch: pa.RecordBatch, books: np.ndarray, fresh: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    parts, entries, positions = books.shape
    n = batch.num_rows
    if fresh:
        x = _of_lists(batch.column(2), parts)
        if x.shape[2] != positions:
            raise ValueError(f"vectors must have one length, not {x.shape[2] * parts} and {positions * parts}")
        return x, np.zeros((n, parts), np.uint8), np.full((n, parts), np.inf, np.float32), np.zeros((n, parts, entries), np.uint16)
    return (
        _of_binary(batch.column(2), np.int32, parts, positions), _of_binary(batch.column(3), np.uint8, parts),
        _of_binary(batch.column(4), np.float32, parts), _of_binary(batch.column(5), np.uint16, parts, entries),
    )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, _ROWS):
            yield batch.slice(a, _ROWS)


def _round(state: DataFrame, books: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """The state after a round, and a row of sums for each task."""
    fresh = before is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, total = Step(books, before), None
        for batch in _pieces(batches):
            x, near, upper, lower = _parts_of(batch, books, fresh)
            near, upper, lower = step.assign(x, near, upper, lower)
            found = step.sums(x, near)
            total = found if total is None else total + found
            yield record_batch(
                {
                    "vec_id": (batch.column(0), pa.int64()), "label": (batch.column(1), pa.string()), "x": (_binary(x), pa.binary()), "near": (_binary(near), pa.binary()),
                    "upper": (_binary(upper), pa.binary()), "lower": (_binary(lower), pa.binary()), "sums": (pa.nulls(batch.num_rows, pa.list_(pa.int64())), pa.list_(pa.int64())),
                }
            )
        if total is not None:
            one = {c: ([None], t) for c, t in (("vec_id", pa.int64()), ("label", pa.string()), ("x", pa.binary()), ("near", pa.binary()), ("upper", pa.binary()), ("lower", pa.binary()))}
            yield record_batch(one | {"sums": ([total.ravel().tolist()], pa.list_(pa.int64()))})
        give_back()

    return state.mapInArrow(run, _STATE)


def _vectors_of(state: DataFrame) -> DataFrame:
    return state.where("x is not null").drop("sums")


def _next(state: DataFrame, books: np.ndarray) -> np.ndarray:
    cells = state.where("sums is not null").select(F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    sums = np.zeros((*books.shape[:2], books.shape[2] + 1), object)
    for r in cells.collect():  # as many as the codebooks have numbers
        sums.ravel()[r["i"]] = int(r["v"])
    return moved_books(books, sums).astype(np.int64)


def _finished(state: DataFrame, books: np.ndarray, before: np.ndarray | None) -> DataFrame:
    fresh = before is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = Step(books, before)
        for batch in _pieces(batches):
            x, near, upper, lower = _parts_of(batch, books, fresh)
            near, _, _ = step.assign(x, near, upper, lower)
            error = sum(_squares(x[:, p], books[p][near[:, p].astype(np.int64)]) for p in range(books.shape[0]))
            yield record_batch({"vec_id": (batch.column(0), pa.int64()), "label": (batch.column(1), pa.string()), "code": ([c.tobytes().hex() for c in near], pa.string()), "error": (error, pa.int64())})
        give_back()

    return state.mapInArrow(run, "vec_id long, label string, code string, error long")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components of all entries in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def first_books(clean: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """(parts, entries, positions): the parts of the vectors of the smallest vec_ids."""
    rows = clean.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").toArrow()["embedding"].combine_chunks()
    return _of_lists(rows, parts).astype(np.int64).transpose(1, 0, 2)


def trained(vectors: DataFrame, scratch: Scratch, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, np.ndarray | None]:
    """The state after the last round, the codebooks, and those that the state's bounds are of."""
    if not 1 <= entries <= 256 or parts < 1 or rounds < 0:
        raise ValueError("a code has at least one part, and one byte for each")
    state = _clean(vectors)
    books, before = first_books(state, parts, entries), None
    for _ in range(rounds if books.shape[1] else 0):
        state = scratch.stored(_round(state, books, before), "codes")
        scratch.drop(keep=1)
        before, books = books, _next(state, books)
        state = _vectors_of(state)
    return state, books, before


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Per vector that stays: vec_id, code, error, label_error and codebooks_sha256."""
    with Scratch() as scratch:
        state, books, before = trained(vectors, scratch, parts, entries, rounds)
        if not books.shape[1]:
            return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
        coded = stored(_finished(state, books, before), "coded")
    key = F.when(F.col("label").isNull(), "n").otherwise(F.concat(F.lit("v"), "label"))
    labels = coded.groupBy(key.alias("key")).agg(F.sum("error").alias("label_error")).select(apart(F.col("key"), "string").alias("key"), "label_error")
    return coded.withColumn("key", key).join(labels, "key").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def decoded(code: str, books: np.ndarray) -> np.ndarray:
    """The vector that a code stands for."""
    near = np.frombuffer(bytes.fromhex(code), np.uint8)
    return np.concatenate([books[p][e] for p, e in enumerate(near)]) / SCALE


