"""Exact duplicates by counting quotient filters, verified byte by byte.

1. Each task makes a counting quotient filter of its texts' 64-bit fingerprints: the top bits of a
   fingerprint are its range, the next ones its quotient, the rest its remainder.  A filter keeps for each
   range the lengths of its quotients' runs in unary, the remainders in order, and counters where a fingerprint
   came more than once.  Nothing of a fingerprint is lost, so filters of any sizes merge without error.
2. A task merges all filters of one range by their sorted remainders and adds the counters.  A task of any
   number of copies sends one entry for them, and the range has about 16 * sqrt(rows) entries.
3. Fingerprints with a count above one set bits of a bitmap of at most ``ROUTE_BITS``.  A second pass over the
   texts lets only those go on whose bits are set; all others are alone.  A full bitmap lets more texts go
   on, which changes the cost and never the result.
4. Texts that go on are compared whole: they are grouped by fingerprint and bytes, in each task first, and
   joined with their groups by fingerprint and bytes.  Fingerprints that meet by chance make a group each.

Texts are equal if they are the same after lower-casing A-Z; null counts as empty, and empty texts are equal.  Of
equal texts the row with the largest doc_id stays.  Rows that repeat a doc_id and its text are one document: they
count in ``group_size`` and share ``kept``.  A row without a doc_id goes if its text has one; of a
text that has none all rows stay, with a null keep_id.  Texts of any length are compared whole.  An empty
table gives an empty table.  Columns other than doc_id and text are ignored; ``kept_documents`` returns them all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import register_profile
from ..operators import membership
from ..plans import sizing
from ._common import Scratch, apart, free_name, give_back, map_arrow, record_batch, stored

#: Bits of the bitmap that routes texts, 8 MB at most.
ROUTE_BITS = 1 << 26
#: Fingerprints that a task holds before it merges equal ones.
_HELD = 1 << 20
_HEAD = np.dtype([("n", "<u4"), ("q", "u1"), ("width", "u1")])

# a fingerprint is a hash already: its halves are the two of a pair
register_profile("halves", lambda key, seed, number: F.shiftrightunsigned(key, 32) if number == 2 else key.bitwiseAND(F.lit(0xFFFFFFFF)))


def normal(text: bytes | None) -> bytes:
    """A text with A-Z lower-cased; null as empty."""
    return b"" if text is None else text.lower()


def _fingerprints(texts: list[bytes], bits: int) -> np.ndarray:
    prints = np.fromiter(map(xxhash.xxh3_64_intdigest, texts), np.uint64, len(texts))
    return prints if bits == 64 else prints >> np.uint64(64 - bits) << np.uint64(64 - bits)


def _below(prints: np.ndarray, range_bits: int) -> np.ndarray:
    """Fingerprints without the bits of their range."""
    return prints << np.uint64(range_bits)


def pack(prints: np.ndarray, counts: np.ndarray, range_bits: int = 0) -> bytes:
    """A filter of sorted distinct fingerprints of one range."""
    n, q = len(prints), max(1, int(len(prints)).bit_length())
    low = _below(prints, range_bits)
    quotient = (low >> np.uint64(64 - q)).astype(np.int64)
    slots = np.zeros(n + (1 << q), bool)  # a one for each entry of a run, a zero for its end
    slots[np.arange(n) + quotient] = True
    rest = max(0, 64 - range_bits - q)
    remainder = (low << np.uint64(q)) >> np.uint64(64 - rest) if rest else np.zeros(n, np.uint64)
    size = -(-rest // 8)
    several = counts > 1
    width = next(w for w in (1, 2, 4, 8) if not several.any() or int(counts.max()) < 1 << 8 * w)
    head = np.array([(n, q, width)], _HEAD)
    tail = np.ascontiguousarray(remainder.astype("<u8").view(np.uint8).reshape(n, 8)[:, :size])
    return b"".join((head.tobytes(), np.packbits(slots).tobytes(), tail.tobytes(), np.packbits(several).tobytes(), counts[several].astype(f"<u{width}").tobytes()))


def unpack(data: bytes, of_range: int = 0, range_bits: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The sorted fingerprints of a filter and their counts."""
    n, q, width = (int(x) for x in np.frombuffer(data, _HEAD, 1)[0])
    at, rest = _HEAD.itemsize, max(0, 64 - range_bits - q)
    size, slots = -(-rest // 8), n + (1 << q)
    quotient = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, -(-slots // 8), at), count=slots)) - np.arange(n)
    at += -(-slots // 8)
    remainder = np.zeros((n, 8), np.uint8)
    remainder[:, :size] = np.frombuffer(data, np.uint8, n * size, at).reshape(n, size)
    at += n * size
    several = np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), at), count=n).astype(bool)
    counts = np.ones(n, np.int64)
    counts[several] = np.frombuffer(data, f"<u{width}", int(several.sum()), at + -(-n // 8))
    prints = (quotient.astype(np.uint64) << np.uint64(rest)) | remainder.view("<u8").reshape(n)
    return (prints | np.uint64(of_range) << np.uint64(64 - range_bits) if range_bits else prints), counts


def summed(prints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints in order, with the sums of their counts."""
    order = np.argsort(prints, kind="stable")
    prints, counts = prints[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]])) if len(prints) else np.zeros(0, np.int64)
    return prints[first], np.add.reduceat(counts, first) if len(first) else counts


def range_bits_for(rows: int) -> int:
    """Bits of a fingerprint that tell ranges apart: about sqrt(rows) / 16 ranges."""
    return max(0, rows.bit_length() // 2 - 4)


def partial_filters(docs: DataFrame, range_bits: int, bits: int = 64) -> DataFrame:
    """(range, filter): each task's filter, a row for each range in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        fresh: list[np.ndarray] = []
        waiting = 0
        for batch in batches:
            fresh.append(_fingerprints([normal(t) for t in batch.column(0).cast(pa.binary()).to_pylist()], bits))
            waiting += batch.num_rows
            del batch
            if waiting >= max(_HELD, len(held)):
                held, counts = summed(np.concatenate([held, *fresh]), np.concatenate([counts, np.ones(waiting, np.int64)]))
                fresh, waiting = [], 0
        held, counts = summed(np.concatenate([held, *fresh]), np.concatenate([counts, np.ones(waiting, np.int64)]))
        which = (held >> np.uint64(64 - range_bits)).astype(np.int64) if range_bits else np.zeros(len(held), np.int64)
        starts = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]])) if len(held) else np.zeros(0, np.int64)
        for block in range(0, len(starts), 1_000):
            rows = [(int(which[a]), pack(held[a:z], counts[a:z], range_bits)) for a, z in zip(starts[block : block + 1_000].tolist(), [*starts[block + 1 : block + 1_000].tolist(), int(starts[block + 1_000]) if block + 1_000 < len(starts) else len(held)])]
            yield record_batch({"range": ([r for r, _ in rows], pa.int64()), "filter": ([f for _, f in rows], pa.binary())})
        give_back()

    return docs.select("text").mapInArrow(run, "range long, filter binary")


def merged_filters(filters: DataFrame, range_bits: int) -> DataFrame:
    """(range, filter): the filters of each range in one, with their counters added."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        which = int(pdf["range"].iloc[0])
        parts = [unpack(f, which, range_bits) for f in pdf["filter"]]
        return pd.DataFrame({"range": [which], "filter": [pack(*summed(*(np.concatenate([p[i] for p in parts]) for i in (0, 1))), range_bits)]})

    return filters.groupBy("range").applyInPandas(merge, "range long, filter binary")


def entries(filters: DataFrame, range_bits: int, least: int = 1) -> DataFrame:
    """(fp, n) of the fingerprints of merged filters that came so often at least."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [unpack(f, r, range_bits) for r, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            fp, n = (np.concatenate([x[i] for x in found]) for i in (0, 1))
            return record_batch({"fp": (fp[n >= least].view(np.int64), pa.int64()), "n": (n[n >= least], pa.int64())})

        return each

    return map_arrow(filters, make, "fp long, n long")


def _routed(docs: DataFrame, repeated: DataFrame, bits: int, scratch: Scratch) -> DataFrame:
    """doc_id, text_sha256, fp and text; the last two are null unless the fingerprint may be among the repeated."""
    n = max(1, repeated.count())
    m = min(ROUTE_BITS, max(1 << 16, 1 << (16 * n - 1).bit_length()))
    spec = sizing.with_params(m, min(8, sizing.optimal_hash_count(m, n)), profile="halves")
    sc = docs.sparkSession.sparkContext
    route = sc.broadcast(membership.bitmap(membership.build(repeated, "fp", spec), m // 64))

    def make():
        on = route.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [normal(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            fp = _fingerprints(texts, bits)
            goes = np.ones(len(fp), bool)
            for _, at in membership.slots([(fp & np.uint64(0xFFFFFFFF)).astype(np.int64), (fp >> np.uint64(32)).astype(np.int64)], spec):
                goes &= (on[at >> 6] >> (at & 63)) & 1 == 1
            sha = [hashlib.sha256(t).hexdigest() for t in texts]
            return record_batch(
                {
                    "doc_id": (batch.column(0), pa.int64()),
                    "text_sha256": (sha, pa.string()),
                    "fp": (pa.array(fp.view(np.int64), mask=~goes), pa.int64()),
                    "text": ([t if g else None for t, g in zip(texts, goes.tolist())], pa.string()),
                }
            )

        return each

    table = scratch.stored(map_arrow(docs, make, "doc_id long, text_sha256 string, fp long, text string"), "routed")
    route.destroy()
    return table


def exact_duplicates(docs: DataFrame, bits: int = 64) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept and text_sha256.  ``bits`` of a fingerprint count; fewer let more texts be compared."""
    docs = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text")
    range_bits = range_bits_for(docs.count())
    with Scratch() as scratch:
        merged = merged_filters(partial_filters(docs, range_bits, bits), range_bits)
        repeated = scratch.stored(entries(merged, range_bits, least=2), "repeated")
        routed = _routed(docs, repeated, bits, scratch)
        several = routed.where("text is not null")
        groups = several.groupBy("fp", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
        groups = groups.select(apart(F.col("fp")).alias("fp"), "text", "keep_id", "group_size")
        keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
        out = several.join(groups, ["fp", "text"], "left").select(
            "doc_id",
            keep.alias("keep_id"),
            F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
            keep.eqNullSafe(F.col("doc_id")).alias("kept"),
            "text_sha256",
        )
        alone = routed.where("text is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
        return stored(alone.union(out), "exact")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that stay, one of each group of equal texts, with all columns; doc_id tells documents apart."""
    gone = exact_duplicates(docs).where("not kept and doc_id is not null").select(F.col("doc_id").alias(key := free_name(docs, "gone"))).distinct()
    return docs.join(gone, docs["doc_id"] == gone[key], "left_anti")
