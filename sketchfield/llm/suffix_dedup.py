"""Removal of repeated byte strings by interval expansion on a Burrows-Wheeler transform.

Every byte goes that a string of ``LENGTH`` bytes covers which also starts in a document with a
smaller doc_id, judged on the texts as they came.

1. A window of ``LENGTH`` bytes is keyed by its minimizer, the smallest hash of its ``GRAM``-byte
   substrings, so equal windows have equal keys wherever they are.  Minimizers are gathered over
   all documents, and only windows whose minimizer occurs in two texts go on.
   Of documents with equal texts (equal SHA-256) the smallest goes on; the others go whole.
2. Runs of consecutive windows with one minimizer are strings of a few dozen bytes.  Equal strings
   collapse at once, compared byte by byte: all but the smallest document's are repeats.
3. Distinct strings meet by minimizer.  Buckets of them are joined into a text with separators; its
   Burrows-Wheeler transform is extended backwards breadth first: from the intervals of common
   prefix length l, one step derives those of l + 1, and the expansion stops at ``LENGTH``.  What
   one interval then holds are the equal windows, whose smallest document decides.
4. A minimizer with more than ``OVER`` distinct strings, or in one chunk more than its share of them
   (at the edges of a passage that a large part of the corpus shares), is not gathered in a bucket:
   its windows go one by one to where a hash of their own sends them, and are compared there byte by
   byte.

What chunks and tasks have found is shuffled in packed rows, one for each destination that has an
entry: minimizers by their hash, strings by their minimizer, removals by their document.  Entries
are never more than the strings, which grow with the input; a packed row holds one entry at least.
Every shuffled key is combined in each chunk before: what meets of a key in a task is bounded by the
number of chunks, not of documents.  Nothing is dropped for it: what a chunk decides alone is final.
Partitions follow the bytes of the input, so what a task gathers doesn't grow with it.

A null text is empty and keeps nothing; texts shorter than ``LENGTH`` have no repeats.  Rows that
repeat a doc_id are one document, neither smaller than the other; each has the repeats of its own
text, so equal rows get equal results.  Rows with a null doc_id have no smaller document, nor are
they one: they stay whole.  Texts of any length count whole; an empty table gives an empty table.
Columns besides doc_id and text are ignored by ``repeats`` and returned as they are by
``without_repeats``, where bytes that are left over from a cut character go too.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, apart, free_name, give_back, record_batch, runs, stored, without_cycle_search

LENGTH = 50
GRAM = 20
OVER = 65_536  # distinct strings of a key that a bucket compares as strings
RUN = 64  # windows in a string at most
CHUNK = 8_000_000  # characters whose findings are combined and shuffled together
TASK_BYTES = 32_000_000  # of the input, to a partition of what is gathered from it

_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    return x ^ (x >> np.uint64(29))


def gram_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k-byte substring, by doubling."""
    h, size, at, out = b.astype(np.uint64), 1, 0, None
    while True:
        if k & size:
            n = len(b) - at - size + 1
            out = h[:n] if out is None else _mix(out[:n] * _A + h[at : at + n])
            at += size
        if 2 * size > k:
            return out
        h = _mix(h[: len(h) - size] * _A + h[size:])
        size *= 2


def minimizers(b: np.ndarray, length: int, k: int) -> np.ndarray:
    """Of each window of ``length`` bytes, the smallest hash of its k-byte substrings."""
    m, width, size = gram_hashes(b, k), length - k + 1, 1
    while 2 * size <= width:
        m = np.minimum(m[: len(m) - size], m[size:])
        size *= 2
    rest = width - size
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def rotations(symbols: np.ndarray, length: int) -> np.ndarray:
    """The starts of the text's rotations, sorted by their first ``length`` symbols at least.

    The first sort is by as many symbols as a word holds, each later one by three ranks of the one before.
    """
    n = len(symbols)
    codes = np.cumsum(np.bincount(symbols) > 0)[symbols] - 1  # dense, in the same order
    bits = max(1, int(codes.max()).bit_length())
    size = 1
    key = codes.astype(np.int64)
    while 2 * size * bits <= 62:
        key = (key << (size * bits)) | np.roll(key, -size)
        size *= 2
    while True:
        order = np.argsort(key)
        if size >= length or size >= n:
            return order
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]).astype(np.int64)]))
        top = int(rank[order[-1]])
        if top == n - 1:
            return order
        wide, key = top.bit_length(), rank
        for k in range(1, 3 if 3 * wide <= 63 else 2):
            key = (key << wide) | np.roll(rank, -k * size)
        size *= 3 if 3 * wide <= 63 else 2


def intervals(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted rotations, and lcp: for neighbours, their common prefix if it is below ``length``, else ``length``.

    Backward extension of a boundary between intervals at ``p`` by a symbol gives the boundary at the
    first rotation of that symbol whose rest is at or after ``p``.
    """
    sa = rotations(symbols, length)
    n = len(sa)
    bwt = symbols[sa - 1]  # the symbol before each rotation
    order = np.argsort(bwt, kind="stable").astype(np.int32)  # order[LF(i)] = i
    column = bwt[order]
    lcp = np.full(n, length, np.int16)
    fresh = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]]))
    lcp[fresh] = 0
    block, ends = fresh.tolist(), np.append(fresh[1:], n).tolist()
    for level in range(1, length):
        if not len(fresh):
            break
        if 8 * len(fresh) * len(block) > n:  # all intervals at once
            g = np.cumsum(lcp < level, dtype=np.int32)[order]
            at = np.flatnonzero(g[1:] != g[:-1]) + 1
            at = at[lcp[at] > level]
        else:  # symbol by symbol
            at = np.concatenate([(a + i)[a + i < z] for a, z in zip(block, ends) for i in (np.searchsorted(order[a:z], fresh),)] or [fresh[:0]])
            at = np.unique(at[lcp[at] > level])
        fresh = at
        lcp[fresh] = level
    return sa, lcp


def repeated_windows(strings: list[bytes], docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, start) of the windows that also occur in a string of a smaller document, in order."""
    sizes = np.array([len(s) for s in strings], np.int64)
    text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.uint16) + np.uint16(1)
    ends = np.cumsum(sizes + 1) - 1
    text[ends] = 0  # separators, below all bytes; a window over one isn't whole
    sa, lcp = intervals(text, length)
    own = np.repeat(np.arange(len(strings), dtype=np.int32), sizes + 1)[sa]
    start = sa - (ends - sizes)[own]
    new = lcp < length
    whole = start + length <= sizes[own]
    of = np.where(whole, docs[own], np.iinfo(np.int64).max)
    least = np.minimum.reduceat(of, np.flatnonzero(new))
    hit = np.flatnonzero(whole & (least[np.cumsum(new) - 1] < of))
    own, start = own[hit], start[hit]
    at = np.lexsort((start, own))
    return own[at], start[at]


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of what (start, stop) rows cover."""
    return merged_by(np.zeros(len(spans), np.int64), spans[:, 0], spans[:, 1])[1]


def merged_by(owner: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each owner (a rising number) the maximal runs of what its spans cover: owners and (start, stop) rows."""
    if not len(owner):
        return owner, np.zeros((0, 2), np.int64)
    order = np.lexsort((start, owner))
    owner, start, stop = owner[order], start[order], stop[order]
    first = np.concatenate([[True], owner[1:] != owner[:-1]])
    lift = (np.cumsum(first) - 1) * (int(stop.max()) + 1)  # each owner beyond the one before
    reach = np.maximum.accumulate(stop + lift)
    new = first | np.concatenate([[True], start[1:] + lift[1:] > reach[:-1]])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(new) - 1)
    return owner[new], np.stack([start[new], (reach - lift)[last]], axis=1)


def _bytes_of(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


# packed rows ----------------------------------------------------------------------------------

#: Kinds of packed rows.  Minimizers known to be shared; ones to meet; removals by what decided them; strings; marks of
#: keys that go window by window; windows.
_SHARED, _POSTED, _EQUAL, _EXPANDED, _WINDOWED, _STRING, _MARK, _WINDOW = range(8)
_ROW = "kind int, p int, key binary, doc binary, id binary, a binary, z binary, bytes binary"
_COLUMNS = ("key", "doc", "id", "a", "z")


def _cut_at(values: np.ndarray | bytes, edges: np.ndarray) -> pa.Array:
    """The bytes of ``values`` between edges, which count elements."""
    width = 1 if isinstance(values, bytes) else values.itemsize
    own = pa.py_buffer(values if isinstance(values, bytes) else np.ascontiguousarray(values))
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * width).astype(np.int32)), own])


def _packed(kind: int, part: np.ndarray, columns: dict[str, np.ndarray], strings: list[bytes] | None = None) -> Iterator[pa.RecordBatch]:
    """A row for each part that has an entry: its entries' values, packed."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    part = part[order]
    edges = np.append(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), len(part))
    n = len(edges) - 1
    out: dict[str, tuple[object, pa.DataType]] = {"kind": (np.full(n, kind, np.int32), pa.int32()), "p": (part[edges[:-1]].astype(np.int32), pa.int32())}
    for c in _COLUMNS:
        out[c] = (_cut_at(columns[c][order], edges) if c in columns else pa.nulls(n, pa.binary()), pa.binary())
    if strings is None:
        out["bytes"] = (pa.nulls(n, pa.binary()), pa.binary())
    else:
        own = [strings[i] for i in order.tolist()]
        ends = np.cumsum([0, *map(len, own)])
        out["bytes"] = (_cut_at(b"".join(own), ends[edges]), pa.binary())
    yield record_batch(out)


def _unpacked(batch: pa.RecordBatch, *columns: str, dtype: type = np.int64) -> list[np.ndarray]:
    """The entries of a batch of packed rows."""
    return [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8 if c == "bytes" else dtype) for c in columns]


def _of_kind(batch: pa.RecordBatch, *kinds: int) -> pa.RecordBatch:
    return batch.filter(pa.array(np.isin(batch.column("kind").to_numpy(), kinds)))


def _part(x: np.ndarray, parts: int) -> np.ndarray:
    return (_mix(x.view(np.uint64) * _A) % np.uint64(parts)).astype(np.int64)


# minimizers -----------------------------------------------------------------------------------


def _posted(batches: Iterable[pa.RecordBatch], length: int, k: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Of (id, text): each chunk's minimizers, and for its texts the ones that two of them have."""
    for batch in batches:
        texts, ids = batch.column(1).to_pylist(), batch.column(0).to_numpy()
        for start, stop in runs(texts, CHUNK):
            found = [np.unique(minimizers(_bytes_of(t), length, k)) for t in texts[start:stop]]
            key, own = np.concatenate(found).view(np.int64), np.repeat(ids[start:stop], [len(x) for x in found])
            order = np.lexsort((own, key))
            key, own = key[order], own[order]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])])  # repeated rows
            key, own = key[new], own[new]
            first = np.concatenate([[True], key[1:] != key[:-1]])
            run = np.cumsum(first) - 1
            shared = np.bincount(run) > 1
            mine = shared[run]
            yield from _packed(_SHARED, _part(own[mine], parts), {"key": key[mine], "id": own[mine]})
            # a text that has it, and whether it is known already that two have
            yield from _packed(_POSTED, _part(key[first], parts), {"key": key[first], "id": own[first], "a": shared.astype(np.int64)})


def _met(batches: Iterable[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Minimizers that two texts have, for each of the texts."""
    posted = []
    for batch in batches:
        if (local := _of_kind(batch, _SHARED)).num_rows:
            yield local
        posted.append(_unpacked(_of_kind(batch, _POSTED), "key", "id", "a"))
    if not sum(len(x[0]) for x in posted):
        return
    key, own, known = (np.concatenate([x[i] for x in posted]) for i in range(3))
    posted.clear()
    order = np.argsort(key, kind="stable")
    key, own, known = key[order], own[order], known[order] > 0
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    # a key has two texts if one chunk says so or two chunks name different ones
    two = (np.minimum.reduceat(own, starts) != np.maximum.reduceat(own, starts)) | np.logical_or.reduceat(known, starts)
    tell = np.repeat(two, np.diff(np.append(starts, len(key)))) & ~known
    yield from _packed(_SHARED, _part(own[tell], parts), {"key": key[tell], "id": own[tell]})


def _by_text(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, keys): a row for each text."""
    got = [_unpacked(batch, "key", "id") for batch in batches]
    if not sum(len(x[0]) for x in got):
        return
    key, own = (np.concatenate([x[i] for x in got]) for i in range(2))
    order = np.argsort(own, kind="stable")
    key, own = key[order], own[order]
    edges = np.append(np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])), len(own))
    for a in range(0, len(edges) - 1, 5_000):
        cut = edges[a : a + 5_001]
        yield record_batch({"id": (own[cut[:-1]], pa.int64()), "keys": (_cut_at(key[cut[0] : cut[-1]], cut - cut[0]), pa.binary())})


# strings --------------------------------------------------------------------------------------

_TEXT = 200_000  # bytes of strings in one transform


class _Table:
    """Distinct strings, each with its key, its smallest document and the texts and positions there; spans to remove in the others."""

    def __init__(self, kind: int = _EQUAL) -> None:
        self.kind = kind  # of its removals
        self.of: dict[bytes, tuple[int, int, list[int], list[int]]] = {}
        self.gone: list[tuple[int, list[int], list[int], int]] = []

    def add(self, key: int, string: bytes, doc: int, ids: list[int], at: list[int]) -> None:
        have = self.of.get(string)
        if have is None:
            self.of[string] = key, doc, ids, at
        elif have[1] == doc:
            have[2].extend(ids)
            have[3].extend(at)
        elif have[1] < doc:
            self.gone.append((doc, ids, at, len(string)))
        else:
            self.gone.append((have[1], have[2], have[3], len(string)))
            self.of[string] = key, doc, ids, at

    def add_windows(self, string: bytes, doc: int, ids: list[int], at: list[int], length: int) -> None:
        for i in range(len(string) - length + 1):
            window = string[i : i + length]
            self.add(xxhash.xxh3_64_intdigest(window) - (1 << 63), window, doc, ids.copy(), [x + i for x in at])

    def removals(self, parts: int) -> Iterator[pa.RecordBatch]:
        n = [len(x[2]) for x in self.gone]
        doc, size = (np.repeat(np.array([x[i] for x in self.gone], np.int64), n) for i in (0, 3))
        own, at = (np.array([y for x in self.gone for y in x[i]], np.int64) for i in (1, 2))
        yield from _removals(self.kind, doc, own, at, at + size, parts)

    def rows(self, kind: int, parts: int) -> Iterator[pa.RecordBatch]:
        """An entry for each position; the string is given with its first."""
        strings, key, doc, own, at, size = [], [], [], [], [], []
        for s, (k, d, ids, places) in self.of.items():
            for i, (x, p) in enumerate(zip(ids, places)):
                strings.append(b"" if i else s)
                key.append(k)
                doc.append(d)
                own.append(x)
                at.append(p)
                size.append(0 if i else len(s))
        keys = np.array(key, np.int64)
        yield from _packed(
            kind,
            _part(keys, parts),
            {"key": keys} | {c: np.array(x, np.int64) for c, x in (("doc", doc), ("id", own), ("a", at), ("z", size))},
            strings,
        )

    def read(self, batch: pa.RecordBatch) -> None:
        """Add what ``rows`` gave."""
        for key, doc, own, at, size, raw in zip(*(batch.column(c).to_pylist() for c in (*_COLUMNS, "bytes"))):
            end, string = 0, b""
            for k, d, i, p, n in zip(*(np.frombuffer(x, np.int64).tolist() for x in (key, doc, own, at, size))):
                if n:
                    string, end = raw[end : end + n], end + n
                self.add(k, string, d, [i], [p])


def _removals(kind: int, doc: np.ndarray, own: np.ndarray, start: np.ndarray, stop: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Spans to remove in texts ``own`` of documents, merged."""
    if len(doc):
        doc, own, spans = _merged_spans(doc, own, start, stop)
        yield from _packed(kind, _part(doc, parts), {"doc": doc, "id": own, "a": spans[:, 0], "z": spans[:, 1]})


def _merged_spans(doc: np.ndarray, own: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((own, doc))
    doc, own, start, stop = doc[order], own[order], start[order], stop[order]
    first = np.concatenate([[True], (doc[1:] != doc[:-1]) | (own[1:] != own[:-1])])
    owner, spans = merged_by(np.cumsum(first) - 1, start, stop)
    return doc[first][owner], own[first][owner], spans


def _cut(batches: Iterable[pa.RecordBatch], length: int, k: int, many: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Of (doc, id, text, keys): strings of windows with these minimizers, and what each chunk decides."""
    for batch in batches:
        docs, ids, texts, keys = (c.to_pylist() for c in batch.columns)
        for first, last in runs(texts, CHUNK):
            table, windows, marks = _Table(), _Table(_WINDOWED), []
            for doc, own, text, packed in zip(docs[first:last], ids[first:last], texts[first:last], keys[first:last]):
                b = _bytes_of(text)
                raw, m = b.tobytes(), minimizers(b, length, k)
                wanted = np.sort(np.frombuffer(packed, np.uint64))
                starts = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
                stops = np.append(starts[1:], len(m))
                key = m[starts]
                on = wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key
                for a, z, h in zip(starts[on].tolist(), stops[on].tolist(), key[on].view(np.int64).tolist()):
                    for s in range(a, z, RUN):
                        table.add(h, raw[s : min(z, s + RUN) + length - 1], doc, [own], [s])
            counts = Counter(have[0] for have in table.of.values())
            marks = {key for key, n in counts.items() if n > many}
            if marks:
                for string in [s for s, have in table.of.items() if have[0] in marks]:
                    _, doc, own, at = table.of.pop(string)
                    windows.add_windows(string, doc, own, at, length)
            yield from table.removals(parts)
            yield from table.rows(_STRING, parts)
            yield from windows.removals(parts)
            yield from windows.rows(_WINDOW, parts)
            marked = np.array(sorted(marks), np.int64)
            yield from _packed(_MARK, _part(marked, parts), {"key": marked})


def _compared(batches: Iterable[pa.RecordBatch], length: int, over: int, parts: int) -> Iterator[pa.RecordBatch]:
    """What meeting by minimizer decides: spans to remove, and windows of marked keys."""
    table, windows, marked = _Table(), _Table(_WINDOWED), set()
    for batch in batches:
        marked.update(_unpacked(_of_kind(batch, _MARK), "key")[0].tolist())
        table.read(_of_kind(batch, _STRING))
    yield from table.removals(parts)
    of_key: dict[int, list[bytes]] = defaultdict(list)
    for string, have in table.of.items():
        of_key[have[0]].append(string)
    part: list[bytes] = []
    size = 0
    for key, own in of_key.items():
        if key in marked or len(own) > over:
            for s in own:
                windows.add_windows(s, *table.of[s][1:], length)
        elif len(own) > 1 and len({table.of[s][1] for s in own}) > 1:
            part += own
            size += sum(map(len, own))
            if size >= _TEXT:
                yield from _expanded(table, part, length, parts)
                part, size = [], 0
    yield from _expanded(table, part, length, parts)
    yield from windows.removals(parts)
    yield from windows.rows(_WINDOW, parts)


def _expanded(table: _Table, strings: list[bytes], length: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Spans that interval expansion decides."""
    if not strings:
        return
    have = [table.of[s] for s in strings]
    docs = np.array([h[1] for h in have], np.int64)
    own, start = repeated_windows(strings, docs, length)
    own, spans = merged_by(own.astype(np.int64), start, start + length)
    # a span for each position of its string
    n = np.array([len(h[2]) for h in have], np.int64)
    ids, at = (np.array([x for h in have for x in h[i]], np.int64) for i in (2, 3))
    each = n[own]
    which = np.repeat(np.arange(len(own)), each)
    place = np.repeat((np.cumsum(n) - n)[own], each) + np.arange(len(which)) - np.repeat(np.cumsum(each) - each, each)
    yield from _removals(_EXPANDED, docs[own][which], ids[place], at[place] + spans[which, 0], at[place] + spans[which, 1], parts)


def _met_windows(batches: Iterable[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    table = _Table(_WINDOWED)
    for batch in batches:
        table.read(batch)
    yield from table.removals(parts)


def _by_document(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, id, spans): a row for each text that loses bytes."""
    got = [_unpacked(batch, "doc", "id", "a", "z") for batch in batches]
    if not sum(len(x[0]) for x in got):
        return
    doc, own, spans = _merged_spans(*(np.concatenate([x[i] for x in got]) for i in range(4)))
    edges = np.append(np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (own[1:] != own[:-1])])), len(doc))
    for a in range(0, len(edges) - 1, 5_000):
        cut = edges[a : a + 5_001]
        yield record_batch(
            {
                "doc": (doc[cut[:-1]], pa.int64()),
                "id": (own[cut[:-1]], pa.int64()),
                "spans": (_cut_at(spans[cut[0] : cut[-1]].ravel(), 2 * (cut - cut[0])), pa.binary()),
            }
        )


# the operator ---------------------------------------------------------------------------------


def _map(df: DataFrame, f, schema: str, *args: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with without_cycle_search():
            yield from f(batches, *args)
        give_back()

    run.__name__ = f.__name__.strip("_")  # which plans show
    return df.mapInArrow(run, schema)


def _dealt(rows: DataFrame, tasks: int) -> DataFrame:
    """Packed rows, each where its ``p`` says."""
    return rows.repartitionById(tasks, F.col("p"))


def removals(
    docs: DataFrame,
    scratch: Scratch,
    length: int = LENGTH,
    k: int = GRAM,
    many: int | None = None,
    over: int = OVER,
) -> tuple[DataFrame, DataFrame, int]:
    """Packed spans to remove, of kinds by what decided them; (doc, id) of the texts that go whole; and the number of destinations."""
    spark = docs.sparkSession
    docs = docs.selectExpr(
        "CAST(doc_id AS BIGINT) AS doc",
        "CAST(text AS STRING) AS text",
    ).where(f"doc is not null and octet_length(text) >= {length}").withColumn("id", F.xxhash64("text"))
    # equal texts: one of them goes on, all but the smallest go whole
    marked = scratch.stored(docs.select("doc", "id", F.sha2("text", 256).alias("content"), F.octet_length("text").cast("long").alias("n")), "contents")
    first = marked.groupBy("content").agg(F.min("doc").alias("first"), F.min("id").alias("id"))
    copied = marked.groupBy("content").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(
        apart(F.col("content"), "string").alias("content"),
        "first",
    )
    whole = marked.select("doc", "id", "content").distinct().join(copied, "content").where("doc > first").select("doc", "id")
    total = marked.agg(F.sum("n")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    posted = _map(docs.select("id", "text"), _posted, _ROW, length, k, tasks)
    shared = _map(_dealt(posted, tasks), _met, _ROW, tasks)
    keys = _map(_dealt(shared, tasks), _by_text, "id long, keys binary")
    keys = scratch.stored(keys.join(first.select(F.col("first").alias("doc"), "id"), "id"), "minimizers", release=True)
    # a key's strings from all chunks stay in one bucket only if they are OVER at most, nearly
    many = max(4, over // (1 + total // CHUNK)) if many is None else many
    found = scratch.stored(
        _map(docs.join(keys, ["doc", "id"]).select("doc", "id", "text", "keys"), _cut, _ROW, length, k, many, tasks),
        "strings",
        release=True,
    )
    compared = scratch.stored(_map(_dealt(found.where(f"kind in ({_STRING}, {_MARK})"), tasks), _compared, _ROW, length, over, tasks), "spans", release=True)
    both = found.union(compared)
    windows = _map(_dealt(both.where(f"kind = {_WINDOW}"), tasks), _met_windows, _ROW, tasks)
    return both.where(f"kind in ({_EQUAL}, {_EXPANDED}, {_WINDOWED})").union(windows), whole, tasks


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = GRAM, many: int | None = None, over: int = OVER) -> DataFrame:
    """(doc, id, spans): of texts (id is xxhash64 of the text) of documents, packed (start, stop) pairs, null for all of it."""
    with Scratch() as scratch:
        gone, whole, tasks = removals(docs, scratch, length, k, many, over)
        spans = _map(_dealt(gone, tasks), _by_document, "doc long, id long, spans binary")
        return stored(spans.union(whole.select("doc", "id", F.lit(None).cast("binary"))), "repeats")


def _kept_bytes(text: str | None, found: bool, spans: bytes | None) -> tuple[bytes, bytes, np.ndarray]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not found:
        return raw, raw, np.zeros((0, 2), np.int64)
    pairs = np.array([[0, len(raw)]]) if spans is None else np.frombuffer(spans, np.int64).reshape(-1, 2)
    edges = [0, *pairs.ravel().tolist(), len(raw)]
    return raw, b"".join([raw[a:z] for a, z in zip(edges[::2], edges[1::2])]), pairs


def _with_spans(docs: DataFrame, spans: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with whether a row loses bytes, and which; and the names of these columns."""
    doc, own, found, which = (free_name(docs, c) for c in ("doc", "id", "found", "spans"))
    spans = spans.toDF(doc, own, which).withColumn(found, F.lit(True))
    on = (docs["doc_id"].cast("long") == spans[doc]) & (F.xxhash64(docs["text"].cast("string")) == spans[own])
    return docs.join(spans, on, "left").select(*(docs[c] for c in docs.columns), found, which), found, which


def repeats(docs: DataFrame, length: int = LENGTH, k: int = GRAM, many: int | None = None, over: int = OVER) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans and kept_sha256."""
    narrow = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text")
    joined, _, _ = _with_spans(narrow, repeated_spans(docs, length, k, many, over))

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_kept_bytes(*x) for x in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))]
            i64 = pa.int64()
            yield record_batch({
                "doc_id": (batch.column(0), i64), "n_bytes": ([len(r) for r, _, _ in rows], i64), "n_removed": ([len(r) - len(x) for r, x, _ in rows], i64),
                "n_spans": ([len(s) for _, _, s in rows], i64), "kept_sha256": ([hashlib.sha256(x).hexdigest() for _, x, _ in rows], pa.string()),
            })

    return joined.mapInArrow(each, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH, k: int = GRAM, many: int | None = None, over: int = OVER, count: str | None = None) -> DataFrame:
    """The documents with all columns, and texts without their repeats; texts without any stay as they are.

    ``count`` names a column of the texts' numbers of characters, which is set anew where a text has changed.
    """
    joined, _, _ = _with_spans(docs, repeated_spans(docs, length, k, many, over))
    n, at, names = len(docs.columns), docs.columns.index("text"), docs.columns

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(n).to_pylist()
            texts = [_kept_bytes(t, True, s)[1].decode("utf-8", "ignore") if f else t for t, f, s in zip(batch.column(at).to_pylist(), found, batch.column(n + 1).to_pylist())]
            columns = [pa.array(texts, batch.column(i).type) if i == at else batch.column(i) for i in range(n)]
            if count is not None:
                c = names.index(count)
                columns[c] = pa.array([len(t) if f else x for t, f, x in zip(texts, found, columns[c].to_pylist())], columns[c].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(each, docs.schema)
