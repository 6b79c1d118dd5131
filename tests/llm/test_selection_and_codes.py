"""Importance resampling, product codes and exact duplicates, each against a plain version."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sketchfield.llm import importance, quotient_dedup, vector_codes
from sketchfield.llm._common import Scratch

ODD = "vec_id long, embedding array<float>, label int, code string, error long, key string"


def lowered(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# importance resampling ------------------------------------------------------------------------


def plain_draw(docs: list[tuple], target: list[str | None], orders: int = 1, buckets: int = 10_000, least: int = 20, percent: int = 10) -> list[tuple]:
    """(doc_id, n_features, weight, score, rank) by loops."""

    def runs(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
        grams = [" ".join(words[i : i + n]) for n in range(1, orders + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(g.encode()) % buckets for g in grams]

    found = [(i, *runs(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in target for b in runs(x)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    rows = []
    for i, n_words, f in found:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words))
    may = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = may[: percent * len(may) // 100]
    ranks: dict[int, list[int]] = {}
    for place, r in enumerate(drawn, 1):
        ranks.setdefault(r[0], []).append(place)
    return sorted([(*r[:4], ranks[r[0]].pop(0) if ranks.get(r[0]) and r[4] >= least else None) for r in rows], key=repr)


@pytest.mark.parametrize(("orders", "percent"), [(1, 10), (1, 60), (3, 60), (2, 100)])
def test_resampling_against_loops(spark, odd, orders, percent):
    target = spark.createDataFrame([("one TWO Three", 1), (None, 2), ("é été w5x5", 3)], "text string, doc_id int")
    got = importance.resampled(odd, target, orders=orders, percent=percent, buckets=500)
    want = plain_draw([(r["doc_id"], r["text"]) for r in odd.collect()], ["one TWO Three", None, "é été w5x5"], orders, 500, percent=percent)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert importance.resampled(odd.limit(0), target).count() == 0
    assert importance.resampled(odd, target.limit(0)).count() == odd.count()


def test_windows_are_cut(spark):
    """Runs that go on beyond a window are found once."""
    text = " ".join(f"w{i}" for i in range(25))
    docs = spark.createDataFrame([(1, text), (1, text), (2, "a b"), (3, "")], "doc_id long, text string")
    whole = sorted(map(tuple, importance.features(docs, 3).drop("row").collect()), key=repr)
    for chunk in (4, 7, 24):
        assert sorted(map(tuple, importance.features(docs, 3, chunk).drop("row").collect()), key=repr) == whole
    assert len(whole) == 2 * (25 + 24 + 23) + 3 + 1 and (3, None, None) in whole
    with pytest.raises(ValueError, match="runs"):
        importance.features(docs, 4, 4)


def test_words_are_ascii_letters_digits_and_beyond(spark):
    text = "".join(map(chr, range(0x250))) + " ÉtÉ K ß \U0001f600x A" + " Z"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [r["word"] for r in importance.positions(docs).orderBy("pos").collect()]
    assert got == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def test_drawn_documents_keep_their_columns(spark, odd):
    target = spark.createDataFrame([("one two three",)], "text string")
    drawn = importance.drawn_documents(odd, target, percent=50)
    assert drawn.columns == odd.columns and 0 < drawn.count() < odd.count()


# product codes --------------------------------------------------------------------------------


def plain_codes(rows: list[tuple], parts: int, entries: int, rounds: int) -> tuple[dict, str]:
    kept = sorted(((i is None, i or 0, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: r[:3])
    x = [[math.floor(4096 * float(np.float32(c))) for c in v] for _, _, v, _ in kept]
    d = len(x[0]) // parts
    cut = [[tuple(v[p * d : (p + 1) * d]) for p in range(parts)] for v in x]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b))
    near = lambda v, p: min(range(len(books[p])), key=lambda e: (far(v[p], books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            own = [near(v, p) for v in cut]
            for e in range(len(books[p])):
                mine = [v[p] for v, o in zip(cut, own) if o == e]
                if mine:
                    books[p] = [*books[p][:e], tuple(sum(c) // len(mine) for c in zip(*mine)), *books[p][e + 1 :]]
                # the assignment of this round is fixed before entries move
    out = []
    for (none, i, _, label), v in zip(kept, cut):
        c = [near(v, p) for p in range(parts)]
        out.append((None if none else i, bytes(c).hex(), sum(far(v[p], books[p][e]) for p, e in enumerate(c)), label))
    sums = Counter()
    for r in out:
        sums[r[3]] += r[2]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((*r[:3], sums[r[3]], digest) for r in out), key=repr)


def vectors(seed: int, n: int, size: int, levels: int) -> list[tuple]:
    """Few levels make many ties."""
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) / 4 - 1 for x in rng.integers(0, levels, size)], None if i % 5 == 0 else int(i % 3)) for i in rng.permutation(n)]
    return [*rows, rows[0], (None, rows[1][1], 2), (n + 1, None, 1), (n + 2, [math.nan] * size, 1), (n + 3, [math.inf] + [0.0] * (size - 1), None), (n + 4, [None] * size, 0)]


@pytest.mark.parametrize(("n", "parts", "entries", "rounds", "levels"), [(150, 4, 6, 6, 3), (60, 2, 16, 3, 9), (9, 8, 16, 2, 30), (80, 1, 5, 0, 4), (200, 2, 16, 9, 100)])
def test_codes_against_loops(spark, n, parts, entries, rounds, levels):
    rows = vectors(n, n, 8, levels)
    table = spark.createDataFrame([(*r, "c", 1, "k") for r in rows], ODD).repartition(3)
    got = vector_codes.vector_codes(table, parts, entries, rounds)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_codes(rows, parts, entries, rounds)


def test_codes_of_nothing_and_of_odd_lengths(spark):
    none = spark.createDataFrame([(1, None, 1), (2, [math.nan], 1)], "vec_id long, embedding array<double>, label string")
    assert vector_codes.vector_codes(none).count() == 0
    assert vector_codes.vector_codes(none.limit(0)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    for bad in ([[0.0] * 8, [0.0] * 16], [[0.0] * 9], [[1e30] * 8]):
        with pytest.raises(Exception, match="vectors must have one length|components must be below"):
            vector_codes.vector_codes(spark.createDataFrame([(i, v, 1) for i, v in enumerate(bad)], "vec_id long, embedding array<double>, label int")).count()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(2, 6), st.integers(1, 5))
def test_bounds_prune_without_an_error(seed, levels, scale):
    rng = np.random.default_rng(seed)
    x = (rng.integers(0, levels, (120, 2, 3)) * 10**scale).astype(np.int32)
    books, before = x[:7].astype(np.int64).transpose(1, 0, 2).copy(), None
    near, upper, lower = np.zeros((120, 2), np.uint8), np.full((120, 2), np.inf, np.float32), np.zeros((120, 2, 7), np.uint16)
    for _ in range(5):
        step = vector_codes.Step(books, before)
        near, upper, lower = step.assign(x, near, upper, lower)
        far = ((x[:, :, None, :].astype(np.int64) - books[None]) ** 2).sum(-1)
        assert (near == far.argmin(-1)).all()  # ties go to the lower index
        assert (upper.astype(float) >= np.sqrt(np.take_along_axis(far, near[:, :, None].astype(int), 2)[:, :, 0]) * (1 - 1e-15)).all()
        assert (vector_codes.full(lower).astype(float) <= np.sqrt(far)).all()
        before, books = books, vector_codes.moved_books(books, step.sums(x, near))


def test_most_distances_are_passed_over():
    rng = np.random.default_rng(5)
    middle = rng.integers(-9_000, 9_000, (16, 8))
    x = (middle[rng.integers(0, 16, 5_000)] + rng.integers(-300, 300, (5_000, 8))).astype(np.int32)[:, None, :]
    books, before, compared = x[:16].astype(np.int64).transpose(1, 0, 2).copy(), None, []
    state = np.zeros((5_000, 1), np.uint8), np.full((5_000, 1), np.inf, np.float32), np.zeros((5_000, 1, 16), np.uint16)
    for _ in range(6):
        step = vector_codes.Step(books, before)
        state = step.assign(x, *state)
        compared.append(step.compared)
        before, books = books, vector_codes.moved_books(books, step.sums(x, state[0]))
    assert compared[-1] < 0.25 * 16 * 5_000


def test_codes_decode(spark, data):
    table = spark.read.parquet(f"{data}/embeddings.parquet")
    with Scratch() as scratch:
        _, books, _ = vector_codes.trained(table, scratch)
        row = vector_codes.vector_codes(table).first()
    v = np.array(table.where(f"vec_id = {row['vec_id']}").first()["embedding"], np.float64)
    assert ((np.floor(v * 4096) - vector_codes.decoded(row["code"], books) * 4096) ** 2).sum() == row["error"]


# exact duplicates -----------------------------------------------------------------------------


def plain_groups(rows: list[tuple]) -> list[tuple]:
    groups: dict[str, list] = {}
    for i, t in rows:
        groups.setdefault(lowered(t), []).append(i)
    out = []
    for i, t in rows:
        own = groups[lowered(t)]
        keep = max((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), i == keep, hashlib.sha256(lowered(t).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [64, 12, 3, 1])
def test_exact_duplicates_against_a_dictionary(spark, odd, bits):
    """Few bits of a fingerprint make different texts meet."""
    more = spark.createDataFrame([(100 + i, f"Text {i % 40} ÀÉ" if i % 2 else f"tEXT {i % 40} Àé") for i in range(300)], "doc_id long, text string")
    docs = odd.select("doc_id", "text", "kept", "s", "words").unionByName(more, allowMissingColumns=True).repartition(5)
    got = quotient_dedup.exact_duplicates(docs, bits).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_groups([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_exact_duplicates_of_nothing(none, odd):
    assert quotient_dedup.exact_duplicates(none).count() == 0
    kept = quotient_dedup.kept_documents(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.select("doc_id").collect()) == sorted(map(str, [2, 2, 5, 4, 6, 7, 8, 9, -5, None, None]))


def test_a_full_bitmap_changes_nothing(spark, odd, monkeypatch):
    want = sorted(map(tuple, quotient_dedup.exact_duplicates(odd).collect()), key=repr)
    monkeypatch.setattr(quotient_dedup, "ROUTE_BITS", 64)
    assert sorted(map(tuple, quotient_dedup.exact_duplicates(odd).collect()), key=repr) == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**64 - 1) | st.integers(0, 40), st.integers(1, 70_000)), max_size=60), st.integers(0, 6))
def test_filters_lose_nothing(pairs, range_bits):
    """Filters of parts of a range, merged, are the filter of the whole."""
    want = Counter()
    for fp, n in pairs:
        want[fp] += n
    parts = []
    for part in (pairs[::2], pairs[1::2]):
        by_range: dict[int, list] = {}
        fp, n = quotient_dedup.summed(np.array([p[0] for p in part], np.uint64), np.array([p[1] for p in part], np.int64))
        for f, c in zip(fp.tolist(), n.tolist()):
            by_range.setdefault(f >> (64 - range_bits), []).append((f, c))
        for r, own in by_range.items():
            packed = quotient_dedup.pack(np.array([f for f, _ in own], np.uint64), np.array([c for _, c in own], np.int64), range_bits)
            back = quotient_dedup.unpack(packed, r, range_bits)
            assert list(zip(back[0].tolist(), back[1].tolist())) == own
            parts.append(back)
    merged = quotient_dedup.summed(*(np.concatenate([np.zeros(0, t), *(p[i] for p in parts)]) for i, t in enumerate((np.uint64, np.int64))))
    assert dict(zip(merged[0].tolist(), merged[1].tolist())) == want and (np.diff(merged[0].astype(object)) > 0).all()


def test_a_filter_is_small():
    fp = np.sort(np.random.default_rng(1).integers(0, 2**63, 100_000).astype(np.uint64))
    assert len(quotient_dedup.pack(fp, np.ones(100_000, np.int64))) < 7.6 * 100_000


def test_copies_send_one_entry(spark):
    """However many copies a task has, a filter gets one entry for them."""
    docs = spark.range(20_000, numPartitions=4).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same' ELSE concat('t', id % 50) END AS text")
    bits = quotient_dedup.range_bits_for(20_000)
    parts = quotient_dedup.partial_filters(docs, bits)
    sizes = [len(quotient_dedup.unpack(r["filter"], r["range"], bits)[0]) for r in parts.collect()]
    assert sum(sizes) == 4 * 51
    found = quotient_dedup.entries(quotient_dedup.merged_filters(parts, bits), bits)
    assert found.count() == 51 and found.agg({"n": "sum"}).first()[0] == 20_000 and found.agg({"n": "max"}).first()[0] == 6_667
