"""Components, near duplicates and repeated byte strings."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from sketchfield.llm import near_dup, suffix_dedup
from sketchfield.llm.components import components


def _components(nodes, links):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def test_components_against_union_find(spark):
    random.seed(4)
    links = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 430)] + [(500, i) for i in range(501, 560)]
    want = {n: c for n, c in _components({n for x in links for n in x}, links).items() if n != c}
    assert dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect())) == want
    assert components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 0


def _sets(rows):
    out = []
    for i, text in rows:
        words = (text or "").encode().lower().split()
        n = min(3, len(words))
        out.append((i, {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set()))
    return out


def _check_near(spark, rows):
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = [(i, s) for i, s in _sets(rows) if i is not None]
    links = [(a, b) for k, (a, s) in enumerate(sets) for b, t in sets[:k] if s and t and 100 * len(s & t) >= 85 * len(s | t)]
    want = _components({i for i, _ in sets}, links)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
            assert r["n_shingles"] in {len(s) for i, s in sets if i == r["doc_id"]}
    return got


def test_near_duplicates_against_brute_force(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    random.seed(1)
    base = [f"word{random.randrange(400)}" for _ in range(150)]
    for i in range(260):  # a group of several blocks, linked in chains
        base[random.randrange(150)] = f"new{i}"
        rows.append((10_000 + i, " ".join(base)))
    rows += [(20_000 + i, " ".join(base)) for i in range(30)]
    got = _check_near(spark, rows)
    assert sum(r["kept"] for r in got) < len(rows) - 200


def test_groups_of_blocks_that_a_hub_does_not_connect(spark, monkeypatch):
    """Families whose members are near some others only, in many small blocks with crowds of visitors."""
    monkeypatch.setattr(near_dup, "BLOCK_DOCS", 3)
    monkeypatch.setattr(near_dup, "CROWD", 2)
    random.seed(6)
    base, rows = [f"word{random.randrange(900)}" for _ in range(120)], []
    for i in range(90):
        own = list(base)
        for k in range(random.choice((1, 3, 4, 5, 6))):
            own[random.randrange(120)] = f"new{i}x{k}"
        rows.append((i, " ".join(own)))
    got = _check_near(spark, rows)
    assert 1 < sum(r["kept"] for r in got) < 80


def test_near_copies_make_rows_in_proportion(spark):
    random.seed(7)
    base = [f"word{i}" for i in range(200)]

    def rows_of(n):
        found = []
        for i in range(n):
            own = list(base)
            own[random.randrange(200)] = f"new{i}"
            found.append((i, 0, i, i == 0, 198, [1, 2, 3], " ".join(own)))
        members = spark.createDataFrame(found, "node long, g long, c long, every boolean, n_shingles long, toks array<long>, text string")
        texts = members.select("node", "toks", "text")
        plan = near_dup.links_in_groups(members.drop("toks", "text"), texts, 85, 3, 3)
        return plan, n

    for n in (400, 1_600):
        plan, _ = rows_of(n)
        links = plan.collect()
        assert len({x for r in links for x in r}) == n and len(links) <= n + n // 100 * 10


def test_match_thresholds():
    assert near_dup.matches_for(85, 32) == 16 and near_dup.matches_for(80, 32) == 13


def test_near_duplicates_of_odd_rows(spark, odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()] + [(50, "two words"), (51, "TWO  words"), (52, "two"), (53, "words two")]
    _check_near(spark, rows)
    assert near_dup.near_duplicates(none).count() == 0
    kept = near_dup.kept_documents(odd)
    assert kept.columns == odd.columns and kept.where("doc_id is null").count() == 2 and [r["doc_id"] for r in kept.where("doc_id in (1, 2)").collect()] == [1]


def _repeats(rows, length=50):
    first = {}
    for i, text in rows:
        b = (text or "").encode()
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if i is not None:
                first[w] = min(i, first.get(w, i))
    out = []
    for i, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if i is not None and first[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("letters", "most"), [("ab", 30), ("abcdefgh", 200), ("a", 60)])
def test_intervals_against_plain_prefixes(letters, most):
    random.seed(3)
    strings = sorted({"".join(random.choices(letters, k=random.randint(1, most))).encode() for _ in range(40)})
    random.shuffle(strings)
    text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.uint16)
    for length in (5, 50):
        sa, lcp = suffix_dedup.intervals(text, length)
        assert sorted(sa.tolist()) == list(range(len(text)))
        prefix = [np.roll(text, -i)[:length].tolist() for i in sa.tolist()]
        assert prefix == sorted(prefix)
        for k in range(1, len(sa)):
            assert lcp[k] == next((i for i, (x, y) in enumerate(zip(prefix[k - 1], prefix[k])) if x != y), length)


def test_windows_of_strings_against_plain_search():
    random.seed(8)
    strings = list({bytes(random.choices(range(3), k=random.randint(1, 40))) for _ in range(300)})
    docs = np.array([random.randrange(20) for _ in strings])
    first = {}
    for s, d in zip(strings, docs.tolist()):
        for i in range(len(s) - 5):
            first[s[i : i + 6]] = min(d, first.get(s[i : i + 6], d))
    want = [(k, i) for k, (s, d) in enumerate(zip(strings, docs.tolist())) for i in range(len(s) - 5) if first[s[i : i + 6]] < d]
    assert list(zip(*(x.tolist() for x in suffix_dedup.repeated_windows(strings, docs, 6)))) == want


@pytest.mark.parametrize(("many", "over"), [(None, 65_536), (2, 65_536), (64, 2)])
def test_repeats_against_brute_force(spark, data, many, over):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    passage = " ".join(f"shared{i}" for i in range(20))
    rows += [(1_000 + i, f"start {i} {i * 7} {passage} end {i * i} " + "la " * (i % 40)) for i in range(60)]
    got = suffix_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), many=many, over=over)
    assert sorted(map(tuple, got.collect()), key=repr) == _repeats(rows)


def test_a_larger_table_against_brute_force(spark, data):
    """All documents of the next size, whole."""
    docs = spark.read.parquet(f"{data.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert len(rows) == 1_000
    assert sorted(map(tuple, suffix_dedup.repeats(docs).collect()), key=repr) == _repeats(rows)
    _check_near(spark, rows)


def test_repeats_of_odd_rows(spark, odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()] + [(2, "another text of document two: " + "word " * 30), (60, "word " * 20 + "another text of document two: "), (70, "ab" * 3_000), (71, "ab" * 2_000 + "c" * 60), (72, "é" * 100), (73, "x" + "é" * 60)]
    got = suffix_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == _repeats(rows)
    assert suffix_dedup.repeats(none).count() == 0
    out = suffix_dedup.without_repeats(odd)
    assert out.schema == odd.schema and out.count() == odd.count()
    texts = {r["doc_id"]: r["text"] for r in out.where("doc_id is not null").collect()}
    assert texts[1] == texts[2] == "" and texts[3] is None and texts[-5] and texts[7] != texts[6]


def test_checksum_of_very_many_links(spark):
    """A sum of hashes would leave 64 bits."""
    from sketchfield.llm.components import checksum

    links = spark.range(1 << 25).selectExpr("id AS u", "id * 7 AS v")
    assert links.agg(checksum()).first()[0] != links.where("u > 0").agg(checksum()).first()[0]
    assert links.limit(0).agg(checksum()).first()[0] == 0
