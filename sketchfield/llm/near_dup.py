"""Near-duplicate groups by a signature-coordinate inverted join, confirmed on whole shingle sets.

1. Each document's set of 3-word shingles gives a MinHash signature of ``COORDS`` values.
   Documents with equal sets are one class, which its smallest doc_id stands for.
2. A class is posted under each (coordinate, value).  Postings of a value that occurs once can't
   collide and go.  ``matches_for`` gives the match threshold: the most collisions that two sets
   at the similarity fall short of with a probability of at most ``MISS`` (of 32 coordinates, 16
   at 0.85 and 13 at 0.8).  A class left with fewer postings has no partner, and by the prefix
   principle a pair with enough collisions meets under one of the rarest ``size - matches + 1``
   values of either: only these prefixes are merged; the frequent rest is skipped and serves to
   count collisions of the pairs found.
3. Pairs aren't listed: under each value the class with the most frequent values is the hub, and a
   class joins the group of its heaviest hub.  A group is dealt in blocks, each with its hub.  A
   task counts the collisions in its block and compares pairs that reach the threshold exactly,
   the most collisions first, as long as nothing connects them: a spanning forest of the links.
   A group of n classes makes n rows and one more for each block.
4. Classes of a group that are not connected with most of it go once more, to every block of it.
5. Two classes under one value but in different groups that no link connects yet are compared
   if they collide often enough.  One of them is not in the group of that value's hub, so only
   those visitors are joined with the value's classes.

Links are confirmed on the full sets (64-bit shingle hashes).  ``components`` joins them.

A null or empty text, or one of white space only, has an empty set, is linked with nothing and
kept.  Rows that repeat a doc_id are one document and share their component.  A row with a null
doc_id is linked with nothing; its component is null and it is kept.  Ties of hubs go to the
smaller doc_id.  Texts of any length are shingled whole.  An empty table gives an empty
table.  Columns other than doc_id and text are ignored; ``kept_documents`` returns them all.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, apart, free_name, map_arrow, record_batch, runs, stored, texts_of
from .components import components

SHINGLE = 3
PERCENT = 85
COORDS = 32
MISS = 1e-6  # probability of fewer collisions than the threshold, at the similarity
BLOCK_DOCS = 128
BLOCK_SHINGLES = 100_000
CROWD = 64  # blocks whose visitors come to another block at once

_CACHE = 100_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.array([int.from_bytes(hashlib.blake2b(bytes([k]), digest_size=16).digest()[:8], "little") for k in range(256)], np.uint64)
_FACTORS = np.array([int.from_bytes(hashlib.blake2b(bytes([k]), digest_size=16).digest()[8:], "little") | 1 for k in range(256)], np.uint64)


def matches_for(percent: int, coords: int, miss: float = MISS) -> int:
    """The largest number of collisions that a pair at the similarity falls short of with at most that probability."""
    s = percent / 100
    most, tail = 0, 0.0
    for m in range(1, coords):
        tail += comb(coords, m - 1) * s ** (m - 1) * (1 - s) ** (coords - m + 1)
        if tail > miss:
            break
        most = m
    return max(1, most)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHashes()


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles; of the whole sequence if it has fewer words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # ASCII letters and white space only
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = min(size, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        h = _mix(h * _MIX + w[k : len(w) - n + 1 + k])
    return np.unique(h)


def minhashes(sets: list[np.ndarray], coords: int = COORDS) -> np.ndarray:
    """A row of values for each set; none of them is empty."""
    out = np.empty((len(sets), coords), np.uint64)
    if sets:
        flat, starts = np.concatenate(sets), np.cumsum([0, *(len(s) for s in sets[:-1])])
        for k in range(coords):
            out[:, k] = np.minimum.reduceat((flat ^ _SEEDS[k]) * _FACTORS[k], starts)
    return out.view(np.int64)


def signatures(docs: DataFrame, size: int = SHINGLE, coords: int = COORDS) -> DataFrame:
    """doc_id, n_shingles, set_key (equal for equal sets) and sig; the last two null for empty sets."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, n, key, sig = texts_of(batch.column(1)), [], [], []
            for a, z in runs(texts, 1_000_000):
                sets = [shingles(t, size) for t in texts[a:z]]
                values = iter(minhashes([s for s in sets if len(s)], coords))
                n += map(len, sets)
                key += [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None for s in sets]
                sig += [next(values) if len(s) else None for s in sets]
            return record_batch(
                {"doc_id": (batch.column(0), pa.int64()), "n_shingles": (n, pa.int64()), "set_key": (key, pa.string()), "sig": (sig, pa.list_(pa.int64()))}
            )

        return each

    return map_arrow(docs.select("doc_id", "text"), make, "doc_id long, n_shingles long, set_key string, sig array<long>")


def candidates(reps: DataFrame, matches: int) -> DataFrame:
    """node, n_shingles, weight and toks (values that others have too, the rarest first), of classes that may have a partner."""
    posts = reps.select("node", "n_shingles", F.posexplode("sig").alias("k", "v")).select("node", "n_shingles", F.xxhash64("k", "v").alias("b"))
    common = posts.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(apart(F.col("b")).alias("b"), "n")
    own = posts.join(common, "b").groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("n", "b"))).alias("toks"),
        F.sum("n").alias("weight"),
        F.max("n_shingles").alias("n_shingles"),
    )
    own = own.where(F.size("toks") >= matches)
    return own.select("node", "n_shingles", "weight", F.col("toks.b").alias("toks"))


def _prefix(toks: str, matches: int) -> Column:
    return F.slice(toks, 1, F.size(toks) - (matches - 1))


def similar(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    """Whether two sets reach the similarity."""
    if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
        return False
    both = np.concatenate([s, t])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common > 0 and 100 * common >= percent * (len(both) - common)


def _colliding(toks: list[np.ndarray], mine: np.ndarray, matches: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i of ``mine``, j) of classes with enough tokens in common, each once, the most collisions first."""
    value = np.unique(np.concatenate([toks[i] for i in mine.tolist()]))
    own = np.zeros(len(toks), bool)
    own[mine] = True

    def incidence(which: np.ndarray) -> np.ndarray:
        has = np.zeros((len(which), len(value)), np.float32)
        flat = np.concatenate([toks[i] for i in which.tolist()])
        row, column = np.repeat(np.arange(len(which)), [len(toks[i]) for i in which.tolist()]), np.minimum(np.searchsorted(value, flat), len(value) - 1)
        there = value[column] == flat
        has[row[there], column[there]] = 1
        return has

    has, found = incidence(mine), []
    for a in range(0, len(toks), 1_000):
        count = has @ incidence(np.arange(a, min(len(toks), a + 1_000))).T
        i, j = np.nonzero(count >= matches)
        n, i, j = count[i, j], mine[i], j + a
        once = (i < j) | ~own[j]
        found.append((n[once], i[once], j[once]))
    n, i, j = (np.concatenate([f[k] for f in found]) for k in range(3))
    order = np.argsort(-n, kind="stable")
    return i[order], j[order]


def _block_links(
    nodes: list[int],
    labels: list[int],
    toks: list[np.ndarray],
    texts: list[str],
    mine: np.ndarray,
    percent: int,
    size: int,
    matches: int,
) -> list[tuple[int, int]]:
    """Links between the block's own classes and all that came, among pairs with enough collisions that nothing connects yet.

    Classes of one label are connected already.
    """
    if not len(mine):
        return []
    root: dict[int, int] = {}

    def top(c: int) -> int:
        while (up := root.get(c, c)) != c:
            root[c] = root.get(up, up)
            c = up
        return c

    sets: dict[int, np.ndarray] = {}
    out = []
    for x, y in zip(*(z.tolist() for z in _colliding(toks, mine, matches))):
        c, d = top(labels[x]), top(labels[y])
        if c == d or nodes[x] == nodes[y]:
            continue
        for z in (x, y):
            if z not in sets:
                sets[z] = shingles(texts[z] or "", size)
        if similar(sets[x], sets[y], percent):
            root[max(c, d)] = min(c, d)
            out.append((nodes[x], nodes[y]))
    return out


def links_in_groups(members: DataFrame, texts: DataFrame, percent: int, size: int, matches: int, visitors: int = 0) -> DataFrame:
    """Links between members (node, g, c, every, n_shingles) of a group that ``c`` doesn't connect; ``texts`` has node, toks and text.

    Groups are dealt before texts come to it, so no text is shuffled by its group.

    Each member is in one block of its group; with ``every``, it visits all others too.  With
    ``visitors``, those of so many blocks come at once, and a block is dealt once for each such crowd.
    """
    blocks = members.groupBy("g").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("n_shingles").alias("total"),
        F.min("c").alias("least"),
        F.max("c").alias("most"),
    ).where("rows > 1 and least != most")
    blocks = blocks.select("g", F.ceil(F.col("rows") / BLOCK_DOCS + F.col("total") / BLOCK_SHINGLES).cast("int").alias("nb"))
    crowd, crowds = (
        F.expr(f"CAST(own div {visitors} AS INT)"),
        F.expr(f"sequence(0, CAST((nb - 1) div {visitors} AS INT))"),
    ) if visitors else (F.lit(0), F.array(F.lit(0)))
    dealt = members.join(blocks.withColumn("g", apart(F.col("g"))), "g").withColumn("own", F.expr("CAST(pmod(xxhash64(node, 7), nb) AS INT)"))
    home = F.transform(crowds, lambda v: F.struct(F.col("own").alias("at"), v.alias("crowd"), F.lit(True).alias("mine")))
    away = F.transform(
        F.filter(F.expr("sequence(0, nb - 1)"), lambda at: at != F.col("own")),
        lambda at: F.struct(at.alias("at"), crowd.alias("crowd"), F.lit(False).alias("mine")),
    )
    dealt = dealt.withColumn("to", F.explode(F.when(F.col("every"), F.concat(home, away)).otherwise(home)))
    dealt = dealt.select("node", "c", "to.mine", F.xxhash64("g", "to.at", "to.crowd").alias("task")).join(texts, "node")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = _block_links(
            pdf["node"].tolist(),
            pdf["c"].tolist(),
            pdf["toks"].tolist(),
            pdf["text"].tolist(),
            np.flatnonzero(pdf["mine"].to_numpy()),
            percent,
            size,
            matches,
        )
        return pd.DataFrame({"a": np.array([a for a, _ in pairs], np.int64), "b": np.array([b for _, b in pairs], np.int64)})

    return dealt.groupBy("task").applyInPandas(compare, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")

    def make():
        seen: dict[str, np.ndarray] = {}  # sets of the last texts; a class comes with many partners

        def set_of(text: str) -> np.ndarray:
            if text not in seen:
                if len(seen) > 500:
                    seen.clear()
                seen[text] = shingles(text, size)
            return seen[text]

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ok = [similar(set_of(x), set_of(y), percent) for x, y in zip(texts_of(batch.column(2)), texts_of(batch.column(3)))]
            return batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

        return each

    return map_arrow(both.select("a", "b", "text_a", "text_b"), make, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, coords: int = COORDS, matches: int | None = None) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id and kept."""
    matches = matches_for(percent, coords) if matches is None else matches
    docs = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text")
    sigs = stored(signatures(docs, size, coords), "signatures")
    with Scratch() as scratch:
        known = sigs.where("set_key is not null and doc_id is not null")
        reps = known.groupBy("set_key").agg(
            F.min("doc_id").alias("node"),
            F.max("n_shingles").alias("n_shingles"),
            F.min("sig").alias("sig"),
            F.count(F.lit(1)).alias("copies"),
        )
        found = scratch.stored(candidates(reps, matches), "candidates")

        posts = found.select("node", "weight", F.explode(_prefix("toks", matches)).alias("b"))
        hubs = posts.groupBy("b").agg(F.max(F.struct("weight", (-F.col("node")).alias("neg"))).alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
        hubs = hubs.select(apart(F.col("b")).alias("b"), "hub")
        posts = posts.join(hubs, "b")
        groups = posts.groupBy("node").agg(F.max("hub").alias("hub")).select("node", (-F.col("hub.neg")).alias("g"))
        groups = scratch.stored(groups.join(found.select("node", "n_shingles", "toks"), "node"), "groups")
        texts = scratch.stored(
            docs.join(groups.select(F.col("node").alias("doc_id"), "toks"), "doc_id").select(F.col("doc_id").alias("node"), "toks", "text"),
            "texts",
            release=True,
        )

        # each group's blocks, with the hub in all of them
        away = groups.select(F.col("g").alias("node")).distinct().join(groups.where("g != node"), "node").select("node", F.col("node").alias("g"), "n_shingles")
        dealt = groups.select("node", "g", "n_shingles").union(away).withColumn("c", F.col("node")).withColumn("every", F.col("node") == F.col("g"))
        links = scratch.stored(links_in_groups(dealt, texts, percent, size, matches), "links", release=True)
        joined = components(links, scratch)

        # what is not connected with the hub visits all blocks
        home = groups.join(joined, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
        of_hub = home.select(F.col("node").alias("g"), F.col("c").alias("hub_c"))
        home = scratch.stored(home.join(of_hub.withColumn("g", apart(F.col("g"))), "g"), "homes")
        loose = home.where("c != hub_c").select("g").distinct()
        again = home.join(loose, "g", "left_semi").select("node", "g", "c", (F.col("c") != F.col("hub_c")).alias("every"), "n_shingles")
        more = links_in_groups(again, texts, percent, size, matches, CROWD)

        # pairs of different groups
        posts = home.select(
            "node",
            "g",
            "c",
            "toks",
            F.explode(_prefix("toks", matches)).alias("b"),
        ).join(hubs.select("b", (-F.col("hub.neg")).alias("h")), "b")
        x, y = posts.where("g != h").alias("x"), posts.alias("y")
        enough = F.size(F.array_intersect(F.col("x.toks"), F.col("y.toks"))) >= matches
        # of the values where a pair meets, at one
        once = F.array_min(F.array_intersect(_prefix("x.toks", matches), _prefix("y.toks", matches))) == F.col("x.b")
        pairs = x.join(y, (F.col("x.b") == F.col("y.b")) & (F.col("x.g") != F.col("y.g")) & (F.col("x.c") != F.col("y.c")) & enough & once)
        pairs = pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        more = more.union(_confirmed(pairs, texts.select("node", "text"), percent, size))
        # rows of one doc_id with different sets are one document
        several = known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id")
        same = known.select("doc_id", "set_key").join(several, "doc_id", "left_semi").join(
            reps.select("set_key", "node"),
            "set_key",
        ).where("node != doc_id").select("node", "doc_id")
        more = scratch.stored(more.union(same), "links")
        joined = components(joined.select("component", "node").union(more))

    classes = reps.select("set_key", "node", "copies").join(joined, "node", "left").where("copies > 1 or component is not null").select(
        apart(F.col("set_key"), "string").alias("set_key"),
        F.coalesce("component", "node").alias("class"),
    )
    component = F.coalesce("class", "doc_id")
    out = sigs.withColumn("set_key", F.when(F.col("doc_id").isNotNull(), F.col("set_key"))).join(classes, "set_key", "left")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def kept_documents(docs: DataFrame, **params: int) -> DataFrame:
    """The documents that stay: one of each group, with all columns."""
    gone = near_duplicates(docs, **params).where("not kept").select(F.col("doc_id").alias(key := free_name(docs, "gone"))).distinct()
    return docs.join(gone, docs["doc_id"] == gone[key], "left_anti")
