"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document's features are its hashed words (log counts, normalised), its structure statistics in
bins (one of each statistic's bins is 1) and the bin of its ``n_chars`` column.  The score is

    sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)),

the sum-of-squares identity for all pairwise interactions, linear in the number of features.

It learns by AdaGrad from at most ``PER_CLASS`` labelled documents of each class, those with the
smallest hash of their doc_id; this bound is the only sample.  Labels, language, source and doc_id
are never features.  Labels of documents with ``crc32(doc_id) % 5 == 0`` are held out.

A null text is the empty text, which has a score of its own like any other.  Documents with
several labels count as the worst of them; labels that are null or neither 0 nor 1 are ignored.
A labelled doc_id whose rows have different texts is learnt from the one with the least features
(compared as bytes).  Without labels every score is 0.5.  A null doc_id counts as held out.  Repeated rows get
repeated scores.  Texts of any length are read whole.  An empty table gives an empty table.
``kept_documents`` returns the input's columns, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import map_arrow, record_batch, texts_of

PER_CLASS = 3000
WORD_BUCKETS = 2048
FACTORS = 8
EPOCHS = 12
THRESHOLD = 0.3

_BINS = 12
#: Upper edges of the bins of ratios; those of sizes are powers of two.
_RATIOS = np.array([0.0, 0.002, 0.005, 0.01, 0.02, 0.04, 0.08, 0.15, 0.3, 0.5, 0.8])
_STATISTICS = (
    "upper",
    "digit",
    "symbol",
    "bar",
    "exclaim",
    "other_punctuation",
    "not_ascii",
    "line",
    "dup_line",
    "dup_word",
    "word_length",
    "words",
    "n_chars",
)
SIZE = WORD_BUCKETS + _BINS * len(_STATISTICS)


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 150_000:
            self.clear()
        b = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORD_BUCKETS
        return b


_buckets = _Buckets()
_CLASS = np.zeros(256, np.int64)
for _k, _members in enumerate(
    (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>@^~_=+\\", b"|", b"!", b".,;:?'\"()[]{}-/`", bytes(range(128, 256)), b"\n")
):
    _CLASS[list(_members)] = _k + 1


def features(text: str, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a document's features."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    by_class = np.bincount(_CLASS, np.bincount(raw, minlength=256), minlength=9)[1:9]
    words = text.lower().split()
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    n, m = max(1, len(words)), max(1, len(raw))
    ratios = [*(by_class[k] / m for k in range(7)), by_class[7] / n, 1 - len(set(lines)) / max(1, len(lines)), 1 - len(counts) / n]
    sizes = [len(raw) / n, len(words), -1 if n_chars is None else n_chars]
    bins = [*np.searchsorted(_RATIOS, ratios).tolist(), *(0 if x < 0 else min(_BINS - 1, 1 + int(np.log2(1 + x) * s)) for x, s in zip(sizes, (2.0, 0.7, 0.6)))]
    structure = WORD_BUCKETS + _BINS * np.arange(len(bins)) + np.array(bins)
    if not counts:
        return structure, np.ones(len(structure), np.float32)
    tf = np.bincount(np.fromiter(map(_buckets.__getitem__, counts), np.int64, len(counts)), np.fromiter(counts.values(), np.float64, len(counts)), WORD_BUCKETS)
    at = np.flatnonzero(tf)
    x = np.log1p(tf[at])
    return np.concatenate([at, structure]), np.concatenate([x / np.sqrt((x * x).sum()), np.ones(len(structure))]).astype(np.float32)


class FactorisationMachine:
    def __init__(self, size: int = SIZE, factors: int = FACTORS, seed: int = 7) -> None:
        self.w0 = 0.0
        self.w = np.zeros(size, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (size, factors)).astype(np.float32)

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Linear-time scores of sparse rows; each has a feature at least."""
        if not rows:
            return np.zeros(0)
        at, x = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        starts = np.cumsum([0, *(len(r[0]) for r in rows[:-1])])
        vx = self.v[at] * x[:, None]
        s, q = np.add.reduceat(vx, starts), np.add.reduceat((vx * vx).sum(axis=1), starts)
        z = self.w0 + np.add.reduceat(self.w[at] * x, starts) + 0.5 * ((s * s).sum(axis=1) - q)
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def fit(
        self,
        rows: list[tuple[np.ndarray, np.ndarray]],
        y: np.ndarray,
        epochs: int = EPOCHS,
        rate: float = 0.1,
        decay: float = 1e-4,
        batch: int = 128,
        seed: int = 11,
    ) -> None:
        """AdaGrad on the log loss of sparse rows, which are dense for the time of their batch."""
        if not len(y):
            return
        rng, g0, gw, gv = np.random.default_rng(seed), 1e-6, np.full_like(self.w, 1e-6), np.full_like(self.v, 1e-6)
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
                b = np.zeros((len(part), len(self.w)), np.float32)
                for i, k in enumerate(part.tolist()):
                    b[i, rows[k][0]] = rows[k][1]
                s = b @ self.v
                sq = b * b
                z = self.w0 + b @ self.w + 0.5 * ((s * s).sum(axis=1) - sq @ (self.v * self.v).sum(axis=1))
                e = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)).astype(np.float32)
                dw = b.T @ e + decay * self.w
                dv = b.T @ (e[:, None] * s) - self.v * (sq.T @ e)[:, None] + decay * self.v
                d0 = float(e.sum())
                g0, gw, gv = g0 + d0 * d0, gw + dw * dw, gv + dv * dv
                self.w0 -= rate * d0 / g0**0.5
                self.w -= rate * dw / np.sqrt(gw)
                self.v -= rate * dv / np.sqrt(gv)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Features and label of the bounded sample; not more than two times ``per_class`` rows reach the driver."""
    known = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    at = F.xxhash64("doc_id")
    chosen = known.where("quality = 0").orderBy(at).limit(per_class).union(known.where("quality = 1").orderBy(at).limit(per_class))
    label = dict((i, q) for i, q in chosen.collect())  # bounded by per_class
    ids = docs.sparkSession.createDataFrame([(i,) for i in label], "doc_id long")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.col("n_chars").cast("long").alias("n_chars"),
    ).join(F.broadcast(ids), "doc_id")

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [features(t, n) for t, n in zip(texts_of(batch.column(1)), batch.column(2).to_pylist())]
            return record_batch(
                {
                    "doc_id": (batch.column(0), pa.int64()),
                    "at": ([f[0].astype(np.int32).tobytes() for f in found], pa.binary()),
                    "x": ([f[1].tobytes() for f in found], pa.binary()),
                }
            )

        return each

    got = map_arrow(rows, make, "doc_id long, at binary, x binary").groupBy("doc_id").agg(F.min(F.struct("at", "x")).alias("f")).collect()
    return [
        (
            np.frombuffer(r["f"]["at"], np.int32).astype(np.int64),
            np.frombuffer(r["f"]["x"], np.float32),
            label[r["doc_id"]],
        ) for r in sorted(got, key=lambda r: r["doc_id"])
    ]


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> FactorisationMachine:
    rows = training_rows(docs, labels, per_class)
    fm = FactorisationMachine()
    if not rows:
        fm.v[:] = 0
        return fm
    fm.fit([r[:2] for r in rows], np.array([r[2] for r in rows], np.float32))
    return fm


def _scorer(df: DataFrame, fm: FactorisationMachine):
    model = df.sparkSession.sparkContext.broadcast((fm.w0, fm.w, fm.v))  # SIZE * (FACTORS + 1) numbers

    def make():
        own = FactorisationMachine(1)
        own.w0, own.w, own.v = model.value

        def score(texts: list[str], n_chars: list[int | None]) -> np.ndarray:
            parts = [own.scores([features(t, n) for t, n in zip(texts[a : a + 500], n_chars[a : a + 500])]) for a in range(0, len(texts), 500)]
            return np.concatenate([*parts, np.zeros(0)])

        return score

    return make


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, per_class: int = PER_CLASS) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted."""
    make_score = _scorer(docs, train(docs, labels, per_class))

    def make():
        score = make_score()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            s = score(texts_of(batch.column(1)), batch.column(2).to_pylist())
            return record_batch({"doc_id": (batch.column(0), pa.int64()), "score": (s, pa.float64())})

        return each

    narrow = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text", "CAST(n_chars AS BIGINT) AS n_chars")
    return map_arrow(narrow, make, "doc_id long, score double").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def kept_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least the threshold, with all columns."""
    make_score = _scorer(docs, train(docs, labels))
    text, n_chars = docs.columns.index("text"), docs.columns.index("n_chars")

    def make():
        score = make_score()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array(score(texts_of(batch.column(text)), batch.column(n_chars).to_pylist()) >= threshold, pa.bool_()))

        return each

    return map_arrow(docs, make, docs.schema)
