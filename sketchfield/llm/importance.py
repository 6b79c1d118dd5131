"""Importance resampling towards a target distribution, over a table of word positions.

1. Each document's words go to a position table (posexplode).  For runs of n words, lead() over the
   document's positions gives the following words, which are concatenated for each order up to n; runs of
   one word need no window.  A window covers ``CHUNK`` positions, with the first words of the next
   ones, so no task holds a whole long document.
2. A run's bucket is its hash.  The position table of buckets is stored once, as texts are dearer to take apart
   again; counts by bucket are aggregated in each task first.  The gains of buckets, from the counts of all documents and of
   all target texts, are ``buckets`` rows, so they are broadcast.
3. Gains are joined to the position table and summed by document.  The weight and a Gumbel number from
   the doc_id make the score: the highest scores are a draw without replacement by weight.
4. Ranks need no global sort: documents are counted by score (an integer of bounded range, see
   ``_ranked``), and only drawn ones are numbered, within their score.

A null or empty text has no features and weight 0.  Rows that repeat a doc_id are documents of their own and
get the same draw number; equal scores go to the smaller doc_id, those of equal ids in any order.  A null doc_id draws its
number from the empty string and comes last among equal scores.  Texts of any length count whole.  An empty
table gives an empty table, an empty target counts as zero everywhere.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import Scratch, stored

ORDERS = 1
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
CHUNK = 100_000  # positions of a window

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[\p{Alnum}\P{ASCII}]++"  # before A-Z are lower-cased; \p{Alnum} is ASCII's


def _lower(word: Column) -> Column:
    """A-Z only; lower() does the same to ASCII and to what it doesn't change, and faster."""
    low = F.lower(word)
    return F.when((F.octet_length(word) == F.length(word)) | (low == word), low).otherwise(F.translate(word, _UPPER, _LOWER))


def positions(docs: DataFrame) -> DataFrame:
    """doc_id, row (which tells rows apart), pos and word; one row with nulls for a document without words."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_WORD), F.lit(0))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), words.alias("words"))  # numbered before they are taken apart
    table = rows.select("doc_id", "row", F.posexplode_outer("words").alias("pos", "word"))
    return table.withColumn("word", _lower(F.col("word")))


def features(docs: DataFrame, orders: int = ORDERS, chunk: int = CHUNK) -> DataFrame:
    """doc_id, row, n and gram: all runs of 1 to ``orders`` words; nulls for a document without words."""
    words = positions(docs)
    if orders == 1:
        return words.select("doc_id", "row", F.when(F.col("word").isNotNull(), 1).alias("n"), F.col("word").alias("gram"))
    if not 1 < orders < chunk:
        raise ValueError(f"runs have from 1 to {chunk - 1} words")
    own = F.expr(f"pos div {chunk}")
    after = (F.col("pos") >= chunk) & (F.col("pos") % chunk < orders - 1)  # also ends runs of the chunk before
    dealt = words.withColumn("chunk", F.explode(F.when(after, F.array(own, own - 1)).otherwise(F.array(own))))
    window = W.partitionBy("row", "chunk").orderBy("pos")
    runs = dealt.select("doc_id", "row", "pos", "chunk", "word", *(F.lead("word", i).over(window).alias(f"next{i}") for i in range(1, orders)))
    runs = runs.where(own.eqNullSafe(F.col("chunk")))
    each = [F.when(F.col(f"next{n - 1}" if n > 1 else "word").isNotNull(), F.struct(F.lit(n).alias("n"), F.concat_ws(" ", "word", *(f"next{i}" for i in range(1, n))).alias("gram"))) for n in range(1, orders + 1)]
    found = runs.select("doc_id", "row", F.explode_outer(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("x"))
    return found.select("doc_id", "row", "x.n", "x.gram")


def _bucket(gram: Column, buckets: int) -> Column:
    return F.crc32(gram.cast("binary")) % buckets


def hashed(docs: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, row, n and bucket of all features; nulls for a document without words."""
    return features(docs, orders).select("doc_id", "row", "n", _bucket(F.col("gram"), buckets).alias("bucket"))


def counts(found: DataFrame) -> DataFrame:
    """(bucket, n): how many features of ``hashed`` each bucket has."""
    return found.where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gains(own: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket: 1000 times the logarithm of how much likelier it is in the target, both smoothed by one."""
    every = own.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    both = every.join(counts(own).withColumnRenamed("n", "s"), "bucket", "left").join(counts(target).withColumnRenamed("n", "t"), "bucket", "left")
    both = both.select("bucket", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")))
    totals = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))  # one row
    up, down = (F.col("t") + 1) * (F.col("all_s") + buckets), (F.col("s") + 1) * (F.col("all_t") + buckets)
    return both.crossJoin(F.broadcast(totals)).select("bucket", F.floor(1000 * F.ln(up / down)).cast("long").alias("gain"))


def _scored(found: DataFrame, gain: DataFrame, seed: int) -> DataFrame:
    """doc_id, n_features, n_words, weight and score."""
    own = found.join(F.broadcast(gain), "bucket", "left").groupBy("row", "doc_id").agg(  # as many rows as buckets
        F.count("bucket").alias("n_features"), F.count(F.when(F.col("n") == 1, 1)).alias("n_words"), F.coalesce(F.sum("gain"), F.lit(0)).alias("total")
    )
    weight = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0).cast("long"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    drawn = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")
    return own.select("doc_id", "n_features", "n_words", weight.alias("weight"), (weight + drawn).alias("score"))


def _ranked(scored: DataFrame, least_words: int, percent: int) -> DataFrame:
    """``scored`` with the rank of those that are drawn.

    A score is an integer between those of the smallest and largest gain, within 90,000 of zero for
    any counts of 64 bits, and a number from -3,200 to 23,000: so their counts are a small table.  No score
    has more than one in 2,700 of documents with ids of their own.
    """
    by_score = scored.where(F.col("n_words") >= least_words).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    higher = W.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)
    places = by_score.select("score", F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("before"), F.expr(f"(sum(n) OVER ()) * {percent} div 100").alias("places"))
    places = places.where("before < places").select(F.col("score").alias("_score"), "before", "places")
    may = scored.join(F.broadcast(places), F.when(F.col("n_words") >= least_words, F.col("score")) == F.col("_score"), "left").drop("_score")
    place = F.col("before") + F.row_number().over(W.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last()))
    drawn = may.where("before is not null").withColumn("_place", place)
    rank = F.when(F.col("_place") <= F.col("places"), F.col("_place")).cast("long").alias("rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    return drawn.select(*columns, rank).union(may.where("before is null").select(*columns, F.lit(None).cast("long").alias("rank")))


def resampled(
    docs: DataFrame,
    target: DataFrame,
    orders: int = ORDERS,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_features, weight, score and rank, null if it is not drawn."""
    docs = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text")
    target = target.selectExpr("CAST(NULL AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text")
    with Scratch() as scratch:
        found = scratch.stored(hashed(docs, orders, buckets), "positions")
        gain = scratch.stored(gains(found, hashed(target, orders, buckets), buckets), "gains")
        scored = stored(_scored(found, gain, seed), "scored")
    return _ranked(scored, least_words, percent)


def drawn_documents(docs: DataFrame, target: DataFrame, **params: int) -> DataFrame:
    """The drawn documents with all their columns; doc_id tells documents apart."""
    ids = resampled(docs, target, **params).where("rank is not null").select("doc_id").distinct()
    return docs.join(ids, "doc_id", "left_semi")
