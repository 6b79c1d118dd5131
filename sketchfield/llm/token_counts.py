"""Exact histogram of encoded lengths, and what its suffix sums answer.

Documents are encoded and aggregated by length, which shuffles one number for each length and
task.  For every length L that occurs, the suffix sums give the totals that a context limit of
L leaves: documents and tokens in all, documents that fit, and the tokens left after truncation
to L; between two lengths that occur, the truncated total is linear in the limit, so the table
answers every limit.  The running share of documents answers every quantile.

Null and empty texts have length 0.  Repeated rows count once for each row.  An empty table
gives an empty table.  Columns other than the text are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import map_arrow, record_batch, runs, stored, texts_of
from .word_bpe import load

BLOCK = 1024


def lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    def make():
        bpe = load(tokenizer)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch.column(0))
            n = [len(raw) // 4 for a, b in runs(texts) for raw in bpe.encode(texts[a:b])]
            return record_batch({"n_tokens": (n, pa.int64())})

        return each

    return map_arrow(docs.selectExpr("CAST(text AS STRING) AS text"), make, "n_tokens long")


def histogram(docs: DataFrame, tokenizer: str) -> DataFrame:
    """n_tokens, n_docs: one row for each length that occurs."""
    return lengths(docs, tokenizer).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Totals for every limit, in two levels: sums inside blocks of lengths, and over the blocks.

    No task holds more than the lengths of one block, or the sums of the blocks, of which there is
    one for each BLOCK tokens of the longest text.
    """
    h = hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    after = W.partitionBy().orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    every = W.partitionBy()
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"),
        F.sum("d").over(every).alias("total_docs"),
        F.sum("t").over(every).alias("total_tokens"),
    )
    within = W.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, 0)
    out = h.withColumn("d_in", F.sum("n_docs").over(within)).withColumn("t_in", F.sum("tokens").over(within)).join(blocks, "block")
    docs_from, tokens_from = F.col("d_in") + F.col("d_after"), F.col("t_in") + F.col("t_after")
    longer = docs_from - F.col("n_docs")
    return out.select(
        "n_tokens",
        "n_docs",
        docs_from.alias("docs_at_least"),
        tokens_from.alias("tokens_at_least"),
        (F.col("total_docs") - longer).alias("docs_fitting"),
        (F.col("total_tokens") - (tokens_from - F.col("tokens")) + longer * F.col("n_tokens")).alias("truncated_total"),
        ((F.col("total_docs") - longer) / F.col("total_docs")).alias("quantile"),
        "total_docs",
        "total_tokens",
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """For each limit: documents that fit and the total tokens after truncation to it."""
    spark = sums.sparkSession
    wanted = spark.createDataFrame([(int(x),) for x in limits], "context_limit long")
    return (
        wanted.join(sums, F.col("n_tokens") > F.col("context_limit"), "left")
        .groupBy("context_limit")
        .agg(F.coalesce(F.max("docs_at_least"), F.lit(0)).alias("docs_cut"), F.coalesce(F.max("tokens_at_least"), F.lit(0)).alias("cut_docs_tokens"))
        .crossJoin(
            F.broadcast(
                sums.agg(F.coalesce(F.max("total_docs"), F.lit(0)).alias("total_docs"), F.coalesce(F.max("total_tokens"), F.lit(0)).alias("total_tokens"))
            )
        )
        .select(
            "context_limit",
            (F.col("total_docs") - F.col("docs_cut")).alias("docs_fitting"),
            (F.col("total_tokens") - F.col("cut_docs_tokens") + F.col("docs_cut") * F.col("context_limit")).alias("truncated_total"),
        )
    )


def token_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The histogram with its suffix sums. The histogram is stored first, so that texts are encoded once."""
    return suffix_sums(stored(histogram(docs, tokenizer), "lengths"))
