"""HyperLogLog registers as a table, portable to any SQL engine, and Spark's own sketch."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRECISION = 14
REGISTERS = 1 << PRECISION
RANK_BITS = 46  # of a 60-bit hash
_FEW = 50  # registers that count themselves
_LARGE = 2.0**32
ERROR_BOUND = 1.04 / math.sqrt(REGISTERS)


def hashed(key: Column) -> Column:
    """60 bits of a key."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("long")


def registers(df: DataFrame, key: str, by: str | None = None) -> DataFrame:
    """(filter_id, register, rank): the largest rank for each register that a key hits. Null keys don't count."""
    own = F.lit("") if by is None else F.col(by).cast("string")
    rows = df.where(F.col(key).isNotNull()).select(own.alias("filter_id"), hashed(F.col(key)).alias("h"))
    rest = F.expr(f"h div {REGISTERS}")
    rank = F.when(rest == 0, F.lit(RANK_BITS + 1)).otherwise(RANK_BITS - F.length(F.bin(rest)) + 1)
    return rows.groupBy("filter_id", (F.col("h") % REGISTERS).alias("register")).agg(F.max(rank).alias("rank"))


def merge(registers: DataFrame) -> DataFrame:
    return registers.groupBy("register").agg(F.max("rank").alias("rank")).select(F.lit("").alias("filter_id"), "register", "rank")


def estimate_of(used: Column, s: Column) -> Column:
    """The estimate of so many registers, with a sum of 2^-rank: the registers if these are few, linear counting for small numbers, and a correction for large ones."""
    m, alpha = float(REGISTERS), 0.7213 / (1 + 1.079 / REGISTERS)
    zeros = m - used
    raw = alpha * m * m / (s + zeros)
    large = F.when(raw < _LARGE, -_LARGE * F.ln(1 - raw / _LARGE)).otherwise(raw)
    value = F.when(used < _FEW, used.cast("double")).when(
        (raw <= 2.5 * m) & (zeros > 0),
        m * F.ln(m / zeros),
    ).when(raw > _LARGE / 30, large).otherwise(raw)
    return F.floor(value).cast("long")


def estimate(registers: DataFrame, by: bool = False) -> DataFrame:
    """One row, or one for each filter_id."""
    used = registers.groupBy(*(["filter_id"] if by else [])).agg(
        F.count("rank").alias("used"),
        F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("rank").cast("double"))), F.lit(0.0)).alias("s"),
    )
    return used.select(*(["filter_id"] if by else []), "used", estimate_of(F.col("used"), F.col("s")).alias("estimate"))


def builtin_estimate(df: DataFrame, key: Column | str, precision: int = PRECISION) -> DataFrame:
    return df.agg(F.hll_sketch_estimate(F.hll_sketch_agg(key, F.lit(precision))).alias("estimate"))
