"""Save and load filters: words as Parquet, metadata as a one-row JSON table beside them."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import IncompatibleFilters, InvalidFilterSize, SerializationError
from ..functions.hashing import PROFILES
from ..operators.membership import WORDS
from ..plans.sizing import Spec
from ..plans.slices import Slice, TreePlan

VERSION = 1


def save(words: DataFrame, spec: Spec, path: str) -> None:
    words.select("filter_id", "grp", "word", "bits").write.mode("overwrite").parquet(f"{path}/words")
    spark = words.sparkSession
    spark.createDataFrame([(VERSION, json.dumps(asdict(spec)))], "version int, spec string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load(spark: SparkSession, path: str, expected: Spec | None = None) -> tuple[DataFrame, Spec]:
    meta = spark.read.schema("version int, spec string").json(f"{path}/meta").first()
    if meta is None or meta["version"] != VERSION:
        raise SerializationError(f"{path} has no filter of version {VERSION}")
    spec = spec_from_json(meta["spec"])
    if expected is not None and not spec.compatible(expected):
        raise IncompatibleFilters(f"{path} has a filter of {spec}")
    return spark.read.schema(WORDS).parquet(f"{path}/words"), spec


def spec_from_json(text: str) -> Spec:
    try:
        spec = Spec(**json.loads(text))
    except (TypeError, ValueError) as e:
        raise SerializationError(str(e)) from e
    if spec.profile not in PROFILES:
        raise SerializationError(f"unknown hash profile {spec.profile}")
    return spec


def to_bytes(words: DataFrame, spec: Spec, chunk: int = 1 << 17) -> DataFrame:
    """(filter_id, grp, chunk, bytes): all words of each filter that has one, in order, as little-endian bytes; a row for each ``chunk`` of them."""
    stride = -(-spec.m // 64)
    own = words.select("filter_id").distinct()
    rows = own.join(words.sparkSession.range(spec.groups).withColumnRenamed("id", "grp")).withColumn("word", F.explode(F.expr(f"sequence(0L, {stride - 1}L)")))
    digits = F.lpad(F.hex(F.coalesce("bits", F.lit(0).cast("long"))), 16, "0")
    little = F.concat(*(F.substring(digits, 15 - 2 * i, 2) for i in range(8)))
    cells = rows.join(words.select("filter_id", "grp", "word", "bits"), ["filter_id", "grp", "word"], "left").select(
        "filter_id",
        "grp",
        F.expr(f"word div {chunk}").alias("chunk"),
        F.struct("word", little.alias("v")).alias("x"),
    )
    return cells.groupBy("filter_id", "grp", "chunk").agg(F.unhex(F.array_join(F.sort_array(F.collect_list("x")).getField("v"), "")).alias("bytes"))


def from_bytes(raw: DataFrame, spec: Spec, chunk: int = 1 << 17) -> DataFrame:
    """The words of ``to_bytes``: lengths are checked, and bits beyond the filter's end are cleared."""
    stride = -(-spec.m // 64)
    bad = raw.groupBy("filter_id").agg(F.sum(F.octet_length("bytes")).alias("n")).where(f"n != {8 * stride * spec.groups}").limit(1).collect()
    if bad:
        raise InvalidFilterSize(f"{bad[0]['n']} bytes are not {spec.groups} groups of {spec.m} bits")
    last = F.expr(f"CASE WHEN word = {stride - 1} THEN {-1 if spec.m % 64 == 0 else (1 << (spec.m % 64)) - 1}L ELSE -1L END")
    cells = raw.select("filter_id", "grp", "chunk", F.hex("bytes").alias("h")).select(
        "filter_id",
        "grp",
        "chunk",
        "h",
        F.explode(F.expr("sequence(0, length(h) div 16 - 1)")).alias("i"),
    )
    hexes = F.concat(*(F.substring("h", F.col("i") * 16 + (15 - 2 * k), F.lit(2)) for k in range(8)))
    # conv gives the unsigned number; its 32-bit halves make the signed one
    number = F.shiftleft(F.conv(F.substring(hexes, 1, 8), 16, 10).cast("long"), 32).bitwiseOR(F.conv(F.substring(hexes, 9, 8), 16, 10).cast("long"))
    words = cells.select("filter_id", "grp", (F.col("chunk") * chunk + F.col("i")).cast("long").alias("word"), number.alias("bits"))
    return words.withColumn("bits", F.col("bits").bitwiseAND(last)).where("bits != 0")


def from_parts(words: DataFrame, m: int, k: int, items: int | None = None, rate: float | None = None, **more: object) -> tuple[DataFrame, Spec]:
    """A filter of words that came from elsewhere, with its parameters; words beyond its end raise."""
    spec = Spec("standard", m, k, expected_items=items, target_fpr=rate, **more)
    if words.where((F.col("word") < 0) | (F.col("word") >= -(-m // 64))).limit(1).count():
        raise InvalidFilterSize(f"a word is beyond {m} bits")
    return words, spec


def estimate_size(spec: Spec, how: str = "bytes", fill: float = 0.5) -> int:
    """Bytes that a filter takes: raw, or about so many as lines of JSON."""
    if how == "bytes":
        return spec.memory_bytes
    used = spec.memory_bytes // 8 * (1 - (1 - fill) ** 64)
    return int(48 * used) + len(json.dumps(asdict(spec))) + 64


def save_counting(counters: DataFrame, spec: Spec, bits: int, path: str, items: int = 0) -> None:
    """Counters with their size and the number of items."""
    counters.select("pos", "cnt").write.mode("overwrite").parquet(f"{path}/counters")
    _save_meta(counters.sparkSession, path, {"spec": asdict(spec), "bits": bits, "items": items})


def load_counting(spark: SparkSession, path: str) -> tuple[DataFrame, Spec, int, int]:
    """Counters, their spec, their size in bits and the number of items."""
    meta = _load_meta(spark, path)
    counters = spark.read.schema("pos long, cnt long").parquet(f"{path}/counters")
    spec = spec_from_json(json.dumps(meta["spec"]))
    if meta["bits"] not in (4, 8, 16):
        raise SerializationError(f"no counter has {meta['bits']} bits")
    return counters, spec, meta["bits"], meta["items"]


def save_growing(words: DataFrame, plan: list[Slice], path: str) -> None:
    """The words of all slices, and their plan."""
    words.select("filter_id", "grp", "word", "bits").write.mode("overwrite").parquet(f"{path}/words")
    _save_meta(words.sparkSession, path, {"slices": [asdict(s) for s in plan]})


def load_growing(spark: SparkSession, path: str) -> tuple[DataFrame, list[Slice]]:
    meta = _load_meta(spark, path)
    try:
        plan = [Slice(**{**s, "spec": Spec(**s["spec"])}) for s in meta["slices"]]
    except (KeyError, TypeError) as e:
        raise SerializationError(str(e)) from e
    return spark.read.schema(WORDS).parquet(f"{path}/words"), plan


def save_tree(words: DataFrame, plan: TreePlan, path: str) -> None:
    """The words of all nodes with their levels, and the tree's plan."""
    words.select("filter_id", "grp", "word", "bits", "level").write.mode("overwrite").parquet(f"{path}/words")
    _save_meta(words.sparkSession, path, {"tree": asdict(plan)})


def load_tree(spark: SparkSession, path: str) -> tuple[DataFrame, TreePlan]:
    meta = _load_meta(spark, path)
    try:
        plan = TreePlan(meta["tree"]["capacity"], meta["tree"]["rate"], tuple(meta["tree"]["branching"]))
    except (KeyError, TypeError) as e:
        raise SerializationError(str(e)) from e
    return spark.read.schema(f"{WORDS}, level int").parquet(f"{path}/words"), plan


def _save_meta(spark: SparkSession, path: str, meta: dict[str, object]) -> None:
    spark.createDataFrame([(VERSION, json.dumps(meta))], "version int, meta string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def _load_meta(spark: SparkSession, path: str) -> dict:
    row = spark.read.schema("version int, meta string").json(f"{path}/meta").first()
    if row is None or row["version"] != VERSION or row["meta"] is None:
        raise SerializationError(f"{path} has nothing of version {VERSION}")
    return json.loads(row["meta"])


def to_json(words: DataFrame, spec: Spec) -> DataFrame:
    """A line of JSON for each filter: (filter_id, json). A filter's words must fit one row."""
    entries = F.sort_array(F.collect_list(F.struct("grp", "word", "bits")))
    return words.groupBy("filter_id").agg(entries.alias("words")).select(
        "filter_id",
        F.to_json(F.struct(F.lit(VERSION).alias("version"), F.lit(json.dumps(asdict(spec))).alias("spec"), "words")).alias("json"),
    )


def from_json(lines: DataFrame) -> DataFrame:
    """The words of ``to_json``."""
    parsed = lines.select("filter_id", F.from_json("json", "version int, spec string, words array<struct<grp: long, word: long, bits: long>>").alias("j"))
    return parsed.select("filter_id", F.explode("j.words").alias("w")).select("filter_id", "w.grp", "w.word", "w.bits")
