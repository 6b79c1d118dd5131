"""Filter queries on tables of other sizes than the small ones: sizes follow the keys counted."""

from __future__ import annotations

from pyspark.sql import functions as F

from sketchfield import queries


def test_slices_go_on_opening(spark, tmp_path):
    rows = spark.range(400_000).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), (F.col("id") % 100).alias("user_id"))
    rows.write.parquet(str(tmp_path / "events.parquet"))
    for name, capacity in (("scalable_slices", 500), ("concurrent_slices", 333)):
        sizes = {r["slice"]: r["n"] for r in queries.QUERIES[name](spark, str(tmp_path)).groupBy("slice").agg(F.count(F.lit(1)).alias("n")).collect()}
        assert sum(sizes.values()) == 400_000 and sorted(sizes) == list(range(len(sizes)))
        assert all(n <= max(1, -(-capacity * 2**i // 2)) for i, n in sizes.items())
    stats = queries.QUERIES["scalable_fpr_breakdown"](spark, str(tmp_path)).collect()
    assert len(stats) == 11 and max(r["fill_rate"] for r in stats) < 0.5


def test_filters_are_sized_by_their_keys(spark, tmp_path):
    """At most 2 % of absent keys pass, where 1 % is the aim."""
    d, ids = str(tmp_path), lambda n: spark.range(n).withColumn("even", F.col("id") % 2 == 0)
    ids(12_000).select(F.col("id").alias("c_custkey"), F.concat(F.lit("name"), "id").alias("c_name"), F.when(F.col("even"), 1.0).otherwise(-1.0).alias("c_acctbal")).write.parquet(f"{d}/customer.parquet")
    ids(5_000).select(F.concat(F.lit("text"), "id").alias("text")).write.parquet(f"{d}/documents.parquet")
    ids(60_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a/"), F.col("id") % 40_000).alias("url")).write.parquet(f"{d}/pages.parquet")
    ids(150_000).select(F.col("id").alias("o_orderkey"), F.when(F.col("even"), "1-URGENT").otherwise("2-HIGH").alias("o_orderpriority"), F.when(F.col("even"), "F").otherwise("O").alias("o_orderstatus")).write.parquet(f"{d}/orders.parquet")
    ids(150_000).select(F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber")).write.parquet(f"{d}/lineitem.parquet")
    run = lambda name: queries.QUERIES[name](spark, d)
    assert 0 < run("std_contains_batch").where("maybe and c_custkey % 2 = 1").count() < 0.02 * 6_000
    assert run("std_contains_batch").where("not maybe and c_custkey % 2 = 0").count() == 0
    assert run("fill_fpr_cardinality").first()["estimated_fpr"] < 0.02 and run("health_check").first()["state"] != "Critical"
    fetched = run("url_dedup")
    assert 0.98 * 40_000 < fetched.count() < 40_000 and fetched.where("page_id >= 40000").count() == 0
    assert 0.98 * 75_000 < run("std_not_contains_anti").count() <= 75_000
    left = run("counting_contains_after_delete")
    assert left.where("maybe and o_orderkey % 2 = 0").count() < 0.02 * 75_000
