"""Rates of a filter that a stream probes."""

from __future__ import annotations

import json
import time

import pytest

from sketchfield.errors import InvalidParameters
from sketchfield.operators import membership
from sketchfield.plans import sizing
from sketchfield.streaming.monitor import FilterMonitor


def counts(probes, false_positives, absent, false_negatives=0):
    return {"probes": probes, "positives": false_positives, "false_positives": false_positives, "false_negatives": false_negatives, "absent": absent}


def test_the_ring_forgets_and_alerts_once():
    said = []
    m = FilterMonitor("f", 0.01, windows=3, on_alert=said.append)
    for batch, fp in enumerate([1, 1, 9, 9, 9, 0, 0, 0, 9]):
        m.record("q", batch, counts(150, fp, 150))
        m.record("q", batch, counts(150, 99, 150))  # a replay
    assert [round(x["window_fpr"], 6) for x in said] == [round(11 / 450, 6), round(9 / 450, 6)]
    now = m.snapshot()
    assert now["probes"] == 9 * 150 and now["false_positives"] == 38 and now["windows"] == 3 and now["state"] == "Degraded" and now["alert"]
    m.record("q", 9, counts(10, 0, 5, false_negatives=1))
    assert m.snapshot()["state"] == "Critical" and json.loads(m.to_json())["false_negatives"] == 1
    assert "# TYPE f_probes gauge\nf_probes 1360" in m.to_prometheus()
    few = FilterMonitor("g", 0.01, on_alert=said.append)
    few.record("q", 0, counts(50, 50, 50))
    few.record("q", 1, counts(0, 0, 0))
    assert not few.snapshot()["alert"] and few.snapshot()["state"] == "Healthy" and len(said) == 2
    with pytest.raises(InvalidParameters):
        FilterMonitor("f", 0.0)


def test_a_stream_raises_an_alert(spark, tmp_path):
    """A filter that gets ten times its keys: the rate passes its bound while the stream runs."""
    spec = sizing.standard(500, 0.01)
    good, full = (membership.build(spark.range(n), "id", spec) for n in (500, 5_000))
    said = []
    monitor = FilterMonitor("probes", 0.01, windows=2, on_alert=said.append)
    spark.streams.addListener(monitor)
    try:
        for i, words in enumerate((good, good, full)):
            low = 10_000 * (i + 1)
            probes = spark.range(low, low + 1_000).unionByName(spark.range(100))
            labelled = membership.probe(probes, "id", words, spec).selectExpr("maybe", "id < 5000 AS actual")
            labelled.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema("maybe boolean, actual boolean").parquet(str(tmp_path / "in"))
            q = monitor.watch(stream).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            q.awaitTermination()
            for _ in range(100):  # events come a little later
                if monitor.snapshot()["probes"] == 1_100 * (i + 1):
                    break
                time.sleep(0.1)
            assert monitor.snapshot()["probes"] == 1_100 * (i + 1)
            assert len(said) == (i == 2)
    finally:
        spark.streams.removeListener(monitor)
    assert said[0]["window_fpr"] > 0.015 and said[0]["state"] == "Critical" and monitor.snapshot()["false_negatives"] == 0
