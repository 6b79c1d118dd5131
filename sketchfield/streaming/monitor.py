"""The false-positive rate of a filter that a stream probes, as it runs.

``watch`` adds observed metrics to a stream of probes with what is true of them; Spark aggregates these in the query's own
tasks and hands a row for each micro-batch to the listener, so nothing is read twice and nothing but counts reaches the driver.  The
listener keeps the counts of all time and a ring of the last micro-batches.
"""

from __future__ import annotations

import json
import threading
from collections import deque
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..errors import InvalidParameters
from ..operators.reports import SAMPLES

COUNTS = ("probes", "positives", "false_positives", "false_negatives", "absent")
#: Rates, as multiples of the expected one, from which a filter is degraded and critical.
LEVELS = (2.0, 5.0)


class FilterMonitor(StreamingQueryListener):
    """Register with ``spark.streams.addListener``; one monitor for each name.

    ``windows``: micro-batches of the ring.  ``alert``: the multiple of the expected rate beyond which the ring's rate calls
    ``on_alert`` with a snapshot, once until it has been below again; ``least`` absent keys in the ring are needed for it.
    """

    def __init__(
        self,
        name: str,
        expected: float,
        windows: int = 10,
        alert: float = 1.5,
        least: int = SAMPLES,
        on_alert: Callable[[dict[str, Any]], None] | None = None,
    ) -> None:
        if not 0 < expected < 1 or windows < 1 or alert <= 0:
            raise InvalidParameters("an expected rate is in (0, 1), and a ring has one window at least")
        self.name, self.expected, self.alert, self.least, self.on_alert = name, expected, alert, least, on_alert
        self._ring: deque[dict[str, int]] = deque(maxlen=windows)
        self._total = dict.fromkeys(COUNTS, 0)
        self._last: dict[str, int] = {}
        self._alerted, self._lock = False, threading.Lock()

    def watch(self, probed: DataFrame, maybe: str = "maybe", actual: str = "actual") -> DataFrame:
        """The stream, with the counts of its probes observed; a probe without a truth counts as a probe only."""
        said, true = F.col(maybe), F.col(actual)
        n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
        return probed.observe(
            self.name,
            F.count(F.lit(1)).alias("probes"),
            n(said).alias("positives"),
            n(said & ~true).alias("false_positives"),
            n(~said & true).alias("false_negatives"),
            n(~true).alias("absent"),
        )

    def onQueryStarted(self, event: Any) -> None: ...

    def onQueryIdle(self, event: Any) -> None: ...

    def onQueryTerminated(self, event: Any) -> None: ...

    def onQueryProgress(self, event: Any) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self.record(str(event.progress.id), event.progress.batchId, {c: int(row[c]) for c in COUNTS})

    def record(self, query: str, batch: int, counts: dict[str, int]) -> None:
        """Counts of a micro-batch; one that was recorded before doesn't count again."""
        with self._lock:
            if batch <= self._last.get(query, -1):
                return
            self._last[query] = batch
            if not counts["probes"]:
                return
            self._ring.append(counts)
            for c in COUNTS:
                self._total[c] += counts[c]
            now = self._snapshot()
            fresh = now["alert"] and not self._alerted
            self._alerted = now["alert"]
        if fresh and self.on_alert is not None:
            self.on_alert(now)

    def _snapshot(self) -> dict[str, Any]:
        ring = {c: sum(x[c] for x in self._ring) for c in COUNTS}
        rate = lambda n: n["false_positives"] / n["absent"] if n["absent"] else 0.0
        enough = ring["absent"] >= self.least
        ratio = rate(ring) / self.expected
        state = "Critical" if self._total["false_negatives"] or (enough and ratio >= LEVELS[1]) else "Degraded" if enough and ratio >= LEVELS[0] else "Healthy"
        return {
            **self._total, "fpr": rate(self._total), "windows": len(self._ring), "window_absent": ring["absent"], "window_fpr": rate(ring),
            "fpr_ratio": ratio, "expected_fpr": self.expected, "enough": enough, "alert": enough and ratio > self.alert, "state": state,
        }

    def snapshot(self) -> dict[str, Any]:
        """All-time counts and rate, the ring's rate, and Healthy, Degraded or Critical; a false negative is always critical."""
        with self._lock:
            return self._snapshot()

    def to_json(self) -> str:
        return json.dumps(self.snapshot())

    def to_prometheus(self) -> str:
        """A gauge for each number."""
        rows = [(f"{self.name}_{c}", v) for c, v in self.snapshot().items() if not isinstance(v, str)]
        return "\n".join(f"# TYPE {c} gauge\n{c} {float(v):g}" for c, v in rows)
