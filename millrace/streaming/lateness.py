"""What the watermark drops, counted: rows behind it vanish from a stream's results, not from its books."""

from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


class LateRows(StreamingQueryListener):
    """Input and late rows of every query that runs while the listener is registered, by the query's run.

    A query's late rows are those that its first stateful operator drops (operators further on see only what that one
    lets through): put `deduplicated` first, and each row is counted once. Kept: two numbers a run.
    """

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._rows: dict[str, list[int]] = {}

    def onQueryStarted(self, event) -> None:
        with self._lock:
            self._rows.setdefault(str(event.runId), [0, 0])

    def onQueryProgress(self, event) -> None:
        progress = json.loads(event.progress.json)
        operators = progress.get("stateOperators") or []
        with self._lock:
            seen = self._rows.setdefault(str(event.progress.runId), [0, 0])
            seen[0] += progress.get("numInputRows") or 0
            # Progress lists operators from the sink upwards: the last one is the first that rows meet.
            seen[1] += operators[-1].get("numRowsDroppedByWatermark", 0) if operators else 0

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        """(run_id, input, late, on_time)."""
        with self._lock:
            rows = [(k, *v) for k, v in self._rows.items()]
        df = spark.createDataFrame(rows, "run_id string, input long, late long")
        return df.withColumn("on_time", F.col("input") - F.col("late"))
