"""The copy gate on a stream of drafts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators import spans
from millrace.operators.ruleset import Ruleset


def gate_drafts(drafts: DataFrame, rules: Callable[[], Ruleset], path: str, checkpoint: str, threshold: float = 20) -> StreamingQuery:
    """A started query that puts each batch of drafts (draft_id, channel, market, text) through the gate and writes its
    findings and verdicts to Parquet under `path`, in a folder a batch: all checks of spans.findings (phrases, tone,
    claims, fields), which need no draft but the one at hand, so nothing is kept between batches.

    rules() is asked at every batch, so rules that were added to their tables hold from the next batch on. A batch that is
    run again after a failure replaces its own folders.
    """

    def decide(batch: DataFrame, number: int) -> None:
        some = batch.select("draft_id", "channel", "market", "text").persist()
        try:
            spans.findings(some, rules()).write.mode("overwrite").parquet(f"{path}/findings/batch={number}")
            found = batch.sparkSession.read.parquet(f"{path}/findings/batch={number}")
            spans.verdicts(some, found, threshold).write.mode("overwrite").parquet(f"{path}/verdicts/batch={number}")
        finally:
            some.unpersist()

    return drafts.writeStream.foreachBatch(decide).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def decided(spark, path: str) -> DataFrame:
    """The verdicts written so far, each draft's last."""
    rows = spark.read.parquet(f"{path}/verdicts")
    return rows.groupBy("draft_id").agg(F.max_by(F.struct("score", "verdict", "reason"), "batch").alias("v")).select("draft_id", "v.*")
