"""Ledger jobs on streams; expressions are those of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import ledger as g
from millrace.sources.actions import normalise


def deduplicated(actions: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Actions once each, by event id, within the watermark."""
    return actions.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def normalised(raw: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Ledger actions, once each, from a stream of provider events (JSON text); what does not fit is left to the batch
    job's quarantine, which reads the same events."""
    return deduplicated(normalise(raw)[0].filter("ts is not null"), delay)


def stateless_checks(actions: DataFrame, policy: g.Policy) -> DataFrame:
    """(event_id, check_type, score, verdict): tone, claims, competitors and regulated wording of every text action:
    nothing is kept between rows."""
    none = F.lit(None).cast("double").alias("score")
    tone = g.tone(actions, policy).select("event_id", F.lit("tov").alias("check_type"), "score", "verdict")
    return tone.unionByName(g.phrase_checks(actions, policy).select("event_id", "check_type", none, "verdict"))


def drift_alarms(days: DataFrame, baseline: DataFrame, policy: g.Policy) -> DataFrame:
    """(agent_id, channel, day, mean, baseline, reason): closed days (of daily_tone) under the warn line, or far under a
    static table's baseline (agent_id, channel, baseline)."""
    reason = F.when(F.col("mean") < policy.warn_below, "below_threshold").when(F.col("baseline") - F.col("mean") > policy.drop_threshold, "drop_vs_baseline")
    rows = days.join(baseline.select("agent_id", "channel", "baseline"), ["agent_id", "channel"], "left").withColumn("reason", reason)
    return rows.filter((F.col("n") >= policy.drift_min_samples) & F.col("reason").isNotNull()).select("agent_id", "channel", "day", "mean", "baseline", "reason")


def email_days(actions: DataFrame, policy: g.Policy, delay: str = "1 hour") -> DataFrame:
    """(agent_id, day, emails, over): a day's emails once the watermark closes it."""
    mails = actions.filter("action_type = 'email.send'").withWatermark("ts", delay)
    days = mails.groupBy("agent_id", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("emails"))
    return days.select("agent_id", F.to_date("w.start").alias("day"), "emails", (F.col("emails") > policy.max_emails_per_day).alias("over"))


def conflicts(left: DataFrame, right: DataFrame, hours: int = 24, delay: str = "1 hour") -> DataFrame:
    """(event_id, other_id): actions of different agents on one subject within the hours; both sides forget what the
    interval and the watermark rule out."""
    a = left.select("event_id", "agent_id", "subject_ref", "ts").withWatermark("ts", delay)
    b = right.select(F.col("event_id").alias("other_id"), F.col("agent_id").alias("other_agent"), F.col("subject_ref").alias("other_ref"), F.col("ts").alias("other_ts")).withWatermark("other_ts", delay)
    near = F.expr(f"subject_ref = other_ref and other_ts >= ts - interval {hours} hours and other_ts <= ts + interval {hours} hours")
    return a.join(b, near).filter("agent_id <> other_agent").select("event_id", "other_id")


def daily_tone(actions: DataFrame, policy: g.Policy, delay: str = "1 hour") -> DataFrame:
    """(agent_id, channel, day, mean, n) of scored text actions; join a static baseline for alarms."""
    rows = g.with_tone(actions.withWatermark("ts", delay), policy)
    days = rows.groupBy("agent_id", "channel", F.window("ts", "1 day").alias("w")).agg(F.avg("score").alias("mean"), F.count("*").alias("n"))
    return days.select("agent_id", "channel", F.to_date("w.start").alias("day"), "mean", "n")


def quiet_periods(log: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """(run_id, first, last, turns): stretches of a run without a pause of the gap."""
    w = log.withWatermark("ts", delay).groupBy("run_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("turns"))
    return w.select("run_id", F.col("w.start").alias("first"), F.col("w.end").alias("last"), "turns")


def gate(actions: DataFrame, policy: g.Policy, path: str, checkpoint: str):
    """A started query that appends each batch's system decisions to Parquet at `path`: tone, phrases and budgets, the
    checks that need no other action. Overrides are a table of their own; ledger.effective joins them on reading. A
    batch run again after a failure replaces its own folder."""

    def decide(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("day", F.to_date("ts"))
        checked = g.tone(rows, policy).select("event_id", F.lit(0).alias("check_order"), F.lit("tov").alias("check_type"), "verdict")
        phrases = g.phrase_checks(rows, policy).select("event_id", F.lit(1).alias("check_order"), "check_type", "verdict")
        budgets = g.spend(rows.filter("action_type <> 'email.send'"), policy).select("event_id", F.lit(4).alias("check_order"), F.lit("spend").alias("check_type"), "verdict")
        found = g.decisions(rows, checked.unionByName(phrases).unionByName(budgets), policy)
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return actions.writeStream.foreachBatch(decide).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
