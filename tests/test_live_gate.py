"""Decisions on a stream against the batch, and rows behind the watermark."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import ledger as g
from millrace.streaming import gate
from millrace.streaming import ledger as live
from millrace.streaming.lateness import LateRows

SCHEMA = "event_id long, ts timestamp, agent_id string, action_type string, channel string, subject_ref string, budget_new double, subject string, text string"
POLICY = g.Policy(max_emails_per_day=3, conflict_hours=6, ceilings={"a1": 50.0})
START = datetime.datetime(2026, 3, 1)


@pytest.fixture(scope="module")
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", gate.STORE)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def make(n, seed, hours=60):
    rng = random.Random(seed)
    said = ["All is well.", "Act now! Hurry!!", "We guarantee more revenue.", "Better than Lattix.", "No risk here.", ""]
    rows = []
    for i in range(n):
        kind = rng.choice(["email.send", "email.send", "page.publish", "ad.budget_change", "social.post", "other"])
        budget = rng.choice([10.0, 90.0, None]) if kind == "ad.budget_change" else None
        ts = START + datetime.timedelta(seconds=rng.randrange(hours * 3600), microseconds=rng.choice([0, 1, 999_999]))
        subject = rng.choice([None, "s1", "s2", "s3", f"own-{i}"])
        rows.append((i, ts, rng.choice(["a1", "a2", "a3"]), kind, "web", subject, budget, None, rng.choice(said)))
    return rows


def drain(spark, rows, path, per_file, delay):
    """The table of revisions after the rows, in that order, have come in file by file."""
    for k in range(0, len(rows), per_file):
        spark.createDataFrame(rows[k : k + per_file], SCHEMA).coalesce(1).write.parquet(f"{path}/in/{k:05d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{path}/in")
    found = gate.live_decisions(stream, POLICY, delay)
    query = found.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{path}/out")


def in_batch(spark, rows):
    actions = spark.createDataFrame(rows, SCHEMA).withColumn("day", F.to_date("ts"))
    return {r.event_id: tuple(r)[1:] for r in g.decisions(actions, g.checks(actions, POLICY), POLICY).collect()}


def test_last_decisions_are_those_of_the_batch(rocks, tmp_path):
    rows = make(160, 3)
    rng = random.Random(4)
    rows.sort(key=lambda r: r[1] + datetime.timedelta(hours=rng.uniform(-2, 2)))  # late, but within the delay
    revisions = drain(rocks, rows, str(tmp_path), 40, "5 hours")
    got = {r.event_id: tuple(r)[1:] for r in gate.last_decisions(revisions).select("event_id", "decision", "tier", "reasons", "decided_check", "decided_rule").collect()}
    assert got == in_batch(rocks, rows)
    assert revisions.filter("revision > 1").count() > 5  # some were revised
    assert revisions.groupBy("event_id", "revision").count().filter("count > 1").count() == 0


def test_helper_decides_as_the_batch(spark):
    rng = random.Random(7)
    policies = [POLICY, g.Policy(default="review"), g.Policy(rules=(("auto", None, "fail"), ("review", "tov", None)))]
    for policy in policies:
        cases = [{c: rng.choice(["pass", "warn", "fail"]) for c in g.CHECKS if rng.random() < 0.6} for _ in range(40)]
        rows = [(i, g.CHECKS.index(c), c, v) for i, case in enumerate(cases) for c, v in case.items()]
        actions = spark.createDataFrame([(i,) for i in range(40)], "event_id long")
        checked = spark.createDataFrame(rows, "event_id long, check_order int, check_type string, verdict string")
        for r in g.decisions(actions, checked, policy).collect():
            assert tuple(r)[1:] == gate.decide(cases[r.event_id], policy)


def test_rows_behind_the_watermark_are_counted(rocks, tmp_path):
    spark = rocks
    rows = sorted(make(60, 9), key=lambda r: r[1])
    early = [(1000 + i, *r[1:]) for i, r in enumerate(rows[:7])]
    for k, part in enumerate((rows[:30], rows[30:], early)):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    listener = LateRows()
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        query = live.deduplicated(stream, "1 hour").writeStream.format("memory").queryName("late_dedup").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination()
        kept = spark.table("late_dedup").count()
        for _ in range(50):
            books = listener.table(spark).filter(F.col("run_id") == query.runId).collect()
            if books and books[0].input == 67:
                break
            query.awaitTermination(1)
    finally:
        spark.streams.removeListener(listener)
    assert (books[0].input, books[0].late, books[0].on_time) == (67, 7, 60) and kept == 60


def test_quiet_periods(rocks, tmp_path):
    at = [START + datetime.timedelta(minutes=m) for m in (0, 10, 20, 90, 95, 400)]
    log = rocks.createDataFrame([(1, t) for t in at] + [(2, at[0])], "run_id long, ts timestamp")
    log.write.parquet(f"{tmp_path}/in")
    stream = rocks.readStream.schema("run_id long, ts timestamp").parquet(f"{tmp_path}/in")
    query = live.quiet_periods(stream).writeStream.format("memory").queryName("t_quiet").outputMode("complete").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    gap = datetime.timedelta(minutes=30)
    got = sorted(tuple(r) for r in rocks.table("t_quiet").collect())
    assert got == [(1, at[0], at[2] + gap, 3), (1, at[3], at[4] + gap, 2), (1, at[5], at[5] + gap, 1), (2, at[0], at[0] + gap, 1)]
