"""The stream of proposal states against the batch operator."""

import datetime
import random

from pyspark.sql import functions as F

from millrace.operators import runs
from millrace.streaming.gate import STORE
from millrace.streaming.proposals import live_transitions, ordered_transitions

SCHEMA = "run_id long, pos long, role string, status string, kind string, proposal_id long"


def test_stream_agrees_with_the_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    for run in range(6):
        filed = []
        for pos in range(1, 60):
            kind, proposal = "turn", None
            if rng.random() < 0.15:
                kind, proposal = "filed", run * 1000 + pos
                filed.append(proposal)
            elif filed and rng.random() < 0.3:
                kind, proposal = rng.choice(["objected", "implemented", "implemented"]), rng.choice(filed)
            rows.append((run, pos, rng.choice(runs.ROLES), rng.choice(["ok", "ok", "ok", "error"]), kind, proposal))
    entries = spark.createDataFrame(rows, SCHEMA)
    for k in range(3):
        entries.filter((F.col("pos") > k * 20) & (F.col("pos") <= k * 20 + 20)).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = live_transitions(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("run_id", "proposal_id", "pos", "to").collect()}

    log = entries.withColumn("ts", F.timestamp_seconds("pos")).withColumn("cost_usd", F.lit(0.0))
    sound = log.filter("status <> 'error'")
    proposals = sound.filter("kind = 'filed'").select("run_id", "proposal_id", F.col("role").alias("filed_by"), "pos", "ts")
    of = lambda kind: sound.filter(F.col("kind") == kind).select("run_id", "proposal_id", "role", "pos")
    cycle = runs.lifecycle(log, proposals, of("objected"), of("implemented"))
    want = {(r.run_id, r.proposal_id, int(r.pos), r.to) for r in runs.transitions(cycle).collect()}
    assert got == want and len({w[3] for w in want}) == 4


def log_rows(seed, runs_n, turns):
    rng = random.Random(seed)
    rows = []
    for run in range(runs_n):
        filed = []
        for pos in range(1, turns):
            kind, proposal = "turn", None
            if rng.random() < 0.15:
                kind, proposal = "filed", run * 1000 + pos
                filed.append(proposal)
            elif filed and rng.random() < 0.3:
                kind, proposal = rng.choice(["objected", "implemented", "implemented"]), rng.choice(filed)
            rows.append((run, pos, rng.choice(runs.ROLES), rng.choice(["ok", "ok", "ok", "error"]), kind, proposal))
    return rows


def test_entries_in_any_order_over_many_batches(spark, tmp_path):
    rng = random.Random(11)
    start = datetime.datetime(2026, 5, 1)
    rows = [(*r, start + datetime.timedelta(minutes=r[1])) for r in log_rows(5, 4, 50)]
    entries = spark.createDataFrame(rows, SCHEMA + ", ts timestamp")
    # Up to 20 minutes late or early, in files of 25; then one entry far on, so that the watermark passes all.
    shuffled = sorted(rows, key=lambda r: r[6] + datetime.timedelta(minutes=rng.uniform(-10, 10)))
    shuffled.append((99, 1, "critic", "ok", "turn", None, start + datetime.timedelta(days=90)))
    for k in range(0, len(shuffled), 25):
        spark.createDataFrame(shuffled[k : k + 25], SCHEMA + ", ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / f"{k:04d}"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        stream = spark.readStream.schema(SCHEMA + ", ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        query = ordered_transitions(stream, "30 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
        left = query.lastProgress.stateOperators[0].numRowsTotal
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("run_id", "proposal_id", "pos", "to").collect())
    log = entries.withColumn("ts", F.timestamp_seconds("pos")).withColumn("cost_usd", F.lit(0.0))
    sound = log.filter("status <> 'error'")
    proposals = sound.filter("kind = 'filed'").select("run_id", "proposal_id", F.col("role").alias("filed_by"), "pos", "ts")
    of = lambda kind: sound.filter(F.col("kind") == kind).select("run_id", "proposal_id", "role", "pos")
    cycle = runs.lifecycle(log, proposals, of("objected"), of("implemented"))
    assert got == sorted((r.run_id, r.proposal_id, int(r.pos), r.to) for r in runs.transitions(cycle).collect())
    assert len(got) > 20 and left <= 6  # the silent runs are forgotten, the last one waits
