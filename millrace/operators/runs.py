"""Agent-run logs and the lifecycle of proposals, derived as sets instead of by stepping through the log.

log: run_id, pos, ts, role, status, cost_usd. proposals: run_id, proposal_id, filed_by, pos, ts. objections and
implementations: run_id, proposal_id, role, pos. Positions order everything; what-if objections lie between two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WRITE_ROLE = "engineer"
ROLES = ("research", "architect", "critic", "engineer")


def _us(c: str = "ts") -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def reviewers(proposals: DataFrame, roles=ROLES, write_role: str = WRITE_ROLE) -> DataFrame:
    """(run_id, proposal_id, ts, role): every role but the filer and the write role."""
    each = F.explode(F.array(*[F.lit(r) for r in roles if r != write_role])).alias("role")
    return proposals.select("run_id", "proposal_id", "filed_by", "ts", each).filter("role <> filed_by").drop("filed_by")


def first_ok_after(asks: DataFrame, log: DataFrame) -> DataFrame:
    """asks (run_id, proposal_id, ts, role) with ok_pos: the role's first turn with status ok strictly later.

    A running minimum from the end of each role's log, not a join of every ask with every turn.
    """
    turns = log.filter("status = 'ok'").select("run_id", "role", _us().alias("us"), F.col("pos").cast("double").alias("turn_pos"), F.lit(None).cast("long").alias("proposal_id"))
    rows = asks.select("run_id", "role", _us().alias("us"), F.lit(None).cast("double").alias("turn_pos"), "proposal_id").unionByName(turns)
    later = Window.partitionBy("run_id", "role").orderBy(-F.col("us")).rangeBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("ok_pos", F.min("turn_pos").over(later)).filter("turn_pos is null").select("run_id", "proposal_id", "role", "ok_pos")


def effective_turns(relation: DataFrame, log: DataFrame) -> DataFrame:
    """Rows of a relation whose turn (run_id, pos) did not end in an error."""
    return relation.join(log.filter("status <> 'error'").select("run_id", "pos"), ["run_id", "pos"], "left_semi")


def lifecycle(log: DataFrame, proposals: DataFrame, objections: DataFrame, implementations: DataFrame, as_of: int | None = None) -> DataFrame:
    """One row a proposal: filed_pos, integrated_pos, reopened_pos, done_pos, objections, dropped, warnings, state.

    A proposal integrates when its last reviewer has had an ok turn, unless an objection stands by then; a later
    objection reopens it for good, unless it is done first. Objections to a proposal that is not filed yet, or done, are
    dropped and warn, as do implementations of one that is not integrated. as_of: positions after it have not happened.
    """
    if as_of is not None:
        log, proposals = log.filter(F.col("pos") <= as_of), proposals.filter(F.col("pos") <= as_of)
        objections, implementations = objections.filter(F.col("pos") <= as_of), implementations.filter(F.col("pos") <= as_of)
    key = ["run_id", "proposal_id"]
    ready = (
        first_ok_after(reviewers(proposals), log)
        .groupBy(*key)
        .agg(F.when(F.count("ok_pos") == F.count("*"), F.max("ok_pos")).alias("ready_pos"))
    )
    filings = proposals.select(*key, F.col("pos").cast("double").alias("filed_pos"))
    raised = objections.select(*key, F.col("pos").cast("double").alias("pos")).join(filings, key)
    objected = raised.filter("pos >= filed_pos").groupBy(*key).agg(F.min("pos").alias("first_objection"))
    base = (
        proposals.select(*key, "filed_by", F.col("ts").alias("filed_ts"), F.col("pos").cast("double").alias("filed_pos"))
        .join(ready, key, "left")
        .join(objected, key, "left")
        .withColumn("integrated_pos", F.when(F.col("first_objection").isNull() | (F.col("first_objection") > F.col("ready_pos")), F.col("ready_pos")))
        .drop("ready_pos")
    )
    built = (
        implementations.select(*key, F.col("pos").cast("double").alias("pos"))
        .join(base.select(*key, "integrated_pos", "first_objection"), key)
        .groupBy(*key)
        .agg(
            F.min(F.when((F.col("pos") > F.col("integrated_pos")) & (F.col("first_objection").isNull() | (F.col("pos") < F.col("first_objection"))), F.col("pos"))).alias("done_pos"),
            F.count("*").alias("implementations"),
        )
    )
    base = base.join(built, key, "left")
    late = F.coalesce(F.col("pos") > F.col("done_pos"), F.lit(False))
    counted = (
        raised.join(base.select(*key, "done_pos"), key)
        .groupBy(*key)
        .agg(F.count_if(late | (F.col("pos") < F.col("filed_pos"))).alias("dropped"), F.count("*").alias("filed"))
    )
    reopened = F.when(F.col("done_pos").isNull() & F.col("integrated_pos").isNotNull(), F.col("first_objection"))
    state = F.when(F.col("done_pos").isNotNull(), "done").when(F.col("integrated_pos").isNotNull() & reopened.isNull(), "integrated").otherwise("open")
    dropped = F.coalesce("dropped", F.lit(0))
    return base.join(counted, key, "left").select(
        *key, "filed_by", "filed_ts", "filed_pos", "integrated_pos", reopened.alias("reopened_pos"), "done_pos",
        (F.coalesce("filed", F.lit(0)) - dropped).alias("objections"),
        dropped.alias("dropped"),
        (dropped + F.coalesce("implementations", F.lit(0)) - F.col("done_pos").isNotNull().cast("int")).alias("warnings"),
        state.alias("state"),
    )


def readable(cycle: DataFrame) -> DataFrame:
    """(run_id, proposal_id, label, why)."""
    label = F.when(F.col("state") != "open", F.col("state")).when(F.col("objections") > 0, "blocked").otherwise("objection window")
    why = (
        F.when(label == "done", F.format_string("implemented at %d", F.col("done_pos").cast("int")))
        .when(label == "integrated", F.format_string("every reviewer passed by %d", F.col("integrated_pos").cast("int")))
        .when(F.col("reopened_pos").isNotNull(), F.format_string("reopened by an objection at %d", F.col("reopened_pos").cast("int")))
        .when(label == "blocked", F.format_string("%d objections stand", "objections"))
        .otherwise("awaiting reviewers")
    )
    return cycle.select("run_id", "proposal_id", label.alias("label"), why.alias("why"))


def transitions(cycle: DataFrame) -> DataFrame:
    """(run_id, proposal_id, pos, to): every change of state, in order of position."""
    steps = F.array(
        *[F.struct(F.col(c).alias("pos"), F.lit(to).alias("to")) for c, to in
          (("filed_pos", "open"), ("integrated_pos", "integrated"), ("reopened_pos", "reopened"), ("done_pos", "done"))]
    )
    return cycle.select("run_id", "proposal_id", F.inline(steps)).filter("pos is not null")


def turn_errors(outputs: DataFrame, log: DataFrame, objections: DataFrame, cycle: DataFrame) -> DataFrame:
    """(run_id, pos, error) of filed turns: outputs (run_id, pos, role) whose role is not the activated one, or that belong
    to no turn; and objections to a proposal that is unknown or already done at their position, unless their turn's output
    is of another role: of such a turn nothing is filed."""
    known = log.select("run_id", "pos", F.col("role").alias("activated"))
    judged = outputs.select("run_id", "pos", "role").join(known, ["run_id", "pos"], "left")
    wrong = judged.filter("activated is null or not (role <=> activated)")
    said = F.when(F.col("activated").isNull(), F.lit("no such turn")).otherwise(F.concat(F.lit("activated "), "activated", F.lit(", output says "), F.coalesce("role", F.lit("nothing"))))
    lost = dangling_objections(objections, cycle).join(wrong.select("run_id", "pos"), ["run_id", "pos"], "left_anti")
    dropped = lost.select("run_id", "pos", F.concat(F.lit("objection dropped: "), F.col("proposal_id").cast("string")).alias("error"))
    return wrong.select("run_id", "pos", said.alias("error")).unionByName(dropped)


def state_intervals(cycle: DataFrame) -> DataFrame:
    """(run_id, proposal_id, state, from_pos, to_pos): when each proposal stands in which state, from a position on and up
    to another, that one excluded (null: for good); states as in lifecycle."""
    steps = transitions(cycle).withColumn("state", F.when(F.col("to") == "reopened", "open").otherwise(F.col("to")))
    order = Window.partitionBy("run_id", "proposal_id").orderBy("pos", F.when(F.col("to") == "open", 0).when(F.col("to") == "integrated", 1).otherwise(2))
    rows = steps.select("run_id", "proposal_id", "state", F.col("pos").alias("from_pos"), F.lead("pos").over(order).alias("to_pos"))
    return rows.filter("to_pos is null or to_pos > from_pos")


def counts_at(intervals: DataFrame, positions: DataFrame) -> DataFrame:
    """(run_id, pos, open, integrated, done): how many proposals stand in each state at each of positions (run_id, pos), in
    one pass: comings and goings are summed up to every position asked for."""
    states = ("open", "integrated", "done")
    moves = intervals.select("run_id", "state", F.inline(F.array(F.struct(F.col("from_pos").alias("pos"), F.lit(1).alias("by")), F.struct(F.col("to_pos").alias("pos"), F.lit(-1).alias("by"))))).filter("pos is not null")
    moves = moves.groupBy("run_id", "pos").agg(*[F.sum(F.when(F.col("state") == s, F.col("by")).otherwise(0)).alias(s) for s in states])
    asks = positions.select("run_id", F.col("pos").cast("double").alias("pos"), F.lit(1).alias("asked"), *[F.lit(0).cast("long").alias(s) for s in states]).distinct()
    both = moves.withColumn("asked", F.lit(0)).unionByName(asks)
    so_far = Window.partitionBy("run_id").orderBy("pos", "asked").rowsBetween(Window.unboundedPreceding, 0)
    return both.select("run_id", "pos", "asked", *[F.sum(s).over(so_far).alias(s) for s in states]).filter("asked = 1").drop("asked")


def with_injected(objections: DataFrame, injected: DataFrame) -> DataFrame:
    """objections and what-if ones (run_id, proposal_id, role, pos), which apply after the turn at pos."""
    real = objections.select("run_id", "proposal_id", "role", F.col("pos").cast("double").alias("pos"))
    return real.unionByName(injected.select("run_id", "proposal_id", "role", (F.col("pos") + 0.5).alias("pos")))


def owed(cycle: DataFrame, log: DataFrame) -> DataFrame:
    """(run_id, proposal_id, role): reviewers of open proposals without an ok turn since."""
    open_ones = cycle.filter("state = 'open'").select("run_id", "proposal_id", "filed_by", F.col("filed_ts").alias("ts"))
    return first_ok_after(reviewers(open_ones), log).filter("ok_pos is null").select("run_id", "proposal_id", "role")


def eligible(cycle: DataFrame, log: DataFrame, write_role: str = WRITE_ROLE) -> DataFrame:
    """(run_id, role, reason): who can be activated: reviewers that owe a turn, and the write role for what is
    integrated."""
    review = owed(cycle, log).select("run_id", "role", F.format_string("objection window: %d", "proposal_id").alias("reason"))
    build = cycle.filter("state = 'integrated'").select("run_id", F.lit(write_role).alias("role"), F.format_string("ready to implement: %d", "proposal_id").alias("reason"))
    return review.unionByName(build)


def contract_errors(outputs: DataFrame) -> DataFrame:
    """(event_id, error) for turn outputs (event_id, output: JSON) that break the contract: an object with a whole
    number k and nothing else."""
    keys = F.expr("json_object_keys(output)")
    k = F.get_json_object("output", "$.k")
    rules = [
        (keys.isNull(), "not an object"),
        (keys.isNotNull() & ~F.coalesce(F.array_contains(keys, "k"), F.lit(False)), "k is missing"),
        (keys.isNotNull() & F.array_contains(keys, "k") & ~F.coalesce(k.rlike(r"^-?\d+$"), F.lit(False)), "k must be a whole number"),
        (keys.isNotNull() & (F.size(F.array_except(keys, F.array(F.lit("k")))) > 0), "unknown keys"),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in rules]))
    return outputs.select("event_id", F.explode(found).alias("error"))


def dangling_objections(objections: DataFrame, cycle: DataFrame) -> DataFrame:
    """Objections to a proposal that was unknown or already done at their position."""
    return (
        objections.join(cycle.select("run_id", "proposal_id", "filed_pos", "done_pos"), ["run_id", "proposal_id"], "left")
        .filter("filed_pos is null or filed_pos > pos or done_pos < pos")
        .select("run_id", "proposal_id", "role", "pos")
    )


def role_costs(log: DataFrame) -> DataFrame:
    """(run_id, role, turns, warned, errors, cost, per_turn, share): cost a costed turn, share of the run's cost."""
    cost = F.sum(F.coalesce("cost_usd", F.lit(0.0)))
    return (
        log.groupBy("run_id", "role")
        .agg(
            F.count("*").alias("turns"), F.count_if(F.col("status") == "ok_with_warnings").alias("warned"),
            F.count_if(F.col("status") == "error").alias("errors"), cost.alias("cost"), (cost / F.count("cost_usd")).alias("per_turn"),
        )
        .withColumn("share", F.col("cost") / F.sum("cost").over(Window.partitionBy("run_id")))
    )


def longest_gap(log: DataFrame) -> DataFrame:
    """(run_id, gap_pos, gap_us): the longest quiet stretch of each run and the turn that ended it."""
    before = F.lag("us").over(Window.partitionBy("run_id").orderBy("pos"))
    gaps = log.withColumn("us", _us()).withColumn("gap", F.col("us") - before).filter("gap is not null")
    return gaps.groupBy("run_id").agg(F.max(F.struct("gap", (-F.col("pos")).alias("p"))).alias("m")).select("run_id", (-F.col("m.p")).alias("gap_pos"), F.col("m.gap").alias("gap_us"))


def objection_matrix(objections: DataFrame, proposals: DataFrame, roles=ROLES) -> DataFrame:
    """(run_id, objector, one column for each filer, proposals_hit)."""
    rows = objections.join(proposals.select("run_id", "proposal_id", "filed_by"), ["run_id", "proposal_id"])
    return rows.groupBy("run_id", F.col("role").alias("objector")).agg(
        *[F.count_if(F.col("filed_by") == r).alias(f"by_{r}") for r in roles], F.countDistinct("proposal_id").alias("proposals_hit")
    )


def waits(cycle: DataFrame, log: DataFrame) -> DataFrame:
    """(run_id, proposal_id, to_integrate_us, to_done_us, objections)."""
    at = log.select("run_id", F.col("pos").cast("double").alias("p"), _us().alias("us"))
    out = cycle
    for c in ("integrated", "done"):
        out = out.join(at.withColumnsRenamed({"p": f"{c}_pos", "us": f"{c}_us"}), ["run_id", f"{c}_pos"], "left")
    filed = _us("filed_ts")
    return out.select("run_id", "proposal_id", (F.col("integrated_us") - filed).alias("to_integrate_us"), (F.col("done_us") - filed).alias("to_done_us"), "objections")


def wait_summary(wait: DataFrame, gaps: DataFrame, cycle: DataFrame) -> DataFrame:
    """(run_id, integrated, median_us, spanning): spanning counts proposals whose wait holds the longest gap."""
    span = (
        cycle.join(gaps, "run_id")
        .filter("filed_pos < gap_pos and integrated_pos >= gap_pos")
        .groupBy("run_id")
        .agg(F.count("*").alias("spanning"))
    )
    return (
        wait.groupBy("run_id")
        .agg(F.count("to_integrate_us").alias("integrated"), F.percentile("to_integrate_us", F.lit(0.5)).alias("median_us"))
        .join(span, "run_id", "left")
        .withColumn("spanning", F.coalesce("spanning", F.lit(0)))
    )


def reconcile(cycle: DataFrame, recorded: DataFrame) -> DataFrame:
    """(matching, differing, missing, warnings): computed against recorded (run_id, proposal_id, final_state)."""
    both = cycle.select("run_id", "proposal_id", "state", "warnings").join(recorded, ["run_id", "proposal_id"], "full_outer")
    return both.agg(
        F.count_if(F.col("state") == F.col("final_state")).alias("matching"),
        F.count_if(F.col("state") != F.col("final_state")).alias("differing"),
        F.count_if(F.col("state").isNull() | F.col("final_state").isNull()).alias("missing"),
        F.sum("warnings").alias("warnings"),
    )


def turn_effects(proposals: DataFrame, objections: DataFrame, implementations: DataFrame) -> DataFrame:
    """(run_id, pos, effects): what each turn did, as a list in order."""
    parts = None
    for k, (name, df) in enumerate((("filed", proposals), ("objected to", objections), ("implemented", implementations))):
        part = df.select("run_id", "pos", F.struct(F.lit(k).alias("k"), F.col("proposal_id").alias("p"), F.format_string(name + " %d", "proposal_id").alias("t")).alias("e"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("run_id", "pos").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["t"]).alias("effects"))
