"""Contracts, intervals, one budget for all panels and merged quantiles against plain versions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import statistics as z
from millrace.operators import contracts, mix, runs

CONTRACT = [
    ("$", ["object"], True, True),
    ("$.a", ["number", "null"], True, False),
    ("$.b", ["array"], False, False),
    ("$.b[*]", ["array"], False, False),
    ("$.b[*][*]", ["object", "string"], False, True),
    ("$.b[*][*].c", ["boolean"], True, False),
    ("$.d", None, False, False),
    ("$.d.e", ["string"], True, False),
]


def plain(value, path="$", at="$"):
    rules = {p: r for p, *r in CONTRACT}
    if path not in rules:
        return []
    types, _, closed = rules[path]
    kind = "null" if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, int | float) else {dict: "object", list: "array", str: "string"}[type(value)]
    if types and kind not in types:
        return [(at, f"expected {' or '.join(types)}, got {kind}")]
    out = []
    if kind == "object":
        own = {p[len(path) + 1 :]: r for p, r in rules.items() if p.startswith(path + ".") and "." not in p[len(path) + 1 :] and "[" not in p[len(path) + 1 :]}
        out += [(at, f"missing {k}") for k, r in own.items() if r[1] and k not in value]
        out += [(at, f"not allowed: {k}") for k in value if closed and k not in own]
        for k, v in value.items():
            out += plain(v, f"{path}.{k}", f"{at}.{k}")
    if kind == "array":
        for i, v in enumerate(value):
            out += plain(v, f"{path}[*]", f"{at}[{i}]")
    return out


def test_contracts_against_a_walk(spark):
    rng = random.Random(1)

    def value(depth):
        kind = rng.choice(["n", "s", "b", "0", "o", "o", "a", "a"]) if depth else rng.choice("nsb0")
        if kind == "o":
            return {k: value(depth - 1) for k in rng.sample(["a", "b", "c", "d", "e"], rng.randrange(4))}
        if kind == "a":
            return [value(depth - 1) for _ in range(rng.randrange(3))]
        return {"n": rng.choice([1, 2.5, 10**12]), "s": "x", "b": True, "0": None}[kind]

    values = [{"a": 1, "b": [[{"c": True}, {"c": 1, "x": 2}, "s"], 4], "d": {"e": 2}}, {"a": None, "d": 5}] + [value(4) for _ in range(80)]
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)] + [(900, "{broken"), (901, None), (902, "")]
    got = contracts.output_errors(spark.createDataFrame(rows, "event_id long, output string"), spark.createDataFrame(CONTRACT, contracts.CONTRACT))
    want = [(i, *e) for i, v in enumerate(values) for e in plain(v)] + [(i, "$", "not JSON") for i in (900, 901, 902)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 90


def test_counts_at_every_position_are_those_of_replays(spark):
    rows = [(1, 1, 1.0, 3.0, 6.0, None), (1, 2, 2.0, 4.0, None, 5.0), (1, 3, 2.0, None, None, None), (2, 4, 7.0, 7.0, None, 9.0)]
    cycle = spark.createDataFrame(rows, "run_id long, proposal_id long, filed_pos double, integrated_pos double, reopened_pos double, done_pos double")
    asked = spark.createDataFrame([(r, p) for r in (1, 2, 3) for p in range(12)], "run_id long, pos long")
    got = {(r.run_id, int(r.pos)): (r.open, r.integrated, r.done) for r in runs.counts_at(runs.state_intervals(cycle), asked).collect()}

    def state(r, p):
        _, _, filed, integrated, reopened, done = r
        past = lambda x: x is not None and x <= p
        return None if not past(filed) else "done" if past(done) else "integrated" if past(integrated) and not past(reopened) else "open"

    for run in (1, 2, 3):
        for p in range(12):
            states = [state(r, p) for r in rows if r[0] == run]
            assert got[run, p] == tuple(states.count(s) for s in ("open", "integrated", "done"))


@pytest.mark.parametrize("budget", [0.0, 500.0, 900.0, 1234.5, 5000.0])
def test_one_budget_for_all_panels(spark, budget):
    rng = random.Random(3)
    rows = [(p, f"c{c}", 50.0 + rng.random() * 100, 30.0 + rng.random() * 100, 0.8 + rng.random() * 2, 500 * rng.random(), c == 3) for p in range(4) for c in range(4)]
    rows += [(9, "same", 80.0, 50.0, 1.0, 100.0, False), (8, "same", 80.0, 50.0, 1.0, 100.0, False)]  # ties
    levels = spark.createDataFrame(rows, "panel_id long, channel string, weekly double, half double, shape double, beta double, locked boolean")
    got = {(r.panel_id, r.channel): r.planned for r in mix.global_plan(levels, budget, steps=20, grid=4).collect()}
    _, each = mix._steps(levels, 0.5, 20)
    floors = {(r[0], r[1]): r[2] if r[6] else r[2] / 2 for r in rows}
    free, used, want = budget - sum(floors.values()), 0.0, dict(floors)
    for r in sorted(each.collect(), key=lambda r: (-r.gain, r.panel_id, r.channel, r.k)):
        used += r.step
        if free <= 0 or used > free + 1e-9:
            break
        want[r.panel_id, r.channel] += r.step
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_merged_quantiles_are_within_their_bound(spark):
    rng = random.Random(4)
    rows = [(d, g, rng.gauss(d, 10)) for d in range(20) for g in ("x", "y") for _ in range(1500)] + [(0, "x", None), (1, "y", float("nan"))]
    df = spark.createDataFrame(rows, "day int, g string, v double")
    ranks = [0.01, 0.25, 0.5, 0.9, 0.999]
    got = z.merged_quantiles(z.quantile_sketches(df, "v", "g", "day"), ranks, "g").collect()
    assert len(got) == 10
    for r in got:
        values = sorted(v for _, g, v in rows if g == r.g and v is not None and v == v)
        rank = sum(v <= r.quantile for v in values) / len(values)
        assert r.n == len(values) == 30_000 and abs(rank - r["rank"]) < 0.01
    assert z.merged_quantiles(z.quantile_sketches(df.limit(0), "v", "g", "day"), ranks, "g").count() == 0


def test_queries_of_sketches_run_on_the_table(spark, sf_dir):
    from millrace import queries

    got = queries.collect("QUERIES")["z_merged_quantiles"](spark, sf_dir)
    exact = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").agg(F.percentile(F.col("l_extendedprice").cast("double"), 0.5).alias("m"))
    for r in got.filter("rank = 0.5").join(exact, "l_returnflag").collect():
        assert abs(r.quantile - r.m) < 0.02 * r.m


def test_the_last_outcome_counts(spark):
    from millrace.operators import ledger

    actions = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "event_id long, subject_ref string")
    rows = [("a", 9, 9, 900.0, 1), ("a", 5, 1, 10.0, 2), ("b", 1, 1, 7.0, 5), ("b", 2, 2, 8.0, 4)]
    outcomes = spark.createDataFrame(rows, "subject_ref string, sessions long, conversions long, revenue double, seq int")
    decided = spark.createDataFrame([(1, "block"), (2, "auto"), (3, "auto")], "event_id long, decision string")
    got = {r.decision: (r.n, r.revenue) for r in ledger.gate_exposure(decided, actions, outcomes).collect()}
    assert got == {"block": (1, 10.0), "auto": (2, 7.0)}
