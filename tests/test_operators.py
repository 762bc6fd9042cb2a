"""Known answers and invariants that need no table."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import contacts as n
from millrace.operators import copygate, entity, experiments, graph, leads, ledger, mix, runs
from millrace.sources import files
from millrace.streaming import ledger as live


def values(spark, expression, inputs):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(inputs)], "k int, c string")
    return [r.v for r in df.select("k", expression(F.col("c")).alias("v")).orderBy("k").collect()]


def test_phonetics(spark):
    assert len(set(values(spark, n.cologne, ["Müller", "Mueller", "Muller"]))) == 1
    assert values(spark, n.cologne, ["Wikipedia", "Breschnew", "", "Xaver", "Philipp", "Tsch"]) == ["3412", "17863", "", "4837", "351", "8"]


def test_accents(spark):
    assert values(spark, n.fold, ["Nguyễn", "Ŵilliam", "Ķēniņš ģ ļ", "Ærø", "E\u0301va", "Größe"]) == ["nguyen", "william", "kenins g l", "ærø", "eva", "groesse"]


def test_phones(spark):
    got = values(spark, lambda c: n.phone(c, F.lit("DE"))["value"], ["+49 (0)30 1234567", "0049 30 1234567", "030/1234567", "12", "030 1234567 ext. 9"])
    assert got == ["+49301234567"] * 3 + ["12", "+49301234567"]
    assert values(spark, lambda c: n.phone(c, F.lit("US"))["value"], ["1 212 555 0100", "212 555 0100"]) == ["+12125550100"] * 2


def test_emails_names_companies_dates(spark):
    assert values(spark, lambda c: n.email(c)["key"], ["J.o.e+x@GoogleMail.com", "a.b+c@x.org", "bad", None]) == ["joe@gmail.com", "a.b@x.org", "bad", ""]
    assert values(spark, n.name_case, ["ANNA-LENA o'neil", "ludwig VAN beethoven", "mcdonald", "MACDONALD machado"]) == ["Anna-Lena O'Neil", "Ludwig van Beethoven", "McDonald", "MacDonald Machado"]
    assert values(spark, lambda c: F.concat_ws("/", n.split_full(c)["first"], n.split_full(c)["last"]), ["Dr. Anna von der Leyen", "Bach, Johann", "Cher"]) == ["Anna/von der Leyen", "Johann/Bach", "/Cher"]
    assert values(spark, n.company, ["ACME GmbH & Co. KG", "beta, Inc.", "GmbH", "KPMG AG"]) == ["Acme", "Beta", "GMBH", "KPMG"]
    assert values(spark, lambda c: n.date(c, F.lit("US")), ["13/02/2026", "02/13/2026", "03/04/2026", "1.2.2026", "2026-2-31", "40.1.2026", "x"]) == ["2026-02-13", "2026-02-13", "2026-03-04", "2026-02-01", "2026-02-31", "", ""]
    assert values(spark, lambda c: n.date(c, F.lit("DE")), ["03/04/2026"]) == ["2026-04-03"]
    assert values(spark, n.title, ["vp OF sales", "head of it"]) == ["VP of Sales", "Head of IT"]


def test_detected_columns():
    assert entity.detect_columns(["Record ID", "First Name", "E-Mail", "Firma", "Note"]) == {"id": "Record ID", "first": "First Name", "email": "E-Mail", "company": "Firma"}


def plain_jaro_winkler(a, b):
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, left = set(), []
    for i, ch in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in taken and b[j] == ch), None)
        if j is not None:
            taken.add(j)
            left.append(ch)
    if not left:
        return 0.0
    moved = sum(x != y for x, y in zip(left, [b[j] for j in sorted(taken)], strict=True)) / 2
    m = len(left)
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


def test_jaro_winkler(monkeypatch):
    rng = random.Random(1)
    names = ["".join(rng.choice("abcdeé\U0001f600") for _ in range(rng.randrange(0, 14))) for _ in range(60)] + ["martha", "marhta", "x" * 300, "xy" * 200, None]
    pairs = [(a, b) for a in names for b in names]
    want = [plain_jaro_winkler(a, b) if a and b else None for a, b in pairs]
    for cells in (1 << 20, 500):
        monkeypatch.setattr(n, "CELLS", cells)
        got = n.similarities(*zip(*pairs, strict=True))
        assert all((x != x) if w is None else abs(x - w) < 1e-12 for x, w in zip(got, want, strict=True))
    assert abs(n.similarities(["martha"], ["marhta"])[0] - 0.9611111) < 1e-6 and len(n.similarities([], [])) == 0


def test_components_do_not_depend_on_order(spark):
    chain = [(k, k + 1) for k in range(30)] + [(100, 101), (102, 101), (7, 7), (None, 3)]
    for edges in (chain, [(b, a) for a, b in reversed(chain)]):
        got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
        assert got == {**{k: 0 for k in range(31)}, 100: 100, 101: 100, 102: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_simplex_weights():
    rng = np.random.default_rng(0)
    for k in (1, 2, 9):
        a = rng.normal(size=(40, k)) + 1
        y = a @ np.full(k, 1 / k) + rng.normal(size=40) * 0.1
        g, b = a.T @ a, a.T @ y
        w = experiments._fit(g, b)
        value = lambda v: 0.5 * v @ g @ v - b @ v
        assert abs(w.sum() - 1) < 1e-9 and (w >= 0).all() and value(w) <= value(np.full(k, 1 / k)) + 1e-9


def test_ridge_keeps_media_non_negative():
    rng = np.random.default_rng(1)
    x = np.column_stack([np.ones(80), rng.random((80, 3))])
    y = x @ np.array([1, 2.0, -3, 0.5])
    beta, error = mix._ridge(x, y, 3)
    assert (beta[1:] >= 0).all() and beta[2] == 0
    assert abs(error - ((y - x @ beta) ** 2).sum()) < 1e-9
    # The intercept is free: a constant moves it alone.
    assert np.allclose(mix._ridge(x, y + 100, 3)[0] - beta, [100, 0, 0, 0], atol=1e-6)


def test_curve_fit_finds_planted_curves(spark):
    rng = np.random.default_rng(3)
    weeks = [dt.date(2024, 1, 1) + dt.timedelta(weeks=k) for k in range(104)]
    spend, target = [], []
    for panel in (1, 2):
        raw = {c: np.where(rng.random(104) < 0.5, rng.uniform(20, 200, 104), 0.0) for c in ("a", "b")}
        curves = {"a": (0.0, 1.0, 1.5, 300.0), "b": (0.5, 0.6, 1.0, 200.0)}
        y = 1000.0 + 50 * np.sin(2 * np.pi * np.arange(104) / mix.YEAR)
        for c, (decay, multiple, shape, beta) in curves.items():
            run, half = 0.0, multiple * raw[c].mean()
            for k in range(104):
                run = run * decay + raw[c][k]
                x = run * (1 - decay)
                y[k] += beta / (1 + (half / x) ** shape) if x > 0 else 0.0
        spend += [(panel, w, c, float(v)) for c in raw for w, v in zip(weeks, raw[c], strict=True)]
        target += [(panel, w, float(v + rng.normal() * 2)) for w, v in zip(weeks, y, strict=True)]
    s = spark.createDataFrame(spend, "panel_id long, week date, channel string, spend double")
    t = spark.createDataFrame(target, "panel_id long, week date, revenue double")
    model = mix.fit_panels(s, t)
    got = {(r.panel_id, r.channel): r for r in model.collect() if r.decay is not None}
    for panel in (1, 2):
        assert abs(got[panel, "a"].decay) <= 0.1 and abs(got[panel, "b"].decay - 0.5) <= 0.1
    quality = mix.fit_quality(mix.fitted(t, mix.adstock(s), model)).collect()
    assert all(r.r2 > 0.95 and r.holdout_mape < 0.05 for r in quality)


def test_objections_before_the_filing_are_dropped(spark):
    log = spark.createDataFrame([(1, k, dt.datetime(2024, 1, 1, k), r, "ok", 0.0) for k, r in enumerate(["critic", "architect", "research", "critic", "engineer"], 1)], "run_id long, pos long, ts timestamp, role string, status string, cost_usd double")
    proposals = spark.createDataFrame([(1, 7, "architect", 2, dt.datetime(2024, 1, 1, 2))], "run_id long, proposal_id long, filed_by string, pos long, ts timestamp")
    objections = spark.createDataFrame([(1, 7, "critic", 1)], "run_id long, proposal_id long, role string, pos long")
    built = spark.createDataFrame([(1, 7, "engineer", 5)], "run_id long, proposal_id long, role string, pos long")
    (row,) = runs.lifecycle(log, proposals, objections, built).collect()
    assert (row.state, row.integrated_pos, row.done_pos, row.dropped, row.objections, row.warnings) == ("done", 4.0, 5.0, 1, 0, 1)


def test_backtest_windows(spark):
    days = [(1, "a", dt.date(2024, 1, 1) + dt.timedelta(days=k), 1.0) for k in range(100)]
    panel = spark.createDataFrame(days, "test_id long, geo string, day date, kpi double")
    tests = spark.createDataFrame([(1, dt.date(2024, 1, 1) + dt.timedelta(days=80))], "test_id long, start date")
    got = sorted((r.window_id, (r.stop - r.start).days) for r in experiments.windows(panel, tests).collect())
    assert len(got) == 24 and got[0] == (28, 20) and got[-1] == (60, 20)
    late = tests.withColumn("start", F.lit(dt.date(2024, 2, 10)))
    assert experiments.windows(panel, late).collect() == []


def test_suggested_cell_passes_over_large_geos(spark):
    ranked = spark.createDataFrame([(1, "big", 0.01, 0.07), (1, "a", 0.02, 0.05), (1, "b", 0.03, 0.06), (1, "c", 0.04, 0.06), (1, "d", 0.05, 0.01)], "test_id long, geo string, mape double, share double")
    (row,) = experiments.suggest_cell(ranked).collect()
    assert row.geos == ["a", "b", "c"] and abs(row.share - 0.17) < 1e-9


def test_phrase_hits_keep_their_places(spark):
    text = "Act now: a game-changer.\nAct NOW, free*. It is free"
    rules = [copygate.Rule("P", "warn", ("act now", "game-chang*")), copygate.Rule("F", "warn", ("free",), unless=r"\*", unless_scope="sentence")]
    drafts = spark.createDataFrame([(1, "linkedin", "UK", text), (2, "linkedin", "UK", None)], "draft_id long, channel string, market string, text string")
    got = sorted((r.rule, r.start, r.stop, r.term) for r in copygate.phrase_hits(drafts, rules).collect())
    assert [(r, text[a:b].lower()) for r, a, b, _ in got] == [(r, t) for r, _, _, t in got]
    assert [(r, t) for r, _, _, t in got] == [("F", "free"), ("P", "act now"), ("P", "game-changer"), ("P", "act now")]
    assert got[0][1] == text.rindex("free")
    said = {r.rule: r.message for r in copygate.with_messages(copygate.phrase_findings(drafts, rules), rules).collect()}
    assert said == {"P": "Found: act now, game-changer.", "F": "Found: free."}


def test_budget_plan_stays_in_bounds(spark):
    levels = spark.createDataFrame([(1, "a", 100.0, 50.0, 1.0, 900.0, False), (1, "b", 100.0, 400.0, 2.0, 500.0, False), (1, "c", 50.0, 10.0, 1.0, 9.0, True)], "panel_id long, channel string, weekly double, half double, shape double, beta double, locked boolean")
    plan = {r.channel: r for r in mix.budget_plan(levels, spark.createDataFrame([(1, 250.0)], "panel_id long, budget double")).collect()}
    assert plan["c"].planned == 50.0 and all(50 <= plan[c].planned <= 150.0001 for c in "ab")
    assert sum(r.planned for r in plan.values()) <= 250.0001


def test_deciles_and_ties(spark):
    rows = spark.createDataFrame([(k, float(k // 2), k % 2) for k in range(13)], "id long, score double, y int")
    assert [r.n for r in leads.deciles(rows).orderBy("decile").collect()] == [1, 2, 1, 1, 2, 1, 1, 1, 2, 1]
    assert abs(leads.auc(rows).first().auc - 0.5) < 0.08


def test_terms_and_hash(spark):
    pattern = copygate.term_pattern(["game-chang*", "free"])
    assert values(spark, lambda c: c.rlike(pattern), ["a game-changer", "FREE!", "freedom", "#free", "carefree"]) == [True, True, False, False, False]
    assert values(spark, copygate.fnv1a, ["abc", ""]) == ["1a47e90b", "811c9dc5"]


def test_claim_outcomes(spark):
    drafts = [(1, "UK", "Save up to 10 hours a month on expense reports."), (2, "UK", "Save 10 hours a month on expense reports."), (3, "UK", "Save up to 25 hours a month on expense reports."), (4, "US", "1% cashback on card spend"), (5, "UK", "We hired 40 customers more."), (6, "UK", "In 2024 we grew. ISO 27001 applies.")]
    df = spark.createDataFrame(drafts, "draft_id long, market string, text string")
    register = spark.createDataFrame(
        [(0, "EV-1", "Save up to 10 hours a month on expense reports", [10.0], "up to", ["UK", "US"], None), (1, "EV-2", "1% cashback on card spend", [1.0], None, ["UK"], None)],
        "reg_no int, id string, claim string, numbers array<double>, qualifier string, markets array<string>, retired string",
    )
    got = {r.draft_id: r.outcome for r in copygate.register_match(copygate.claim_numbers(copygate.sentences(df)), register).collect()}
    assert got == {1: "ok", 2: "qualifier dropped", 3: "altered", 4: "wrong market", 5: "unsubstantiated"}


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "in.csv").write_text('id , note\n1,"a ""b""\nc"\n , \n2, x \n')
    rows = files.read_csv(spark, str(tmp_path / "in.csv"))
    assert sorted((r.id, r.note) for r in rows.collect()) == [("1", 'a "b"\nc'), ("2", "x")]
    files.write_csv(rows, str(tmp_path / "out"), ["note"])
    assert sorted(r.note for r in files.read_csv(spark, str(tmp_path / "out")).collect()) == ['a "b"\nc', "x"]


@pytest.fixture
def actions(spark, tmp_path):
    at = dt.datetime(2026, 8, 1, 9)
    rows = [(k, at + dt.timedelta(hours=5 * k), "ab"[k % 2], "email.send", "email", f"r{k % 3}", None, "Hello!!! " * (k % 2) + "hi there") for k in range(20)]
    schema = "event_id long, ts timestamp, agent_id string, action_type string, channel string, subject_ref string, subject string, text string"
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(str(tmp_path / "actions"))
    return df, lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "actions"))


def drained(query_df, name, mode="append"):
    q = query_df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return query_df.sparkSession.table(name).collect()


def test_stream_gate_appends_decisions(spark, actions, tmp_path):
    _, stream = actions
    rows = stream().withColumn("budget_new", F.lit(None).cast("double")).withColumn("agent_label", F.col("agent_id"))
    policy = ledger.Policy(competitors=("hi there",))
    live.gate(rows, policy, str(tmp_path / "gate"), str(tmp_path / "state")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "gate"))
    assert got.count() == 20 and {r.decision for r in got.collect()} == {"block"}


def test_streams_agree_with_batches(spark, actions):
    batch, stream = actions
    policy = ledger.Policy(max_emails_per_day=4)
    checked = drained(live.stateless_checks(stream(), policy), "t_tone")
    assert {(r.event_id, r.score, r.verdict) for r in checked if r.check_type == "tov"} == {tuple(r) for r in ledger.tone(batch, policy).collect()}
    phrases = {(r.event_id, r.check_type, r.verdict) for r in ledger.phrase_checks(batch, policy).collect()}
    assert {(r.event_id, r.check_type, r.verdict) for r in checked if r.check_type != "tov"} == phrases
    assert len(drained(live.deduplicated(stream()), "t_dedup")) == 20
    days = {(r.agent_id, r.day): r.emails for r in drained(live.email_days(stream(), policy), "t_days")}
    want = {(r.agent_id, r.day): r.emails for r in ledger.email_days(batch.withColumn("day", F.to_date("ts"))).collect()}
    assert days and all(want[k] == v for k, v in days.items())
    pairs = {(r.event_id, r.other_id) for r in drained(live.conflicts(stream(), stream()), "t_conflicts")}
    assert (0, 3) in pairs and all(abs(a - b) == 3 for a, b in pairs)


def test_verdict_hashes_the_whole_draft(spark):
    """Drafts that differ after character 256 alone, and one beyond the basic plane, against a plain FNV-1a."""
    def plain(text):
        data, h = text.encode("utf-16-be"), 2166136261
        for k in range(0, len(data), 2):
            h = (h ^ int.from_bytes(data[k : k + 2], "big")) * 16777619 % 2**32
        return f"{h:08x}"

    texts = ["é word " * 200 + "a", "é word " * 200 + "b", "smile 😀 end"]
    drafts = spark.createDataFrame(list(enumerate(texts)), "draft_id long, text string")
    none = spark.createDataFrame([], "draft_id long, rule string, severity string, weight int, count long")
    got = {r.draft_id: r.hash for r in copygate.verdicts(drafts, none).collect()}
    assert got == {k: plain(t) for k, t in enumerate(texts)}


def test_stream_of_drift_alarms(spark, actions):
    _, stream = actions
    policy = ledger.Policy(warn_below=0.0, drop_threshold=0.2)
    days = drained(live.daily_tone(stream(), policy), "t_daily")
    base = spark.createDataFrame([(r.agent_id, r.channel, r["mean"] + (0.5 if k % 2 else 0.1)) for k, r in enumerate(days)], "agent_id string, channel string, baseline double").groupBy("agent_id", "channel").agg(F.max("baseline").alias("baseline"))
    top = {(r.agent_id, r.channel): r.baseline for r in base.collect()}
    alarms = {(r.agent_id, r.channel, r.day) for r in drained(live.drift_alarms(live.daily_tone(stream(), policy), base, policy), "t_alarms")}
    assert alarms == {(r.agent_id, r.channel, r.day) for r in days if top[r.agent_id, r.channel] - r["mean"] > 0.2}


def test_stream_of_provider_events(spark, tmp_path):
    event = '{"provider":"zapier","ext_id":"e%d","zap_title":"News","started_at":"2024-01-0%dT10:00:00Z","action":{"type":"send_email","output":{"subject":"s","body_text":"hello"}}}'
    raw = spark.createDataFrame([(event % (k % 3, 1 + k % 3),) for k in range(6)] + [("no json",)], "raw string")
    raw.coalesce(1).write.parquet(str(tmp_path / "raw"))
    stream = spark.readStream.schema("raw string").parquet(str(tmp_path / "raw"))
    got = drained(live.normalised(stream), "t_raw")
    assert sorted(r.event_id for r in got) == ["e0", "e1", "e2"] and {r.action_type for r in got} == {"email.send"}
