"""The copy gate over span tables: sample drafts with known answers, and places in odd texts."""

import pytest

from millrace.operators import ruleset, spans

SCHEMA = "draft_id long, channel string, market string, text string, extra string"
SAMPLES = {
    1: ("rsa", "UK", "H: Expense cards for every team\nH: Used by 40,000+ companies\nH: Receipts matched for you\nH: Set card limits in two clicks\n"
        "D: Save up to 10 hours a month on expense reports. Give each team its own card.\nD: Issue cards in minutes and see every payment as it happens."),
    2: ("meta", "US", "Primary: Switching from SpendHive? Move your cards and policies over in a day, with seamless setup and a free onboarding call.\n"
        "Headline: Expense cards your team will use"),
    3: ("email", "UK", "Subject: The #1 expense card for finance teams. Guaranteed.\nPreheader: Cheaper than Ledgerly and risk-free!\n"
        "We built a revolutionary platform. Our customers save 15 hours a month on expense reports, and we offer 0% interest on card spend for 60 days.\n"
        "Our bank-grade security keeps every payment safe. ACT NOW!!"),
}
LINES = [
    ("Give every team a card and see spend as it happens.", "approve", []),
    ("Save up to 10 hours a month on expense reports.", "approve", ["CLM-OK:EV-014"]),
    ("Save 20 hours a month on expense reports.", "block", ["CLM-ALTERED:EV-014"]),
    ("Used by 40,000+ companies across Europe.", "approve", ["CLM-OK:EV-002"]),
    ("Trusted by 25,000 companies.", "block", ["CLM-RETIRED:EV-009"]),
    ("Unlock seamless spend control with our revolutionary cards!", "review", ["TOV-HYPE"]),
    ("Fernway is cheaper than Ledgerly on list price for teams of 50 or more.", "review", ["CMP-COMPARE:EV-052", "CMP-MENTION", "CLM-OK:EV-052"]),
    ("Cheaper than Ledgerly on list price for teams of 20 or more.", "block", ["CLM-ALTERED:EV-052", "CMP-COMPARE", "CMP-MENTION"]),
    ("Cheaper than Ledgerly for 50 countries.", "block", ["CLM-OK:EV-052", "CMP-COMPARE", "CMP-MENTION"]),
    ("Clearbook is clunky. Fernway is not.", "block", ["CMP-DISPARAGE", "CMP-MENTION"]),
    ("Receipts matched automatically in 92% of cases.", "approve", ["CLM-OK:EV-027"]),
    ("The #1 expense card in Europe.", "block", ["CLM-SUPERLATIVE"]),
    ("Spend in 30+ currencies with no FX markup.", "approve", ["CLM-OK:EV-033"]),
    ("1% cashback on card spend, risk-free.", "block", ["UK-FCA-ABSOLUTE", "CLM-OK:EV-045"]),
    ("Cards issued in 2 minutes.", "approve", ["CLM-QUALIFIER:EV-021"]),
    ("We are ISO 27001 certified and SOC 2 ready.", "block", ["SEC-CERT", "CLM-OK:EV-060"]),
    ("Our plan beats Clearbook vs. anything.", "block", ["CMP-COMPARE", "CMP-MENTION"]),
    ("Apply now at 9% APR. Representative example: none.", "block", ["CLM-UNSUB"]),
    ("Nr. 1 and number 1, no. 1!", "block", ["CLM-SUPERLATIVE"] * 3),
]


def gate(spark, rows, rules=None):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    found = spans.findings(df, rules or ruleset.house(spark))
    by = {}
    for r in found.orderBy("draft_id", "n").collect():
        by.setdefault(r.draft_id, []).append(r)
    return by, {r.draft_id: r for r in spans.verdicts(df, found).collect()}


def said(text, row):
    units = text.encode("utf-16-le")
    return [units[2 * s.start : 2 * s.stop].decode("utf-16-le") for s in row.spans]


@pytest.fixture(scope="module")
def samples(spark):
    rows = [(k, *v) for k, v in SAMPLES.items()]
    rows += [(100 + k, "linkedin", "UK", t) for k, (t, _, _) in enumerate(LINES)]
    return gate(spark, rows)


def test_sample_drafts(samples):
    found, verdict = samples
    listed = lambda k: [(r.rule, r["count"], said(SAMPLES[k][2], r)) for r in found[k]]
    assert verdict[1].verdict == "approve" and listed(1) == [("CLM-OK", 1, ["40,000+"]), ("CLM-OK", 1, ["10"])]
    assert (verdict[2].verdict, verdict[2].score, verdict[2].reason) == ("review", 35, "CMP-MENTION, US-FREE")
    assert listed(2) == [("CMP-MENTION", 1, ["SpendHive"]), ("TOV-HYPE", 1, ["seamless"]), ("US-FREE", 1, ["free"])]
    assert (verdict[3].verdict, verdict[3].score) == ("block", 100)
    assert listed(3) == [
        ("CLM-SUPERLATIVE", 1, ["#1"]), ("UK-FCA-ABSOLUTE", 2, ["Guaranteed", "risk-free"]), ("CMP-COMPARE", 1, ["Cheaper than", "Ledgerly"]),
        ("CLM-ALTERED", 1, ["15"]), ("CLM-UNSUB", 1, ["0%"]), ("UK-CREDIT-REP", 1, ["interest"]), ("CMP-MENTION", 1, ["Ledgerly"]),
        ("TOV-EXCLAIM", 2, ["!", "!", "!"]), ("TOV-HYPE", 1, ["revolutionary"]), ("SEC-VAGUE", 1, ["bank-grade"]), ("TOV-PUSHY", 1, ["ACT NOW"]),
        ("TOV-CAPS", 2, ["ACT", "NOW"]), ("TOV-PERSON", 1, []),
    ]


@pytest.mark.parametrize("k", range(len(LINES)))
def test_lines(samples, k):
    found, verdict = samples
    rows = found.get(100 + k, [])
    got = sorted(r.rule + (f":{r.evidence}" if r.evidence else "") for r in rows if r.rule != "TOV-PASSIVE")
    assert (verdict[100 + k].verdict, got) == (LINES[k][1], sorted(LINES[k][2]))


def test_fields_rules_and_odd_drafts(spark):
    long = "Word " * 40
    rows = [
        (1, "rsa", "UK", "H: Hey! \U0001f600 You!\nplain line\nD: " + "d" * 95),
        (2, "email", "DE", "Body text here\n\nmore of it\nSubject: " + "s" * 61),
        (3, "linkedin", "US", "\U0001f680 " + long.strip() + ".\nFree free FREE, no strings. Gratis."),
        (4, "linkedin", "DE", "Kostenlos. Kostenlos zzgl. Versand. MARKTFÜHRER und Marktführer."),
        (5, None, None, None),
        (6, "tv", "FR", "   \r\n "),
        (7, "linkedin", "UK", "game changing, game-changing: seamlessly!"),
        (8, "meta", "UK", "word " * 4000 + "hurry"),
    ]
    found, verdict = gate(spark, rows, ruleset.house(spark, ("plain line",)))
    text = {r[0]: r[3] for r in rows}
    of = lambda k: {r.rule: said(text[k], r) for r in found.get(k, [])}
    assert of(1)["FMT-RSA-EXCLAIM"] == ["!", "!"] and of(1)["LEN-RSA-DESC"] == ["d" * 5] and of(1)["TOV-EMOJI"] == ["\U0001f600"]
    assert of(1)["TOV-CUSTOM"] == ["plain line"] and "FMT-RSA-LABEL" in of(1) and of(1)["TOV-EXCLAIM"] == ["!", "!"]
    assert of(2)["LEN-EMAIL-SUBJ"] == ["s"] and "FMT-EMAIL-PRE" in of(2) and "FMT-EMAIL-SUBJ" not in of(2)
    assert of(3)["LEN-LI-HOOK"][0].startswith("rd Word") or of(3)["LEN-LI-HOOK"] and of(3)["TOV-LONG-SENT"]
    assert "US-FREE" not in of(3) and of(3)["TOV-EMOJI"] == ["\U0001f680"] and of(3)["TOV-CAPS"] == ["FREE"]
    assert of(4)["DE-FREE"] == ["Kostenlos"] and len([r for r in found[4] if r.rule == "CLM-SUPERLATIVE"]) == 2
    assert verdict[5].verdict == verdict[6].verdict == "empty" and 5 not in found and 6 not in found
    hype = next(r for r in found[7] if r.rule == "TOV-HYPE")
    assert said(text[7], hype) == ["game changing", "game-changing", "seamlessly"] and hype.message == "Hype words: game changing, game-changing, seamlessly."
    assert of(8)["TOV-PUSHY"] == ["hurry"] and of(8)["LEN-META-PRIMARY"][0].endswith("hurry")
    assert spans.findings(spark.createDataFrame([], SCHEMA), ruleset.house(spark)).count() == 0


def test_a_rule_as_a_row(spark):
    """A rule added to the tables finds without any code."""
    house = ruleset.house(spark)
    rule = spark.createDataFrame([(90, "OWN-RULE", "block", 7, "phrase", ["linkedin"], None, '{"unless": "nearly", "unlessScope": "sentence"}', "Says {terms} {n} times.", "Stop."), (91, "OWN-PATTERN", "info", None, "regex", None, None, r'{"pattern": "(?i)\\bq[0-9]+\\b"}', "Quarter: {terms}.", "")], ruleset.RULE_SCHEMA)
    rows = house.rules.withColumn("params", house.rules["params"].cast("string")).unionByName(rule)
    terms = house.terms.unionByName(spark.createDataFrame([("OWN-RULE", "zero down?", None), ("OWN-RULE", "zero", None)], ruleset.TERM_SCHEMA))
    more = ruleset.Ruleset.of(rows, terms, house.register)
    found, verdict = gate(spark, [(1, "linkedin", "DE", "Zero down. ZERO dow. It is zero. Nearly zero."), (2, "meta", "DE", "Zero down. In Q3 and q41, not xQ1 or Q2b.")], more)
    own = [(r["count"], r.weight, r.message, said("Zero down. ZERO dow. It is zero. Nearly zero.", r)) for r in found[1] if r.rule == "OWN-RULE"]
    assert own == [(3, 7, "Says Zero down, ZERO dow, zero 3 times.", ["Zero down", "ZERO dow", "zero"])]
    assert [r.message for r in found[2] if r.rule == "OWN-PATTERN"] == ["Quarter: Q3, q41."]
    assert verdict[1].verdict == "block" and not any(r.rule == "OWN-RULE" for r in found.get(2, []))


def test_drafts_are_read_once(spark, tmp_path):
    spark.createDataFrame([(1, "meta", "UK", "Act now. Free!")], "draft_id long, channel string, market string, text string").write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    scan, matchers = spans.scanned(df, ruleset.house(spark))
    plan = spans.findings_of(scan, matchers, ruleset.house(spark))._jdf.queryExecution().toString()
    assert str(tmp_path) not in plan  # all further work reads what the one pass has written


def test_a_stream_of_drafts_gets_the_verdicts_of_the_batch(spark, tmp_path):
    from millrace.streaming.drafts import decided, gate_drafts

    schema = "draft_id long, channel string, market string, text string"
    rows = [(k, "linkedin", "UK", t) for k, (t, _, _) in enumerate(LINES)] + [(100, "meta", "US", None)]
    for k in range(0, len(rows), 8):
        spark.createDataFrame(rows[k : k + 8], schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    asked = []

    def rules():
        asked.append(1)
        return ruleset.house(spark)

    gate_drafts(stream, rules, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = {r.draft_id: r.verdict for r in decided(spark, str(tmp_path / "out")).collect()}
    assert got == {k: v for k, (_, v, _) in enumerate(LINES)} | {100: "empty"} and len(asked) == 3
