"""Governance of agent actions: checks, decisions, drift, outcome impact and report tables.

Actions have event_id (the ledger's order), ts, day, agent_id, agent_label, action_type, channel, subject_ref,
budget_new, subject and text. Each operator takes DataFrames and returns one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.numbers import clamp, half_up
from millrace.operators.sweep import first_by_another

# Fixed values.
TEXT_ACTIONS = ("email.send", "page.publish", "social.post", "task.execute")
BUDGET_ACTIONS = ("ad.budget_change", "ad.create")
CHECKS = ("tov", "claims", "competitor", "regulated", "spend", "conflict")
QUALITY_CHECKS = ("tov", "claims", "competitor", "regulated")
TIERS = {"auto": 1, "review": 2, "block": 3}
CHECK_LABELS = {
    "tov": "Tone of voice",
    "claims": "Claims",
    "competitor": "Competitor mentions",
    "regulated": "Regulated language",
    "spend": "Spend",
    "conflict": "Conflicting actions",
}
CHANNEL_LABELS = {
    "email": "Email",
    "web": "Web",
    "paid_social": "Paid social",
    "paid_search": "Paid search",
    "organic_social": "Organic social",
    "agent_run": "Live agent run",
}
ACTION_LABELS = {
    "email.send": "Sent an email",
    "page.publish": "Published a page",
    "ad.create": "Created an ad",
    "ad.budget_change": "Changed ad budget",
    "social.post": "Posted to social",
    "task.execute": "Ran a task",
}
SOURCE_LABELS = {"hubspot": "HubSpot", "zapier": "Zapier", "lindy": "Lindy", "agent_governance": "Deployed here"}
SUBSTANTIATED = (
    r"(?i)(according to|based on|case study|\bstudy\b|customer[- ]reported|median|on average|average of|\d+\s*(customers|teams)\b)"
)
EMOJI = "[☀-➿\U0001f300-\U0001faff]"


@dataclass(frozen=True)
class Policy:
    banned: tuple[str, ...] = (
        "act now", "buy now", "limited time", "don't miss out", "hurry", "you won't believe", "click here right now",
    )
    max_sentence_words: int = 26
    allow_emoji: bool = False
    fail_below: float = 0.5
    warn_below: float = 0.75
    claims: tuple[str, ...] = (
        "guarantee", "guaranteed", "risk-free", "#1", "best-in-class", "proven", "double your", "10x", "no-brainer",
    )
    claim_triggers: tuple[str, ...] = (
        "revenue", "roi", "profit", "sales", "save", "cheaper", "cut costs", "double your", "faster", "productivity",
        "efficiency", "stress", "wellbeing", "burnout",
    )
    competitors: tuple[str, ...] = ("Taskmere", "Weekday.io", "Pinwheel", "Corkline", "Lattix", "Foliopad")
    regulated: tuple[str, ...] = (
        "risk-free", "no risk", "bank-level", "military-grade", "soc 2 certified", "fully gdpr compliant", "hipaa compliant",
    )
    max_emails_per_day: float = 5
    ceilings: dict[str, float] = field(default_factory=lambda: {"lifecycle-bot": 0.0, "blog-agent": 300.0})
    conflict_hours: float = 24
    drop_threshold: float = 0.2
    drift_min_samples: int = 1
    outcome_min_samples: int = 3
    default: str = "auto"
    # (decision, check or None for any, verdict or None for any); the first that fits a check counts.
    rules: tuple[tuple[str, str | None, str | None], ...] = (
        ("block", "competitor", "fail"),
        ("block", "spend", "fail"),
        ("review", "claims", "fail"),
        ("review", "tov", "fail"),
        ("review", "regulated", "warn"),
        ("review", None, "fail"),
        ("auto", None, "warn"),
    )


def _joined(sep: str) -> Column:
    filled = [F.when(F.col(c) != "", F.col(c)) for c in ("subject", "text")]
    return F.concat_ws(sep, *filled)


def _hits(text: Column, phrases: tuple[str, ...]) -> Column:
    """The phrases that a lower-case text contains, in the order given."""
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(p.lower())), F.lit(p)) for p in phrases] or [F.lit(None)]))


def _labels(key: Column, labels: dict[str, str]) -> Column:
    """Label of a code; the code itself where there is none."""
    out = key
    for code, label in labels.items():
        out = F.when(key == code, label).otherwise(out)
    return out


def labelled(df: DataFrame) -> DataFrame:
    """df with the labels of the codes it has: check_label, channel_label, action_label, source_label."""
    known = {"check_type": ("check_label", CHECK_LABELS), "channel": ("channel_label", CHANNEL_LABELS), "action_type": ("action_label", ACTION_LABELS), "source": ("source_label", SOURCE_LABELS)}
    return df.withColumns({name: _labels(F.col(c), labels) for c, (name, labels) in known.items() if c in df.columns})


def _counted(actions: DataFrame, policy: Policy) -> DataFrame:
    """Actions with one column for each pattern: each is counted once, whatever the score uses it for."""
    text = _joined("\n")
    capitals = F.filter(
        F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])([A-Z]{2,})(?![A-Za-z0-9_])"), 1), lambda w: ~w.isin("USD", "US")
    )
    return actions.withColumns(
        {
            "words": F.regexp_count(text, F.lit(r"\p{L}[\p{L}']*")),
            "capitals": F.size(capitals),
            "bangs": F.regexp_count(text, F.lit("!")),
            "sentences": F.regexp_count(text, F.lit(r"[^.!?]*[^.!?\s][^.!?]*")),
            "banned": F.size(_hits(F.lower(text), policy.banned)),
            "doubled": F.contains(text, F.lit("!!")),
            "emoji": F.lit(False) if policy.allow_emoji else text.rlike(EMOJI),
        }
    )


def _scored(actions: DataFrame, policy: Policy) -> DataFrame:
    """actions with what their texts' score counts, the score and tone_verdict."""
    share = F.when(F.col("words") > 0, F.col("capitals") / F.col("words")).otherwise(0.0)
    mean = F.when(F.col("sentences") > 0, F.col("words") / F.col("sentences")).otherwise(0.0)
    raw = (
        F.lit(1.0)
        - 0.25 * F.col("banned")
        - F.when(share > 0.6, 0.5).when(share > 0.3, 0.3).otherwise(0.0)
        - F.when(F.col("bangs") >= 3, 0.3).otherwise(0.0)
        - F.when(F.col("doubled"), 0.2).otherwise(0.0)
        - F.when(mean > policy.max_sentence_words, 0.15).otherwise(0.0)
        - F.when(F.col("emoji"), 0.15).otherwise(0.0)
    )
    scored = _counted(actions, policy).withColumn("score", half_up(clamp(raw, 0.0, 1.0), 3))
    verdict = F.when(F.col("score") < policy.fail_below, "fail").when(F.col("score") < policy.warn_below, "warn").otherwise("pass")
    return scored.withColumn("tone_verdict", verdict)


def with_tone(actions: DataFrame, policy: Policy) -> DataFrame:
    """The actions that carry text, with what their score counts, the score and the verdict."""
    return _scored(actions.filter(F.col("action_type").isin(*TEXT_ACTIONS)), policy).withColumnRenamed("tone_verdict", "verdict")


def tone(actions: DataFrame, policy: Policy) -> DataFrame:
    """(event_id, score, verdict) of the actions that carry text."""
    return with_tone(actions, policy).select("event_id", "score", "verdict")


def first_sentence_with(text: Column, needle: Column) -> Column:
    """The first sentence that holds the needle, whatever its case: trimmed, 160 characters; '' if none."""
    found = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.contains(F.lower(s), F.lower(needle)))
    return F.substring(F.trim(F.coalesce(F.get(found, F.lit(0)), F.lit(""))), 1, 160)


def _phrases(actions: DataFrame, policy: Policy) -> DataFrame:
    """actions with the phrases each text holds, whether a claim is triggered or backed, and the three verdicts."""
    hay = F.lower(F.concat(F.coalesce("subject", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))))
    found = actions.withColumn("hay", hay).withColumns(
        {
            "claims": _hits(F.col("hay"), policy.claims),
            "competitor": _hits(F.col("hay"), policy.competitors),
            "regulated": _hits(F.col("hay"), policy.regulated),
            "triggered": F.size(_hits(F.col("hay"), policy.claim_triggers)) > 0,
            "backed": F.coalesce(F.col("text"), F.lit("")).rlike(SUBSTANTIATED),
        }
    )
    verdicts = {
        "claims": F.when(F.col("backed"), "pass").when(F.col("triggered"), "fail").otherwise("warn"),
        "competitor": F.lit("fail"),
        "regulated": F.lit("warn"),
    }
    return found.withColumns({f"{k}_verdict": F.when(F.size(k) > 0, v).otherwise("pass") for k, v in verdicts.items()})


def phrase_checks(actions: DataFrame, policy: Policy) -> DataFrame:
    """(event_id, check_type, verdict, hits, evidence): claims, competitor and regulated wording in text actions.

    Claims fail with a trigger word and no substantiation in the text, pass with substantiation, else warn; competitors
    fail; regulated wording warns. evidence: the sentence of the first hit.
    """
    found = _phrases(actions.filter(F.col("action_type").isin(*TEXT_ACTIONS)), policy)
    rows = F.array(
        *[
            F.struct(F.lit(k).alias("check_type"), F.col(k).alias("hits"), F.col(f"{k}_verdict").alias("verdict"))
            for k in ("claims", "competitor", "regulated")
        ]
    )
    return (
        found.select("event_id", "text", F.inline(rows))
        .withColumn("evidence", F.when(F.col("verdict") != "pass", first_sentence_with(F.col("text"), F.get("hits", F.lit(0)))))
        .select("event_id", "check_type", "verdict", "hits", "evidence")
    )


def own_checks(actions: DataFrame, policy: Policy) -> DataFrame:
    """The columns of actions, and check_type, score, verdict: one row for each check that needs no other action (tone,
    phrases, budgets), in one pass; an event without any has one row, whose check_type is null."""
    kept = [F.col(c) for c in actions.columns]
    known = _phrases(_scored(actions, policy), policy)
    none = F.lit(None).cast("double")

    def row(check: str, score: Column, verdict: Column) -> Column:
        return F.struct(F.lit(check).alias("check_type"), score.alias("score"), verdict.alias("verdict"))

    said = F.array(row("tov", F.col("score"), F.col("tone_verdict")), *[row(k, none, F.col(f"{k}_verdict")) for k in QUALITY_CHECKS[1:]])
    budget = F.col("action_type").isin(*BUDGET_ACTIONS) & F.col("budget_new").isNotNull()
    spent = F.array(row("spend", none, _budget_verdict(policy)))
    rows = F.when(F.col("action_type").isin(*TEXT_ACTIONS), said).when(budget, spent)
    return known.select(*kept, F.inline_outer(rows))


def email_days(actions: DataFrame) -> DataFrame:
    """(agent_id, day, emails)."""
    return actions.filter("action_type = 'email.send'").groupBy("agent_id", "day").agg(F.count("*").alias("emails"))


def _budget_verdict(policy: Policy) -> Column:
    ceiling = F.lit(None).cast("double")
    for agent, cap in policy.ceilings.items():
        ceiling = F.when(F.col("agent_id") == agent, F.lit(float(cap))).otherwise(ceiling)
    return F.when(F.col("budget_new") > ceiling, "fail").otherwise("pass")


def email_spend(actions: DataFrame, policy: Policy) -> DataFrame:
    """(event_id, verdict, amount) of emails: every one of a day above the limit fails."""
    return (
        actions.filter("action_type = 'email.send'")
        .select("event_id", "agent_id", "day")
        .join(email_days(actions), ["agent_id", "day"])
        .select(
            "event_id",
            F.when(F.col("emails") > policy.max_emails_per_day, "fail").otherwise("pass").alias("verdict"),
            F.col("emails").cast("double").alias("amount"),
        )
    )


def spend(actions: DataFrame, policy: Policy) -> DataFrame:
    """(event_id, verdict, amount): budgets above the agent's ceiling, and every email of a day above the limit, fail."""
    budgets = actions.filter(F.col("action_type").isin(*BUDGET_ACTIONS) & F.col("budget_new").isNotNull()).select(
        "event_id", _budget_verdict(policy).alias("verdict"), F.col("budget_new").alias("amount")
    )
    return budgets.unionByName(email_spend(actions, policy))


def conflicts(actions: DataFrame, policy: Policy) -> DataFrame:
    """(event_id, other_id, other_agent, other_action): the first event in ledger order by another agent on the same
    subject within the window, bounds included. Found by a sweep: no pairs are formed, however busy a subject is."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = actions.select("event_id", "agent_id", "subject_ref", at.alias("at"))
    near = first_by_another(rows, "subject_ref", "agent_id", "at", "event_id", int(policy.conflict_hours * 3_600_000_000))
    other = actions.select(F.col("event_id").alias("other_id"), F.col("agent_id").alias("other_agent"), F.col("action_type").alias("other_action"))
    return near.select(F.col("number").alias("event_id"), F.col("other").alias("other_id")).join(other, "other_id").select("event_id", "other_id", "other_agent", "other_action")


def checks(actions: DataFrame, policy: Policy) -> DataFrame:
    """(event_id, check_order, check_type, score, verdict): one row for each check that applies to an event. Texts are
    read once, for all the checks they need; emails a day and conflicts read no text."""
    order = F.lit(None).cast("int")
    for k, c in enumerate(CHECKS):
        order = F.when(F.col("check_type") == c, k).otherwise(order)
    none = F.lit(None).cast("double").alias("score")
    own = own_checks(actions, policy).filter("check_type is not null").select("event_id", "check_type", "score", "verdict")
    mails = email_spend(actions, policy).select("event_id", F.lit("spend").alias("check_type"), none, "verdict")
    met = conflicts(actions, policy).select("event_id", F.lit("conflict").alias("check_type"), none, F.lit("warn").alias("verdict"))
    return own.unionByName(mails).unionByName(met).withColumn("check_order", order)


def findings(checked: DataFrame) -> DataFrame:
    """(event_id, check_type, verdict, severity, summary) of the checks that warn or fail."""
    severity = F.when(F.col("verdict") == "fail", "high").otherwise("medium")
    summary = F.substring(F.concat("check_type", F.lit(": "), "verdict"), 1, 200)
    return checked.filter("verdict <> 'pass'").select("event_id", "check_type", "verdict", severity.alias("severity"), summary.alias("summary"))


def _rules(spark, policy: Policy) -> DataFrame:
    rows = [(k, d, c, v, TIERS[d]) for k, (d, c, v) in enumerate(policy.rules)]
    return spark.createDataFrame(rows, "rule_index int, rule_decision string, rule_check string, rule_verdict string, rule_tier int")


def decisions(actions: DataFrame, checked: DataFrame, policy: Policy) -> DataFrame:
    """(event_id, decision, tier, reasons, decided_check, decided_rule): for each check that does not pass, the first
    rule that fits; the worst tier decides; events without such a check get the default."""
    default, base = policy.default, TIERS[policy.default]
    rules = F.broadcast(_rules(actions.sparkSession, policy))  # the policy's rules: a handful
    fits = (rules.rule_check.isNull() | (rules.rule_check == F.col("check_type"))) & (
        rules.rule_verdict.isNull() | (rules.rule_verdict == F.col("verdict"))
    )
    ruled = (
        checked.filter("verdict <> 'pass'")
        .join(rules, fits, "left")
        .groupBy("event_id", "check_order", "check_type", "verdict")
        .agg(F.min(F.struct("rule_index", "rule_decision", "rule_tier")).alias("r"))
        .select(
            "event_id",
            "check_order",
            "check_type",
            F.coalesce("r.rule_decision", F.lit(default)).alias("d"),
            F.coalesce("r.rule_tier", F.lit(base)).alias("t"),
            F.col("r.rule_index").alias("rule_index"),
        )
    )
    reason = F.when(F.col("d") != "auto", F.struct("check_order", _labels(F.col("check_type"), CHECK_LABELS).alias("label")))
    per_event = ruled.groupBy("event_id").agg(
        F.min(F.struct((-F.col("t")).alias("nt"), "check_order", "d", "check_type", "rule_index")).alias("w"),
        F.array_sort(F.collect_list(reason)).alias("why"),
    )
    worst = -F.col("w.nt")
    return (
        actions.select("event_id")
        .join(per_event, "event_id", "left")
        .select(
            "event_id",
            F.when(worst > base, F.col("w.d")).otherwise(default).alias("decision"),
            F.greatest(F.coalesce(worst, F.lit(base)), F.lit(base)).alias("tier"),
            F.coalesce(F.transform("why", lambda x: x["label"]), F.array().cast("array<string>")).alias("reasons"),
            F.when(worst >= base, F.col("w.check_type")).alias("decided_check"),
            F.when(worst >= base, F.col("w.rule_index")).alias("decided_rule"),
        )
    )


def effective(decided: DataFrame, overrides: DataFrame) -> DataFrame:
    """decided with the last override in append order (seq), if any: system_decision, decision, overridden."""
    last = overrides.groupBy("event_id").agg(F.max(F.struct("seq", "decision", "actor_role")).alias("o"))
    return (
        decided.withColumnRenamed("decision", "system_decision")
        .join(last, "event_id", "left")
        .withColumn("decision", F.coalesce("o.decision", "system_decision"))
        .withColumn("overridden", F.col("o").isNotNull())
        .withColumn("override_role", F.col("o.actor_role"))
        .drop("o")
    )


def decided_by(effective_rows: DataFrame) -> DataFrame:
    """(event_id, decided_by): the override, the default, or the check and the number of its rule."""
    text = (
        F.when(F.col("overridden"), F.concat(F.lit("override by "), "override_role"))
        .when(F.col("decided_check").isNull(), F.lit("default"))
        .when(F.col("decided_rule").isNull(), F.concat(_labels(F.col("decided_check"), CHECK_LABELS), F.lit(", default")))
        .otherwise(F.concat(_labels(F.col("decided_check"), CHECK_LABELS), F.lit(", rule "), (F.col("decided_rule") + 1).cast("string")))
    )
    return effective_rows.select("event_id", text.alias("decided_by"))


def gate_counts(effective_rows: DataFrame) -> DataFrame:
    return effective_rows.agg(*[F.count_if(F.col("decision") == d).alias(d) for d in ("block", "review", "auto")])


def pending(effective_rows: DataFrame, actions: DataFrame) -> DataFrame:
    """Events not let through, in queue order: blocks first, then by time."""
    first = F.when(F.col("decision") == "block", 0).otherwise(1)
    held = effective_rows.filter("decision <> 'auto'").select("event_id", "decision", "system_decision", "overridden")
    return held.join(actions.select("event_id", "ts", "agent_id", "action_type", "subject_ref"), "event_id").orderBy(first, "ts", "event_id")


def override_history(effective_rows: DataFrame, overrides: DataFrame, actions: DataFrame) -> DataFrame:
    """Overrides of known events next to the system's decision, newest first."""
    return (
        overrides.select("event_id", F.col("decision").alias("override_decision"), "actor_role", "seq")
        .join(effective_rows.select("event_id", "system_decision"), "event_id")
        .join(actions.select("event_id", "agent_id", "action_type"), "event_id")
        .orderBy(F.desc("seq"), "event_id")
    )


def daily_tone(actions: DataFrame, checked: DataFrame, *by: str) -> DataFrame:
    """Mean tone and count a day, by agent and channel unless told otherwise."""
    scored = checked.filter("check_type = 'tov' and score is not null").select("event_id", "score")
    keys = by or ("agent_id", "channel")
    # Scores are whole thousandths: their sum is exact in any order.
    mean = F.sum(F.round(F.col("score") * 1000).cast("long")) / (F.count("*") * 1000.0)
    return actions.select("event_id", *keys, "day").join(scored, "event_id").groupBy(*keys, "day").agg(mean.alias("mean"), F.count("*").alias("n"))


def drift_alarms(points: DataFrame, policy: Policy) -> DataFrame:
    """Days whose tone is under the warn line, or far under the stream's baseline (the mean of its daily means)."""
    stream = Window.partitionBy("agent_id", "channel")
    gap = F.col("baseline") - F.col("mean")
    reason = F.when(F.col("mean") < policy.warn_below, "below_threshold").when(gap > policy.drop_threshold, "drop_vs_baseline")
    # Billionths, so that the sum does not depend on its order.
    baseline = F.sum(F.round(F.col("mean") * 1e9).cast("long")).over(stream) / (F.count("*").over(stream) * 1e9)
    return (
        points.withColumn("baseline", baseline)
        .withColumn("reason", reason)
        .filter((F.col("n") >= policy.drift_min_samples) & F.col("reason").isNotNull())
        .select("agent_id", "channel", "day", half_up(F.col("mean"), 3).alias("mean"), half_up(F.col("baseline"), 3).alias("baseline"), half_up(gap, 3).alias("drop"), "reason")
    )


def tone_grid(points: DataFrame) -> DataFrame:
    """Every stream on every day from the first to the last, null where there is nothing."""
    span = points.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("day"))
    streams = points.select("agent_id", "channel").distinct()
    return streams.join(days).join(points, ["agent_id", "channel", "day"], "left")


def _outcome_by_ref(outcomes: DataFrame) -> DataFrame:
    """One outcome a subject: the last one where outcomes have an order (seq), else the largest."""
    whole = F.struct("sessions", "conversions", "revenue")
    one = F.max_by(whole, "seq") if "seq" in outcomes.columns else F.max(whole)
    return outcomes.groupBy("subject_ref").agg(one.alias("o")).select("subject_ref", "o.*")


def outcome_coverage(actions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(events, with_outcome, coverage)."""
    known = _outcome_by_ref(outcomes).select("subject_ref", F.lit(1).alias("hit"))
    return actions.join(known, "subject_ref", "left").agg(
        F.count("*").alias("events"), F.count("hit").alias("with_outcome"), (F.count("hit") / F.count("*")).alias("coverage")
    )


def flagged_sets(checked: DataFrame) -> DataFrame:
    """(scope, event_id): events with a finding, by quality check, in `aggregate` over these, and in `any` over all."""
    found = checked.filter("verdict <> 'pass'").select("event_id", "check_type")
    own = found.filter(F.col("check_type").isin(*QUALITY_CHECKS))
    return (
        own.select(F.col("check_type").alias("scope"), "event_id")
        .unionByName(own.select(F.lit("aggregate").alias("scope"), "event_id"))
        .unionByName(found.select(F.lit("any").alias("scope"), "event_id"))
        .distinct()
    )


def conversion_impact(actions: DataFrame, checked: DataFrame, outcomes: DataFrame, policy: Policy) -> DataFrame:
    """(scope, clean_rate, clean_n, flagged_rate, flagged_n, delta, material): conversion of events without any finding
    against flagged ones; delta only where both have enough samples."""
    flagged = flagged_sets(checked)
    known = actions.select("event_id", "subject_ref").join(_outcome_by_ref(outcomes), "subject_ref")
    sums = (F.count("*").alias("n"), F.sum("conversions").alias("c"), F.sum("sessions").alias("s"))
    clean = known.join(flagged.filter("scope = 'any'").select("event_id"), "event_id", "left_anti").agg(*sums)
    clean = clean.select(F.col("n").alias("clean_n"), F.when(F.col("s") > 0, F.col("c") / F.col("s")).otherwise(0.0).alias("clean_rate"))
    scopes = actions.sparkSession.createDataFrame([(s,) for s in ("aggregate", *QUALITY_CHECKS)], "scope string")
    groups = known.join(flagged.filter("scope <> 'any'"), "event_id").groupBy("scope").agg(*sums)
    rows = scopes.join(groups, "scope", "left").select(
        "scope", F.coalesce("n", F.lit(0)).alias("flagged_n"), F.when(F.col("s") > 0, F.col("c") / F.col("s")).otherwise(0.0).alias("flagged_rate")
    )
    least = policy.outcome_min_samples
    material = (F.col("clean_n") >= least) & (F.col("flagged_n") >= least)
    return rows.join(clean).select(
        "scope", "clean_rate", "clean_n", "flagged_rate", "flagged_n",
        F.when(material & (F.col("clean_rate") > 0), (F.col("clean_rate") - F.col("flagged_rate")) / F.col("clean_rate")).alias("delta"),
        material.alias("material"),
    )


def gate_exposure(effective_rows: DataFrame, actions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(decision, n, revenue): revenue of the subjects that each decision touches."""
    rows = effective_rows.select("event_id", "decision").join(actions.select("event_id", "subject_ref"), "event_id")
    return (
        rows.join(_outcome_by_ref(outcomes), "subject_ref", "left")
        .groupBy("decision")
        .agg(F.count("*").alias("n"), F.sum(F.coalesce("revenue", F.lit(0.0))).alias("revenue"))
    )


def finding_view(actions: DataFrame, checked: DataFrame) -> DataFrame:
    """Findings with their events: high severity first, then by time."""
    rank = F.when(F.col("severity") == "high", 0).otherwise(1)
    rows = actions.select("event_id", "ts", "agent_id", "agent_label", "action_type", "channel", "subject_ref")
    return findings(checked).join(rows, "event_id").withColumn("severity_rank", rank).orderBy("severity_rank", "ts", "event_id", "check_type")


def top_findings(view: DataFrame, k: int = 3) -> DataFrame:
    """The first k findings of the view as digest lines."""
    line = F.concat("agent_label", F.lit(": "), _labels(F.col("check_type"), CHECK_LABELS), F.lit(", "), F.col("verdict"))
    return view.orderBy("severity_rank", "ts", "event_id", "check_type").limit(k).select("event_id", "check_type", line.alias("line"))


def agent_rollup(actions: DataFrame, checked: DataFrame, policy: Policy) -> DataFrame:
    """(agent_id, events, emails, pages, posts, budgets, over_ceiling, findings): findings count by the agent's label,
    so agents that share one share the count."""
    budgets = spend(actions, policy).filter("verdict = 'fail'").select("event_id", F.lit(1).alias("over"))
    kinds = {"emails": "email.send", "pages": "page.publish", "posts": "social.post", "budgets": "ad.budget_change"}
    by_label = finding_view(actions, checked).groupBy("agent_label").agg(F.count("*").alias("findings"))
    return (
        actions.join(budgets, "event_id", "left")
        .groupBy("agent_id")
        .agg(
            F.count("*").alias("events"),
            *[F.count_if(F.col("action_type") == a).alias(k) for k, a in kinds.items()],
            F.count_if((F.col("action_type") == "ad.budget_change") & F.col("over").isNotNull()).alias("over_ceiling"),
            F.min_by("agent_label", "event_id").alias("agent_label"),
        )
        .join(by_label, "agent_label", "left")
        .withColumn("findings", F.coalesce("findings", F.lit(0)))
        .drop("agent_label")
    )


def report_totals(actions: DataFrame, checked: DataFrame) -> DataFrame:
    """One row: events, agents, range, checks, findings, fails, warns."""
    left = actions.agg(F.count("*").alias("events"), F.countDistinct("agent_id").alias("agents"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    right = checked.agg(
        F.count("*").alias("checks"), F.count_if(F.col("verdict") != "pass").alias("findings"),
        F.count_if(F.col("verdict") == "fail").alias("fails"), F.count_if(F.col("verdict") == "warn").alias("warns"),
    )
    return left.join(right)


def digest(actions: DataFrame, checked: DataFrame, effective_rows: DataFrame, policy: Policy) -> DataFrame:
    """(section, position, line): the weekly digest as a table. Findings and held events, whose number grows with the
    ledger, are in the order of their event's number."""
    t = report_totals(actions, checked).join(gate_counts(effective_rows))
    head = t.select(
        F.lit("headline").alias("section"),
        F.posexplode(
            F.array(
                F.format_string("%d agent actions across %d agents.", "events", "agents"),
                F.format_string("%d findings (%d fail, %d warn). Gate: %d blocked, %d for review.", "findings", "fails", "warns", "block", "review"),
            )
        ).alias("position", "line"),
    )
    top = top_findings(finding_view(actions, checked))
    at = Window.orderBy("event_id", "check_type")
    top = top.select(F.lit("top").alias("section"), (F.row_number().over(at) - 1).alias("position"), "line")
    alarms = drift_alarms(daily_tone(actions, checked), policy).groupBy("agent_id", "channel").agg(F.count("*").alias("n"))
    at = Window.orderBy("agent_id", "channel")
    off = alarms.select(
        F.lit("drift").alias("section"),
        (F.row_number().over(at) - 1).alias("position"),
        F.format_string("%s / %s off its usual tone on %d days", "agent_id", "channel", "n").alias("line"),
    )
    said = lambda *parts: F.concat(F.lit("["), parts[0], F.lit("] "), F.concat_ws(" · ", *parts[1:])).alias("line")
    found = labelled(finding_view(actions, checked))
    found = found.select(F.lit("finding").alias("section"), F.col("event_id").alias("position"), said("severity", "check_label", "agent_label", "action_label"))
    held = labelled(effective_rows.filter("decision <> 'auto'").select("event_id", "decision").join(actions.select("event_id", "agent_label", "action_type", "subject_ref"), "event_id"))
    held = held.select(F.lit("pending").alias("section"), F.col("event_id").alias("position"), said("decision", "agent_label", "action_label", F.coalesce("subject_ref", F.lit("-"))))
    short = head.unionByName(top).unionByName(off).withColumn("position", F.col("position").cast("long"))
    return short.unionByName(found).unionByName(held)


def policy_errors(policies: DataFrame) -> DataFrame:
    """(policy_id, error) for policy rows (fail_below, warn_below, max_emails, window_hours, decision)."""
    bad = [
        (~(F.col("fail_below") <= F.col("warn_below")), "fail_below must be <= warn_below"),
        (F.col("max_emails").isNull() | F.isnan("max_emails"), "max_emails must be a number"),
        (F.col("window_hours").isNull() | F.isnan("window_hours"), "window_hours must be a number"),
        (~F.coalesce("decision", F.lit("")).isin("auto", "review", "block"), "decision must be auto, review or block"),
    ]
    errors = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(m)) for c, m in bad]))
    return policies.select("policy_id", F.explode(errors).alias("error"))


def policy_document_errors(policies: DataFrame) -> DataFrame:
    """(policy_id, error) for whole policy documents: fail_below, warn_below, max_emails, window_hours, drop_threshold,
    min_samples (doubles), ceilings (map of agent to double) and decisions (array, one a rule, in their order)."""

    def number(c: str) -> Column:
        x = F.col(c)
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    needed = [
        (F.coalesce(F.col("fail_below") <= F.col("warn_below"), F.lit(False)), "fail_below must be <= warn_below"),
        (number("max_emails"), "max_emails must be a number"),
        (number("window_hours"), "window_hours must be a number"),
        (number("drop_threshold") & number("min_samples"), "drift settings must be numbers"),
    ]
    plain = F.array_compact(F.array(*[F.when(~c, F.lit(m)) for c, m in needed]))
    fine = lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))
    agents = F.transform(F.filter(F.map_entries("ceilings"), lambda e: ~fine(e["value"])), lambda e: F.concat(F.lit("ceiling of "), e["key"], F.lit(" must be a number")))
    said = F.transform("decisions", lambda d, i: F.struct(d.alias("d"), i.alias("i")))
    rules = F.transform(
        F.filter(said, lambda r: ~F.coalesce(r["d"].isin(*TIERS), F.lit(False))), lambda r: F.concat(F.lit("decision of rule "), (r["i"] + 1).cast("string"), F.lit(" must be auto, review or block"))
    )
    none = F.array().cast("array<string>")
    return policies.select("policy_id", F.explode(F.concat(plain, F.coalesce(F.array_sort(agents), none), F.coalesce(rules, none))).alias("error"))


def top_findings_of(view: DataFrame, *tenant: str, k: int = 3) -> DataFrame:
    """(tenant.., rank, event_id, check_type, line): the first k findings of each tenant in the view's order."""
    line = F.concat("agent_label", F.lit(": "), _labels(F.col("check_type"), CHECK_LABELS), F.lit(", "), F.col("verdict"))
    order = Window.partitionBy(*tenant).orderBy("severity_rank", "ts", "event_id", "check_type")
    ranked = view.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(*tenant, "rank", "event_id", "check_type", line.alias("line"))


def as_of(actions: DataFrame, last_event: int) -> DataFrame:
    """The ledger when `last_event` had just come in."""
    return actions.filter(F.col("event_id") <= last_event)


def previous_budgets(actions: DataFrame) -> DataFrame:
    """(event_id, budget_new, previous): each budget change next to the last earlier one on its subject."""
    earlier = Window.partitionBy("subject_ref").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    rows = actions.filter(F.col("action_type").isin(*BUDGET_ACTIONS)).withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")))
    return rows.select("event_id", "budget_new", F.last("budget_new", ignorenulls=True).over(earlier).alias("previous"))
