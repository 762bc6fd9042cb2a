"""Ledger queries on the derived action table."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import ledger as g
from millrace.plans.storage import materialise
from millrace.plans.views import view, with_views

#: Phrases that occur in the invented prose of the tables.
POLICY = g.Policy(
    banned=("of the", "and that", "er la"),
    max_sentence_words=9,
    claims=("in the", "to be"),
    claim_triggers=("ingth", "onst"),
    competitors=("Rehe", "Onoi"),
    regulated=("enth",),
    max_emails_per_day=8,
    ceilings={"agent-1": 40.0, "agent-2": 100.0},
)


def _l(q: str) -> str:
    return "'" + q.replace("'", "''") + "'"


def _any(hay: str, words) -> str:
    return "(" + " OR ".join(f"contains({hay}, {_l(w.lower())})" for w in words) + ")"


_TEXT = "action_type IN ('email.send','page.publish','social.post','task.execute')"
_P = POLICY
_CHECKS = f"""
j AS (SELECT event_id, text, lower(coalesce(text, '')) AS low, coalesce(text, '') AS t,
             lower(coalesce(subject, '') || chr(10) || coalesce(text, '')) AS hay FROM a WHERE {_TEXT}),
w AS (SELECT event_id, low, hay, t, text,
             len(regexp_extract_all(t, '\\p{{L}}[\\p{{L}}'']*')) AS words,
             len(list_filter(regexp_extract_all(t, '[A-Za-z0-9_]+'), lambda x: regexp_full_match(x, '[A-Z]{{2,}}') AND x NOT IN ('USD', 'US'))) AS caps,
             len(regexp_extract_all(t, '!')) AS bangs, len(regexp_extract_all(t, '[^.!?]*[^.!?\\s][^.!?]*')) AS sents FROM j),
tone AS (SELECT event_id, floor(least(1.0, greatest(0.0, 1.0
   - 0.25 * ({" + ".join(f"CAST(contains(low, {_l(b)}) AS INT)" for b in _P.banned)})
   - CASE WHEN words > 0 AND caps / words > 0.6 THEN 0.5 WHEN words > 0 AND caps / words > 0.3 THEN 0.3 ELSE 0.0 END
   - CASE WHEN bangs >= 3 THEN 0.3 ELSE 0.0 END - CASE WHEN contains(t, '!!') THEN 0.2 ELSE 0.0 END
   - CASE WHEN sents > 0 AND words / sents > {_P.max_sentence_words} THEN 0.15 ELSE 0.0 END
   - CASE WHEN regexp_matches(t, '[☀-➿\U0001f300-\U0001faff]') THEN 0.15 ELSE 0.0 END)) * 1000 + 0.5) / 1000 AS score FROM w),
tone2 AS (SELECT event_id, CAST(score AS DOUBLE) AS score, CASE WHEN score < 0.5 THEN 'fail' WHEN score < 0.75 THEN 'warn' ELSE 'pass' END AS verdict FROM tone),
phr AS (
 SELECT event_id, 'claims' AS check_type, text,
   CASE WHEN NOT {_any("hay", _P.claims)} THEN 'pass'
        WHEN regexp_matches(t, '(?i)(according to|based on|case study|\\bstudy\\b|customer[- ]reported|median|on average|average of|\\d+\\s*(customers|teams)\\b)') THEN 'pass'
        WHEN {_any("hay", _P.claim_triggers)} THEN 'fail' ELSE 'warn' END AS verdict FROM w
 UNION ALL SELECT event_id, 'competitor', text, CASE WHEN {_any("hay", _P.competitors)} THEN 'fail' ELSE 'pass' END FROM w
 UNION ALL SELECT event_id, 'regulated', text, CASE WHEN {_any("hay", _P.regulated)} THEN 'warn' ELSE 'pass' END FROM w),
mails AS (SELECT agent_id, day, count(*) AS emails FROM a WHERE action_type = 'email.send' GROUP BY ALL),
spend AS (
 SELECT event_id, CASE WHEN budget_new > CASE agent_id WHEN 'agent-1' THEN 40.0 WHEN 'agent-2' THEN 100.0 END THEN 'fail' ELSE 'pass' END AS verdict, budget_new AS amount
 FROM a WHERE action_type IN ('ad.budget_change', 'ad.create') AND budget_new IS NOT NULL
 UNION ALL SELECT event_id, CASE WHEN emails > 8 THEN 'fail' ELSE 'pass' END, CAST(emails AS DOUBLE) FROM a JOIN mails USING (agent_id, day) WHERE action_type = 'email.send'),
conf AS (SELECT x.event_id, min(y.event_id) AS other_id FROM a x JOIN a y
   ON x.subject_ref = y.subject_ref AND x.agent_id <> y.agent_id AND abs(epoch_us(x.ts) - epoch_us(y.ts)) <= 86400000000 GROUP BY 1),
c AS (
 SELECT event_id, 'tov' AS check_type, score, verdict, 0 AS check_order FROM tone2
 UNION ALL SELECT event_id, check_type, NULL, verdict, CASE check_type WHEN 'claims' THEN 1 WHEN 'competitor' THEN 2 ELSE 3 END FROM phr
 UNION ALL SELECT event_id, 'spend', NULL, verdict, 4 FROM spend
 UNION ALL SELECT event_id, 'conflict', NULL, 'warn', 5 FROM conf),
f AS (SELECT *, CASE WHEN verdict = 'fail' THEN 'high' ELSE 'medium' END AS severity FROM c WHERE verdict <> 'pass')"""

_DECIDE = """
rl AS (SELECT * FROM (VALUES (0, 'block', 'competitor', 'fail', 3), (1, 'block', 'spend', 'fail', 3), (2, 'review', 'claims', 'fail', 2),
   (3, 'review', 'tov', 'fail', 2), (4, 'review', 'regulated', 'warn', 2), (5, 'review', NULL, 'fail', 2), (6, 'auto', NULL, 'warn', 1)) t(i, d, k, v, tier)),
lb AS (SELECT * FROM (VALUES ('tov', 'Tone of voice'), ('claims', 'Claims'), ('competitor', 'Competitor mentions'),
   ('regulated', 'Regulated language'), ('spend', 'Spend'), ('conflict', 'Conflicting actions')) t(k, label)),
ru AS (SELECT f.event_id, f.check_order, f.check_type, r.i, r.d, r.tier FROM f JOIN rl r
   ON (r.k IS NULL OR r.k = f.check_type) AND (r.v IS NULL OR r.v = f.verdict)
   QUALIFY row_number() OVER (PARTITION BY f.event_id, f.check_order ORDER BY r.i) = 1),
wr AS (SELECT * FROM ru QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY tier DESC, check_order) = 1),
rs AS (SELECT event_id, list(label ORDER BY check_order) AS reasons FROM ru JOIN lb ON lb.k = check_type WHERE d <> 'auto' GROUP BY 1),
de AS (SELECT a.event_id, coalesce(wr.d, 'auto') AS decision, coalesce(wr.tier, 1) AS tier, coalesce(rs.reasons, []) AS reasons,
   wr.check_type AS decided_check, wr.i AS decided_rule FROM a LEFT JOIN wr USING (event_id) LEFT JOIN rs USING (event_id)),
ov AS (SELECT * FROM v_overrides QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY seq DESC) = 1),
ef AS (SELECT de.event_id, de.decision AS system_decision, de.tier, de.decided_check, de.decided_rule, coalesce(ov.decision, de.decision) AS decision,
   ov.event_id IS NOT NULL AS overridden, ov.actor_role AS override_role FROM de LEFT JOIN ov USING (event_id)),
oc AS (SELECT * FROM v_outcomes)"""

_DAILY = """
pt AS (SELECT agent_id, channel, day, sum(CAST(round(score * 1000) AS BIGINT)) / (count(*) * CAST(1000.0 AS DOUBLE)) AS mean, count(*) AS n FROM a JOIN c USING (event_id) WHERE check_type = 'tov' GROUP BY ALL),
pb AS (SELECT *, sum(CAST(round(mean * 1e9) AS BIGINT)) OVER (PARTITION BY agent_id, channel) / (count(*) OVER (PARTITION BY agent_id, channel) * CAST(1e9 AS DOUBLE)) AS baseline FROM pt),
al AS (SELECT agent_id, channel, day, floor(mean * 1000 + 0.5) / 1000 AS mean, floor(baseline * 1000 + 0.5) / 1000 AS baseline,
   floor((baseline - mean) * 1000 + 0.5) / 1000 AS drop, CASE WHEN mean < 0.75 THEN 'below_threshold' ELSE 'drop_vs_baseline' END AS reason
   FROM pb WHERE mean < 0.75 OR baseline - mean > 0.2)"""


def _sql(select: str, *more: str) -> str:
    return with_views("a AS (SELECT * FROM v_ledger),\n" + ",\n".join([_CHECKS.strip(), *[m.strip() for m in more]]) + "\n" + select, "v_ledger", "v_overrides", "v_outcomes")


def _actions(spark, d):
    return view(spark, d, "v_ledger")


def _checked(spark, d):
    # Written once: what follows reads the checks several times, and never a text again.
    a = _actions(spark, d)
    return a, materialise(g.checks(a, POLICY), "checks")


def _effective(spark, d):
    a, c = _checked(spark, d)
    o = view(spark, d, "v_overrides")
    return a, c, o, g.effective(g.decisions(a, c, POLICY), o)


def g_tone(spark, d):
    return g.tone(_actions(spark, d), POLICY)


def g_phrases(spark, d):
    return g.phrase_checks(_actions(spark, d), POLICY).select("event_id", "check_type", "verdict", F.length(F.coalesce("evidence", F.lit(""))).alias("evidence_chars"), F.size("hits").alias("n_hits")).select("event_id", "check_type", "verdict")


def g_email_days(spark, d):
    return g.email_days(_actions(spark, d))


def g_spend(spark, d):
    return g.spend(_actions(spark, d), POLICY)


def g_conflicts(spark, d):
    return g.conflicts(_actions(spark, d), POLICY).select("event_id", "other_id")


def g_checks(spark, d):
    return _checked(spark, d)[1].select("event_id", "check_type", "score", "verdict")


def g_findings(spark, d):
    return g.findings(_checked(spark, d)[1]).select("event_id", "check_type", "verdict", "severity")


def g_decisions(spark, d):
    a, c = _checked(spark, d)
    return g.decisions(a, c, POLICY)


def g_effective(spark, d):
    return _effective(spark, d)[3].select("event_id", "system_decision", "decision", "overridden", "override_role")


def g_decided_by(spark, d):
    return g.decided_by(_effective(spark, d)[3])


def g_gate_counts(spark, d):
    return g.gate_counts(_effective(spark, d)[3])


def g_pending(spark, d):
    a, _, _, e = _effective(spark, d)
    return g.pending(e, a).select("event_id", "decision", "system_decision", "overridden", "agent_id", "subject_ref")


def g_override_history(spark, d):
    a, _, o, e = _effective(spark, d)
    return g.override_history(e, o, a)


def g_drift_points(spark, d):
    a, c = _checked(spark, d)
    return g.daily_tone(a, c)


def g_drift_alarms(spark, d):
    a, c = _checked(spark, d)
    return g.drift_alarms(g.daily_tone(a, c), POLICY)


def g_tone_grid(spark, d):
    a, c = _checked(spark, d)
    return g.tone_grid(g.daily_tone(a, c))


def g_outcome_coverage(spark, d):
    return g.outcome_coverage(_actions(spark, d), view(spark, d, "v_outcomes"))


def g_flagged_sets(spark, d):
    return g.flagged_sets(_checked(spark, d)[1]).groupBy("scope").agg(F.count("*").alias("events"))


def g_conversion_impact(spark, d):
    a, c = _checked(spark, d)
    return g.conversion_impact(a, c, view(spark, d, "v_outcomes"), POLICY)


def g_gate_exposure(spark, d):
    a, _, _, e = _effective(spark, d)
    return g.gate_exposure(e, a, view(spark, d, "v_outcomes"))


def g_finding_view(spark, d):
    a, c = _checked(spark, d)
    return g.labelled(g.finding_view(a, c)).select("event_id", "check_type", "check_label", "channel_label", "action_label", "severity", "agent_label")


def g_top_findings(spark, d):
    a, c = _checked(spark, d)
    return g.top_findings(g.finding_view(a, c))


def g_agent_rollup(spark, d):
    a, c = _checked(spark, d)
    return g.agent_rollup(a, c, POLICY)


def g_agent_daily_tone(spark, d):
    a, c = _checked(spark, d)
    return g.daily_tone(a, c, "agent_id")


def g_report_totals(spark, d):
    a, c = _checked(spark, d)
    return g.report_totals(a, c)


def g_digest(spark, d):
    a, c, _, e = _effective(spark, d)
    return g.digest(a, c, e, POLICY)


def g_policy_errors(spark, d):
    rows = view(spark, d, "v_accounts").selectExpr(
        "id as policy_id", "purchases / 10.0D as fail_below", "signups / 10.0D as warn_below",
        "case when id % 5 > 0 then cast(id as double) end as max_emails", "24.0D as window_hours",
        "case when id % 4 = 0 then 'hold' else 'auto' end as decision",
    )
    return g.policy_errors(rows)


def g_policy_documents(spark, d):
    rows = view(spark, d, "v_accounts").selectExpr(
        "id as policy_id", "purchases / 10.0D as fail_below", "signups / 10.0D as warn_below", "5.0D as max_emails",
        "case when id % 9 = 0 then double('NaN') else 24.0D end as window_hours", "0.2D as drop_threshold",
        "case when id % 6 > 0 then 1.0D end as min_samples",
        "map('lifecycle-bot', case when id % 7 > 0 then cast(id as double) end, 'blog-agent', 300.0D) as ceilings",
        "array('auto', case when id % 4 = 0 then 'hold' else 'block' end, case when id % 10 > 0 then 'review' end) as decisions",
    )
    return g.policy_document_errors(rows)


def g_top_findings_by_agent(spark, d):
    a, c = _checked(spark, d)
    return g.top_findings_of(g.finding_view(a, c), "agent_id")


def g_as_of(spark, d):
    half = view(spark, d, "events").agg((F.max("event_id") / 2).cast("long")).first()[0]
    a = g.as_of(_actions(spark, d), half)
    return g.gate_counts(g.effective(g.decisions(a, g.checks(a, POLICY), POLICY), view(spark, d, "v_overrides")))


def g_previous_budgets(spark, d):
    return g.previous_budgets(_actions(spark, d))


QUERIES = {f.__name__: f for f in (
    g_tone, g_phrases, g_email_days, g_spend, g_conflicts, g_checks, g_findings, g_decisions, g_effective, g_decided_by, g_gate_counts,
    g_pending, g_override_history, g_drift_points, g_drift_alarms, g_tone_grid, g_outcome_coverage, g_flagged_sets, g_conversion_impact,
    g_gate_exposure, g_finding_view, g_top_findings, g_agent_rollup, g_agent_daily_tone, g_report_totals, g_digest, g_policy_errors,
    g_as_of, g_previous_budgets, g_policy_documents, g_top_findings_by_agent,
)}

_SETS = """
own AS (SELECT DISTINCT check_type, event_id FROM f WHERE check_type IN ('tov', 'claims', 'competitor', 'regulated')),
fs AS (SELECT check_type AS scope, event_id FROM own UNION SELECT 'aggregate', event_id FROM own UNION SELECT 'any', event_id FROM f)"""
_TOP = """
fv AS (SELECT f.*, a.ts, a.agent_label, a.agent_id, a.action_type, a.channel, lb.label AS check_label, CASE WHEN severity = 'high' THEN 0 ELSE 1 END AS sr FROM f JOIN a USING (event_id) JOIN lb ON lb.k = f.check_type),
top AS (SELECT event_id, check_type, agent_label || ': ' || check_label || ', ' || verdict AS line FROM fv ORDER BY sr, ts, event_id, check_type LIMIT 3)"""
_TOTALS = """
tot AS (SELECT (SELECT count(*) FROM a) AS events, (SELECT count(DISTINCT agent_id) FROM a) AS agents, (SELECT min(day) FROM a) AS first_day, (SELECT max(day) FROM a) AS last_day,
   (SELECT count(*) FROM c) AS checks, (SELECT count(*) FROM f) AS findings, (SELECT count(*) FROM f WHERE verdict = 'fail') AS fails, (SELECT count(*) FROM f WHERE verdict = 'warn') AS warns),
gc AS (SELECT count(*) FILTER (decision = 'block') AS block, count(*) FILTER (decision = 'review') AS review, count(*) FILTER (decision = 'auto') AS auto FROM ef)"""
_RATE = "coalesce(CASE WHEN sum(sessions) > 0 THEN sum(conversions) / sum(sessions) END, 0.0)"

ORACLES = {
    "g_tone": _sql("SELECT * FROM tone2"),
    "g_phrases": _sql("SELECT event_id, check_type, verdict FROM phr"),
    "g_email_days": _sql("SELECT * FROM mails"),
    "g_spend": _sql("SELECT * FROM spend"),
    "g_conflicts": _sql("SELECT * FROM conf"),
    "g_checks": _sql("SELECT event_id, check_type, score, verdict FROM c"),
    "g_findings": _sql("SELECT event_id, check_type, verdict, severity FROM f"),
    "g_decisions": _sql("SELECT * FROM de", _DECIDE),
    "g_effective": _sql("SELECT event_id, system_decision, decision, overridden, override_role FROM ef", _DECIDE),
    "g_decided_by": _sql("SELECT event_id, CASE WHEN overridden THEN 'override by ' || override_role WHEN decided_check IS NULL THEN 'default' ELSE label || ', rule ' || (decided_rule + 1) END AS decided_by FROM ef LEFT JOIN lb ON lb.k = decided_check", _DECIDE),
    "g_gate_counts": _sql("SELECT block, review, auto FROM gc", _DECIDE, _TOTALS),
    "g_pending": _sql("SELECT event_id, decision, system_decision, overridden, agent_id, subject_ref FROM ef JOIN a USING (event_id) WHERE decision <> 'auto'", _DECIDE),
    "g_override_history": _sql("SELECT o.event_id, o.decision AS override_decision, o.actor_role, o.seq, ef.system_decision, a.agent_id, a.action_type FROM v_overrides o JOIN ef USING (event_id) JOIN a USING (event_id)", _DECIDE),
    "g_drift_points": _sql("SELECT * FROM pt", _DAILY),
    "g_drift_alarms": _sql("SELECT * FROM al", _DAILY),
    "g_tone_grid": _sql("""SELECT s.agent_id, s.channel, dd.day, pt.mean, pt.n FROM (SELECT DISTINCT agent_id, channel FROM pt) s
        CROSS JOIN (SELECT CAST(unnest(generate_series((SELECT min(day) FROM pt), (SELECT max(day) FROM pt), INTERVAL 1 DAY)) AS DATE) AS day) dd
        LEFT JOIN pt ON pt.agent_id = s.agent_id AND pt.channel = s.channel AND pt.day = dd.day""", _DAILY),
    "g_outcome_coverage": _sql("SELECT count(*) AS events, count(o.subject_ref) AS with_outcome, count(o.subject_ref) / count(*) AS coverage FROM a LEFT JOIN v_outcomes o USING (subject_ref)"),
    "g_flagged_sets": _sql("SELECT scope, count(*) AS events FROM fs GROUP BY 1", _SETS),
    "g_conversion_impact": _sql(f"""SELECT scope, clean_rate, clean_n, flagged_rate, flagged_n, CASE WHEN clean_n >= 3 AND flagged_n >= 3 AND clean_rate > 0 THEN (clean_rate - flagged_rate) / clean_rate END AS delta, clean_n >= 3 AND flagged_n >= 3 AS material
        FROM (SELECT s.scope, count(o.subject_ref) AS flagged_n, {_RATE} AS flagged_rate FROM (VALUES ('aggregate'), ('tov'), ('claims'), ('competitor'), ('regulated')) s(scope)
              LEFT JOIN fs ON fs.scope = s.scope LEFT JOIN a ON a.event_id = fs.event_id LEFT JOIN v_outcomes o ON o.subject_ref = a.subject_ref GROUP BY 1)
        CROSS JOIN (SELECT count(*) AS clean_n, {_RATE} AS clean_rate FROM a JOIN v_outcomes USING (subject_ref) WHERE event_id NOT IN (SELECT event_id FROM fs WHERE scope = 'any'))""", _SETS),
    "g_gate_exposure": _sql("SELECT decision, count(*) AS n, sum(coalesce(revenue, 0.0)) AS revenue FROM ef JOIN a USING (event_id) LEFT JOIN v_outcomes USING (subject_ref) GROUP BY 1", _DECIDE),
    "g_finding_view": _sql("""SELECT event_id, check_type, check_label, CASE channel WHEN 'email' THEN 'Email' WHEN 'web' THEN 'Web' WHEN 'paid_search' THEN 'Paid search' WHEN 'organic_social' THEN 'Organic social' ELSE 'Live agent run' END AS channel_label,
        CASE action_type WHEN 'email.send' THEN 'Sent an email' WHEN 'page.publish' THEN 'Published a page' WHEN 'ad.budget_change' THEN 'Changed ad budget' WHEN 'social.post' THEN 'Posted to social' ELSE 'Ran a task' END AS action_label, severity, agent_label FROM fv""", _DECIDE, _TOP),
    "g_top_findings": _sql("SELECT * FROM top", _DECIDE, _TOP),
    "g_agent_rollup": _sql("""SELECT g.*, coalesce(n.findings, 0) AS findings FROM (SELECT agent_id, count(*) AS events, count(*) FILTER (action_type = 'email.send') AS emails, count(*) FILTER (action_type = 'page.publish') AS pages, count(*) FILTER (action_type = 'social.post') AS posts,
        count(*) FILTER (action_type = 'ad.budget_change') AS budgets, count(*) FILTER (action_type = 'ad.budget_change' AND s.verdict = 'fail') AS over_ceiling FROM a LEFT JOIN spend s USING (event_id) GROUP BY 1) g
        LEFT JOIN (SELECT agent_id, any_value(agent_label) AS lab FROM a GROUP BY 1) x USING (agent_id) LEFT JOIN (SELECT agent_label AS lab, count(*) AS findings FROM fv GROUP BY 1) n USING (lab)""", _DECIDE, _TOP).replace("SELECT g.*,", "SELECT g.agent_id, events, emails, pages, posts, budgets, over_ceiling,"),
    "g_agent_daily_tone": _sql("SELECT agent_id, day, sum(CAST(round(score * 1000) AS BIGINT)) / (count(*) * CAST(1000.0 AS DOUBLE)) AS mean, count(*) AS n FROM a JOIN c USING (event_id) WHERE check_type = 'tov' GROUP BY ALL"),
    "g_report_totals": _sql("SELECT events, agents, first_day, last_day, checks, findings, fails, warns FROM tot", _DECIDE, _TOTALS),
    "g_digest": _sql("""SELECT 'headline' AS section, 0 AS position, format('{} agent actions across {} agents.', events, agents) AS line FROM tot
        UNION ALL SELECT 'headline', 1, format('{} findings ({} fail, {} warn). Gate: {} blocked, {} for review.', findings, fails, warns, block, review) FROM tot, gc
        UNION ALL SELECT 'top', row_number() OVER (ORDER BY event_id, check_type) - 1, line FROM top
        UNION ALL SELECT 'drift', row_number() OVER (ORDER BY agent_id, channel) - 1, format('{} / {} off its usual tone on {} days', agent_id, channel, n) FROM (SELECT agent_id, channel, count(*) AS n FROM al GROUP BY 1, 2)
        UNION ALL SELECT 'finding', event_id, '[' || severity || '] ' || check_label || ' · ' || agent_label || ' · ' || _ACTION FROM fv
        UNION ALL SELECT 'pending', event_id, '[' || decision || '] ' || agent_label || ' · ' || _ACTION || ' · ' || coalesce(subject_ref, '-') FROM ef JOIN a USING (event_id) WHERE decision <> 'auto'""".replace("_ACTION", "CASE action_type WHEN 'email.send' THEN 'Sent an email' WHEN 'page.publish' THEN 'Published a page' WHEN 'ad.budget_change' THEN 'Changed ad budget' WHEN 'social.post' THEN 'Posted to social' ELSE 'Ran a task' END"), _DECIDE, _TOTALS, _TOP, _DAILY),
    "g_policy_errors": with_views("""p AS (SELECT id AS policy_id, purchases / 10.0 AS fb, signups / 10.0 AS wb, id % 5 > 0 AS has, CASE WHEN id % 4 = 0 THEN 'hold' ELSE 'auto' END AS decision FROM v_accounts)
        SELECT policy_id, 'fail_below must be <= warn_below' AS error FROM p WHERE NOT fb <= wb UNION ALL SELECT policy_id, 'max_emails must be a number' FROM p WHERE NOT has
        UNION ALL SELECT policy_id, 'decision must be auto, review or block' FROM p WHERE decision = 'hold'""", "v_accounts"),
    "g_as_of": _sql("SELECT block, review, auto FROM gc", _DECIDE, _TOTALS).replace("a AS (SELECT * FROM v_ledger)", "a AS (SELECT * FROM v_ledger WHERE event_id <= (SELECT max(event_id) // 2 FROM events))"),
    "g_previous_budgets": _sql("SELECT event_id, budget_new, last_value(budget_new IGNORE NULLS) OVER (PARTITION BY subject_ref ORDER BY epoch_us(ts) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM a WHERE action_type = 'ad.budget_change'"),
}

ORACLES["g_policy_documents"] = with_views(
    """p AS (SELECT id AS policy_id, purchases / 10.0 AS fb, signups / 10.0 AS wb, id FROM v_accounts)
    SELECT policy_id, 'fail_below must be <= warn_below' AS error FROM p WHERE NOT fb <= wb
    UNION ALL SELECT policy_id, 'window_hours must be a number' FROM p WHERE id % 9 = 0
    UNION ALL SELECT policy_id, 'drift settings must be numbers' FROM p WHERE id % 6 = 0
    UNION ALL SELECT policy_id, 'ceiling of lifecycle-bot must be a number' FROM p WHERE id % 7 = 0
    UNION ALL SELECT policy_id, 'decision of rule 2 must be auto, review or block' FROM p WHERE id % 4 = 0
    UNION ALL SELECT policy_id, 'decision of rule 3 must be auto, review or block' FROM p WHERE id % 10 = 0""",
    "v_accounts",
)
ORACLES["g_top_findings_by_agent"] = _sql(
    """SELECT agent_id, CAST(rank AS INTEGER) AS rank, event_id, check_type, line FROM (
       SELECT *, agent_label || ': ' || check_label || ', ' || verdict AS line, row_number() OVER (PARTITION BY agent_id ORDER BY sr, ts, event_id, check_type) AS rank FROM fv) WHERE rank <= 3""",
    _DECIDE, _TOP,
)
