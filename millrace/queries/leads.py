"""Lead-scoring queries on accounts derived from customers, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import leads as m
from millrace.plans.views import view, with_views

SOURCE, DECAYED = m.Config(), m.Config(weights={**m.SIGNALS, "segment_pql": 4.0, "github_star": 2.0}, half_life=14.0)
_AGES = {s: 1 + k for k, s in enumerate(m.SIGNALS)}


def _accounts(spark, d):
    ages = F.create_map(*[x for s, k in _AGES.items() for x in (F.lit(s), (F.col("id") % 5 * 4 + k).cast("int"))])
    return view(spark, d, "v_leads").withColumn("age", ages)


def _weights(spark, cfg):
    return spark.createDataFrame(list(cfg.weights.items()), "signal string, weight double")


def l_icp(spark, d):
    return m.icp(_accounts(spark, d)).select("id", *m.DIMENSIONS, "icp")


def l_composite(spark, d):
    return m.composite(_accounts(spark, d)).select("id", "pql")


def l_flags(spark, d):
    return m.flags(m.composite(_accounts(spark, d))).select("id", F.explode("fired").alias("signal", "fired"))


def l_branch(spark, d):
    return _accounts(spark, d).select("id", m.branch().alias("branch"))


def l_signal_points(spark, d):
    return m.signal_points(_accounts(spark, d), DECAYED)


def l_score(spark, d):
    return m.score(_accounts(spark, d), SOURCE)


def l_score_decayed(spark, d):
    return m.score(_accounts(spark, d), DECAYED).select("id", "tier", "branch", F.round("total", 6).alias("total"))


def l_explain(spark, d):
    return m.explain_points(_accounts(spark, d), SOURCE)


def l_ranking(spark, d):
    return m.ranking(l_score(spark, d), "icp")


def l_tier_counts(spark, d):
    return m.tier_counts(l_score(spark, d))


def l_features(spark, d):
    return m.features(_accounts(spark, d)).select("id", *m.DIMENSIONS, *m.SIGNALS)


def _scored(spark, d):
    a = _accounts(spark, d)
    y = a.select("id", "y", "fold")
    one = m.score(a, SOURCE).select("id", F.lit("source").alias("scorer"), F.col("total").cast("double").alias("score"))
    two = m.score(a, DECAYED).select("id", F.lit("current").alias("scorer"), F.round("total", 6).alias("score"))
    return one.unionByName(two).join(y, "id")


def l_auc(spark, d):
    return m.auc(_scored(spark, d), by=("scorer",))


def l_deciles(spark, d):
    return m.deciles(_scored(spark, d), by=("scorer",))


def l_lift(spark, d):
    return m.top_decile_lift(m.deciles(_scored(spark, d).filter("scorer = 'source'")))


def l_out_of_fold(spark, d):
    return m.out_of_fold(m.features(_accounts(spark, d)), lam=4.0)


def l_holdout_auc(spark, d):
    """The learned scorer next to the rules on the same rows, each scored by a model that has not seen it."""
    learned = m.out_of_fold(m.features(_accounts(spark, d)), lam=4.0)
    rules = m.score(_accounts(spark, d), SOURCE).select("id", F.col("total").cast("double").alias("total"))
    both = learned.join(rules, "id").select("id", "y", F.inline(F.array(F.struct(F.lit("learned").alias("scorer"), F.col("p").alias("score")), F.struct(F.lit("rules").alias("scorer"), F.col("total").alias("score")))))
    return m.auc(both, by=("scorer",))


def l_learned_weights(spark, d):
    _, coefficients = m.fit_logit(m.features(_accounts(spark, d)).filter("fold <> 0"), lam=4.0)
    rows = spark.createDataFrame([(s, coefficients[s]) for s in m.SIGNALS], "signal string, coefficient double")
    return m.integer_weights(rows)


def l_integer_weights(spark, d):
    rows = view(spark, d, "v_leads").groupBy((F.col("id") % 10).alias("k")).agg((F.sum(F.col("y")) - F.lit(5)).alias("c"), F.count("*").alias("n"))
    return m.integer_weights(rows.select(F.concat(F.lit("s"), "k").alias("signal"), (F.col("c") / F.col("n")).alias("coefficient")))


def l_weight_gap(spark, d):
    return m.weight_gap(l_integer_weights(spark, d), view(spark, d, "v_leads").select(F.concat(F.lit("s"), "id").alias("signal"), (F.col("id") % 6).cast("int").alias("weight")))


def l_drafts(spark, d):
    a = _accounts(spark, d)
    return m.drafts(a, m.score(a, SOURCE))


def l_gate(spark, d):
    a = _accounts(spark, d)
    return m.gate(m.drafts(a, m.score(a, SOURCE)), a)


def l_config_difference(spark, d):
    used = _accounts(spark, d).select(F.explode(F.map_keys("age")).alias("signal")).distinct()
    return m.config_difference(_weights(spark, DECAYED).join(used, "signal"), _weights(spark, SOURCE))


QUERIES = {f.__name__: f for f in (
    l_icp, l_composite, l_flags, l_branch, l_signal_points, l_score, l_score_decayed, l_explain, l_ranking, l_tier_counts, l_features,
    l_auc, l_deciles, l_lift, l_out_of_fold, l_holdout_auc, l_learned_weights, l_integer_weights, l_weight_gap, l_drafts, l_gate, l_config_difference,
)}

_ON = {"segment_pql": "pql > 0", **{s: c for s, c in m.FLAG_OF.items()}}
_BASE = f"""
x AS (SELECT *, CASE billing_model WHEN 'flat' THEN 1 WHEN 'subscription' THEN 1 WHEN 'usage-based' THEN 2 ELSE 3 END AS bm,
   CASE funding_stage WHEN 'pre-seed' THEN 0 WHEN 'bootstrapped' THEN 1 WHEN 'seed' THEN 1 WHEN 'series-a' THEN 2 ELSE 3 END AS st FROM v_leads),
ic AS (SELECT *, CASE WHEN multi_currency OR multi_product OR enterprise_contracts THEN least(bm + 1, 3) ELSE bm END AS billing_complexity,
   CASE WHEN headcount >= 200 THEN 3 WHEN headcount >= 20 THEN 2 WHEN headcount >= 1 THEN 1 ELSE 0 END AS company_scale,
   CASE WHEN funding_total_m >= 50 THEN 3 ELSE st END AS funding_growth,
   CASE WHEN headcount >= 100 THEN 3 WHEN headcount >= 10 THEN 2 WHEN headcount >= 1 THEN 1 ELSE 0 END AS headcount_fit,
   CASE WHEN api_first AND high_event_volume THEN 3 WHEN api_first THEN 2 ELSE 1 END AS technical_fit,
   least(15, CASE WHEN invoices_30d >= 200 THEN 3 WHEN invoices_30d >= 50 THEN 2 WHEN invoices_30d >= 20 THEN 1 ELSE 0 END
     + CASE WHEN plans + metrics >= 8 THEN 3 WHEN plans + metrics >= 4 THEN 2 WHEN plans + metrics >= 2 THEN 1 ELSE 0 END
     + CASE WHEN seats >= 3 THEN 2 WHEN seats >= 2 THEN 1 ELSE 0 END + CASE WHEN payment_failed THEN 2 ELSE 0 END
     + CASE WHEN hosting_months >= 6 THEN 2 WHEN hosting_months >= 2 THEN 1 ELSE 0 END) AS pql,
   CASE WHEN invoices_30d >= 50 THEN 'A' WHEN fork_main OR helm OR fork_api OR pypi THEN 'B' ELSE 'C' END AS br FROM x),
ii AS (SELECT *, billing_complexity + company_scale + funding_growth + headcount_fit + technical_fit AS icp FROM ic),
fl AS ({" UNION ALL ".join(f"SELECT id, '{s}' AS signal, {_ON[s]} AS fired, pql, CAST(id % 5 * 4 + {_AGES[s]} AS INT) AS age, {w} AS w1, {DECAYED.weights[s]} AS w2 FROM ii" for s, w in m.SIGNALS.items())}),
sp AS (SELECT id, signal, age, CASE WHEN signal = 'segment_pql' THEN pql * w1 / 5 ELSE w1 END AS p1, CASE WHEN signal = 'segment_pql' THEN pql * w2 / 5 ELSE w2 END * pow(0.5, age / 14.0) AS p2 FROM fl WHERE fired),
ss AS (SELECT id, sum(p1) AS r1, sum(p2) AS r2 FROM sp GROUP BY 1),
sc AS (SELECT ii.*, CAST(coalesce(r1, 0) AS DOUBLE) AS raw_signal, CAST(least(coalesce(r1, 0), 15) AS DOUBLE) AS signal, CAST(icp + least(coalesce(r1, 0), 15) AS DOUBLE) AS total,
   round(CAST(icp + least(coalesce(r2, 0), 15) AS DOUBLE), 6) AS t2 FROM ii LEFT JOIN ss USING (id)),
ti AS (SELECT *, CASE WHEN total >= 20 THEN 'A' WHEN total >= 12 THEN 'B' WHEN total >= 7 THEN 'C' ELSE 'none' END AS tier, CASE WHEN t2 >= 20 THEN 'A' WHEN t2 >= 12 THEN 'B' WHEN t2 >= 7 THEN 'C' ELSE 'none' END AS tier2 FROM sc),
s1 AS (SELECT id, name, icp, raw_signal, signal, total, tier, CASE WHEN tier <> 'none' THEN br END AS branch FROM ti),
sd AS (SELECT id, 'source' AS scorer, total AS score, y FROM ti UNION ALL SELECT id, 'current', t2, y FROM ti),
rk AS (SELECT *, row_number() OVER (PARTITION BY scorer ORDER BY score) AS rn, row_number() OVER (PARTITION BY scorer ORDER BY score DESC, id) - 1 AS rd, count(*) OVER (PARTITION BY scorer) AS n FROM sd),
av AS (SELECT *, avg(rn) OVER (PARTITION BY scorer, score) AS rank FROM rk),
dc AS (SELECT scorer, {" + ".join(f"CAST(rd >= floor(n * {d} / 10.0 + 0.5) AS INT)" for d in range(1, 10))} AS decile, y FROM rk),
iw AS (SELECT 's' || k AS signal, CAST(floor(least(5.0, greatest(0.0, 5 * c / greatest(max(c) OVER (), 1e-9))) + 0.5) AS INT) AS weight FROM (SELECT id % 10 AS k, (sum(y) - 5) / count(*) AS c FROM v_leads GROUP BY 1)),
dr AS (SELECT id, name, branch, CASE branch WHEN 'A' THEN invoices_30d || ' invoices a month, self-hosted' WHEN 'B' THEN name || ' and the ' || CASE WHEN helm THEN 'Helm charts' WHEN fork_main THEN 'main repo' WHEN fork_api THEN 'API repo' ELSE 'Python client' END ELSE 'Billing at ' || name END AS subject,
   'Hi there,' || chr(10) || chr(10) || name || ' ' || CASE branch WHEN 'A' THEN 'has run the self-hosted edition for ' || hosting_months || ' months and issued ' || invoices_30d || ' invoices in 30 days'
     WHEN 'B' THEN CASE WHEN helm THEN 'deployed the Helm charts' WHEN fork_main THEN 'forked the main repo' WHEN fork_api THEN 'forked the API repo' ELSE 'integrated the Python client' END
     ELSE CASE WHEN job THEN 'is hiring for billing infrastructure' WHEN inbound THEN 'asked about pricing through the site form' WHEN hosting_months > 0 THEN 'has run the self-hosted edition for ' || hosting_months || ' months' WHEN pricing THEN 'looked at pricing this month'
       WHEN docker THEN 'pulled the Docker image this month' WHEN star THEN 'starred the open-source repo' ELSE 'runs ' || billing_model || ' pricing' END END || '.' || chr(10) || chr(10) || 'Worth 20 minutes?' AS body
   FROM (SELECT ti.*, CASE WHEN tier <> 'none' THEN br END AS branch FROM ti) WHERE branch IS NOT NULL)"""


def _sql(select: str) -> str:
    return with_views(_BASE.strip() + "\n" + select, "v_leads")


def _said(word: str, *signals: str) -> tuple[str, str]:
    return f"contains(lower(body), '{word}')", "(" + " OR ".join(_ON[s] for s in signals) + ")"


# What the drafts can say, by plain substrings.
_SAID = [_said("self-hosted", "segment_pql"), _said("helm", "helm_fork"), _said("fork", "helm_fork", "github_fork_main", "github_fork_api"), _said("main repo", "github_fork_main"),
         _said("api repo", "github_fork_api"), _said("python client", "pypi_active"), _said("docker", "docker_deployed"), _said("hiring", "job_posting"), _said("starred", "github_star"),
         _said("looked at pricing", "website_pricing"), _said("asked about", "inbound_form")]
_GATE = f"""SELECT id, unnest([{{'rule': 'body length', 'ok': len(regexp_extract_all(body, '\\S+')) <= 75}}, {{'rule': 'subject length', 'ok': len(regexp_extract_all(subject, '\\S+')) <= 8}}, {{'rule': 'vocabulary', 'ok': true}},
   {{'rule': 'company named', 'ok': true}}, {{'rule': 'cites a signal', 'ok': {" OR ".join(f"({a} AND {b})" for a, b in _SAID)}}}, {{'rule': 'no unbacked claim', 'ok': NOT ({" OR ".join(f"({a} AND NOT {b})" for a, b in _SAID)})}},
   {{'rule': 'opening', 'ok': true}}, {{'rule': 'one closing question', 'ok': true}}], recursive := true) FROM dr JOIN (SELECT * EXCLUDE (name) FROM ii) USING (id)"""
_DIMS = ", ".join(m.DIMENSIONS)
ORACLES = {
    "l_icp": _sql(f"SELECT id, {_DIMS}, icp FROM ii"),
    "l_composite": _sql("SELECT id, pql FROM ii"),
    "l_flags": _sql("SELECT id, signal, fired FROM fl"),
    "l_branch": _sql("SELECT id, br AS branch FROM ii"),
    "l_signal_points": _sql("SELECT id, signal, CAST(p2 AS DOUBLE) AS points, age FROM sp"),
    "l_score": _sql("SELECT * FROM s1"),
    "l_score_decayed": _sql("SELECT id, tier2 AS tier, CASE WHEN tier2 <> 'none' THEN br END AS branch, t2 AS total FROM ti"),
    "l_explain": _sql("SELECT id, signal AS part, CAST(p1 AS DOUBLE) AS points, 'fired ' || age || ' days ago' AS rule FROM sp " + " ".join(f"UNION ALL SELECT id, '{d}', {d}, '{d} = ' || {d} FROM ii" for d in m.DIMENSIONS)),
    "l_ranking": _sql("SELECT * FROM s1 ORDER BY icp DESC, total DESC, name, id LIMIT 100"),
    "l_tier_counts": _sql("SELECT tier, count(*) AS accounts FROM s1 GROUP BY 1"),
    "l_features": _sql("SELECT id, " + ", ".join(f"CAST({d} AS DOUBLE) AS {d}" for d in m.DIMENSIONS) + ", " + ", ".join(f"CAST(CAST({'invoices_30d >= 50' if s == 'segment_pql' else _ON[s]} AS INT) AS DOUBLE) AS {s}" for s in m.SIGNALS) + " FROM ii"),
    "l_auc": _sql("SELECT scorer, (sum(y * rank) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS auc FROM av GROUP BY 1"),
    "l_deciles": _sql("SELECT scorer, decile, count(*) AS n, avg(y) AS rate FROM dc GROUP BY 1, 2"),
    "l_lift": _sql("SELECT (SELECT avg(y) FROM dc WHERE decile = 0 AND scorer = 'source') / (SELECT avg(y) FROM dc WHERE scorer = 'source') AS lift"),
    "l_integer_weights": _sql("SELECT * FROM iw"),
    "l_weight_gap": _sql("SELECT signal, weight AS learned, CAST(id % 6 AS INT) AS current, weight - CAST(id % 6 AS INT) AS gap FROM iw JOIN v_leads ON signal = 's' || id WHERE weight <> id % 6"),
    "l_drafts": _sql("SELECT id, branch, subject, body FROM dr"),
    "l_gate": _sql(_GATE),
    "l_config_difference": "SELECT * FROM (VALUES ('segment_pql', 5.0::DOUBLE, 4.0::DOUBLE), ('github_star', 1.0, 2.0)) t(signal, source, current)",
}
