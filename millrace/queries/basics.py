"""Statistics and source queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import statistics as z
from millrace.plans.views import view
from millrace.sources import actions as src


def z_describe(spark, d):
    out = z.describe(view(spark, d, "lineitem"), "l_quantity", "l_returnflag")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "sd")})


def z_histogram(spark, d):
    return z.histogram(view(spark, d, "lineitem"), "l_quantity", 1.0, 50.0, 18)


def z_normal_equations(spark, d):
    rows = view(spark, d, "lineitem").selectExpr("cast(l_linenumber as double) as a", "cast(l_quantity as double) as b", "1.0D as one", "cast(l_quantity * 2 as double) as y", "l_returnflag")
    return z.normal_equations(rows, "y", ["one", "a", "b"], "l_returnflag")


_RAW = """SELECT event_id, CASE event_id % 5
  WHEN 0 THEN concat('{"provider": "zapier", "ext_id": "e', CAST(event_id AS STRING), '", "zap_title": "Life Cycle Bot ', CAST(user_id % 3 AS STRING), '", "started_at": "2026-08-01T09:05:00Z", "action": {"type": "send_email", "output": {"subject": "s', CAST(user_id AS STRING), '", "body_text": "Hi"}}}')
  WHEN 1 THEN concat('{"provider": "lindy", "ext_id": "e', CAST(event_id AS STRING), '", "agent": "Ads", "agent_key": "ads-bot", "completed_at": "2026-08-02T09:05:00Z", "tool_call": {"tool": "google_ads.update_budget", "args": {"campaign": "c', CAST(user_id AS STRING), '", "daily_budget_usd": 150}}}')
  WHEN 2 THEN concat('{"provider": "lindy", "ext_id": "e', CAST(event_id AS STRING), '", "agent": "Blog", "completed_at": "2026-08-02T09:05:00Z", "tool_call": {"tool": "cms.delete", "args": {}}}')
  WHEN 3 THEN '{"provider": "other"}' ELSE 'no json' END AS raw FROM events"""


def _raw(spark, d):
    view(spark, d, "events").createOrReplaceTempView("events")
    return src.normalise(spark.sql(_RAW))


def s_actions(spark, d):
    return _raw(spark, d)[0].select("event_id", "source", "agent_id", "attribution_confidence", "action_type", "channel", "subject_ref", "budget_new", "day")


def s_quarantine(spark, d):
    return _raw(spark, d)[1].groupBy("reason").agg(F.count("*").alias("rows"))


def s_clicks(spark, d):
    return src.click_events(view(spark, d, "pages").select(F.col("url").alias("href")))


def z_merged_quantiles(spark, d):
    """Quantiles by return flag from sketches by flag and ship month."""
    rows = view(spark, d, "lineitem").withColumn("month", F.date_trunc("month", "l_shipdate"))
    by_month = z.quantile_sketches(rows, "l_extendedprice", "l_returnflag", "month")
    return z.merged_quantiles(by_month, [0.05, 0.25, 0.5, 0.75, 0.95], "l_returnflag")


QUERIES = {f.__name__: f for f in (z_merged_quantiles, z_describe, z_histogram, z_normal_equations, s_actions, s_quarantine, s_clicks)}

ORACLES = {
    "z_describe": "SELECT l_returnflag, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS total, round(avg(CAST(l_quantity AS DOUBLE)), 6) AS mean, round(stddev_samp(CAST(l_quantity AS DOUBLE)), 6) AS sd, quantile_cont(CAST(l_quantity AS DOUBLE), 0.05) AS q05, quantile_cont(CAST(l_quantity AS DOUBLE), 0.5) AS median, quantile_cont(CAST(l_quantity AS DOUBLE), 0.95) AS q95 FROM lineitem GROUP BY 1",
    "z_histogram": "SELECT CAST(least(17, floor((CAST(l_quantity AS DOUBLE) - 1) / (49.0::DOUBLE / 18))) AS INTEGER) AS bin, count(*) AS n FROM lineitem GROUP BY 1",
    "z_normal_equations": "WITH r AS (SELECT l_returnflag, 1.0::DOUBLE AS one, CAST(l_linenumber AS DOUBLE) AS a, CAST(l_quantity AS DOUBLE) AS b, CAST(l_quantity * 2 AS DOUBLE) AS y FROM lineitem) "
    + " UNION ALL ".join(f"SELECT l_returnflag, '{i}' AS i, '{j}' AS j, sum({i} * {j}) AS xx, {f'sum({i} * y)' if i == j else 'NULL'} AS xy FROM r GROUP BY 1" for i, j in (("one", "one"), ("one", "a"), ("one", "b"), ("a", "a"), ("a", "b"), ("b", "b"))),
    "s_actions": "SELECT 'e' || event_id AS event_id, CASE event_id % 5 WHEN 0 THEN 'zapier' ELSE 'lindy' END AS source, CASE event_id % 5 WHEN 0 THEN 'life-cycle-bot-' || (user_id % 3) ELSE 'ads-bot' END AS agent_id, CASE event_id % 5 WHEN 0 THEN 'medium' ELSE 'high' END AS attribution_confidence, CASE event_id % 5 WHEN 0 THEN 'email.send' ELSE 'ad.budget_change' END AS action_type, CASE event_id % 5 WHEN 0 THEN 'email' ELSE 'paid_search' END AS channel, CASE event_id % 5 WHEN 0 THEN 's' ELSE 'c' END || user_id AS subject_ref, CASE event_id % 5 WHEN 1 THEN 150.0::DOUBLE END AS budget_new, CASE event_id % 5 WHEN 0 THEN DATE '2026-08-01' ELSE DATE '2026-08-02' END AS day FROM events WHERE event_id % 5 < 2",
    "s_quarantine": "SELECT CASE event_id % 5 WHEN 2 THEN 'unsupported tool cms.delete' WHEN 3 THEN 'unknown provider other' ELSE 'no provider' END AS reason, count(*) AS rows FROM events WHERE event_id % 5 > 1 GROUP BY 1",
    "s_clicks": "SELECT CASE WHEN regexp_matches(url, '(?i)(^|/)cv(\\.html|\\.pdf|$)') THEN 'cv' WHEN regexp_matches(url, '(?i)^mailto:|/contact') THEN 'contact' WHEN regexp_matches(url, '(?i)llms(-full)?\\.txt') THEN 'agent_surface' ELSE 'outbound' END AS event, count(*) AS clicks FROM pages WHERE regexp_matches(url, '(?i)(^|/)cv(\\.html|\\.pdf|$)|^mailto:|/contact|llms(-full)?\\.txt|^https?://') GROUP BY 1",
}
