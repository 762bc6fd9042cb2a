"""Input shapes of the operators, derived from the given tables by SQL that Spark and DuckDB both accept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    "v_ledger": """
SELECT e.event_id, e.ts, CAST(e.ts AS DATE) AS day, concat('agent-', CAST(e.user_id % 8 AS STRING)) AS agent_id,
       concat('Agent ', CAST(e.user_id % 4 AS STRING)) AS agent_label,
       CASE e.event_type WHEN 'signup' THEN 'email.send' WHEN 'view' THEN 'page.publish'
            WHEN 'click' THEN 'social.post' WHEN 'purchase' THEN 'ad.budget_change' ELSE 'task.execute' END AS action_type,
       CASE e.event_type WHEN 'signup' THEN 'email' WHEN 'view' THEN 'web'
            WHEN 'click' THEN 'organic_social' WHEN 'purchase' THEN 'paid_search' ELSE 'agent_run' END AS channel,
       concat('ref-', regexp_extract(e.props, '([0-9]+)', 1)) AS subject_ref,
       CASE WHEN e.event_type = 'purchase' THEN e.value END AS budget_new,
       CAST(NULL AS STRING) AS subject, d.text
FROM events e LEFT JOIN documents d ON d.doc_id = CAST(floor(e.event_id / 5) AS BIGINT)""",
    "v_overrides": """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'auto' WHEN event_id % 3 = 1 THEN 'review' ELSE 'block' END AS decision,
       'lead' AS actor_role, event_id % 2 AS seq FROM events WHERE event_id % 7 = 0
UNION ALL SELECT event_id, 'auto' AS decision, 'legal' AS actor_role, 9 AS seq FROM events WHERE event_id % 21 = 0""",
    "v_outcomes": """
SELECT concat('ref-', regexp_extract(props, '([0-9]+)', 1)) AS subject_ref, count(*) AS sessions,
       CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS conversions,
       sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0.0 END) AS revenue
FROM events WHERE event_id % 3 > 0 GROUP BY 1""",
    "v_runlog": """
SELECT user_id % 10 + 10 * CAST(floor(user_id / 40) AS BIGINT) AS run_id,
       row_number() OVER (PARTITION BY user_id % 10 + 10 * CAST(floor(user_id / 40) AS BIGINT) ORDER BY ts, event_id) AS pos, ts,
       CASE CAST(floor(user_id / 10) AS BIGINT) % 4 WHEN 0 THEN 'research' WHEN 1 THEN 'architect' WHEN 2 THEN 'critic' ELSE 'engineer' END AS role,
       CASE WHEN event_id % 50 = 0 THEN 'error' WHEN event_id % 20 = 0 THEN 'ok_with_warnings' ELSE 'ok' END AS status,
       value / 100.0 AS cost_usd, event_type, event_id, user_id
FROM events""",
    "v_contacts": """
SELECT c.c_custkey * 3 + v.k AS row_id, c.c_custkey AS person_id,
       CASE WHEN v.k = 1 THEN upper(f.nick) WHEN v.k = 2 THEN concat('  ', f.first) ELSE f.first END AS first_name,
       concat('Name', CAST(c.c_custkey AS STRING)) AS last_name,
       CASE WHEN v.k = 2 THEN '' ELSE concat(lower(f.nick), CASE WHEN v.k = 1 THEN '+crm@' ELSE '.' END,
            CASE WHEN v.k = 1 THEN '' ELSE CAST(c.c_custkey AS STRING) END,
            CASE WHEN v.k = 1 THEN 'x.example' ELSE '@x.example' END) END AS email,
       concat('0049 30 ', CAST(1000000 + c.c_custkey AS STRING)) AS phone,
       concat(c.c_mktsegment, CASE WHEN v.k = 1 THEN ' GmbH' ELSE '' END) AS company, n.n_name AS country,
       CASE c.c_custkey % 5 WHEN 0 THEN 'VP of Sales' WHEN 1 THEN 'head of IT and ops' WHEN 2 THEN 'CEO'
            WHEN 3 THEN 'Marketing Manager' ELSE '' END AS title,
       CASE (c.c_custkey + v.k) % 4 WHEN 0 THEN 'Lead' WHEN 1 THEN 'Customer' WHEN 2 THEN 'MQL' ELSE '' END AS stage,
       CASE v.k WHEN 0 THEN concat('2026-0', CAST(1 + c.c_custkey % 9 AS STRING), '-1', CAST(c.c_custkey % 10 AS STRING))
            WHEN 1 THEN concat('1', CAST(c.c_custkey % 10 AS STRING), '.0', CAST(1 + c.c_custkey % 9 AS STRING), '.2025')
            ELSE '02/03/2024' END AS last_activity
FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey
JOIN (SELECT 0 AS g, 'Robert' AS first, 'Bob' AS nick UNION ALL SELECT 1, 'Jürgen', 'Juergen'
      UNION ALL SELECT 2, 'Katharina', 'Kate' UNION ALL SELECT 3, 'Thomas', 'Tom') f ON f.g = c.c_custkey % 4
CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) v
WHERE v.k <= c.c_custkey % 3""",
    "v_drafts": """
SELECT doc_id AS draft_id, 'linkedin' AS channel,
       CASE lang WHEN 'de' THEN 'DE' WHEN 'en' THEN 'UK' ELSE 'US' END AS market, text FROM documents""",
    "v_accounts": """
SELECT c.c_custkey AS id, c.c_name AS name, c.c_mktsegment AS industry, coalesce(o.n_orders, 0) AS n_orders,
       coalesce(o.spend, 0.0) AS spend, CAST(coalesce(e.purchases, 0) AS BIGINT) AS purchases, CAST(coalesce(e.signups, 0) AS BIGINT) AS signups,
       CAST(coalesce(e.views, 0) AS BIGINT) AS views, CAST(coalesce(e.clicks, 0) AS BIGINT) AS clicks, CAST(coalesce(e.errors, 0) AS BIGINT) AS errors
FROM customer c
LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS spend FROM orders GROUP BY o_custkey) o
       ON o.o_custkey = c.c_custkey
LEFT JOIN (SELECT user_id, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS purchases,
                  sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS signups,
                  sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS views,
                  sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS clicks,
                  sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS errors
           FROM events GROUP BY user_id) e ON e.user_id = c.c_custkey""",
    "v_geo": """
SELECT CAST(ascii(c.c_mktsegment) AS BIGINT) AS test_id, n.n_name AS geo, CAST(date_trunc('month', o.o_orderdate) AS DATE) AS day,
       CAST(count(*) AS DOUBLE) AS kpi
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY 1, 2, 3""",
    # Money is summed as decimals and rounded once, so that no engine's order of adding shows.
    "v_mix_spend": """
SELECT CAST(n.n_regionkey AS BIGINT) AS panel_id, CAST(date_trunc('week', o.o_orderdate) AS DATE) AS week, o.o_orderpriority AS channel,
       CAST(round(sum(CAST(o.o_totalprice AS DECIMAL(18, 2))), 0) AS DOUBLE) AS spend
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY 1, 2, 3""",
    "v_mix_revenue": """
SELECT CAST(n.n_regionkey AS BIGINT) AS panel_id, CAST(date_trunc('week', o.o_orderdate) AS DATE) AS week,
       CAST(round(sum(CAST(l.l_extendedprice AS DECIMAL(18, 2)) * (1 - CAST(l.l_discount AS DECIMAL(4, 2)))), 2) AS DOUBLE) AS revenue
FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY 1, 2""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view's rows, or a table's, over the tables in sf_dir."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    for t in TABLES:
        if t in sql:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(sql)


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL in front of which the named views are defined."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names) + ",\n" + sql


VIEWS["v_proposals"] = f"""
SELECT run_id, event_id AS proposal_id, role AS filed_by, pos, ts FROM ({VIEWS["v_runlog"]}) l
WHERE role = 'architect' AND event_type = 'signup' AND status <> 'error'"""
_LATEST = f"""
SELECT *, max(CASE WHEN role = 'architect' AND event_type = 'signup' AND status <> 'error' THEN pos END)
          OVER (PARTITION BY run_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS filed_pos
FROM ({VIEWS["v_runlog"]}) l"""
for _name, _which in (("v_objections", "l.event_type = 'error' AND l.event_id % 4 = 0"), ("v_implementations", "l.event_type = 'purchase' AND l.role = 'engineer'")):
    VIEWS[_name] = f"""
SELECT l.run_id, p.proposal_id, l.role, l.pos FROM ({_LATEST}) l
JOIN ({VIEWS["v_proposals"]}) p ON p.run_id = l.run_id AND p.pos = l.filed_pos WHERE {_which} AND l.status <> 'error'"""
VIEWS["v_leads"] = f"""
SELECT id, name, CASE id % 4 WHEN 0 THEN 'flat' WHEN 1 THEN 'subscription' WHEN 2 THEN 'usage-based' ELSE 'hybrid' END AS billing_model,
       CASE id % 6 WHEN 0 THEN 'pre-seed' WHEN 1 THEN 'bootstrapped' WHEN 2 THEN 'seed' WHEN 3 THEN 'series-a' WHEN 4 THEN 'series-b-plus' ELSE 'public' END AS funding_stage,
       n_orders * 17 % 260 AS headcount, n_orders * 7 % 90 AS funding_total_m, id % 5 = 0 AS multi_currency, id % 7 = 0 AS multi_product,
       id % 11 = 0 AS enterprise_contracts, id % 2 = 0 AS api_first, id % 3 = 0 AS high_event_volume, industry,
       n_orders * 9 AS invoices_30d, id % 6 AS plans, id % 5 AS metrics, id % 4 AS seats, id % 9 AS hosting_months, id % 8 = 1 AS payment_failed,
       id % 10 = 3 AS helm, id % 6 = 2 AS fork_main, id % 9 = 4 AS fork_api, id % 7 = 5 AS pypi, id % 4 = 1 AS docker, id % 5 = 2 AS job,
       id % 3 = 1 AS pricing, id % 8 = 6 AS inbound, id % 2 = 1 AS star,
       CASE WHEN (n_orders * 3 + id % 7 + CASE WHEN id % 8 = 6 THEN 9 ELSE 0 END) % 23 > 12 THEN 1 ELSE 0 END AS y, id % 4 AS fold
FROM ({VIEWS["v_accounts"]}) a"""
