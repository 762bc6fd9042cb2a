"""Media-mix queries on weekly order values by priority; the oracle takes given curves and coefficients."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import mix as m
from millrace.plans.views import view, with_views

CHANNELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _r(df, *cols, places=4):
    return df.withColumns({c: F.round(c, places) for c in cols})


def _spend(spark, d):
    return view(spark, d, "v_mix_spend")


def _levels(spark, d):
    rows = _spend(spark, d).groupBy("panel_id", "channel").agg(F.round(F.avg("spend"), 2).alias("weekly"))
    k = F.substring("channel", 1, 1).cast("double")
    return rows.select("panel_id", "channel", "weekly", (F.col("weekly") * k / 2).alias("half"), (k / 2).alias("shape"), (F.col("weekly") * (6 - k)).alias("beta"))


def _budgets(spark, d):
    return _levels(spark, d).groupBy("panel_id").agg((F.sum("weekly") * 1.1).alias("budget"))


def m_adstock(spark, d):
    return _r(m.adstock(_spend(spark, d), (0.0, 0.5)), "x")


def m_hill(spark, d):
    return _r(m.saturated(m.adstock(_spend(spark, d), (0.5,)), _levels(spark, d).select("panel_id", "channel", F.lit(0.5).alias("decay"), "half", "shape")), "v", places=9)


def m_candidates(spark, d):
    return _r(m.curve_candidates(_spend(spark, d)), "half")


def m_baseline(spark, d):
    return _r(m.baseline(view(spark, d, "v_mix_revenue")), *m.TERMS, places=9).drop("revenue")


def m_wide_export(spark, d):
    return _r(m.wide_export(_spend(spark, d), view(spark, d, "v_mix_revenue"), CHANNELS), "revenue", *CHANNELS, places=2)


def m_panel_errors(spark, d):
    return m.panel_errors(_spend(spark, d), weeks=400, active=340, channels=4)


def m_fit(spark, d):
    return m.fit_panels(_spend(spark, d), view(spark, d, "v_mix_revenue"))


def m_fit_quality(spark, d):
    s, t = _spend(spark, d), view(spark, d, "v_mix_revenue")
    return m.fit_quality(m.fitted(t, m.adstock(s), m.fit_panels(s, t)))


def _decomposed(spark, d):
    s = _spend(spark, d)
    model = _levels(spark, d).select("panel_id", "channel", F.lit(0.5).alias("decay"), "half", "shape", "beta")
    return m.decomposition(s, m.adstock(s, (0.5,)), model)


def m_decomposition(spark, d):
    return _r(_decomposed(spark, d), "spend", "contribution", "roi", places=3)


def m_marginal_roi(spark, d):
    return _r(m.marginal_roi(_levels(spark, d)).select("panel_id", "channel", "marginal"), "marginal", places=6)


def m_response_curve(spark, d):
    return _r(m.response_curve(_levels(spark, d)), "spend", "revenue", places=5)


def m_budget_plan(spark, d):
    return _r(m.budget_plan(_levels(spark, d), _budgets(spark, d)).select("panel_id", "channel", "planned"), "planned", places=5)


def m_global_plan(spark, d):
    """One budget for all panels: 1.1 times what they spend a week now."""
    levels = _levels(spark, d)
    budget = 1.1 * levels.agg(F.sum("weekly")).first()[0]
    return _r(m.global_plan(levels, budget), "weekly", "planned", places=4)


def m_plan_summary(spark, d):
    b = _budgets(spark, d)
    return _r(m.plan_summary(m.budget_plan(_levels(spark, d), b), b), "budget", "planned", "unspent", "revenue_now", "revenue_plan", places=3)


def m_headline(spark, d):
    return m.headline(m.budget_plan(_levels(spark, d), _budgets(spark, d)))


def m_correlation(spark, d):
    return _r(m.channel_correlation(_spend(spark, d)), "r", places=6)


def m_diagnosis(spark, d):
    s = _spend(spark, d)
    return m.recovery_diagnosis(s, m.channel_correlation(s), _decomposed(spark, d), view(spark, d, "v_mix_revenue"))


def m_truth_recovery(spark, d):
    truth = _levels(spark, d).select("panel_id", "channel", F.round(F.col("shape") * 2 / 3, 3).alias("true_roi"))
    return _r(m.truth_recovery(m_decomposition(spark, d), truth), "error", places=3)


def m_validation(spark, d):
    wide = view(spark, d, "v_accounts").selectExpr("id % 9 as panel_id", "id as line", "case when id % 13 > 0 then 'w' end as week", "case when id % 17 = 0 then 'n/a' else concat('€ ', cast(cast(spend as bigint) as string)) end as revenue", "cast(views - 2 as string) as a", "case when id % 19 = 0 then '' else '1_000' end as b")
    return m.validated(wide, ["a", "b"])[1]


QUERIES = {f.__name__: f for f in (
    m_adstock, m_hill, m_candidates, m_baseline, m_wide_export, m_panel_errors, m_fit, m_fit_quality, m_decomposition, m_marginal_roi, m_response_curve,
    m_global_plan, m_budget_plan, m_plan_summary, m_headline, m_correlation, m_diagnosis, m_truth_recovery, m_validation,
)}

_HILL = "CASE WHEN {x} > 0 THEN 1 / (1 + pow(half / ({x}), shape)) ELSE 0.0 END"
_BASE = f"""
sp AS (SELECT *, row_number() OVER (PARTITION BY panel_id, channel ORDER BY week) AS t FROM v_mix_spend),
ad AS (SELECT a.panel_id, a.channel, a.week, a.t, sum(b.spend * pow(0.5, a.t - b.t)) * 0.5 AS x FROM sp a JOIN sp b ON a.panel_id = b.panel_id AND a.channel = b.channel AND b.t <= a.t GROUP BY ALL),
lv AS (SELECT panel_id, channel, round(avg(spend), 2) AS weekly, CAST(channel[1:1] AS DOUBLE) AS k FROM sp GROUP BY 1, 2),
le AS (SELECT *, weekly * k / 2 AS half, k / 2 AS shape, weekly * (6 - k) AS beta FROM lv),
sa AS (SELECT ad.panel_id, ad.channel, week, {_HILL.format(x="ad.x")} AS v, beta FROM ad JOIN le USING (panel_id, channel)),
ct AS (SELECT panel_id, channel, sum(v * beta) AS contribution FROM sa GROUP BY 1, 2),
dc AS (SELECT panel_id, channel, spend, contribution, contribution / spend AS roi FROM (SELECT panel_id, channel, sum(spend) AS spend FROM sp GROUP BY 1, 2) JOIN ct USING (panel_id, channel)),
co AS (SELECT a.panel_id, a.channel AS a, b.channel AS b, coalesce(corr(a.spend, b.spend), 0) AS r FROM sp a JOIN sp b ON a.panel_id = b.panel_id AND a.week = b.week AND a.channel < b.channel GROUP BY ALL),
mh AS (SELECT *, greatest(50.0, 0.01 * weekly) AS h FROM le),
bu AS (SELECT panel_id, sum(weekly) * 1.1 AS budget, sum(weekly * 0.5) AS floors FROM le GROUP BY 1),
es AS (SELECT le.*, kk, weekly * 0.01 AS step, (beta * {_HILL.format(x="weekly * 0.5 + kk * weekly * 0.01")} - beta * {_HILL.format(x="weekly * 0.5")}) / (kk * weekly * 0.01) AS mean FROM le CROSS JOIN (SELECT unnest(range(1, 101)) AS kk)),
eg AS (SELECT *, max(mean) OVER (PARTITION BY panel_id, channel ORDER BY kk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS gain FROM es),
eu AS (SELECT *, sum(step) OVER (PARTITION BY panel_id ORDER BY gain DESC, channel, kk) AS used FROM eg),
et AS (SELECT eu.panel_id, channel, sum(step) AS added FROM eu JOIN bu ON eu.panel_id = bu.panel_id AND used <= budget - floors + 1e-9 GROUP BY 1, 2),
pl AS (SELECT le.*, weekly * 0.5 + coalesce(added, 0) AS planned FROM le LEFT JOIN et USING (panel_id, channel)),
pr AS (SELECT *, beta * {_HILL.format(x="weekly")} AS now, beta * {_HILL.format(x="planned")} AS later, planned - weekly AS ch, 0.005 * sum(weekly) OVER (PARTITION BY panel_id) AS tol FROM pl),
hl AS (SELECT panel_id, count(*) FILTER (ch > tol) AS ups, count(*) FILTER (ch < -tol) AS downs, coalesce(sum(-ch) FILTER (ch < -tol), 0) AS moved, arg_max(channel, ch) AS top, arg_min(channel, ch) AS bottom, sum(later - now) AS gain FROM pr GROUP BY 1),
ht AS (SELECT *, CASE WHEN gain >= 0 THEN '+' ELSE '-' END || CAST(CAST(round(abs(gain)) AS BIGINT) AS VARCHAR) || ' revenue/wk' AS g, 'Shift ' || CAST(CAST(round(moved) AS BIGINT) AS VARCHAR) || '/wk ' AS sh FROM hl),
pk AS (SELECT panel_id, channel, max(spend) AS peak, quantile_cont(spend, 0.25) AS q, coalesce(stddev_samp(spend), 0) / avg(spend) < 0.3 AS flat FROM sp GROUP BY 1, 2),
rs AS (SELECT sp.*, spend > 0.4 * peak AND NOT coalesce(lag(spend > 0.4 * peak) OVER (PARTITION BY panel_id, channel ORDER BY week), false) AS rise FROM sp JOIN pk USING (panel_id, channel)),
rv AS (SELECT panel_id, sum(revenue) AS revenue FROM v_mix_revenue GROUP BY 1),
dg AS (SELECT panel_id, channel, flat, q < 0.1 * peak AS gaps, (SELECT count(*) FROM rs WHERE rs.panel_id = pk.panel_id AND rs.channel = pk.channel AND rise) AS flights, EXISTS (SELECT 1 FROM co WHERE co.panel_id = pk.panel_id AND (a = channel OR b = channel) AND abs(r) > 0.6) AS collinear, contribution / revenue AS share FROM pk JOIN ct USING (panel_id, channel) JOIN rv USING (panel_id))"""


def _sql(select: str) -> str:
    return with_views(_BASE.strip() + "\n" + select, "v_mix_spend", "v_mix_revenue")


_W = ", ".join(f"round({f}(2 * pi() * {k} * t / 52.18), 9) AS {f}{k}" for k in (1, 2, 3) for f in ("sin", "cos"))
_GRID = " CROSS JOIN ".join(f"(SELECT CAST(unnest({list(x)}) AS DOUBLE) AS {n})" for x, n in ((m.DECAYS, "decay"), (m.HALF_SATURATIONS, "h"), (m.SHAPES, "shape")))
ORACLES = {
    "m_adstock": _sql("SELECT panel_id, channel, 0.0::DOUBLE AS decay, week, round(spend, 4) AS x FROM sp UNION ALL SELECT panel_id, channel, 0.5, week, round(x, 4) FROM ad"),
    "m_hill": _sql("SELECT panel_id, channel, week, round(v, 9) AS v FROM sa"),
    "m_candidates": _sql(f"SELECT panel_id, channel, decay, round(lvl * h, 4) AS half, shape FROM (SELECT panel_id, channel, avg(spend) AS lvl FROM sp GROUP BY 1, 2) CROSS JOIN {_GRID}"),
    "m_baseline": _sql(f"SELECT panel_id, week, t, n, round(t / greatest(n - 1, 1), 9) AS trend, {_W} FROM (SELECT panel_id, week, row_number() OVER (PARTITION BY panel_id ORDER BY week) - 1 AS t, count(*) OVER (PARTITION BY panel_id) AS n FROM v_mix_revenue)"),
    "m_wide_export": _sql("SELECT r.panel_id, r.week, round(any_value(revenue), 2) AS revenue, " + ", ".join(f"round(sum(spend) FILTER (channel = '{c}'), 2) AS \"{c}\"" for c in CHANNELS) + " FROM v_mix_revenue r JOIN v_mix_spend s ON s.panel_id = r.panel_id AND s.week = r.week GROUP BY 1, 2"),
    "m_panel_errors": _sql("SELECT panel_id, count(DISTINCT week) || ' weeks, at least 400 are needed' AS error FROM sp GROUP BY 1 HAVING count(DISTINCT week) < 400 UNION ALL SELECT panel_id, count(DISTINCT channel) || ' channels, at most 4 are fitted' FROM sp GROUP BY 1 HAVING count(DISTINCT channel) > 4 UNION ALL SELECT panel_id, channel || ' has spend in ' || count(*) FILTER (spend > 0) || ' weeks, at least 340 are needed' FROM sp GROUP BY panel_id, channel HAVING count(*) FILTER (spend > 0) < 340"),
    "m_decomposition": _sql("SELECT panel_id, channel, round(spend, 3) AS spend, round(contribution, 3) AS contribution, round(roi, 3) AS roi FROM dc"),
    "m_marginal_roi": _sql(f"SELECT panel_id, channel, round((beta * {_HILL.format(x='weekly + h')} - beta * {_HILL.format(x='greatest(weekly - h, 0.0)')}) / (h + least(h, weekly)), 6) AS marginal FROM mh"),
    "m_response_curve": _sql(f"SELECT panel_id, channel, k2 AS k, round(weekly * 2.0 * k2 / 60, 5) AS spend, round(beta * {_HILL.format(x='weekly * 2.0 * k2 / 60')}, 5) AS revenue FROM (SELECT le.* EXCLUDE (k), CAST(unnest(range(61)) AS INTEGER) AS k2 FROM le)"),
    "m_budget_plan": _sql("SELECT panel_id, channel, round(planned, 5) AS planned FROM pl"),
    "m_plan_summary": _sql("SELECT panel_id, round(budget, 3) AS budget, round(sum(planned), 3) AS planned, round(budget - sum(planned), 3) AS unspent, round(sum(now), 3) AS revenue_now, round(sum(later), 3) AS revenue_plan, count(*) FILTER (abs(planned - weekly) > 0.005 * weekly) AS movers FROM pr JOIN bu USING (panel_id) GROUP BY panel_id, budget"),
    "m_headline": _sql("SELECT panel_id, CASE WHEN ups = 0 AND downs = 0 THEN 'Today''s split is already close to the best plan' WHEN ups = 1 AND downs = 1 THEN sh || 'from ' || bottom || ' to ' || top || ': ' || g WHEN ups > 0 AND downs > 0 THEN sh || 'toward ' || top || ': ' || g WHEN ups > 0 THEN 'Extra budget goes mostly to ' || top || ': ' || g ELSE 'Cuts land first on ' || bottom || ': ' || g END AS headline FROM ht"),
    "m_correlation": _sql("SELECT panel_id, a, b, round(r, 6) AS r FROM co"),
    "m_diagnosis": _sql("SELECT panel_id, channel, collinear, flat, flights, flights <= 4 AND gaps AS few_flights, NOT collinear AND NOT flat AND NOT (flights <= 4 AND gaps) AND share < 0.04 AS small FROM dg"),
    "m_truth_recovery": _sql("SELECT panel_id, channel, roi, true_roi, round((roi - true_roi) / true_roi, 3) AS error, abs((roi - true_roi) / true_roi) > 0.2 AS off FROM (SELECT panel_id, channel, round(roi, 3) AS roi, round(shape * 2 / 3, 3) AS true_roi FROM dc JOIN le USING (panel_id, channel))"),
    "m_validation": with_views("e AS (SELECT id % 9 AS panel_id, id AS line, id % 13 = 0 AS w, id % 17 = 0 AS r, id % 17 > 0 AND spend < 1 AS z, views < 2 AS n, id % 19 = 0 AS b FROM v_accounts) SELECT panel_id, line, 'week is missing' AS error FROM e WHERE w UNION ALL SELECT panel_id, line, 'revenue is missing' FROM e WHERE r UNION ALL SELECT panel_id, line, 'revenue must be positive' FROM e WHERE z UNION ALL SELECT panel_id, line, 'a is negative' FROM e WHERE n UNION ALL SELECT panel_id, line, 'b is no number' FROM e WHERE b", "v_accounts"),
}

# All steps of all panels in one order, taken while they fit.
ORACLES["m_global_plan"] = _sql(
    """, gs AS (SELECT * FROM (SELECT panel_id, channel, step, sum(step) OVER (ORDER BY round(gain, 12) DESC, panel_id, channel, kk ROWS UNBOUNDED PRECEDING) AS used FROM eg)
        WHERE used <= (SELECT sum(weekly) * 1.1 - sum(weekly * 0.5) FROM le) + 1e-9), ga AS (SELECT panel_id, channel, sum(step) AS added FROM gs GROUP BY 1, 2)
        SELECT le.panel_id, le.channel, round(weekly, 4) AS weekly, round(weekly * 0.5 + coalesce(added, 0), 4) AS planned FROM le LEFT JOIN ga USING (panel_id, channel)"""
)
