"""Geo-lift queries: a test for each market segment, orders a month and nation as its panel; the oracle takes uniform
donor weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import experiments as x
from millrace.plans.storage import materialise
from millrace.plans.views import view, with_views

START = "2000-09-01"


def _base(spark, d):
    panel, counters = x.dense(view(spark, d, "v_geo"))
    panel = materialise(panel, "geo-panel")
    tests = panel.select("test_id").distinct().withColumn("start", F.lit(START).cast("date"))
    cell = panel.filter("geo in ('NATION_1', 'NATION_7')").select("test_id", F.lit("test").alias("cell"), "geo").distinct()
    return panel, counters, tests, cell


def _cells(spark, d, draws=60):
    panel, _, tests, cell = _base(spark, d)
    return panel, tests, materialise(cell.unionByName(x.placebo_cells(panel, tests, cell, draws)), "geo-cells")


def _fitted(spark, d, solve=False):
    panel, tests, cells = _cells(spark, d)
    norm, series = x.normalised(panel, tests), x.cell_series(panel, tests, cells)
    pool = x.donors(norm, cells)
    w = x.donor_weights(x.gram(norm), x.cross_products(norm, series, pool)) if solve else x.uniform_weights(pool)
    return x.counterfactual(norm, series, w), w, norm


def x_dense(spark, d):
    return _base(spark, d)[0]


def x_counters(spark, d):
    return _base(spark, d)[1]


def x_normalised(spark, d):
    panel, _, tests, _ = _base(spark, d)
    return x.normalised(panel, tests).select("test_id", "geo", "day", F.round("z", 9).alias("z"))


def x_gram(spark, d):
    panel, _, tests, _ = _base(spark, d)
    return x.gram(x.normalised(panel, tests)).select("test_id", "i", "j", F.round("g", 6).alias("g"))


def x_cells(spark, d):
    return _cells(spark, d)[2]


def x_metrics(spark, d):
    return _rounded(x.fit_metrics(_fitted(spark, d)[0]), "pre_rmspe", "post_rmspe", "ratio", "lift", "incremental", "mape")


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def x_inference(spark, d):
    found = x.inference(x.fit_metrics(_fitted(spark, d)[0]))
    return _rounded(x.verdicts(found, F.lit(500.0), F.lit(2.0)), "lift", "incremental", "ratio", "mape", "p", "low", "high", "incremental_low", "incremental_high", "iroas")


def x_bands(spark, d):
    return _rounded(x.null_bands(_fitted(spark, d)[0]), "gap", "low", "high", "cumulative", "cum_low", "cum_high")


def x_share(spark, d):
    return _rounded(x.volume_share(*_cells(spark, d)), "share")


def x_injected(spark, d):
    panel, tests, cells = _cells(spark, d)
    return x.injected(panel, tests, cells, 0.1).select("test_id", "geo", "day", F.round("kpi", 6).alias("kpi"))


def x_donor_weights(spark, d):
    return _fitted(spark, d, solve=True)[1]


def x_solved_inference(spark, d):
    return x.inference(x.fit_metrics(_fitted(spark, d, solve=True)[0]))


def x_top_donors(spark, d):
    return x.top_donors(_fitted(spark, d, solve=True)[1])


def x_ratio_histogram(spark, d):
    return x.ratio_histogram(x.fit_metrics(_fitted(spark, d)[0]))


def _backtests(spark, d, solve):
    panel, tests, cells = _cells(spark, d, 12)
    return x.backtest(panel, x.windows(panel, tests), cells, solve)


def x_windows(spark, d):
    panel, _, tests, _ = _base(spark, d)
    return x.windows(panel, tests)


def x_backtests(spark, d):
    return _rounded(_backtests(spark, d, False), "lift")


def x_power(spark, d):
    return x.power_curve(x.null_lifts(_backtests(spark, d, True)))


def _curve(spark, d):
    # To nine places, so that no lift lies on the edge of the threshold in one engine alone.
    null = x.null_lifts(_backtests(spark, d, False)).select("test_id", F.round("null_lift", 9).alias("null_lift"), (F.round("threshold", 9) + 5e-10).alias("threshold"))
    return x.power_curve(null)


def x_power_curve(spark, d):
    return _rounded(_curve(spark, d), "lift", "power")


def x_minimum_effect(spark, d):
    return _rounded(x.minimum_effect(_curve(spark, d)), "mde")


def _ranked(spark, d, solve):
    panel, _, tests, _ = _base(spark, d)
    return x.rank_geos(panel, tests, solve)


def x_ranked_geos(spark, d):
    return _rounded(_ranked(spark, d, False), "mape", "share")


def x_suggest_cell(spark, d):
    return _rounded(x.suggest_cell(x_ranked_geos(spark, d)), "share")


def x_solved_suggestion(spark, d):
    return x.suggest_cell(_ranked(spark, d, True))


def x_panel_errors(spark, d):
    return x.panel_errors(view(spark, d, "v_geo"), geos=26, days=60)


def x_default_start(spark, d):
    return x.default_start(view(spark, d, "v_geo"))


QUERIES = {f.__name__: f for f in (
    x_dense, x_counters, x_normalised, x_gram, x_cells, x_metrics, x_inference, x_bands, x_share, x_injected, x_donor_weights,
    x_solved_inference, x_top_donors, x_ratio_histogram, x_windows, x_backtests, x_power, x_power_curve, x_minimum_effect, x_ranked_geos,
    x_suggest_cell, x_solved_suggestion, x_panel_errors, x_default_start,
)}



def _chain(p: str, panel: str, cells: str) -> str:
    """SQL of the whole chain with uniform weights, for a panel (test_id, geo, day, kpi, pre) and cells: tables {p}mn, {p}nz,
    {p}ft and {p}mt."""
    return f"""
{p}mn AS (SELECT test_id, geo, avg(kpi) FILTER (pre) AS m, sum(kpi) FILTER (pre) AS vol FROM {panel} GROUP BY 1, 2),
{p}nz AS (SELECT q.*, CASE WHEN m <> 0 THEN kpi / m END AS z FROM {panel} q JOIN {p}mn USING (test_id, geo)),
{p}se AS (SELECT *, avg(CASE WHEN pre THEN kpi END) OVER (PARTITION BY test_id, cell) AS cm FROM (SELECT test_id, cell, day, pre, sum(kpi) AS kpi FROM {panel} JOIN {cells} USING (test_id, geo) GROUP BY ALL)),
{p}po AS (SELECT c.test_id, c.cell, g.geo FROM (SELECT DISTINCT test_id, cell FROM {cells}) c JOIN (SELECT DISTINCT test_id, geo FROM {p}nz WHERE z IS NOT NULL) g USING (test_id)
   WHERE NOT EXISTS (SELECT 1 FROM {cells} k WHERE k.test_id = c.test_id AND k.geo = g.geo AND k.cell IN (c.cell, 'test'))),
{p}mx AS (SELECT test_id, cell, day, avg(z) AS mix FROM {p}po JOIN {p}nz USING (test_id, geo) GROUP BY ALL),
{p}ft AS (SELECT q.*, mix * cm AS fit, kpi - mix * cm AS gap FROM {p}se q JOIN {p}mx USING (test_id, cell, day)),
{p}me AS (SELECT test_id, cell, sqrt(avg(gap * gap) FILTER (pre)) AS pre_rmspe, sqrt(avg(gap * gap) FILTER (NOT pre)) AS post_rmspe, sum(gap) FILTER (NOT pre) AS incremental, sum(fit) FILTER (NOT pre) AS ex, avg(abs(gap / kpi)) FILTER (pre AND kpi <> 0) AS mape FROM {p}ft GROUP BY 1, 2),
{p}mt AS (SELECT test_id, cell, pre_rmspe, post_rmspe, CASE WHEN pre_rmspe > 0 THEN post_rmspe / pre_rmspe END AS ratio, CASE WHEN ex <> 0 THEN incremental / ex END AS lift, incremental, mape FROM {p}me)"""


_TEST = "geo IN ('NATION_1', 'NATION_7')"


def _placebos(name: str, draws: int) -> str:
    return f"""
{name}st AS (SELECT test_id, list_sort(list(geo)) AS geos, draw, sum(vol) / any_value(tv) AS size FROM dr WHERE r <= k AND draw < {4 * draws} GROUP BY test_id, draw),
{name}sn AS (SELECT test_id, geos, row_number() OVER (PARTITION BY test_id ORDER BY CASE WHEN size BETWEEN 0.5 AND 2 THEN 0 ELSE 1 END, draw) AS n FROM (SELECT test_id, geos, min(draw) AS draw, any_value(size) AS size FROM {name}st GROUP BY 1, 2)),
{name} AS (SELECT test_id, 'placebo-' || lpad(CAST(n AS VARCHAR), 2, '0') AS cell, unnest(geos) AS geo FROM {name}sn WHERE n <= {draws} UNION ALL SELECT DISTINCT test_id, 'test', geo FROM pn WHERE {_TEST})"""


_BASE = f"""
pn AS (SELECT a.test_id, a.geo, b.day, coalesce(g.kpi, 0.0) AS kpi, g.kpi IS NULL AS miss, b.day < DATE '{START}' AS pre FROM (SELECT DISTINCT test_id, geo FROM v_geo) a JOIN (SELECT DISTINCT test_id, day FROM v_geo) b USING (test_id) LEFT JOIN v_geo g ON g.test_id = a.test_id AND g.geo = a.geo AND g.day = b.day),
mn AS (SELECT test_id, geo, sum(kpi) FILTER (pre) AS vol FROM pn GROUP BY 1, 2),
kt AS (SELECT test_id, count(*) AS k, sum(vol) AS tv FROM mn WHERE {_TEST} GROUP BY 1),
d0 AS (SELECT test_id, draw, geo, vol, k, tv, rank() OVER (PARTITION BY test_id, draw ORDER BY geo) AS g, count(*) OVER (PARTITION BY test_id, draw) AS controls FROM (SELECT unnest(range(240)) AS draw) CROSS JOIN mn JOIN kt USING (test_id) WHERE NOT {_TEST}),
dr AS (SELECT *, row_number() OVER (PARTITION BY test_id, draw ORDER BY CASE WHEN k = 1 THEN lpad(CAST(abs(draw - g + 1) AS VARCHAR), 9, '0') ELSE md5(test_id || '|' || draw || '|' || geo) END, geo) AS r FROM d0 WHERE controls - k >= 2),
{_placebos("ce", 60).strip()},
{_chain("a", "pn", "ce").strip()},
ip AS (SELECT t.test_id, t.lift, t.incremental, t.ratio, t.mape, count(*) AS placebos, count(*) FILTER (p.ratio < t.ratio) AS beaten, t.lift - quantile_cont(p.lift, 0.95) AS low, t.lift - quantile_cont(p.lift, 0.05) AS high FROM amt t JOIN amt p ON t.test_id = p.test_id AND t.cell = 'test' AND p.cell <> 'test' GROUP BY 1, 2, 3, 4, 5),
iq AS (SELECT *, (1 + placebos - beaten) / (placebos + 1) AS p, CASE WHEN low > 0 THEN 'pos' WHEN high < 0 THEN 'neg' ELSE 'none' END AS verdict FROM ip),
bd AS (SELECT *, gap / cm AS rg, sum(gap / cm) OVER (PARTITION BY test_id, cell ORDER BY day) AS cu FROM aft WHERE NOT pre),
ln AS (SELECT test_id, count(DISTINCT day) FILTER (pre) AS n, count(DISTINCT day) FILTER (NOT pre) AS post FROM pn GROUP BY 1),
lk AS (SELECT *, n - post - 28 AS room, least(24, n - post - 27) AS k FROM ln WHERE n - post >= 28),
dy AS (SELECT test_id, day, row_number() OVER (PARTITION BY test_id ORDER BY day) - 1 AS r FROM (SELECT DISTINCT test_id, day FROM pn)),
wi AS (SELECT DISTINCT lk.test_id, d.r AS window_id, d.day AS start, e.day AS stop FROM lk JOIN (SELECT unnest(range(24)) AS i) ON i < k JOIN dy d ON d.test_id = lk.test_id AND d.r = floor(28 + CASE WHEN k > 1 THEN i * room / (k - 1) ELSE 0 END + 0.5) JOIN dy e ON e.test_id = lk.test_id AND e.r = d.r + post)"""
_BACK = f"""
{_placebos("cf", 12).strip()},
bp AS (SELECT pn.test_id * 1000 + window_id AS test_id, geo, day, kpi, day < start AS pre FROM pn JOIN wi USING (test_id) WHERE day < stop),
bc AS (SELECT test_id * 1000 + window_id AS test_id, cell, geo FROM cf JOIN wi USING (test_id)),
{_chain("b", "bp", "bc").strip()},
bt AS (SELECT CAST(test_id // 1000 AS BIGINT) AS test_id, CAST(test_id % 1000 AS INT) AS window_id, cell, lift FROM bmt),
nl AS (SELECT t.test_id, round(lift, 9) AS nl, threshold FROM bt t JOIN (SELECT test_id, round(quantile_cont(lift, 0.95), 9) + 5e-10 AS threshold FROM bt WHERE cell <> 'test' GROUP BY 1) USING (test_id) WHERE cell = 'test'),
pc AS (SELECT test_id, lift, avg(CAST(lift + nl * (1 + lift) > threshold AS DOUBLE)) AS power FROM nl CROSS JOIN (SELECT unnest(range(41)) * CAST(0.2 AS DOUBLE) / 40 AS lift) GROUP BY 1, 2),
pl AS (SELECT *, lag(lift) OVER (PARTITION BY test_id ORDER BY lift) AS l0, lag(power) OVER (PARTITION BY test_id ORDER BY lift) AS p0 FROM pc)"""
_RANK = f"""
al AS (SELECT DISTINCT test_id, geo AS cell, geo FROM pn),
{_chain("r", "pn", "al").strip()},
rg AS (SELECT test_id, cell AS geo, round(mape, 6) AS mape, round(vol / sum(vol) OVER (PARTITION BY test_id), 6) AS share FROM rmt JOIN mn ON mn.test_id = rmt.test_id AND mn.geo = rmt.cell)""".replace("SELECT test_id, cell AS geo, round(mape", "SELECT rmt.test_id, cell AS geo, round(mape").replace("PARTITION BY test_id), 6) AS share", "PARTITION BY rmt.test_id), 6) AS share")
_GREEDY = """
rk AS (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY mape NULLS FIRST, geo) AS r FROM rg),
gr AS (SELECT DISTINCT test_id, CAST(0 AS BIGINT) AS r, CAST(0 AS DOUBLE) AS share, CAST([] AS VARCHAR[]) AS geos FROM rk UNION ALL
   SELECT gr.test_id, rk.r, CASE WHEN gr.share < 0.12 AND rk.share <= 0.06 AND gr.share + rk.share <= 0.2 THEN gr.share + rk.share ELSE gr.share END,
          CASE WHEN gr.share < 0.12 AND rk.share <= 0.06 AND gr.share + rk.share <= 0.2 THEN list_append(geos, geo) ELSE geos END FROM gr JOIN rk ON rk.test_id = gr.test_id AND rk.r = gr.r + 1)"""


def _sql(select: str, *more: str) -> str:
    return with_views(",\n".join([_BASE.strip(), *[m.strip() for m in more]]) + "\n" + select, "v_geo")


_R = lambda *cs: ", ".join(f"round({c}, 6) AS {c}" for c in cs)
ORACLES = {
    "x_dense": _sql("SELECT test_id, geo, day, kpi FROM pn"),
    "x_counters": _sql("SELECT test_id, 0 AS bad, count(*) FILTER (miss) AS missing FROM pn GROUP BY 1"),
    "x_normalised": _sql("SELECT test_id, geo, day, round(z, 9) AS z FROM anz"),
    "x_gram": _sql("SELECT a.test_id, a.geo AS i, b.geo AS j, round(sum(a.z * b.z), 6) AS g FROM anz a JOIN anz b ON a.test_id = b.test_id AND a.day = b.day AND a.geo <= b.geo AND a.pre WHERE a.z IS NOT NULL AND b.z IS NOT NULL GROUP BY 1, 2, 3"),
    "x_cells": _sql("SELECT test_id, cell, geo FROM ce"),
    "x_metrics": _sql("SELECT test_id, cell, " + _R("pre_rmspe", "post_rmspe", "ratio", "lift", "incremental", "mape") + " FROM amt"),
    "x_inference": _sql("SELECT test_id, placebos, beaten, verdict, (verdict <> 'none') <> (p <= 0.1) AS disagrees, mape > 0.1 AS poor_fit, round(low * incremental / lift, 6) AS incremental_low, round(high * incremental / lift, 6) AS incremental_high, round(incremental * 2 / 500, 6) AS iroas, " + _R("lift", "incremental", "ratio", "mape", "p", "low", "high") + " FROM iq"),
    "x_bands": _sql("SELECT test_id, day, round(max(rg) FILTER (cell = 'test'), 6) AS gap, round(quantile_cont(rg, 0.05) FILTER (cell <> 'test'), 6) AS low, round(quantile_cont(rg, 0.95) FILTER (cell <> 'test'), 6) AS high, round(max(cu) FILTER (cell = 'test'), 6) AS cumulative, round(quantile_cont(cu, 0.05) FILTER (cell <> 'test'), 6) AS cum_low, round(quantile_cont(cu, 0.95) FILTER (cell <> 'test'), 6) AS cum_high FROM bd GROUP BY 1, 2"),
    "x_share": _sql("SELECT test_id, cell, round(sum(vol) / any_value(total), 6) AS share FROM ce JOIN mn USING (test_id, geo) JOIN (SELECT test_id, sum(vol) AS total FROM mn GROUP BY 1) USING (test_id) GROUP BY 1, 2"),
    "x_injected": _sql(f"SELECT test_id, geo, day, round(CASE WHEN {_TEST} AND NOT pre THEN kpi * 1.1::DOUBLE ELSE kpi END, 6) AS kpi FROM pn"),
    "x_ratio_histogram": _sql("SELECT test_id, CAST(least(17, floor((ratio - lo) / ((hi - lo) / 18))) AS INTEGER) AS bin, count(*) AS cells FROM amt JOIN (SELECT test_id, min(ratio) AS lo, max(ratio) AS hi FROM amt GROUP BY 1) USING (test_id) GROUP BY 1, 2"),
    "x_windows": _sql("SELECT test_id, CAST(window_id AS INT) AS window_id, start, stop FROM wi"),
    "x_backtests": _sql("SELECT test_id, window_id, cell, round(lift, 6) AS lift FROM bt", _BACK),
    "x_power_curve": _sql("SELECT test_id, " + _R("lift", "power") + " FROM pc", _BACK),
    "x_minimum_effect": _sql("SELECT test_id, round(arg_min(CASE WHEN p0 IS NULL THEN lift ELSE l0 + (0.8 - p0) / (power - p0) * (lift - l0) END, lift) FILTER (power >= 0.8 AND (p0 IS NULL OR p0 < 0.8)), 6) AS mde FROM pl GROUP BY 1", _BACK),
    "x_ranked_geos": _sql("SELECT test_id, geo, mape, share FROM rg", _RANK),
    "x_suggest_cell": _sql("SELECT test_id, geos, round(share, 6) AS share FROM gr QUALIFY row_number() OVER (PARTITION BY test_id ORDER BY r DESC) = 1", _RANK, _GREEDY).replace("WITH ", "WITH RECURSIVE ", 1),
    "x_panel_errors": with_views("n AS (SELECT test_id, count(DISTINCT geo) AS g, count(DISTINCT day) AS d FROM v_geo GROUP BY 1) SELECT test_id, g || ' geos, at least 26 are needed' AS error FROM n WHERE g < 26 UNION ALL SELECT test_id, d || ' days, at least 60 are needed' FROM n WHERE d < 60", "v_geo"),
    "x_default_start": with_views("d AS (SELECT test_id, list_sort(list(DISTINCT day)) AS l FROM v_geo GROUP BY 1) SELECT test_id, l[CAST(floor(len(l) * 0.75) AS BIGINT) + 1] AS start FROM d", "v_geo"),
}
